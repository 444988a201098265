"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Score: w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j; the pairwise part in linear time as
half of (sum v_i x_i)^2 - sum (v_i x_i)^2, for each of the few factors. Inputs: words, lower-cased
and hashed, weighted log(1 + count) and scaled to length one; structure statistics, each cut into
`STEPS` steps, one input for each step; as metadata the length class of the text. Neither
labels, lang, source nor doc_id ever enter.

It is fitted on a bounded labelled sample, whose sparse inputs the driver gets; scoring runs where
the documents are. Defined cases: null text counts as empty and is scored; without labels of both
kinds nothing is learned and every score is one half, so every document is predicted good; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StructField, StructType

from quadrille.llm import text_stats
from quadrille.llm.common import map_arrow, unused
from quadrille.llm.labelled import sample

WORD_INPUTS = 1 << 15
STEPS = 16
LENGTH_CLASSES = 24
INPUTS = WORD_INPUTS + STEPS * len(text_stats.SHAPE) + LENGTH_CLASSES
#: Upper ends of the steps of a statistic: 0, then evenly on a logarithmic scale up to 20.
ENDS = np.concatenate([[0.0], np.geomspace(0.005, 20, STEPS - 2)])


def inputs(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and values of the inputs that aren't 0."""
    words = text_stats.split(text)
    hashed = np.fromiter(map(crc32, text.lower().encode("utf-8", "surrogatepass").split()), np.uint32) & (WORD_INPUTS - 1)
    index, count = np.unique(hashed, return_counts=True)
    value = np.log1p(count)
    value /= max(float(np.sqrt((value * value).sum())), 1e-9)
    stats = np.array(text_stats.shape(text, words, text_stats.base(text, words)))
    steps = WORD_INPUTS + STEPS * np.arange(len(stats)) + np.searchsorted(ENDS, stats, side="left")
    length = INPUTS - LENGTH_CLASSES + min(len(text).bit_length(), LENGTH_CLASSES - 1)
    rest = np.concatenate([steps, [length]])
    # each kind of input has length one, so that neither outweighs the other
    return np.concatenate([index.astype(np.int64), rest]), np.concatenate([value, np.full(len(rest), len(rest) ** -0.5)])


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margin(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margins of rows whose inputs begin at starts, and their factor sums."""
        scaled = self.factors[index] * value[:, None]
        sums = np.add.reduceat(scaled, starts)
        squares = np.add.reduceat(scaled * scaled, starts)
        return self.bias + np.add.reduceat(self.weights[index] * value, starts) + (sums * sums - squares).sum(1) / 2, sums

    def score(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        for at in range(0, len(texts), 256):
            rows = [inputs(t) for t in texts[at : at + 256]]
            starts = np.cumsum([0, *(len(i) for i, _ in rows[:-1])])
            margin, _ = self.margin(np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]), starts)
            out[at : at + 256] = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return out


def learn(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, factors: int = 8, epochs: int = 8, batch: int = 128, rate: float = 0.1, ridge: float = 1e-5, seed: int = 3) -> Machine:
    """AdaGrad on the logistic loss, both labels weighing the same."""
    rng = np.random.default_rng(seed)
    if not 0 < label.sum() < len(label):
        return Machine(0.0, np.zeros(INPUTS), np.zeros((INPUTS, factors)))
    share = float(np.clip(label.mean(), 1e-3, 1 - 1e-3))
    m = Machine(0.0, np.zeros(INPUTS), rng.normal(0, 0.02, (INPUTS, factors)))
    seen_w, seen_v, seen_b = np.full(INPUTS, 1e-6), np.full((INPUTS, factors), 1e-6), 1e-6
    weight = np.where(label == 1, 0.5 / share, 0.5 / (1 - share))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            lengths = np.array([len(rows[k][0]) for k in some])
            index, value = np.concatenate([rows[k][0] for k in some]), np.concatenate([rows[k][1] for k in some])
            margin, sums = m.margin(index, value, np.concatenate([[0], lengths.cumsum()[:-1]]))
            slope = weight[some] * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label[some]) / len(some)
            of = np.repeat(np.arange(len(some)), lengths)
            touched, back = np.unique(index, return_inverse=True)
            g_w = np.bincount(back, slope[of] * value) + ridge * m.weights[touched]
            pull = (slope[of] * value)[:, None] * (sums[of] - m.factors[index] * value[:, None])
            g_v = np.stack([np.bincount(back, pull[:, f]) for f in range(factors)], 1) + ridge * m.factors[touched]
            seen_w[touched] += g_w * g_w
            seen_v[touched] += g_v * g_v
            seen_b += slope.sum() ** 2
            m.weights[touched] -= rate * g_w / np.sqrt(seen_w[touched])
            m.factors[touched] -= rate / 4 * g_v / np.sqrt(seen_v[touched])
            m.bias -= rate * slope.sum() / np.sqrt(seen_b)
    return m


def fit(docs: DataFrame, labels: DataFrame, rows: int = 6_000) -> Machine:
    """A machine from at most `rows` labelled documents outside the held-out third."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [inputs(t.as_py() or "") for t in batch.column("text")]
            arrays = [batch.column("label"), pa.array([i.astype(np.int32) for i, _ in found], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["label", "index", "value"])

    chosen = sample(docs, labels, rows).select("label", "text")
    schema = StructType([StructField("label", IntegerType()), StructField("index", ArrayType(IntegerType())), StructField("value", ArrayType(FloatType()))])
    got = map_arrow(chosen, encode, schema).orderBy(F.xxhash64("index", "value")).toArrow()
    pairs = [(np.asarray(i.values, np.int64), np.asarray(v.values, float)) for i, v in zip(got["index"], got["value"], strict=True)]
    return learn(pairs, got["label"].to_numpy().astype(float))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """docs with score (0 to 1) and predicted; their other columns as they are."""
    name, mark = unused(docs, "score"), unused(docs, "predicted")
    shipped = docs.sparkSession.sparkContext.broadcast(machine)
    text = docs.columns.index("text")
    # by number, since not every name gets through to Python
    numbered = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shipped.value.score([t.as_py() or "" for t in batch.column(text)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, "score"])

    schema = StructType([*numbered.schema.fields, StructField("score", DoubleType())])
    return map_arrow(numbered, apply, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int")).toDF(*docs.columns, name, mark)
