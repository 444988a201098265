"""Quality rules as gradient-boosted trees over document statistics.

The trees are grown here, on histograms of a bounded labelled sample, with logistic loss. Features
named in MONOTONE may only push the verdict one way: a split that would break the order is refused,
and each child's values are bounded by the middle of its split. Fitted trees are flattened into
numpy node arrays (feature, cut, left, right, value), and a batch of documents walks all of them level by level.

Scores depend on the text alone. Defined cases: null text counts as empty; without labels of both
kinds there are no trees, every score is one half and every document passes; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from quadrille.llm import text_stats
from quadrille.llm.common import map_arrow
from quadrille.llm.labelled import sample

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: -1: more of it never makes a document better.
MONOTONE = {"symbols_per_word": -1, "dup_line_share": -1, "repeat_word_share": -1, "bang_per_word": -1, "bar_per_word": -1, "distinct_share": 1}
SIGNS = np.array([MONOTONE.get(name, 0) for name in text_stats.SHAPE])


@dataclass
class Trees:
    """Node arrays of all trees one after another; roots has each tree's first node. A leaf points to itself."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for at in range(0, len(x), 4096):
            block = x[at : at + 4096]
            node = np.broadcast_to(self.roots, (len(block), len(self.roots)))
            rows = np.arange(len(block))[:, None]
            for _ in range(self.depth):
                node = np.where(block[rows, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
            total[at : at + 4096] += self.value[node].sum(1)
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, signs: np.ndarray = SIGNS, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 5.0) -> Trees:
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    feature, cut, left, right, value, roots = [], [], [], [], [], []
    both = 0 < y.sum() < len(y)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if both else 0.5
    start = float(np.log(share / (1 - share)))
    margin = np.full(len(y), start)

    def new_node() -> int:
        k = len(feature)
        for column, v in ((feature, 0), (cut, np.inf), (left, k), (right, k), (value, 0.0)):
            column.append(v)
        return k

    def split(k: int, rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, levels: int) -> None:
        weight = lambda a, b: np.clip(-a / (b + ridge), low, high)
        value[k] = rate * float(weight(g[rows].sum(), h[rows].sum()))
        if not levels or len(rows) < 2 * least:
            margin[rows] += value[k]
            return
        gain_of = lambda a, b, w: -(a * w + (b + ridge) * w * w / 2)
        total_g, total_h, best = g[rows].sum(), h[rows].sum(), (1e-6, None)
        here = gain_of(total_g, total_h, weight(total_g, total_h))
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            gl, hl, nl = (np.bincount(binned[rows, f], w, len(c) + 1)[:-1].cumsum() for w in (g[rows], h[rows], np.ones(len(rows))))
            wl, wr = weight(gl, hl), weight(total_g - gl, total_h - hl)
            gain = gain_of(gl, hl, wl) + gain_of(total_g - gl, total_h - hl, wr) - here
            gain[(nl < least) | (len(rows) - nl < least) | (signs[f] * (wr - wl) < 0)] = 0
            if gain.max() > best[0]:
                at = int(gain.argmax())
                best = (float(gain[at]), (f, at, float(wl[at] + wr[at]) / 2))
        if best[1] is None:
            margin[rows] += value[k]
            return
        f, at, middle = best[1]
        goes_left = binned[rows, f] <= at
        feature[k], cut[k], left[k], right[k] = f, float(cuts[f][at]), new_node(), new_node()
        bounds = ((low, high), (low, high)) if not signs[f] else ((low, middle), (middle, high)) if signs[f] > 0 else ((middle, high), (low, middle))
        split(left[k], rows[goes_left], g, h, *bounds[0], levels - 1)
        split(right[k], rows[~goes_left], g, h, *bounds[1], levels - 1)

    for _ in range(rounds if both else 0):
        p = 1 / (1 + np.exp(-margin))
        roots.append(new_node())
        split(roots[-1], np.arange(len(y)), p - y, p * (1 - p), -np.inf, np.inf, depth)
    return Trees(*(np.array(v, t) for v, t in ((feature, np.int64), (cut, float), (left, np.int64), (right, np.int64), (value, float), (roots, np.int64))), start, depth)


def statistics(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), trees: Trees | None = None) -> DataFrame:
    """The carried columns, the base counts, and either the shape statistics or, given trees, the score."""
    carry = list(carry)
    more = ["score"] if trees else list(text_stats.SHAPE)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shapes = [], []
            for t in batch.column("text"):
                text = t.as_py() or ""
                words = text_stats.split(text)
                counts.append(text_stats.base(text, words))
                shapes.append(text_stats.shape(text, words, counts[-1]))
            x = np.array(shapes, float).reshape(-1, len(text_stats.SHAPE))
            c = np.array(counts, np.int64).reshape(-1, len(BASE))
            x = trees.score(x)[:, None] if trees else x
            columns = [batch.column(name) for name in carry] + [pa.array(v) for v in c.T] + [pa.array(v) for v in x.T]
            yield pa.RecordBatch.from_arrays(columns, [*carry, *BASE, *more])

    schema = StructType([*(docs.schema[c] for c in carry), *(StructField(c, LongType()) for c in BASE), *(StructField(c, DoubleType()) for c in more)])
    return map_arrow(docs.select(*carry, F.col("text").cast("string").alias("text")), measure, schema)


def fit(docs: DataFrame, labels: DataFrame, rows: int = 20_000) -> Trees:
    """Trees from at most `rows` labelled documents; the driver gets their statistics, 14 numbers each."""
    learned = statistics(sample(docs, labels, rows), ("label",)).toPandas()
    learned = learned.sort_values(list(learned.columns))
    return grow(learned[list(text_stats.SHAPE)].to_numpy(float), learned["label"].to_numpy(float))


def judge(docs: DataFrame, trees: Trees, at_least: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept, a row for each document."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return statistics(docs, ("doc_id",), trees).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= at_least))
