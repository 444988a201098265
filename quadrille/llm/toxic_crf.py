"""Toxicity: a linear-chain conditional random field over words with the tags clean and toxic.

Inputs of a word are hashes of the word in lower case and of its first 4 to 7 letters, its shape (capitals) and a bias; tags of
neighbouring words are tied by transitions. Documents are labelled, words aren't, so word labels are made first: inputs that
hardly occur in clean documents are taken by the weight of the toxic documents they occur in, each taken one halving the weight of its documents, until one would add
little (near copies of a document count once, else its rare words would count as toxic). In toxic documents words with such an input are
toxic, all others are clean, and the field's likelihood of these tags is climbed by AdaGrad, with expectations from the forward-backward
pass. A document's score is a logistic function of its largest marginal and of the sum of its marginals, fitted on the sample; its spans
are the runs of words whose marginal is one half or more, in code points.

The forward-backward pass is run over many documents at once: the words of all of them, one after the other, are cut into as many
lanes as each has steps; lanes first multiply their 2x2 matrices, then get their true start and go once more. A document's
start is a matrix that forgets what was before.

It is fitted on at most `rows` labelled documents of each label, of at most MOST_CHARS characters each (longer ones are
scored, not learned from). Labels, lang, source and doc_id are never inputs.
Defined cases: null text counts as empty and has the score of a text without words; without labels of both kinds, or without any input
that tells them apart, every score is below one half, so nothing is called toxic; repeated rows are scored each; other columns are kept, and added ones take free names; an
empty table has no rows. Texts are scored whole; a batch of texts holds about BATCH_WORDS words, or one text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from quadrille.llm.common import map_arrow, unused

TOKEN = re.compile(r"[^\W\d_]+")
HASHED = 1 << 18
SHAPES = 3
PREFIXES = (4, 5, 6, 7)
#: Hashed inputs, shapes, bias, and a last one that stands for no input.
BIAS = HASHED + SHAPES
NONE = BIAS + 1
MOST_CHARS = 50_000
BATCH_WORDS = 1 << 19
#: Words remembered by a task.
REMEMBERED = 1 << 20


def held_out() -> Column:
    """Labels of a fifth of the documents, by a checksum of the id, are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def inputs(word: str) -> list[int]:
    """The inputs of a word, as many for each."""
    low = word.lower()
    hashed = lambda k, s: crc32(f"{k}:{s}".encode("utf-8", "surrogatepass")) & (HASHED - 1)
    shape = 2 if len(word) > 1 and word.isupper() else 1 if word[:1].isupper() else 0
    return [hashed(0, low), *[hashed(k, low[:k]) if len(low) >= k else NONE for k in PREFIXES], HASHED + shape, BIAS]


def _lanes(values: np.ndarray, fill: float, lanes: int, steps: int) -> np.ndarray:
    out = np.full(lanes * steps, fill)
    out[: len(values)] = values
    return np.ascontiguousarray(out.reshape(lanes, steps).T)


def _through(a: np.ndarray) -> np.ndarray:
    """Products over vectors: a is (steps, 4, lanes), row-wise 2x2 matrices; the share of the second component after each step, (steps, lanes)."""
    steps, _, lanes = a.shape
    m00, m01, m10, m11 = np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes)
    for k in range(steps):
        p, q, r, s = a[k]
        m00, m01, m10, m11 = p * m00 + q * m10, p * m01 + q * m11, r * m00 + s * m10, r * m01 + s * m11
        total = m00 + m01 + m10 + m11
        m00, m01, m10, m11 = m00 / total, m01 / total, m10 / total, m11 / total
    first = np.empty(lanes)
    share = 0.5
    for k, (p, q, r, s) in enumerate(zip(m00.tolist(), m01.tolist(), m10.tolist(), m11.tolist(), strict=True)):
        first[k] = share
        up, down = r * (1 - share) + s * share, p * (1 - share) + q * share
        share = up / (up + down)
    out = np.empty((steps, lanes))
    high = first
    for k in range(steps):
        p, q, r, s = a[k]
        low = 1 - high
        down, up = p * low + q * high, r * low + s * high
        high = up / (up + down)
        out[k] = high
    return out


class Known(dict):
    """Words and what their inputs add up to."""

    def __init__(self, weights: np.ndarray) -> None:
        super().__init__()
        self.weights = weights.tolist()

    def __missing__(self, word: str) -> float:
        self[word] = found = sum(self.weights[k] for k in inputs(word))
        return found


@dataclass
class Field:
    weights: np.ndarray
    #: Logarithms of transitions clean-toxic, toxic-clean, toxic-toxic and of a toxic start.
    moves: np.ndarray
    #: Of the score: constant, largest marginal, sum of marginals.
    scale: np.ndarray
    known: Known | None = None

    def emissions(self, words: list[str]) -> np.ndarray:
        if self.known is None or len(self.known) > REMEMBERED:
            self.known = Known(self.weights)
        return np.fromiter(map(self.known.__getitem__, words), float, len(words))

    def passes(self, e: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shares of toxic in the forward and backward vectors, and the emissions' exponentials."""
        n = len(e)
        steps = max(int(np.sqrt(n)), 1)
        lanes = -(-n // steps)
        x = np.exp(np.clip(e, -25, 25))
        t01, t10, t11, s = np.exp(self.moves)
        fresh = np.zeros(n, bool)
        fresh[starts] = True
        y, b = _lanes(x, 1.0, lanes, steps), _lanes(fresh, 1.0, lanes, steps) > 0
        forward = np.stack([np.ones_like(y), np.where(b, 1.0, t10), np.where(b, s, t01) * y, np.where(b, s, t11) * y], 1)
        f = _through(forward).T.reshape(-1)[:n]
        # backward: what comes after a word, from the last one on; a document's last word sees a start after it
        after_x, after_b = np.append(x[1:], 1.0)[::-1], np.append(fresh[1:], True)[::-1]
        z, b = _lanes(after_x, 1.0, lanes, steps), _lanes(after_b, 1.0, lanes, steps) > 0
        backward = np.stack([np.ones_like(z), np.where(b, 1.0, t01 * z), np.where(b, 1.0, t10), np.where(b, 1.0, t11 * z)], 1)
        g = _through(backward).T.reshape(-1)[:n][::-1]
        return f, g, x

    def marginals(self, e: np.ndarray, starts: np.ndarray) -> np.ndarray:
        f, g, _ = self.passes(e, starts)
        return f * g / (f * g + (1 - f) * (1 - g))

    def summary(self, m: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of each document: constant, log-odds of the largest marginal, logarithm of their sum."""
        top, total = np.zeros(len(sizes)), np.zeros(len(sizes))
        full = sizes > 0
        if full.any():
            at = starts[full]
            top[full], total[full] = np.maximum.reduceat(m, at), np.add.reduceat(m, at)
        top = np.clip(top, 1e-4, 1 - 1e-4)
        return np.stack([np.ones(len(sizes)), np.log(top / (1 - top)), np.log(total + 1e-3)], 1)

    def tag(self, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Scores and spans."""
        words = [TOKEN.findall(t) for t in texts]
        sizes = np.array([len(w) for w in words])
        starts = np.concatenate([[0], sizes.cumsum()[:-1]])
        flat = [w for some in words for w in some]
        m = self.marginals(self.emissions(flat), starts[sizes > 0]) if flat else np.zeros(0)
        score = 1 / (1 + np.exp(-(self.summary(m, starts, sizes) @ self.scale)))
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        hot = m >= 0.5
        for k in np.unique(np.searchsorted(starts, np.flatnonzero(hot), side="right") - 1):
            k = int(k)
            while not sizes[k]:  # empty texts begin where the next one does
                k += 1
            going = False
            for on, found in zip(hot[starts[k] : starts[k] + sizes[k]].tolist(), TOKEN.finditer(texts[k]), strict=True):
                if on and going:
                    spans[k][-1] = (spans[k][-1][0], found.end())
                elif on:
                    spans[k].append(found.span())
                going = on
        return score, spans


def _cover(doc: np.ndarray, inp: np.ndarray, toxic: np.ndarray) -> list[int]:
    """Inputs that tell toxic documents, chosen one by one by the weight of their documents; (doc, inp) are distinct pairs."""
    n_toxic, n_clean = int(toxic.sum()), int((~toxic).sum())
    hits = np.bincount(inp[toxic[doc]], minlength=NONE + 1)
    false = np.bincount(inp[~toxic[doc]], minlength=NONE + 1)
    least = max(4, n_toxic // 100)
    usable = (hits >= least) & (hits / max(n_toxic, 1) >= 20 * (false + 0.5) / max(n_clean, 1))
    usable[HASHED:] = False
    keep = toxic[doc] & usable[inp]
    doc, inp = doc[keep], inp[keep]
    chosen, weight = [], np.ones(len(toxic))
    while len(inp):
        gain = np.bincount(inp, weight[doc], minlength=HASHED)
        gain[chosen] = 0
        best = int((gain - 2 * false[:HASHED] * (gain > 0)).argmax())
        if gain[best] < least:
            break
        chosen.append(best)
        weight[doc[inp == best]] *= 0.5
    return chosen


def learn(texts: list[str], label: np.ndarray, rounds: int = 40, rate: float = 0.5, ridge: float = 1e-3) -> Field:
    nothing = Field(np.zeros(NONE + 1), np.zeros(4), np.array([-4.0, 0.0, 0.0]))
    words = [TOKEN.findall(t) for t in texts]
    sketches, keep = set(), []
    for k, some in enumerate(words):  # near copies share the two words of least hash
        least = tuple(sorted({crc32(w.encode("utf-8", "surrogatepass")) for w in set(some)})[:2])
        if some and (least, label[k]) not in sketches:
            sketches.add((least, label[k]))
            keep.append(k)
    words, toxic = [words[k] for k in keep], np.asarray(label)[keep] == 1
    if not 0 < toxic.sum() < len(toxic):
        return nothing
    kinds = {w: k for k, w in enumerate(dict.fromkeys(w for some in words for w in some))}
    of_kind = np.array([inputs(w) for w in kinds])
    kind = np.fromiter((kinds[w] for some in words for w in some), np.int64)
    sizes = np.array([len(w) for w in words])
    starts = np.concatenate([[0], sizes.cumsum()[:-1]])
    doc = np.repeat(np.arange(len(words)), sizes)
    pairs = np.unique(doc * len(kinds) + kind)
    both = np.unique((pairs // len(kinds))[:, None] * (NONE + 1) + of_kind[pairs % len(kinds)])
    chosen = _cover(both // (NONE + 1), both % (NONE + 1), toxic)
    if not chosen:
        return nothing
    y = np.isin(of_kind, chosen).any(1)[kind] & toxic[doc]
    inner = np.ones(len(kind), bool)
    inner[starts] = False
    before, after = np.flatnonzero(inner) - 1, np.flatnonzero(inner)
    seen_moves = np.array([(~y[before] & y[after]).sum(), (y[before] & ~y[after]).sum(), (y[before] & y[after]).sum(), y[starts].sum()], float)
    made = Field(np.zeros(NONE + 1), np.zeros(4), np.zeros(3))
    made.weights[BIAS] = -3.0
    squares, move_squares = np.full(NONE + 1, 1e-6), np.full(4, 1e-6)
    size = len(words)
    for _ in range(rounds):
        e = made.weights[of_kind].sum(1)[kind]
        f, g, x = made.passes(e, starts)
        m = f * g / (f * g + (1 - f) * (1 - g))
        slope = np.bincount(of_kind.reshape(-1), np.repeat(np.bincount(kind, m - y, minlength=len(kinds)), of_kind.shape[1]), minlength=NONE + 1) / size + ridge * made.weights / size
        slope[NONE] = 0
        t01, t10, t11, _ = np.exp(made.moves)
        p, q, z = f[before], g[after], x[after]
        ways = np.stack([(1 - p) * (1 - q), (1 - p) * t01 * z * q, p * t10 * (1 - q), p * t11 * z * q])
        expected = (ways / ways.sum(0))[1:].sum(1)
        move_slope = (np.append(expected, m[starts].sum()) - seen_moves) / size
        squares += slope * slope
        move_squares += move_slope * move_slope
        made.weights -= rate * slope / np.sqrt(squares)
        made.moves -= rate / 4 * move_slope / np.sqrt(move_squares)
    made.scale = _logistic(made.summary(made.marginals(made.weights[of_kind].sum(1)[kind], starts), starts, sizes), toxic.astype(float))
    return made


def _logistic(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Newton steps on the logistic loss, with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (p - label) + 0.1 * w)
    return w


def sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, label): at most `rows` documents of each label outside the held-out fifth, the same at every run.

    Ids in the order of their hashes; of several documents with an id the one whose text has the least hash; of several labels the
    least; rows without id or label are none. What is broadcast is 2 * rows ids at most.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy(F.col("doc_id").alias("_id")).agg(F.min("toxic").cast("int").alias("label"))
    chosen = [usable.filter(F.col("label") == k).orderBy(F.xxhash64("_id"), "_id").limit(rows) for k in (0, 1)]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    short = docs.select("doc_id", text.alias("text")).filter(F.char_length("text") <= MOST_CHARS)
    found = short.join(F.broadcast(chosen[0].unionByName(chosen[1])), F.col("doc_id") == F.col("_id"))
    one = found.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("of"))
    return one.select(F.col("of.text").alias("text"), "label")


def fit(docs: DataFrame, labels: DataFrame, rows: int = 1_500) -> Field:
    got = sample(docs, labels, rows).orderBy(F.xxhash64("text"), "text", "label").toArrow()
    return learn(got["text"].to_pylist(), got["label"].to_numpy())


SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))


def tag(docs: DataFrame, found: Field) -> DataFrame:
    """docs with score (0 to 1), predicted and spans (code points, end exclusive)."""
    names = [unused(docs, n) for n in ("score", "spans", "predicted")]
    shipped = docs.sparkSession.sparkContext.broadcast(Field(found.weights, found.moves, found.scale))
    at = docs.columns.index("text")
    numbered = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # by number, since not every name gets through to Python

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            texts = [str(t) if t is not None else "" for t in batch.column(at).to_pylist()]
            begun = 0
            while begun < len(texts):
                ended, chars = begun, 0
                while ended < len(texts) and (ended == begun or chars + len(texts[ended]) <= 6 * BATCH_WORDS):
                    chars += len(texts[ended])
                    ended += 1
                score, spans = model.tag(texts[begun:ended])
                part = batch.slice(begun, ended - begun)
                told = pa.array([[{"start": a, "end": b} for a, b in some] for some in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), told], [*batch.schema.names, "score", "spans"])
                begun = ended

    schema = StructType([*numbered.schema.fields, StructField("score", DoubleType()), StructField("spans", SPANS)])
    return map_arrow(numbered, apply, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int")).toDF(*docs.columns, *names)
