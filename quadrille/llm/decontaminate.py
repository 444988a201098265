"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k edits is cut into k + 1 pieces; wherever a document holds
the item with at most k edits, at least one piece stands there unchanged. An Aho-Corasick automaton of all
pieces finds the exact hits in a document, and the text around each hit is verified with Myers'
bit-parallel distance, one step for each character whatever the item's length. Hits on the same
stretch are verified once.

Items and documents are compared in lower case with runs of white space as one space. The
budget is `error_rate` of the item's length, rounded down. Items are dealt to blocks of about `block_bytes` by
a hash, and each block is sent to the executors and held against all documents, in one pass where
the benchmark fits one block, as those in use do; a larger one takes a pass for each block. A piece that
is common text costs a verification, as many steps as the item is long, at each stretch where it stands.

Defined cases: null or blank items match nothing; null texts count as empty; repeated items with one
id count once; an item id may be of any type, and a null one is kept as null; repeated rows are matched each; an empty table on either side gives no
match and removes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quadrille.llm.common import columns, cut, key_of, map_arrow, unused

SPACE = re.compile(r"[ \t\n\v\f\r]+")


def normal(text: str | None) -> str:
    return SPACE.sub(" ", (text or "").lower()).strip()


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of nearly equal length, with their places."""
    n = errors + 1
    ends = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def best_match(masks: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """Least edit distance between the pattern and any part of text, and where that part ends (Myers 1999)."""
    ones, top = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score, best, end = ones, 0, length, length, 0
    for at, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        vertical = eq | minus
        horizontal = ((((eq & plus) + plus) ^ plus) | eq) & ones
        up, down = (minus | ~(horizontal | plus)) & ones, plus & horizontal
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 & ones, down << 1 & ones
        plus, minus = (down | ~(vertical | up)) & ones, up & vertical
        if score < best:
            best, end = score, at
    return best, end


def masks_of(item: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for k, c in enumerate(item):
        found[c] = found.get(c, 0) | 1 << k
    return found


class Matcher:
    def __init__(self, items: list[str], error_rate: float) -> None:
        self.items = [(item, int(len(item) * error_rate)) for item in items]
        self.masks = [masks_of(item) for item, _ in self.items]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (item, errors) in enumerate(self.items):
            for at, piece in pieces(item, errors):
                places.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item, distance, end in the normal text): the best match of each item within its budget."""
        text = normal(text)
        wanted: dict[int, list[int]] = {}
        for last, (length, where) in self.automaton.iter(text):
            for k, at in where:
                wanted.setdefault(k, []).append(last + 1 - length - at)
        found = []
        for k, starts in wanted.items():
            item, errors = self.items[k]
            best, end = errors + 1, 0
            # a stretch from a start may begin and end up to `errors` off; stretches that overlap are gone through once, as one
            low = high = None
            for start in [*sorted(set(starts)), None]:
                if start is not None and high is not None and start - errors <= high:
                    high = start + len(item) + errors
                    continue
                if high is not None:
                    distance, at = best_match(self.masks[k], len(item), text[low:high])
                    if distance < best:
                        best, end = distance, low + at
                if start is not None:
                    low, high = max(start - errors, 0), start + len(item) + errors
            if best <= errors:
                found.append((k, best, end))
        return found


def matches(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.08, block_bytes: int = 2 << 20, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, item_id, distance and match_end (in the normal text), a row for each document and item that match."""
    carry = list(carry)
    items = cut(benchmark.select("item_id", F.col("text").cast("string").alias("text")).filter("text is not null").distinct())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    dealt = items.withColumn("_block", F.pmod(F.xxhash64("text"), F.lit(blocks)))
    source = docs.select(*carry, F.col("text").cast("string").alias("text"))
    item_type = benchmark.schema["item_id"].dataType
    schema = StructType([*(docs.schema[c] for c in carry), StructField("item_id", item_type), StructField("distance", LongType()), StructField("match_end", LongType())])
    found = []
    for b in range(blocks):
        got = dealt.filter(F.col("_block") == b).select("item_id", "text").toArrow()  # about `block_bytes`
        texts = [normal(t) for t in got["text"].to_pylist()]
        named = [k for k, t in enumerate(texts) if t]
        ids = got["item_id"].take(pa.array(named, pa.int64())).combine_chunks()
        shipped = docs.sparkSession.sparkContext.broadcast((ids, [texts[k] for k in named]))

        def scan(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            ids, texts = shipped.value
            matcher = Matcher(texts, error_rate) if texts else None
            for batch in batches if matcher else ():
                rows, item, distance, end = [], [], [], []
                for r, t in enumerate(batch.column("text")):
                    for k, d, e in matcher.find(t.as_py() or ""):
                        rows.append(r)
                        item.append(k)
                        distance.append(d)
                        end.append(e)
                taken = [batch.column(c).take(pa.array(rows, pa.int64())) for c in carry]
                columns = [*taken, ids.take(pa.array(item, pa.int64())), pa.array(distance, pa.int64()), pa.array(end, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*carry, "item_id", "distance", "match_end"])

        found.append(map_arrow(source, scan, schema))
    return reduce(DataFrame.unionByName, found)


def clean(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.08, block_bytes: int = 2 << 20) -> DataFrame:
    """docs without those that hold a test item."""
    key = unused(docs, "_key")
    keyed = docs.withColumn(key, key_of())
    hit = matches(keyed.select("text", F.col(key).alias("_k")), benchmark, error_rate, block_bytes, ("_k",)).select(F.col("_k").alias(key)).distinct()
    return keyed.join(hit, key, "left_anti").select(*columns(docs))
