"""SimHash near-duplicates through deletion variants.

Fingerprint: A-Z of the text in lower case, words of non-white-space, shingles of `words` words
with their repeats, XXH64 of each (seed 42); a bit is 1 if it is set in over half of the hashes.

Links: fingerprints that differ in at most two bits. Cut into two halves, one half then differs in
at most one bit. Half values are indexed under variants with one wildcard bit; a variant with 0 at
that bit meets the one with 1 by an equality join, which gives all pairs of half values one bit
apart. Fingerprints of such half values, and those of the same half value, are then verified on all
64 bits. Only distinct fingerprints enter, so exact copies cost one row.

A few half values may be shared by very many fingerprints. Groups above `pairs_up_to` members
aren't paired: their members get wildcard variants of the other half too (two bits where the half
is equal, one where it differs by one), and all members of such a variant are within two bits of
each other, so each is linked to the least of them. No link is lost; classes come out the same.

Defined cases: null or white-space text has fingerprint 0 and is linked like any other; fewer words
than a shingle: the whole sequence is the one shingle; a null doc_id is linked and gets the component's
id, but never names one unless all ids are null; repeated rows stay; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quadrille.llm.common import columns, cut, key_of, map_arrow, meet, unused
from quadrille.llm.components import components

HALF = 32
MASK = (1 << HALF) - 1


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest, n = xxhash.xxh64_intdigest, len(tokens) - words + 1
    if not tokens:
        return np.zeros(0, "<u8")
    if n <= 1:
        return np.array([digest(b" ".join(tokens), 42)], "<u8")
    return np.fromiter((digest(s, 42) for s in map(b" ".join, zip(*[tokens[i:] for i in range(words)], strict=False))), "<u8", n)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        block = hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    return majority(shingle_hashes(text, words))


def with_fingerprint(docs: DataFrame, words: int = 3, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and fp, the 64-bit fingerprint of text as a signed long."""
    carry = list(carry)

    def stamp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column("text")], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(found, pa.int64())], [*carry, "fp"])

    schema = StructType([*(docs.schema[c] for c in carry), StructField("fp", LongType())])
    return map_arrow(docs.select(*carry, F.col("text").cast("string").alias("text")), stamp, schema)


def _half(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, HALF * k).bitwiseAND(F.lit(MASK))


def links(fps: DataFrame, pairs_up_to: int = 256) -> DataFrame:
    """Distinct fp -> (a, b): links whose transitive closure equals that of all links within two bits."""
    halves = fps.select("fp", F.posexplode(F.array(_half(F.col("fp"), 0), _half(F.col("fp"), 1))).alias("k", "half"))
    other = F.when(F.col("k") == 0, _half(F.col("fp"), 1)).otherwise(_half(F.col("fp"), 0))
    members = cut(halves.withColumn("rest", other))
    counted = cut(members.groupBy("k", "half").agg(F.count(F.lit(1)).alias("n")))

    bit = F.expr("shiftleft(1L, j)")
    variants = counted.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(HALF - 1))))
    masked = F.col("half").bitwiseAND(F.bitwise_not(bit))
    zero = variants.filter(F.col("half").bitwiseAND(bit) == 0).select("k", "j", F.col("half").alias("low"), F.col("n").alias("n_low"), masked.alias("v"))
    one = variants.filter(F.col("half").bitwiseAND(bit) != 0).select("k", "j", F.col("half").alias("high"), F.col("n").alias("n_high"), masked.alias("v"))
    apart = meet(zero, one, ["k", "j", "v"]).select("k", "low", "high", (F.col("n_low") + F.col("n_high")).alias("n"))
    # a group: the half values whose fingerprints may be linked, and the bits left for the other half
    alike = counted.filter("n > 1").select("k", F.col("half").alias("low"), F.col("half").alias("high"), "n")
    groups = cut(alike.unionByName(apart))

    left, right = members.select("k", F.col("half").alias("low"), F.col("fp").alias("a")), members.select("k", F.col("half").alias("high"), F.col("fp").alias("b"))
    small = groups.filter(F.col("n") <= pairs_up_to)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    paired = meet(meet(small, left, ["k", "low"]), right, ["k", "high"]).filter(((F.col("low") != F.col("high")) | (F.col("a") < F.col("b"))) & near)

    large = groups.filter(F.col("n") > pairs_up_to)
    sides = large.select("k", "low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("half"))
    one_bit = [~(1 << i) & MASK for i in range(HALF)]
    two_bits = [~(1 << i | 1 << j) & MASK for i in range(HALF) for j in range(i)]
    wild = F.when(F.col("low") == F.col("high"), F.array(*map(F.lit, two_bits)).cast("array<bigint>")).otherwise(F.array(*map(F.lit, one_bit)).cast("array<bigint>"))
    masks = meet(sides, members, ["k", "half"]).withColumn("mask", F.explode(wild))
    keyed = masks.select("k", "low", "high", "mask", F.col("rest").bitwiseAND(F.col("mask")).alias("v"), "fp")
    least = keyed.groupBy("k", "low", "high", "mask", "v").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    starred = meet(keyed, least, ["k", "low", "high", "mask", "v"]).select("a", F.col("fp").alias("b")).filter("a <> b")
    return paired.select("a", "b").union(starred).distinct()


def group(docs: DataFrame, words: int = 3, pairs_up_to: int = 256, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns (doc_id among them), fp and component_id, a row for each of docs."""
    stamped = cut(with_fingerprint(docs, words, carry))
    fps = cut(stamped.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    labels = components(links(fps.select("fp"), pairs_up_to))
    classes = meet(fps, labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    ids = classes.groupBy("label").agg(F.min("first_id").alias("component_id"))
    return meet(stamped, meet(classes.select("fp", "label"), ids, "label").select("fp", "component_id"), "fp").select(*carry, "fp", "component_id")


def dedup(docs: DataFrame, words: int = 3, pairs_up_to: int = 256) -> DataFrame:
    """One row of each class: the one with the class's id (of several such, the least by text hash)."""
    key = unused(docs, "_key")
    keyed = docs.withColumn(key, key_of())
    classes = group(keyed.select("doc_id", "text", F.col(key).alias("_k")), words, pairs_up_to, ("doc_id", "_k"))
    first = classes.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("_of")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_k")).alias("kept")
    )
    kept = first.select(F.col("kept._k").alias(key))
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).select(*columns(docs))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
