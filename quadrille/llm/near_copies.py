"""Near copies by word shingles: documents of a Jaccard similarity of `similar` or more are linked, and one of each class stays.

Sets: A-Z of the text in lower case, words of non-white-space, shingles of `words` words, each once, known by
XXH64 (seed 42). Documents with the same set are one node.

Candidates come from two sides. Operator 4 (simhash_dedup) links sets whose fingerprints, of the same shingles with their repeats, differ in
at most two bits, through its one-wildcard variants. At a similarity of 0.8 fingerprints of 64 bits differ in 9 to 10 bits on
average, though, and segments that are short enough for so many are shared by chance. So there are also bands of least hashes under
ROWS x BANDS functions: two sets of similarity j agree in a band of ROWS with j ** ROWS, at 0.8 in one band at least with 0.9994, and
unrelated ones hardly ever. Every link of either side is verified on the whole sets: one shingle that makes up most of two texts
gives them one fingerprint, but no link.

Large groups: in each bucket (band and value) all members are first held against one, the one that
shares its buckets with most others. Of buckets that still hold several classes after that, shingles are counted: what a set shares
with any other such member bounds its similarity to all of them, so a set with too many shingles of its own is done with.
The others are held against the member with the fewest of its own, again one comparison for each. Only
members that are in different classes then, and whose bounds allow a link, are paired with each other (see settled); no link is lost by this.

Defined cases: null or white-space text has an empty set, one class; fewer words than a shingle: the
whole sequence is the one shingle; repeated rows are copies; a null doc_id stays only where its class has no other; all columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import simhash_dedup
from quadrille.llm.common import columns, cut, key_of, look_up, map_arrow, meet, stored, unused
from quadrille.llm.components import contracted, joined

ROWS, BANDS = 8, 40
#: Pairs that read one copy of a set.
COPY = 256
_random = np.random.default_rng(8)
FLIP = _random.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32)
FACTOR = _random.integers(0, 1 << 31, ROWS * BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    return np.unique(simhash_dedup.shingle_hashes(text, words))


def band_values(hashes: np.ndarray) -> np.ndarray:
    """A value of each band of least hashes, as signed longs."""
    least = np.full(ROWS * BANDS, (1 << 32) - 1, np.uint32)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), 256):
        np.minimum(least, ((high[at : at + 256, None] ^ FLIP) * FACTOR).min(0), out=least)
    return np.array([xxhash.xxh3_64_intdigest(b.tobytes()) for b in least.reshape(BANDS, ROWS)], np.uint64).view(np.int64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    every = np.concatenate([a, b])
    every.sort()
    return int((every[1:] == every[:-1]).sum())


def compared(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b) with both, how many shingles they share, and near, whether they are similar. A set that many pairs name is dealt out in copies."""
    copies = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / COPY).alias("copies"))
    left = meet(sets.select(F.col("s").alias("a"), F.col("h").alias("h_a")), copies, "a").select("a", "h_a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    right = meet(meet(pairs, copies, "a").withColumn("copy", F.pmod(F.xxhash64("b"), "copies")), sets.select(F.col("s").alias("b"), F.col("h").alias("h_b")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, near = [], []
            for x, y in zip(batch.column("h_a"), batch.column("h_b"), strict=True):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                both.append(overlap(x, y))
                near.append(both[-1] >= similar * max(len(x) + len(y) - both[-1], 1))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(both, pa.int64()), pa.array(near, pa.bool_())], ["a", "b", "both", "near"])

    return cut(map_arrow(meet(right, left, ["a", "copy"]).select("a", "b", "h_a", "h_b"), compare, "a string, b string, both long, near boolean"))


def by_fingerprint(nodes: DataFrame) -> DataFrame:
    """(s, fp) -> pairs (a, b) of sets that operator 4 links: each with the least of its fingerprint, and those with each other."""
    firsts = cut(nodes.groupBy("fp").agg(F.min("s").alias("first"), F.count(F.lit(1)).alias("n")))
    same = look_up(nodes.select("s", "fp"), firsts, "fp").select(F.col("found.first").alias("a"), F.col("s").alias("b")).filter("a <> b")
    linked = simhash_dedup.links(firsts.select("fp"))
    first = firsts.select(F.col("fp").alias("b"), F.col("first").alias("of_b"))
    across = meet(meet(linked, firsts.select(F.col("fp").alias("a"), F.col("first").alias("of_a")), "a"), first, "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    return same.union(across)


def labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members with label, their class or themselves."""
    return meet(members, labels.withColumnRenamed("node", "s"), "s", "left").withColumn("label", F.coalesce("label", "s"))


def of_several(members: DataFrame) -> DataFrame:
    """Members of buckets that hold several classes."""
    buckets = members.groupBy("band", "v").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("band", "v")
    return meet(members, buckets, ["band", "v"])


def with_common(members: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """members with common: how many of a set's shingles any other of them has. Those with less than a share of `similar` have no link left to find and go."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(h.as_py(), "<i8") for h in batch.column("h")]
            of = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([batch.column("s").take(pa.array(of, pa.int64())), pa.array(np.concatenate([*found, np.zeros(0, "<i8")]))], ["s", "g"])

    each = stored(map_arrow(meet(sets, members.select("s").distinct(), "s").select("s", "h"), spread, "s string, g long"))
    shared = cut(each.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("yes", F.lit(True)))
    common = look_up(each, shared, "g").filter("found.yes").groupBy("s").agg(F.count(F.lit(1)).alias("common"))
    return meet(members, common, "s").filter(F.col("common") >= similar * F.col("n"))


def settled(members: DataFrame, labels: DataFrame, tried: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The classes (node, label) with the links that are still to be found in buckets which hold several of them.

    All members of a bucket are measured against the one with the fewest shingles of its own. With `both` shingles in that
    one, a set has at most common - both others that anything else has, so two sets x, y of the bucket share at most
    min(both x, both y) + min(common x - both x, common y - both y). Only where that can suffice they are compared.
    """
    rest = cut(of_several(with_common(cut(of_several(labelled(members, labels))), sets, similar)))
    hubs = rest.groupBy("band", "v").agg(F.max(F.struct(F.col("common") / F.col("n"), "s")).alias("hub")).select("band", "v", F.col("hub.s").alias("a"))
    placed = meet(rest.select("band", "v", "s", "n", "common"), hubs, ["band", "v"])
    measured = compared(cut(placed.filter("a <> s").select("a", F.col("s").alias("b")).distinct()), sets, similar)
    labels = joined(labels, measured.filter("near"))
    of_hub = meet(placed, measured.select("a", F.col("b").alias("s"), "both"), ["a", "s"], "left").select("band", "v", "s", "n", "common", F.coalesce("both", "n").alias("both"))
    x = cut(of_several(labelled(of_hub, labels)))
    y = x.select("band", "v", *[F.col(c).alias(f"{c}_y") for c in ("s", "n", "common", "both", "label")])
    most = F.least("both", "both_y") + F.least(F.col("common") - F.col("both"), F.col("common_y") - F.col("both_y"))
    able = most >= similar * (F.col("n") + F.col("n_y") - most)
    pairs = meet(x, y, ["band", "v"]).filter((F.col("s") < F.col("s_y")) & (F.col("label") != F.col("label_y")) & able).select(F.col("s").alias("a"), F.col("s_y").alias("b")).distinct()
    return joined(labels, compared(cut(meet(pairs, tried, ["a", "b"], "left_anti")), sets, similar).filter("near"))


def group(docs: DataFrame, words: int = 5, similar: float = 0.8) -> DataFrame:
    """(doc_id, k, text) -> (doc_id, k, label): label is the same for the rows of a class."""

    def stamp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [simhash_dedup.shingle_hashes(t.as_py(), words) for t in batch.column("text")]
            fps = np.array([simhash_dedup.majority(h) for h in every], "<u8").view("<i8")
            found = [np.unique(h) for h in every]
            digests, sizes = [xxhash.xxh3_128_hexdigest(h.tobytes()) for h in found], [len(h) for h in found]
            bands = [band_values(h) for h in found]
            columns = [batch.column("doc_id"), batch.column("k"), pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(fps, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "k", "s", "n", "bands", "fp"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), words).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("s"), pa.array(found, pa.binary())], ["s", "h"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    stamped = cut(map_arrow(docs.select("doc_id", "k", "text"), stamp, f"doc_id {id_type}, k string, s string, n long, bands array<long>, fp long"))
    nodes = cut(stamped.groupBy("s").agg(F.min(F.struct("k", "n", "bands", "fp")).alias("of")).select("s", "of.*"))
    printed = cut(by_fingerprint(nodes))
    placed = nodes.select("s", "n", F.posexplode("bands").alias("band", "v"))
    shared = placed.groupBy("band", "v").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    members = cut(meet(placed, shared, ["band", "v"]))

    central = members.groupBy("s").agg(F.sum("m").alias("reach"))
    hubs = meet(members, central, "s").groupBy("band", "v").agg(F.max(F.struct("reach", "s", "n")).alias("hub")).select("band", "v", F.col("hub.s").alias("a"), F.col("hub.n").alias("n_a"))
    close = F.least("n_a", "n") >= similar * F.greatest("n_a", "n")
    to_hub = meet(members, hubs, ["band", "v"]).filter((F.col("a") != F.col("s")) & close).select("a", F.col("s").alias("b"))
    starred = cut(to_hub.union(printed).distinct())
    some = members.select("s").union(starred.select("a")).union(starred.select("b")).distinct()
    named = meet(nodes.select("k", "s"), some, "s")
    sets = cut(map_arrow(meet(docs.select("k", "text"), named, "k").select("s", "text"), spell, "s string, h binary").dropDuplicates(["s"]))
    labels = cut(contracted(compared(starred, sets, similar).filter("near")))
    tried = starred.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return labelled(stamped, settled(members, labels, tried, sets, similar)).select("doc_id", "k", "label")


def dedup(docs: DataFrame, words: int = 5, similar: float = 0.8) -> DataFrame:
    """One row of each class: the one with the least id (of several such, the least by text hash)."""
    key = unused(docs, "_key")
    keyed = docs.withColumn(key, key_of())
    classes = group(keyed.select("doc_id", F.col(key).alias("k"), F.col("text").cast("string").alias("text")), words, similar)
    kept = classes.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k")).alias("kept")).select(F.col("kept.k").alias(key))
    return meet(keyed, kept, key, "left_semi").dropDuplicates([key]).select(*columns(docs))
