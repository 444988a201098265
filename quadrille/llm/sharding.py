"""Sharding by extendible hashing.

A document's key is a 128-bit hash. A bucket is a prefix of it; the directory starts with the
empty prefix, and only a bucket whose bytes exceed the limit is split, on the next bit, until every
bucket fits. A document's shard is therefore its shortest prefix whose bucket fits the limit.

The sizes come from one aggregate per `step` bits: documents are summed up by the first `step`
bits, those sums are folded upwards to every shorter prefix, and only prefixes that still don't fit
at the full `step` bits are looked at again with `step` bits more. What is summed up is bounded by
2**step rows a round, whatever the input; documents themselves are never gathered.

Rows that agree in all hashed bits (repeated rows) can't be told apart by any bit: such a bucket is
cut into runs of at most `limit` bytes, counted by tasks that each hold a part of them, and the run's number
becomes part of the shard's name. A document above the limit has a shard of its own. Nulls count as empty text; an
empty table gives an empty result; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import as_row, cut, key_of, look_up, text_or_empty, unused

BITS = 128
#: Directory bits looked at in a round.
STEP = 16


def bits_of(key: Column) -> Column:
    return F.concat(*[F.lpad(F.conv(F.substring(key, i, 8), 16, 2), 32, "0") for i in (1, 9, 17, 25)])


def directory(keys: DataFrame, limit: int, step: int = STEP) -> DataFrame:
    """(bits, bytes) -> (prefix, depth, fits): the leaves; `fits` is false where all bits agree and the bytes are still above the limit."""
    open_keys, leaves, at = keys, None, 0
    while True:
        to = min(at + step, BITS)
        sums = open_keys.groupBy(F.substring(F.col("bits"), 1, to).alias("longest")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"))
        levels = sums.select("bytes", "docs", "longest", F.explode(F.sequence(F.lit(at), F.lit(to))).alias("depth"))
        judged = (
            levels.groupBy("depth", F.expr("substring(longest, 1, depth)").alias("prefix"))
            .agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"))
            .select("depth", "prefix", ((F.col("bytes") <= limit) | (F.col("docs") == 1)).alias("fits"))
        )
        # a bucket exists where its parent had to be split
        split = judged.filter(~F.col("fits")).select(F.col("prefix").alias("parent"), (F.col("depth") + 1).alias("depth"))
        born = (
            judged.withColumn("parent", F.expr("substring(prefix, 1, depth - 1)"))
            .join(split.withColumn("born", F.lit(True)), ["depth", "parent"], "left")
            .filter((F.col("depth") == at) | F.col("born"))
            .select("prefix", "depth", "fits")
        )
        born = cut(born)
        done = born.filter(F.col("fits") | (F.col("depth") == BITS))
        leaves = done if leaves is None else leaves.unionByName(done)
        stuck = born.filter(~F.col("fits") & (F.col("depth") == to))
        if to == BITS or stuck.isEmpty():
            return leaves
        open_keys = keys.withColumn("prefix", F.substring(F.col("bits"), 1, to)).join(stuck, "prefix", "left_semi")
        at = to


def shard(docs: DataFrame, limit: int = 64 << 20, step: int = STEP) -> DataFrame:
    """docs with shard (the prefix, plus the run where all bits agree), shard_depth and n_bytes, in that order at the end.

    Where docs has such a name already, the new column gets an underscore in front.
    """
    rows = docs.select(as_row(docs).alias("row"), key_of().alias("key"), F.octet_length(text_or_empty()).cast("long").alias("bytes"))
    keys = cut(rows.select("key", "bytes"))
    leaves = directory(keys.withColumn("bits", bits_of(F.col("key"))), limit, step)
    depths = sorted(r[0] for r in leaves.select("depth").distinct().collect())  # at most BITS + 1 numbers
    prefixes = F.array(*[F.struct(F.lit(d).alias("depth"), F.substring(F.col("bits"), 1, d).alias("prefix")) for d in depths or [0]])
    counted = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("bits", bits_of(F.col("key")))
    of_key = cut(counted.select("key", "n", F.inline(prefixes)).join(leaves, ["depth", "prefix"]).select("key", "n", "prefix", "depth", "fits"))
    found = look_up(rows, of_key, "key").select("row", "key", "bytes", "found.*")
    whole = found.filter("fits").select("row", F.col("prefix").alias("shard"), "depth", "bytes")

    # rows that agree in all bits: numbered by the tasks that hold them, each after those before it
    alike = cut(found.filter(~F.col("fits")).withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = alike.groupBy("key", "part").agg(F.count(F.lit(1)).alias("held")).select("key", "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("first"))
    number = F.col("first") + F.row_number().over(Window.partitionBy("key", "part").orderBy("bytes")) - 1
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("bytes"), F.lit(1))))
    runs = alike.join(starts, ["key", "part"]).withColumn("run", F.floor(number / each).cast("string"))
    cut_up = runs.select("row", F.concat_ws("+", "prefix", "run").alias("shard"), "depth", "bytes")
    made = {"shard": "shard", "shard_depth": "depth", "n_bytes": "bytes"}
    return whole.unionByName(cut_up).select(*[F.col(f"row.`{c}`") for c in docs.columns], *[F.col(c).alias(unused(docs, name)) for name, c in made.items()])
