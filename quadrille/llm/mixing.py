"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Each source gets a target number of words. Every document of a source is expected
target / source_size times; the expected copies are summed up along a fixed order of the
source's documents, one offset in [0, 1) is added, and a document is emitted once for each
integer that the running sum crosses at it. The order goes by size class, up and down in turns inside of them, so that documents of each
size are sampled at the source's rate and the words taken come near the target: they miss it by
half of the source's longest document at most, about.

The running sum is built in steps so that no task ever holds a source: documents are dealt
to blocks inside their source and size class (as many blocks as there are `block_rows` documents, by a hash),
classes and blocks are summed up, and the sums before
each block are added to the running sum inside it. Expected copies are whole numbers of
1/2**FRACTION_BITS, so sums are exact, in any order, and reruns agree. The table of sources is
levelled in one task, a row for each source.

Defined cases: null text has size 0; the null source is a source of its own and comes last; a
source without words has target 0 and none of its documents is taken; repeated rows are sampled as
rows of their own; an empty table gives an empty result; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import WORD, cut, unused

FRACTION_BITS = 24
UNIT = 1 << FRACTION_BITS


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, share: float = 1.0) -> DataFrame:
    """(source, source_size) -> (source, source_size, target): water-filling under a cap of `most` times the size.

    Sources in code-point order, null last, take the weights in turn. A capped source is one whose
    cap lies below its share; sorted by cap per weight, the capped ones are a prefix, and the first
    prefix whose remaining level is not above the next source's cap gives the level of the others.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    weighed = sizes.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    # two sources may have the same cap per weight: the second key only fixes an order
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levelled = weighed.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    water = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), F.col("level"))).alias("w")).over(everything)["level"]
    level_of_all = levelled.withColumn("water", water)
    return level_of_all.select(
        "source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))).alias("target")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, share: float = 1.0, seed: int = 17, block_rows: int = 500_000, carry: tuple[str, ...] | None = None) -> DataFrame:
    """docs (the columns of carry, or all) with size, source_size, target and copies, in that order at the end; rows that are not taken have 0 copies.

    Where docs has such a name already, the new column gets an underscore in front.
    """
    kept = docs.select(*[f"`{c}`" for c in carry]) if carry is not None else docs
    group = ["none", "source", "class"]
    # words are counted here and nowhere else
    rows = cut(
        docs.select(
            F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("row"), F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("source"),
            word_count(F.col("text")).alias("size"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"),
        )
    )
    classed = rows.withColumn("class", F.floor(F.log2(F.col("size") + 1) * 4).cast("int"))
    by_class = cut(classed.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("words")))
    blocks = -(-(by_class.agg(F.sum("rows")).first()[0] or 1) // block_rows)
    dealt = classed.withColumn("deal", F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.col("h")), F.lit(blocks)).cast("int"))

    sizes = by_class.groupBy("none", "source").agg(F.sum("words").alias("source_size"))
    named = sizes.select(F.when(~F.col("none"), F.col("source")).alias("source"), "source_size")
    targets = source_targets(named, weights, most, share).select(
        F.col("source").isNull().alias("none"),
        F.coalesce("source", F.lit("")).alias("source"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.least(F.lit(most * UNIT), F.round(F.col("target") / F.col("source_size") * UNIT)))
        .otherwise(0)
        .cast("long")
        .alias("expected"),
        F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), F.col("source")), F.lit(UNIT)).cast("long").alias("offset"),
    )
    upto_here = (Window.unboundedPreceding, -1)
    classes = by_class.withColumn("first", F.coalesce(F.sum("rows").over(Window.partitionBy("none", "source").orderBy("class").rowsBetween(*upto_here)), F.lit(0)))
    in_class = Window.partitionBy(*group).orderBy("deal").rowsBetween(*upto_here)
    counts = dealt.groupBy(*group, "deal").agg(F.count(F.lit(1)).alias("n")).select(*group, "deal", F.coalesce(F.sum("n").over(in_class), F.lit(0)).alias("before"))
    starts = (
        counts.join(classes.select(*group, "first"), group).join(targets, ["none", "source"])
        .select(*group, "deal", "source_size", "target", "expected", "offset", ((F.col("first") + F.col("before")) * F.col("expected")).alias("sum_before"))
    )
    inside = Window.partitionBy(*group, "deal").orderBy(F.when(F.col("class") % 2 == 0, F.col("size")).otherwise(-F.col("size")), "id", "h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    drawn = dealt.withColumn("rank", F.row_number().over(inside)).join(starts, [*group, "deal"])
    upto = F.col("sum_before") + F.col("rank") * F.col("expected") + F.col("offset")
    crossed = F.shiftright(upto, FRACTION_BITS) - F.shiftright(upto - F.col("expected"), FRACTION_BITS)
    copies = F.when(F.col("size") > 0, crossed).otherwise(0).cast("long")
    made = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "copies": copies}
    return drawn.select(*[F.col(f"row.`{c}`") for c in kept.columns], *[column.alias(unused(kept, name)) for name, column in made.items()])


def take(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of a mix themselves, each as often as it was drawn."""
    copies = F.col(f"`{mixed.columns[-1]}`")
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    often = mixed.filter(copies > 0).select(row, F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias("copy"))
    return often.select(*[F.col(f"row.`{c}`") for c in columns])
