"""Density and centroid roll-ups over the cell hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions import codec
from quadrille.operators.coverage import hex_of, keep_bits
from quadrille.operators.graph import saved


def rollup(points: DataFrame, min_res: int = 2, max_res: int = 16, threshold: int = 0, code: str = "hh", weight: str | None = None) -> DataFrame:
    """For each resolution and cell: weight (points, or a column's sum), centroid (hex), and the points themselves where they are `threshold` at most.

    Points are summed once, at the finest level; coarser levels are sums of its rows. Members are gathered only in finest cells
    that have few and go up only to cells that have few in all, so no crowded cell is ever collected.
    """
    levels = [r for r in codec.RESOLUTIONS if min_res <= r <= max_res]
    finest = max(levels)
    y, x = codec.y_of(F.col("hh")), codec.x_of(F.col("hh"))
    measured = points.select(F.col(code).alias("hh"), (F.col(weight) if weight else F.lit(1)).alias("_w"))
    # units have 32 bits: whole-number sums of them are exact, whatever the order
    fine = saved(
        measured.groupBy(codec.at_resolution(F.col("hh"), finest).alias("_fine")).agg(
            F.count(F.lit(1)).alias("points"), F.sum("_w").alias("weight"), F.sum(y.cast("decimal(38,0)")).alias("_sy"), F.sum(x.cast("decimal(38,0)")).alias("_sx")
        )
    )
    up = lambda rows: rows.withColumn("res", F.explode(F.array(*map(F.lit, levels)))).withColumn("cell", F.col("_fine").bitwiseAND(keep_bits(F.col("res"))))
    sums = up(fine).groupBy("res", "cell").agg(*[F.sum(c).alias(c) for c in ("points", "weight", "_sy", "_sx")])
    mean = lambda c: F.floor(F.col(c) / F.col("points")).cast("long")
    out = sums.select(
        "res", hex_of(F.col("res"), F.col("cell")).alias("hex"), "points", "weight", codec.to_hex(codec.encode_units(mean("_sy"), mean("_sx"))).alias("centroid"), "cell"
    )
    if threshold > 0:
        out = saved(out)
        few = out.filter(F.col("points") <= threshold).select("res", "cell")
        small = fine.filter(F.col("points") <= threshold).select("_fine")
        held = measured.withColumn("_fine", codec.at_resolution(F.col("hh"), finest)).join(small, "_fine").groupBy("_fine").agg(F.collect_list(codec.to_hex(F.col("hh"))).alias("_some"))
        members = up(held).join(few, ["res", "cell"]).groupBy("res", "cell").agg(F.array_sort(F.flatten(F.collect_list("_some"))).alias("markers"))
        out = out.join(members, ["res", "cell"], "left")
    else:
        out = out.withColumn("markers", F.lit(None).cast("array<string>"))
    return out.drop("cell")


def density(points: DataFrame, res: int, code: str = "hh") -> DataFrame:
    return points.groupBy(codec.to_hex(F.col(code), res).alias("hex")).agg(F.count(F.lit(1)).alias("points"))


def density_by_levels(points: DataFrame, res: int, code: str = "hh") -> DataFrame:
    """Counts for each prefix up to a resolution: one pass to the finest level, then its counts are rolled up."""
    finest = density(points, res, code).withColumnRenamed("hex", "_h")
    digits = F.explode(F.sequence(F.lit(1), F.lit(res // 2)))
    return finest.withColumn("_n", digits).groupBy(F.substring(F.col("_h"), F.lit(1), F.col("_n")).alias("hex")).agg(F.sum("points").alias("points"))


def document_frequency(points: DataFrame, document: str, finest: int = 12, code: str = "hh") -> DataFrame:
    """(hex, documents): for each cell up to `finest`, how many documents have a point in it. Each pair of cell and document is made one before it is counted."""
    digits = codec.to_hex(F.col(code))
    terms = points.select(F.col(document).alias("_d"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(finest // 2)), lambda n: F.substring(digits, F.lit(1), n))).alias("hex"))
    return terms.groupBy("hex").agg(F.count_distinct("_d").alias("documents"))
