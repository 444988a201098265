"""Points in shards of bounded size, by cells of as many resolutions as their density asks for.

Counts at the finest level are folded to all coarser ones; a cell is a shard if it has no more than `most_rows` points and the cell above it
has more. Shards part the points. A table of shards, stored beside them, tells a query's cells which to read, and the
join on it prunes folders before anything else of them is opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quadrille.functions import codec
from quadrille.operators import coverage as cov
from quadrille.operators import match
from quadrille.operators.graph import saved

#: Shards whose table is sent to all tasks at most.
BROADCAST_SHARDS = 1 << 18


def plan(points: DataFrame, most_rows: int = 1_000_000, finest: int = 16, code: str = "hh") -> DataFrame:
    """(res, cell, points): the shards. Cells of the finest resolution are taken however many points they have."""
    levels = [r for r in codec.RESOLUTIONS if r <= finest]
    fine = saved(points.groupBy(codec.at_resolution(F.col(code), finest).alias("fine")).agg(F.count(F.lit(1)).alias("points")))
    spread = fine.withColumn("res", F.explode(F.array(*map(F.lit, levels)))).withColumn("cell", F.col("fine").bitwiseAND(cov.keep_bits(F.col("res"))))
    counts = saved(spread.groupBy("res", "cell").agg(F.sum("points").alias("points")))
    crowded = counts.filter(F.col("points") > most_rows).select((F.col("res") + 2).alias("res"), F.col("cell").alias("above"))
    above = F.when(F.col("res") > 2, F.col("cell").bitwiseAND(cov.keep_bits(F.col("res") - 2)))
    small = counts.filter((F.col("points") <= most_rows) | (F.col("res") == finest)).withColumn("above", above)
    return small.filter("res = 2").unionByName(small.filter("res > 2").join(crowded, ["res", "above"], "left_semi").select(*small.columns)).drop("above")


def write(points: DataFrame, path: str, most_rows: int = 1_000_000, finest: int = 16, code: str = "hh") -> None:
    """Points under path/points, a folder for each shard with files of most_rows rows at most, and the table of shards under path/shards.

    A shard of more than most_rows points (a crowded cell of the finest level) is written by several tasks.
    """
    found = saved(plan(points, most_rows, finest, code).withColumn("shard", cov.hex_of(F.col("res"), F.col("cell"))))
    found.select("shard", "res", "cell", "points").write.mode("overwrite").parquet(f"{path}/shards")
    parts = F.greatest(F.lit(1), F.ceil(F.col("points") / most_rows)).cast("int")
    table = found.select("res", "cell", "shard", parts.alias("_parts"))
    tried = match.probes(points, match.levels_of(found), code)
    placed = tried.join(F.broadcast(table) if found.count() <= BROADCAST_SHARDS else table, ["res", "cell"])
    dealt = placed.withColumn("_part", F.pmod(F.xxhash64(code, *[F.col(f"`{c}`") for c in points.columns]), F.col("_parts")))
    dealt.repartition("shard", "_part").select(*points.columns, "shard").write.mode("overwrite").option("maxRecordsPerFile", most_rows).partitionBy("shard").parquet(f"{path}/points")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", f"{path}/points").schema(_schema(spark, path)).parquet(f"{path}/points")


def _schema(spark: SparkSession, path: str) -> StructType:
    """Shards are text, though some look like numbers."""
    found = spark.read.option("basePath", f"{path}/points").parquet(f"{path}/points").schema
    fields = [f if f.name != "shard" else StructField("shard", StringType()) for f in found.fields]
    return StructType(fields)


def routed(spark: SparkSession, path: str, cells: DataFrame) -> DataFrame:
    """Shards that a coverage's cells meet: those above, at, or below a cell."""
    table = spark.read.parquet(f"{path}/shards")
    wanted = saved(cells.select("res", "cell").distinct())
    up = lambda rows, levels: rows.withColumn("_r", F.explode(F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda r: r <= F.col("res")))).withColumn("_c", F.col("cell").bitwiseAND(cov.keep_bits(F.col("_r"))))
    below = up(table, match.levels_of(wanted)).join(wanted.select(F.col("res").alias("_r"), F.col("cell").alias("_c")), ["_r", "_c"], "left_semi").select("shard")
    above = table.select("shard", F.col("res").alias("_r"), F.col("cell").alias("_c")).join(up(wanted, match.levels_of(table)), ["_r", "_c"], "left_semi").select("shard")
    return saved(below.unionByName(above).distinct())


def in_cells(spark: SparkSession, path: str, cells: DataFrame, code: str = "hh") -> DataFrame:
    """Points in a coverage, from the shards that can have some."""
    # the condition always holds: folders are pruned by a join only where its other side has one
    wanted = routed(spark, path, cells).filter(F.length("shard") > 0)
    some = read(spark, path).join(F.broadcast(wanted) if wanted.count() <= BROADCAST_SHARDS else wanted, "shard")
    return match.semi_join(some, cells, code).drop("shard")
