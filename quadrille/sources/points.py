"""Points from tables and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import codec


def with_codes(rows: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    code = codec.encode(F.col(lat), F.col(lon))
    return rows.withColumn("hh", code).withColumn("hex", codec.to_hex(F.col("hh")))


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated gazetteer: latitude in the fourth field, longitude in the fifth; its header begins with RC."""
    rows = spark.read.text(path).filter(~F.col("value").startswith("RC"))
    fields = F.split("value", "\t")
    return with_codes(rows.select(F.get(fields, 3).try_cast("double").alias("lat"), F.get(fields, 4).try_cast("double").alias("lon")).dropna())


def read_hex_lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.trim("value").alias("hex")).filter(F.col("hex").rlike("^[0-9a-f]{16}$"))
    return lines.withColumn("hh", codec.from_hex(F.col("hex")))


def of_events(events: DataFrame) -> DataFrame:
    """events with coordinates made from their ids (the test tables have none)."""
    lat = (F.col("event_id") * 7919 % 170001) / F.lit(1e3) - 85.0
    lon = ((F.col("user_id") * 104729 + F.col("event_id") * 31) % 360000) / F.lit(1e3) - 180.0
    return with_codes(events.withColumn("lat", lat).withColumn("lon", lon))


def write_partitioned(points: DataFrame, path: str, res: int = 4) -> None:
    """Points in folders by their cell: a query for some cells reads those folders only. A folder is written by a few tasks, not by all; see shards for folders of bounded size."""
    dealt = points.withColumn("shard", codec.to_hex(F.col("hh"), res)).repartition("shard", F.pmod(F.xxhash64("hh"), F.lit(8)))
    dealt.write.partitionBy("shard").mode("overwrite").parquet(path)


def read_partitioned(spark: SparkSession, path: str, cells: list[str] | None = None) -> DataFrame:
    rows = spark.read.option("basePath", path).parquet(path)
    return rows.filter(F.col("shard").cast("string").isin(cells)) if cells is not None else rows
