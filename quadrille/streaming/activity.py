"""Activity in fixed cycles over cells, as a stream or a batch, and the latest value of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions import codec


def cycles(points: DataFrame, res: int = 4, cycle: str = "5 minutes", late: str = "10 minutes", ts: str = "ts", value: str = "value") -> DataFrame:
    """Events and their values' sum for each cycle and cell. On a stream, events later than the watermark are left out."""
    timed = points.withColumn("_ts", F.col(ts).cast("timestamp"))
    timed = timed.withWatermark("_ts", late) if points.isStreaming else timed
    grouped = timed.groupBy(F.window("_ts", cycle).alias("w"), codec.to_hex(F.col("hh"), res).alias("hex"))
    return grouped.agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), "hex", "events", "total")


def latest(rows: DataFrame, keys: list[str], ts: str = "ts", ties: str | None = None) -> DataFrame:
    """The last row of each key; of several at one time the one with the greatest `ties`."""
    order = [F.col(ts).desc(), *([F.col(ties).desc()] if ties else [])]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
