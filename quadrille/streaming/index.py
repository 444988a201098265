"""An index of cells kept by a stream, which goes on where it broke off.

Each batch is summed by cell and written under its own number, in place of whatever an earlier attempt at that batch left there. A batch that
the checkpoint doesn't know as done is run again with the same rows and the same number, so the index holds every event once, however
often the stream is ended and started. Rows of many batches are folded into one by compact(), which the same numbers make safe to repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import codec


class BrokenOff(RuntimeError):
    """Raised on purpose, after a batch is written and before it counts as done."""


def _sums(points: DataFrame, keys: list[str], res: int) -> DataFrame:
    return points.groupBy(codec.to_hex(F.col("hh"), res).alias("hex"), *keys).agg(
        F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"), F.min("event_id").alias("first"), F.max("event_id").alias("last")
    )


def _folded(rows: DataFrame, keys: list[str]) -> DataFrame:
    add: dict[str, Column] = {"events": F.sum("events"), "total": F.sum("total"), "first": F.min("first"), "last": F.max("last")}
    # types as they were: sums of decimals would widen at each fold
    return rows.groupBy("hex", *keys).agg(*[c.cast(rows.schema[n].dataType).alias(n) for n, c in add.items()])


def keep(points: DataFrame, path: str, checkpoint: str, keys: list[str], res: int = 8, break_in: int | None = None) -> None:
    """Take in what a stream of points (hh, event_id, value and keys) has, until it is at its end. break_in names a batch to break off in, for trials."""

    def put(batch: DataFrame, number: int) -> None:
        _sums(batch, keys, res).write.mode("overwrite").parquet(f"{path}/upto={number:012d}/batch={number:012d}")
        if number == break_in:
            raise BrokenOff(f"batch {number}")

    points.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _current(rows: DataFrame) -> DataFrame:
    """Without batches that a folded one holds: of a batch only what stands under the highest upto, and nothing numbered below a fold but the fold."""
    fold = rows.filter("batch = -1").agg(F.max("upto")).first()[0]
    return rows if fold is None else rows.filter((F.col("upto") > fold) | ((F.col("upto") == fold) & (F.col("batch") == -1)))


def _rows(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("basePath", path).parquet(path)
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("upto", "batch")})


def read(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """(hex, keys, events, total, first, last) of all batches."""
    return _folded(_current(_rows(spark, path)), keys)


def compact(spark: SparkSession, path: str, keys: list[str]) -> None:
    """All batches so far as one, which readers take in their place; not while the stream runs."""
    rows = _current(_rows(spark, path))
    last = rows.agg(F.max("upto")).first()[0]
    if last is not None and rows.filter("batch >= 0").limit(1).count():
        _folded(rows, keys).write.mode("overwrite").parquet(f"{path}/upto={last:012d}/batch=-1")

