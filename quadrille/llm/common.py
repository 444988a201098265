"""What the training-data operators share: table access, durable cuts of lineage, column hygiene."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quadrille.shipping import ship

#: Words, as every operator here defines them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A key is heavy if it holds more than one of this many parts of all rows.
HEAVY = 4096
#: Spark's setting that removes a query's shuffle files when it ends, and not when the driver happens to collect its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this machine only where none is set and nothing else runs tasks."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def fresh_dir(spark: SparkSession, purpose: str) -> str:
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and end inside leave no shuffle files: for those whose rows are stored, or of which the driver has the few rows."""
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(TIDY)
        else:
            spark.conf.set(TIDY, before)


def cut(df: DataFrame) -> DataFrame:
    """Run df once and keep its rows in the shared folder, from where any executor can read them again."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    with tidy(spark):
        return df.select("*").checkpoint(eager=True)  # a query made here, so that the setting holds for it


def stored(df: DataFrame) -> DataFrame:
    """df run once and written as Parquet in the shared folder: compressed, and read by columns."""
    path = fresh_dir(df.sparkSession, "rows")
    with tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """A column name near `name` that df doesn't have yet (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def key_of() -> Column:
    """MD5 of id and text as 32 hex digits: names a row, never null; repeated rows share it."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_or_empty()))


def columns(df: DataFrame) -> list[Column]:
    """The columns of df, whatever their names."""
    return [F.col(f"`{c}`") for c in df.columns]


def as_row(df: DataFrame) -> Column:
    """All columns as one struct, so that no name of theirs meets one of an operator's."""
    return F.struct(*columns(df))


def look_up(rows: DataFrame, unique: DataFrame, key: str | list[str]) -> DataFrame:
    """rows with `found`, a struct of the other columns of unique (key, n, ...), null where there is none.

    unique has one row for each key, and n is the number of rows that have it. Heavy keys are fewer
    than HEAVY whatever the input, so those are broadcast; their rows are spread over the join that finds
    the others, and no task gets all rows of a key.
    """
    keys = [key] if isinstance(key, str) else key
    values = unique.select(*keys, "n", F.struct(*[c for c in unique.columns if c not in keys]).alias("found"))
    with tidy(rows.sparkSession):
        total = unique.agg(F.sum("n")).first()[0] or 0
    heavy = values.filter(F.col("n") * HEAVY > total).select(*keys, F.col("found").alias("_heavy"))
    marked = rows.join(F.broadcast(heavy), keys, "left")
    # whatever a spread row meets, what was broadcast goes first
    spread = F.xxhash64(F.monotonically_increasing_id()).cast(rows.schema[keys[0]].dataType)
    keyed = marked.withColumn("_at", F.when(F.col("_heavy").isNull(), F.col(keys[0])).otherwise(spread))
    others = values.select(F.col(keys[0]).alias("_at"), *keys[1:], "found")
    return meet(keyed, others, ["_at", *keys[1:]], "left").select(*rows.columns, F.coalesce("_heavy", "found").alias("found"))


def meet(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join whose sides both grow with the data: sorted and merged, neither is ever sent to the driver and broadcast."""
    return left.join(right.hint("merge"), on, how)


def map_arrow(df: DataFrame, function: Callable, schema: StructType | str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)
