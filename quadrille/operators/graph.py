"""Connected components of a link table by contraction."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def saved(df: DataFrame) -> DataFrame:
    """df run once, kept in the folder that the cluster names for checkpoints; one of this machine only where none is named and nothing else runs tasks."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local") and not df.sparkSession.conf.get("spark.checkpoint.dir", None):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager=True)


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, label): the least node that can be reached; nodes without links don't appear.

    Each round every node goes to the least of itself and its neighbours by hash, and links are rewritten to where their ends went.
    Stars are gone after two rounds, chains shrink by a share of their length, and a round reads only what is left of the links.
    """
    by_hash = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("node"))
    edges = saved(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct())
    placed = None
    while placed is None or not edges.isEmpty():
        goes = saved(edges.groupBy("a").agg(F.min(by_hash("b")).alias("m")).select("a", F.least(by_hash("a"), "m")["node"].alias("to")))
        if placed is None:
            placed = goes.toDF("node", "label")
        else:
            placed = saved(placed.join(goes.toDF("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        one = edges.join(goes, "a").select("b", F.col("to").alias("x"))
        both = one.join(goes.toDF("b", "y"), "b").filter("x <> y")
        edges = saved(both.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    least = placed.groupBy("label").agg(F.min("node").alias("least"))
    return placed.join(least, "label").select("node", F.col("least").alias("label"))
