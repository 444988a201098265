"""Connected components over a table of links, by contraction.

Each round every node goes to the least of itself and its neighbours, in an order by hash, and the links are
rewritten to where their ends went: stars are gone after two rounds, and chains shrink by a share of their length each
round, whatever the ids. What is left of the links is all that a round reads, so the rounds together cost
about as much as the first. Rounds are cut in the shared folder; only whether links are left reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import cut, meet


def _ranked(node: str) -> Column:
    return F.struct(F.xxhash64(node).alias("rank"), F.col(node).alias("node"))


def contracted(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, label): label is some node of the component, the same for all; nodes without links don't appear."""
    edges = cut(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct())
    placed = None
    while placed is None or not edges.isEmpty():
        least = edges.groupBy("a").agg(F.min(_ranked("b")).alias("near"))
        goes = cut(least.select("a", F.least(_ranked("a"), "near")["node"].alias("to")))
        moved = meet(meet(edges, goes, "a").select("b", F.col("to").alias("x")), goes.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        edges = cut(moved.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        if placed is None:
            placed = goes.select(F.col("a").alias("node"), F.col("to").alias("label"))
        else:
            placed = meet(placed, goes.withColumnRenamed("a", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return placed


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, label): label is the least node of the component; nodes without links don't appear."""
    labels = cut(contracted(links))
    return meet(labels, labels.groupBy("label").agg(F.min("node").alias("least")), "label").select("node", F.col("least").alias("label"))


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The classes (node, label) after more links (a, b): only links between classes enter the rounds."""
    of_a, of_b = labels.toDF("a", "of_a"), labels.toDF("b", "of_b")
    ends = meet(meet(links.select("a", "b"), of_a, "a", "left"), of_b, "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    between = cut(ends.filter("a <> b").distinct())
    if between.isEmpty():
        return labels
    further = contracted(between).toDF("at", "to")
    both = labels.join(further.hint("merge"), F.col("label") == F.col("at"), "full")
    return cut(both.select(F.coalesce("node", "at").alias("node"), F.coalesce("to", "label").alias("label")))
