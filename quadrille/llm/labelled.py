"""The bounded sample of labelled documents that the quality models are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out() -> F.Column:
    """Labels of a third of the documents, by a checksum of the id, are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """At most `rows` labelled documents outside the held-out third: doc_id, text and label.

    The sample is the same at every run: ids of documents in the order of their hashes, and of several documents with
    an id the one with the least hash of its text. Rows without an id or a quality are no labels; of several
    labels for an id the least holds. Both what is broadcast and what comes out are `rows` rows at most.
    """
    usable = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
        .groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").cast("int").alias("label"))
    )
    present = usable.join(docs.select(F.col("doc_id").alias("_id")).distinct(), "_id", "left_semi")
    chosen = present.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    text = F.col("text").cast("string")
    found = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    one = found.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("of"))
    return one.select("doc_id", F.col("of.text").alias("text"), "label")
