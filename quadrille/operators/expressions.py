"""Area expressions and coverages kept as text, one cell's digits on a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators import cover
from quadrille.operators import coverage as cov
from quadrille.operators.graph import saved
from quadrille.plans import areas


def evaluate(spark: SparkSession, text: str, res: int, shape_id: str = "area") -> DataFrame:
    """The coverage of an expression, terms taken from left to right, simplified at the end."""
    terms = areas.parse_expression(text)
    if not terms:
        return cov.empty(spark)
    out = None
    for sign, area in terms:
        cells = saved(cover.polygons(cover._rings(spark, [(shape_id, res, area)])))
        out = cells if out is None else {"+": cov.merge, "-": cov.minus, "&": cov.intersect}[sign](out, cells)
    return cov.optimize(out)


def read_lines(spark: SparkSession, path: str, shape_id: str = "area") -> DataFrame:
    """A text coverage: distinct lines of hex digits, others left out."""
    lines = spark.read.text(path).select(F.trim("value").alias("hex")).filter(F.col("hex").rlike("^[0-9a-f]{1,16}$"))
    return cov.from_hex(lines.withColumn("shape_id", F.lit(shape_id)))


def write_lines(coverage: DataFrame, path: str, suffix: str = "") -> None:
    """A line for each cell, each once."""
    coverage.select(F.concat(cov.hex_of(F.col("res"), F.col("cell")), F.lit(suffix)).alias("value")).distinct().write.mode("overwrite").text(path)


def minus_exact(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of a that b doesn't have as the very same line: ancestors and descendants don't count."""
    return a.select(*cov.COLUMNS).subtract(b.select(*cov.COLUMNS))


def intersect_exact(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*cov.COLUMNS).intersect(b.select(*cov.COLUMNS))
