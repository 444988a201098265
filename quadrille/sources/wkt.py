"""Polygons from well-known text, as rings of grid coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import codec


def _vertices(text: Column) -> Column:
    pairs = F.transform(F.split(text, ","), lambda p: F.split(F.trim(p), r"\s+"))
    return F.transform(
        pairs, lambda p: F.struct(codec.vertex_lat(F.get(p, 1).try_cast("double")).alias("y"), codec.vertex_lon(F.get(p, 0).try_cast("double")).alias("x"))
    )


def _opened(ring: str) -> Column:
    """A ring without its last vertex, where that is its first."""
    return F.when(F.get(ring, F.size(ring) - 1) == F.get(ring, F.lit(0)), F.slice(ring, 1, F.size(ring) - 1)).otherwise(F.col(ring))


def rings(rows: DataFrame, column: str = "wkt") -> DataFrame:
    """(shape_id, res, wkt of a POLYGON without holes) -> (shape_id, res, ring)."""
    inner = F.regexp_extract(F.upper(column), r"^\s*POLYGON\s*\(\(([^()]*)\)\)\s*$", 1)
    return rows.filter(inner != "").withColumn("_r", _vertices(inner)).select("shape_id", "res", _opened("_r").alias("ring"))


def geometry_rings(rows: DataFrame, column: str = "wkt") -> DataFrame:
    """(shape_id, wkt of a POLYGON or MULTIPOLYGON) -> a row (shape_id, ring) for each ring, holes too: descend.cover_geometry takes a shape's rings by the even-odd rule. Other text has none."""
    known = rows.filter(F.upper(column).rlike(r"^\s*(MULTI)?POLYGON\s*\("))
    every = F.regexp_extract_all(F.upper(column), F.lit(r"\(([^()]+)\)"), F.lit(1))
    return known.select("shape_id", F.explode(every).alias("_t")).withColumn("_r", _vertices(F.col("_t"))).select("shape_id", _opened("_r").alias("ring"))
