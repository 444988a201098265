"""Bounding boxes and the choice of a resolution for an area."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import codec, measure

LAST = codec.UNITS - 1


def bbox_of_codes(points: DataFrame, keys: list[str] | None = None, code: str = "hh") -> DataFrame:
    """Least and greatest units of the codes of each group; null for no code."""
    y, x = codec.y_of(F.col(code)), codec.x_of(F.col(code))
    return points.groupBy(*(keys or [])).agg(F.min(y).alias("swy"), F.min(x).alias("swx"), F.max(y).alias("ney"), F.max(x).alias("nex"))


def bbox_of_vertices(vertices: Column) -> Column:
    """array<struct<y, x>> -> struct."""
    ys, xs = F.transform(vertices, lambda v: v["y"]), F.transform(vertices, lambda v: v["x"])
    return F.struct(F.array_min(ys).alias("swy"), F.array_min(xs).alias("swx"), F.array_max(ys).alias("ney"), F.array_max(xs).alias("nex"))


def bbox_of_coverage(coverage: DataFrame) -> DataFrame:
    """(shape_id, res, cell) -> shape_id and corners in degrees, the last unit of a cell inclusive; no row for an empty shape."""
    last = F.expr("shiftleft(1L, 32 - res) - 1")
    y, x = codec.y_of(F.col("cell")), codec.x_of(F.col("cell"))
    box = coverage.groupBy("shape_id").agg(F.min(y).alias("a"), F.min(x).alias("b"), F.max(y.bitwiseOR(last)).alias("c"), F.max(x.bitwiseOR(last)).alias("d"))
    return box.select(
        "shape_id", codec.units_to_lat(F.col("a")).alias("swlat"), codec.units_to_lon(F.col("b")).alias("swlon"),
        codec.units_to_lat(F.col("c")).alias("nelat"), codec.units_to_lon(F.col("d")).alias("nelon"),
    )


def _arc(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a, b = math.radians(lat1), math.radians(lat2)
    s = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return math.degrees(2 * math.asin(min(1.0, math.sqrt(s)))) * measure.METRES_PER_DEGREE


#: Length of a cell's diagonal at the equator, for each resolution.
DIAGONALS = {r: _arc(0, 0, 180.0 / 2**r, 360.0 / 2**r) for r in codec.RESOLUTIONS}


def for_error(box: tuple[float, float, float, float], share: float) -> int:
    """The finest resolution whose cell diagonal exceeds a share of the box's diagonal (0.01 is 1 %); 2 if none does."""
    most = share * _arc(*box)
    return next((r for r in reversed(codec.RESOLUTIONS) if DIAGONALS[r] > most), 2)


def for_error_column(diagonal: Column, share: float) -> Column:
    """The same for a column of box diagonals in metres."""
    pick = lambda out, r: F.when(F.lit(DIAGONALS[r]) > diagonal * share, F.lit(r)).otherwise(out)
    return reduce(pick, codec.RESOLUTIONS, F.lit(2))


def for_polygon(box: tuple[int, int, int, int], offset: int = 0) -> int:
    """Resolution for a box in units (swy, swx, ney, nex); an offset of 0 or less asks for one finer by that much."""
    dy, dx = (min(max(abs(b - a), 1), LAST) for a, b in ((box[0], box[2]), (box[1], box[3])))
    a, b = dy.bit_length() - 1, dx.bit_length() - 1
    steps = (max(a, b) - 4 if abs(a - b) > 4 else min(a, b)) & ~1
    res = 32 - steps
    if offset <= 0 and res - offset <= 32:
        res -= offset
    return min(max(res & ~1, 2), 32)


def for_polyline(box: tuple[int, int, int, int], offset: int = 0) -> int:
    """Resolution for a line's box: four finer than a polygon's, at most 64 cells a side, at most 26."""
    res = min(for_polygon(box) + 4, 32)
    while res > 2 and any(abs(b - a) >> (32 - res) > 64 for a, b in ((box[0], box[2]), (box[1], box[3]))):
        res -= 2
    res = min(res, 26)
    return (res - offset if 2 <= res - offset <= 32 else res) & ~1
