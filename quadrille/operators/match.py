"""Points and coverages: the cell join and what is built on it.

A point lies in a cell if the cell is one of its prefixes. Only resolutions that the coverage has
are tried (they are 16 at most and asked for first), so a point becomes as many rows as there are levels, and one
equality join on (res, cell) finds all shapes. Spark broadcasts the coverage where it is small and
shuffles both sides where it isn't.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions import codec, measure
from quadrille.operators.coverage import keep_bits
from quadrille.operators.graph import saved
from quadrille.shipping import ship


def levels_of(coverage: DataFrame) -> list[int]:
    return sorted(r[0] for r in coverage.select("res").distinct().collect())


def probes(points: DataFrame, levels: list[int], code: str = "hh") -> DataFrame:
    """points once for each level: res and cell."""
    tried = F.array(*[F.lit(r) for r in levels]) if levels else F.array().cast("array<int>")
    return points.withColumn("res", F.explode(tried)).withColumn("cell", F.col(code).bitwiseAND(keep_bits(F.col("res"))))


def join_points(points: DataFrame, coverage: DataFrame, code: str = "hh", distinct: bool = True) -> DataFrame:
    """Each point with each shape it lies in. Without distinct, once for each cell around it, with res and cell."""
    hit = probes(points, levels_of(coverage), code).join(coverage.select("shape_id", "res", "cell").distinct(), ["res", "cell"])
    return hit.select(*points.columns, "shape_id").distinct() if distinct else hit.select(*points.columns, "shape_id", "res", "cell")


#: Cells of a coverage that are sent to every task at most, 16 bytes each; larger ones are shuffled.
BROADCAST_CELLS = 1 << 20


def _matched(points: DataFrame, wanted: DataFrame, levels: list[int], code: str) -> DataFrame:
    codes = probes(points.select(F.col(code).alias("_code")).distinct(), levels, "_code")
    return codes.join(wanted, ["res", "cell"], "left_semi").select("_code").distinct()


def _filtered(points: DataFrame, coverage: DataFrame, code: str, low: int, high: int, inside: bool) -> DataFrame:
    """Points in the coverage, or the others. Up to BROADCAST_CELLS its cells go to the points, a look-up for each level, and no point is shuffled."""
    wanted = saved(coverage.filter(F.col("res").between(low, high)).select("res", "cell").distinct())  # read once for each level
    held = {r["res"]: r["count"] for r in wanted.groupBy("res").count().collect()}  # 16 levels at most
    if sum(held.values()) > BROADCAST_CELLS:
        return points.join(_matched(points, wanted, sorted(held), code), F.col(code) == F.col("_code"), "left_semi" if inside else "left_anti")
    marked, hit = points, F.lit(False)
    for res in sorted(held):
        cells = wanted.filter(F.col("res") == res).select(F.col("cell").alias(f"_cell_{res}"))
        marked = marked.join(F.broadcast(cells), codec.at_resolution(F.col(code), res) == F.col(f"_cell_{res}"), "left")
        hit = hit | F.col(f"_cell_{res}").isNotNull()
    return marked.filter(hit if inside else ~hit).select(*points.columns)


def semi_join(points: DataFrame, coverage: DataFrame, code: str = "hh", low: int = 2, high: int = 32) -> DataFrame:
    """Points in any shape, each row once; only cells of resolutions low to high count."""
    return _filtered(points, coverage, code, low, high, True)


def anti_join(points: DataFrame, coverage: DataFrame, code: str = "hh", low: int = 2, high: int = 32) -> DataFrame:
    """Points in no shape."""
    return _filtered(points, coverage, code, low, high, False)


def has_cell(coverage: DataFrame, cells: DataFrame) -> DataFrame:
    """cells (res, cell) that a coverage has at that very resolution."""
    return cells.join(coverage.select("res", "cell").distinct(), ["res", "cell"], "left_semi")


def _cells_around(centers: DataFrame, north: float, res: int) -> DataFrame:
    """(center_id, lat, lon, cell): the cells that a circle of `north` degrees touches, each once for a center.

    Row by row: in the latitudes of a row of cells a circle is widest where its meridian of tangency stands, or
    at the row's end that is nearer to it; the columns looked at are those within that width, all of them around a pole.
    """
    rows, tall, wide, step = 1 << res, 180.0 / 2**res, 360.0 / 2**res, 1 << (32 - res)
    own = centers.select("center_id", "lat", "lon").distinct()
    everywhere = north >= 90.0  # beyond a quarter of the way around all cells are looked at
    radius = math.radians(north) * (1 + 1e-6) + 1e-9  # what rounding may move stays inside
    reach = 180.0 if everywhere else math.degrees(radius)
    row = lambda lat: F.least(F.greatest(F.floor((lat + 90.0) / tall), F.lit(0)), F.lit(rows - 1))
    placed = own.withColumn("_row", F.explode(F.sequence(row(F.col("lat") - reach), row(F.col("lat") + reach))))
    if everywhere:
        half = F.lit(180.0)
    else:
        lat = F.radians("lat")
        south, end = F.radians(F.col("_row") * tall - 90.0), F.radians((F.col("_row") + 1) * tall - 90.0)
        widest = F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.sin(lat) / math.cos(radius))))
        at = F.least(F.greatest(widest, south), end)
        share = (math.sin(radius / 2) ** 2 - F.pow(F.sin((at - lat) / 2), 2)) / (F.cos(lat) * F.cos(at))
        half = F.degrees(2 * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))))) + 1e-6
    sized = placed.withColumn("_half", half)
    ended = sized.withColumns({"_first": F.floor((F.col("lon") - F.col("_half") + 180.0) / wide), "_last": F.floor((F.col("lon") + F.col("_half") + 180.0) / wide)})
    across = ended.withColumn("_col", F.explode(F.sequence("_first", F.least(F.col("_last"), F.col("_first") + (rows - 1)))))
    return across.select("center_id", "lat", "lon", codec.encode_units(F.col("_row") * step, F.pmod("_col", F.lit(rows)) * step, res).alias("cell"))


def _on_sphere(lat: str, lon: str) -> list[Column]:
    """The place as a vector of length one."""
    a, b = F.radians(lat), F.radians(lon)
    return [F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)]


def within(points: DataFrame, centers: DataFrame, metres: float, code: str = "hh") -> DataFrame:
    """Pairs of a point and a center (center_id, lat, lon) no further apart than `metres`, with the distance.

    Cells of a quarter of the radius or more, less than the whole: a center looks into those that its circle touches, an
    equality join. Of what they hold, pairs whose chord is too long go without trigonometry; the exact distance decides on the others.
    """
    north = metres / measure.METRES_PER_DEGREE
    res = next((r for r in reversed(codec.RESOLUTIONS) if 180.0 / 2**r >= north / 4), 2)
    # conditions are wrapped and the cell is never null, since Spark would otherwise check each part for null beside the scan, spell
    # the codes out once more for it, and get methods that Java doesn't compile; vectors are made behind the shuffle for the same reason
    apart = lambda code: F.coalesce(codec.at_resolution(code, res), F.lit(0).cast("long"))
    vectors = lambda side, lat, lon: {f"_{side}{k}": c for k, c in enumerate(_on_sphere(lat, lon))}
    around = _cells_around(centers, north, res).select("center_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), apart(F.col("cell")).alias("cell"))
    around = around.repartition("cell").withColumns(vectors("c", "_lat", "_lon"))
    placed = points.withColumn("cell", apart(F.col(code))).repartition("cell").withColumns(vectors("p", "lat", "lon"))
    chord = (2 * math.sin(min(math.radians(north) * (1 + 1e-6) + 1e-9, math.pi) / 2)) ** 2 * (1 + 1e-6)
    x, y, z = (F.col(f"_p{k}") - F.col(f"_c{k}") for k in range(3))
    exact = measure.great_circle_degrees(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))
    close = F.col(code).isNotNull() & (x * x + y * y + z * z <= chord) & (exact <= metres)
    near = placed.join(around.hint("merge"), "cell").filter(F.coalesce(close, F.lit(False)))
    return near.withColumn("distance", exact).drop("cell", "_lat", "_lon", *[f"_{s}{k}" for s in "pc" for k in range(3)])


# --- intervals of codes --------------------------------------------------------------------------

#: Intervals that are sent to every task at most, and pairs of a stretch of codes and a shape; larger coverages are joined by levels.
BROADCAST_INTERVALS = 1 << 18
BROADCAST_PAIRS = 1 << 20
#: Cells that intervals don't reach beyond, so that a shape's cells are merged in parts.
BLOCK_RES = 4
#: A code with its first bit turned sorts as a signed number as codes do.
FIRST_BIT = -(1 << 63)


def intervals(coverage: DataFrame) -> DataFrame:
    """(shape_id, low, high): the codes of each shape as intervals that don't touch inside a block; low and high have their first bit turned."""
    rows = coverage.select("shape_id", "res", "cell").distinct()
    last = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(64) - F.col("res") * 2).cast("int")) - 1
    fine = rows.filter(F.col("res") >= BLOCK_RES).select("shape_id", F.col("cell").alias("low"), F.col("cell").bitwiseOR(F.when(F.col("res") == 32, F.lit(0)).otherwise(last)).alias("high"))
    size = 1 << (64 - 2 * BLOCK_RES)
    parts = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.col("cell").bitwiseOR(F.call_function("shiftleft", k.cast("long"), F.lit(64 - 2 * BLOCK_RES))))
    wide = rows.filter(F.col("res") < BLOCK_RES).select("shape_id", F.explode(parts).alias("low")).select("shape_id", "low", F.col("low").bitwiseOR(codec.long(size - 1)).alias("high"))
    turned = fine.unionByName(wide).select(
        "shape_id", F.shiftrightunsigned("low", 64 - 2 * BLOCK_RES).alias("block"), F.col("low").bitwiseXOR(codec.long(FIRST_BIT)).alias("low"), F.col("high").bitwiseXOR(codec.long(FIRST_BIT)).alias("high")
    )
    along = Window.partitionBy("shape_id", "block").orderBy("low", "high")
    reach = F.max("high").over(along.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col("low") > F.try_add(F.col("reach"), F.lit(1).cast("long"))  # null beyond the last code, where nothing begins
    begins = turned.withColumn("reach", reach).withColumn("new", (F.col("reach").isNull() | F.coalesce(apart, F.lit(False))).cast("int"))
    merged = begins.withColumn("part", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0))).groupBy("shape_id", "block", "part").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return merged.select("shape_id", "low", "high")


def _stretches(low: np.ndarray, high: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted starts of stretches of codes, and pairs (stretch, shape) for the shapes that have a stretch."""
    after = high[high < np.iinfo(np.int64).max] + 1
    starts = np.unique(np.concatenate([low, after]))
    first, end = np.searchsorted(starts, low), np.searchsorted(starts, high, side="right")
    size = end - first
    at = np.repeat(first - np.concatenate([[0], size.cumsum()[:-1]]), size) + np.arange(size.sum()) if len(size) else np.zeros(0, np.int64)
    return starts, at, np.repeat(shape, size)


def join_intervals(points: DataFrame, coverage: DataFrame, code: str = "hh") -> DataFrame:
    """Each point with each shape it lies in, as join_points: one binary search for a point, whatever the levels of the coverage.

    The intervals of all shapes are cut where any of them begins or ends; a point finds its stretch by bisection, and the stretch its shapes.
    Up to BROADCAST_INTERVALS intervals are sent to the tasks; a coverage of more (or of shapes that overlap so much that there are over BROADCAST_PAIRS pairs) is joined by levels.
    """
    spark = points.sparkSession
    found = saved(intervals(coverage))
    if found.count() > BROADCAST_INTERVALS:
        return join_points(points, coverage, code)
    got = found.toArrow()
    names = got["shape_id"].to_pylist()
    known = sorted(set(names))
    number = {name: k for k, name in enumerate(known)}
    starts, at, shape = _stretches(got["low"].to_numpy(), got["high"].to_numpy(), np.array([number[n] for n in names], np.int64))
    if len(at) > BROADCAST_PAIRS:
        return join_points(points, coverage, code)
    ship(spark)
    shared = spark.sparkContext.broadcast(starts)

    @F.pandas_udf("long")
    def stretch(codes: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, codes.to_numpy(np.int64), side="right") - 1)

    frame = pd.DataFrame({"_at": at, "_shape": [known[k] for k in shape]})
    pairs = spark.createDataFrame(frame, f"_at bigint, _shape {coverage.schema['shape_id'].dataType.simpleString()}")
    placed = points.filter(F.col(code).isNotNull()).withColumn("_at", stretch(F.col(code).bitwiseXOR(codec.long(FIRST_BIT))))
    return placed.join(F.broadcast(pairs), "_at").select(*points.columns, F.col("_shape").alias("shape_id"))
