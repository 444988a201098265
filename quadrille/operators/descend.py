"""Geometry to cells from the top: cells that the rim touches are split, level by level.

Rings of a shape are taken together by the even-odd rule, so holes are rings too. A relation of (cell, side) is handed down: a side
goes on only to the children whose interior it passes through, so work goes with the cells along the rim. What the other sides say about a cell
is one bit, whether a reference point in it is inside: from a cell's point to its child's point a path of two legs is crossed
only by sides that pass through the cell, so the bit is handed down and turned once for each crossing. A
cell that no side touches is all inside or all outside, as its bit says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import codec, measure, resolution
from quadrille.operators import coverage as cov
from quadrille.operators.graph import saved

OUT, RIM, INSIDE = 0, 1, 2
SIDE = ("y1", "x1", "y2", "x2")
#: Where in a cell its reference point is, beyond the middle in units: off the whole numbers that vertices have, and off the lines between them.
BESIDE_Y, BESIDE_X = 0.3819660113, 0.2360679775


def sides_of(rings: DataFrame) -> DataFrame:
    """(shape_id, ring array<struct<y, x>>) -> (shape_id, y1, x1, y2, x2), a row for each side; rings of less than three vertices have none."""
    n = F.size("ring")
    nxt = lambda k: F.get("ring", (k + 1) % n)
    d = lambda c: c.cast("double")
    sides = F.transform("ring", lambda v, k: F.struct(d(v["y"]).alias("y1"), d(v["x"]).alias("x1"), d(nxt(k)["y"]).alias("y2"), d(nxt(k)["x"]).alias("x2")))
    return rings.filter(n >= 3).select("shape_id", F.inline(sides)).filter("y1 <> y2 or x1 <> x2")


def passes(y: Column, x: Column, step: Column) -> Column:
    """Whether the row's side has a point in the open square from (y, x)."""
    low, high = F.lit(0.0), F.lit(1.0)
    outside = F.lit(False)
    for start, end, border in (("y1", "y2", y), ("x1", "x2", x)):
        p, d = F.col(start), F.col(end) - F.col(start)
        a, b = F.try_divide(border - p, d), F.try_divide(border + step - p, d)
        level = d == 0
        outside = outside | (level & ((p <= border) | (p >= border + step)))
        low = F.when(level, low).otherwise(F.greatest(low, F.least(a, b)))
        high = F.when(level, high).otherwise(F.least(high, F.greatest(a, b)))
    return ~outside & (low < high)


def _crosses(u1: Column, v1: Column, u2: Column, v2: Column, u: Column, low: Column, high: Column) -> Column:
    """Whether a side meets the line u between low and high on the other axis."""
    at = v1 + F.try_divide((u - u1) * (v2 - v1), u2 - u1)
    return ((u1 > u) != (u2 > u)) & (at > low) & (at <= high)


def cover_geometry(rings: DataFrame, min_res: int = 2, max_res: int = 16, inside_only: bool = False, max_cells: int = 0, limits: DataFrame | None = None, uniform: bool = False) -> DataFrame:
    """(shape_id, ring array<struct<y, x>>) -> coverage.

    A cell is taken where it lies inside and is min_res or finer, or where it meets the area at
    max_res, unless only cells inside are asked for. A negative max_res stands for so much finer than the
    first level with a cell inside. A shape with more than max_cells cells has none. limits (shape_id, limit) gives each shape
    a max_res of its own; with uniform all cells have the resolution of the limit.
    """
    sides = sides_of(rings)
    sides = sides.withColumn("limit", F.lit(max_res if max_res > 0 else 32)) if limits is None else sides.join(limits, "shape_id")
    y1, x1, y2, x2 = map(F.col, SIDE)
    half = lambda res: float(1 << (32 - res)) / 2
    # the first level: a whole ray to the east tells which points are inside
    roots = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.call_function("shiftleft", k.cast("long"), F.lit(60)))
    here = sides.withColumn("child", F.explode(roots)).withColumn("y", codec.y_of(F.col("child")).cast("double")).withColumn("x", codec.x_of(F.col("child")).cast("double"))
    ray = _crosses(y1, x1, y2, x2, F.col("y") + half(2) + BESIDE_Y, F.col("x") + half(2) + BESIDE_X, F.lit(float("inf")))
    met = saved(here.select("shape_id", "limit", *SIDE, F.lit(None).cast("bigint").alias("cell"), "child", ray.cast("int").alias("turns"), passes(F.col("y"), F.col("x"), F.lit(float(1 << 30))).alias("touched")))
    above = None
    taken = None
    for res in codec.RESOLUTIONS:
        told = met.groupBy("shape_id", "limit", "cell", "child").agg((F.sum("turns") % 2).cast("int").alias("turns"), F.max("touched").alias("touched"))
        if above is None:
            bit = told.withColumn("bit", F.col("turns"))
        else:  # children that no side of the parent has to do with are there too
            bit = told.join(above, ["shape_id", "cell"]).withColumn("bit", (F.col("bit") + F.col("turns")) % 2)
        judged = saved(bit.select("shape_id", "limit", F.col("child").alias("cell"), "bit", F.when(F.col("touched"), RIM).when(F.col("bit") == 1, INSIDE).otherwise(OUT).alias("state")))
        found = judged.filter(F.col("state") != OUT)
        if max_res < 0 and limits is None:
            first = judged.filter(F.col("state") == INSIDE).select("shape_id", F.lit(res - max_res).alias("_first")).distinct()
            nearer = F.least("limit", F.coalesce("_first", F.lit(32)))
            found = found.join(first, "shape_id", "left").withColumn("limit", nearer).drop("_first")
            met = met.join(first, "shape_id", "left").withColumn("limit", nearer).drop("_first")
        inside = (F.col("state") == INSIDE) & (F.col("limit") <= res if uniform else F.lit(res >= min_res))
        ended = (F.col("limit") <= res) & (~F.lit(inside_only) | (F.col("state") == INSIDE))
        here = found.filter(inside | ended).select("shape_id", F.lit(res).alias("res"), "cell")
        taken = here if taken is None else taken.unionByName(here)
        if res == 32:
            break
        # inside cells that have to be finer are spread out at once, no side has to do with them
        coarse = found.filter((F.col("state") == INSIDE) & ~inside & (F.col("limit") > res))
        if not coarse.isEmpty():
            whole = coarse.withColumn("_to", F.col("limit") if uniform else F.greatest(F.lit(min_res), F.lit(res + 2)))
            last = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_to") - res) * 2) - 1
            spread = whole.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), last)))
            fine = F.col("cell").bitwiseOR(F.call_function("shiftleft", F.col("_k"), F.lit(64) - F.col("_to") * 2))
            taken = taken.unionByName(spread.select("shape_id", F.col("_to").alias("res"), fine.alias("cell")))
        above = found.filter((F.col("state") == RIM) & (F.col("limit") > res)).select("shape_id", "cell", "bit")
        if above.isEmpty():
            break
        going = met.filter(F.col("touched") & (F.col("limit") > res)).select("shape_id", "limit", *SIDE, F.col("child").alias("cell"))
        child = F.call_function("shiftleft", F.col("_k").cast("long"), F.lit(60 - 2 * res))
        split = going.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumn("child", F.col("cell").bitwiseOR(child))
        for name, of in (("py", codec.y_of(F.col("cell"))), ("px", codec.x_of(F.col("cell"))), ("y", codec.y_of(F.col("child"))), ("x", codec.x_of(F.col("child")))):
            split = split.withColumn(name, of.cast("double"))
        p, q = F.col("py") + half(res) + BESIDE_Y, F.col("px") + half(res) + BESIDE_X
        r, s = F.col("y") + half(res + 2) + BESIDE_Y, F.col("x") + half(res + 2) + BESIDE_X
        along = _crosses(y1, x1, y2, x2, p, F.least(q, s), F.greatest(q, s))
        across = _crosses(x1, y1, x2, y2, s, F.least(p, r), F.greatest(p, r))
        met = saved(split.select("shape_id", "limit", *SIDE, "cell", "child", (along.cast("int") + across.cast("int")).alias("turns"), passes(F.col("y"), F.col("x"), F.lit(half(res + 2) * 2)).alias("touched")))
    if max_cells > 0:
        fits = taken.groupBy("shape_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= max_cells)
        taken = taken.join(fits, "shape_id", "left_semi")
    return taken


def shape(rings: DataFrame, res: int, inside_only: bool = False, max_cells: int = 0) -> DataFrame:
    return cov.optimize(cover_geometry(rings, 2, res, inside_only, max_cells))


def uniform_shape(rings: DataFrame, res: int, inside_only: bool = False, max_cells: int = 0) -> DataFrame:
    return cover_geometry(rings, res, res, inside_only, max_cells)


def error_limits(rings: DataFrame, share: float) -> DataFrame:
    """(shape_id, limit): the resolution whose cell diagonal fits a share of the diagonal of each shape's box (0.01 is 1 %)."""
    v = rings.select("shape_id", F.explode("ring").alias("v"))
    box = v.groupBy("shape_id").agg(F.min("v.y").alias("swy"), F.min("v.x").alias("swx"), F.max("v.y").alias("ney"), F.max("v.x").alias("nex"))
    diagonal = measure.great_circle_degrees(codec.units_to_lat(F.col("swy")), codec.units_to_lon(F.col("swx")), codec.units_to_lat(F.col("ney")), codec.units_to_lon(F.col("nex")))
    return box.select("shape_id", resolution.for_error_column(diagonal, share).alias("limit"))


def shape_for_error(rings: DataFrame, share: float, inside_only: bool = False, max_cells: int = 0) -> DataFrame:
    """As shape, at a resolution chosen for each shape by the error allowed."""
    return cov.optimize(cover_geometry(rings, inside_only=inside_only, max_cells=max_cells, limits=error_limits(rings, share)))


def uniform_shape_for_error(rings: DataFrame, share: float, inside_only: bool = False, max_cells: int = 0) -> DataFrame:
    return cover_geometry(rings, inside_only=inside_only, max_cells=max_cells, limits=error_limits(rings, share), uniform=True)
