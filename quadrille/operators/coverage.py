"""The coverage relation (shape_id, res, cell): building, inspecting, simplifying, combining.

cell is a code aligned to the left, so all resolutions up to 32 fit. `key` is the same cell as hex
digits, whose length tells the resolution; joins between levels use it. Every operator is a plan;
loops run over the 16 resolutions at most, never over rows, and are cut in between so that plans stay small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.functions import codec, hierarchy
from quadrille.operators.graph import saved

COLUMNS = ("shape_id", "res", "cell")
FULL = 16


# --- building and reading ------------------------------------------------------------------------


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "shape_id string, res int, cell bigint")


def from_geocells(shapes: DataFrame, column: str = "cells") -> DataFrame:
    """(shape_id, array of geocells) -> coverage."""
    return shapes.select("shape_id", F.explode(column).alias("_g")).select(
        "shape_id", hierarchy.geocell_resolution(F.col("_g")).alias("res"), hierarchy.geocell_code(F.col("_g")).alias("cell")
    ).distinct()


def from_map(shapes: DataFrame, column: str = "cells") -> DataFrame:
    """(shape_id, map of resolution to codes) -> coverage; keys that are no resolution are left out."""
    spread = shapes.select("shape_id", F.explode(column).alias("res", "_codes")).filter(F.col("res").isin(*codec.RESOLUTIONS))
    return align(spread.select("shape_id", F.col("res").cast("int").alias("res"), F.explode("_codes").alias("cell")))


def from_hex(rows: DataFrame, column: str = "hex") -> DataFrame:
    """(shape_id, hex digits) -> coverage."""
    return rows.select("shape_id", (F.length(column) * 2).cast("int").alias("res"), codec.from_hex(F.col(column)).alias("cell")).distinct()


def keep_bits(res: Column) -> Column:
    return F.call_function("shiftleft", F.lit(-1).cast("long"), (F.lit(64) - res * 2).cast("int"))


def align(coverage: DataFrame) -> DataFrame:
    return coverage.withColumn("cell", F.col("cell").bitwiseAND(keep_bits(F.col("res")))).distinct()


def hex_of(res: Column, cell: Column) -> Column:
    return F.substring(codec.to_hex(cell), F.lit(1), (res / 2).cast("int"))


def keyed(coverage: DataFrame) -> DataFrame:
    return coverage.withColumn("key", hex_of(F.col("res"), F.col("cell")))


def unkeyed(rows: DataFrame) -> DataFrame:
    """(shape_id, key) -> coverage."""
    return rows.select("shape_id", (F.length("key") * 2).cast("int").alias("res"), codec.from_hex(F.col("key")).alias("cell"))


def levels_of(coverage: DataFrame) -> list[int]:
    return sorted(r[0] for r in coverage.select("res").distinct().collect())  # 16 at most


def with_ancestors(coverage: DataFrame, own: bool = False, levels: list[int] | None = None) -> DataFrame:
    """Each row once for each ancestor: _ares and _acell; with own, the cell itself too. Of levels only, where those are given: coarser ones have few cells, so each would gather many rows."""
    top = F.col("res") if own else F.col("res") - 2
    tried = F.array(*map(F.lit, codec.RESOLUTIONS if levels is None else levels)).cast("array<int>")
    return coverage.withColumn("_ares", F.explode(F.filter(tried, lambda r: r <= top))).withColumn("_acell", F.col("cell").bitwiseAND(keep_bits(F.col("_ares"))))


def to_geocells(coverage: DataFrame, finest: int = 30) -> DataFrame:
    """shape_id and its geocells as a sorted array; cells finer than `finest` are cut to it."""
    capped = limit_levels(coverage, 2, min(finest, 30))
    cell = F.shiftrightunsigned("cell", 4).bitwiseOR(F.call_function("shiftleft", (F.col("res") / 2).cast("long"), F.lit(60)))
    return capped.groupBy("shape_id").agg(F.array_sort(F.collect_set(cell)).alias("cells"))


def to_text(coverage: DataFrame, separator: str = " ", prefix: str = "") -> DataFrame:
    """shape_id and its cells as text, sorted."""
    one = F.concat(F.lit(prefix), hex_of(F.col("res"), F.col("cell")))
    return coverage.groupBy("shape_id").agg(F.array_join(F.array_sort(F.collect_set(one)), separator).alias("text"))


def serialize(coverage: DataFrame) -> DataFrame:
    """shape_id and its geocells, 8 bytes each, big-endian."""
    return to_geocells(coverage).select("shape_id", F.unhex(F.array_join(F.transform("cells", lambda c: F.lpad(F.hex(c), 16, "0")), "")).alias("bytes"))


def deserialize(rows: DataFrame) -> DataFrame:
    digits = F.hex("bytes")
    cells = F.transform(F.sequence(F.lit(0), (F.length(digits) / 16 - 1).cast("int")), lambda k: F.conv(F.substring(digits, k * 16 + 1, F.lit(16)), 16, -10).cast("long"))
    return from_geocells(rows.filter(F.length("bytes") > 0).select("shape_id", cells.alias("cells")))


# --- inspecting ----------------------------------------------------------------------------------


def cardinalities(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("shape_id", "res").agg(F.count(F.lit(1)).alias("cells"))


def summary(coverage: DataFrame) -> DataFrame:
    """Cells, coarsest, finest and mean resolution, and area in cells of resolution 32."""
    weight = F.sum(F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(64) - F.col("res") * 2).cast("int")).cast("decimal(38,0)"))
    # a shift by 62 is the largest that stays positive: resolution 2 has 2**60, so all fit
    sums = coverage.groupBy("shape_id").agg(
        F.count(F.lit(1)).alias("cells"), F.min("res").alias("coarsest"), F.max("res").alias("finest"), weight.cast("decimal(38,0)").alias("area")
    )
    # of the mean area in whole cells of resolution 32, a cell of resolution r having 2**(64 - 2 r) of them: the finest level whose cells are no smaller
    mean = F.floor(F.col("area") / F.col("cells")).cast("long")
    bits = F.when(mean > 1, F.length(F.bin(mean - 1))).otherwise(0)
    return sums.select("shape_id", "cells", "coarsest", "finest", F.floor((64 - bits) / 4).cast("int").alias("quarter"), "area").select(
        "shape_id", "cells", "coarsest", "finest", (F.col("quarter") * 2).alias("mean_res"), "area"
    )


def resolutions_at(coverage: DataFrame, points: DataFrame) -> DataFrame:
    """points with the coarsest and finest resolution of a cell around them, for each shape; points without one are left out."""
    from quadrille.operators import match

    hit = match.join_points(points, coverage, distinct=False)
    return hit.groupBy(*points.columns, "shape_id").agg(F.min("res").alias("coarsest"), F.max("res").alias("finest"))


# --- simplifying ---------------------------------------------------------------------------------


def dedup(coverage: DataFrame) -> DataFrame:
    """Without cells that lie inside another cell of their shape."""
    rows = coverage.select(*COLUMNS).distinct()
    covered = with_ancestors(rows, levels=levels_of(rows)).join(rows.select("shape_id", F.col("res").alias("_ares"), F.col("cell").alias("_acell")), ["shape_id", "_ares", "_acell"], "left_semi")
    return rows.join(covered.select(*COLUMNS).distinct(), list(COLUMNS), "left_anti")


def threshold_of(thresholds: int, res: int) -> int:
    """The nibble for a resolution in a threshold word, resolution 2 in the highest; 0 stands for 16."""
    return (thresholds >> 4 * (16 - res // 2) & 15) or FULL


def _parent(res: int) -> Column:
    return F.col("cell").bitwiseAND(codec.long(codec.mask(2 * (res - 2))))


def optimize(coverage: DataFrame, thresholds: int = 0, min_res: int = 0, max_res: int = 32, cell_count: int = 0) -> DataFrame:
    """Parents in place of enough children, finest level first; what is made takes part in the next level.

    With cell_count, a shape that has no more cells than that is left as it is from then on. Where
    all 16 children are asked for, which is what 0 stands for, no level has to wait for another: a
    cell is made exactly if the cells inside it add up to its area.
    """
    rows = saved(dedup(coverage))
    if thresholds == 0 and max_res == 32 and cell_count == 0:
        area = lambda res: F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(64) - res * 2).cast("int"))
        parts = with_ancestors(rows).filter(F.col("_ares") >= max(min_res, 2))
        full = parts.groupBy("shape_id", F.col("_ares").alias("res"), F.col("_acell").alias("cell")).agg(F.sum(area(F.col("res"))).alias("_sum"))
        made = full.filter(F.col("_sum") == area(F.col("res"))).select(*COLUMNS)
        return dedup(saved(rows.unionByName(made)))
    present = [r[0] for r in rows.select("res").distinct().collect()]  # 16 numbers at most
    for res in range(min(max_res, max(present, default=2)), max(min_res, 2), -2):
        here = rows.filter(F.col("res") == res)
        full = here.groupBy("shape_id", _parent(res).alias("_up")).agg(F.count_distinct("cell").alias("_n")).filter(F.col("_n") >= threshold_of(thresholds, res))
        if cell_count > 0:
            large = rows.groupBy("shape_id").agg(F.count(F.lit(1)).alias("_all")).filter(F.col("_all") > cell_count)
            full = full.join(large, "shape_id", "left_semi")
        made = full.select("shape_id", F.lit(res - 2).alias("res"), F.col("_up").alias("cell"))
        left = here.withColumn("_up", _parent(res)).join(full, ["shape_id", "_up"], "left_anti").select(*COLUMNS)
        rows = saved(rows.filter(F.col("res") != res).unionByName(left).unionByName(made).distinct())
    return dedup(rows)


def prune(coverage: DataFrame, thresholds: int, min_res: int = 0) -> DataFrame:
    """Only groups of siblings with more members than the threshold; 0 prunes nothing; levels up to min_res stay."""
    nibble = F.lit(0)
    for res in codec.RESOLUTIONS:
        nibble = F.when(F.col("res") == res, thresholds >> 4 * (16 - res // 2) & 15).otherwise(nibble)
    up = F.col("cell").bitwiseAND(keep_bits(F.col("res") - 2))
    siblings = F.count(F.lit(1)).over(Window.partitionBy("shape_id", "res", "_up"))
    rows = coverage.select(*COLUMNS).distinct().withColumn("_up", F.when(F.col("res") > 2, up).otherwise(F.lit(0))).withColumn("_n", siblings)
    return rows.filter((F.col("res") <= min_res) | (F.col("_n") > nibble)).select(*COLUMNS)


def normalize(coverage: DataFrame, res: int, most_levels: int = 6) -> DataFrame:
    """All cells at one resolution. Coarser cells are spread out: by most_levels levels (16 children each) at most."""
    gap = (F.lit(res) - F.col("res")) / 2
    spread = F.when(gap <= most_levels, gap.cast("int")).otherwise(F.raise_error(F.lit(f"a cell would become more than 16**{most_levels} cells")).cast("int"))
    fine = coverage.filter(F.col("res") >= res).select("shape_id", F.col("cell").bitwiseAND(codec.long(codec.mask(2 * res))).alias("cell"))
    coarse = coverage.filter(F.col("res") < res).withColumn("_d", spread)
    last = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_d") * 4) - 1
    filled = coarse.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), last))).select(
        "shape_id", F.col("cell").bitwiseOR(F.shiftleft("_k", 64 - 2 * res)).alias("cell")
    )
    return fine.unionByName(filled).distinct().select("shape_id", F.lit(res).alias("res"), "cell")


def limit_levels(coverage: DataFrame, min_res: int, max_res: int) -> DataFrame:
    """Cells finer than max_res become their ancestors there; cells coarser than min_res are spread out to it."""
    cut = coverage.filter(F.col("res") >= min_res).select(
        "shape_id", F.least("res", F.lit(max_res)).alias("res"), F.col("cell").bitwiseAND(keep_bits(F.least("res", F.lit(max_res)))).alias("cell")
    )
    coarse = coverage.filter(F.col("res") < min_res)
    return dedup(cut.unionByName(normalize(coarse, min_res)) if min_res > 2 else cut)


def reduce_cells(coverage: DataFrame, count: int) -> DataFrame:
    """Each shape with `count` cells at most, coarser where it must be: thresholds go down from 15 to 1, finest level first.

    All shapes are worked on at once, level by level. What a threshold would save on a level is known from the numbers of siblings, so a
    sum for each threshold and shape tells the largest one that fits; a shape that fits is left as it is from then on, and where none
    does, all its cells on the level give way to their parents. A shape's cells meet by parent, 16 at most, never as a whole; of the
    levels' states only whether any shape is still too large reaches the driver. Coverages whose cells are all at resolution 2 stay.
    """
    base = saved(optimize(coverage))
    state = saved(base.groupBy("shape_id").agg(F.count(F.lit(1)).alias("size")))
    levels, made, out = levels_of(base), None, []
    for res in range(max(levels, default=2), 2, -2):
        if state.filter(F.col("size") > count).isEmpty():
            break
        here = base.filter(F.col("res") == res)
        here = here if made is None else here.unionByName(made)
        groups = saved(here.groupBy("shape_id", _parent(res).alias("up")).agg(F.count(F.lit(1)).alias("n"), F.collect_list("cell").alias("kids")))
        saves = lambda t: F.sum(F.when(F.col("n") >= t, F.col("n") - 1).otherwise(0))
        sums = groups.groupBy("shape_id").agg(F.array(*[saves(t) for t in range(1, FULL)]).alias("saves"))
        fits = F.array_max(F.filter(F.sequence(F.lit(2), F.lit(FULL - 1)), lambda t: F.col("size") - F.get("saves", t - 1) <= count))
        least = F.when(F.col("size") <= count, FULL + 1).otherwise(F.coalesce(fits, F.lit(1)))
        chosen = saved(state.join(sums, "shape_id", "left").withColumn("least", F.when(F.col("saves").isNotNull(), least)))
        state = chosen.select("shape_id", F.when(F.col("least") <= FULL, F.col("size") - F.get("saves", F.col("least") - 1)).otherwise(F.col("size")).alias("size"))
        judged = groups.join(chosen.select("shape_id", "least"), "shape_id")
        out.append(judged.filter("n < least").select("shape_id", F.lit(res).alias("res"), F.explode("kids").alias("cell")))
        made = saved(judged.filter("n >= least").select("shape_id", F.lit(res - 2).alias("res"), F.col("up").alias("cell")))
        levels = [r for r in levels if r < res]
    rest = base.filter(F.col("res").isin(levels)) if levels else base.limit(0)
    return reduce(DataFrame.unionByName, [rest if made is None else rest.unionByName(made), *out])


# --- combining -----------------------------------------------------------------------------------


def merge(*coverages: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [c.select(*COLUMNS) for c in coverages]).distinct()


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return optimize(merge(a, b))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """For shapes of one id: cells of either side that lie in a cell of the other."""
    x, y = saved(dedup(a)), saved(dedup(b))

    def inside(deep: DataFrame, wide: DataFrame) -> DataFrame:
        return with_ancestors(deep, own=True, levels=levels_of(wide)).join(wide.select("shape_id", F.col("res").alias("_ares"), F.col("cell").alias("_acell")), ["shape_id", "_ares", "_acell"], "left_semi").select(*COLUMNS)

    return inside(x, y).unionByName(inside(y, x)).distinct()


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """For shapes of one id: what a covers and b doesn't. A cell of a that b covers in part is split only along the way to b's cells."""
    x, y = saved(dedup(a)), saved(dedup(b))
    wide = y.select("shape_id", F.col("res").alias("_ares"), F.col("cell").alias("_acell"))
    gone = with_ancestors(x, own=True, levels=levels_of(y)).join(wide, ["shape_id", "_ares", "_acell"], "left_semi").select(*COLUMNS)
    left = x.join(gone.distinct(), list(COLUMNS), "left_anti")
    # cells of b strictly inside a cell of a, and the nodes between: those are split
    up = with_ancestors(y, levels=levels_of(x)).withColumnsRenamed({"res": "_bres", "cell": "_bcell"})
    hit = up.join(left.select("shape_id", F.col("res").alias("_ares"), F.col("cell").alias("_acell")), ["shape_id", "_ares", "_acell"])
    between = hit.withColumn("res", F.explode(F.sequence(F.col("_ares"), F.col("_bres") - 2, F.lit(2)))).withColumn("cell", F.col("_bcell").bitwiseAND(keep_bits(F.col("res"))))
    split = saved(between.select(*COLUMNS).distinct())
    whole = left.join(split, list(COLUMNS), "left_anti")
    child = F.col("cell").bitwiseOR(F.call_function("shiftleft", F.col("_k").cast("long"), (F.lit(60) - F.col("res") * 2).cast("int")))
    parts = split.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(15)))).select("shape_id", (F.col("res") + 2).alias("res"), child.alias("cell"))
    return whole.unionByName(parts.join(split, list(COLUMNS), "left_anti").join(y, list(COLUMNS), "left_anti"))


def co_normalize(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with their partly shared cells split, so that cells of the two are equal or apart."""
    common = intersect(a, b)
    return minus(a, common).unionByName(common), minus(b, common).unionByName(common)


def minus_normalized(a: DataFrame, b: DataFrame, res: int) -> DataFrame:
    return normalize(a, res).subtract(normalize(b, res))


def intersect_normalized(a: DataFrame, b: DataFrame, res: int) -> DataFrame:
    return normalize(a, res).intersect(normalize(b, res))


def clusters(coverage: DataFrame) -> DataFrame:
    """coverage with cluster: the least key of the cells that hang together over sides (corners don't count, nor the world's edge)."""
    from quadrille.operators.graph import components

    rows = saved(dedup(coverage))
    step = F.expr("shiftleft(1L, 32 - res)")
    y, x = codec.y_of(F.col("cell")), codec.x_of(F.col("cell"))
    moves = F.array(*[F.struct((y + a * step).alias("y"), (x + b * step).alias("x")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    sides = rows.withColumn("_m", F.explode(moves)).filter("_m.y >= 0 and _m.y < 4294967296 and _m.x >= 0 and _m.x < 4294967296")
    beside = sides.select("shape_id", F.col("res").alias("_res"), F.col("cell").alias("_cell"), "res", codec.encode_units(F.col("_m.y"), F.col("_m.x")).alias("cell"))
    wide = rows.select("shape_id", F.col("res").alias("_ares"), F.col("cell").alias("_acell"))
    name = lambda res, cell: F.concat_ws("/", F.col("shape_id"), hex_of(res, cell))
    links = with_ancestors(beside, own=True, levels=levels_of(rows)).join(wide, ["shape_id", "_ares", "_acell"]).select(
        name(F.col("_res"), F.col("_cell")).alias("a"), name(F.col("_ares"), F.col("_acell")).alias("b")
    )
    labels = components(links)
    out = rows.withColumn("_node", name(F.col("res"), F.col("cell"))).join(labels, F.col("_node") == F.col("node"), "left")
    return out.select(*COLUMNS, F.element_at(F.split(F.coalesce("label", "_node"), "/"), -1).alias("cluster"))
