"""Areas to cells, as relations: shapes in, rows of (shape_id, res, cell) out.

Everything is a plan over rows: edges come from vertex arrays, grid rows from sequences, interiors from
paired crossings. Rectangles and lines follow the same scheme. A shape's rows are made where the
shape is, so many shapes are covered in parallel; work grows with the cells on a shape's rim and its area.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.functions import codec, resolution
from quadrille.operators.graph import saved
from quadrille.plans import areas
from quadrille.shipping import ship

COVERAGE = "shape_id string, res int, cell bigint"
RINGS = "shape_id string, res int, ring array<struct<y: bigint, x: bigint>>"


def _cell(y: Column, x: Column, res: Column | int) -> Column:
    """Grid coordinates modulo the world to a cell; over a pole the longitude isn't turned, as coverages do."""
    code = codec.encode_units(y.bitwiseAND(F.lit(codec.UNITS - 1)), x.bitwiseAND(F.lit(codec.UNITS - 1)))
    if isinstance(res, int):
        return codec.at_resolution(code, res)
    # a shift by 64 would be one by 0, which is right for resolution 32
    return code.bitwiseAND(F.call_function("shiftleft", F.lit(-1).cast("long"), (F.lit(64) - res * 2).cast("int")))


def rectangles(boxes: DataFrame) -> DataFrame:
    """(shape_id, res, swy, swx, ney, nex) in units -> coverage; an east edge beyond the last unit crosses the date line."""
    step = F.expr("shiftleft(1L, 32 - res)")
    low = lambda c: F.expr(f"{c} & -shiftleft(1L, 32 - res)")
    full = boxes.withColumn("nex", F.least("nex", F.col("swx") + codec.UNITS - 1))
    rows = full.withColumn("_y", F.explode(F.sequence(low("swy"), F.col("ney"), step)))
    cells = rows.withColumn("_x", F.explode(F.sequence(low("swx"), F.col("nex"), step)))
    return cells.select("shape_id", F.col("res").cast("int").alias("res"), _cell(F.col("_y"), F.col("_x"), F.col("res")).alias("cell")).distinct()


def polygons(rings: DataFrame) -> DataFrame:
    """(shape_id, res, ring array<struct<y, x>>) -> coverage: cells that an edge crosses, and the even-odd interior.

    An edge is met by the grid rows in its range and by its own two ends; that gives the cells between its
    crossings of a row and of the row's upper bound. Crossings of whole rows are paired for the interior; a vertex on a
    row counts once, or for neither edge where the ring turns back there. So rows go with the edges' heights in cells, whatever the number
    of vertices, and what is sorted together is what crosses one row of one ring.
    """
    step, low = "shiftleft(1L, 32 - res)", "-shiftleft(1L, 32 - res)"
    # a shape may have several rings (the segments of a path): each is filled on its own
    numbered = rings.withColumn("_ring", F.xxhash64("shape_id", "ring")).filter(F.size("ring") >= 3)
    n = F.size("ring")
    around = F.transform("ring", lambda v, k: F.struct(
        k.alias("_k"), v["y"].alias("iy"), v["x"].alias("ix"),
        F.get("ring", (k + n - 1) % n)["y"].alias("jy"), F.get("ring", (k + n - 1) % n)["x"].alias("jx"), F.get("ring", (k + 1) % n)["y"].alias("ny"),
    ))
    edges = numbered.select("shape_id", "res", "_ring", F.inline(around))
    slanted = edges.filter("iy <> jy").withColumn("_lo", F.least("iy", "jy")).withColumn("_hi", F.greatest("iy", "jy"))
    first = f"((_lo + {step} - 1) & {low})"
    bounds = F.expr(f"if({first} <= _hi, sequence({first}, _hi, {step}), cast(array() as array<bigint>))")
    met = slanted.withColumn("_row", F.explode(F.array_distinct(F.concat(bounds, F.array("_lo", "_hi")))))
    slope = (F.col("jx") - F.col("ix")).cast("double") / (F.col("jy") - F.col("iy")).cast("double")
    cross = lambda row: F.col("ix") + ((row - F.col("iy")) * slope).cast("long")
    crossed = (
        met.withColumn("_a", cross(F.col("_row"))).withColumn("_b", cross(F.expr(f"_row | ({step} - 1)")))
        .withColumn("_from", F.expr(f"greatest(least(_a, _b), least(ix, jx)) & {low}"))
        .withColumn("_to", F.expr(f"least(greatest(_a, _b), greatest(ix, jx)) & {low}"))
    )
    sane = crossed.withColumn("_from", F.least("_from", "_to"))
    rim = sane.select("shape_id", "res", F.col("_row").alias("_y"), F.explode(F.expr(f"sequence(_from, _to, {step})")).alias("_x"))
    level = edges.filter("iy = jy").select(
        "shape_id", "res", F.col("iy").alias("_y"), F.explode(F.expr(f"sequence(least(ix, jx) & {low}, greatest(ix, jx), {step})")).alias("_x")
    )
    counts = (F.col("_row") != F.col("iy")) & (F.col("_row") != F.col("jy"))
    turns = (F.col("_row") == F.col("iy")) & ((F.col("ny") - F.col("iy")).cast("double") * (F.col("jy") - F.col("iy")).cast("double") > 0)
    passes = (F.col("_row") == F.col("jy")) | turns
    nodes = sane.filter(F.expr(f"_row = (_row & {low})") & (counts | passes)).select("shape_id", "res", "_ring", "_row", "_from", "_to", "_k")
    order = Window.partitionBy("shape_id", "res", "_ring", "_row").orderBy("_from", "_k")
    paired = nodes.withColumn("_n", F.row_number().over(order)).withColumn("_end", F.lead("_to").over(order)).filter("_n % 2 = 1 and _end is not null")
    inside = paired.select("shape_id", "res", F.col("_row").alias("_y"), F.explode(F.expr(f"sequence(_from, greatest(_from, _end), {step})")).alias("_x"))
    cells = rim.unionByName(level).unionByName(inside)
    return cells.select("shape_id", F.col("res").cast("int").alias("res"), _cell(F.col("_y"), F.col("_x"), F.col("res")).alias("cell")).distinct()


def lines(segments: DataFrame) -> DataFrame:
    """(shape_id, res, y1, x1, y2, x2) in units -> coverage: cells that a segment passes through, its end left out where it only touches a border.

    Each column of cells between the ends gets the run of cells between the segment's heights at
    the column's two sides.
    """
    step, low = "shiftleft(1L, 32 - res)", "-shiftleft(1L, 32 - res)"
    turned = segments.select(
        "shape_id", "res",
        F.expr("if(x1 <= x2, y1, y2)").alias("ay"), F.least("x1", "x2").alias("ax"), F.expr("if(x1 <= x2, y2, y1)").alias("by"), F.greatest("x1", "x2").alias("bx"),
    )
    columns = turned.withColumn("_x", F.explode(F.expr(f"sequence(ax & {low}, greatest(ax & {low}, if(bx > ax, bx - 1, bx)), {step})")))
    slope = F.expr("if(bx = ax, 0D, cast(by - ay as double) / cast(bx - ax as double))")
    height = lambda x: F.expr(f"ay + cast(({x} - ax) * _slope as bigint)")
    sides = columns.withColumn("_slope", slope).withColumn("_p", height("greatest(_x, ax)")).withColumn("_q", F.when(F.col("bx") == F.col("ax"), F.col("by")).otherwise(height(f"least(_x + {step} - 1, bx)")))
    # the end itself isn't entered where it lies on a border
    upper = F.expr("greatest(_p, _q) - if(greatest(_p, _q) = greatest(ay, by) and ay <> by and greatest(_p, _q) > least(_p, _q), 1, 0)")
    runs = sides.withColumn("_y", F.explode(F.sequence(F.expr(f"least(_p, _q) & {low}"), F.greatest(F.expr(f"least(_p, _q) & {low}"), upper), F.expr(step))))
    return runs.select("shape_id", F.col("res").cast("int").alias("res"), _cell(F.col("_y"), F.col("_x"), F.col("res")).alias("cell")).distinct()


def stepped_lines(segments: DataFrame) -> DataFrame:
    """(shape_id, res, y1, x1, y2, x2) in units -> coverage: one cell for each step along the longer axis, the one that the segment is in where the step begins."""
    step, low = "shiftleft(1L, 32 - res)", "-shiftleft(1L, 32 - res)"
    axes = segments.withColumn("_steep", F.expr("abs(y2 - y1) > abs(x2 - x1)")).select(
        "shape_id", "res", "_steep", *[F.expr(f"if(_steep, {a}, {b})").alias(c) for a, b, c in (("y1", "x1", "p1"), ("x1", "y1", "q1"), ("y2", "x2", "p2"), ("x2", "y2", "q2"))]
    )
    ahead = axes.selectExpr("shape_id", "res", "_steep", "least(p1, p2) as ap", "if(p1 <= p2, q1, q2) as aq", "greatest(p1, p2) as bp", "if(p1 <= p2, q2, q1) as bq")
    along = ahead.withColumn("_p", F.explode(F.expr(f"sequence(ap & {low}, bp, {step})")))
    at = along.withColumn("_q", F.expr("aq + if(bp = ap, 0L, cast((greatest(_p, ap) - ap) * (cast(bq - aq as double) / cast(bp - ap as double)) as bigint))"))
    cell = _cell(F.expr("if(_steep, _p, _q)"), F.expr("if(_steep, _q, _p)"), F.col("res"))
    return at.select("shape_id", F.col("res").cast("int").alias("res"), cell.alias("cell")).distinct()


def polylines(paths: DataFrame, stepped: bool = False) -> DataFrame:
    """(shape_id, res, vertices array<struct<y, x>>) -> coverage of the segments between them; stepped takes one cell a step only."""
    spread = paths.select("shape_id", "res", F.posexplode("vertices").alias("_k", "_v"))
    after = Window.partitionBy("shape_id", "res").orderBy("_k")
    pairs = spread.withColumn("_w", F.lead("_v").over(after)).filter("_w is not null")
    return (stepped_lines if stepped else lines)(pairs.select("shape_id", "res", F.col("_v.y").alias("y1"), F.col("_v.x").alias("x1"), F.col("_w.y").alias("y2"), F.col("_w.x").alias("x2"))).distinct()


def legs(places: DataFrame, key: str, ts: str, ties: str, seconds: int = 86_400) -> DataFrame:
    """(key, ts, ties, y, x) -> (key, y1, x1, y2, x2): from each place of a key to its next one.

    A key's places are put in order by stretches of time, so that the track of one busy key is sorted by many tasks; the last place of a stretch goes on
    to the first one of the key's next stretch. Places without a time come first.
    """
    part = F.coalesce(F.floor(F.col(ts).cast("timestamp").cast("double") / seconds), F.lit(-(1 << 62)))
    rows = saved(places.select(key, ts, ties, "y", "x", part.alias("_part")))
    inner = Window.partitionBy(key, "_part").orderBy(ts, ties)
    led = rows.withColumn("_to", F.lead(F.struct("y", "x")).over(inner))
    firsts = rows.groupBy(key, "_part").agg(F.min(F.struct(ts, ties, "y", "x")).alias("_first"))
    further = firsts.select(F.col(key).alias("_key"), F.col("_part").alias("_at"), F.lead("_first").over(Window.partitionBy(key).orderBy("_part")).alias("_next"))
    ended = led.filter("_to is null").join(further, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_at")))
    ways = led.filter("_to is not null").select(key, "y", "x", "_to.y", "_to.x").toDF(key, "y1", "x1", "y2", "x2")
    return ways.unionByName(ended.filter("_next is not null").select(key, "y", "x", "_next.y", "_next.x").toDF(key, "y1", "x1", "y2", "x2"))


def resample(paths: DataFrame) -> DataFrame:
    """(shape_id, res, vertices) -> (shape_id, k, y, x): cell centres along a polyline, repeats in a row dropped."""
    spread = paths.select("shape_id", "res", F.posexplode("vertices").alias("k", "_v"))
    cell = _cell(F.col("_v.y"), F.col("_v.x"), F.col("res"))
    before = F.lag("_cell").over(Window.partitionBy("shape_id", "res").orderBy("k"))
    kept = spread.withColumn("_cell", cell).withColumn("_before", before).filter("_before is null or _before <> _cell")
    half = F.expr("if(res >= 32, 0L, shiftleft(1L, 31 - res))")
    return kept.select("shape_id", "k", (codec.y_of(F.col("_cell")) + half).alias("y"), (codec.x_of(F.col("_cell")) + half).alias("x"))


def _fit(ring: tuple[areas.Vertex, ...], res: int) -> int:
    ys, xs = [y for y, _ in ring], [x for _, x in ring]
    return res if res > 0 else resolution.for_polygon((min(ys), min(xs), max(ys), max(xs)), res)


def _rings(spark: SparkSession, shapes: list[tuple[str, int, areas.Area]]) -> DataFrame:
    rows = [(shape_id, _fit(ring, res), list(ring)) for shape_id, res, area in shapes for ring in area.polygons]
    return spark.createDataFrame(rows, RINGS)


def rings_of(defs: DataFrame, text: str = "def") -> DataFrame:
    """A table of areas (shape_id, text, res) -> a row (shape_id, res, ring) for each ring. Tasks read the text; what is null or no area has no ring."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for shape_id, area, res in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for ring in areas.parse_area(area or "").polygons:
                    rows.append({"shape_id": shape_id, "res": _fit(ring, res or 0), "ring": [{"y": y, "x": x} for y, x in ring]})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("shape_id", pa.string()), ("res", pa.int32()), ("ring", pa.list_(pa.struct([("y", pa.int64()), ("x", pa.int64())])))]))

    ship(defs.sparkSession)
    return defs.select(F.col("shape_id").cast("string"), F.col(text).cast("string"), F.col("res").cast("int")).mapInArrow(read, RINGS)


def from_table(defs: DataFrame, text: str = "def") -> DataFrame:
    """(shape_id, text, res) -> coverage of as many areas as there are rows; see definitions for res."""
    return polygons(rings_of(defs, text))


def definitions(spark: SparkSession, defs: list[tuple[str, str, int]]) -> DataFrame:
    """(shape_id, area text, res) -> coverage. A resolution of 0 or less is chosen for the area, finer by that much."""
    return saved(polygons(_rings(spark, [(shape_id, res, areas.parse_area(text)) for shape_id, text, res in defs])))


#: Cells of a rectangle that are worked out on the driver at most.
LITERAL_CELLS = 1 << 16


def rectangle_tree(low: areas.Vertex, high: areas.Vertex, res: int) -> list[tuple[int, int]]:
    """(resolution, code) of the fewest cells down to `res` that hold a rectangle of units, both corners in it; their number goes with its rim."""
    step = 1 << (32 - res)
    south, west, north, east = low[0] // step * step, low[1] // step * step, high[0] // step * step + step, high[1] // step * step + step
    found, open_cells = [], [(0, 0, 0)]
    while open_cells:
        r, y, x = open_cells.pop()
        s = 1 << (32 - r)
        if y >= north or y + s <= south or x >= east or x + s <= west:
            continue
        if r and south <= y and y + s <= north and west <= x and x + s <= east:
            found.append((r, codec.interleave(y, x)))
        else:
            open_cells += [(r + 2, y + s // 4 * a, x + s // 4 * b) for a in range(4) for b in range(4)]
    return found


def compact(spark: SparkSession, defs: list[tuple[str, str, int]]) -> DataFrame:
    """As optimize(definitions(...)): the fewest cells for areas given by text. Rectangles with a bounded rim become a table of literals, without a job of their own."""
    from quadrille.operators import coverage as cov

    parsed = [(shape_id, areas.parse_area(text), res) for shape_id, text, res in defs]
    simple = [a.kind == "rect" and res > 0 and len({s for s, _, _ in defs}) == len(defs) for _, a, res in parsed]
    corners = [(min(a.polygons[0]), max(a.polygons[0])) if ok else None for ok, (_, a, _) in zip(simple, parsed, strict=True)]
    rims = sum(2 * (sum(h - l for l, h in zip(*c, strict=True)) >> (32 - res)) + 4 for c, (_, _, res) in zip(corners, parsed, strict=True) if c)
    if not all(simple) or rims > LITERAL_CELLS or any(c[1][1] >= codec.UNITS for c in corners):
        return cov.optimize(definitions(spark, defs))
    rows = [(shape_id, r, codec.signed(code)) for (shape_id, _, res), (low, high) in zip(parsed, corners, strict=True) for r, code in rectangle_tree(low, high, res)]
    return spark.createDataFrame(rows, COVERAGE)


def clip(coverage: DataFrame, cells: DataFrame, exclude: bool = False) -> DataFrame:
    """Cells of a coverage that lie in one of `cells` (res, cell), or with exclude those that don't. Clip cells finer than the coverage don't count."""
    from quadrille.operators.coverage import levels_of, with_ancestors

    inside = with_ancestors(coverage, own=True, levels=levels_of(cells)).join(cells.select(F.col("res").alias("_ares"), F.col("cell").alias("_acell")).distinct(), ["_ares", "_acell"], "left_semi")
    return coverage.join(inside.select("shape_id", "res", "cell").distinct(), ["shape_id", "res", "cell"], "left_anti" if exclude else "left_semi")
