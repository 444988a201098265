"""Outlines of coverages, and KML and GeoJSON text.

The rim of a coverage is what remains of its cells' sides when sides that two cells share cancel out. Sides are intervals on
grid lines: a cell adds one to the sum along a line where its side begins and takes it off where it ends, with the sign of
the way around the cell, so what is left where the sum isn't 0 are whole stretches between corners, however coarse or fine the
cells are. Each stretch is followed by the one that begins where it ends; where two corners meet, by the one to
the left, so that rings don't cross. Rings are told by pointer doubling over all shapes at once: each stretch learns the least stretch
ahead of it and the steps to it, twice as far each round. Rings are closed, counter-clockwise outside and clockwise around holes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions import codec
from quadrille.operators import coverage as cov
from quadrille.operators.graph import saved

#: Ways of a stretch: east, north, west, south.
EAST, NORTH, WEST, SOUTH = range(4)


def rim(coverage: DataFrame) -> DataFrame:
    """(shape_id, vertical, line, low, high, way): stretches that bound the shape, way 1 where the inside is on the left going up the line, else -1.

    Rows follow the cells' sides, not their length; a line of a shape is sorted as one group.
    """
    rows = cov.dedup(coverage).withColumn("s", F.expr("shiftleft(1L, 32 - res)"))
    rows = rows.withColumn("y", codec.y_of(F.col("cell"))).withColumn("x", codec.x_of(F.col("cell")))
    ends = F.expr(
        """array(
        struct(false as vertical, y as line, x as at, 1 as d), struct(false as vertical, y as line, x + s as at, -1 as d),
        struct(false as vertical, y + s as line, x as at, -1 as d), struct(false as vertical, y + s as line, x + s as at, 1 as d),
        struct(true as vertical, x + s as line, y as at, 1 as d), struct(true as vertical, x + s as line, y + s as at, -1 as d),
        struct(true as vertical, x as line, y as at, -1 as d), struct(true as vertical, x as line, y + s as at, 1 as d))"""
    )
    changes = rows.select("shape_id", F.inline(ends)).groupBy("shape_id", "vertical", "line", "at").agg(F.sum("d").alias("d")).filter("d <> 0")
    along = Window.partitionBy("shape_id", "vertical", "line").orderBy("at")
    summed = changes.withColumn("way", F.sum("d").over(along.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).withColumn("high", F.lead("at").over(along))
    return summed.filter("way <> 0").select("shape_id", "vertical", "line", F.col("at").alias("low"), "high", "way")


def rim_units(coverage: DataFrame) -> DataFrame:
    """(shape_id, y, x, vertical, way): the rim cut into sides of the shape's finest cell."""
    step = coverage.groupBy("shape_id").agg(F.expr("shiftleft(1L, 32 - max(res))").alias("step"))
    cut = rim(coverage).join(step, "shape_id").withColumn("at", F.explode(F.expr("sequence(low, high - step, step)")))
    return cut.select("shape_id", F.expr("if(vertical, at, line)").alias("y"), F.expr("if(vertical, line, at)").alias("x"), "vertical", F.col("way").cast("bigint").alias("way"))


def ring_sides(coverage: DataFrame) -> DataFrame:
    """(shape_id, ring_y, ring_x, ahead, y, x, way): each stretch of the rim with its ring.

    A ring is named by its least corner; ahead is the number of stretches to the one that begins there. (y, x) is where the stretch begins, way is one of EAST, NORTH, WEST, SOUTH.
    """
    stretches = rim(coverage).select(
        "shape_id",
        F.expr("if(vertical, if(way > 0, low, high), line)").alias("y"), F.expr("if(vertical, line, if(way > 0, low, high))").alias("x"),
        F.expr("if(vertical, if(way > 0, high, low), line)").alias("to_y"), F.expr("if(vertical, line, if(way > 0, high, low))").alias("to_x"),
        F.expr(f"if(vertical, if(way > 0, {NORTH}, {SOUTH}), if(way > 0, {EAST}, {WEST}))").alias("way"),
    )
    sides = saved(stretches)
    # a corner is left by two stretches at most
    leaving = sides.groupBy("shape_id", F.col("y").alias("to_y"), F.col("x").alias("to_x")).agg(F.collect_set("way").alias("ways"))
    left, right = (F.col("way") + 1) % 4, (F.col("way") + 3) % 4
    turned = sides.join(leaving, ["shape_id", "to_y", "to_x"]).withColumn("turn", F.when(F.array_contains("ways", left), left).otherwise(right))
    name = lambda x, way: F.col(x) * 4 + F.col(way)
    at = saved(turned.select("shape_id", "y", name("x", "way").alias("xw"), F.col("to_y").alias("ny"), name("to_x", "turn").alias("nxw"), F.struct("y", name("x", "way").alias("xw")).alias("least"), F.lit(0).cast("bigint").alias("ahead")))
    reach = 1
    while True:
        there = at.select("shape_id", F.col("y").alias("ny"), F.col("xw").alias("nxw"), F.col("ny").alias("_y"), F.col("nxw").alias("_xw"), F.col("least").alias("_least"), F.col("ahead").alias("_ahead"))
        better = F.col("_least") < F.col("least")
        moved = at.join(there, ["shape_id", "ny", "nxw"]).select(
            "shape_id", "y", "xw", F.col("_y").alias("ny"), F.col("_xw").alias("nxw"), better.alias("better"),
            F.when(better, F.col("_least")).otherwise(F.col("least")).alias("least"), F.when(better, F.col("_ahead") + reach).otherwise(F.col("ahead")).alias("ahead"),
        )
        moved = saved(moved)
        done = moved.filter("better").isEmpty()  # then all stretches of a ring have seen all of it
        at, reach = moved.drop("better"), reach * 2
        if done:
            break
    x, way = F.floor(F.col("xw") / 4).cast("bigint"), (F.col("xw") % 4).cast("int")
    return at.select("shape_id", F.col("least.y").alias("ring_y"), F.floor(F.col("least.xw") / 4).cast("bigint").alias("ring_x"), "ahead", "y", x.alias("x"), way.alias("way"))


def envelope(coverage: DataFrame) -> DataFrame:
    """Rings of each shape: shape_id, ring ("y:x" of the least corner), outer, area in square degrees (negative for holes), points array<struct<lat, lon>>."""
    exact = "decimal(20,0)"
    rings = ring_sides(coverage).groupBy("shape_id", "ring_y", "ring_x").agg(
        F.array_sort(F.collect_list(F.struct(F.when(F.col("ahead") == 0, F.lit(-(1 << 62))).otherwise(-F.col("ahead")).alias("turn"), "y", "x", "way"))).alias("corners")
    )
    # x times the way north, over the sides that go north or south; each ends where the next one begins
    n = F.size("corners")
    nxt = lambda k: F.get("corners", (k + 1) % n)
    terms = F.transform("corners", lambda c, k: c["x"].cast(exact) * (nxt(k)["y"] - c["y"]).cast(exact))
    area = F.aggregate(terms, F.lit(0).cast("decimal(38,0)"), lambda a, b: (a + b).cast("decimal(38,0)")).cast("double") * (codec.LAT_UNIT * codec.LON_UNIT)
    points = F.transform("corners", lambda c: F.struct(codec.units_to_lat(c["y"]).alias("lat"), codec.units_to_lon(c["x"]).alias("lon")))
    named = rings.select("shape_id", F.concat_ws(":", F.col("ring_y").cast("string"), F.col("ring_x").cast("string")).alias("ring"), area.alias("area"), F.concat(points, F.slice(points, 1, 1)).alias("points"))
    return named.select("shape_id", "ring", (F.col("area") > 0).alias("outer"), "area", "points")


def geojson(coverage: DataFrame) -> DataFrame:
    """shape_id and a MultiPolygon: a polygon for each cluster of cells, its holes after its outline."""
    parts = cov.clusters(coverage)
    named = parts.select(F.concat_ws("\u0001", "shape_id", "cluster").alias("shape_id"), "res", "cell")
    rings = envelope(named)
    pair = F.transform("points", lambda p: F.array(p["lon"], p["lat"]))
    sorted_rings = F.transform(F.array_sort(F.collect_list(F.struct((~F.col("outer")).alias("hole"), (-F.abs("area")).alias("size"), pair.alias("ring")))), lambda r: r["ring"])
    polygons = rings.groupBy("shape_id").agg(sorted_rings.alias("polygon"))
    split = polygons.select(F.split("shape_id", "\u0001")[0].alias("shape_id"), F.split("shape_id", "\u0001")[1].alias("cluster"), "polygon")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("cluster", "polygon"))), lambda p: p["polygon"])
    return split.groupBy("shape_id").agg(F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), ordered.alias("coordinates"))).alias("geojson"))


def _coordinates(points: Column) -> Column:
    return F.array_join(F.transform(points, lambda p: F.concat_ws(",", p["lon"].cast("string"), p["lat"].cast("string"))), " ")


def _box(res: Column, cell: Column) -> Column:
    step = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(32) - res)
    y, x = codec.y_of(cell), codec.x_of(cell)
    corner = lambda a, b: F.struct(codec.units_to_lat(y + a).alias("lat"), codec.units_to_lon(x + b).alias("lon"))
    zero = F.lit(0).cast("long")
    return F.array(corner(zero, zero), corner(zero, step), corner(step, step), corner(step, zero), corner(zero, zero))


HEAD = '<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>'
TAIL = "</Document></kml>"


def kml_cells(coverage: DataFrame) -> DataFrame:
    """(shape_id, kml): a placemark for each cell, as rows of text; see kml_document for whole files."""
    name = cov.hex_of(F.col("res"), F.col("cell"))
    body = F.concat(
        F.lit("<Placemark><name>"), name, F.lit("</name><Polygon><outerBoundaryIs><LinearRing><coordinates>"),
        _coordinates(_box(F.col("res"), F.col("cell"))), F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"),
    )
    return coverage.select("shape_id", name.alias("key"), body.alias("kml"))


def kml_envelope(coverage: DataFrame) -> DataFrame:
    """(shape_id, key, kml): a placemark for each ring of the outline."""
    body = F.concat(F.lit("<Placemark><LineString><coordinates>"), _coordinates(F.col("points")), F.lit("</coordinates></LineString></Placemark>"))
    place = F.split("ring", ":")
    return envelope(coverage).select("shape_id", F.concat(F.lpad(place[0], 10, "0"), F.lpad(place[1], 10, "0")).alias("key"), body.alias("kml"))


def kml_document(placemarks: DataFrame) -> DataFrame:
    """shape_id and its placemarks as one document."""
    inner = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "kml"))), lambda p: p["kml"]), "")
    return placemarks.groupBy("shape_id").agg(F.concat(F.lit(HEAD), inner, F.lit(TAIL)).alias("kml"))
