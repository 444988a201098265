"""Registered queries of the grid engine and the SQL that checks them.

The tables have no coordinates; points are made from the ids of events by a fixed formula, in both
engines. The SQL works on hex digits and whole numbers of its own making, not on the engine's codes.
"""

from __future__ import annotations

import contextlib
import math
import uuid
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import codec, densify, geohash, hierarchy, measure, resolution, sql_names, sql_tables
from quadrille.operators import bloom, centroid, cover, descend, expressions, match, render
from quadrille.operators import coverage as cov
from quadrille.operators.graph import saved
from quadrille.plans import areas
from quadrille.sources import points as sources
from quadrille.sources import shards, wkt
from quadrille.streaming import activity, index

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with SQL for the same rows."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.of_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def shape(spark: SparkSession, *defs: tuple[str, str, int]) -> DataFrame:
    return cover.definitions(spark, list(defs))


# --- SQL parts -----------------------------------------------------------------------------------

DIGIT = "substr('0123456789abcdef', 1 + {0}, 1)"
#: Hex digit i of y and x: two bits of each, y's first.
_BITS = "CAST(8*(({y} >> (31-2*i)) & 1) + 4*(({x} >> (31-2*i)) & 1) + 2*(({y} >> (30-2*i)) & 1) + (({x} >> (30-2*i)) & 1) AS BIGINT)"


def sql_hex(y: str = "y", x: str = "x", digits: int = 16) -> str:
    return f"array_to_string(list_transform(range({digits}), lambda i: {DIGIT.format(_BITS.format(y=y, x=x))}), '')"


SQL_POINTS = f"""pts AS (
  SELECT *, {sql_hex()} AS hex FROM (
    SELECT *, CAST(floor((lat + 90) / (180e0 / 4294967296)) AS BIGINT) AS y, CAST(floor((lon + 180) / (360e0 / 4294967296)) AS BIGINT) AS x FROM (
      SELECT *, ((event_id * 7919) % 170001) / 1e3 - 85e0 AS lat, ((user_id * 104729 + event_id * 31) % 360000) / 1e3 - 180e0 AS lon FROM events)))"""


def sql_cell(digits: str) -> str:
    """y and x of the south-west corner of a cell given by hex digits."""
    value = f"(strpos('0123456789abcdef', substr({digits}, i + 1, 1)) - 1)"
    of = lambda high, low: f"CAST(coalesce(list_sum(list_transform(range(length({digits})), lambda i: ((({value} >> {high}) & 1) << (31-2*i)) + ((({value} >> {low}) & 1) << (30-2*i)))), 0) AS BIGINT)"
    return f"{of(3, 1)} AS cy, {of(2, 0)} AS cx"


def sql_with(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts) + " "


def sql_region(name: str, res: int, low: float, left: float, high: float, right: float) -> str:
    """The cells of a rectangle as a CTE of hex digits."""
    step = 1 << (32 - res)
    ys = tuple(math.floor((v + 90) / 180 * 2**32) // step for v in (low, high))
    xs = tuple(math.floor((v + 180) / 360 * 2**32) // step for v in (left, right))
    return (
        f"{name} AS (SELECT {sql_hex('y', 'x', res // 2)} AS hex FROM (SELECT a.v * {step} AS y, ((b.v * {step}) & 4294967295) AS x "
        f"FROM range({ys[0]}, {ys[1] + 1}) a(v), range({xs[0]}, {xs[1] + 1}) b(v)))"
    )


# --- points --------------------------------------------------------------------------------------


@query(sql_with(SQL_POINTS) + "SELECT event_id, lat, lon, hex FROM pts")
def point_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("event_id", "lat", "lon", "hex")


@query(sql_with(SQL_POINTS) + "SELECT event_id, y, x, round(y * (180e0/4294967296) - 90, 6) AS lat, round(x * (360e0/4294967296) - 180, 6) AS lon FROM pts")
def point_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    units, degrees = codec.decode_units(F.col("hh")), codec.decode(F.col("hh"))
    return points(spark, sf_dir).select(
        "event_id", units["y"].alias("y"), units["x"].alias("x"), F.round(degrees["lat"], 6).alias("lat"), F.round(degrees["lon"], 6).alias("lon")
    )


@query(sql_with(SQL_POINTS) + "SELECT substr(hex, 1, 4) AS hex, count(*) AS points FROM pts GROUP BY 1")
def hex_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid.density(points(spark, sf_dir), 8)


@query(sql_with(SQL_POINTS) + "SELECT event_id, array_to_string(list_transform(range(1, 16), lambda i: substr(hex, 1, i)), ' ') AS index_text FROM pts")
def index_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("event_id", hierarchy.index_text(F.col("hh")).alias("index_text"))


@query(sql_with(SQL_POINTS) + "SELECT event_id, '5' || substr(hex, 1, 5) || '0000000000' AS geocell, '4' || substr(hex, 1, 4) || '00000000000' AS parent FROM pts")
def geocell(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = hierarchy.geocell(F.col("hh"), 10)
    return points(spark, sf_dir).select("event_id", codec.to_hex(cell).alias("geocell"), codec.to_hex(hierarchy.geocell_parent(cell)).alias("parent"))


@query(sql_with(SQL_POINTS) + "SELECT DISTINCT substr(hex, 1, 5) AS cell, substr(hex, 1, 4) AS parent FROM pts")
def parent_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = codec.to_hex(F.col("hh"), 10)
    return points(spark, sf_dir).select(cell.alias("cell"), hierarchy.parent_hex(cell).alias("parent")).distinct()


@query(sql_with(SQL_POINTS) + f"SELECT cell, cell || {DIGIT.format('d')} AS child FROM (SELECT DISTINCT substr(hex, 1, 3) AS cell FROM pts), range(16) r(d)")
def child_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = points(spark, sf_dir).select(codec.to_hex(F.col("hh"), 6).alias("cell")).distinct()
    return cells.select("cell", F.explode(hierarchy.children(F.col("cell"))).alias("child"))


_WRAP = "SELECT event_id, d, CASE WHEN (ny >> 32) & 1 = 1 THEN xor(ny, 4294967295) ELSE ny END & 4294967295 AS y, CASE WHEN (ny >> 32) & 1 = 1 THEN xor(nx, 2147483648) ELSE nx END & 4294967295 AS x"
_MOVES = ", ".join(f"('{d}', {n}, {e})" for d, (n, e) in hierarchy.DIRECTIONS.items())


@query(
    sql_with(SQL_POINTS, f"moved AS ({_WRAP} FROM (SELECT event_id, d, ((y >> 20) << 20) + n * 1048576 AS ny, ((x >> 20) << 20) + e * 1048576 AS nx FROM pts, (VALUES {_MOVES}) m(d, n, e)))")
    + f"SELECT event_id, d AS direction, {sql_hex(digits=6)} AS hex FROM moved"
)
def neighbours_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    around = F.array(*[F.struct(F.lit(d).alias("direction"), codec.to_hex(hierarchy.neighbour(F.col("hh"), 12, d), 12).alias("hex")) for d in hierarchy.DIRECTIONS])
    return points(spark, sf_dir).select("event_id", F.inline(around))


@query(sql_with(SQL_POINTS) + "SELECT event_id, substr(hex, 1, 4) || 'c00000000000' AS center, ((y >> 24) << 24) + 8388608 AS y, ((x >> 24) << 24) + 8388608 AS x FROM pts")
def cell_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = codec.center_units(F.col("hh"), 8)
    return points(spark, sf_dir).select("event_id", F.substring(codec.to_hex(codec.center(F.col("hh"), 8)), 1, 16).alias("center"), units["y"].alias("y"), units["x"].alias("x"))


@query(
    sql_with(SQL_POINTS)
    + "SELECT DISTINCT substr(hex, 1, 4) AS hex, round(((y >> 24) << 24) * (180e0/4294967296) - 90, 6) + 0e0 AS swlat, round(((x >> 24) << 24) * (360e0/4294967296) - 180, 6) + 0e0 AS swlon, "
    "round((((y >> 24) << 24) + 16777215) * (180e0/4294967296) - 90, 6) + 0e0 AS nelat, round((((x >> 24) << 24) + 16777215) * (360e0/4294967296) - 180, 6) + 0e0 AS nelon FROM pts"
)
def cell_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = codec.cell_bbox(F.col("hh"), 8)
    return points(spark, sf_dir).select(codec.to_hex(F.col("hh"), 8).alias("hex"), *[(F.round(box[c], 6) + 0.0).alias(c) for c in ("swlat", "swlon", "nelat", "nelon")]).distinct()


@query(sql_with(SQL_POINTS) + "SELECT event_id, substr(hex, 1, 7) || '0' AS packed FROM pts")
def packed_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("event_id", F.lower(F.hex(codec.packed_bytes(F.col("hh"), 14))).alias("packed"))


@query(sql_with(SQL_POINTS) + "SELECT event_type, min(y) AS swy, min(x) AS swx, max(y) AS ney, max(x) AS nex FROM pts GROUP BY 1")
def points_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.bbox_of_codes(points(spark, sf_dir), ["event_type"])


# --- measures ------------------------------------------------------------------------------------

_PARIS = (48.8566, 2.3522)


def _paris() -> tuple:
    return F.lit(_PARIS[0]), F.lit(_PARIS[1])


@query(
    sql_with(SQL_POINTS) + f"""SELECT event_id, round(degrees(2 * asin(least(1e0, sqrt(pow(sin((radians({_PARIS[0]}e0) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians({_PARIS[0]}e0)) *
    pow(sin(radians({_PARIS[1]}e0 - lon) / 2), 2))))) * 111120e0, 2) AS metres FROM pts"""
)
def great_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("event_id", F.round(measure.great_circle_degrees(F.col("lat"), F.col("lon"), *_paris()), 2).alias("metres"))


@query(
    sql_with(SQL_POINTS) + """SELECT event_id, round(sqrt(pow((3221225472 - y) * (180e0/4294967296), 2) + pow((CASE WHEN abs(2147483648 - x) > 2147483648 THEN 4294967295 - abs(2147483648 - x) ELSE abs(2147483648 - x) END)
    * (360e0/4294967296) * cos(radians((y * (180e0/4294967296) - 90 + 45) / 2)), 2)) * 111120e0, 2) AS metres FROM pts"""
)
def mean_lat_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = codec.long(codec.interleave(3221225472, 2147483648))
    return points(spark, sf_dir).select("event_id", F.round(measure.mean_latitude_distance(F.col("hh"), there), 2).alias("metres"))


@query(
    sql_with(SQL_POINTS) + f"""SELECT event_id, round(acos(least(1e0, greatest(-1e0, sin(radians(lat)) * sin(radians({_PARIS[0]}e0)) + cos(radians(lat)) * cos(radians({_PARIS[0]}e0)) *
    cos(radians({_PARIS[1]}e0 - lon))))), 6) AS angle FROM pts"""
)
def law_of_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("event_id", F.round(measure.law_of_cosines(F.col("lat"), F.col("lon"), *_paris()), 6).alias("angle"))


@query(
    sql_with(SQL_POINTS) + """SELECT event_id, CAST(floor(131072e0 + lon * (262144e0 / 360)) AS BIGINT) AS px,
    CAST(floor(131072e0 - 0.5e0 * ln((1 + s) / (1 - s)) * (262144e0 / (2 * pi()))) AS BIGINT) AS py FROM (SELECT *, greatest(-0.9999e0, least(0.9999e0, sin(radians(lat)))) AS s FROM pts)"""
)
def mercator_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixel = measure.mercator_xy(F.col("lat"), F.col("lon"), 10)
    return points(spark, sf_dir).select("event_id", pixel["x"].alias("px"), pixel["y"].alias("py"))


@query(sql_with(SQL_POINTS) + "SELECT event_id, CAST(round(4294967296 / (360 * 111120e0) / cos(radians(y * (180e0/4294967296) - 90))) AS BIGINT) AS per_metre FROM pts")
def scale_at_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("event_id", measure.scale(F.col("hh"))["x"].alias("per_metre"))


@query(
    sql_with(SQL_POINTS) + f"""SELECT event_id, CASE WHEN one THEN round(degrees(atan2(z, sqrt(u * u + v * v))), 4) END AS lat, CASE WHEN one THEN round(degrees(atan2(v, u)), 4) END AS lon FROM (
    SELECT event_id, abs({_PARIS[1]}e0 - lon) < 180 AS one, cos(radians(lat)) * cos(radians(lon)) + cos(radians({_PARIS[0]}e0)) * cos(radians({_PARIS[1]}e0)) AS u,
    cos(radians(lat)) * sin(radians(lon)) + cos(radians({_PARIS[0]}e0)) * sin(radians({_PARIS[1]}e0)) AS v, sin(radians(lat)) + sin(radians({_PARIS[0]}e0)) AS z FROM pts)"""
)
def great_circle_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle of each event's way to one place; null where the longitudes are 180 degrees or more apart."""
    middle = measure.intermediate(F.col("lat"), F.col("lon"), *_paris(), F.lit(0.5))
    return points(spark, sf_dir).withColumn("m", middle).select("event_id", F.round("m.lat", 4).alias("lat"), F.round("m.lon", 4).alias("lon"))


@query(sql_with(SQL_POINTS) + "SELECT event_id, round(degrees(2 * atan(exp((131072e0 - py) / (262144e0 / (2 * pi())))) - pi() / 2), 6) AS lat, round((px - 131072e0) / (262144e0 / 360), 6) AS lon FROM (SELECT event_id, (event_id * 7919) % 262144 AS px, (user_id * 104729) % 262144 AS py FROM pts)")
def mercator_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = measure.mercator_latlon((F.col("event_id") * 7919) % 262144, (F.col("user_id") * 104729) % 262144, 10)
    return points(spark, sf_dir).withColumn("p", place).select("event_id", F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"))


@query(sql_with(SQL_POINTS) + "SELECT event_id, round(sqrt(pow((3221225472 - y) / (4294967296 / (180 * 111120e0)), 2) + pow((2147483648 - x) * cos(radians(y * (180e0/4294967296) - 90)) / (4294967296 / (360 * 111120e0)), 2)) / 1000, 4) AS km FROM pts")
def flat_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = codec.long(codec.interleave(3221225472, 2147483648))
    return points(spark, sf_dir).select("event_id", F.round(F.sqrt(measure.squared_distance_exact(F.col("hh"), there)) / 1000, 4).alias("km"))


@query(sql_with(SQL_POINTS) + f"SELECT event_id, {sql_hex('y2', 'x2')} AS hex FROM (SELECT event_id, (y * 3 + 3221225472) // 4 AS y2, (x * 3 + 2147483648) // 4 AS x2 FROM pts)")
def weighted_mean_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = codec.long(codec.interleave(3221225472, 2147483648))
    return points(spark, sf_dir).select("event_id", codec.to_hex(measure.weighted_centroid(F.col("hh"), F.lit(3), there, F.lit(1))).alias("hex"))


@query(sql_with(SQL_POINTS) + "SELECT event_id, hex, hex AS again, round(((y >> 22) + 0.5e0) * 4194304 * (180e0/4294967296) - 90, 6) AS lat, round(((x >> 22) + 0.5e0) * 4194304 * (360e0/4294967296) - 180, 6) AS lon FROM pts")
def codes_there_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes from text and from bytes, and centres of cells in degrees."""
    center = codec.center_degrees(F.col("hh"), 10)
    read = points(spark, sf_dir).withColumn("c", center)
    return read.select(
        "event_id", codec.to_hex(codec.from_hex(codec.to_hex(F.col("hh")))).alias("hex"), codec.to_hex(codec.from_bytes(codec.to_bytes(F.col("hh")))).alias("again"),
        F.round("c.lat", 6).alias("lat"), F.round("c.lon", 6).alias("lon"),
    )


@query(
    sql_with(SQL_POINTS) + f"""SELECT event_id, hex, substr(hex, 1, 6) AS cell, round(y * (180e0/4294967296) - 90, 6) AS lat, round(x * (360e0/4294967296) - 180, 6) AS lon,
    round(degrees(2 * asin(least(1e0, sqrt(pow(sin((radians({_PARIS[0]}e0) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians({_PARIS[0]}e0)) * pow(sin(radians({_PARIS[1]}e0 - lon) / 2), 2))))) * 111120e0, 2) AS metres FROM pts"""
)
def functions_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid's functions called by their names in SQL."""
    sql_names.register(spark)
    coded = points(spark, sf_dir).selectExpr("event_id", "lat", "lon", "grid_code(lat, lon) as code")
    return coded.selectExpr(
        "event_id", "grid_hex(code, 32) as hex", "grid_hex(grid_cell(code, 12), 12) as cell", "round(grid_lat(code), 6) as lat", "round(grid_lon(code), 6) as lon",
        f"round(grid_metres(lat, lon, {_PARIS[0]}D, {_PARIS[1]}D), 2) as metres",
    )


@query(sql_with(SQL_POINTS) + f"SELECT event_id, {sql_hex()} AS hex FROM pts")
def codes_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes from places written as lat:lon."""
    told = F.concat_ws(":", F.col("lat").cast("string"), F.col("lon").cast("string"))
    return points(spark, sf_dir).select("event_id", codec.to_hex(codec.encode_text(told)).alias("hex"))


@query(sql_with(SQL_POINTS) + "SELECT event_id, list_transform(range(1, 16), lambda i: substr('0123456789abcdef', CAST(i + 1 AS BIGINT), 1) || rpad(substr(hex, 1, CAST(i AS BIGINT)), 15, '0')) AS cells FROM pts")
def ancestor_geocells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All geocells around each event, from coarse to fine, as digits."""
    return points(spark, sf_dir).select("event_id", F.transform(hierarchy.ancestors(F.col("hh")), lambda c: codec.to_hex(c)).alias("cells"))


_AROUND = ", ".join(f"({k}, {y}, {x})" for k, (y, x) in enumerate(((0, 0), (0, 1), (1, 1), (1, 0), (0, 0))))


@query(
    sql_with(SQL_POINTS, "cells AS (SELECT DISTINCT substr(hex, 1, 4) AS hex, (y >> 24) AS cy, (x >> 24) AS cx FROM pts)")
    + f"SELECT hex, k, round((cy + dy) * 16777216 * (180e0/4294967296) - 90, 6) + 0e0 AS lat, round((cx + dx) * 16777216 * (360e0/4294967296) - 180, 6) + 0e0 AS lon FROM cells, (VALUES {_AROUND}) r(k, dy, dx)"
)
def cell_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closed outlines of single cells."""
    cells = points(spark, sf_dir).select(codec.at_resolution(F.col("hh"), 8).alias("cell")).distinct()
    return cells.select(codec.to_hex(F.col("cell"), 8).alias("hex"), F.posexplode(hierarchy.cell_ring(F.col("cell"), 8)).alias("k", "p")).select("hex", "k", (F.round("p.lat", 6) + 0.0).alias("lat"), (F.round("p.lon", 6) + 0.0).alias("lon"))


# --- roll-ups ------------------------------------------------------------------------------------


@query(sql_with(SQL_POINTS) + "SELECT substr(hex, 1, CAST(n AS BIGINT)) AS hex, CAST(count(*) AS BIGINT) AS points FROM pts, range(1, 7) r(n) GROUP BY 1")
def density_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid.density_by_levels(points(spark, sf_dir), 12)


@query(sql_with(SQL_POINTS) + "SELECT substr(hex, 1, CAST(n AS BIGINT)) AS hex, count(DISTINCT user_id) AS documents FROM pts, range(1, 7) r(n) GROUP BY 1")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid.document_frequency(points(spark, sf_dir), "user_id")


@query(sql_with(SQL_POINTS) + "SELECT substr(hex, 1, 1) AS a, substr(hex, 2, 1) AS b, count(*) AS points FROM pts GROUP BY ROLLUP (1, 2)")
def rollup_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select(F.substring("hex", 1, 1).alias("a"), F.substring("hex", 2, 1).alias("b")).rollup("a", "b").agg(F.count(F.lit(1)).alias("points"))


@query(
    sql_with(SQL_POINTS, "means AS (SELECT substr(hex, 1, CAST(n AS BIGINT)) AS cell, count(*) AS points, CAST(floor(sum(y) / count(*)) AS BIGINT) AS y, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x, list_sort(list(hex)) AS all_hex FROM pts, range(1, 6) r(n) GROUP BY 1)")
    + f"SELECT cell AS hex, points, {sql_hex()} AS centroid, CASE WHEN points <= 3 THEN array_to_string(all_hex, ' ') END AS markers FROM means"
)
def centroid_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroid.rollup(points(spark, sf_dir), 2, 10, threshold=3)
    return found.select("hex", "points", "centroid", F.when(F.col("markers").isNotNull(), F.array_join("markers", " ")).alias("markers"))


@query(sql_with(SQL_POINTS) + "SELECT substr(hex, 1, 3) AS hex, count(*) AS points FROM pts GROUP BY 1 ORDER BY points DESC, hex LIMIT 20")
def topk_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid.density(points(spark, sf_dir), 6).orderBy(F.col("points").desc(), "hex").limit(20)


# --- areas over points ---------------------------------------------------------------------------

WEST = ("west", "rect:43.0:-5.5,51.2:6.1", 12)
EAST = ("east", "rect:40.0:0.5,60.0:40.0", 10)
_WEST = sql_region("west", 12, 43.0, -5.5, 51.2, 6.1)
_EAST = sql_region("east", 10, 40.0, 0.5, 60.0, 40.0)


@query(sql_with(SQL_POINTS, _WEST) + "SELECT substr(p.hex, 1, 3) AS hex, count(*) AS points FROM pts p JOIN west w ON substr(p.hex, 1, 6) = w.hex GROUP BY 1")
def point_in_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid.density(match.semi_join(points(spark, sf_dir), cover.compact(spark, [WEST])), 6)


@query(sql_with(SQL_POINTS, _WEST) + "SELECT event_id FROM pts WHERE substr(hex, 1, 6) IN (SELECT hex FROM west)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.semi_join(points(spark, sf_dir), shape(spark, WEST)).select("event_id")


@query(sql_with(SQL_POINTS, _WEST) + "SELECT event_id FROM pts WHERE substr(hex, 1, 6) NOT IN (SELECT hex FROM west)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.anti_join(points(spark, sf_dir), cov.optimize(shape(spark, WEST))).select("event_id")


@query(
    sql_with(SQL_POINTS, _WEST, _EAST)
    + "SELECT event_id, 'west' AS shape_id FROM pts WHERE substr(hex, 1, 6) IN (SELECT hex FROM west) UNION ALL SELECT event_id, 'east' FROM pts WHERE substr(hex, 1, 5) IN (SELECT hex FROM east)"
)
def points_by_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.join_points(points(spark, sf_dir).select("event_id", "hh"), shape(spark, WEST, EAST)).select("event_id", "shape_id")


@query(ORACLES["points_by_shape"])
def points_by_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by binary search in intervals of codes."""
    return match.join_intervals(points(spark, sf_dir).select("event_id", "hh"), cover.compact(spark, [WEST, EAST])).select("event_id", "shape_id")


def _algebra(rule: str) -> str:
    """Points tell what a coverage holds: those in the result of an operation on the two areas."""
    w, e = "substr(hex, 1, 6) IN (SELECT hex FROM west)", "substr(hex, 1, 5) IN (SELECT hex FROM east)"
    return sql_with(SQL_POINTS, _WEST, _EAST) + f"SELECT event_id FROM pts WHERE {rule.format(w=w, e=e)}"


def _two(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    one = lambda d: shape(spark, ("area", *d[1:]))
    return one(WEST), one(EAST)


@query(_algebra("{w} OR {e}"))
def coverage_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.semi_join(points(spark, sf_dir), cov.union(*_two(spark))).select("event_id")


@query(_algebra("{w} AND {e}"))
def coverage_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.semi_join(points(spark, sf_dir), cov.intersect(*_two(spark))).select("event_id")


@query(_algebra("{w} AND NOT {e}"))
def coverage_minus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.semi_join(points(spark, sf_dir), cov.minus(*_two(spark))).select("event_id")


_TERMS = ("rect:43.0:-5.5,51.2:6.1", "rect:40.0:0.5,60.0:40.0", "rect:-20.0:20.0,10.0:50.0", "rect:-10.0:-6.0,60.0:45.0")
_TERM_SQL = [sql_region(f"t{k}", 10, *map(float, t.removeprefix("rect:").replace(",", ":").split(":"))) for k, t in enumerate(_TERMS)]


@query(
    sql_with(SQL_POINTS, *_TERM_SQL)
    + "SELECT event_id FROM pts WHERE ((substr(hex, 1, 5) IN (SELECT hex FROM t0) AND substr(hex, 1, 5) NOT IN (SELECT hex FROM t1)) OR substr(hex, 1, 5) IN (SELECT hex FROM t2)) AND substr(hex, 1, 5) IN (SELECT hex FROM t3)"
)
def area_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All operators in one text, from left to right; a term before the first + doesn't count."""
    text = "-{3} +{0} -{1} +{2} &{3}".format(*_TERMS)
    return match.semi_join(points(spark, sf_dir), expressions.evaluate(spark, text, 10)).select("event_id")


# --- coverages made from points ------------------------------------------------------------------

SQL_SEEN = "seen AS (SELECT DISTINCT event_type AS shape_id, substr(hex, 1, 2) AS hex FROM pts)"


def seen(spark: SparkSession, sf_dir: str, res: int = 4) -> DataFrame:
    """For each event type, the cells that have its events."""
    cell = codec.at_resolution(F.col("hh"), res)
    return points(spark, sf_dir).select(F.col("event_type").alias("shape_id"), F.lit(res).alias("res"), cell.alias("cell")).distinct()


def as_hex(coverage: DataFrame) -> DataFrame:
    return coverage.select("shape_id", cov.hex_of(F.col("res"), F.col("cell")).alias("hex"))


_MIXED = "mixed AS (SELECT DISTINCT event_type AS shape_id, CASE WHEN event_id % 50 = 0 THEN substr(hex, 1, 2) ELSE substr(hex, 1, 3) END AS hex FROM pts)"


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of two resolutions, some inside others."""
    res = F.when(F.col("event_id") % 50 == 0, 4).otherwise(6)
    rows = points(spark, sf_dir).select(F.col("event_type").alias("shape_id"), res.alias("res"), F.col("hh").alias("cell"))
    return cov.align(rows)


@query(sql_with(SQL_POINTS, _MIXED) + "SELECT shape_id, hex FROM mixed m WHERE NOT (length(hex) = 3 AND EXISTS (SELECT 1 FROM mixed u WHERE u.shape_id = m.shape_id AND u.hex = substr(m.hex, 1, 2)))")
def coverage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_hex(cov.dedup(mixed(spark, sf_dir)))


@query(sql_with(SQL_POINTS, _MIXED) + "SELECT event_id FROM pts WHERE substr(hex, 1, 3) IN (SELECT hex FROM mixed WHERE length(hex) = 3)")
def member_at_one_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in cells of one resolution, whatever else a coverage has."""
    return match.semi_join(points(spark, sf_dir), mixed(spark, sf_dir), low=6, high=6).select("event_id")


@query(sql_with(SQL_POINTS, SQL_SEEN) + "SELECT shape_id, hex FROM (SELECT *, count(*) OVER (PARTITION BY shape_id, substr(hex, 1, 1)) AS n FROM seen) WHERE n > 9")
def coverage_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_hex(cov.prune(seen(spark, sf_dir), 0x0900000000000000))


@query(
    sql_with(SQL_POINTS, "fine AS (SELECT DISTINCT event_type AS shape_id, substr(hex, 1, 3) AS hex FROM pts)",
             "up2 AS (SELECT shape_id, substr(hex, 1, 2) AS hex FROM fine GROUP BY 1, 2 HAVING count(*) >= 14)",
             "left3 AS (SELECT * FROM fine f WHERE NOT EXISTS (SELECT 1 FROM up2 u WHERE u.shape_id = f.shape_id AND u.hex = substr(f.hex, 1, 2)))",
             "up1 AS (SELECT shape_id, substr(hex, 1, 1) AS hex FROM up2 GROUP BY 1, 2 HAVING count(*) >= 12)",
             "both_levels AS (SELECT * FROM left3 UNION ALL SELECT * FROM up2 u WHERE NOT EXISTS (SELECT 1 FROM up1 v WHERE v.shape_id = u.shape_id AND v.hex = substr(u.hex, 1, 1)))")
    + "SELECT shape_id, hex FROM both_levels b WHERE NOT EXISTS (SELECT 1 FROM up1 v WHERE v.shape_id = b.shape_id AND v.hex = substr(b.hex, 1, 1)) UNION ALL SELECT * FROM up1"
)
def coverage_optimize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_hex(cov.optimize(seen(spark, sf_dir, 6), 0x0CE0000000000000, max_res=6))


@query(sql_with(SQL_POINTS, _MIXED) + f"SELECT DISTINCT shape_id, CASE WHEN length(hex) = 3 THEN hex ELSE hex || {DIGIT.format('d')} END AS hex FROM mixed, range(16) r(d)")
def coverage_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_hex(cov.normalize(mixed(spark, sf_dir), 6))


@query(sql_with(SQL_POINTS, _MIXED) + "SELECT shape_id, count(*) AS cells, CAST(min(2 * length(hex)) AS INTEGER) AS coarsest, CAST(max(2 * length(hex)) AS INTEGER) AS finest, CAST(sum(pow(2, 64 - 4 * length(hex))) AS DOUBLE) AS area FROM mixed GROUP BY 1")
def coverage_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.summary(mixed(spark, sf_dir)).select("shape_id", "cells", "coarsest", "finest", F.col("area").cast("double").alias("area"))


#: Cells of resolution 4 with more than a few events of their type.
_BUSY = "busy AS (SELECT event_type AS shape_id, substr(hex, 1, 2) AS hex FROM pts GROUP BY 1, 2 HAVING count(*) > 5)"
_FINE = f"fine AS (SELECT DISTINCT shape_id, CASE WHEN length(hex) = 3 THEN hex ELSE hex || {DIGIT.format('d')} END AS hex FROM mixed, range(16) r(d))"
_FINE_BUSY = f"fine_busy AS (SELECT shape_id, hex || {DIGIT.format('d')} AS hex FROM busy, range(16) r(d))"
_TWO = (SQL_POINTS, _MIXED, _BUSY, _FINE, _FINE_BUSY)


def busy(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = codec.at_resolution(F.col("hh"), 4)
    counted = points(spark, sf_dir).groupBy(F.col("event_type").alias("shape_id"), F.lit(4).alias("res"), cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    return counted.filter("n > 5").drop("n")


@query(sql_with(*_TWO) + "SELECT * FROM fine UNION SELECT * FROM fine_busy")
def union_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_hex(cov.normalize(cov.union(mixed(spark, sf_dir), busy(spark, sf_dir)), 6))


@query(sql_with(*_TWO) + "SELECT * FROM fine INTERSECT SELECT * FROM fine_busy")
def intersect_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_hex(cov.normalize(cov.intersect(mixed(spark, sf_dir), busy(spark, sf_dir)), 6))


@query(sql_with(*_TWO) + "SELECT * FROM fine EXCEPT SELECT * FROM fine_busy")
def minus_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_hex(cov.normalize(cov.minus(mixed(spark, sf_dir), busy(spark, sf_dir)), 6))


@query(sql_with(*_TWO) + "SELECT 'minus' AS what, * FROM (SELECT * FROM fine EXCEPT SELECT * FROM fine_busy) UNION ALL SELECT 'both', * FROM (SELECT * FROM fine INTERSECT SELECT * FROM fine_busy)")
def normalized_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference and intersection by taking both sides to one resolution."""
    a, b = mixed(spark, sf_dir), busy(spark, sf_dir)
    left, both = as_hex(cov.minus_normalized(a, b, 6)), as_hex(cov.intersect_normalized(a, b, 6))
    return left.select(F.lit("minus").alias("what"), "shape_id", "hex").unionByName(both.select(F.lit("both").alias("what"), "shape_id", "hex"))


@query(sql_with(*_TWO) + "SELECT 'a' AS side, * FROM fine UNION ALL SELECT 'b', * FROM fine_busy")
def co_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two coverages cover stays the same when their partly shared cells are split."""
    a, b = cov.co_normalize(mixed(spark, sf_dir), busy(spark, sf_dir))
    sides = [as_hex(cov.normalize(c, 6)).select(F.lit(side).alias("side"), "shape_id", "hex") for side, c in (("a", a), ("b", b))]
    return sides[0].unionByName(sides[1])


@query(sql_with(*_TWO) + "SELECT * FROM mixed UNION SELECT * FROM busy")
def merge_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_hex(cov.merge(mixed(spark, sf_dir), busy(spark, sf_dir)))


@query(sql_with(*_TWO) + "SELECT * FROM mixed WHERE substr(hex, 1, 2) IN (SELECT hex FROM busy)")
def clip_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_hex(cover.clip(mixed(spark, sf_dir), busy(spark, sf_dir)))


@query(sql_with(*_TWO) + "SELECT DISTINCT hex FROM busy WHERE hex IN (SELECT hex FROM mixed)")
def present_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that a coverage has at their very resolution."""
    return match.has_cell(mixed(spark, sf_dir), busy(spark, sf_dir).select("res", "cell").distinct()).select(cov.hex_of(F.col("res"), F.col("cell")).alias("hex"))


@query(sql_with(SQL_POINTS) + "SELECT DISTINCT event_type AS shape_id, substr(hex, 1, 3) AS hex FROM pts")
def serialized_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverages written as bytes and read back."""
    return as_hex(cov.deserialize(cov.serialize(seen(spark, sf_dir, 6))))


@query(sql_with(SQL_POINTS, _MIXED) + "SELECT event_id, m.shape_id, CAST(min(2 * length(m.hex)) AS INTEGER) AS coarsest, CAST(max(2 * length(m.hex)) AS INTEGER) AS finest FROM pts p JOIN mixed m ON m.hex IN (substr(p.hex, 1, 2), substr(p.hex, 1, 3)) GROUP BY 1, 2")
def resolutions_at_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.resolutions_at(mixed(spark, sf_dir), points(spark, sf_dir).select("event_id", "hh")).select("event_id", "shape_id", "coarsest", "finest")


@query(sql_with(SQL_POINTS, _MIXED) + "SELECT DISTINCT event_id, m.shape_id FROM pts p JOIN mixed m ON m.hex IN (substr(p.hex, 1, 2), substr(p.hex, 1, 3))")
def intervals_of_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of two resolutions that overlap everywhere, by intervals of codes."""
    return match.join_intervals(points(spark, sf_dir).select("event_id", "hh"), mixed(spark, sf_dir)).select("event_id", "shape_id")


@query(sql_with(SQL_POINTS, _MIXED) + "SELECT shape_id, CAST(max(r) AS INTEGER) AS mean_res FROM (SELECT shape_id, floor(sum(pow(2, 64 - 4 * length(hex))) / count(*)) AS mean FROM mixed GROUP BY 1), range(2, 34, 2) t(r) WHERE pow(2, 64 - 2 * r) >= mean GROUP BY 1")
def mean_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.summary(mixed(spark, sf_dir)).select("shape_id", "mean_res")


@query(sql_with(SQL_POINTS, "boxes AS (SELECT event_type AS shape_id, min(y) >> 26 AS y0, max(y) >> 26 AS y1, min(x) >> 26 AS x0, max(x) >> 26 AS x1 FROM pts GROUP BY 1)", "grid AS (SELECT shape_id, a.v * 67108864 AS y, b.v * 67108864 AS x FROM boxes, range(64) a(v), range(64) b(v) WHERE a.v BETWEEN y0 AND y1 AND b.v BETWEEN x0 AND x1)") + f"SELECT shape_id, {sql_hex(digits=3)} AS hex FROM grid")
def rectangle_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of a rectangle around each type's events."""
    y, x = codec.y_of(F.col("hh")), codec.x_of(F.col("hh"))
    boxes = points(spark, sf_dir).groupBy(F.col("event_type").alias("shape_id"), F.lit(6).alias("res")).agg(F.min(y).alias("swy"), F.min(x).alias("swx"), F.max(y).alias("ney"), F.max(x).alias("nex"))
    return as_hex(cover.rectangles(boxes))


@query(sql_with(SQL_POINTS, _MIXED) + "SELECT shape_id, CAST(2 * length(hex) AS INTEGER) AS res, count(*) AS cells FROM mixed GROUP BY 1, 2")
def coverage_cardinalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.cardinalities(mixed(spark, sf_dir))


@query(sql_with(SQL_POINTS, _MIXED) + "SELECT DISTINCT shape_id, substr(hex, 1, 2) AS hex FROM mixed")
def limit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_hex(cov.limit_levels(mixed(spark, sf_dir), 2, 4))


@query(sql_with(SQL_POINTS, _MIXED) + "SELECT shape_id, array_to_string(list_sort(list(hex)), ' ') AS text FROM mixed GROUP BY 1")
def coverage_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.to_text(mixed(spark, sf_dir))


@query(sql_with(SQL_POINTS, _MIXED, SQL_SEEN) + "SELECT * FROM mixed EXCEPT SELECT * FROM seen")
def text_minus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_hex(expressions.minus_exact(mixed(spark, sf_dir), seen(spark, sf_dir)))


@query(sql_with(SQL_POINTS, _MIXED, SQL_SEEN) + "SELECT * FROM mixed INTERSECT SELECT * FROM seen")
def text_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_hex(expressions.intersect_exact(mixed(spark, sf_dir), seen(spark, sf_dir)))


@query(sql_with(SQL_POINTS, SQL_SEEN, f"corners AS (SELECT shape_id, {sql_cell('hex')} FROM seen)") + "SELECT shape_id, round(min(cy) * (180e0/4294967296) - 90, 6) + 0e0 AS swlat, round(min(cx) * (360e0/4294967296) - 180, 6) + 0e0 AS swlon, round((max(cy) + 268435455) * (180e0/4294967296) - 90, 6) + 0e0 AS nelat, round((max(cx) + 268435455) * (360e0/4294967296) - 180, 6) + 0e0 AS nelon FROM corners GROUP BY 1")
def coverage_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.bbox_of_coverage(seen(spark, sf_dir)).select("shape_id", *[(F.round(c, 6) + 0.0).alias(c) for c in ("swlat", "swlon", "nelat", "nelon")])


@query(sql_with(SQL_POINTS, SQL_SEEN, "stems AS (SELECT shape_id, substr(hex, 1, 1) || '[' || array_to_string(list_sort(list(substr(hex, 2, 1))), '') || '].*' AS part FROM seen GROUP BY shape_id, substr(hex, 1, 1))") + "SELECT shape_id, array_to_string(list_sort(list(part)), '|') AS regexp FROM stems GROUP BY 1")
def cells_regexp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.cells_regexp(as_hex(seen(spark, sf_dir)), ["shape_id"])


def _sql_reduce(finest: int, count: int) -> list[str]:
    """CTEs from `fine` (shape_id, hex of `finest` digits) to `reduced`: full parents first, then from the finest level on the largest threshold that fits."""
    up = lambda n: f"substr(hex, 1, {n})"
    parts = [f"full{finest} AS MATERIALIZED (SELECT * FROM fine)"]
    for n in range(finest - 1, 0, -1):
        parts.append(f"full{n} AS MATERIALIZED (SELECT shape_id, {up(n)} AS hex FROM full{n + 1} GROUP BY 1, 2 HAVING count(*) = 16)")
    for n in range(finest, 1, -1):
        parts.append(f"kept{n} AS MATERIALIZED (SELECT f.shape_id, f.hex FROM full{n} f WHERE NOT EXISTS (SELECT 1 FROM full{n - 1} u WHERE u.shape_id = f.shape_id AND u.hex = substr(f.hex, 1, {n - 1})))")
    everything = " UNION ALL ".join([*[f"SELECT * FROM kept{n}" for n in range(finest, 1, -1)], "SELECT * FROM full1"])
    parts.append(f"size{finest} AS MATERIALIZED (SELECT shape_id, count(*) AS size FROM ({everything}) GROUP BY 1)")
    for n in range(finest, 1, -1):
        here = f"SELECT * FROM kept{n}" + (f" UNION ALL SELECT * FROM made{n}" if n < finest else "")
        parts += [
            f"here{n} AS MATERIALIZED ({here})",
            f"group{n} AS MATERIALIZED (SELECT shape_id, {up(n - 1)} AS up, count(*) AS n FROM here{n} GROUP BY 1, 2)",
            f"saves{n} AS MATERIALIZED (SELECT shape_id, t, CAST(sum(CASE WHEN n >= t THEN n - 1 ELSE 0 END) AS BIGINT) AS saves FROM group{n}, range(1, 16) r(t) GROUP BY 1, 2)",
            f"least{n} AS MATERIALIZED (SELECT shape_id, size, CASE WHEN size <= {count} THEN 17 ELSE coalesce((SELECT max(t) FROM saves{n} v WHERE v.shape_id = s.shape_id AND t > 1 AND s.size - saves <= {count}), 1) END AS least FROM size{n} s)",
            f"made{n - 1} AS MATERIALIZED (SELECT g.shape_id, up AS hex FROM group{n} g JOIN least{n} USING (shape_id) WHERE n >= least)",
            f"left{n} AS MATERIALIZED (SELECT shape_id, hex FROM here{n} h WHERE NOT EXISTS (SELECT 1 FROM made{n - 1} m WHERE m.shape_id = h.shape_id AND m.hex = substr(h.hex, 1, {n - 1})))",
            f"size{n - 1} AS MATERIALIZED (SELECT l.shape_id, size - coalesce(saves, 0) AS size FROM least{n} l LEFT JOIN saves{n} v ON v.shape_id = l.shape_id AND v.t = l.least)",
        ]
    last = " UNION ALL ".join([*[f"SELECT * FROM left{n}" for n in range(finest, 1, -1)], "SELECT * FROM full1", "SELECT * FROM made1"])
    return [*parts, f"reduced AS ({last})"]


_SEEN_8 = "fine AS (SELECT DISTINCT event_type AS shape_id, substr(hex, 1, 4) AS hex FROM pts)"


@query(sql_with(SQL_POINTS, _SEEN_8, *_sql_reduce(4, 100)) + "SELECT * FROM reduced")
def reduce_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_hex(cov.reduce_cells(seen(spark, sf_dir, 8), 100))


@query(sql_with(SQL_POINTS, "fine AS (SELECT DISTINCT user_id % 8 AS shape_id, substr(hex, 1, 4) AS hex FROM pts WHERE user_id IS NOT NULL)", *_sql_reduce(4, 700)) + "SELECT shape_id, hex FROM reduced")
def reduce_cells_of_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some shapes fit at once, some at a threshold between, some only levels up."""
    rows = points(spark, sf_dir).filter("user_id is not null")
    cells = rows.select((F.col("user_id") % 8).alias("shape_id"), F.lit(8).alias("res"), codec.at_resolution(F.col("hh"), 8).alias("cell")).distinct()
    return as_hex(cov.reduce_cells(cells, 700))


@query()
def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.clusters(seen(spark, sf_dir, 8)).select("shape_id", cov.hex_of(F.col("res"), F.col("cell")).alias("hex"), "cluster")


@query(
    sql_with(SQL_POINTS, SQL_SEEN, f"corners AS (SELECT shape_id, hex, {sql_cell('hex')} FROM seen)",
             "links AS (SELECT a.shape_id, a.hex AS a, b.hex AS b FROM corners a JOIN corners b ON a.shape_id = b.shape_id AND abs(a.cy - b.cy) + abs(a.cx - b.cx) = 268435456)",
             "reach AS (SELECT shape_id, hex, hex AS label FROM seen UNION SELECT l.shape_id, l.b, r.label FROM reach r JOIN links l ON l.shape_id = r.shape_id AND l.a = r.hex)")
    + "SELECT shape_id, hex, min(label) AS cluster FROM reach GROUP BY 1, 2"
)
def clusters_coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.clusters(seen(spark, sf_dir)).select("shape_id", cov.hex_of(F.col("res"), F.col("cell")).alias("hex"), "cluster")


_SEEN_6 = "seen6 AS (SELECT DISTINCT event_type AS shape_id, y >> 26 AS cy, x >> 26 AS cx FROM pts)"


@query(
    sql_with(SQL_POINTS, _SEEN_6, "sides AS (SELECT shape_id, cy + dy AS y, cx + dx AS x, vertical, way FROM seen6, (VALUES (0, 0, false, 1), (1, 0, false, -1), (0, 1, true, 1), (0, 0, true, -1)) s(dy, dx, vertical, way))")
    + "SELECT shape_id, y * 67108864 AS y, x * 67108864 AS x, vertical, CAST(sum(way) AS BIGINT) AS way FROM sides GROUP BY ALL HAVING sum(way) <> 0"
)
def rim_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sides of cells that bound what each event type has seen."""
    return render.rim_units(seen(spark, sf_dir, 6)).select("shape_id", "y", "x", "vertical", "way")


@query(sql_with(SQL_POINTS, _SEEN_6) + "SELECT shape_id, round(count(*) * 2.8125e0 * 5.625e0, 4) AS area FROM seen6 GROUP BY 1")
def outline_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings with their holes taken off enclose as much as the cells cover."""
    return render.envelope(seen(spark, sf_dir, 6)).groupBy("shape_id").agg(F.round(F.sum("area"), 4).alias("area"))


def _sql_rings(cells: str, step: int, rounds: int, low: str = "cy", left: str = "cx") -> list[str]:
    """CTEs up to `sides`: unit sides of cells (shape_id, cy, cx in steps) with the least side of their ring and the sides to it.

    Each side is followed by the one to the left, straight on or to the right, in this order; rings are told by doubling over unit sides.
    """
    turns = "(VALUES (0, 0, 0, 1, 0), (0, 1, 1, 1, 1), (1, 1, 1, 0, 2), (1, 0, 0, 0, 3)) s(ya, xa, yb, xb, d)"
    parts = [
        f"around AS MATERIALIZED (SELECT shape_id, {low} + ya AS y1, {left} + xa AS x1, {low} + yb AS y2, {left} + xb AS x2, d FROM {cells}, {turns})",
        "units AS MATERIALIZED (SELECT * FROM around a WHERE NOT EXISTS (SELECT 1 FROM around b WHERE a.shape_id = b.shape_id AND a.y1 = b.y2 AND a.x1 = b.x2 AND a.y2 = b.y1 AND a.x2 = b.x1))",
        "turned AS MATERIALIZED (SELECT u.*, n.d AS nd, row_number() OVER (PARTITION BY u.shape_id, u.y1, u.x1, u.d ORDER BY (n.d - u.d + 5) % 4 = 2 DESC, (n.d - u.d + 5) % 4 = 1 DESC) AS k "
        "FROM units u JOIN units n ON n.shape_id = u.shape_id AND n.y1 = u.y2 AND n.x1 = u.x2 AND (n.d - u.d + 4) % 4 <> 2)",
        "hop0 AS MATERIALIZED (SELECT shape_id, y1, x1, d, y2 AS ny, x2 AS nx, nd, {'y': y1, 'x': x1, 'd': d} AS least, CAST(0 AS BIGINT) AS ahead FROM turned WHERE k = 1)",
    ]
    for k in range(rounds):
        parts.append(
            f"hop{k + 1} AS MATERIALIZED (SELECT a.shape_id, a.y1, a.x1, a.d, b.ny, b.nx, b.nd, least(a.least, b.least) AS least, CASE WHEN b.least < a.least THEN b.ahead + {1 << k} ELSE a.ahead END AS ahead "
            f"FROM hop{k} a JOIN hop{k} b ON b.shape_id = a.shape_id AND b.y1 = a.ny AND b.x1 = a.nx AND b.d = a.nd)"
        )
    parts.append(
        f"sides AS MATERIALIZED (SELECT t.shape_id, CAST(h.least.y * {step} AS VARCHAR) || ':' || CAST(h.least.x * {step} AS VARCHAR) AS ring, h.ahead, t.y1, t.x1, t.y2, t.x2, t.d, t.nd "
        f"FROM hop{rounds} h JOIN turned t ON t.k = 1 AND t.shape_id = h.shape_id AND t.y1 = h.y1 AND t.x1 = h.x1 AND t.d = h.d)"
    )
    return parts


@query(
    sql_with(SQL_POINTS, _SEEN_6, *_sql_rings("seen6", 1 << 26, 14))
    + "SELECT shape_id, ring, sum(x1 * (y2 - y1)) > 0 AS \"outer\", round(sum(x1 * (y2 - y1)) * 2.8125e0 * 5.625e0, 4) AS area, CAST(count(*) FILTER (WHERE d <> nd) + 1 AS INTEGER) AS corners FROM sides GROUP BY 1, 2"
)
def envelope_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ring of what the event types have seen, by its least corner: which way it goes, what it encloses, its corners."""
    return render.envelope(seen(spark, sf_dir, 6)).select("shape_id", "ring", "outer", F.round("area", 4).alias("area"), F.size("points").alias("corners"))


@query()
def geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.geojson(seen(spark, sf_dir, 6))


_LON_LAT = "[x2 * 268435456 * (360e0/4294967296) - 180, y2 * 268435456 * (180e0/4294967296) - 90]"


@query(
    sql_with(
        SQL_POINTS, SQL_SEEN, f"corners AS (SELECT shape_id, hex, {sql_cell('hex')} FROM seen)",
        "links AS (SELECT a.shape_id, a.hex AS a, b.hex AS b FROM corners a JOIN corners b ON a.shape_id = b.shape_id AND abs(a.cy - b.cy) + abs(a.cx - b.cx) = 268435456)",
        "reach AS (SELECT shape_id, hex, hex AS label FROM seen UNION SELECT l.shape_id, l.b, r.label FROM reach r JOIN links l ON l.shape_id = r.shape_id AND l.a = r.hex)",
        "named AS (SELECT shape_id, hex, min(label) AS cluster FROM reach GROUP BY 1, 2)",
        "parted AS MATERIALIZED (SELECT n.shape_id || chr(1) || cluster AS shape_id, cy >> 28 AS cy, cx >> 28 AS cx FROM named n JOIN corners c ON c.shape_id = n.shape_id AND c.hex = n.hex)",
        *_sql_rings("parted", 1 << 28, 11),
        f"rings AS (SELECT shape_id, ring, sum(x1 * (y2 - y1)) AS size, list({_LON_LAT} ORDER BY CASE WHEN ahead = 1 THEN -1000001 WHEN ahead = 0 THEN -1000000 ELSE -ahead END) FILTER (WHERE d <> nd) AS pts FROM sides GROUP BY 1, 2)",
        "told AS (SELECT *, '[' || array_to_string(list_transform(list_append(pts, pts[1]), lambda p: '[' || p[1] || ',' || p[2] || ']'), ',') || ']' AS text FROM rings)",
        "polygons AS (SELECT split_part(shape_id, chr(1), 1) AS shape_id, split_part(shape_id, chr(1), 2) AS cluster, '[' || string_agg(text, ',' ORDER BY size < 0, -abs(size), pts) || ']' AS text FROM told GROUP BY 1, 2)",
    )
    + """SELECT shape_id, '{"type":"MultiPolygon","coordinates":[' || string_agg(text, ',' ORDER BY cluster) || ']}' AS geojson FROM polygons GROUP BY 1"""
)
def geojson_coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text of each event type's outline: a polygon for each cluster, holes after the outside."""
    return render.geojson(seen(spark, sf_dir))


@query(
    sql_with(
        SQL_POINTS, "squares AS MATERIALIZED (SELECT DISTINCT event_type AS shape_id, y >> 28 AS cy, x >> 28 AS cx FROM pts)", *_sql_rings("squares", 1 << 28, 11),
        f"rings AS (SELECT shape_id, ring, list({_LON_LAT} ORDER BY CASE WHEN ahead = 1 THEN -1000001 WHEN ahead = 0 THEN -1000000 ELSE -ahead END) FILTER (WHERE d <> nd) AS pts FROM sides GROUP BY 1, 2)",
        "told AS (SELECT shape_id, ring, '<Placemark><LineString><coordinates>' || array_to_string(list_transform(list_append(pts, pts[1]), lambda p: p[1] || ',' || p[2]), ' ') || '</coordinates></LineString></Placemark>' AS kml FROM rings)",
    )
    + f"SELECT shape_id, '{render.HEAD}' || string_agg(kml, '' ORDER BY lpad(split_part(ring, ':', 1), 10, '0') || lpad(split_part(ring, ':', 2), 10, '0')) || '{render.TAIL}' AS kml FROM told GROUP BY 1"
)
def kml_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each ring of what the event types have seen."""
    return render.kml_document(render.kml_envelope(seen(spark, sf_dir)))


@query(sql_with(SQL_POINTS, _MIXED) + f"SELECT shape_id, hex FROM mixed WHERE length(hex) = 3 UNION SELECT shape_id, hex || {DIGIT.format('d')} FROM mixed, range(16) r(d) WHERE length(hex) = 2")
def geocells_there_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverages of two resolutions as geocells and back, then taken to one resolution."""
    return as_hex(cov.normalize(cov.from_geocells(cov.to_geocells(mixed(spark, sf_dir))), 6))


_CORNER = "(cx + {x} * 268435456) * (360e0/4294967296) - 180 || ',' || ((cy + {y} * 268435456) * (180e0/4294967296) - 90)"
_CORNERS = " || ' ' || ".join(f"({_CORNER.format(y=y, x=x).replace(' - 180 ||', ' - 180) ||', 1)}" for y, x in ((0, 0), (0, 1), (1, 1), (1, 0), (0, 0)))


@query(
    sql_with(SQL_POINTS, SQL_SEEN, f"corners AS (SELECT shape_id, hex, {sql_cell('hex')} FROM seen)",
             "marks AS (SELECT shape_id, hex, '<Placemark><name>' || hex || '</name><Polygon><outerBoundaryIs><LinearRing><coordinates>' || " + _CORNERS + " || '</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>' AS kml FROM corners)")
    + f"SELECT shape_id, '{render.HEAD}' || string_agg(kml, '' ORDER BY hex) || '{render.TAIL}' AS kml FROM marks GROUP BY 1"
)
def kml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.kml_document(render.kml_cells(seen(spark, sf_dir)))


# --- areas and their edges -----------------------------------------------------------------------


def _legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each user's event to the next, as segments at resolution 6."""
    places = points(spark, sf_dir).select("user_id", "ts", "event_id", codec.y_of(F.col("hh")).alias("y"), codec.x_of(F.col("hh")).alias("x"))
    return cover.legs(places, "user_id", "ts", "event_id").withColumnRenamed("user_id", "shape_id").withColumn("shape_id", F.col("shape_id").cast("string")).withColumn("res", F.lit(6))


def _in(spark: SparkSession, sf_dir: str, cells: DataFrame) -> DataFrame:
    return match.join_points(points(spark, sf_dir).select("event_id", "hh"), cells).select("event_id", "shape_id")


def _sql_fill(ring: str, res: int, name: str = "filled") -> list[str]:
    """CTEs from `ring` (shape_id, part, k, y, x: vertices in order) to `name` (shape_id, hex): cells that a side passes through, and those with an odd number of sides before them."""
    bits, step = 32 - res, 1 << (32 - res)
    cross = lambda y: f"ix + CAST(trunc(({y} - iy) * (CAST(jx - ix AS DOUBLE) / CAST(jy - iy AS DOUBLE))) AS BIGINT)"
    mark = lambda c: f"{name}_{c}"
    around = "OVER (PARTITION BY shape_id, part ORDER BY k)"
    parts = [
        f"{mark('n')} AS (SELECT *, count(*) OVER (PARTITION BY shape_id, part) AS n FROM {ring})",
        f"{mark('sides')} AS MATERIALIZED (SELECT shape_id, part, k, y AS iy, x AS ix, coalesce(lag(y) {around}, last_value(y) OVER (PARTITION BY shape_id, part ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS jy, "
        f"coalesce(lag(x) {around}, last_value(x) OVER (PARTITION BY shape_id, part ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS jx, "
        f"coalesce(lead(y) {around}, first_value(y) {around}) AS ny FROM {mark('n')} WHERE n >= 3)",
        f"{mark('steps')} AS (SELECT *, unnest(range(least(iy, jy) >> {bits}, (greatest(iy, jy) >> {bits}) + 1)) AS r FROM {mark('sides')} WHERE iy <> jy)",
        f"{mark('rows')} AS (SELECT *, greatest(r * {step}, least(iy, jy)) AS spot FROM {mark('steps')} UNION ALL SELECT *, greatest(iy, jy) AS spot FROM {mark('steps')} WHERE r = greatest(iy, jy) >> {bits})",
        f"{mark('ends')} AS (SELECT *, {cross('spot')} AS a, {cross(f'(r * {step} + {step - 1})')} AS b FROM {mark('rows')})",
        f"{mark('met')} AS MATERIALIZED (SELECT *, least(lo, hi) AS c0, hi AS c1 FROM (SELECT *, greatest(least(a, b), least(ix, jx)) >> {bits} AS lo, least(greatest(a, b), greatest(ix, jx)) >> {bits} AS hi FROM {mark('ends')}))",
        f"{mark('rim')} AS MATERIALIZED (SELECT DISTINCT shape_id, part, r, unnest(range(c0, c1 + 1)) AS c FROM {mark('met')} UNION SELECT DISTINCT shape_id, part, iy >> {bits}, unnest(range(least(ix, jx) >> {bits}, (greatest(ix, jx) >> {bits}) + 1)) FROM {mark('sides')} WHERE iy = jy)",
        f"{mark('counted')} AS MATERIALIZED (SELECT shape_id, part, r, c0 FROM {mark('met')} WHERE spot = r * {step} AND ((spot <> iy AND spot <> jy) OR spot = jy OR (spot = iy AND (CAST(ny - iy AS DOUBLE) * CAST(jy - iy AS DOUBLE) > 0))))",
        f"{mark('wide')} AS (SELECT shape_id, part, r, unnest(range(min(c0), max(c0) + 1)) AS c FROM {mark('counted')} GROUP BY shape_id, part, r)",
        f"{mark('inner')} AS (SELECT w.shape_id, w.r, w.c FROM {mark('wide')} w JOIN {mark('counted')} n ON n.shape_id = w.shape_id AND n.part = w.part AND n.r = w.r AND n.c0 < w.c "
        f"WHERE NOT EXISTS (SELECT 1 FROM {mark('rim')} e WHERE e.shape_id = w.shape_id AND e.part = w.part AND e.r = w.r AND e.c = w.c) GROUP BY w.shape_id, w.part, w.r, w.c HAVING count(*) % 2 = 1)",
        f"{name} AS MATERIALIZED (SELECT DISTINCT shape_id, {sql_hex(digits=res // 2)} AS hex FROM (SELECT shape_id, (r << {bits}) & 4294967295 AS y, (c << {bits}) & 4294967295 AS x FROM (SELECT shape_id, r, c FROM {mark('rim')} UNION SELECT * FROM {mark('inner')})))",
    ]
    return parts


def _sql_area(text: str) -> str:
    """The vertices of an area text as the CTE `ring`; shape_id is the kind of area."""
    area = areas.parse_area(text)
    rows = ", ".join(f"('{area.kind}', {p}, {k}, {y}, {x})" for p, ring in enumerate(area.polygons) for k, (y, x) in enumerate(ring))
    return f"ring AS (SELECT shape_id, part, k, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x FROM (VALUES {rows}) v(shape_id, part, k, y, x))"


def _events_in(text: str, res: int) -> str:
    """SQL for the events in an area."""
    return sql_with(SQL_POINTS, _sql_area(text), *_sql_fill("ring", res)) + f"SELECT event_id, shape_id FROM pts JOIN filled f ON f.hex = substr(pts.hex, 1, {res // 2})"


_CIRCLE = "circle:48.0:-4.5:500000"
_PATH = "path:48.0:-4.5:50000,45.0:5.0,40.0:20.0:80000"
#: A polygon with a known number of cells (1,395 at resolution 12, parents in place of full children).
_POLYGON = "polygon:51.344338660599234:2.548828125,48.574789910928864:-5.537109375,43.45291889355465:-1.93359375,42.09822241118974:3.515625,43.89789239125797:8.876953125,49.0954521625348:8.701171875"


@query(_events_in(_CIRCLE, 14))
def circle_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in(spark, sf_dir, cov.optimize(shape(spark, ("circle", _CIRCLE, 14))))


@query(_events_in(_PATH, 14))
def path_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in(spark, sf_dir, shape(spark, ("path", _PATH, 14)))


@query(_events_in(_POLYGON, 12).replace("event_id, shape_id", "event_id, 'west' AS shape_id"))
def polygon_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in(spark, sf_dir, cov.optimize(shape(spark, ("west", _POLYGON, 12))))


#: Vertices of a star around a supplier's site, in units.
_STAR = ((0, 90_000_000), (40_000_000, 30_000_000), (120_000_000, 10_000_000), (35_000_000, -40_000_000), (-10_000_000, -100_000_000), (-60_000_000, -20_000_000), (-45_000_000, 50_000_000))
_STAR_Y = "1000000000 + (s_suppkey * 7919 % 150001) * 15000 + ({dy}) * (1 + s_suppkey % 3)"
_STAR_X = "400000000 + (s_suppkey * 104729 % 340000) * 10000 + ({dx}) * (1 + s_suppkey % 3)"


@query(
    sql_with(
        "star(k, dy, dx) AS (VALUES " + ", ".join(f"({k}, {dy}, {dx})" for k, (dy, dx) in enumerate(_STAR)) + ")",
        f"ring AS (SELECT s_suppkey AS shape_id, 0 AS part, k, CAST({_STAR_Y.format(dy='dy')} AS BIGINT) AS y, CAST({_STAR_X.format(dx='dx')} AS BIGINT) AS x FROM supplier, star)",
        *_sql_fill("ring", 8),
    )
    + "SELECT CAST(shape_id AS VARCHAR) AS shape_id, hex FROM filled"
)
def polygon_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells of a star around each supplier."""
    return as_hex(cover.polygons(_stars(spark, sf_dir)))


@query(
    f"SELECT CAST(s_suppkey AS VARCHAR) AS shape_id, {_STAR_Y.format(dy=min(y for y, _ in _STAR))} AS swy, {_STAR_X.format(dx=min(x for _, x in _STAR))} AS swx, "
    f"{_STAR_Y.format(dy=max(y for y, _ in _STAR))} AS ney, {_STAR_X.format(dx=max(x for _, x in _STAR))} AS nex FROM supplier"
)
def boxes_of_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box around each star's corners."""
    return _stars(spark, sf_dir).withColumn("b", resolution.bbox_of_vertices(F.col("ring"))).select("shape_id", "b.swy", "b.swx", "b.ney", "b.nex")


def _stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    corners = ", ".join(f"struct(cast({_STAR_Y.format(dy=dy)} as bigint) as y, cast({_STAR_X.format(dx=dx)} as bigint) as x)" for dy, dx in _STAR)
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("cast(s_suppkey as string) as shape_id", "8 as res", f"array({corners}) as ring")


@query(
    sql_with(
        SQL_POINTS,
        "ways AS (SELECT user_id, y AS y1, x AS x1, lead(y) OVER w AS y2, lead(x) OVER w AS x2 FROM pts WINDOW w AS (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id))",
        "ahead AS (SELECT user_id, CASE WHEN x1 <= x2 THEN y1 ELSE y2 END AS ay, least(x1, x2) AS ax, CASE WHEN x1 <= x2 THEN y2 ELSE y1 END AS zy, greatest(x1, x2) AS zx FROM ways WHERE y2 IS NOT NULL)",
        "lanes AS (SELECT *, unnest(range(ax >> 26, greatest(ax >> 26, (zx - CASE WHEN zx > ax THEN 1 ELSE 0 END) >> 26) + 1)) * 67108864 AS x, CASE WHEN zx = ax THEN 0 ELSE CAST(zy - ay AS DOUBLE) / CAST(zx - ax AS DOUBLE) END AS slope FROM ahead)",
        "heights AS (SELECT *, ay + CAST(trunc((greatest(x, ax) - ax) * slope) AS BIGINT) AS p, CASE WHEN zx = ax THEN zy ELSE ay + CAST(trunc((least(x + 67108863, zx) - ax) * slope) AS BIGINT) END AS q FROM lanes)",
        "reach AS (SELECT *, least(p, q) >> 26 AS r0, (greatest(p, q) - CASE WHEN greatest(p, q) = greatest(ay, zy) AND ay <> zy AND p <> q THEN 1 ELSE 0 END) >> 26 AS r1 FROM heights)",
        f"met AS (SELECT DISTINCT user_id, {sql_hex(digits=3)} AS hex FROM (SELECT user_id, x, unnest(range(r0, greatest(r0, r1) + 1)) * 67108864 AS y FROM reach))",
    )
    + "SELECT hex, count(*) AS users FROM met GROUP BY 1"
)
def line_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells on the way from each user's event to the next."""
    pairs = _legs(spark, sf_dir)
    return as_hex(cover.lines(pairs)).groupBy("hex").agg(F.count(F.lit(1)).alias("users"))


@query(
    sql_with(
        SQL_POINTS,
        "ways AS (SELECT user_id, y AS y1, x AS x1, lead(y) OVER w AS y2, lead(x) OVER w AS x2 FROM pts WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))",
        "axes AS (SELECT *, abs(y2 - y1) > abs(x2 - x1) AS steep FROM ways WHERE y2 IS NOT NULL)",
        "ends AS (SELECT user_id, steep, CASE WHEN steep THEN y1 ELSE x1 END AS p1, CASE WHEN steep THEN x1 ELSE y1 END AS q1, CASE WHEN steep THEN y2 ELSE x2 END AS p2, CASE WHEN steep THEN x2 ELSE y2 END AS q2 FROM axes)",
        "ahead AS (SELECT user_id, steep, least(p1, p2) AS ap, CASE WHEN p1 <= p2 THEN q1 ELSE q2 END AS aq, greatest(p1, p2) AS bp, CASE WHEN p1 <= p2 THEN q2 ELSE q1 END AS bq FROM ends)",
        "steps AS (SELECT *, unnest(range(ap >> 26, (bp >> 26) + 1)) * 67108864 AS p FROM ahead)",
        "places AS (SELECT user_id, steep, p, aq + CASE WHEN bp = ap THEN 0 ELSE CAST(trunc((greatest(p, ap) - ap) * (CAST(bq - aq AS DOUBLE) / CAST(bp - ap AS DOUBLE))) AS BIGINT) END AS q FROM steps)",
        f"met AS (SELECT DISTINCT user_id, {sql_hex(digits=3)} AS hex FROM (SELECT user_id, CASE WHEN steep THEN p ELSE q END AS y, CASE WHEN steep THEN q ELSE p END AS x FROM places))",
    )
    + "SELECT hex, count(*) AS users FROM met GROUP BY 1"
)
def line_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells on the way through each user's events, one for each step along the longer axis."""
    return as_hex(cover.stepped_lines(_legs(spark, sf_dir).filter("shape_id is not null"))).groupBy("hex").agg(F.count(F.lit(1)).alias("users"))


_SITE = "((s_suppkey * 7919) % 150001) / 1e3 - 75e0 AS lat, ((s_suppkey * 104729) % 340000) / 1e3 - 170e0 AS lon"


@query(
    f"WITH sites AS (SELECT s_suppkey, {_SITE} FROM supplier), "
    "boxes AS (SELECT s_suppkey, " + ", ".join(f"CAST(floor(({v} + {half}) / ({2 * half}e0 / 4294967296)) AS BIGINT) >> 24 AS {c}" for v, half, c in (("lat", 90, "y0"), ("lat + 2.5e0", 90, "y1"), ("lon", 180, "x0"), ("lon + 4.5e0", 180, "x1"))) + " FROM sites), "
    "grid_rows AS (SELECT s_suppkey, x0, x1, unnest(range(y0, y1 + 1)) << 24 AS y FROM boxes), grid AS (SELECT s_suppkey, y, unnest(range(x0, x1 + 1)) << 24 AS x FROM grid_rows) "
    f"SELECT CAST(s_suppkey AS VARCHAR) AS shape_id, {sql_hex(digits=4)} AS hex FROM grid"
)
def shapes_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An area around each supplier, its text made and read on Spark."""
    lat, lon = "(s_suppkey * 7919 % 150001) / 1e3D - 75D", "(s_suppkey * 104729 % 340000) / 1e3D - 170D"
    text = f"concat('rect:', {lat}, ':', {lon}, ',', {lat} + 2.5D, ':', {lon} + 4.5D) as def"
    return as_hex(cover.from_table(spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey as shape_id", text, "8 as res")))


@query(ORACLES["shapes_from_table"])
def cover_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in SQL, by a table function."""
    sql_tables.register(spark)
    lat, lon = "(s_suppkey * 7919 % 150001) / 1e3D - 75D", "(s_suppkey * 104729 % 340000) / 1e3D - 170D"
    areas_of = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("cast(s_suppkey as string) as shape_id", f"concat('rect:', {lat}, ':', {lon}, ',', {lat} + 2.5D, ':', {lon} + 4.5D) as def")
    return spark.sql("SELECT a.shape_id, c.hex FROM {areas} a, LATERAL grid_cover(a.def, 8) c", areas=areas_of)


_GEOMETRY = "MULTIPOLYGON (((0 0, 90 0, 90 45, 0 45, 0 0), (22.5 11.25, 45 11.25, 45 22.5, 22.5 22.5, 22.5 11.25)), ((-90 -45, -45 -45, -45 -22.5, -90 -22.5, -90 -45)))"
_IN_GEOMETRY = (
    "SELECT event_id FROM pts WHERE (y >= 2147483648 AND y < 3221225472 AND x >= 2147483648 AND x < 3221225472 AND NOT (y >= 2415919104 AND y < 2684354560 AND x >= 2415919104 AND x < 2684354560)) "
    "OR (y >= 1073741824 AND y < 1610612736 AND x >= 1073741824 AND x < 1610612736)"
)


def geometry(spark: SparkSession) -> DataFrame:
    return wkt.geometry_rings(spark.createDataFrame([("framed", _GEOMETRY)], "shape_id string, wkt string"))


@query(sql_with(SQL_POINTS) + _IN_GEOMETRY)
def wkt_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in two polygons, one with a hole."""
    return match.semi_join(points(spark, sf_dir), descend.shape(geometry(spark), 12)).select("event_id")


@query(sql_with(SQL_POINTS) + _IN_GEOMETRY)
def shape_by_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, cells chosen by the error allowed; the borders lie on those of its cells."""
    return match.semi_join(points(spark, sf_dir), descend.shape_for_error(geometry(spark), 0.05)).select("event_id")


@query(sql_with(SQL_POINTS) + _IN_GEOMETRY)
def uniform_by_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.semi_join(points(spark, sf_dir), descend.uniform_shape_for_error(geometry(spark), 0.05)).select("event_id")


#: An area with a slanted hole.
_FRAME = (
    [(3400000000, 1700000000), (3400000000, 2900000000), (2600000000, 2900000000), (2600000000, 1700000000)],
    [(3200000000, 2000000000), (3200000000, 2500000000), (2800000000, 2200000000)],
)


def _sql_touched(sides: str, res: int) -> str:
    """Condition on the cell (cy, cx in cells) of a row: one of the sides (y1, x1, y2, x2) passes through it, or an odd number stand east of its middle."""
    step = float(1 << (32 - res))
    span = lambda p, d, c: f"CASE WHEN {d} = 0 THEN [0e0, 1e0] ELSE [least(({c} * {step} - {p}) / {d}, (({c} + 1) * {step} - {p}) / {d}), greatest(({c} * {step} - {p}) / {d}, (({c} + 1) * {step} - {p}) / {d})] END"
    flat = lambda p, d, c: f"({d} = 0 AND ({p} <= {c} * {step} OR {p} >= ({c} + 1) * {step}))"
    dy, dx = "(y2 - y1)", "(x2 - x1)"
    touched = (
        f"EXISTS (SELECT 1 FROM (SELECT {span('y1', dy, 'cy')} AS v, {span('x1', dx, 'cx')} AS h, {flat('y1', dy, 'cy')} OR {flat('x1', dx, 'cx')} AS off FROM {sides}) "
        "WHERE NOT off AND greatest(0e0, v[1], h[1]) < least(1e0, v[2], h[2]))"
    )
    my, mx = f"(cy + 0.5e0) * {step}", f"(cx + 0.5e0) * {step}"
    return f"({touched} OR (SELECT count(*) FROM {sides} WHERE (y1 > {my}) <> (y2 > {my}) AND {mx} < x1 + ({my} - y1) * {dx} / CASE WHEN {dy} = 0 THEN 1 ELSE {dy} END) % 2 = 1)"


_FRAME_SIDES = "frame AS (SELECT CAST(y1 AS DOUBLE) AS y1, CAST(x1 AS DOUBLE) AS x1, CAST(y2 AS DOUBLE) AS y2, CAST(x2 AS DOUBLE) AS x2 FROM (VALUES " + ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for ring in _FRAME for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) + ") v(y1, x1, y2, x2))"


@query(
    sql_with(SQL_POINTS, _FRAME_SIDES, "occupied AS MATERIALIZED (SELECT DISTINCT y >> 20 AS cy, x >> 20 AS cx FROM pts)", f"met AS MATERIALIZED (SELECT cy, cx FROM occupied WHERE {_sql_touched('frame', 12)})")
    + "SELECT event_id, 'framed' AS shape_id FROM pts JOIN met ON cy = y >> 20 AND cx = x >> 20"
)
def geometry_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rings = spark.createDataFrame([("framed", ring) for ring in _FRAME], "shape_id string, ring array<struct<y: bigint, x: bigint>>")
    return _in(spark, sf_dir, descend.cover_geometry(rings, 2, 12))


def _radius_sql() -> str:
    sites = "sites AS (SELECT s_suppkey AS center_id, ((s_suppkey * 7919) % 170001) / 1e3 - 85e0 AS slat, ((s_suppkey * 104729) % 360000) / 1e3 - 180e0 AS slon FROM supplier)"
    far = "degrees(2 * asin(least(1e0, sqrt(pow(sin((radians(slat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(slat)) * pow(sin(radians(slon - lon) / 2), 2))))) * 111120e0"
    return sql_with(SQL_POINTS, sites) + f"SELECT event_id, center_id, round({far}, 1) AS distance FROM pts JOIN sites ON abs(slat - lat) < 2 WHERE {far} <= 200000"


@query(_radius_sql())
def radius_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.col("s_suppkey").alias("center_id"), ((F.col("s_suppkey") * 7919 % 170001) / F.lit(1e3) - 85.0).alias("lat"), ((F.col("s_suppkey") * 104729 % 360000) / F.lit(1e3) - 180.0).alias("lon")
    )
    found = match.within(points(spark, sf_dir).select("event_id", "hh", "lat", "lon"), sites, 200_000.0)
    return found.select("event_id", "center_id", F.round("distance", 1).alias("distance"))


# --- geohash -------------------------------------------------------------------------------------

#: Letter k of a geohash: five bits, longitude's first.
_FIVE = "CAST(list_sum(list_transform(range(5), lambda j: (CASE WHEN (5*k+j) % 2 = 0 THEN (x >> (31 - (5*k+j)//2)) & 1 ELSE (y >> (31 - (5*k+j)//2)) & 1 END) << (4-j))) AS BIGINT)"
_SQL_GEOHASH = f"array_to_string(list_transform(range(12), lambda k: substr('{geohash.ALPHABET}', 1 + {_FIVE}, 1)), '')"


@query(sql_with(SQL_POINTS) + f"SELECT event_id, {_SQL_GEOHASH} AS geohash FROM pts")
def geohash_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("event_id", geohash.encode(F.col("hh")).alias("geohash"))


@query(sql_with(SQL_POINTS) + "SELECT event_id, substr(hex, 1, 10) AS hex FROM pts")
def geohash_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = geohash.decode(F.substring(geohash.encode(F.col("hh")), 1, 8))
    return points(spark, sf_dir).select("event_id", codec.to_hex(code, 20).alias("hex"))


@query(
    sql_with(SQL_POINTS, f"g2 AS (SELECT DISTINCT substr({_SQL_GEOHASH}, 1, 2) AS geohash FROM pts)", "g1 AS (SELECT substr(geohash, 1, 1) AS geohash FROM g2 GROUP BY 1 HAVING count(*) = 32)")
    + "SELECT geohash FROM g1 UNION ALL SELECT geohash FROM g2 WHERE substr(geohash, 1, 1) NOT IN (SELECT geohash FROM g1)"
)
def geohash_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geohash.merge_siblings(points(spark, sf_dir).select(F.substring(geohash.encode(F.col("hh")), 1, 2).alias("geohash")).distinct())


@query(
    sql_with(SQL_POINTS, f"named AS (SELECT DISTINCT substr({_SQL_GEOHASH}, 1, 3) AS geohash, y >> 25 AS gy, x >> 24 AS gx FROM pts)")
    + f"SELECT geohash, {sql_hex(digits=4)} AS hex FROM (SELECT geohash, (gy * 2 + d) << 24 AS y, gx << 24 AS x FROM named, range(2) r(d))"
)
def geohash_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    # saved: else the filter on decoded cells is pushed below the distinct and spells encoding out once for each use
    hashes = saved(points(spark, sf_dir).select(F.substring(geohash.encode(F.col("hh")), 1, 3).alias("geohash")).distinct())
    return geohash.to_cells(hashes).select("geohash", cov.hex_of(F.col("res"), F.col("cell")).alias("hex"))


_FOUR = "array_to_string(list_transform(range(4), lambda k: substr('" + geohash.ALPHABET + "', 1 + " + _FIVE + ", 1)), '')"


@query(
    sql_with(SQL_POINTS, "cells AS (SELECT DISTINCT substr(hex, 1, 4) AS cell, (y >> 24) << 24 AS cy, (x >> 24) << 24 AS cx FROM pts)", "parts AS (SELECT cell, cy + (a << 22) AS y, cx + (b << 22) AS x FROM cells, range(4) r(a), range(4) s(b))")
    + f"SELECT DISTINCT cell, {_FOUR} AS geohash FROM parts"
)
def geohash_from_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The geohashes of four letters that make up cells of resolution 8."""
    cells = points(spark, sf_dir).select(F.lit(8).alias("res"), codec.at_resolution(F.col("hh"), 8).alias("cell"), codec.to_hex(F.col("hh"), 8).alias("name")).distinct()
    return geohash.from_cells(cells).withColumnRenamed("name", "cell")


# --- membership, time ----------------------------------------------------------------------------


@query()
def bloom_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events are members; the cells of events and the eight around each are tested."""
    layout = bloom.Layout(max_res=12)
    pts = points(spark, sf_dir)
    bits = bloom.build(pts, layout)
    own = pts.select(codec.at_resolution(F.col("hh"), 12).alias("cell")).distinct()
    cells = hierarchy.with_neighbours(own, 12).select(F.lit(12).alias("res"), "cell").distinct()
    return bloom.contains(saved(cells), bits, layout).select(cov.hex_of(F.col("res"), F.col("cell")).alias("hex"), "member")


@query(sql_with(SQL_POINTS) + "SELECT DISTINCT substr(hex, 1, 6) AS hex FROM pts")
def bloom_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter never misses a member: of the cells of all events every one is found."""
    layout, pts = bloom.Layout(max_res=12), points(spark, sf_dir)
    cells = pts.select(F.lit(12).alias("res"), codec.at_resolution(F.col("hh"), 12).alias("cell")).distinct()
    return bloom.contains(cells, bloom.build(pts, layout), layout).filter("member").select(cov.hex_of(F.col("res"), F.col("cell")).alias("hex"))


@query(sql_with(SQL_POINTS) + "SELECT DISTINCT substr(hex, 1, 6) AS hex FROM pts")
def bloom_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of all events pass with all their ancestors, asked for at a finer level than the filter has."""
    layout, pts = bloom.Layout(max_res=12, sliced=True), points(spark, sf_dir)
    cells = pts.select(F.lit(14).alias("res"), codec.at_resolution(F.col("hh"), 14).alias("cell")).distinct()
    return bloom.contains(cells, bloom.build(pts, layout), layout, hierarchy=True).filter("member").select(cov.hex_of(F.lit(12), F.col("cell")).alias("hex")).distinct()


@query(
    sql_with(
        SQL_POINTS, "own AS (SELECT DISTINCT event_type, substr(hex, 1, 6) AS hex FROM pts)", "cells AS (SELECT DISTINCT hex FROM own)", "types AS (SELECT DISTINCT event_type FROM own)",
        "asked AS (SELECT t.event_type, o.hex IS NOT NULL AS mine FROM types t, cells c LEFT JOIN own o ON o.event_type = t.event_type AND o.hex = c.hex)",
    )
    + "SELECT event_type, count(*) FILTER (WHERE mine) AS members, count(*) FILTER (WHERE NOT mine) AS others, CAST(0 AS BIGINT) AS missed, true AS few_false FROM asked GROUP BY 1"
)
def bloom_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter for each event type, asked for the cells of all types: none of its own is missed, of the others it takes hardly more than its error says."""
    layout, pts = bloom.Layout(max_res=12), points(spark, sf_dir)
    own = saved(pts.select("event_type", F.lit(12).alias("res"), codec.at_resolution(F.col("hh"), 12).alias("cell")).distinct())
    types = [r[0] for r in own.select("event_type").distinct().collect()]  # a handful
    asked = own.select("res", "cell").distinct().withColumn("event_type", F.explode(F.array(*map(F.lit, types))))
    told = bloom.contains(asked, bloom.build(pts, layout, keys=["event_type"]), layout, keys=["event_type"])
    marked = told.join(own.withColumn("mine", F.lit(True)), ["event_type", "res", "cell"], "left").withColumn("mine", F.coalesce("mine", F.lit(False)))
    count = lambda c: F.count(F.when(c, 1))
    others, false = count(~F.col("mine")), count(~F.col("mine") & F.col("member"))
    return marked.groupBy("event_type").agg(
        count(F.col("mine")).alias("members"), others.alias("others"), count(F.col("mine") & ~F.col("member")).alias("missed"), (false <= 2 * max(bloom.ERRORS[:4]) * others + 10).alias("few_false")
    )


@query(sql_with(SQL_POINTS) + "SELECT time_bucket(INTERVAL '5 minutes', CAST(ts AS TIMESTAMP)) AS start, substr(hex, 1, 2) AS hex, count(*) AS events, round(sum(value), 2) AS total FROM pts GROUP BY 1, 2")
def activity_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = activity.cycles(points(spark, sf_dir))
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "hex", "events", F.round("total", 2).alias("total"))


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    saved(spark.range(1))  # names the folder for checkpoints where none is named
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query(sql_with(SQL_POINTS) + "SELECT substr(hex, 1, 4) AS hex, event_type, count(*) AS events, round(sum(value), 2) AS total, min(event_id) AS first, max(event_id) AS last FROM pts GROUP BY 1, 2")
def resumed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of cells kept by a stream that breaks off in the middle of a batch and starts again from its checkpoint."""
    folder = _scratch(spark, "index")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for k in range(3):  # three files, so that there are batches
        events.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = sources.of_events(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
    with contextlib.suppress(StreamingQueryException):
        index.keep(stream, f"{folder}/index", f"{folder}/checkpoint", ["event_type"], break_in=1)
    index.keep(stream, f"{folder}/index", f"{folder}/checkpoint", ["event_type"])
    found = index.read(spark, f"{folder}/index", ["event_type"])
    return found.select("hex", "event_type", "events", F.round("total", 2).alias("total"), "first", "last")


@query(sql_with(SQL_POINTS, _WEST) + "SELECT event_id FROM pts WHERE substr(hex, 1, 6) IN (SELECT hex FROM west)")
def sharded_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in shards of bounded size; a query's cells tell which shards are read."""
    folder = _scratch(spark, "shards")
    shards.write(points(spark, sf_dir).select("event_id", "hh"), folder, most_rows=2_000)
    return shards.in_cells(spark, folder, shape(spark, WEST)).select("event_id")


@query(sql_with(SQL_POINTS, *[f"n{d} AS MATERIALIZED (SELECT substr(hex, 1, {d}) AS hex, count(*) AS n FROM pts GROUP BY 1)" for d in range(1, 7)])
       + " UNION ALL ".join([f"SELECT c.hex, c.n AS points FROM n{d} c" + (f" JOIN n{d - 1} u ON u.hex = substr(c.hex, 1, {d - 1}) AND u.n > 50" if d > 1 else "") + (" WHERE c.n <= 50" if d < 6 else "") for d in range(1, 7)]))
def shard_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that points are parted by: no more than 50 points each, or of resolution 12."""
    return shards.plan(points(spark, sf_dir), most_rows=50, finest=12).select(cov.hex_of(F.col("res"), F.col("cell")).alias("hex"), "points")


@query(sql_with(SQL_POINTS) + "SELECT user_id, event_id, hex FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM pts) WHERE n = 1")
def latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.latest(points(spark, sf_dir), ["user_id"], ties="event_id").select("user_id", "event_id", "hex")


_RATIO = """CASE WHEN arc = 0 THEN 1 ELSE sqrt(pow(b - a, 2) + pow(CASE WHEN abs(b - a) < 3.1622776601683794e-8 THEN cos(a) ELSE (b - a) / ln(tan(b / 2 + pi() / 4) / tan(a / 2 + pi() / 4)) END * turn, 2)) / arc END"""
_WAYS = f"""SELECT *, {_RATIO} AS ratio, cos(a) * cos(radians(lo1)) + cos(b) * cos(radians(lo2)) AS u, cos(a) * sin(radians(lo1)) + cos(b) * sin(radians(lo2)) AS v FROM (
  SELECT *, 2 * asin(least(1e0, sqrt(pow(sin((a - b) / 2), 2) + cos(a) * cos(b) * pow(sin(turn / 2), 2)))) AS arc FROM (
    SELECT *, radians(la1) AS a, radians(la2) AS b, radians(lo2) - radians(lo1) AS turn FROM {{segments}}))"""
_HALVED = f"""SELECT event_id, t, size / 2 AS size, la1, lo1, la2, lo2 FROM (
  SELECT event_id, CASE WHEN h = 0 THEN t ELSE t + size / 2 END AS t, size, CASE WHEN h = 0 THEN la1 ELSE mla END AS la1, CASE WHEN h = 0 THEN lo1 ELSE mlo END AS lo1, CASE WHEN h = 0 THEN mla ELSE la2 END AS la2, CASE WHEN h = 0 THEN mlo ELSE lo2 END AS lo2
  FROM (SELECT *, degrees(atan2(sin(a) + sin(b), sqrt(u * u + v * v))) AS mla, degrees(atan2(v, u)) AS mlo FROM ({_WAYS.format(segments='ways')}) WHERE ratio >= 1.02e0), (VALUES (0), (1)) s(h))"""


@query(
    sql_with(
        SQL_POINTS,
        f"whole AS (SELECT event_id, lat AS la1, lon AS lo1, {_PARIS[0]}e0 AS la2, {_PARIS[1]}e0 AS lo2, abs({_PARIS[1]}e0 - lon) AS span FROM pts)",
        "parted AS (SELECT *, 179.9999e0 / span AS f, la1 * (1 - 179.9999e0 / span) + la2 * (179.9999e0 / span) AS cla, lo1 * (1 - 179.9999e0 / span) + lo2 * (179.9999e0 / span) AS clo FROM whole WHERE span > 180)",
        "ways AS (SELECT event_id, 0e0 AS t, 1e0 AS size, la1, lo1, la2, lo2 FROM whole WHERE span <= 180 UNION ALL SELECT event_id, 0e0, f, la1, lo1, cla, clo FROM parted UNION ALL SELECT event_id, f, 1 - f, cla, clo, la2, lo2 FROM parted "
        f"UNION ALL {_HALVED})",
        f"kept AS (SELECT event_id, t, la1 AS lat, lo1 AS lon FROM ({_WAYS.format(segments='ways')}) WHERE ratio < 1.02e0 UNION ALL SELECT event_id, 2e0, la2, lo2 FROM whole)",
    )
    + "SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY t) AS INTEGER) AS k, round(lat, 4) + 0e0 AS lat, round(lon, 4) + 0e0 AS lon FROM kept"
)
def densified_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vertices of each event's way to one place, with points along the great circle."""
    track = F.array(F.struct("lat", "lon"), F.struct(F.lit(_PARIS[0]).alias("lat"), F.lit(_PARIS[1]).alias("lon")))
    spread = points(spark, sf_dir).select("event_id", F.posexplode(densify.densify(track, 1.02)).alias("k", "p"))
    return spread.select("event_id", (F.col("k") + 1).alias("k"), (F.round("p.lat", 4) + 0.0).alias("lat"), (F.round("p.lon", 4) + 0.0).alias("lon"))
