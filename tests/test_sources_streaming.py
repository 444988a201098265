from pyspark.sql import functions as F

from quadrille import cover_cli
from quadrille.functions import codec
from quadrille.operators import coverage as cov
from quadrille.operators import cover, descend, expressions
from quadrille.sources import points, wkt
from quadrille.streaming import activity


def hexes(df):
    return {r[0] for r in df.select(cov.hex_of(F.col("res"), F.col("cell"))).collect()}


def test_cycles_are_the_same_as_a_stream(spark, sf_dir, tmp_path):
    pts = points.of_events(spark.read.parquet(f"{sf_dir}/events.parquet")).select("ts", "hh", F.round("value", 2).alias("value")).orderBy("ts")
    pts.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = activity.cycles(spark.readStream.schema(pts.schema).parquet(str(tmp_path / "in")), late="3650 days")
    run = stream.writeStream.format("memory").queryName("cycles").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    of = lambda df: sorted((r["start"], r["hex"], r["events"]) for r in df.collect())
    assert of(spark.table("cycles")) == of(activity.cycles(pts))


def test_gazetteer_and_hex_lines(spark, tmp_path):
    (tmp_path / "g.txt").write_text("RC\tUFI\tUNI\tLAT\tLONG\n1\t2\t3\t48.0\t-4.5\tx\n1\t2\t3\tbad\t-4.5\tx\n")
    assert [r["hex"] for r in points.read_gazetteer(spark, str(tmp_path / "g.txt")).collect()] == ["b570707070707070"]
    (tmp_path / "h.txt").write_text("b570707070707070\nnot hex\n\n")
    assert points.read_hex_lines(spark, str(tmp_path / "h.txt")).count() == 1


def test_partitioned_points_are_pruned(spark, tmp_path):
    pts = spark.range(200).select("id", F.xxhash64("id").alias("hh"))
    points.write_partitioned(pts, str(tmp_path / "p"), 2)
    some = points.read_partitioned(spark, str(tmp_path / "p"), ["a", "b"])
    assert some.count() == pts.filter(codec.to_hex(F.col("hh"), 2).isin("a", "b")).count()
    assert "PartitionFilters: [" in some._jdf.queryExecution().toString()


def test_wkt_and_descent(spark):
    rows = spark.createDataFrame([("t", 10, "POLYGON((-4.5 48.0, -4.5 49.0, -4.0 48.0, -4.5 48.0))"), ("x", 10, "POINT(1 2)")], "shape_id string, res int, wkt string")
    rings = wkt.rings(rows)
    assert [(r["shape_id"], len(r["ring"])) for r in rings.collect()] == [("t", 3)]
    flat, deep = hexes(cover.polygons(rings)), hexes(cov.normalize(descend.cover_geometry(rings, 2, 10), 10))
    assert deep <= flat
    assert hexes(descend.cover_geometry(rings, 2, 14, inside_only=True)) and descend.cover_geometry(rings, 2, 14, max_cells=1).count() == 0


def test_wkt_with_holes(spark):
    rows = spark.createDataFrame(
        [("h", "polygon((0 0, 20 0, 20 20, 0 20, 0 0),(5 5, 15 5, 15 15, 5 15))"), ("m", "MULTIPOLYGON(((0 0, 2 0, 2 2, 0 0)), ((9 9, 9 8, 8 8, 9 9)))"), ("p", "POINT(1 2)"), ("n", None), ("e", "POLYGON EMPTY")],
        "shape_id string, wkt string",
    )
    rings = wkt.geometry_rings(rows)
    assert sorted((r["shape_id"], len(r["ring"])) for r in rings.collect()) == [("h", 4), ("h", 4), ("m", 3), ("m", 3)]
    limits = {r["shape_id"]: r["limit"] for r in descend.error_limits(rings, 0.1).collect()}
    assert limits["h"] < limits["m"]  # the larger shape is allowed larger cells
    assert {r["res"] for r in descend.uniform_shape_for_error(rings.filter("shape_id = 'h'"), 0.1).collect()} == {limits["h"]}


def test_areas_from_a_table(spark):
    texts = {"r": ("rect:0:0,5:5", 8), "c": ("circle:10:10:50000", 0), "p": ("path:48.0:-4.5:5000,45.0:5.0", 12), "bad": ("rect:1", 8), "none": (None, 8)}
    defs = spark.createDataFrame([(k, t, r) for k, (t, r) in texts.items()], "shape_id string, def string, res int")
    got = cover.from_table(defs)
    want = cover.definitions(spark, [(k, t or "", r) for k, (t, r) in texts.items()])
    rows = lambda df: {tuple(r) for r in df.select("shape_id", "res", "cell").collect()}
    assert rows(got) == rows(want) and {r[0] for r in rows(got)} == {"r", "c", "p"}


def test_stepped_line_is_a_thin_part_of_the_whole_line(spark):
    ends = [("a", 8, 1 << 31, 1 << 31, 3 << 30, (1 << 31) + 12345), ("b", 8, 1 << 31, 3 << 30, 5 << 28, 1 << 29), ("dot", 8, 77, 99, 77, 99)]
    segments = spark.createDataFrame(ends, "shape_id string, res int, y1 bigint, x1 bigint, y2 bigint, x2 bigint")
    for name, _, y1, x1, y2, x2 in ends:
        one = segments.filter(F.col("shape_id") == name)
        steps = max(abs((y1 >> 24) - (y2 >> 24)), abs((x1 >> 24) - (x2 >> 24))) + 1
        thin = hexes(cover.stepped_lines(one))
        assert len(thin) == steps and len(thin - hexes(cover.lines(one))) <= 1  # the end itself may be left out there


def test_command_line_and_text(spark, tmp_path):
    (tmp_path / "terms").write_text("+rect:0:0,10:10 -rect:0:0,5:5")
    cover_cli.main(["--out", str(tmp_path / "out"), "--kml", str(tmp_path / "kml"), "--res", "8", f"@{tmp_path / 'terms'}"])
    cells = expressions.read_lines(spark, str(tmp_path / "out"))
    want = expressions.evaluate(spark, "+rect:0:0,10:10 -rect:0:0,5:5", 8)
    assert hexes(cells) == hexes(want) != set()
    assert spark.read.text(str(tmp_path / "kml")).first()[0].startswith("<?xml")
