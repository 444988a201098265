"""The kept index, shards, interval joins, filters by key and the table function."""

import random

import pytest
from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import functions as F

from quadrille.functions import codec, sql_tables
from quadrille.operators import bloom, cover, match
from quadrille.operators import coverage as cov
from quadrille.sources import points, shards
from quadrille.streaming import index
from tests.test_coverage import of


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_index_goes_on_where_it_broke_off(spark, sf_dir, tmp_path):
    events = points.of_events(spark.read.parquet(f"{sf_dir}/events.parquet")).select("event_id", "event_type", "hh", F.round("value", 2).cast("decimal(20,2)").alias("value"))
    put = lambda k: events.filter(F.pmod(F.xxhash64("event_id"), F.lit(5)) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    keep = lambda **more: index.keep(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), f"{tmp_path}/index", f"{tmp_path}/cp", ["event_type"], **more)
    for k in range(3):
        put(k)
    for broken in (1, 2):  # written, but not counted as done
        with pytest.raises(StreamingQueryException):
            keep(break_in=broken)
    keep()
    some = events.filter(F.pmod(F.xxhash64("event_id"), F.lit(5)) < 3)
    assert rows(index.read(spark, f"{tmp_path}/index", ["event_type"])) == rows(index._sums(some, ["event_type"], 8))
    for _ in range(2):
        index.compact(spark, f"{tmp_path}/index", ["event_type"])
    put(3)
    put(4)
    keep()
    assert rows(index.read(spark, f"{tmp_path}/index", ["event_type"])) == rows(index._sums(events, ["event_type"], 8))


def test_shards_are_bounded_and_pruned(spark, tmp_path):
    crowd = spark.range(2_000).select("id", codec.long(0x123456789ABCDEF0).alias("hh"))  # a third of all rows at one place
    rest = spark.range(2_000, 6_000).select("id", F.xxhash64("id").alias("hh"))
    pts = crowd.unionByName(rest)
    shards.write(pts, str(tmp_path), most_rows=300, finest=8)
    plan = {r["shard"]: r for r in spark.read.parquet(f"{tmp_path}/shards").collect()}
    assert sum(r["points"] for r in plan.values()) == 6_000 and all(r["points"] <= 300 or r["res"] == 8 for r in plan.values())
    assert not any(a != b and b.startswith(a) for a in plan for b in plan)
    stored = shards.read(spark, str(tmp_path))
    assert {r["shard"]: r["count"] for r in stored.groupBy("shard").count().collect()} == {k: r["points"] for k, r in plan.items()}
    crowded = next(k for k, r in plan.items() if r["points"] > 300)
    assert len(list((tmp_path / "points" / f"shard={crowded}").glob("part-*"))) >= 4
    cells = of(spark, "a", "12345", "b0000000")
    got = shards.in_cells(spark, str(tmp_path), cells)
    assert rows(got.select("id")) == rows(match.semi_join(pts, cells).select("id"))
    assert "dynamicpruning" in got._jdf.queryExecution().toString().lower()
    assert {r["shard"] for r in shards.routed(spark, str(tmp_path), cells).collect()} == {k for k in plan if any(k.startswith(c) or c.startswith(k) for c in ("a", "12345", "b0000000"))}


def test_intervals_find_what_levels_find(spark, monkeypatch):
    draw = random.Random(3)
    some = [(f"s{draw.randrange(4)}", "".join(draw.choice("0789f") for _ in range(draw.choice((1, 2, 3, 5, 16))))) for _ in range(300)] + [("s9", "f"), ("s9", "0"), ("s9", "7"), ("s9", "8")]
    cells = cov.from_hex(spark.createDataFrame(some, "shape_id string, hex string"))
    codes = [int("".join(draw.choice("0789f") for _ in range(16)), 16) for _ in range(800)] + [int(h.ljust(16, e), 16) for _, h in some for e in "0f"]
    pts = spark.createDataFrame([(k, codec.signed(c)) for k, c in enumerate(codes)] + [(-1, None)], "id long, hh long")
    want = rows(match.join_points(pts, cells))
    assert rows(match.join_intervals(pts, cells)) == want and want
    merged = match.intervals(cells).filter("shape_id = 's9'").count()
    assert merged == 64  # sixteen blocks for each of four cells of resolution 2
    assert match.join_intervals(pts, cells.limit(0)).count() == 0
    monkeypatch.setattr(match, "BROADCAST_INTERVALS", 3)
    assert rows(match.join_intervals(pts, cells)) == want


def test_filters_by_key(spark):
    layout = bloom.Layout(max_res=8, sizes=(50, 500, 5_000), errors=(0.01, 0.02, 0.03))
    pts = spark.range(3_000).select(F.when(F.col("id") < 10, F.lit("few")).when(F.col("id") < 2_900, F.lit("many")).alias("k"), F.xxhash64("id").alias("hh"))
    bits = bloom.build(pts, layout, keys=["k"])
    assert {(r["k"], r["generation"]) for r in bits.select("k", "generation").distinct().collect()} == {("few", -1), ("few", 0), ("many", -1), ("many", 2), (None, -1), (None, 1)}
    cells = pts.select("k", F.lit(8).alias("res"), codec.at_resolution(F.col("hh"), 8).alias("cell"))
    assert bloom.contains(cells, bits, layout, hierarchy=True, keys=["k"]).filter("not member").count() == 0
    other = spark.range(5_000, 9_000).select(F.lit("few").alias("k"), F.lit(8).alias("res"), codec.at_resolution(F.xxhash64("id"), 8).alias("cell"))
    assert bloom.contains(other, bits, layout, keys=["k"]).filter("member").count() < 200
    assert bloom.contains(other.withColumn("k", F.lit("none")), bits, layout, keys=["k"]).filter("member").count() == 0
    half = [bloom.build(pts.filter(F.pmod("hh", F.lit(2)) == k), bloom.Layout(max_res=8, sizes=(5_000,), errors=(0.03,)), keys=["k"]) for k in (0, 1)]
    whole = bloom.build(pts, bloom.Layout(max_res=8, sizes=(5_000,), errors=(0.03,)), keys=["k"])
    assert rows(bloom.merge(*half).select(*whole.columns)) == rows(whole)


def test_table_function_covers_as_the_plan_does(spark):
    sql_tables.register(spark)
    texts = ["circle:48.0:-4.5:50000", "path:48.0:-4.5:50000,45.0:5.0,40.0:20.0:80000", "polygon:51.3:2.5,48.5:-5.5,43.4:-1.9,42.0:3.5", "rect:10:170,20:175", "nonsense", None]
    areas = spark.createDataFrame([(str(k), t, 10) for k, t in enumerate(texts)], "shape_id string, def string, res int")
    areas.createOrReplaceTempView("areas_to_cover")
    got = spark.sql("SELECT a.shape_id, c.hex FROM areas_to_cover a, LATERAL grid_cover(a.def, a.res) c")
    want = cover.from_table(areas.filter("def is not null"))
    assert rows(got) == rows(want.select("shape_id", cov.hex_of(F.col("res"), F.col("cell")).alias("hex")))
    with pytest.raises(AnalysisException):
        spark.sql("SELECT * FROM grid_cover('rect:0:0,1:1', 7)")
