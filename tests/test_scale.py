"""Joins and filters at size: what is compared and what is sent stays small, and no row is lost by it."""

import math
import random

from pyspark.sql import functions as F

from quadrille.functions import codec, hierarchy
from quadrille.operators import bloom, match
from quadrille.operators.graph import saved


def _far(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    s = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return math.degrees(2 * math.asin(min(1.0, math.sqrt(s)))) * 111120.0


def test_radius_search_against_all_pairs(spark):
    rng = random.Random(4)
    for metres in (60.0, 30_000.0, 900_000.0, 8_000_000.0, 15_000_000.0):
        north = metres / 111120.0
        # around the poles, the date line and elsewhere
        sites = [(89.9997, 10.0), (-89.9997, -170.0), (90.0, 0.0), (0.0, 179.9999), (12.0, -180.0), (84.0, 3.0), (-61.0, 100.0)]
        spots = [(max(-90.0, min(90.0, a + rng.uniform(-1.2, 1.2) * north)), (b + rng.uniform(-1.2, 1.2) * min(180.0, north / max(math.cos(math.radians(a)), 1e-5)) + 540) % 360 - 180) for a, b in sites for _ in range(40)]
        points = spark.createDataFrame([(k, *p) for k, p in enumerate(spots)], "id long, lat double, lon double").withColumn("hh", codec.encode(F.col("lat"), F.col("lon")))
        centers = spark.createDataFrame([(k, *c) for k, c in enumerate(sites)] + [(0, *sites[0])], "center_id long, lat double, lon double")
        got = [(r["id"], r["center_id"]) for r in match.within(points, centers, metres).collect()]
        want = {(k, j) for k, p in enumerate(spots) for j, c in enumerate(sites) if _far(*p, *c) <= metres}
        assert len(got) == len(set(got)) and set(got) == want and want


def test_radius_search_sends_no_side_whole(spark, sf_dir):
    from quadrille import catalog

    plan = catalog.QUERIES["radius_search"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_neighbours_as_rows(spark):
    cells = spark.range(200).select(codec.at_resolution(F.xxhash64("id"), 8).alias("cell")).union(spark.createDataFrame([(0,), (codec.signed(0xFFFF << 48),)], "cell long"))
    want = cells.select(F.explode(F.array("cell", *[hierarchy.neighbour(F.col("cell"), 8, d) for d in hierarchy.DIRECTIONS])).alias("cell"))
    assert sorted(r[0] for r in hierarchy.with_neighbours(cells, 8).collect()) == sorted(r[0] for r in want.collect())
    assert "transform(" not in hierarchy.with_neighbours(cells, 8)._jdf.queryExecution().toString()


def test_filter_is_read_once_and_ancestors_count(spark):
    layout = bloom.Layout(max_res=8)
    points = spark.range(300).select(F.when(F.col("id") % 2 == 0, F.lit("a")).alias("k"), F.xxhash64("id").alias("hh"))
    bits = saved(bloom.build(points, layout, keys=["k"]))
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    own = points.select("k", F.lit(10).alias("res"), codec.at_resolution(F.col("hh"), 10).alias("cell"))
    asked = own.unionByName(own.withColumn("res", F.lit(4)).withColumn("cell", codec.at_resolution(F.col("cell"), 4)))
    told = bloom.contains(asked, bits.mapInArrow(count, bits.schema), layout, hierarchy=True, keys=["k"]).collect()
    assert len(told) == 600 and all(r["member"] for r in told)
    assert read.value == bits.count()
    # without the coarsest bits nothing is a member any more where ancestors count, but is where they don't
    none = bits.filter("generation >= 0")
    assert not any(r["member"] for r in bloom.contains(own, none, layout, hierarchy=True, keys=["k"]).collect())
    assert all(r["member"] for r in bloom.contains(own, none, layout, keys=["k"]).collect())
