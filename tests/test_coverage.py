import random

from pyspark.sql import functions as F

from quadrille import cover_cli
from quadrille.functions import codec
from quadrille.operators import bloom, cover, expressions, match, render
from quadrille.operators import coverage as cov


def of(spark, *cells, shape="s"):
    return cov.from_hex(spark.createDataFrame([(shape, c) for c in cells], "shape_id string, hex string"))


def hexes(df):
    return {r[0] for r in df.select(cov.hex_of(F.col("res"), F.col("cell"))).collect()}


def test_optimize_thresholds(spark):
    assert hexes(cov.optimize(of(spark, "a0", "a1", "a2", "a3"), 0x0500000000000000)) == {"a0", "a1", "a2", "a3"}
    assert hexes(cov.optimize(of(spark, "a0", "a1", "a2", "a3"), 0x0400000000000000)) == {"a"}
    assert hexes(cov.optimize(of(spark, "a", "a00", "a01", "a02", "a03"))) == {"a"}
    assert hexes(cov.optimize(of(spark, *[f"b{d:x}{e:x}" for d in range(16) for e in range(16)]))) == {"b"}


def test_prune(spark):
    five = ("11", "12", "13", "14", "15")
    assert len(hexes(cov.prune(of(spark, *five), 0x0400000000000000))) == 5
    assert hexes(cov.prune(of(spark, *five), 0x0500000000000000)) == set()


def test_normalize_minus_intersect(spark):
    assert hexes(cov.normalize(of(spark, "f"), 4)) == {f"f{d:x}" for d in range(16)}
    assert hexes(cov.minus(of(spark, "0"), of(spark, "00"))) == {f"0{d:x}" for d in range(1, 16)}
    left = cov.minus(of(spark, "0"), of(spark, "000000"))
    assert left.count() == 75 and left.select("res").distinct().count() == 5
    assert hexes(cov.intersect(of(spark, "0"), of(spark, "000000"))) == {"000000"}
    assert hexes(cov.intersect(of(spark, "0"), of(spark, "f"))) == set()
    assert hexes(expressions.minus_exact(of(spark, "b"), of(spark, "bb"))) == {"b"}


def test_algebra_against_leaves(spark):
    rng = random.Random(4)
    pick = lambda: {"".join(rng.choice("012f") for _ in range(rng.randrange(1, 4))) for _ in range(12)}
    leaves = lambda cells: {c + t for c in cells for t in tails(3 - len(c))}

    def tails(n):
        return [""] if n == 0 else [a + b for a in "0123456789abcdef" for b in tails(n - 1)]

    a, b = pick(), pick()
    x, y = of(spark, *a), of(spark, *b)
    assert leaves(hexes(cov.minus(x, y))) == leaves(a) - leaves(b)
    assert leaves(hexes(cov.intersect(x, y))) == leaves(a) & leaves(b)
    assert leaves(hexes(cov.union(x, y))) == leaves(a) | leaves(b)
    assert leaves(hexes(cov.dedup(x))) == leaves(a)


def test_geocell_round_trip_and_bytes(spark):
    x = of(spark, "a", "b01", "c0ffee")
    assert hexes(cov.from_geocells(cov.to_geocells(x))) == {"a", "b01", "c0ffee"}
    assert hexes(cov.deserialize(cov.serialize(x))) == {"a", "b01", "c0ffee"}


def test_reduce_and_limit(spark):
    x = of(spark, *[f"a{d:x}{e:x}" for d in range(4) for e in range(9)])
    assert 0 < cov.reduce_cells(x, 5).count() <= 5
    assert hexes(cov.limit_levels(x, 2, 4)) == {f"a{d:x}" for d in range(4)}


def test_polygon_known_size(spark):
    # fixed values: a polygon and the numbers of its cells
    ring = [(51.344338660599234, 2.548828125), (48.574789910928864, -5.537109375), (43.45291889355465, -1.93359375),
            (42.09822241118974, 3.515625), (43.89789239125797, 8.876953125), (49.0954521625348, 8.701171875)]
    text = "polygon:" + ",".join(f"{a}:{b}" for a, b in ring)
    cells = cov.optimize(cover.definitions(spark, [("w", text, 12)]))
    counts = {r["res"]: r["cells"] for r in cov.cardinalities(cells).collect()}
    assert counts == {6: 1, 8: 57, 10: 273, 12: 1064}


def test_rectangles(spark):
    box = lambda *b: spark.createDataFrame([("r", 4, *b)], "shape_id string, res int, swy bigint, swx bigint, ney bigint, nex bigint")
    half, last = 1 << 31, (1 << 32) - 1
    assert hexes(cov.optimize(cover.rectangles(box(half, half, last, last)))) == {"c", "d", "e", "f"}
    # ten degrees over the date line
    over = last + 1 + int(10 / codec.LON_UNIT)
    assert "8" in {h[0] for h in hexes(cover.rectangles(box(half, half, last, over)))}


def test_lines_touch_every_cell_between(spark):
    seg = spark.createDataFrame([("l", 6, 1 << 31, 1 << 30, 1 << 31, 3 << 30)], "shape_id string, res int, y1 bigint, x1 bigint, y2 bigint, x2 bigint")
    # fixed values: the cells of a line along the equator
    want = "900 c45 940 c05 944 c01 904 c41 c44 901 c04 941 c00 945 c40 905 911 c54 951 c14 955 c10 915 c50 c55 910 c15 950 c11 954 c51 914"
    assert hexes(cover.lines(seg)) == set(want.split())


def test_points_join_every_level(spark):
    pts = spark.range(400).select("id", F.xxhash64("id").alias("hh"))
    cells = of(spark, "a", "b0", "c12")
    inside = {r[0] for r in pts.filter(F.substring(codec.to_hex(F.col("hh")), 1, 1) == "a").select("id").collect()}
    got = {r[0] for r in match.semi_join(pts, cells).select("id").collect()}
    assert inside <= got and match.anti_join(pts, cells).count() == 400 - len(got)


def test_clusters_and_rings(spark):
    x = of(spark, "c0", "c1", "c4", "ff")
    labels = {r["cluster"] for r in cov.clusters(x).collect()}
    assert len(labels) == 2
    rings = render.envelope(of(spark, *[f"c{d}" for d in "0123467"], "c8", "c9")).collect()
    assert sum(r["area"] for r in rings) > 0
    assert render.geojson(x).first()["geojson"].startswith('{"type":"MultiPolygon"')


def test_bloom_has_no_false_negative(spark):
    layout = bloom.Layout(max_res=10)
    pts = spark.range(300).select(F.xxhash64("id").alias("hh"))
    bits = bloom.build(pts, layout)
    cells = pts.select(F.lit(10).alias("res"), codec.at_resolution(F.col("hh"), 10).alias("cell"))
    assert bloom.contains(cells, bits, layout, hierarchy=True).filter("not member").count() == 0
    other = spark.range(1000, 3000).select(F.lit(10).alias("res"), codec.at_resolution(F.xxhash64("id"), 10).alias("cell"))
    assert bloom.contains(other, bits, layout).filter("member").count() < 200


def test_bloom_query_holds_all_events(spark, sf_dir):
    from quadrille import catalog

    member = {r["hex"]: r["member"] for r in catalog.QUERIES["bloom_membership"](spark, sf_dir).collect()}
    own = {r["hex"][:6] for r in catalog.QUERIES["point_encode"](spark, sf_dir).select("hex").collect()}
    assert own <= {h[:6] for h, m in member.items() if m}
    others = [m for h, m in member.items() if h[:6] not in own]
    assert len(others) > len(own) and sum(others) < 0.1 * len(others)


def test_large_coverages_are_shuffled_to_the_same_rows(spark, monkeypatch):
    points = spark.range(300).select("id", (F.xxhash64("id")).alias("hh"))
    wanted = points.filter("id < 40").select(F.lit("a").alias("shape_id"), F.when(F.col("id") % 2 == 0, 4).otherwise(8).alias("res"), "hh")
    cells = cov.align(wanted.withColumnRenamed("hh", "cell"))
    small = [sorted(r["id"] for r in f(points, cells).collect()) for f in (match.semi_join, match.anti_join)]
    assert "Exchange hashpartitioning(hh" not in match.semi_join(points, cells)._jdf.queryExecution().toString()
    monkeypatch.setattr(match, "BROADCAST_CELLS", 3)
    assert [sorted(r["id"] for r in f(points, cells).collect()) for f in (match.semi_join, match.anti_join)] == small
    assert sorted(small[0] + small[1]) == list(range(300)) and len(small[0]) >= 40
    assert match.semi_join(points, cells.limit(0)).count() == 0 and match.anti_join(points, cells.limit(0)).count() == 300


def test_rectangles_to_take_away_are_no_options(spark, tmp_path):
    assert cover_cli.main(["--out", f"{tmp_path}/x", "-r", "6", "+rect:0:0,20:20", "-rect:0:0,5:5"]) == 0
    got = {r["value"] for r in spark.read.text(f"{tmp_path}/x").collect()}
    assert cover_cli.main(["--out", f"{tmp_path}/y", "--res", "6", "+rect:0:0,20:20"]) == 0
    whole = expressions.read_lines(spark, f"{tmp_path}/y")
    taken = match.has_cell(cov.normalize(whole, 8), cov.normalize(expressions.read_lines(spark, f"{tmp_path}/x"), 8).select("res", "cell"))
    assert 0 < taken.count() < cov.normalize(whole, 8).count() and got


def test_literal_rectangles_are_compact(spark, monkeypatch):
    rng = random.Random(5)
    defs = []
    for k in range(6):
        y, x = sorted(rng.uniform(-80, 80) for _ in range(2)), sorted(rng.uniform(-170, 170) for _ in range(2))
        defs.append((f"s{k}", f"rect:{y[0]}:{x[0]},{y[1]}:{x[1]}", rng.choice((4, 6, 8))))
    rows = lambda df: sorted(tuple(r) for r in df.select("shape_id", "res", "cell").collect())
    want = rows(cov.optimize(cover.definitions(spark, defs)))
    assert rows(cover.compact(spark, defs)) == want
    monkeypatch.setattr(cover, "LITERAL_CELLS", 0)
    assert rows(cover.compact(spark, defs)) == want
    assert rows(cover.compact(spark, [("w", "rect:-90:-180,90:180", 8)])) == [("w", 2, codec.signed(k << 60)) for k in sorted(range(16), key=lambda k: codec.signed(k << 60))]
