import pytest
from pyspark.sql import functions as F

from quadrille.functions import codec, geohash, hierarchy, measure, resolution
from quadrille.plans import areas


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


POINTS = [
    (48.0, -4.5, "b570707070707070"),
    (0.0, 0.0, "c000000000000000"),
    (-90.0, -180.0, "0000000000000000"),
    (90.0, 180.0, "eaaaaaaaaaaaaaaa"),
]


def test_encode_known_points_and_wraps(spark):
    rows = spark.createDataFrame([(a, b) for a, b, _ in POINTS], "lat double, lon double")
    got = [r[0] for r in rows.select(codec.to_hex(codec.encode(F.col("lat"), F.col("lon")))).collect()]
    assert got == [h for *_, h in POINTS]
    code = lambda a, b: codec.encode(F.lit(float(a)), F.lit(float(b)))
    for a, b in [((0, 181), (0, -179)), ((0, -181), (0, 179)), ((91, 179), (89, -1)), ((91, 181), (89, 1))]:
        x, y = one(spark, code(*a), code(*b))
        assert x == y


def test_decode_is_the_inverse(spark):
    pts = spark.range(500).select(F.xxhash64("id").alias("hh"))
    back = pts.select("hh", codec.encode_units(codec.y_of(F.col("hh")), codec.x_of(F.col("hh"))).alias("again"))
    assert back.filter("hh <> again").count() == 0
    assert pts.filter(codec.from_hex(codec.to_hex(F.col("hh"))) != F.col("hh")).count() == 0
    assert pts.filter(codec.from_bytes(codec.to_bytes(F.col("hh"))) != F.col("hh")).count() == 0


def test_neighbours_wrap(spark):
    code = lambda h: codec.from_hex(F.lit(h))
    got = one(
        spark,
        codec.to_hex(hierarchy.neighbour(code("aaaaaaaaaaaaaaaa"), 32, "n")),
        codec.to_hex(hierarchy.neighbour(code("0"), 32, "s")),
        codec.to_hex(hierarchy.neighbour(code("5555555555555555"), 32, "e")),
    )
    assert tuple(got) == ("eaaaaaaaaaaaaaaa", "4000000000000000", "0000000000000000")


def test_geocells_parents_and_children(spark):
    code = codec.from_hex(F.lit("1234567890abcdef"))
    got = one(spark, *[codec.to_hex(hierarchy.geocell(code, r)).alias(f"r{r}") for r in (2, 4, 30, 0, 5, 31, 32, -2)])
    assert list(got) == ["1100000000000000", "2120000000000000", "f1234567890abcde"] + ["0" * 16] * 5
    cell = codec.from_hex(F.lit("f123456789abcdef"))
    chain = []
    for _ in range(14):
        cell = hierarchy.geocell_parent(cell)
        chain.append(one(spark, codec.to_hex(cell))[0])
        cell = codec.from_hex(F.lit(chain[-1]))
    assert chain[0] == "e123456789abcde0"
    assert chain[-1] == "1100000000000000"
    children = one(spark, hierarchy.geocell_children(codec.from_hex(F.lit("1100000000000000"))))[0]
    assert [f"{c & (1 << 64) - 1:016x}" for c in children] == [f"21{d:x}0000000000000" for d in range(16)]


def test_packed_bytes(spark):
    code = codec.from_hex(F.lit("1234567897abcdef"))
    want = {2: "10", 6: "1230", 18: "1234567890", 32: "1234567897abcdef"}
    for r, h in want.items():
        assert one(spark, codec.packed_bytes(code, r))[0].hex() == h
    for r in (0, 1, 3, 33, 34):
        assert one(spark, codec.packed_bytes(code, r))[0] is None


@pytest.mark.parametrize(
    ("a", "b", "arc", "flat"),
    [
        ((48.0, -4.55), (48.0, -4.50), 3717.688116, 3717.688181),
        ((48.0, -4.55), (49.0, -4.55), 111119.998033, 111119.998033),
        ((48.0, -4.55), (-48.0, 4.55), 10703606.805314, 10715339.110828),
    ],
)
def test_distances(spark, a, b, arc, flat):
    p, q = (codec.encode(F.lit(x[0]), F.lit(x[1])) for x in (a, b))
    got = one(spark, measure.great_circle(p, q), measure.mean_latitude_distance(p, q))
    assert got[0] == pytest.approx(arc, abs=1e-2)
    assert got[1] == pytest.approx(flat, abs=1e-2)


def test_geohash_known_values(spark):
    code = codec.from_hex(F.lit("b570702e87ffd5d0"))
    assert one(spark, geohash.encode(code))[0] == "gbsc07bczzpf"
    got = one(spark, *[geohash.decode(F.lit(g)) for g in ("ezs42", "u4pruydqqvj", "a", "")])
    assert list(got) == [-6921889690756841472, -2155044206010576640, None, None]


def test_polyline_known_values():
    got = areas.decode_polyline("_p~iF~ps|U_ulLnnqC_mqNvxq`@")
    assert [y for y, _ in got] == [3066129430, 3118623475, 3179516567]
    assert [x for _, x in got] == [713441789, 704493941, 638840593]


def test_area_text_that_is_no_area():
    for text in ("circle:1:2", "polygon:1:2,3:4", "rect:a:b,c:d", "cube:1", "", "path:1:2:5"):
        assert areas.parse_area(text).polygons == ()
    assert [s for s, _ in areas.parse_expression("-circle:0:0:5 +circle:1:1:5 -circle:1:1:2 &rect:0:0,1:1")] == ["+", "-", "&"]


def test_resolution_choice_stays_even_and_in_range():
    for box in ((0, 0, 1, 1), (0, 0, 1 << 31, 1 << 20), (5, 5, 5, 5), (0, 0, (1 << 32) - 1, (1 << 32) - 1)):
        for offset in (0, -4, -10):
            assert resolution.for_polygon(box, offset) in codec.RESOLUTIONS
        assert resolution.for_polyline(box) in codec.RESOLUTIONS
