"""Reduction, rings, polygon scans, descent and densified lines against plain versions."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quadrille.functions import codec, densify
from quadrille.operators import cover, descend, render
from quadrille.operators import coverage as cov
from tests.test_coverage import hexes, of

RING = "shape_id string, ring array<struct<y: bigint, x: bigint>>"
UNITS = codec.UNITS


def plain_reduced(cells, count):
    cells = {c for c in cells if not any(c[:k] in cells for k in range(1, len(c)))}

    def climb(digits, least):
        kids = defaultdict(set)
        for c in cells:
            if len(c) == digits:
                kids[c[:-1]].add(c)
        for up, some in kids.items():
            if len(some) >= least:
                cells.difference_update(some)
                cells.add(up)

    for digits in range(16, 1, -1):
        climb(digits, 16)
    for digits in range(16, 1, -1):
        for least in range(15, 0, -1):
            if len(cells) <= count:
                return cells
            climb(digits, least)
    return cells


def random_shapes(seed):
    draw = random.Random(seed)
    shapes = {}
    for k in range(5):
        some = {"".join(draw.choice("0123456789abcdef"[: draw.choice((3, 16))]) for _ in range(draw.randint(2, 5))) for _ in range(draw.choice((3, 40, 300)))}
        full = {"ab" + x + y for x in "0123456789abcdef" for y in "0123456789abcdef" if draw.random() < 0.95}
        shapes[f"s{k}"] = some | full if k % 2 else some
    return shapes


@pytest.mark.parametrize("count", [1, 30, 200])
def test_shapes_are_reduced_together(spark, count):
    shapes = random_shapes(count)
    rows = cov.from_hex(spark.createDataFrame([(k, h) for k, s in shapes.items() for h in s], "shape_id string, hex string"))
    got = defaultdict(set)
    for r in cov.reduce_cells(rows, count).select("shape_id", cov.hex_of(F.col("res"), F.col("cell")).alias("hex")).collect():
        got[r["shape_id"]].add(r["hex"])
    assert got == {k: plain_reduced(set(s), count) for k, s in shapes.items()}
    assert cov.reduce_cells(rows.limit(0), count).count() == 0


def box_of(hexed):
    """South-west corner and side of a cell."""
    y = x = 0
    for c in hexed.ljust(16, "0"):
        d = int(c, 16)
        y, x = y << 2 | (d >> 3 & 1) << 1 | d >> 1 & 1, x << 2 | (d >> 2 & 1) << 1 | d & 1
    return y, x, 1 << (32 - 2 * len(hexed))


def plain_rings(cells):
    """Rings of corners by walking unit sides, the left one first; each from its least corner."""
    unit = min(box_of(c)[2] for c in cells)
    sides = set()
    for c in cells:
        y, x, s = box_of(c)
        n = s // unit
        y, x = y // unit, x // unit
        around = [((y, x + k), (y, x + k + 1)) for k in range(n)] + [((y + k, x + n), (y + k + 1, x + n)) for k in range(n)]
        around += [((y + n, x + n - k), (y + n, x + n - k - 1)) for k in range(n)] + [((y + n - k, x), (y + n - k - 1, x)) for k in range(n)]
        for a, b in around:
            if (b, a) in sides:
                sides.remove((b, a))
            else:
                sides.add((a, b))
    leaving = defaultdict(list)
    for a, b in sides:
        leaving[a].append(b)
    rings = set()
    while sides:
        a, b = side = min(sides)
        ring = []
        while side in sides:
            sides.remove(side)
            a, b = side
            dy, dx = b[0] - a[0], b[1] - a[1]
            nxt = next((b[0] + p, b[1] + q) for p, q in ((dx, -dy), (dy, dx), (-dx, dy)) if (b[0] + p, b[1] + q) in leaving[b])
            if (nxt[0] - b[0], nxt[1] - b[1]) != (dy, dx):
                ring.append((b[0] * unit, b[1] * unit))
            side = (b, nxt)
        least = ring.index(min(ring))
        rings.add(tuple(ring[least:] + ring[:least]))
    return rings


@pytest.mark.parametrize("seed", range(2))
def test_rings_by_walking(spark, seed):
    draw = random.Random(seed)
    cells = {"c" + "".join(draw.choice("0123456789abcdef") for _ in range(draw.choice((1, 2)))) for _ in range(60)}
    cells = {c for c in cells if not any(c[:k] in cells for k in range(1, len(c)))}
    got = {}
    for r in render.ring_sides(of(spark, *cells)).collect():
        got.setdefault((r["ring_y"], r["ring_x"]), []).append((-r["ahead"] if r["ahead"] else -(10**9), r["y"], r["x"]))
    assert {tuple((y, x) for _, y, x in sorted(v)) for v in got.values()} == plain_rings(cells)
    assert all(min((y, x) for _, y, x in v) == k for k, v in got.items())


def test_rings_turn_around_holes(spark):
    frame = [f"c{d}" for d in "0123456789abcdef" if d not in "3"]
    rings = {r["outer"]: r for r in render.envelope(of(spark, *frame)).collect()}
    cell = 180 / 16 * 360 / 16
    assert rings[True]["area"] == pytest.approx(16 * cell) and rings[False]["area"] == pytest.approx(-cell)
    assert len(rings[True]["points"]) == len(rings[False]["points"]) == 5


def test_rim_rows_do_not_go_with_lengths(spark):
    rows = render.rim(of(spark, "c", "9" + "5" * 15))
    assert rows.count() <= 12
    assert [len(r["points"]) for r in render.envelope(of(spark, "c", "9" + "5" * 15)).collect()] == [7]  # the smallest cell stands beside the largest, on one level


def star(draw, corners, size, grid):
    cy, cx = (draw.randrange(UNITS // 4, 3 * UNITS // 4) for _ in range(2))
    at = lambda of, i: int(of(2 * math.pi * i / corners) * size * draw.uniform(0.3, 1))
    return [((cy + at(math.sin, i)) // grid * grid, (cx + at(math.cos, i)) // grid * grid) for i in range(corners)]


def touches(ring, y, x, s):
    """Whether a side has a point in the open square."""
    for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1], strict=True):
        low, high = 0.0, 1.0
        for p, q, border in ((a, c, y), (b, d, x)):
            if p == q:
                if not border < p < border + s:
                    low = 2.0
            else:
                t = sorted(((border - p) / (q - p), (border + s - p) / (q - p)))
                low, high = max(low, t[0]), min(high, t[1])
        if low < high:
            return True
    return False


def odd(rings, y, x):
    return sum((a > y) != (c > y) and x < b + (y - a) * (d - b) / (c - a) for ring in rings for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1], strict=True)) % 2 == 1


@pytest.mark.parametrize("seed", range(3))
def test_polygon_scan_and_descent_have_the_plain_cells(spark, seed):
    draw = random.Random(seed)
    ring = star(draw, draw.choice((3, 7, 25)), UNITS // 9, 1 if seed else 1 << 22)
    res, s = 8, 1 << 24
    low = [min(v[k] for v in ring) // s * s for k in (0, 1)]
    high = [max(v[k] for v in ring) for k in (0, 1)]
    cells = [(y, x) for y in range(low[0], high[0] + 1, s) for x in range(low[1], high[1] + 1, s)]
    inside = {c for c in cells if touches(ring, *c, s) or odd([ring], c[0] + s / 2, c[1] + s / 2)}
    place = lambda df: {box_of(h)[:2] for h in hexes(df)}
    fine = cov.normalize(descend.cover_geometry(spark.createDataFrame([("a", ring)], RING), 2, res), res)
    assert place(fine) == inside
    scanned = place(cover.polygons(spark.createDataFrame([("a", res, ring)], "shape_id string, res int, ring array<struct<y: bigint, x: bigint>>")))
    # the scan takes cells whose border a side lies on too, and a corner's place is cut to whole units
    assert inside - scanned == set() or all(not odd([ring], y + s / 2, x + s / 2) for y, x in inside - scanned)
    near = lambda c: touches(ring, c[0] - 2, c[1] - 2, s + 4)
    assert all(near(c) for c in scanned - inside)


def test_holes_and_several_rings_in_descent(spark):
    rings = [[(1 << 31, 1 << 30), (1 << 31, 3 << 30), (3 << 30, 3 << 30), (3 << 30, 1 << 30)], [(9 << 28, 6 << 28), (9 << 28, 9 << 28), (11 << 28, 8 << 28)], [(1 << 28, 1 << 28), (2 << 28, 3 << 28), (3 << 28, 1 << 28)]]
    got = cov.normalize(descend.cover_geometry(spark.createDataFrame([("a", r) for r in rings], RING), 2, 6), 6)
    s = 1 << 26
    want = {(y, x) for y in range(0, 13 << 28, s) for x in range(0, 13 << 28, s) if any(touches(r, y, x, s) for r in rings) or odd(rings, y + s / 2, x + s / 2)}
    assert {box_of(h)[:2] for h in hexes(got)} == want


def test_rings_of_many_corners_are_scanned(spark):
    n = 50_000
    ring = [(int(UNITS / 2 + UNITS / 8 * (1 + 0.3 * math.sin(50 * t)) * math.sin(t)), int(UNITS / 2 + UNITS / 8 * (1 + 0.3 * math.sin(50 * t)) * math.cos(t))) for t in (2 * math.pi * k / n for k in range(n))]
    cells = cover.polygons(spark.createDataFrame([("a", 10, ring)], "shape_id string, res int, ring array<struct<y: bigint, x: bigint>>"))
    area = abs(sum(a * d - b * c for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1], strict=True))) / 2
    assert 1 <= cells.count() * 4.0**22 / area < 1.15  # cells on the rim count whole


def plain_ratio(a, b):
    p, q, turn = math.radians(a[0]), math.radians(b[0]), math.radians(b[1] - a[1])
    arc = 2 * math.asin(min(1.0, math.sqrt(math.sin((p - q) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(turn / 2) ** 2)))
    stretch = math.cos(p) if abs(q - p) < 1e-15**0.5 else (q - p) / math.log(math.tan(q / 2 + math.pi / 4) / math.tan(p / 2 + math.pi / 4))
    return math.hypot(q - p, stretch * turn) / arc if arc else 1.0


def test_dense_lines_keep_to_the_ratio(spark):
    draw = random.Random(9)
    lines = [[(draw.uniform(-80, 80), draw.uniform(-180, 180)) for _ in range(draw.randint(0, 4))] for _ in range(40)] + [[(10.0, 20.0), (10.0, 20.0)], [(0.0, -179.0), (5.0, 179.0)]]
    for delta in (1.001, 1.1):
        for line, dense in zip(lines, densify.densified(lines, delta), strict=True):
            assert [p for p in dense if p in line] == [p for k, p in enumerate(line)] or len(set(line)) < len(line)
            assert all(plain_ratio(a, b) < delta and abs(b[1] - a[1]) <= 180 for a, b in zip(dense, dense[1:], strict=False))
    alone = densify.densified([[(60.0, 0.0), (60.0, 90.0)]], 1.2)[0]
    assert len(alone) == 2  # the parallel is 1.09 times as long
    middle = densify.densified([[(60.0, 0.0), (60.0, 90.0)]], 1.05)[0][1]
    assert middle[1] == pytest.approx(45) and middle[0] == pytest.approx(67.79, abs=0.01)
    df = spark.createDataFrame([(1, [(60.0, 0.0), (60.0, 90.0)]), (2, None), (3, [])], "id int, track array<struct<lat: double, lon: double>>")
    got = {r["id"]: r["d"] for r in df.select("id", densify.densify(F.col("track"), 1.05).alias("d")).collect()}
    assert got[2] is None and got[3] == [] and len(got[1]) == 3
    with pytest.raises(ValueError):
        densify.densify(F.col("track"), 1.0)
