"""Cells, their ancestors, children and neighbours, as Column expressions.

A geocell packs a cell into one long: R/2 in the high four bits, the cell's first 60 bits below. It can't
hold resolution 32; relations of this library keep (res, cell) instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import codec

GEOCELL_RESOLUTIONS = tuple(range(2, 31, 2))
#: Steps to the north and to the east.
DIRECTIONS = {"n": (1, 0), "ne": (1, 1), "e": (0, 1), "se": (-1, 1), "s": (-1, 0), "sw": (-1, -1), "w": (0, -1), "nw": (1, -1)}


def geocell(code: Column, res: int) -> Column:
    """0 for a resolution that has no geocell."""
    if res not in GEOCELL_RESOLUTIONS:
        return codec.long(0)
    low = F.shiftrightunsigned(code, 4).bitwiseAND(codec.long(codec.mask(2 * res) >> 4))
    return low.bitwiseOR(codec.long((res // 2) << 60))


def geocell_resolution(cell: Column) -> Column:
    return (F.shiftrightunsigned(cell, 60) * 2).cast("int")


def geocell_code(cell: Column) -> Column:
    return F.shiftleft(cell, 4)


def ancestors(code: Column, finest: int = 30, coarsest: int = 2) -> Column:
    """Geocells of the code from coarse to fine."""
    return F.array(*[geocell(code, r) for r in GEOCELL_RESOLUTIONS if coarsest <= r <= finest])


def ancestor_hexes(code: Column, finest: int = 32, coarsest: int = 2) -> Column:
    """Prefixes of the code's digits, from coarse to fine."""
    digits = codec.to_hex(code)
    return F.transform(F.sequence(F.lit(coarsest // 2), F.lit(finest // 2)), lambda n: F.substring(digits, F.lit(1), n))


def index_text(code: Column, low: int = 2, high: int = 30) -> Column:
    """Prefixes from one resolution to another, space-separated; bounds are swapped and moved to 2..30 where they must be."""
    low, high = (min(max(r, 2), 30) for r in sorted((low, high)))
    return F.concat_ws(" ", ancestor_hexes(code, high & ~1, low + low % 2))


def children(hex_cell: Column) -> Column:
    """The 16 cells one level below, as prefixes; none below resolution 32."""
    digits = F.split(F.lit("0,1,2,3,4,5,6,7,8,9,a,b,c,d,e,f"), ",")
    none = F.array().cast("array<string>")
    return F.when(F.length(hex_cell) < 16, F.transform(digits, lambda d: F.concat(hex_cell, d))).otherwise(none)


def geocell_children(cell: Column) -> Column:
    """The 16 geocells below a geocell of a resolution under 30; for one at 30, the codes at resolution 32."""
    level = F.shiftrightunsigned(cell, 60)
    code = geocell_code(cell)

    def child(k: Column) -> Column:
        # the new digit follows the level's digits; shift amounts are per row, so in SQL
        return F.call_function("shiftleft", k.cast("long"), (F.lit(60) - level * 4).cast("int"))

    below = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.shiftrightunsigned(code.bitwiseOR(child(k)), 4).bitwiseOR(F.shiftleft(level + 1, 60)))
    last = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: code.bitwiseOR(child(k)))
    return F.when(level < 15, below).otherwise(last)


def geocell_parent(cell: Column) -> Column:
    """0 for a geocell of the coarsest resolution."""
    level = F.shiftrightunsigned(cell, 60).cast("int")
    out = codec.long(0)
    for n in range(2, 16):
        kept = cell.bitwiseAND(codec.long(codec.mask(4 * (n - 1)) >> 4))
        out = F.when(level == n, kept.bitwiseOR(codec.long((n - 1) << 60))).otherwise(out)
    return out


def parent_hex(hex_cell: Column) -> Column:
    """The prefix one digit shorter, null at the coarsest resolution."""
    return F.when(F.length(hex_cell) > 1, F.substring(hex_cell, F.lit(1), F.length(hex_cell) - 1))


def neighbour(code: Column, res: int, direction: str) -> Column:
    """The cell of the same size next to the code's, around the world and over the poles."""
    north, east = DIRECTIONS[direction]
    cell, step = codec.at_resolution(code, res), 1 << (32 - res)
    moved = F.struct((codec.y_of(cell) + north * step).alias("y"), (codec.x_of(cell) + east * step).alias("x"))
    # bound to a variable, so that the expression isn't written out at each of its uses
    return F.transform(F.array(moved), lambda m: codec.at_resolution(codec.encode_units(m["y"], m["x"]), res))[0]


def with_neighbours(cells: DataFrame, res: int) -> DataFrame:
    """Rows with a cell of a resolution -> (cell) for each of these and the eight around it. Moves are rows, so that a cell is decoded once and codes are made in one place, by generated code."""
    step = 1 << (32 - res)
    moves = F.array(*[F.struct(F.lit(n * step).cast("long").alias("n"), F.lit(e * step).cast("long").alias("e")) for n, e in [(0, 0), *DIRECTIONS.values()]])
    placed = cells.select(codec.y_of(F.col("cell")).alias("y"), codec.x_of(F.col("cell")).alias("x"))
    moved = placed.select("y", "x", F.explode(moves).alias("m"))
    return moved.select(codec.encode_units(F.col("y") + F.col("m.n"), F.col("x") + F.col("m.e"), res).alias("cell"))


def cell_ring(code: Column, res: int) -> Column:
    """The five corners of a cell, the first one again at the end, as (lat, lon)."""
    cell, step = codec.at_resolution(code, res), 1 << (32 - res)
    y, x = codec.y_of(cell), codec.x_of(cell)
    corners = [(0, 0), (0, step), (step, step), (step, 0), (0, 0)]
    return F.array(*[F.struct(codec.units_to_lat(y + a).alias("lat"), codec.units_to_lon(x + b).alias("lon")) for a, b in corners])


def cells_regexp(cells, keys: list[str] | None = None, cell: str = "hex"):
    """One pattern for each group of cells that matches the full digits of any code inside; null without cells."""
    keys = keys or []
    stem = F.substring(F.col(cell), F.lit(1), F.length(cell) - 1)
    stems = cells.filter(F.col(cell).isNotNull()).groupBy(*keys, stem.alias("_stem")).agg(F.concat_ws("", F.array_sort(F.collect_set(F.substring(F.col(cell), -1, 1)))).alias("_last"))
    part = F.concat(F.col("_stem"), F.lit("["), F.col("_last"), F.lit("].*"))
    return stems.groupBy(*keys).agg(F.when(F.count(F.lit(1)) > 0, F.concat_ws("|", F.array_sort(F.collect_list(part)))).alias("regexp"))
