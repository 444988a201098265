"""Approximate membership of cells in a set of points.

All prefixes of a point are members: exactly for resolutions 2 and 4 (16 and 256 bits), by hashing for finer ones.
Hashed members go to the first of six generations of growing size that holds their number (they are
counted first); a cell is a member if any generation has it. A generation is stored as words of 63 bits, a row each: building is an aggregate, testing an equality join for each hash
function that only what was found so far takes part in, and filters of any size are joined and merged like other tables.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import codec
from quadrille.operators.coverage import hex_of, keep_bits
from quadrille.operators.graph import saved

# Elements and error rates of the six generations.
SIZES = (10**3, 10**4, 10**5, 10**6, 10**7, 10**8)
ERRORS = (0.01, 0.02, 0.03, 0.04, 0.05, 0.10)
WORD = 63


@dataclass(frozen=True)
class Layout:
    """Bits and hash functions of each generation."""

    max_res: int = 20
    sizes: tuple[int, ...] = SIZES
    errors: tuple[float, ...] = ERRORS
    hashes: int = 6
    sliced: bool = False

    def bits(self, generation: int) -> int:
        n = math.ceil(-self.sizes[generation] * math.log(self.errors[generation]) / math.log(2) ** 2)
        return -(-n // self.hashes) * self.hashes if self.sliced else n

    @property
    def keys(self) -> list[int]:
        """The seeds; the same everywhere, so that filters can be merged."""
        return list(range(1, self.hashes + 1))


def _at(cell: str, res: Column) -> Column:
    return F.col(cell).bitwiseAND(keep_bits(res))


def _with_ancestors(given: dict[int, DataFrame], keys: list[str]) -> DataFrame:
    """Cells (keys, cell) by their level -> (keys, res, cell), distinct, with all ancestors: a level is made of the distinct cells of the next finer one, so a cell is handed up once."""
    made = finer = None
    for res in range(max(given), 0, -2):
        here = given[res].select(*keys, "cell") if res in given else None
        if finer is not None:
            above = finer.select(*keys, _at("cell", F.lit(res)).alias("cell"))
            here = above if here is None else above.unionByName(here)
        finer = saved(here.distinct())
        level = finer.select(*keys, F.lit(res).alias("res"), "cell")
        made = level if made is None else made.unionByName(level)
    return made


def members(points: DataFrame, layout: Layout, code: str = "hh", keys: list[str] | None = None) -> DataFrame:
    finest = max(r for r in codec.RESOLUTIONS if r <= layout.max_res)
    return _with_ancestors({finest: points.select(*(keys or []), codec.at_resolution(F.col(code), finest).alias("cell"))}, keys or [])


def _place(key: Column, layout: Layout, generation: int, k: int) -> Column:
    bits = layout.bits(generation)
    part = bits // layout.hashes
    return F.pmod(F.xxhash64(key, F.lit(k)), F.lit(part if layout.sliced else bits)) + (part * (k - 1) if layout.sliced else 0)


def _place_of(generation: Column, key: Column, layout: Layout, present: list[int], k: int) -> Column:
    """The place by hash function k in the generation that the row names."""
    out = F.lit(None).cast("bigint")
    for g in present:
        out = F.when(generation == g, _place(key, layout, g, k)).otherwise(out)
    return out


def _exact_place(res: str, cell: str) -> Column:
    return F.when(F.col(res) == 2, F.shiftrightunsigned(cell, 60)).otherwise(16 + F.shiftrightunsigned(cell, 56))


def generation_of(total: int, layout: Layout) -> int:
    """The first generation that holds a number of members; beyond the last one the last, whose error then grows."""
    return next((g for g, n in enumerate(layout.sizes) if total <= n), len(layout.sizes) - 1)


def _chosen(total: Column, layout: Layout) -> Column:
    out = F.lit(len(layout.sizes) - 1)
    for g in reversed(range(len(layout.sizes))):
        out = F.when(total <= layout.sizes[g], F.lit(g)).otherwise(out)
    return out


def build(points: DataFrame, layout: Layout | None = None, code: str = "hh", keys: list[str] | None = None) -> DataFrame:
    """points -> (generation, word, bits), with keys a filter for each of their values. Generation -1 holds the exact bits.

    Each filter's hashed members go to the generation that holds their number, so keys of any sizes are built in one aggregate.
    """
    layout, keys = layout or Layout(), keys or []
    found = members(points, layout, code, keys)
    exact = found.filter("res <= 4").select(*keys, F.lit(-1).alias("generation"), _exact_place("res", "cell").alias("place"))
    fine = found.filter("res > 4")
    if keys:
        sizes = saved(fine.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("generation", _chosen(F.col("_n"), layout)).drop("_n"))
        same = [F.col(f"_b.{k}").eqNullSafe(F.col(f"_a.{k}")) for k in keys]
        placed = fine.alias("_a").join(sizes.alias("_b"), same).select(*[F.col(f"_a.{k}").alias(k) for k in keys], "generation", "res", "cell")
        present = sorted(r[0] for r in sizes.select("generation").distinct().collect())  # six at most
    else:
        present = [generation_of(fine.count(), layout)]
        placed = fine.withColumn("generation", F.lit(present[0]))
    # the key is a column of its own, so that its digits are made once for a cell and not once for each hash function
    named = placed.withColumn("_key", hex_of(F.col("res"), F.col("cell")))
    places = named.withColumn("_places", F.array(*[_place_of(F.col("generation"), F.col("_key"), layout, present, k) for k in layout.keys]))
    hashed = places.select(*keys, "generation", F.explode("_places").alias("place"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("place", F.lit(WORD)).cast("int"))
    bits = exact.unionByName(hashed).select(*keys, "generation", F.floor(F.col("place") / WORD).alias("word"), bit.alias("bit"))
    # dealt out first: places are spread all over a filter, so a table of words on the side of the cells would hold about as many rows as it takes in
    return bits.repartition(*keys, "generation", "word").groupBy(*keys, "generation", "word").agg(F.bit_or("bit").alias("bits"))


def merge(*filters: DataFrame) -> DataFrame:
    """Filters of one layout as one; those with keys key by key."""
    out = filters[0]
    for f in filters[1:]:
        out = out.unionByName(f)
    return out.groupBy(*[c for c in out.columns if c != "bits"]).agg(F.bit_or("bits").alias("bits"))


def contains(cells: DataFrame, bloom: DataFrame, layout: Layout | None = None, hierarchy: bool = False, keys: list[str] | None = None) -> DataFrame:
    """cells (res, cell) with `member`. With hierarchy, all ancestors have to be members too. Cells finer than the filter are tested at its finest level.

    With keys each row is tested in the filter of its key; a key without a filter has no members. Only generations that a filter has are probed.
    """
    layout, keys = layout or Layout(), keys or []
    of = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)  # one column, in which nulls are equal
    finest = F.least("res", F.lit(layout.max_res))
    fixed = cells.select(of.alias("_of"), finest.alias("res"), _at("cell", finest).alias("cell"))
    tried = saved(fixed.distinct())
    if hierarchy:
        given = sorted(r[0] for r in tried.select("res").distinct().collect() if r[0] in codec.RESOLUTIONS)  # 16 at most
        tried = _with_ancestors({r: tried.filter(F.col("res") == r) for r in given}, ["_of"]) if given else tried.limit(0)
    bits = saved(bloom.select(of.alias("_of"), "generation", "word", "bits"))
    held = saved(bits.select("_of", "generation").distinct())
    present = sorted(r[0] for r in held.select("generation").distinct().collect())  # seven at most
    fits = (F.col("res") <= 4) == (F.col("generation") == -1)
    of_cell = (F.col("_a._of") == F.col("_b._of")) & fits
    live = tried.alias("_a").join((held if keys else F.broadcast(held)).alias("_b"), of_cell).select("_a._of", "res", "cell", "generation")
    live = saved(live)  # else hashing is written out inside of the join
    one = F.call_function("shiftright", F.col("bits"), F.pmod("_p", F.lit(WORD)).cast("int")).bitwiseAND(F.lit(1)) == 1
    for k in layout.keys:
        hashed = _place_of(F.col("generation"), hex_of(F.col("res"), F.col("cell")), layout, [g for g in present if g >= 0], k)
        asked = live.withColumn("_p", F.when(F.col("generation") == -1, _exact_place("res", "cell")).otherwise(hashed)).withColumn("word", F.coalesce(F.floor(F.col("_p") / WORD), F.lit(-1).cast("long")))  # never null, so that no check for null spells it out again
        looked = asked.join(bits.hint("shuffle_hash"), ["_of", "generation", "word"])
        live = looked.filter(one).select("_of", "res", "cell", "generation")
    found = live.select("_of", "res", "cell").distinct()
    if hierarchy:
        found = _with_all_above(saved(found), max(given, default=2))
    told = cells.withColumns({"_of": of, "_res": finest, "_cell": _at("cell", finest)}).alias("_a").join(
        found.withColumn("_member", F.lit(True)).alias("_b"), (F.col("_a._of") == F.col("_b._of")) & (F.col("_a._res") == F.col("_b.res")) & (F.col("_a._cell") == F.col("_b.cell")), "left"
    )
    return told.select(*[F.col(f"_a.`{c}`") for c in cells.columns], F.coalesce("_member", F.lit(False)).alias("member"))


def _with_all_above(found: DataFrame, finest: int) -> DataFrame:
    """Cells (_of, res, cell) whose ancestors are all among them, from the coarsest level down."""
    kept = above = found.filter(F.col("res") == 2)
    for res in range(4, finest + 1, 2):
        parents = above.select("_of", F.col("cell").alias("_up"))
        here = found.filter(F.col("res") == res).withColumn("_up", _at("cell", F.lit(res - 2)))
        above = saved(here.join(parents, ["_of", "_up"], "left_semi").select("_of", "res", "cell"))
        kept = kept.unionByName(above)
    return kept
