"""Geohash text from and to codes. A geohash interleaves longitude first, five bits to a letter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import codec

# The geohash alphabet.
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
MOST = 12


def swap_axes(code: Column) -> Column:
    """The code with the two bits of each pair exchanged."""
    high = F.shiftrightunsigned(code, 1).bitwiseAND(codec.long(0x5555555555555555))
    return F.shiftleft(code.bitwiseAND(codec.long(0x5555555555555555)), 1).bitwiseOR(high)


def encode(code: Column, res: int = 32) -> Column:
    """As many letters as 2*res bits fill."""
    swapped = swap_axes(codec.at_resolution(code, res))
    letters = [
        F.substring(F.lit(ALPHABET), (F.shiftrightunsigned(swapped, 59 - 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for k in range(min(2 * res // 5, MOST))
    ]
    return F.concat(*letters) if letters else F.lit("")


def decode(geohash: Column) -> Column:
    """The code at the cell's south-west corner; null where a letter isn't one or there are more than twelve."""
    bits, valid = codec.long(0), F.length(geohash).between(1, MOST)
    for k in range(MOST):
        letter = F.substring(geohash, k + 1, 1)
        value = F.instr(F.lit(ALPHABET), letter) - 1
        there = F.length(geohash) > k
        valid = valid & (~there | (value >= 0))
        bits = bits.bitwiseOR(F.when(there, F.shiftleft(value.cast("long"), 59 - 5 * k)).otherwise(codec.long(0)))
    return F.when(valid, swap_axes(bits))


def to_cells(geohashes: DataFrame, column: str = "geohash") -> DataFrame:
    """Rows of geohashes -> res and cell: each geohash is 1, 2, 4 or 8 cells of the next even resolution.

    5 bits a letter are completed to a multiple of 4 bits; the missing bits take all values.
    """
    bits = F.length(column) * 5
    missing = F.pmod(-bits, F.lit(4)).cast("int")
    tails = F.expr("transform(sequence(0L, shiftleft(1L, _missing) - 1), v -> shiftleft(v, 64 - _bits - _missing))")
    spread = (
        geohashes.withColumn("_bits", bits).withColumn("_missing", missing).withColumn("_code", decode(F.col(column))).filter("_code is not null")
        .withColumn("_tail", F.explode(tails))
    )
    swapped = swap_axes(F.col("_code")).bitwiseOR(F.col("_tail"))
    return spread.withColumn("res", ((F.col("_bits") + F.col("_missing")) / 2).cast("int")).withColumn("cell", swap_axes(swapped)).drop("_bits", "_missing", "_code", "_tail")


def from_cells(cells: DataFrame, merge: bool = False) -> DataFrame:
    """(res, cell) -> geohashes that cover the cells: bits that a letter lacks take all values."""
    bits = F.col("res") * 2
    letters = F.least(F.ceil(bits / 5), F.lit(MOST)).cast("int")
    tails = F.expr("transform(sequence(0L, shiftleft(1L, greatest(0, _letters * 5 - _bits)) - 1), v -> shiftleft(v, 64 - _letters * 5))")
    spread = cells.withColumn("_bits", bits.cast("int")).withColumn("_letters", letters).withColumn("_tail", F.explode(tails))
    code = swap_axes(swap_axes(F.col("cell")).bitwiseOR(F.col("_tail")))
    out = spread.withColumn("geohash", F.substring(encode(code), F.lit(1), F.col("_letters"))).drop("_bits", "_letters", "_tail", "res", "cell").distinct()
    return merge_siblings(out) if merge else out


def merge_siblings(geohashes: DataFrame, column: str = "geohash") -> DataFrame:
    """32 geohashes that share all but the last letter become that prefix; repeated until none is left."""
    from quadrille.operators.graph import saved

    keys = [c for c in geohashes.columns if c != column]
    out = saved(geohashes.distinct())
    longest = out.agg(F.max(F.length(column))).first()[0] or 0
    for n in range(min(longest, MOST), 1, -1):
        stem = F.substring(F.col(column), F.lit(1), F.lit(n - 1))
        here = out.filter(F.length(column) == n).withColumn("_stem", stem)
        full = here.groupBy(*keys, "_stem").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 32").drop("_n")
        left = here.join(full, [*keys, "_stem"], "left_anti").drop("_stem")
        out = saved(out.filter(F.length(column) != n).unionByName(left).unionByName(full.withColumnRenamed("_stem", column)).distinct())
    return out
