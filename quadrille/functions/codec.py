"""Points as 64-bit Z-order codes.

Latitude and longitude are cut into 2**32 steps each, and their bits interleaved, latitude on the
higher bit of each pair. A code's first 2*R bits name a cell at resolution R (even, 2 to 32);
as hex digits that is a prefix of R/2 digits. Codes are stored as signed longs and meant unsigned.
All functions here are Column expressions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = 1 << 32
LAT_UNIT = 180.0 / UNITS
LON_UNIT = 360.0 / UNITS
RESOLUTIONS = tuple(range(2, 33, 2))
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def signed(value: int) -> int:
    """The signed long with the bits of an unsigned one."""
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def long(value: int) -> Column:
    return F.lit(signed(value)).cast("long")


def mask(bits: int) -> int:
    """The high `bits` bits of a code."""
    return ((1 << bits) - 1) << (64 - bits)


def interleave(y: int, x: int) -> int:
    """The code of whole units, on the driver."""
    for shift, keep in _SPREAD:
        y, x = (y | y << shift) & keep, (x | x << shift) & keep
    return y << 1 | x


def _table(values: list[int]) -> Column:
    """A lookup table as one literal, so that plans stay small."""
    return F.lit(np.array(values, dtype=np.int64))


def _spread_byte(b: int) -> int:
    return interleave(0, b)


def _compact_byte(b: int) -> int:
    return sum((b >> 2 * k & 1) << k for k in range(4))


def _look_up(table: Column, x: Column, low: int) -> Column:
    byte = F.shiftrightunsigned(x, low) if low else x
    return F.get(table, byte.bitwiseAND(F.lit(255)).cast("int"))


def _spread(x: Column) -> Column:
    """The low 32 bits, each moved to twice its place."""
    table = _table([_spread_byte(b) for b in range(256)])
    out = _look_up(table, x, 0)
    for low in (8, 16, 24):
        out = out.bitwiseOR(F.shiftleft(_look_up(table, x, low), 2 * low))
    return out


def _compact(x: Column) -> Column:
    """Every second bit, moved together."""
    table = _table([_compact_byte(b) for b in range(256)])
    out = _look_up(table, x, 0)
    for low in range(8, 64, 8):
        out = out.bitwiseOR(F.shiftleft(_look_up(table, x, low), low // 2))
    return out


def encode_units(y: Column, x: Column, res: int = 32) -> Column:
    """The code of grid coordinates. Beyond a pole the latitude is mirrored and the longitude turned by half a circle."""
    over = F.shiftright(F.shiftleft(y, 31), 63)  # all ones where bit 32 is set
    y2 = y.bitwiseXOR(over.bitwiseAND(long(0xFFFFFFFF)))
    x2 = x.bitwiseXOR(over.bitwiseAND(long(0x80000000)))
    code = F.shiftleft(_spread(y2), 1).bitwiseOR(_spread(x2))
    return at_resolution(code, res) if res < 32 else code


def lat_to_units(lat: Column) -> Column:
    return F.floor((lat + 90.0) / LAT_UNIT).cast("long")


def lon_to_units(lon: Column) -> Column:
    return F.floor((lon + 180.0) / LON_UNIT).cast("long")


def vertex_lat(lat: Column) -> Column:
    """Units of an area's vertex: truncated, and 90 degrees is the last unit."""
    return F.when(lat == 90.0, F.lit(UNITS - 1)).otherwise(((lat + 90.0) / LAT_UNIT).cast("long"))


def vertex_lon(lon: Column) -> Column:
    return F.when(lon == 180.0, F.lit(UNITS - 1)).otherwise(((lon + 180.0) / LON_UNIT).cast("long"))


def units_to_lat(y: Column) -> Column:
    return y * F.lit(LAT_UNIT) - 90.0


def units_to_lon(x: Column) -> Column:
    return x * F.lit(LON_UNIT) - 180.0


def encode(lat: Column, lon: Column) -> Column:
    return encode_units(lat_to_units(lat), lon_to_units(lon))


def encode_text(text: Column) -> Column:
    """The code of `lat:lon`."""
    parts = F.split(text, ":")
    return encode(parts[0].cast("double"), parts[1].cast("double"))


def at_resolution(code: Column, res: int) -> Column:
    """The cell at a resolution: the code's prefix, aligned to the left."""
    return code.bitwiseAND(long(mask(2 * res)))


def y_of(code: Column) -> Column:
    return _compact(F.shiftrightunsigned(code, 1))


def x_of(code: Column) -> Column:
    return _compact(code)


def decode_units(code: Column, res: int = 32) -> Column:
    cell = at_resolution(code, res)
    return F.struct(y_of(cell).alias("y"), x_of(cell).alias("x"))


def decode(code: Column, res: int = 32) -> Column:
    cell = at_resolution(code, res)
    return F.struct(units_to_lat(y_of(cell)).alias("lat"), units_to_lon(x_of(cell)).alias("lon"))


def center(code: Column, res: int) -> Column:
    """The code in the middle of a cell; at resolution 32 the cell itself."""
    cell = at_resolution(code, res)
    return cell if res >= 32 else cell.bitwiseOR(long(0xC << (60 - 2 * res)))


def center_degrees(code: Column, res: int) -> Column:
    return decode(center(code, res))


def center_units(code: Column, res: int) -> Column:
    return decode_units(center(code, res))


def cell_bbox(code: Column, res: int) -> Column:
    """South-west corner and the last unit to the north-east, in degrees."""
    cell, last = at_resolution(code, res), (1 << (32 - res)) - 1
    y, x = y_of(cell), x_of(cell)
    return F.struct(
        units_to_lat(y).alias("swlat"),
        units_to_lon(x).alias("swlon"),
        units_to_lat(y.bitwiseOR(long(last))).alias("nelat"),
        units_to_lon(x.bitwiseOR(long(last))).alias("nelon"),
    )


def to_hex(code: Column, res: int = 32) -> Column:
    """R/2 hex digits; an odd resolution counts as the even one below."""
    digits = F.lower(F.lpad(F.hex(code), 16, "0"))
    return digits if res >= 32 else F.substring(digits, 1, (res & ~1) // 2)


def from_hex(text: Column) -> Column:
    return F.conv(F.rpad(text, 16, "0"), 16, -10).cast("long")


def to_bytes(code: Column) -> Column:
    return F.unhex(F.lpad(F.hex(code), 16, "0"))


def from_bytes(raw: Column) -> Column:
    return F.conv(F.hex(raw), 16, -10).cast("long")


def packed_bytes(code: Column, res: int) -> Column:
    """The prefix's digits, two to a byte, padded by 0; null for a resolution that isn't one."""
    if res not in RESOLUTIONS:
        return F.lit(None).cast("binary")
    digits = res // 2
    return F.unhex(F.rpad(to_hex(code, res), digits + digits % 2, "0"))


def random_codes(spark, count: int, seed: int = 0):
    """`count` codes that look random and are the same for a seed: (hh, hex)."""
    code = F.xxhash64(F.lit(seed), F.col("id"))
    return spark.range(count).select(code.alias("hh"), to_hex(code).alias("hex"))
