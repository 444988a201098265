"""Distances, scales and projections, as Column expressions.

An arc minute is taken as 1852 m, so a degree is 111120 m everywhere on a great circle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.functions import codec

METRES_PER_DEGREE = 60.0 * 1852.0
UNITS_PER_METRE_LAT = codec.UNITS / (180.0 * METRES_PER_DEGREE)
UNITS_PER_METRE_LON = codec.UNITS / (360.0 * METRES_PER_DEGREE)
TILE = 256


def great_circle_degrees(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres along the great circle (haversine)."""
    a, b = F.radians(lat1), F.radians(lat2)
    s = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sqrt(s)))) * METRES_PER_DEGREE


def great_circle(a: Column, b: Column) -> Column:
    deg = lambda c: (codec.units_to_lat(codec.y_of(c)), codec.units_to_lon(codec.x_of(c)))
    return great_circle_degrees(*deg(a), *deg(b))


def mean_latitude_distance(a: Column, b: Column) -> Column:
    """Metres on a flat map at the mean latitude, the shorter way around the world."""
    y1, x1, y2, x2 = codec.y_of(a), codec.x_of(a), codec.y_of(b), codec.x_of(b)
    dx = F.abs(x2 - x1)
    dx = F.when(dx > F.lit(1 << 31), F.lit(codec.UNITS - 1) - dx).otherwise(dx)
    mean = F.radians((codec.units_to_lat(y1) + codec.units_to_lat(y2)) / 2)
    north, east = (y2 - y1) * codec.LAT_UNIT, dx * codec.LON_UNIT * F.cos(mean)
    return F.sqrt(north * north + east * east) * METRES_PER_DEGREE


def law_of_cosines(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Radians along the great circle."""
    a, b = F.radians(lat1), F.radians(lat2)
    cos = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(lon2 - lon1))
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cos)))


def scale(code: Column) -> Column:
    """Units for a metre at the code's place, whole numbers."""
    lat = F.radians(codec.units_to_lat(codec.y_of(code)))
    return F.struct(
        F.round(F.lit(UNITS_PER_METRE_LAT)).cast("long").alias("y"), F.round(UNITS_PER_METRE_LON / F.cos(lat)).cast("long").alias("x")
    )


def lat_scale(lat: Column) -> Column:
    """How much longer a degree of latitude is than one of longitude."""
    return 1.0 / F.cos(F.radians(lat))


def squared_distance(a: Column, b: Column, scales: Column) -> Column:
    """Square metres on the flat map that the scales belong to."""
    dy, dx = (codec.y_of(b) - codec.y_of(a)) / scales["y"], (codec.x_of(b) - codec.x_of(a)) / scales["x"]
    return dy * dy + dx * dx


def squared_distance_exact(a: Column, b: Column) -> Column:
    lat = F.radians(codec.units_to_lat(codec.y_of(a)))
    dy, dx = (codec.y_of(b) - codec.y_of(a)) / UNITS_PER_METRE_LAT, (codec.x_of(b) - codec.x_of(a)) * F.cos(lat) / UNITS_PER_METRE_LON
    return dy * dy + dx * dx


def intermediate(lat1: Column, lon1: Column, lat2: Column, lon2: Column, fraction: Column) -> Column:
    """The point at a fraction of the great circle; null where a latitude is out of range or the way isn't unique."""
    a, b, m, n = F.radians(lat1), F.radians(lat2), F.radians(lon1), F.radians(lon2)
    d = law_of_cosines(lat1, lon1, lat2, lon2)
    p, q = F.sin((1 - fraction) * d) / F.sin(d), F.sin(fraction * d) / F.sin(d)
    x = p * F.cos(a) * F.cos(m) + q * F.cos(b) * F.cos(n)
    y = p * F.cos(a) * F.sin(m) + q * F.cos(b) * F.sin(n)
    z = p * F.sin(a) + q * F.sin(b)
    point = F.struct(F.degrees(F.atan2(z, F.sqrt(x * x + y * y))).alias("lat"), F.degrees(F.atan2(y, x)).alias("lon"))
    usable = lat1.between(-90, 90) & lat2.between(-90, 90) & (F.abs(lon2 - lon1) < 180)
    return F.when(usable & (d > 0), point).when(usable, F.struct(lat1.alias("lat"), lon1.alias("lon")))


def mercator_xy(lat: Column, lon: Column, zoom: int) -> Column:
    """Pixels of the web map at a zoom of 0 to 30."""
    size = float(TILE << zoom)
    s = F.greatest(F.lit(-0.9999), F.least(F.lit(0.9999), F.sin(F.radians(lat))))
    x = size / 2 + lon * (size / 360)
    y = size / 2 - 0.5 * F.log((1 + s) / (1 - s)) * (size / (2 * math.pi))
    return F.struct(F.floor(x).cast("long").alias("x"), F.floor(y).cast("long").alias("y"))


def mercator_latlon(x: Column, y: Column, zoom: int) -> Column:
    size = float(TILE << zoom)
    lat = F.degrees(2 * F.atan(F.exp((size / 2 - y) / (size / (2 * math.pi)))) - math.pi / 2)
    return F.struct(lat.alias("lat"), ((x - size / 2) / (size / 360)).alias("lon"))


def weighted_centroid(a: Column, wa: Column, b: Column, wb: Column) -> Column:
    """The code at the weighted mean of two, truncated to whole units."""
    mean = lambda of: ((of(a) * wa + of(b) * wb) / (wa + wb)).cast("long")
    return codec.encode_units(mean(codec.y_of), mean(codec.x_of))
