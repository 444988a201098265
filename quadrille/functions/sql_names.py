"""The grid's functions by name in SQL: temporary SQL functions, which Spark inlines into the plan.

Bits are spread by reading binary digits as digits of base 4, and gathered the other way round.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, parameters, type and body; later ones use earlier ones.
FUNCTIONS = (
    ("grid_y", "lat DOUBLE", "BIGINT", "cast(floor((lat + 90D) / (180D / 4294967296D)) as bigint)"),
    ("grid_x", "lon DOUBLE", "BIGINT", "cast(floor((lon + 180D) / (360D / 4294967296D)) as bigint)"),
    ("grid_code_of_units", "y BIGINT, x BIGINT", "BIGINT", "shiftleft(cast(conv(bin(y), 4, 10) as bigint), 1) | cast(conv(bin(x), 4, 10) as bigint)"),
    ("grid_code", "lat DOUBLE, lon DOUBLE", "BIGINT", "grid_code_of_units(grid_y(lat), grid_x(lon))"),
    ("grid_units_y", "code BIGINT", "BIGINT", "cast(conv(conv(cast(shiftrightunsigned(code, 1) & 6148914691236517205 as string), 10, 4), 2, 10) as bigint)"),
    ("grid_units_x", "code BIGINT", "BIGINT", "cast(conv(conv(cast(code & 6148914691236517205 as string), 10, 4), 2, 10) as bigint)"),
    ("grid_lat", "code BIGINT", "DOUBLE", "grid_units_y(code) * (180D / 4294967296D) - 90D"),
    ("grid_lon", "code BIGINT", "DOUBLE", "grid_units_x(code) * (360D / 4294967296D) - 180D"),
    ("grid_cell", "code BIGINT, res INT", "BIGINT", "code & shiftleft(-1L, 64 - 2 * res)"),
    ("grid_hex", "code BIGINT, res INT", "STRING", "substr(lpad(lower(hex(code)), 16, '0'), 1, cast(res / 2 as int))"),
    (
        "grid_metres", "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "DOUBLE",
        "degrees(2 * asin(least(1D, sqrt(pow(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))) * 111120D",
    ),
)


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to a session; returns their names. Places outside the world have no defined code."""
    for name, parameters, type_, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {type_} RETURN {body}")
    return [name for name, *_ in FUNCTIONS]
