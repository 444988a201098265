"""Points along great circles.

A segment is halved at the middle of its great circle while its length along the rhumb line is `delta` times that along the great circle
or more. A segment over more than 180 degrees of longitude is first cut where it reaches just under 180, in a straight line on the map.
Halves come ever nearer to each other's lengths, so with a delta above 1 this ends by itself; there is no limit of depth.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quadrille.shipping import ship

POINTS = "array<struct<lat: double, lon: double>>"
#: Degrees of longitude after which a longer segment is cut.
JUST_UNDER = 179.9999
#: A difference of latitudes below this is none, in radians.
LEVEL = 1e-15**0.5


def ratios(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Rhumb length by great-circle length of segments in degrees; 1 for segments of no length."""
    a, b, turn = np.radians(lat1), np.radians(lat2), np.radians(lon2) - np.radians(lon1)
    s = np.sin((a - b) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(turn / 2) ** 2
    arc = 2 * np.arcsin(np.minimum(1.0, np.sqrt(s)))
    with np.errstate(divide="ignore", invalid="ignore"):
        stretched = np.log(np.tan(b / 2 + np.pi / 4) / np.tan(a / 2 + np.pi / 4))
        q = np.where(np.abs(b - a) < LEVEL, np.cos(a), (b - a) / stretched)
        return np.where(arc > 0, np.hypot(b - a, q * turn) / arc, 1.0)


def middles(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b, m, n = np.radians(lat1), np.radians(lat2), np.radians(lon1), np.radians(lon2)
    x, y = np.cos(a) * np.cos(m) + np.cos(b) * np.cos(n), np.cos(a) * np.sin(m) + np.cos(b) * np.sin(n)
    return np.degrees(np.arctan2(np.sin(a) + np.sin(b), np.hypot(x, y))), np.degrees(np.arctan2(y, x))


def densified(lines: list[list[tuple[float, float]]], delta: float) -> list[list[tuple[float, float]]]:
    """Lines of (lat, lon) with what has to be put in; segments with an end beyond a pole stay. All segments of all lines are halved together."""
    flat = np.array([p for line in lines for p in line], float).reshape(-1, 2)
    line = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    begins = np.flatnonzero(line[1:] == line[:-1])
    # of a segment: number of its first point, part of the way at its ends, and the ends
    seg, low, high = begins.astype(float), np.zeros(len(begins)), np.ones(len(begins))
    ends = np.concatenate([flat[begins], flat[begins + 1]], 1)
    usable = (np.abs(ends[:, [0, 2]]) <= 90).all(1)
    seg, low, high, ends = seg[usable], low[usable], high[usable], ends[usable]
    added: list[tuple[np.ndarray, ...]] = []
    span = np.abs(ends[:, 3] - ends[:, 1])
    while (long := span > 180).any():
        part = JUST_UNDER / span[long]
        cut = ends[long, :2] * (1 - part)[:, None] + ends[long, 2:] * part[:, None]
        at = low[long] + (high[long] - low[long]) * part
        added.append((seg[long], at, cut[:, 0], cut[:, 1]))
        halves = [np.concatenate([ends[long, :2], cut], 1), np.concatenate([cut, ends[long, 2:]], 1)]
        seg, ends = np.concatenate([seg[~long], seg[long], seg[long]]), np.concatenate([ends[~long], *halves])
        low, high = np.concatenate([low[~long], low[long], at]), np.concatenate([high[~long], at, high[long]])
        span = np.abs(ends[:, 3] - ends[:, 1])
    while len(seg):
        split = ratios(*ends.T) >= delta
        seg, low, high, ends = seg[split], low[split], high[split], ends[split]
        lat, lon = middles(*ends.T)
        at = (low + high) / 2
        added.append((seg, at, lat, lon))
        middle = np.stack([lat, lon], 1)
        seg, ends = np.concatenate([seg, seg]), np.concatenate([np.concatenate([ends[:, :2], middle], 1), np.concatenate([middle, ends[:, 2:]], 1)])
        low, high = np.concatenate([low, at]), np.concatenate([at, high])
    own = (np.arange(len(flat), dtype=float), np.zeros(len(flat)), flat[:, 0], flat[:, 1])
    number, part, lat, lon = (np.concatenate(c) for c in zip(own, *added, strict=True))
    order = np.lexsort((part, number))
    at = line[number[order].astype(int)] if len(flat) else number.astype(int)
    bounds = np.searchsorted(at, np.arange(len(lines) + 1))
    pairs = list(zip(lat[order].tolist(), lon[order].tolist(), strict=True))
    return [pairs[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def densify(points: Column, delta: float) -> Column:
    """array<struct<lat, lon>> with points added along the great circles; null stays null. delta: above 1, e.g. 1.01."""
    if not delta > 1:
        raise ValueError("delta must be above 1: no way is shorter than the great circle")
    ship(SparkSession.active())

    @F.pandas_udf(POINTS)
    def add(lines: pd.Series) -> pd.Series:
        given = lines.notna()
        done = densified([[(p["lat"], p["lon"]) for p in line] for line in lines[given]], delta)
        out = pd.Series([None] * len(lines), index=lines.index, dtype=object)
        out[given] = pd.Series([[{"lat": a, "lon": b} for a, b in line] for line in done], index=lines.index[given], dtype=object)
        return out

    return add(points)
