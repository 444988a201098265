"""Area definitions as text: parsing on the driver, one small tree for each definition.

    circle:lat:lon:radius            metres
    polygon:lat:lon,lat:lon,...      three points at least
    rect:swlat:swlon,nelat:nelon
    path:lat:lon:dist,lat:lon[:dist],...     a distance holds until another is given
    polyline:dist:encoded            vertices in the encoded-polyline format

An expression is a space-separated list of terms, each an operator (+, -, &) and an area, taken from
left to right; the first + term is the base, and terms before it don't count. A term that can't be
parsed covers nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from quadrille.functions import codec, measure

Vertex = tuple[int, int]
#: Vertices of a circle: 16 for each quadrant.
CIRCLE = 64


@dataclass(frozen=True)
class Area:
    """Polygons to be covered and united; each a list of (y, x) in units, x beyond the last unit where it crosses the date line."""

    kind: str
    polygons: tuple[tuple[Vertex, ...], ...] = ()
    line: tuple[Vertex, ...] = field(default=())


NOWHERE = Area("nowhere")


def lat_units(lat: float) -> int:
    return codec.UNITS - 1 if lat == 90.0 else int((lat + 90.0) / codec.LAT_UNIT)


def lon_units(lon: float) -> int:
    return codec.UNITS - 1 if lon == 180.0 else int((lon + 180.0) / codec.LON_UNIT)


def _vertex(lat: str, lon: str) -> Vertex:
    a, b = float(lat), float(lon)
    if not (math.isfinite(a) and math.isfinite(b)):
        raise ValueError("not a place")
    return lat_units(a), lon_units(b)


def circle_vertices(lat: float, lon: float, radius: float) -> tuple[Vertex, ...]:
    r = abs(radius)
    north = round(r * measure.UNITS_PER_METRE_LAT)
    east = round(r * measure.UNITS_PER_METRE_LON / max(math.cos(math.radians(lat)), 1e-9))
    y, x = lat_units(lat), lon_units(lon)
    turn = [2 * math.pi * k / CIRCLE for k in range(CIRCLE)]
    return tuple((int(y + north * math.sin(t)), int(x + east * math.cos(t))) for t in turn)


def buffered_segment(a: Vertex, b: Vertex, metres: float) -> tuple[Vertex, ...]:
    """The rectangle around a segment, longer by the distance at both ends; a circle where the ends are one."""
    middle = (a[0] + b[0]) / 2 * codec.LAT_UNIT - 90.0
    if a == b:
        return circle_vertices(a[0] * codec.LAT_UNIT - 90.0, a[1] * codec.LON_UNIT - 180.0, metres)
    sy, sx = measure.UNITS_PER_METRE_LAT, measure.UNITS_PER_METRE_LON / max(math.cos(math.radians(middle)), 1e-9)
    dy, dx = (b[0] - a[0]) / sy, (b[1] - a[1]) / sx
    length = math.hypot(dy, dx)
    uy, ux = dy / length * metres, dx / length * metres
    place = lambda p, along, side: (int(p[0] + (along * uy + side * ux) * sy), int(p[1] + (along * ux - side * uy) * sx))
    return place(a, -1, 1), place(b, 1, 1), place(b, 1, -1), place(a, -1, -1)


def decode_polyline(text: str) -> list[Vertex]:
    """Vertices in units; what stands after the last whole pair is left out."""
    numbers, value, shift = [], 0, 0
    for c in text:
        part = ord(c) - 63
        value |= (part & 31) << shift
        shift += 5
        if part < 32:
            numbers.append(~(value >> 1) if value & 1 else value >> 1)
            value = shift = 0
    out, lat, lon = [], 0, 0
    for a, b in zip(numbers[::2], numbers[1::2], strict=False):
        lat, lon = lat + a, lon + b
        out.append((lat_units(lat / 1e5), lon_units(lon / 1e5)))
    return out


def _buffered(line: list[Vertex], metres: list[float], kind: str) -> Area:
    if len(line) < 2:
        return NOWHERE
    parts = [buffered_segment(a, b, d) for a, b, d in zip(line, line[1:], metres, strict=False) if d > 0]
    return Area(kind, tuple(parts), tuple(line))


def parse_area(text: str) -> Area:
    kind, _, rest = text.partition(":")
    try:
        if kind == "circle":
            lat, lon, radius = map(float, rest.split(":"))
            return Area(kind, (circle_vertices(lat, lon, radius),))
        if kind == "polygon":
            ring = [_vertex(*p.split(":")) for p in rest.split(",")]
            if len(ring) > 1 and ring[0] == ring[-1]:
                ring.pop()
            return Area(kind, (tuple(ring),)) if len(ring) >= 3 else NOWHERE
        if kind == "rect":
            (y0, x0), (y1, x1) = (_vertex(*p.split(":")) for p in rest.split(","))
            y0, y1, x0, x1 = min(y0, y1), max(y0, y1), min(x0, x1), max(x0, x1)
            return Area(kind, (((y0, x0), (y0, x1), (y1, x1), (y1, x0)),))
        if kind == "path":
            line, metres, now = [], [], 0.0
            for p in rest.split(","):
                lat, lon, *more = p.split(":")
                now = float(more[0]) if more else now
                line.append(_vertex(lat, lon))
                metres.append(now)
            return _buffered(line, metres, kind)
        if kind == "polyline":
            metres, _, encoded = rest.partition(":")
            line = decode_polyline(encoded)
            return _buffered(line, [float(metres)] * len(line), kind)
    except (ValueError, TypeError, OverflowError):
        return NOWHERE
    return NOWHERE


def parse_expression(text: str) -> list[tuple[str, Area]]:
    """(operator, area) in order, the base first; empty without a + term."""
    terms = [(t[0], parse_area(t[1:])) for t in text.split(" ") if t and t[0] in "+-&"]
    first = next((k for k, (sign, _) in enumerate(terms) if sign == "+"), len(terms))
    return terms[first:]
