"""A table function for SQL: the cells of an area text.

    SELECT a.name, c.res, c.hex FROM areas a, LATERAL grid_cover(a.def, 10) c

An area is covered where its row is, so many areas are covered in parallel; one area is one task's work, so it should be of bounded size
(cover.from_table takes large ones apart). Null or unreadable text has no cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.types import IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quadrille.functions import codec
from quadrille.plans import areas
from quadrille.shipping import ship

COLUMNS = StructType().add("res", IntegerType()).add("cell", LongType()).add("hex", StringType())


def ring_cells(ring: tuple[tuple[int, int], ...], res: int) -> set[tuple[int, int]]:
    """(row, column) of the cells that a ring's sides pass through or that lie inside, by rows of cells."""
    shift, last = 32 - res, (1 << (32 - res)) - 1
    found: set[tuple[int, int]] = set()
    crossings: dict[int, list[tuple[int, int]]] = {}
    for k, (iy, ix) in enumerate(ring):
        (jy, jx), ny = ring[k - 1], ring[(k + 1) % len(ring)][0]
        if iy == jy:
            found.update((iy >> shift, x) for x in range(min(ix, jx) >> shift, (max(ix, jx) >> shift) + 1))
            continue
        low, high = min(iy, jy), max(iy, jy)
        rows = np.arange(low >> shift, (high >> shift) + 1)
        at = np.append(np.maximum(rows << shift, low), high)
        slope = float(jx - ix) / float(jy - iy)
        a, b = (ix + np.trunc((y - iy) * slope).astype(np.int64) for y in (at, at | last))
        left = np.maximum(np.minimum(a, b), min(ix, jx)) >> shift
        right = np.minimum(np.maximum(a, b), max(ix, jx)) >> shift
        for y, f, t in zip(at.tolist(), np.minimum(left, right).tolist(), right.tolist(), strict=True):
            row = y >> shift
            found.update((row, x) for x in range(f, t + 1))
            turns = y == iy and (ny - iy) * (jy - iy) > 0
            if y & last == 0 and (y not in (iy, jy) or y == jy or turns):
                crossings.setdefault(row, []).append((f, t))
    for row, ends in crossings.items():
        ends.sort()
        for (f, _), (_, t) in zip(ends[::2], ends[1::2], strict=False):
            found.update((row, x) for x in range(f, t + 1))
    return found


class GridCover:
    """grid_cover(def STRING, res INT): res, cell and hex of the area's cells."""

    @staticmethod
    def analyze(text: AnalyzeArgument, res: AnalyzeArgument) -> AnalyzeResult:
        if text.dataType.typeName() not in ("string", "void"):
            raise ValueError("the first argument of grid_cover is an area's text")
        if res.isConstantExpression and res.value not in codec.RESOLUTIONS:
            raise ValueError(f"the second argument of grid_cover is a resolution, one of {codec.RESOLUTIONS}")
        return AnalyzeResult(schema=COLUMNS)

    def eval(self, text: str, res: int) -> Iterator[tuple[int, int, str]]:
        if text is None or res not in codec.RESOLUTIONS:
            return
        cells: set[tuple[int, int]] = set()
        for ring in areas.parse_area(text).polygons:
            cells |= ring_cells(ring, res)
        step, world = 32 - res, codec.UNITS - 1
        for code in sorted({codec.interleave((y << step) & world, (x << step) & world) for y, x in cells}):
            yield res, codec.signed(code), f"{code:016x}"[: res // 2]


def register(spark: SparkSession) -> str:
    """Make grid_cover known to a session."""
    from pyspark.sql.functions import udtf

    ship(spark)
    spark.udtf.register("grid_cover", udtf(GridCover))
    return "grid_cover"
