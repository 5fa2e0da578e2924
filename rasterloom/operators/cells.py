"""Reads of cells: regions, levels and slices, as predicates that reach the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slice_predicate(slices: dict[str, tuple[int, int]]) -> Column:
    """Half-open ranges by coordinate; a range past the edge just meets fewer cells."""
    parts = [(F.col(d) >= lo) & (F.col(d) < hi) for d, (lo, hi) in slices.items()]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def tile_predicate(slices: dict[str, tuple[int, int]], extent: dict[str, int]) -> Column:
    """What a region means for tile indices; prunes files and row groups of a tile table."""
    parts = [F.col(f"t{d}").between(lo // extent[d], (hi - 1) // extent[d]) for d, (lo, hi) in slices.items() if d in extent]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def read_region(cells: DataFrame, location: tuple[int, int], size: tuple[int, int], depth: int = 1) -> DataFrame:
    """Cells of x in [x, x+w) and y in [y, y+h), in the frame of the cells' own level; depth: channels folded into x."""
    (x, y), (w, h) = location, size
    return cells.filter(slice_predicate({"y": (y, y + h), "x": (x * depth, (x + w) * depth)}))


def read_level(cells: DataFrame, level: int | None = None, axes: str | None = None) -> DataFrame:
    """All cells of a level; axes: coordinates in this order, absent ones being 0."""
    out = cells if level is None else cells.filter(F.col("level") == level).drop("level")
    if axes is None:
        return out
    have = set(out.columns)
    return out.select(*[F.col(d) if d in have else F.lit(0).alias(d) for d in axes.lower()], "intensity")


def levels_from(cells: DataFrame, level_min: int) -> DataFrame:
    return cells.filter(F.col("level") >= level_min)
