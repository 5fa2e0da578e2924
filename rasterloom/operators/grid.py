"""Tile grids: enumeration, counts, and the assignment of cells and regions to tiles."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest tile extents by axis; all channels are in one tile.
DEFAULT_TILES = {"T": 1, "C": 2**31 - 1, "Z": 1, "Y": 1024, "X": 1024}


def extents(axes: str, shape: tuple[int, ...], tiles: dict[str, int] | None = None) -> tuple[int, ...]:
    """Tile extents by axis, overridden by tiles and no larger than the dimension."""
    largest = DEFAULT_TILES | (tiles or {})
    return tuple(min(n, largest[d]) for d, n in zip(axes, shape, strict=True))


def starts(size: Column, step: Column) -> Column:
    return F.sequence(F.lit(0).cast("long"), size.cast("long") - 1, step.cast("long"))


def tile_grid(spark: SparkSession, names: list[str], shape: tuple[int, ...], tile: tuple[int, ...], scale: int = 1) -> DataFrame:
    """All tiles of a grid, row-major: tile_no, and NAME_start and NAME_stop by dimension; the last ones are clipped."""
    out = spark.range(1).select()
    for name, n, t in zip(names, shape, tile, strict=True):
        out = out.select("*", F.explode(starts(F.lit(n), F.lit(t * scale))).alias(f"{name}_start"))
        out = out.withColumn(f"{name}_stop", F.least(F.col(f"{name}_start") + t * scale, F.lit(n)).cast("long"))
    number = F.lit(0).cast("long")
    for name, n, t in zip(names, shape, tile, strict=True):
        number = number * -(-n // (t * scale)) + F.expr(f"{name}_start div {t * scale}")
    return out.select(number.alias("tile_no"), "*")


def iter_tiles(shape: tuple[int, ...], tile: tuple[int, ...], scale: int = 1):
    """The same on the driver, as tuples of slices."""
    steps = [[slice(a, min(a + t * scale, n)) for a in range(0, n, t * scale)] for n, t in zip(shape, tile, strict=True)]
    return product(*steps)


def num_tiles(shape: Column, tile: Column, scale: int = 1) -> Column:
    each = F.zip_with(shape, tile, lambda n, t: F.ceil(n / (t * scale)).cast("long"))
    return F.aggregate(each, F.lit(1).cast("long"), lambda acc, n: acc * n)


def tile_of(coordinate: str, extent: int) -> Column:
    return F.expr(f"cast({coordinate} div {int(extent)} as int)")


def with_tiles(cells: DataFrame, extent: dict[str, int]) -> DataFrame:
    """Add the tile index tD of each coordinate d."""
    return cells.select("*", *[tile_of(d, n).alias(f"t{d}") for d, n in extent.items()])


def covered_tiles(regions: DataFrame, extent: dict[str, int]) -> DataFrame:
    """One row a region (d_lo, d_hi half-open by coordinate d) and tile that it meets: an equi-join key for tiles."""
    out = regions
    for d, n in extent.items():
        out = out.withColumn(f"t{d}", F.explode(F.sequence(tile_of(f"{d}_lo", n), tile_of(f"({d}_hi - 1)", n))))
    return out
