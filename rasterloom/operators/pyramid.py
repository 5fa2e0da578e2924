"""Pyramids: level plans, box means on cells, and smoothed linear resampling on tiles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scaled(size: Column, factor: Column) -> Column:
    """Size of a scaled dimension: rounded half to even, 1 at least."""
    return F.greatest(F.lit(1), F.bround(size / factor)).cast("long")


def level_shapes(base: tuple[int, ...], axes: str, factors: list[float], scale_axes: str = "XY") -> list[tuple[int, ...]]:
    return [tuple(max(1, round(n / f)) if d in scale_axes else n for d, n in zip(axes, base, strict=True)) for f in factors]


def progressive_factors(factors: DataFrame, order: str = "i", factor: str = "factor") -> DataFrame:
    """Each factor relative to the level before it."""
    return factors.withColumn("step", F.col(factor) / F.lag(factor, 1, 1.0).over(Window.orderBy(order)))


def source_window(start: Column, stop: Column, factor: Column, size: Column) -> tuple[Column, Column]:
    """The source cells of a target tile in one dimension, half-open."""
    return F.floor(start * factor).cast("long"), F.floor(F.least(stop * factor, size.cast("double"))).cast("long")


def box_mean(cells: DataFrame, factor: int, *keep: str) -> DataFrame:
    """Mean of factor x factor cells, rounded half to even; partial sums are made before the shuffle."""
    box = [F.expr(f"cast({d} div {int(factor)} as int)").alias(d) for d in ("y", "x")]
    sums = cells.groupBy(*keep, *box).agg(F.sum("intensity").alias("__s"), F.count(F.lit(1)).alias("__n"))
    return sums.select(*keep, "y", "x", F.bround(F.col("__s") / F.col("__n")).cast("int").alias("intensity"))


def kernel(start: int, stop: int, factor: float, size: int, smooth: bool = True) -> tuple[int, np.ndarray]:
    """Weights of source cells (rows: targets start..stop) in one dimension, and the first source cell.

    A target's centre lies between two source cells, which are mixed linearly after Gaussian smoothing with a
    deviation of (factor - 1) / 2; cells beyond an edge are mirrored.
    """
    sigma = max(0.0, (factor - 1) / 2) if smooth else 0.0
    reach = math.ceil(4 * sigma) + 1
    centre = (np.arange(start, stop) + 0.5) * factor - 0.5
    base = np.floor(centre).astype(int)
    offset = np.arange(-reach, reach + 2)
    at = base[:, None] + offset[None, :]
    gauss = (lambda d: np.exp(-0.5 * (d / sigma) ** 2)) if sigma else (lambda d: (d == 0).astype(float))
    part = (centre - base)[:, None]
    weight = (1 - part) * gauss(offset)[None, :] + part * gauss(offset - 1)[None, :]
    weight /= weight.sum(axis=1, keepdims=True)
    period = max(1, 2 * (size - 1))
    at = np.abs(at) % period
    at = np.where(at >= size, period - at, at) if size > 1 else np.zeros_like(at)
    low, high = int(at.min()), int(at.max()) + 1
    out = np.zeros((stop - start, high - low))
    np.add.at(out, (np.arange(stop - start)[:, None], at - low), weight)
    return low, out


def resample(tiles: DataFrame, shape: tuple[int, int], factor: float, extent: int, smooth: bool = True) -> DataFrame:
    """A smaller level of a YX image held as tiles (ty, tx, y0, x0, height, width, dtype, data)."""
    made = resample_planes(tiles.withColumn("plane", F.array().cast("array<int>")), shape, factor, extent, smooth)
    index = [F.expr(f"cast({d}0 div {extent} as int)").alias(f"t{d}") for d in "yx"]
    return made.select(*index, *TILE_FIELDS[2:])


def resample_planes(tiles: DataFrame, shape: tuple[int, int], factor: float, extent: int, smooth: bool = True, turned: bool = False) -> DataFrame:
    """Planes of a smaller level, from tiles (plane, y0, x0, height, width, dtype, data); turned: data come out in the order X, Y.

    Each source tile goes to the target tiles whose kernel reaches it, found by tile index, so a target tile is made
    in one task from the few source tiles below it. Values are rounded half to even and clipped to the type.
    """
    (h, w), (nh, nw) = shape, level_shapes(shape, "YX", [factor])[0]
    fy, fx = h / nh, w / nw
    reach = math.ceil(4 * max(0.0, (max(fy, fx) - 1) / 2)) + 3

    def targets(start: str, length: str, f: float, n: int) -> Column:
        lo = F.floor((F.col(start) - reach) / (f * extent)).cast("int")
        hi = F.floor((F.col(start) + F.col(length) + reach) / (f * extent)).cast("int")
        last = F.lit((n - 1) // extent)
        return F.sequence(F.greatest(F.lit(0), F.least(lo, last)), F.greatest(F.lit(0), F.least(hi, last)))

    sent = tiles.withColumn("oy", F.explode(targets("y0", "height", fy, nh))).withColumn("ox", F.explode(targets("x0", "width", fx, nw)))

    def make(part: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(part["oy"].iloc[0]) * extent, int(part["ox"].iloc[0]) * extent
        y1, x1 = min(y0 + extent, nh), min(x0 + extent, nw)
        ly, wy = kernel(y0, y1, fy, h, smooth)
        lx, wx = kernel(x0, x1, fx, w, smooth)
        source = np.zeros((wy.shape[1], wx.shape[1]))
        kind = np.dtype(part["dtype"].iloc[0])
        for t in part.itertuples():
            block = np.frombuffer(t.data, kind).reshape(t.height, t.width)
            a, b = max(t.y0, ly), min(t.y0 + t.height, ly + len(source))
            c, d = max(t.x0, lx), min(t.x0 + t.width, lx + source.shape[1])
            if a < b and c < d:
                source[a - ly : b - ly, c - lx : d - lx] = block[a - t.y0 : b - t.y0, c - t.x0 : d - t.x0]
        value = wy @ source @ wx.T
        if kind.kind in "iu":
            value = np.clip(np.rint(value), np.iinfo(kind).min, np.iinfo(kind).max)
        return pd.DataFrame([(list(part["plane"].iloc[0]), y0, x0, y1 - y0, x1 - x0, kind.name, (value.T if turned else value).astype(kind).tobytes())], columns=["plane", *TILE_FIELDS[2:]])

    return sent.groupBy("plane", "oy", "ox").applyInPandas(make, "plane array<int>, y0 int, x0 int, height int, width int, dtype string, data binary")


TILE_FIELDS = ["ty", "tx", "y0", "x0", "height", "width", "dtype", "data"]
TILE_SCHEMA = "ty int, tx int, y0 int, x0 int, height int, width int, dtype string, data binary"


def tiles_of(cells: DataFrame, shape: tuple[int, int], extent: int, dtype: str = "uint8") -> DataFrame:
    """YX cells packed into tiles; a tile's cells come together in one group of at most extent**2 rows."""
    h, w = shape
    placed = cells.select(F.expr(f"cast(y div {extent} as int)").alias("ty"), F.expr(f"cast(x div {extent} as int)").alias("tx"), "y", "x", "intensity")

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(part["ty"].iloc[0]), int(part["tx"].iloc[0])
        y0, x0 = ty * extent, tx * extent
        block = np.zeros((min(extent, h - y0), min(extent, w - x0)), dtype)
        block[part["y"] - y0, part["x"] - x0] = part["intensity"]
        return pd.DataFrame([(ty, tx, y0, x0, *block.shape, np.dtype(dtype).name, block.tobytes())], columns=TILE_FIELDS)

    return placed.groupBy("ty", "tx").applyInPandas(pack, TILE_SCHEMA)


def cells_in(tiles: DataFrame, region: tuple[int, int, int, int] | None = None, cell_type: str = "int") -> DataFrame:
    """Cells (y, x, intensity) of tiles; region (y0, y1, x0, x1) is cut out of each block before it is spread out."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch.itertuples():
                block = np.frombuffer(t.data, t.dtype).reshape(t.height, t.width)
                a, b, c, d = region or (0, 2**31, 0, 2**31)
                ya, yb, xa, xb = max(a, t.y0), min(b, t.y0 + t.height), max(c, t.x0), min(d, t.x0 + t.width)
                if ya < yb and xa < xb:
                    cut = block[ya - t.y0 : yb - t.y0, xa - t.x0 : xb - t.x0]
                    y, x = np.indices(cut.shape).reshape(2, -1)
                    yield pd.DataFrame({"y": y + ya, "x": x + xa, "intensity": cut.reshape(-1)})

    return tiles.mapInPandas(spread, f"y int, x int, intensity {cell_type}")


def ssim(a: np.ndarray, b: np.ndarray, window: int = 11) -> float:
    """Mean structural similarity of two images, by uniform windows."""
    a, b = a.astype(float), b.astype(float)
    span = max(a.max(), b.max()) - min(a.min(), b.min()) or 1.0

    def mean(z: np.ndarray) -> np.ndarray:
        s = np.pad(z.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        return (s[window:, window:] - s[:-window, window:] - s[window:, :-window] + s[:-window, :-window]) / window**2

    ma, mb = mean(a), mean(b)
    va, vb, cov = mean(a * a) - ma**2, mean(b * b) - mb**2, mean(a * b) - ma * mb
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    return float((((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean())
