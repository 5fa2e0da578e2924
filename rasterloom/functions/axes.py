"""Axes of an image and the mappings between layouts, for shapes, tiles, numpy blocks and cell DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = "TCZYX"


@dataclass(frozen=True)
class Axes:
    """Names of an array's dimensions: X and Y, no name twice, at most one that is not of TCZYX."""

    dims: str

    def __post_init__(self) -> None:
        dims = self.dims
        if len(set(dims)) != len(dims):
            raise ValueError(f"axes {dims!r} name a dimension twice")
        if not {"X", "Y"} <= set(dims):
            raise ValueError(f"axes {dims!r} need X and Y")
        if len(set(dims) - set(ORDER)) > 1:
            raise ValueError(f"axes {dims!r} have more than one unknown dimension")

    def named(self) -> Axes:
        """An unknown dimension stands for T, or for Z if there is a T."""
        other = next(iter(set(self.dims) - set(ORDER)), None)
        if other is None:
            return self
        free = next((d for d in "TZC" if d not in self.dims), None)
        if free is None:
            raise ValueError(f"axes {self.dims!r} leave no name for {other!r}")
        return Axes(self.dims.replace(other, free))

    def canonical(self, shape: tuple[int, ...]) -> Axes:
        """Stored order TCZYX without dimensions of size 1; X and Y always stay."""
        own = self.named()
        large = {d for d, n in zip(own.dims, shape, strict=True) if n > 1 or d in "XY"}
        return Axes("".join(d for d in ORDER if d in large))


@dataclass(frozen=True)
class Layout:
    """How an array in the order `source` lies in the order `target`; either may hold `depth` channels side by side in its last axis X.

    Dimensions that the target lacks have size 1 and go; those that the source lacks come in with size 1.
    """

    source: str
    target: str
    source_depth: int = 1
    target_depth: int = 1

    def __post_init__(self) -> None:
        for dims, depth in ((self.source, self.source_depth), (self.target, self.target_depth)):
            if depth > 1 and (dims[-1] != "X" or "C" in dims):
                raise ValueError(f"axes {dims!r} can't hold channels in X")

    def back(self) -> Layout:
        return Layout(self.target, self.source, self.target_depth, self.source_depth)

    @property
    def _named(self) -> tuple[str, str]:
        """Both orders with channels as a dimension of their own."""
        return tuple(dims + "C" * (depth > 1) for dims, depth in ((self.source, self.source_depth), (self.target, self.target_depth)))

    def shape(self, sizes: tuple[int, ...]) -> tuple[int, ...]:
        names, wanted = self._named
        sizes = tuple(sizes)
        if self.source_depth > 1:
            sizes = (*sizes[:-1], sizes[-1] // self.source_depth, self.source_depth)
        held = dict(zip(names, sizes, strict=True))
        if any(n != 1 for d, n in held.items() if d not in wanted):
            raise ValueError(f"dimensions of {self.source!r} that {self.target!r} lacks must have size 1")
        out = [held.get(d, 1) for d in wanted]
        if self.target_depth > 1:
            if out[-1] != self.target_depth:
                raise ValueError(f"{out[-1]} channels where {self.target_depth} lie side by side")
            out[-2:] = [out[-2] * out[-1]]
        return tuple(out)

    def tile(self, tile: tuple[slice, ...]) -> tuple[slice, ...]:
        """Where a tile of the source lies in the target; an added dimension is whole."""
        names, wanted = self._named
        tile = tuple(tile)
        if self.source_depth > 1:
            x, n = tile[-1], self.source_depth
            tile = (*tile[:-1], slice(x.start // n, -(-x.stop // n)), slice(0, n))
        held = dict(zip(names, tile, strict=True))
        out = [held.get(d, slice(None)) for d in wanted]
        if self.target_depth > 1:
            x, c = out[-2:]
            if (c.start or 0, c.stop or self.target_depth) != (0, self.target_depth):
                raise ValueError("a tile with channels side by side has all of them")
            out[-2:] = [slice(x.start * self.target_depth, x.stop * self.target_depth)]
        return tuple(out)

    def array(self, a: np.ndarray) -> np.ndarray:
        names, wanted = self._named
        shape = self.shape(a.shape)
        if self.source_depth > 1:
            a = a.reshape(*a.shape[:-1], a.shape[-1] // self.source_depth, self.source_depth)
        gone = [d for d in names if d not in wanted]
        turned = a.transpose([names.index(d) for d in gone] + [names.index(d) for d in wanted if d in names])
        return turned.reshape(shape)


def stored_layout(source: str, shape: tuple[int, ...], folded: int = 1, preserve: bool = False) -> tuple[str, Layout]:
    """Stored axes and the layout of an array of the source's axes in them: YX with channels side by side, the source's own, or canonical."""
    if folded > 1:
        return "YX", Layout(source, "YX", 1, folded)
    if preserve:
        return source, Layout(source, source)
    own = Axes(source)
    target = own.canonical(shape).dims
    return target, Layout(own.named().dims, target)


def level_layout(level: dict) -> Layout:
    """From a stored level's axes to its original ones."""
    original = level["original_axes"]
    return Layout(level["axes"], original if original == level["axes"] else Axes(original).named().dims, level.get("pixel_depth") or 1, 1)


def canonical_axes(shape: Column) -> Column:
    """The canonical axes of an image with sizes in the order TCZYX: those of more than one cell, and X and Y."""
    names = F.array(*[F.lit(d) for d in ORDER])
    return F.array_join(F.filter(names, lambda d, i: (F.get(shape, i) > 1) | d.isin("X", "Y")), "")


def axes_held(axes: Column, pixel_depth: Column) -> Column:
    """Which original axes each stored axis holds, as a map: itself, and X also C where channels lie side by side."""
    names = F.filter(F.split(axes, ""), lambda d: d != "")
    held = F.transform(names, lambda d: F.when((d == "X") & (pixel_depth > 1), F.array(d, F.lit("C"))).otherwise(F.array(d)))
    return F.map_from_arrays(names, held)


def distances(given: Column, orders: tuple[str, ...]) -> Column:
    """Edits (insert, delete, replace) from axes to each of the orders, as an array of (distance, place, target)."""
    each = [F.struct(F.levenshtein(given, F.lit(o)).alias("distance"), F.lit(i).alias("place"), F.lit(o).alias("target")) for i, o in enumerate(orders)]
    return F.array(*each)


def nearest(given: Column, orders: tuple[str, ...]) -> Column:
    """The order of fewest edits, the first of several."""
    return F.array_min(distances(given, orders))


# ---- the same on cells: coordinates are columns, so a permutation is a projection


def swap(cells: DataFrame, a: str, b: str) -> DataFrame:
    names = {a: b, b: a}
    return cells.select(*[F.col(c).alias(names.get(c, c)) for c in cells.columns])


def move(cells: DataFrame, axis: str, to: int) -> DataFrame:
    rest = [c for c in cells.columns if c != axis]
    rest.insert(to, axis)
    return cells.select(*rest)


def squeeze(cells: DataFrame, axis: str) -> DataFrame:
    """Drop a dimension of size 1; a cell beyond it fails the job."""
    wrong = F.raise_error(F.lit(f"dimension {axis} has more than one coordinate"))
    checked = F.when(F.col(axis) == 0, F.col("intensity")).otherwise(wrong.cast(cells.schema["intensity"].dataType))
    return cells.withColumn("intensity", checked).drop(axis)


def unsqueeze(cells: DataFrame, axis: str, to: int = 0) -> DataFrame:
    return move(cells.withColumn(axis, F.lit(0)), axis, to)


def fold(cells: DataFrame, channels: int) -> DataFrame:
    folded = cells.withColumn("x", (F.col("x") * channels + F.col("c")).cast("int"))
    return folded.drop("c")


def unfold(cells: DataFrame, channels: int) -> DataFrame:
    split = cells.withColumn("c", F.pmod(F.col("x"), F.lit(channels)).cast("int"))
    return split.withColumn("x", F.expr(f"cast(x div {int(channels)} as int)"))
