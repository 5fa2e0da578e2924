"""Level algebra, and the slide: one stored image with its levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.operators import cells as reads


def size_of(axis: str, axes: str = "axes", shape: str = "shape") -> Column:
    """A dimension's size in a levels row; 1 if the level lacks it."""
    at = F.instr(F.col(axes), F.lit(axis))
    return F.when(at > 0, F.element_at(shape, F.greatest(at, F.lit(1)))).otherwise(1).cast("long")


def dimensions(levels: DataFrame) -> DataFrame:
    """Per level its width (channels unfolded) and height."""
    width = F.expr("width div pixel_depth").cast("long")
    out = levels.withColumn("width", size_of("X")).withColumn("height", size_of("Y"))
    return out.withColumn("width", width)


def downsamples(levels: DataFrame) -> DataFrame:
    """Per level (image_id, level, width, height): mean ratio of the first level's width and height to its own."""
    first = Window.partitionBy("image_id").orderBy("level").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ratio = (F.first("width").over(first) / F.col("width") + F.first("height").over(first) / F.col("height")) / 2
    return levels.withColumn("downsample", ratio)


def best_levels(levels: DataFrame, factors: DataFrame) -> DataFrame:
    """Per factor the position of the last level with a downsample strictly below it, else 0.

    Levels of an image are few, so they travel as one array a row of factors.
    """
    order = Window.partitionBy("image_id").orderBy("level")
    placed = levels.withColumn("position", (F.row_number().over(order) - 1).cast("int"))
    arrays = placed.groupBy("image_id").agg(F.collect_list(F.struct("position", "downsample")).alias("all"))
    below = F.filter("all", lambda s: s["downsample"] < F.col("factor"))
    best = F.coalesce(F.array_max(F.transform(below, lambda s: s["position"])), F.lit(0))
    return factors.join(arrays, "image_id").select("image_id", "factor", best.cast("int").alias("position"))


def with_depths(levels: DataFrame, known: DataFrame) -> DataFrame:
    """Levels with the pixel_depth that known records by level, 1 where it records none."""
    found = known.select("level", F.col("pixel_depth").alias("__depth"))
    return levels.join(found, "level", "left").withColumn("pixel_depth", F.coalesce("__depth", F.lit(1)).cast("int")).drop("__depth")


def missing_levels(planned: DataFrame, stored: DataFrame) -> DataFrame:
    """Planned levels that stored lacks, by image and level."""
    return planned.join(stored, ["image_id", "level"], "left_anti")


class Slide:
    """A stored image; opening it reads metadata only, pixels stay lazy DataFrames."""

    def __init__(self, spark: SparkSession, path: str, image_id: str):
        from rasterloom.sources import store

        self._spark, self._path, self.image_id = spark, path, image_id
        image, levels = store.image_rows(path, image_id)
        if image is None or not image["valid"]:
            raise KeyError(f"no valid image {image_id!r} in {path}")
        self.properties = image["metadata"]
        size = [dict(zip(r["axes"], r["shape"], strict=True)) for r in levels]
        self._levels = [r | {"width": n.get("X", 1) // r["pixel_depth"], "height": n.get("Y", 1)} for r, n in zip(levels, size, strict=True)]
        if not self._levels:
            raise RuntimeError(f"image {image_id!r} in {path} has no levels")

    @property
    def levels(self) -> list[int]:
        return [r["level"] for r in self._levels]

    @property
    def level_count(self) -> int:
        return len(self._levels)

    @property
    def level_dimensions(self) -> list[tuple[int, int]]:
        return [(r["width"], r["height"]) for r in self._levels]

    @property
    def dimensions(self) -> tuple[int, int]:
        return self.level_dimensions[0]

    @property
    def level_downsamples(self) -> list[float]:
        w, h = self.dimensions
        return [(w / a + h / b) / 2 for a, b in self.level_dimensions]

    def level_properties(self, position: int) -> dict:
        return self._levels[position]["properties"]

    def best_level_for_downsample(self, factor: float) -> int:
        return max((i for i, d in enumerate(self.level_downsamples) if d < factor), default=0)

    def read_level(self, position: int, original_axes: bool = False, attribute: str = "intensity") -> DataFrame:
        """Cells of the level at a position in the sorted list, with one attribute; in its original axes, or as y, x, c."""
        row = self._levels[position]
        return self._read(row, {}, row["original_axes"] if original_axes else None, attribute)

    def read_region(self, location: tuple[int, int], position: int, size: tuple[int, int], attribute: str = "intensity") -> DataFrame:
        """Cells of a region, in the level's own frame; neither tiles outside nor other attributes are read."""
        (x, y), (w, h) = location, size
        return self._read(self._levels[position], {"y": (y, y + h), "x": (x, x + w)}, None, attribute)

    def attributes(self, position: int) -> dict[str, str]:
        """The attributes of a level's cells, with their types."""
        row = self._levels[position]
        return {"intensity": row["dtype"]} | (row.get("attributes") or {})

    def _read(self, row, slices: dict, axes: str | None, attribute: str) -> DataFrame:
        from rasterloom.sources import store

        if axes is None:
            deep = [d for d, n in zip(row["axes"], row["shape"], strict=True) if d in "TZ" and n > 1]
            if deep:
                raise ValueError(f"dimensions {deep} have several coordinates; read the level in its original axes")
        found = store.cells(self._spark, self._path, self.image_id, row, slices, attribute)
        return reads.read_level(found, axes=axes or "YXC").withColumnRenamed("intensity", attribute)
