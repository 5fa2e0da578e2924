"""Load image files into a store, build pyramids, and write images back to files."""

from __future__ import annotations

import logging
import sys
import warnings
from collections.abc import Callable
from functools import reduce
from importlib import metadata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions.axes import Layout, stored_layout
from rasterloom.metadata import ome
from rasterloom.operators import grid, pyramid
from rasterloom.operators.slide import Slide
from rasterloom.sinks import tiff, writers
from rasterloom.sources import log, raster, store

#: Writers by name; None: the format can only be read.
WRITERS: dict[str, Callable | None] = {"png": writers.png_file, "tiff": tiff.tiff, "zarr": writers.zarr, "svs": None}


def register_writer(name: str, writer: Callable) -> None:
    """Add a format: writer(tiles, rows of levels, common metadata, destination, **options)."""
    WRITERS[name] = writer


def register_format(name: str, reader: Callable | None = None, writer: Callable | None = None) -> None:
    """Add a format as a pair; one without a reader can only be written, one without a writer only be read."""
    if reader is None and writer is None:
        raise ValueError(f"format {name!r} has neither a reader nor a writer")
    if reader is not None:
        raster.register(name, reader)
    if writer is not None or name not in WRITERS:
        register_writer(name, writer)


def get_logger(verbose: bool = False) -> logging.Logger:
    """The library's logger, to standard output; it tells of each level that is loaded or written if verbose, else of warnings alone."""
    if not LOG.handlers:
        shown = logging.StreamHandler(sys.stdout)
        shown.setFormatter(logging.Formatter("[%(asctime)s] %(name)s %(levelname)s: %(message)s"))
        LOG.addHandler(shown)
    LOG.setLevel(logging.DEBUG if verbose else logging.WARNING)
    return LOG


def load_plugins() -> list[str]:
    """Register the readers, writers and formats (objects with reader and writer) that installed packages declare as entry points; returns their names."""
    found = []
    for point in metadata.entry_points(group="rasterloom.formats"):
        both = point.load()
        register_format(point.name, getattr(both, "reader", None), getattr(both, "writer", None))
        found.append(point.name)
    for group, add in (("rasterloom.readers", raster.register), ("rasterloom.writers", register_writer)):
        for point in metadata.entry_points(group=group):
            add(point.name, point.load())
            found.append(point.name)
    return found


LOG = logging.getLogger("rasterloom")


class MetadataCallbackError(Exception):
    """A user's metadata function failed."""


def filtered_metadata(text: str | None, exclude: bool | Callable[[str], str] | None) -> str | None:
    """Original metadata after exclusion: True prunes OME-XML and drops other text; a function replaces the text."""
    if not exclude:
        return text
    if callable(exclude):
        try:
            return exclude(text or "")
        except Exception as e:
            raise MetadataCallbackError(f"the metadata function failed: {e}") from e
    return ome.prune(text)


def codecs_by_level(compressor: str | dict[int, str] | None, levels: int) -> dict[int, str]:
    """zstd unless told otherwise; a mapping names every level of the source."""
    if isinstance(compressor, dict):
        if len(compressor) != levels:
            raise ValueError(f"{len(compressor)} compressors for {levels} levels")
        return compressor
    return dict.fromkeys(range(levels), compressor or "zstd")


def ingest(
    spark: SparkSession, source: str, path: str, image_id: str, codec: str = "tiff", *, level_min: int = 0, tiles: dict[str, int] | None = None,
    preserve_axes: bool = False, exclude_metadata: bool | Callable[[str], str] | None = None, compressor: str | dict[int, str] | None = None,
    scale_factors: list[float] | None = None, folded: bool = False, tile_scale: int = 1, **options,
) -> Slide:
    """Load a file's levels from level_min on as image_id of the store at path; levels already there are skipped.

    folded: lay the channels of a plane side by side in X; tile_scale: times as many segments a task; options go to the
    reader.
    """
    about = raster.READERS[codec](source, **options).describe()
    if not store.check_version(spark, path, image_id):
        return Slide(spark, path, image_id)
    writer = log.Writer(path, image_id)
    codecs = codecs_by_level(compressor, len(about["levels"]))
    channels = about["image"].get("channels", [])
    for level in about["levels"][level_min:][: 1 if scale_factors else None]:
        depth = dict(zip(about["axes"], level["shape"], strict=True)).get("C", 1) if folded else 1
        axes, change = stored_layout(about["axes"], tuple(level["shape"]), depth, preserve_axes)
        shape = change.shape(tuple(level["shape"]))
        tile = grid.extents(axes, (*shape[:-1], shape[-1] // depth), tiles)
        tile = (*tile[:-1], tile[-1] * depth)
        row = {
            "image_id": image_id, "level": level["level"], "axes": axes, "shape": list(shape), "dtype": level["dtype"], "tile": list(tile),
            "codec": codecs[level["level"]], "pixel_depth": depth, "original_axes": about["axes"], "original_shape": list(level["shape"]), "properties": {"level": str(level["level"])} | ({"tags": store.as_json(level["tags"])} if "tags" in level else {}),
        }
        if depth > 1:  # a channel at a time may come; store.save_level lays them side by side
            change = Layout(about["axes"], "YXC")
        store.save_level(spark, path, row, raster.blocks(spark, source, codec, level["level"], scale=tile_scale, **options).withColumn("image_id", F.lit(image_id)), writer, change)
        LOG.debug("level %s of %s: %s cells of %s", level["level"], image_id, "x".join(map(str, level["shape"])), level["dtype"])
        if level["level"] == level_min:
            add_ranges(spark, path, writer.levels[level_min], channels)
    if scale_factors:
        if len(about["levels"]) > level_min + 1:
            warnings.warn("levels of the source above level_min are replaced by generated ones", stacklevel=2)
        build_pyramid(spark, path, image_id, level_min, scale_factors, writer=writer)
    text = about["original"].get("description") if isinstance(about["original"], dict) else None
    original = store.as_json(about["original"]) if not exclude_metadata else filtered_metadata(text, exclude_metadata)
    store.mark(spark, path, {
        "image_id": image_id, "fmt_version": store.FORMAT_VERSION, "axes": about["axes"], "channels": [c["name"] for c in channels],
        "metadata": store.as_json(about["image"]), "original_metadata": original or "{}", "valid": True,
    }, writer)
    return Slide(spark, path, image_id)


def store_cells(spark: SparkSession, cells: DataFrame, path: str, image_id: str, axes: str, shape: tuple[int, ...], dtypes: dict[str, str], tiles: dict[str, int] | None = None, compressor: str = "zstd") -> Slide:
    """Store a table of cells (a column a coordinate, named like its axis in small letters, and one an attribute) as an image of one level.

    dtypes: the type of each attribute, intensity among them; every cell of the shape must be there once. The cells
    of a tile meet in a task.
    """
    import numpy as np
    import pandas as pd

    if "intensity" not in dtypes:
        raise ValueError("a cell has an intensity")
    tile = dict(zip(axes, grid.extents(axes, shape, tiles), strict=True))
    names, more = [d.lower() for d in axes], list(store.named_well({n: k for n, k in dtypes.items() if n != "intensity"}))

    def block(part: pd.DataFrame) -> pd.DataFrame:
        start = [int(part[d].iloc[0]) // tile[d.upper()] * tile[d.upper()] for d in names]
        size = [min(tile[d], n - s) for d, n, s in zip(axes, shape, start, strict=True)]
        at = tuple(part[d].to_numpy() - s for d, s in zip(names, start, strict=True))
        held = np.zeros(size, np.int64)
        np.add.at(held, at, 1)
        if (held != 1).any():
            raise ValueError(f"the tile at {start} of {image_id!r} lacks cells, or has some twice")
        out = {"image_id": [image_id], "level": [0], "start": [start], "extent": [size], "dtype": [dtypes["intensity"]]}
        for name in ["intensity", *more]:
            whole = np.zeros(size, dtypes[name])
            whole[at] = part[name].to_numpy()
            out["data" if name == "intensity" else f"data_{name}"] = [whole.tobytes()]
        return pd.DataFrame(out)

    schema = ", ".join(["image_id string, level int, start array<int>, extent array<int>, dtype string, data binary", *[f"data_{n} binary" for n in more]])
    placed = grid.with_tiles(cells.select(*names, "intensity", *more), {d: tile[d.upper()] for d in names})
    blocks = placed.groupBy(*[f"t{d}" for d in names]).applyInPandas(lambda part: block(part), schema)
    writer = log.Writer(path, image_id)
    row = {
        "image_id": image_id, "level": 0, "axes": axes, "shape": list(shape), "dtype": dtypes["intensity"], "tile": [tile[d] for d in axes], "codec": compressor, "pixel_depth": 1,
        "original_axes": axes, "original_shape": list(shape), "properties": {"level": "0"}, "attributes": {n: dtypes[n] for n in more},
    }
    store.save_level(spark, path, row, blocks, writer, in_tiles=True)
    store.mark(spark, path, {"image_id": image_id, "fmt_version": store.FORMAT_VERSION, "axes": axes, "channels": [], "metadata": '{"channels": []}', "original_metadata": "{}", "valid": True}, writer)
    return Slide(spark, path, image_id)


def add_ranges(spark: SparkSession, path: str, level: dict, channels: list[dict]) -> None:
    """Give channels the range of their cells, unless the source gave one; read from the stored tiles."""
    measured = {r["c"]: r for r in store.channel_stats(store.level_tiles(spark, path, level), level["axes"], level["pixel_depth"]).collect()}
    for i, channel in enumerate(channels):
        if i in measured:
            channel.setdefault("min", measured[i]["min"])
            channel.setdefault("max", measured[i]["max"])


def build_pyramid(spark: SparkSession, path: str, image_id: str, base: int, factors: list[float], progressive: bool = False, writer: log.Writer | None = None) -> None:
    """Generate levels base+1, ... by smoothed linear resampling, each from the base or from the level before."""
    writer = writer or log.Writer(path, image_id)
    top = writer.levels[base]
    if top["pixel_depth"] > 1:
        raise ValueError("a pyramid can't be made of channels side by side")
    size = dict(zip(top["axes"], top["shape"], strict=True))
    lead = [d for d in top["axes"] if d not in "YX"]
    now, now_size, done = top, size, 1.0
    for i, factor in enumerate(factors):
        step = factor / done if progressive else factor
        source, source_size = (now, now_size) if progressive else (top, size)
        h, w = pyramid.level_shapes((source_size["Y"], source_size["X"]), "YX", [step])[0]
        shape = [{"Y": h, "X": w}.get(d, size[d]) for d in top["axes"]]
        tile = [min(t, n) for t, n in zip(top["tile"], shape, strict=True)]
        row = top | {"level": base + 1 + i, "shape": shape, "tile": tile, "properties": {"level": str(base + 1 + i), "factor": str(factor)}, "attributes": {}}
        row["original_shape"] = [dict(zip(top["axes"], shape, strict=True)).get(d, 1) for d in top["original_axes"]]
        found = store.level_tiles(spark, path, writer.levels[source["level"]])
        sides = [dict(zip(top["axes"], tile, strict=True))[d] for d in "YX"]
        extent = max(sides)
        in_tiles = all(t in (extent, n) for t, n in zip(sides, (h, w), strict=True))
        store.save_level(spark, path, row, resampled_planes(found, top["axes"], lead, (source_size["Y"], source_size["X"]), step, extent, row), writer, in_tiles=in_tiles)
        now, now_size, done = row, dict(zip(top["axes"], shape, strict=True)), factor if progressive else 1.0


def resampled_planes(found: DataFrame, axes: str, lead: list[str], shape: tuple[int, int], factor: float, extent: int, row: dict) -> DataFrame:
    """Blocks of a smaller level: each YX plane of each tile goes to the target tiles that it reaches."""
    import numpy as np
    import pandas as pd

    def planes(batches):
        for batch in batches:
            rows = []
            for t in batch.itertuples():
                block = np.frombuffer(t.data, t.dtype).reshape(tuple(t.extent))
                order = [axes.index(d) for d in lead] + [axes.index("Y"), axes.index("X")]
                start = [int(t.start[k]) for k in order]
                turned = block.transpose(order)
                for where in np.ndindex(turned.shape[:-2]):
                    plane = turned[where]
                    rows.append(([a + b for a, b in zip(start[:-2], where, strict=True)], start[-2], start[-1], *plane.shape, t.dtype, plane.tobytes()))
            yield pd.DataFrame(rows, columns=["plane", "y0", "x0", "height", "width", "dtype", "data"])

    flat = found.mapInPandas(planes, "plane array<int>, y0 int, x0 int, height int, width int, dtype string, data binary")
    made = pyramid.resample_planes(flat, shape, factor, extent, turned=axes.index("X") < axes.index("Y"))
    start = {"Y": F.col("y0"), "X": F.col("x0")} | {d: F.get("plane", F.lit(i)) for i, d in enumerate(lead)}
    size = {"Y": F.col("height"), "X": F.col("width")}
    placed = [F.array(*[start[d] for d in axes]).alias("start"), F.array(*[size.get(d, F.lit(1)) for d in axes]).alias("extent")]
    return made.select(F.lit(row["image_id"]).alias("image_id"), F.lit(row["level"]).alias("level"), *placed, "dtype", "data")


def export(spark: SparkSession, path: str, image_id: str, dest: str, codec: str = "tiff", *, level_min: int = 0, **options) -> None:
    """Write an image's levels from level_min on to a file (or folder) in their original axes; options go to the writer."""
    import json

    writer = WRITERS.get(codec)
    if writer is None:
        raise NotImplementedError(f"images cannot be written as {codec!r}")
    slide = Slide(spark, path, image_id)
    rows = [r for r in slide._levels if r["level"] >= level_min]
    if not rows:
        raise ValueError(f"image {image_id!r} has no level from {level_min} on")
    found = reduce(DataFrame.unionByName, [store.level_tiles(spark, path, r) for r in rows])
    writer(found, rows, json.loads(slide.properties), dest, **options)
    LOG.debug("%s levels of %s written to %s as %s", len(rows), image_id, dest, codec)
