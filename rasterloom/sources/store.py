"""Stored images: Parquet tables of tiles, and a log of what images and levels there are (sources.log).

A load writes tiles into a folder of its own, then commits the level's row, which names the load, and last the row of the image
with valid = true. Tiles of a load that no level names are never read, so a load that broke off leaves nothing behind that
counts, and vacuum() removes it; images without a valid row are incomplete and are loaded again. A load must bring every
cell of its level, else it fails before it counts. Levels that a valid image already has are skipped, and a store of
another format version is left alone with a warning. Of two writers that load one image at the same time, one fails.

images() and levels() are tables over the whole log; image_rows() opens one image, by reading one folder of the log.

A cell may have further attributes beside its intensity: the level's row names them with their types, and a tile holds the
pixels of each in a column of its own, data_NAME. So reading one attribute leaves the bytes of the others unread.

A region read opens one load's folder. Its files hold bands of neighbouring tiles in order, in small row groups, so tile
rows and columns prune files and row groups by their statistics.
"""

from __future__ import annotations

import json
import math
import re
import uuid
import warnings
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import dtypes
from rasterloom.functions.axes import Layout
from rasterloom.operators.cells import tile_predicate
from rasterloom.sources import files, log

FORMAT_VERSION = 3
IMAGES = "image_id string, fmt_version int, axes string, channels array<string>, metadata string, original_metadata string, valid boolean"
LEVELS = (
    "image_id string, level int, axes string, shape array<long>, dtype string, tile array<long>, codec string, pixel_depth int, "
    "original_axes string, original_shape array<long>, properties map<string,string>, load_id string, attributes map<string,string>"
)
TILES = "image_id string, level int, ty int, tx int, tc int, tz int, tt int, start array<int>, extent array<int>, dtype string, data binary"
STORED = TILES + ", load_id string"
#: What each file of a load holds; Spark's readers pass over names that begin like this.
PARTS = "_parts.json"
#: Neighbouring tiles that are written together, and the size of row groups.
BAND, ROW_GROUP = 16, 16 << 20


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def _states(spark: SparkSession, path: str) -> DataFrame:
    """The newest state of each image in the log."""
    kinds = f"image_id string, commit long, image struct<{_fields(IMAGES)}>, levels array<struct<{_fields(LEVELS)}>>"
    try:
        lines = spark.read.schema(kinds).json(f"{path}/log")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        lines = spark.createDataFrame([], kinds)
    # a state stands in its commit and in later snapshots
    return lines.groupBy("image_id").agg(F.max_by(F.struct("image", "levels"), "commit").alias("r")).select("image_id", "r.*")


def _fields(schema: str) -> str:
    return re.sub(r"(\w+) ([a-z]+(<[^>]*>)?)", r"\1: \2", schema)


def images(spark: SparkSession, path: str) -> DataFrame:
    return _states(spark, path).filter("image is not null").select("image.*")


def levels(spark: SparkSession, path: str) -> DataFrame:
    return _states(spark, path).select(F.explode("levels").alias("r")).select("r.*")


def image_rows(path: str, image_id: str) -> tuple[dict | None, list[dict]]:
    """The row of an image and those of its levels, from one folder of the log."""
    held = log.Writer(path, image_id)
    return held.image, list(held.levels.values())


def tiles(spark: SparkSession, path: str) -> DataFrame:
    """Tiles of the loads that levels name."""
    return _read(spark, f"{path}/tiles", STORED).join(levels(spark, path).select("load_id"), "load_id", "left_semi").drop("load_id")


def level_tiles(spark: SparkSession, path: str, level: dict, attribute: str = "intensity") -> DataFrame:
    """Tiles of one level, from the folder of its load, with the pixels of one attribute."""
    folder = f"{path}/tiles/load_id={level['load_id']}"
    if attribute == "intensity":
        return _read(spark, folder, TILES)
    kinds = level.get("attributes") or {}
    if attribute not in kinds:
        raise KeyError(f"level {level['level']} has no attribute {attribute!r}, but {['intensity', *kinds]}")
    place = [c for c in TILES.split(", ") if c.split()[0] not in ("dtype", "data")]
    found = _read(spark, folder, ", ".join([*place, f"data_{attribute} binary"]))
    return found.select(*[c.split()[0] for c in place], F.lit(kinds[attribute]).alias("dtype"), F.col(f"data_{attribute}").alias("data"))


def named_well(attributes: dict[str, str]) -> dict[str, str]:
    """The attributes, if they can be names of columns."""
    if wrong := [n for n in attributes if not re.fullmatch(r"[A-Za-z_]\w*", n, re.ASCII) or n == "intensity"]:
        raise ValueError(f"{wrong} are no names of attributes")
    return attributes


def tile_schema(attributes: dict[str, str]) -> str:
    return ", ".join([TILES, *[f"data_{name} binary" for name in attributes]])


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the tiles of loads that no level names, which broke off or were replaced, and old parts of the log; returns how many loads. Not while a load runs."""
    from pyarrow import fs

    store, folder = files.store_of(f"{path}/tiles")
    named = {f"load_id={r['load_id']}" for r in levels(spark, path).select("load_id").collect()}
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    gone = [f for f in found if f.base_name.startswith("load_id=") and f.base_name not in named]
    for f in gone:
        store.delete_dir(f.path)
    log.trim(path)
    return len(gone)


def mark(spark: SparkSession, path: str, row: dict, writer: log.Writer | None = None) -> None:
    """Commit the row of an image; writer: the one that committed its levels."""
    (writer or log.Writer(path, row["image_id"])).commit(image={c.split()[0]: row.get(c.split()[0]) for c in IMAGES.split(", ")})


def split_tiles(blocks: DataFrame, axes: str, tile: dict[str, int], attributes: dict[str, str], change: Layout | None = None) -> DataFrame:
    """Blocks (image_id, level, start, extent, dtype, data, and data_NAME of each attribute), cut along the tile grid.

    A block may span several tiles and a tile several blocks; pieces of a tile meet in merge_tiles(). change brings
    blocks of other axes into the stored ones, in the same pass: each pass is a Python worker more a task.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for b in batch.itertuples():
                each = [np.frombuffer(getattr(b, c), k or b.dtype).reshape(tuple(b.extent)) for c, k in columns.items()]
                begin = b.start
                if change is not None:
                    begin = [s.start or 0 for s in change.tile(tuple(slice(int(s), int(s) + int(n)) for s, n in zip(b.start, b.extent, strict=True)))]
                    each = [change.array(block) for block in each]
                steps = []
                for d, s, n in zip(axes, begin, each[0].shape, strict=True):
                    t = tile[d]
                    steps.append([(k, max(s, k * t), min(s + n, (k + 1) * t)) for k in range(s // t, (s + n - 1) // t + 1)])
                for where in product(*steps):
                    index = dict(zip(axes, (k for k, _, _ in where), strict=True))
                    inside = tuple(slice(lo - s, hi - s) for (_, lo, hi), s in zip(where, begin, strict=True))
                    place = (*[index.get(d, 0) for d in "YXCZT"], [lo for _, lo, _ in where], [hi - lo for _, lo, hi in where])
                    rows.append((b.image_id, b.level, *place, b.dtype, *[block[inside].tobytes() for block in each]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    columns, schema = {"data": None} | {f"data_{name}": kind for name, kind in attributes.items()}, tile_schema(attributes)
    return blocks.mapInPandas(cut, schema)


def placed_tiles(blocks: DataFrame, axes: str, tile: dict[str, int], attributes: dict[str, str]) -> DataFrame:
    """What split_tiles() gives of blocks that each lie within one tile, without a pass of Python."""
    index = {d: F.expr(f"cast(start[{i}] div {tile[d]} as int)") for i, d in enumerate(axes)}
    place = [index.get(d, F.lit(0)).alias(f"t{d.lower()}") for d in "YXCZT"]
    return blocks.select("image_id", "level", *place, "start", "extent", "dtype", "data", *[f"data_{name}" for name in attributes])


def merge_tiles(pieces: DataFrame, axes: str, tile: dict[str, int], shape: tuple[int, ...], attributes: dict[str, str]) -> DataFrame:
    """Pieces of the same tile put together, bands of neighbouring tiles in a task; a tile is bounded, so its group is. A hole fails."""
    size = dict(zip(axes, shape, strict=True))
    across = -(-size["X"] // tile["X"])
    keys = ["band", "image_id", "level", "ty", "tx", "tc", "tz", "tt"]
    placed = pieces.withColumn("band", F.expr(f"cast((cast(ty as long) * {across} + tx) div {BAND} as long)")).repartition("band")

    def join(part: pd.DataFrame) -> pd.DataFrame:
        first = part.iloc[0]
        at = [int(first["t" + d.lower()]) * tile[d] for d in axes]
        size = [min(tile[d], n - a) for d, n, a in zip(axes, shape, at, strict=True)]
        covered, kinds = np.zeros(size, bool), {"data": first["dtype"]} | {f"data_{name}": kind for name, kind in attributes.items()}
        whole = {c: np.zeros(size, kind) for c, kind in kinds.items()}
        for p in part.itertuples():
            place = tuple(slice(s - a, s - a + n) for s, n, a in zip(p.start, p.extent, at, strict=True))
            for c, kind in kinds.items():
                whole[c][place] = np.frombuffer(getattr(p, c), kind).reshape(tuple(p.extent))
            covered[place] = True
        if not covered.all():  # pieces that overlap can't make up for a hole
            raise ValueError(f"pieces of the tile at {at} of level {first['level']} are missing")
        out = part.iloc[:1].drop(columns="band")
        out["start"], out["extent"] = [at], [size]
        for c, block in whole.items():
            out[c] = [block.tobytes()]
        return out

    return placed.groupBy(*keys).applyInPandas(join, tile_schema(attributes))


def channel_stats(found: DataFrame, axes: str, depth: int = 1) -> DataFrame:
    """Least and largest cell by channel: reduced per tile, then merged; depth: channels side by side in X."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch.itertuples():
                block = np.frombuffer(t.data, t.dtype).reshape(tuple(t.extent))
                if depth > 1:
                    block = block.reshape(*block.shape[:-1], -1, depth)
                each = np.moveaxis(block, -1 if depth > 1 else axes.index("C"), 0) if depth > 1 or "C" in axes else block[None]
                base = t.start[axes.index("C")] if "C" in axes else 0
                rows += [(t.level, base + k, float(c.min()), float(c.max())) for k, c in enumerate(each)]
            yield pd.DataFrame(rows, columns=["level", "c", "min", "max"])

    from rasterloom.operators.stats import merge_minmax

    return merge_minmax(found.mapInPandas(partial, "level int, c int, min double, max double"), "level", "c")


def parts_of(found: DataFrame) -> list[dict]:
    """A record a file of a load: its name, tiles, and least and largest tile index by axis."""
    spans = [x.alias(f"{c}_{n}") for c in ("ty", "tx", "tc", "tz", "tt") for n, x in (("lo", F.min(c)), ("hi", F.max(c)))]
    each = found.groupBy(F.regexp_extract(F.input_file_name(), "[^/]+$", 0).alias("file")).agg(F.count(F.lit(1)).alias("tiles"), *spans)
    return [r.asDict() for r in each.orderBy("file").collect()]


def save_level(spark: SparkSession, path: str, level: dict, blocks: DataFrame, writer: log.Writer | None = None, change: Layout | None = None, in_tiles: bool = False) -> bool:
    """Write a level's blocks as tiles and commit its row; False if a valid image already has it. writer: that of the other levels.

    Blocks come in the level's axes, or in those that change brings into them; for a level with channels side by side
    in X that is YXC. in_tiles: each block lies within one tile, and has these axes already.
    """
    writer = writer or log.Writer(path, level["image_id"])
    if (writer.image or {}).get("valid") and level["level"] in writer.levels:
        return False
    axes, shape, extents, depth = level["axes"], tuple(level["shape"]), list(level["tile"]), level["pixel_depth"]
    if depth > 1:
        axes, shape, extents = "YXC", (shape[0], shape[1] // depth, depth), [extents[0], extents[1] // depth, depth]
    tile = dict(zip(axes, extents, strict=True))
    attributes = named_well(dict(level.get("attributes") or {}))
    if attributes and depth > 1:
        raise ValueError("channels side by side have no further attributes")
    pieces = placed_tiles(blocks, axes, tile, attributes) if in_tiles else split_tiles(blocks, axes, tile, attributes, change)
    packed = merge_tiles(pieces, axes, tile, shape, attributes)
    if depth > 1:  # a block of YXC lies in memory as one of YX with channels side by side
        side_by_side = [F.array(F.get(c, F.lit(0)), F.get(c, F.lit(1)) * depth).alias(c) for c in ("start", "extent")]
        packed = packed.select(*[c for c in packed.columns if c not in ("start", "extent")], *side_by_side).select(*packed.columns)
    load = uuid.uuid4().hex
    folder = f"{path}/tiles/load_id={load}"
    packed.write.option("compression", level["codec"]).option("parquet.block.size", ROW_GROUP).parquet(folder)
    expected = math.prod(-(-n // t) for n, t in zip(level["shape"], level["tile"], strict=True))
    parts = parts_of(spark.read.schema(TILES).parquet(folder))
    if (found := sum(p["tiles"] for p in parts)) != expected:
        raise ValueError(f"level {level['level']} of {level['image_id']!r} has {found} of {expected} tiles")
    files.write_whole(f"{folder}/{PARTS}", json.dumps(parts).encode())
    named = level | {"load_id": load, "attributes": attributes}
    writer.commit(level={c.split()[0]: named[c.split()[0]] for c in LEVELS.split(", ")})
    return True


def check_version(spark: SparkSession, path: str, image_id: str) -> bool:
    """Whether this version may write the image; read before the valid mark is taken away."""
    row, _ = image_rows(path, image_id)
    if row is None or row["fmt_version"] == FORMAT_VERSION:
        return True
    warnings.warn(f"image {image_id!r} has another format version and is left as it is", stacklevel=2)
    return False


def cells(spark: SparkSession, path: str, image_id: str, level: dict, slices: dict[str, tuple[int, int]] | None = None, attribute: str = "intensity") -> DataFrame:
    """Cells of a stored level, with one attribute, which is called intensity; slices become tile predicates first, then cut each block before it is spread out.

    Channels folded into X come back as c.
    """
    axes, depth = level["axes"], level["pixel_depth"]
    slices = dict(slices or {})
    if depth > 1 and "x" in slices:
        slices["x"] = tuple(n * depth for n in slices["x"])
    extent = {d.lower(): n for d, n in zip(axes, level["tile"], strict=True)}
    channels = slices.pop("c", None) if depth > 1 else None
    found = level_tiles(spark, path, level, attribute).filter(tile_predicate(slices, extent))
    names = [d.lower() for d in axes]

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch.itertuples():
                block = np.frombuffer(t.data, t.dtype).reshape(tuple(t.extent))
                lows = [max(s, slices.get(d, (s, 0))[0]) for d, s in zip(names, t.start, strict=True)]
                highs = [min(s + n, slices.get(d, (0, s + n))[1]) for d, s, n in zip(names, t.start, t.extent, strict=True)]
                if all(a < b for a, b in zip(lows, highs, strict=True)):
                    piece = block[tuple(slice(a - s, b - s) for a, b, s in zip(lows, highs, t.start, strict=True))]
                    at = np.indices(piece.shape).reshape(len(names), -1)
                    yield pd.DataFrame({d: at[i] + lows[i] for i, d in enumerate(names)} | {"intensity": piece.reshape(-1)})

    kind = dtypes.spark_type(level["dtype"] if attribute == "intensity" else level["attributes"][attribute])
    out = found.mapInPandas(spread, ", ".join([*[f"{d} int" for d in names], f"intensity {kind}"]))
    if depth > 1:
        from rasterloom.functions.axes import unfold

        out = unfold(out, depth)
    return out if channels is None else out.filter(F.col("c").between(channels[0], channels[1] - 1))


def as_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, default=str)
