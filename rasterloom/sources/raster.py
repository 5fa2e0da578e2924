"""The Spark data source `raster`: spark.read.format("raster").option("codec", "tiff").load(path) gives pixel blocks.

A partition is a run of segments (strips, tiles or chunks), read by ranges, so a large file is spread over tasks.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator, Mapping
from importlib import metadata
from typing import Protocol

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rasterloom.sources import files
from rasterloom.sources.png import PngFile
from rasterloom.sources.tiff import ScannedSlide, TiffFile
from rasterloom.sources.zarr import ZarrImage

BLOCKS = "level int, start array<int>, extent array<int>, dtype string, data binary"
SEGMENTS_A_TASK = 64


class Reader(Protocol):
    """What a format has to bring: an image at a URI, which can be pickled, in segments that are read one by one."""

    def describe(self) -> dict:
        """axes, levels (level, shape, dtype and, if there are any, tags), image (the common metadata) and original."""

    def segments(self, level: int) -> int: ...

    def segment(self, level: int, i: int) -> tuple[tuple[int, ...], np.ndarray]:
        """Start and pixels."""

    def bounds(self, level: int, i: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """Start and extent without reading; a reader without this method reads whole levels."""

    def place(self, level: int, i: int) -> tuple[str, int, int]:
        """File, offset and length of a segment's bytes, 0 for one without any; may be left out, together with decode()."""

    def decode(self, level: int, i: int, data: bytes) -> tuple[tuple[int, ...], np.ndarray]:
        """Start and pixels of a segment from its bytes."""


#: Readers by name; register() adds to them.
READERS: dict[str, Callable[..., Reader]] = {"png": PngFile, "tiff": TiffFile, "svs": ScannedSlide, "zarr": ZarrImage}


_BUILT_IN = frozenset(READERS)


def register(name: str, reader: Callable[..., Reader]) -> None:
    READERS[name] = reader


def packed_reader(codec: str) -> dict[str, str]:
    """An option that carries a registered reader to Spark's own processes, which know the built-in ones alone."""
    return {} if codec in _BUILT_IN else {"pickled": base64.b64encode(cloudpickle.dumps(READERS[codec])).decode()}


def reader_of(codec: str, options: Mapping[str, str]) -> Callable[..., Reader]:
    """The reader of a format: a registered one, one that the options carry, or an installed package's."""
    if codec in READERS:
        return READERS[codec]
    if "pickled" in options:
        return cloudpickle.loads(base64.b64decode(options["pickled"]))
    for point in metadata.entry_points(group="rasterloom.readers"):
        if point.name == codec:
            return point.load()
    raise ValueError(f"there is no reader of {codec!r}")


def segments(image: Reader, level: int, wanted: list[int]) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """Start and pixels of some segments; where their places are known, neighbours are read together (files.read_ranges)."""
    if not hasattr(image, "place"):
        yield from (image.segment(level, i) for i in wanted)
        return
    places = [image.place(level, i) for i in wanted]
    held = [k for k, (_, _, size) in enumerate(places) if size]
    yield from (image.decode(level, i, b"") for i, (_, _, size) in zip(wanted, places, strict=True) if not size)
    for k, data in files.read_ranges([places[k] for k in held]):
        yield image.decode(level, wanted[held[k]], bytes(data))


class Run(InputPartition):
    def __init__(self, level: int, segments: list[int]):
        self.level, self.segments = level, segments


class RasterReader(DataSourceReader):
    """The file's directory is read once, by the driver, and goes to the tasks; a region leaves out segments that it doesn't meet."""

    def __init__(self, reader: Callable[..., Reader], path: str, level: int, region: dict[str, tuple[int, int]] | None = None, options: dict | None = None, scale: int = 1):
        self.image, self.level = reader(path, **(options or {})), level
        self.step = SEGMENTS_A_TASK * scale
        axes = self.image.describe()["axes"] if region else ""
        self.region = [(axes.index(d), lo, hi) for d, (lo, hi) in (region or {}).items()]

    def _meets(self, i: int) -> bool:
        start, extent = self.image.bounds(self.level, i)
        return all(start[k] < hi and start[k] + extent[k] > lo for k, lo, hi in self.region)

    def partitions(self) -> list[Run]:
        found = [i for i in range(self.image.segments(self.level)) if not self.region or not hasattr(self.image, "bounds") or self._meets(i)]
        return [Run(self.level, found[a : a + self.step]) for a in range(0, len(found), self.step)]

    def read(self, partition: Run) -> Iterator[tuple]:
        for start, block in segments(self.image, partition.level, partition.segments):
            start = list(map(int, start))
            for k, lo, hi in self.region:
                low, high = max(lo, start[k]), min(hi, start[k] + block.shape[k])
                block = block[(slice(None),) * k + (slice(max(0, low - start[k]), max(0, high - start[k])),)]
                start[k] = low
            if block.size:
                yield partition.level, start, list(block.shape), block.dtype.name, np.ascontiguousarray(block).tobytes()


class RasterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return BLOCKS

    def writer(self, schema, overwrite: bool):
        from rasterloom.sinks.tiff import TiffWriter

        if self.options.get("codec") != "tiff":
            raise ValueError("blocks can be written as tiff only")
        return TiffWriter(self.options, overwrite)

    def reader(self, schema) -> RasterReader:
        region, options = (json.loads(self.options.get(k, "{}")) for k in ("region", "reader"))
        return RasterReader(reader_of(self.options["codec"], self.options), self.options["path"], int(self.options.get("level", "0")), region, options, int(self.options.get("scale", "1")))


def blocks(spark: SparkSession, path: str, codec: str, level: int, region: dict[str, tuple[int, int]] | None = None, scale: int = 1, **options) -> DataFrame:
    """Blocks of a level; region: half-open ranges by axis, by which segments are left out and cut; scale: times as many segments a task; options go to the reader."""
    spark.dataSource.register(RasterSource)
    found = spark.read.format("raster").options(**packed_reader(codec)).option("codec", codec).option("level", str(level)).option("scale", str(scale))
    return found.option("region", json.dumps(region or {})).option("reader", json.dumps(options)).load(path)
