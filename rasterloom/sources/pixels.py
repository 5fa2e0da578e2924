"""Spark data sources whose rows are cells, and which read only what given ranges of coordinates meet.

raster_cells  a file: options codec, path, and level or none for all levels; reader: the reader's own options as JSON
stored_cells  a stored image: options path, image, and level or none for all levels

Columns are level, the image's axes in small letters, and intensity. A half-open range by axis, such as x '0:100' (either
end may be left out), is an option like the others, so that views over parts of images can be made in SQL. Segments, or
files and row groups of tiles, that don't meet the ranges are left out of the partitions, and blocks are cut before they
are spread into rows. functions.tables has the same as a function for lateral joins, with ranges from columns.

Filters are not pushed down by Spark itself: in Spark 4.1 all scans of one relation share what the last of them pushed
into a Python source, so that df.filter("x = 1").union(df.filter("x = 2")) gives the rows of x = 2 twice.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rasterloom.functions import dtypes
from rasterloom.sources import files, raster
from rasterloom.sources.store import PARTS, image_rows

#: Rows of a batch.
ROWS = 1 << 18
#: Files of a load that one task reads.
FILES_A_TASK = 4
_FAR = 1 << 62


def enable(spark: SparkSession) -> None:
    for source in (RasterCells, StoredCells):
        spark.dataSource.register(source)


def span(text: str) -> tuple[int, int]:
    """A half-open range as text, low:high; an end that is left out is open."""
    low, colon, high = text.partition(":")
    if not colon:
        raise ValueError(f"{text!r} is no range low:high")
    return int(low) if low.strip() else -_FAR, int(high) if high.strip() else _FAR


class Box:
    """Half-open ranges by axis, all of it where none is given."""

    def __init__(self, axes: str, ranges: Mapping[str, tuple[int, int]]):
        if unknown := set(ranges) - set(axes.lower()):
            raise ValueError(f"an image of axes {axes} has no range of {', '.join(sorted(unknown))}")
        self.spans = {d: ranges.get(d, (-_FAR, _FAR)) for d in axes.lower()}

    @classmethod
    def of_options(cls, axes: str, options: Mapping[str, str]) -> Box:
        return cls(axes, {d: span(options[d]) for d in "tczyx" if d in options})

    @property
    def empty(self) -> bool:
        return any(lo >= hi for lo, hi in self.spans.values())

    def meets(self, start: tuple[int, ...], extent: tuple[int, ...]) -> bool:
        return all(s < hi and s + n > lo for (lo, hi), s, n in zip(self.spans.values(), start, extent, strict=True))

    def cut(self, start: tuple[int, ...], block: np.ndarray) -> tuple[list[int], np.ndarray]:
        """What of a block lies within, and where it begins; empty if nothing does."""
        lows = [max(s, lo) for s, (lo, _) in zip(start, self.spans.values(), strict=True)]
        highs = [max(low, min(s + n, hi)) for low, s, n, (_, hi) in zip(lows, start, block.shape, self.spans.values(), strict=True)]
        return lows, block[tuple(slice(a - s, b - s) for a, b, s in zip(lows, highs, start, strict=True))]


class Part(InputPartition):
    """Of one level, the segments or files that a task reads."""

    def __init__(self, level: int, items: list):
        self.level, self.items = level, items


class CellsReader(DataSourceReader):
    """What both sources share; a source brings wanted() and blocks()."""

    def __init__(self, axes: str, kind: str, box: Box, step: int):
        self.names, self.kind, self.box, self.step = [d.lower() for d in axes], kind, box, step

    def wanted(self) -> Iterator[tuple[int, list]]:
        """Levels, and what of them the box meets."""
        raise NotImplementedError

    def blocks(self, part: Part) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
        """Start and pixels of all blocks of a part, in the source's axes."""
        raise NotImplementedError

    def partitions(self) -> list[Part]:
        found = [] if self.box.empty else list(self.wanted())
        # Spark asks for one partition at least
        return [Part(level, items[a : a + self.step]) for level, items in found for a in range(0, len(items), self.step)] or [Part(0, [])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        for start, block in self.blocks(partition) if partition.items else ():
            lows, piece = self.box.cut(start, block)
            flat = piece.reshape(-1)
            for a in range(0, flat.size, ROWS):
                here = np.unravel_index(np.arange(a, min(a + ROWS, flat.size)), piece.shape)
                columns = [pa.array(np.full(len(here[0]), partition.level, np.int32))]
                columns += [pa.array((k + lo).astype(np.int32)) for k, lo in zip(here, lows, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, intensities(flat[a : a + ROWS], self.kind)], ["level", *self.names, "intensity"])


def intensities(values: np.ndarray, kind: str) -> pa.Array:
    """Cells in the Spark type that holds them."""
    wide = {"boolean": pa.bool_(), "tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}
    if kind.startswith("decimal"):
        return pa.array(values.astype(np.uint64)).cast(pa.decimal128(20, 0))
    return pa.array(values.astype(values.dtype.newbyteorder("="), copy=False)).cast(wide[kind])


def schema_of(axes: str, dtype: str) -> str:
    return ", ".join(["level int", *[f"{d.lower()} int" for d in axes], f"intensity {dtypes.spark_type(dtype)}"])


class FileReader(CellsReader):
    def __init__(self, image: raster.Reader, level: int | None, options: Mapping[str, str]):
        about = image.describe()
        super().__init__(about["axes"], dtypes.spark_type(about["levels"][0]["dtype"]), Box.of_options(about["axes"], options), raster.SEGMENTS_A_TASK)
        self.image = image
        self.kept = [r["level"] for r in about["levels"]] if level is None else [level]

    def wanted(self) -> Iterator[tuple[int, list]]:
        for level in self.kept:
            yield level, within(self.image, level, self.box)

    def blocks(self, part: Part) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
        return raster.segments(self.image, part.level, part.items)


def within(image: raster.Reader, level: int, box: Box) -> list[int]:
    """The segments of a level that a box meets; all where the reader can't tell."""
    every = range(image.segments(level))
    return [i for i in every if box.meets(*image.bounds(level, i))] if hasattr(image, "bounds") else list(every)


class RasterCells(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster_cells"

    def image(self) -> raster.Reader:
        return raster.reader_of(self.options["codec"], self.options)(self.options["path"], **json.loads(self.options.get("reader", "{}")))

    def schema(self) -> str:
        about = self.image().describe()
        return schema_of(about["axes"], about["levels"][0]["dtype"])

    def reader(self, schema) -> FileReader:
        return FileReader(self.image(), int(self.options["level"]) if "level" in self.options else None, self.options)


class StoreReader(CellsReader):
    """Tiles of a stored image, straight from the files of their loads: a record a file tells which tiles it may hold."""

    def __init__(self, path: str, levels: list[dict], options: Mapping[str, str]):
        first = levels[0]
        super().__init__(first["axes"], dtypes.spark_type(first["dtype"]), Box.of_options(first["axes"], options), FILES_A_TASK)
        self.path, self.levels = path, {r["level"]: r for r in levels}

    def spans(self, level: dict) -> dict[str, tuple[int, int]]:
        """First and last tile index that the box meets, by column of tile indices."""
        found = {f"t{d}": (self.box.spans[d], n) for d, n in zip(self.names, level["tile"], strict=True)}
        return {c: (max(0, lo) // n, (hi - 1) // n) for c, ((lo, hi), n) in found.items() if (lo, hi) != (-_FAR, _FAR)}

    def wanted(self) -> Iterator[tuple[int, list]]:
        for number, level in self.levels.items():
            folder, spans = f"{self.path}/tiles/load_id={level['load_id']}", self.spans(level)
            parts = json.loads(files.read_range(f"{folder}/{PARTS}"))
            yield number, [f"{folder}/{p['file']}" for p in parts if all(p[f"{c}_lo"] <= hi and p[f"{c}_hi"] >= lo for c, (lo, hi) in spans.items())]

    def blocks(self, part: Part) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
        import pyarrow.parquet as pq

        spans = self.spans(self.levels[part.level])
        for uri in part.items:
            store, path = files.store_of(uri)
            with store.open_input_file(path) as f:
                held = pq.ParquetFile(f)
                place = {held.metadata.schema.column(k).path: k for k in range(held.metadata.num_columns)}
                for group in range(held.num_row_groups):
                    stats = {c: held.metadata.row_group(group).column(place[c]).statistics for c in spans}
                    if any(s is not None and s.has_min_max and (s.min > spans[c][1] or s.max < spans[c][0]) for c, s in stats.items()):
                        continue
                    for batch in held.iter_batches(1, [group], columns=["start", "extent", "dtype", "data"]):
                        for t in batch.to_pylist():
                            yield tuple(t["start"]), np.frombuffer(t["data"], t["dtype"]).reshape(t["extent"])


class StoredCells(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stored_cells"

    def levels(self) -> list[dict]:
        _, rows = image_rows(self.options["path"], self.options["image"])
        out = [r for r in rows if "level" not in self.options or r["level"] == int(self.options["level"])]
        if not out:
            raise ValueError(f"no level of image {self.options['image']!r} in {self.options['path']}")
        if any(r["pixel_depth"] > 1 for r in out):
            raise ValueError("channels side by side have no column of their own; read them by Slide")
        return out

    def schema(self) -> str:
        first = self.levels()[0]
        return schema_of(first["axes"], first["dtype"])

    def reader(self, schema) -> StoreReader:
        return StoreReader(self.options["path"], self.levels(), self.options)
