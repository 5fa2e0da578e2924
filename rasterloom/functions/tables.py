"""Functions for SQL that give rows, for lateral joins with tables of levels, files or regions.

image_tiles(axes, shape, tile, region)        the tiles of a grid that a region meets
stored_image_cells(path, image, level, region) cells of a level of a stored image
file_cells(codec, path, level, region)        cells of a level of an image file

region is a map from axes in small letters to half-open ranges, array(low, high), or null for the whole image; so

    SELECT r.name, max(c.intensity) FROM regions r,
    LATERAL stored_image_cells(r.path, r.image, 0, map('y', array(r.y0, r.y1), 'x', array(r.x0, r.x1))) c GROUP BY r.name

reads only the files and tiles that each region meets. A call is work of one task: spread large images over rows by
image_tiles first. Cells have all five coordinates, 0 where the image lacks an axis, and an intensity in double precision;
64-bit cells that it can't hold exactly are an error. A null argument other than region gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

_CELLS = "t int, z int, c int, y int, x int, intensity double"


def register(spark: SparkSession) -> None:
    """Make the functions known to a session's SQL."""
    for name, f in (("image_tiles", image_tiles), ("stored_image_cells", stored_image_cells), ("file_cells", file_cells)):
        spark.udtf.register(name, f)


def ranges_of(region: dict[str, list[int]] | None) -> dict[str, tuple[int, int]]:
    for d, r in (region or {}).items():
        if r is None or len(r) != 2 or None in r:
            raise ValueError(f"the range of {d} is no array(low, high)")
    return {d.lower(): (int(lo), int(hi)) for d, (lo, hi) in (region or {}).items()}


@udtf(returnType="tile_no long, start array<long>, extent array<long>, region map<string, array<long>>")
class image_tiles:  # noqa: N801
    def eval(self, axes, shape, tile, region):
        from rasterloom.sources.pixels import Box

        if axes is None or shape is None or tile is None:
            return
        box = Box(axes, ranges_of(region))
        counts = [-(-n // t) for n, t in zip(shape, tile, strict=True)]
        spans = [range(max(0, lo) // t, min(k, -(-min(hi, n) // t))) for (lo, hi), n, t, k in zip(box.spans.values(), shape, tile, counts, strict=True)]
        if box.empty:
            return
        for where in product(*spans):
            number = 0
            for k, n in zip(where, counts, strict=True):
                number = number * n + k
            start = [k * t for k, t in zip(where, tile, strict=True)]
            extent = [min(t, n - s) for t, n, s in zip(tile, shape, start, strict=True)]
            yield number, start, extent, {d: [s, s + e] for d, s, e in zip(box.spans, start, extent, strict=True)}


def rows_of(names: list[str], box, blocks) -> Iterator[tuple]:
    """The cells of blocks within a box, with all five coordinates."""
    for start, block in blocks:
        lows, piece = box.cut(start, block)
        flat = piece.reshape(-1)
        if not flat.size:
            continue
        if flat.dtype.kind in "iu" and flat.dtype.itemsize == 8 and max(abs(int(flat.min())), abs(int(flat.max()))) > 1 << 53:
            raise ValueError("cells of 64 bits don't fit double precision")
        at = {d: (k + lo).tolist() for d, k, lo in zip(names, np.indices(piece.shape).reshape(len(names), -1), lows, strict=True)}
        yield from zip(*(at.get(d, repeat(0, flat.size)) for d in "tzcyx"), flat.astype(np.float64).tolist(), strict=True)


# Spark 4.1 takes no Arrow function on the right of a lateral join, so these give row by row


@udtf(returnType=_CELLS)
class stored_image_cells:  # noqa: N801
    def eval(self, path, image, level, region) -> Iterator[tuple]:
        from rasterloom.sources.pixels import StoredCells

        if None in (path, image, level):
            return
        options = {d: f"{lo}:{hi}" for d, (lo, hi) in ranges_of(region).items()}
        reader = StoredCells({"path": path, "image": image, "level": str(level)} | options).reader(None)
        for part in reader.partitions():
            if part.items:
                yield from rows_of(reader.names, reader.box, reader.blocks(part))


@udtf(returnType=_CELLS)
class file_cells:  # noqa: N801
    def eval(self, codec, path, level, region) -> Iterator[tuple]:
        from rasterloom.sources import pixels, raster

        if None in (codec, path, level):
            return
        image = raster.reader_of(codec, {})(path)
        axes = image.describe()["axes"]
        box = pixels.Box(axes, ranges_of(region))
        if not box.empty:
            yield from rows_of([d.lower() for d in axes], box, raster.segments(image, level, pixels.within(image, level, box)))
