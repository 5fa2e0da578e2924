"""Export of stored levels: chunk files for Zarr, bands of rows for PNG (TIFF: sinks.tiff)."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.axes import Layout, level_layout
from rasterloom.metadata import ome
from rasterloom.session import scratch_path
from rasterloom.sinks.shared import SharedFile
from rasterloom.sources import files, png

#: Bytes of pixels that one task deflates for a PNG file, or a row if that is more.
PNG_BAND = 8 << 20


def original(level: dict, tile) -> tuple[np.ndarray, list[int]]:
    """Pixels and start of a stored tile in the original axes."""
    change = level_layout(level)
    block = change.array(np.frombuffer(tile.data, tile.dtype).reshape(tuple(tile.extent)))
    place = change.tile(tuple(slice(int(a), int(a) + int(n)) for a, n in zip(tile.start, tile.extent, strict=True)))
    return block, [p.start or 0 for p in place]


def zarr(tiles: DataFrame, levels: list[dict], image: dict, dest: str) -> None:
    """A chunk file a tile, in the original axes; sidecars last."""
    by_level = {r["level"]: r for r in levels}

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch.itertuples():
                level = by_level[t.level]
                block, start = original(level, t)
                full = level_layout(level).shape(tuple(level["tile"]))
                index = [s // n for s, n in zip(start, full, strict=True)]
                chunk = np.zeros(full, t.dtype)
                chunk[tuple(slice(0, n) for n in block.shape)] = block
                files.write_whole(f"{dest}/{t.level}/" + ".".join(map(str, index)), zlib.compress(chunk.tobytes(), 5))
            yield pd.DataFrame({"n": [len(batch)]})

    tiles.mapInPandas(write, "n long").agg(F.sum("n")).collect()
    for r in levels:
        change = level_layout(r)
        spec = {"zarr_format": 2, "shape": list(change.shape(tuple(r["shape"]))), "chunks": list(change.shape(tuple(r["tile"]))), "dtype": np.dtype(r["dtype"]).str,
                "compressor": {"id": "zlib", "level": 5}, "fill_value": 0, "order": "C", "filters": None}
        files.write_whole(f"{dest}/{r['level']}/.zarray", json.dumps(spec).encode())
    scales = {"version": "0.4", "axes": [{"name": d.lower()} for d in levels[0]["original_axes"]], "datasets": [{"path": str(r["level"])} for r in levels]}
    files.write_whole(f"{dest}/.zgroup", b'{"zarr_format": 2}')
    files.write_whole(f"{dest}/.zattrs", json.dumps({"multiscales": [scales], "omero": ome.to_omero(image)}).encode())


def joined_sums(first: int, second: int, size: int) -> int:
    """The Adler-32 sum of two stretches of bytes from their own sums, the second of `size` bytes."""
    prime = 65521
    a, b = first & 0xFFFF, first >> 16
    c, d = second & 0xFFFF, second >> 16
    return (b + d + size * (a - 1)) % prime << 16 | (a + c - 1) % prime


def png_file(tiles: DataFrame, levels: list[dict], image: dict, dest: str, effort: int = 6) -> None:
    """One PNG of the first level.

    Tasks deflate bands of rows, each to a byte's end, into scratch space. The driver gets their lengths and sums alone;
    where tasks share the file system with it, they write each band in its place, else it lines them up one at a time.
    """
    level, axes = levels[0], levels[0]["axes"]
    depth = level["pixel_depth"]
    size = dict(zip(axes, level["shape"], strict=True))
    if depth > 1:
        size |= {"X": size["X"] // depth, "C": depth}
    n, kind = size.get("C", 1), np.dtype(level["dtype"])
    if kind.name not in ("uint8", "uint16") or n not in (1, 2, 3, 4) or set(axes) - set("YXC"):
        raise ValueError("PNG holds 8- or 16-bit images of up to four channels")
    change, width, height = Layout(axes, "YXC", depth, 1), size["X"], size["Y"]
    tall = max(1, min(height, PNG_BAND // (width * n * kind.itemsize)))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch.itertuples():
                block = change.array(np.frombuffer(t.data, t.dtype).reshape(tuple(t.extent)))
                place = change.tile(tuple(slice(int(a), int(a) + int(k)) for a, k in zip(t.start, t.extent, strict=True)))
                y0, x0, c0 = (p.start or 0 for p in place)
                for band in range(y0 // tall, (y0 + len(block) - 1) // tall + 1):
                    top = max(y0, band * tall)
                    part = block[top - y0 : (band + 1) * tall - y0]
                    rows.append((band, top - band * tall, x0, c0, *part.shape, part.tobytes()))
            yield pd.DataFrame(rows, columns=["band", "y", "x", "c", "h", "w", "n", "data"])

    def deflated(pieces: pd.DataFrame) -> pd.DataFrame:
        band = int(pieces["band"].iloc[0])
        whole = np.zeros((min(tall, height - band * tall), width, n), kind)
        for p in pieces.itertuples():
            whole[p.y : p.y + p.h, p.x : p.x + p.w, p.c : p.c + p.n] = np.frombuffer(p.data, kind).reshape(p.h, p.w, p.n)
        lines = np.zeros((len(whole), 1 + whole[0].nbytes), np.uint8)
        lines[:, 1:] = whole.astype(kind.newbyteorder(">")).reshape(len(whole), -1).view(np.uint8)
        z = zlib.compressobj(effort, zlib.DEFLATED, -15)
        data = z.compress(lines.tobytes()) + z.flush(zlib.Z_FULL_FLUSH)
        return pd.DataFrame({"band": [band], "data": [data], "sum": [zlib.adler32(lines.tobytes())], "size": [lines.nbytes]})

    pieces = tiles.filter(F.col("level") == level["level"]).mapInPandas(cut, "band int, y int, x int, c int, h int, w int, n int, data binary")
    bands = pieces.groupBy("band").applyInPandas(deflated, "band int, data binary, sum long, size long")
    spark = tiles.sparkSession
    scratch = scratch_path(spark, "png")
    bands.write.parquet(scratch)
    staged = spark.read.parquet(scratch)
    rows = staged.select("band", "sum", "size", F.length("data").alias("n")).orderBy("band").collect()
    begun, front = zlib.compress(b"")[:2], png.head(height, width, n, kind.itemsize * 8)
    total, at, places = 1, len(front), []
    for r in rows:
        places.append((r["band"], at))
        total, at = joined_sums(total, r["sum"], r["size"]), at + 12 + r["n"] + (len(begun) if r["band"] == 0 else 0)
    # an empty last block, and the sum of all bytes
    back = png.chunk(b"IDAT", b"\3\0" + struct.pack(">I", total)) + png.chunk(b"IEND", b"")
    file = SharedFile(dest, len(front))

    def chunk(band: int, data: bytes) -> bytes:
        return png.chunk(b"IDAT", (begun if band == 0 else b"") + data)

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for band, data, offset in zip(batch["band"], batch["data"], batch["at"], strict=True):
                file.place(offset, chunk(band, data))
            yield pd.DataFrame({"n": [len(batch)]})

    if file.local:
        try:
            placed = staged.select("band", "data").join(spark.createDataFrame(places, "band int, at long"), "band")
            placed.mapInPandas(put, "n long").agg(F.sum("n")).collect()
            file.place(0, front)
            file.place(at, back)
            file.rename()
        except BaseException:
            file.drop()
            raise
    else:
        with files.writing(dest) as f:
            f.write(front)
            for row in staged.orderBy("band").toLocalIterator(prefetchPartitions=False):
                f.write(chunk(row["band"], bytes(row["data"])))
            f.write(back)
    files.delete(scratch)
