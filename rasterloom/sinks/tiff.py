"""Export to BigTIFF: tasks encode tiles and add them to the file, the commit writes the directories.

df.write.format("raster").mode("overwrite").save(path) takes blocks as the data source gives them (level, start, extent,
dtype, data), each one tile of the grid of side `tile`, cut at the image's edges. Options: axes, which end in YX or YXC;
levels, a JSON list of {level, shape} of which the first is the main picture; tile; compression (none, deflate, or jpeg for 8 bits and
one or three samples, with quality); image, the common metadata as JSON. Each task answers with the places of its tiles; the commit checks that every tile of every level is there,
writes offsets, lengths and directories behind them, and renames the file. An abort deletes what tasks have written.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from rasterloom.functions.axes import level_layout
from rasterloom.metadata import ome
from rasterloom.sinks import jpeg
from rasterloom.sinks.shared import SharedFile
from rasterloom.sinks.writers import original
from rasterloom.sources import files, raster

#: Side of a tile in exported files.
TILE = 256
#: Numbers of compressions.
COMPRESSIONS = {"none": 1, "jpeg": 7, "deflate": 8}
_HEAD = 16
_PIECES = "level int, ty int, tx int, lead array<int>, y int, x int, h int, w int, n int, dtype string, data binary"


@dataclass
class Written(WriterCommitMessage):
    """Where a task's tiles lie: level, page, row, column, offset and length of each, in a part of the file."""

    part: str
    places: np.ndarray
    dtypes: set[str]


class TiffWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.axes, self.levels = options["axes"], json.loads(options["levels"])
        if not self.axes.endswith(("YX", "YXC")):
            raise ValueError(f"a TIFF file holds images whose axes end in YX or YXC, not {self.axes}")
        self.interleaved = self.axes.endswith("YXC")
        self.tile, self.compression = int(options.get("tile", TILE)), options.get("compression", "deflate")
        self.quality = int(options.get("quality", "90"))
        if self.tile % 16 or self.compression not in COMPRESSIONS:
            raise ValueError(f"no TIFF file of tiles of {self.tile}, {self.compression}")
        self.image = json.loads(options.get("image", "{}"))
        if not overwrite and files.exists(options["path"]):
            raise FileExistsError(options["path"])
        self.file = SharedFile(options["path"], _HEAD)

    def inner(self, level: dict) -> tuple[tuple[int, ...], int, int, int]:
        """Sizes of the leading axes, height, width and samples."""
        shape = tuple(level["shape"])
        return (shape[:-3], *shape[-3:]) if self.interleaved else (shape[:-2], *shape[-2:], 1)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        by_level = {r["level"]: self.inner(r) for r in self.levels}
        places, dtypes = [], set()
        with self.file.appender() as out:
            for t in (t for batch in iterator for t in batch.to_pylist()):
                lead, height, width, n = by_level[t["level"]]
                start, extent = (t["start"], t["extent"]) if self.interleaved else ([*t["start"], 0], [*t["extent"], 1])
                y, x = start[-3:-1]
                h, w = min(self.tile, height - y), min(self.tile, width - x)
                if y % self.tile or x % self.tile or list(extent) != [1] * len(lead) + [h, w, n]:
                    raise ValueError(f"a block of {t['extent']} at {t['start']} is no tile of {self.tile} of level {t['level']}")
                data = self.encoded(np.frombuffer(t["data"], t["dtype"]).reshape(h, w, n))
                page = int(np.ravel_multi_index(start[:-3], lead)) if lead else 0
                places.append((t["level"], page, y // self.tile, x // self.tile, out.put(data), len(data)))
                dtypes.add(t["dtype"])
            return Written(out.part, np.array(places, np.int64).reshape(-1, 6), dtypes)

    def encoded(self, block: np.ndarray) -> bytes:
        """The bytes of a tile; beyond the image's edges it holds zeros, or the edge again where zeros would shine through."""
        lossy = self.compression == "jpeg"
        whole = np.pad(block, ((0, self.tile - block.shape[0]), (0, self.tile - block.shape[1]), (0, 0)), mode="edge" if lossy else "constant")
        if lossy:
            return jpeg.encode(whole, self.quality)
        data = whole.astype(whole.dtype.newbyteorder("<"), copy=False).tobytes()
        return zlib.compress(data, 5) if self.compression == "deflate" else data

    def abort(self, messages: list) -> None:
        self.file.drop()

    def commit(self, messages: list) -> None:
        try:
            told = [m for m in messages if m is not None and len(m.places)]
            kinds = set().union(*(m.dtypes for m in told))
            if len(kinds) != 1:
                raise ValueError(f"blocks of types {sorted(kinds)} in one file")

            def tail(starts: dict[str, int], end: int) -> tuple[bytes, bytes]:
                for m in told:
                    m.places[:, 4] += starts[m.part]
                return self.directories(np.concatenate([m.places for m in told]), np.dtype(kinds.pop()), end)

            self.file.finish([m.part for m in told], tail)
        except BaseException:
            self.file.drop()
            raise

    def directories(self, places: np.ndarray, kind: np.dtype, end: int) -> tuple[bytes, bytes]:
        """Head of the file, and all directories with what they point to, for a place behind the tiles."""
        places = places[np.lexsort(places[:, 3::-1].T)]
        pages = {}
        for r in self.levels:
            lead, height, width, _ = self.inner(r)
            mine = places[places[:, 0] == r["level"]]
            down, across = -(-height // self.tile), -(-width // self.tile)
            every = np.stack([a.reshape(-1) for a in np.indices((int(np.prod(lead)), down, across))], axis=1)
            if not np.array_equal(mine[:, 1:4], every):
                raise ValueError(f"level {r['level']} has {len(mine)} of {len(every)} tiles, or some twice")
            for page, held in enumerate(mine.reshape(-1, down * across, 6)):
                pages[r["level"], page] = held[:, 4].tolist(), held[:, 5].tolist()
        body, links, heads = bytearray(), [], []
        top = self.levels[0]
        lead = self.inner(top)[0]
        count = int(np.prod(lead))
        sizes = dict(zip(self.axes, top["shape"], strict=True))
        over = list(self.axes[: len(lead)])
        dims = "XY" + "".join(reversed(over)) + "".join(d for d in "CZT" if d not in over)
        text = ome.to_ome_xml(self.image, sizes, kind.name, count).replace('DimensionOrder="XYCZT"', f'DimensionOrder="{dims}"')

        def directory(level: dict, page: int, text: str, subs: list[int]) -> int:
            _, height, width, n = self.inner(level)
            tags = level.get("tags", {})
            offsets, lengths = pages[level["level"], page]
            entries = [
                (254, 4, [int(level["level"] != top["level"])]), (256, 4, [width]), (257, 4, [height]), (258, 3, [kind.itemsize * 8] * n),
                (259, 3, [COMPRESSIONS[self.compression]]), (262, 3, [2 if n in (3, 4) else int(tags.get("photometric") != 0)]), (277, 3, [n]), (284, 3, [1]), (322, 4, [self.tile]), (323, 4, [self.tile]),
                (324, 16, offsets), (325, 16, lengths), (330, 16, subs), (338, 3, [2] * (n == 4)), (339, 3, [{"u": 1, "b": 1, "i": 2, "f": 3}[kind.kind]] * n),
            ]
            entries += [(270, 2, text)] if text else []
            if self.compression == "jpeg":
                entries = [e for e in entries if e[0] != 262] + [(262, 3, [6 if n == 3 else 1]), (347, 7, jpeg.tables(self.quality, n))]
                entries += [(530, 3, [1, 1])] if n == 3 else []
            entries += tags_back(tags)
            packed = []
            for tag, code, values in sorted(entries):
                many, data = field(code, values)
                if not many:
                    continue
                if len(data) > 8:
                    place = end + len(body)
                    body.extend(data + b"\0" * (-len(data) % 8))
                    data = struct.pack("<Q", place)
                packed.append(struct.pack("<HHQ", tag, code, many) + data.ljust(8, b"\0"))
            place = end + len(body)
            body.extend(struct.pack("<Q", len(packed)) + b"".join(packed))
            links.append(len(body))
            body.extend(bytes(8))
            return place

        for p in range(count):
            subs = [directory(r, p, "", []) for r in self.levels[1:]]
            heads.append(directory(top, p, text if p == 0 else "", subs))
            if p:
                struct.pack_into("<Q", body, following, heads[-1])
            following = links[-1]
        return struct.pack("<2sHHHQ", b"II", 43, 8, 0, heads[0]), bytes(body)


def field(code: int, values: list | str | bytes) -> tuple[int, bytes]:
    """Number of values of a directory's entry, and their bytes."""
    if code == 2:
        data = values.encode("utf-8") + b"\0"
        return len(data), data
    if code == 7:
        return len(values), values
    form = {3: "H", 4: "I", 5: "I", 12: "d", 16: "Q", 17: "q"}[code]
    return len(values) // (2 if code == 5 else 1), struct.pack(f"<{len(values)}{form}", *values)


def tags_back(tags: dict) -> list[tuple[int, int, list | str]]:
    """Entries for what a TIFF source told of a page and what stays true of it: resolution, software, date, and tags that were asked for."""
    out: list[tuple[int, int, list | str]] = []
    for name, tag in (("x_resolution", 282), ("y_resolution", 283)):
        if tags.get(name, 0) > 0:
            part = Fraction(tags[name]).limit_denominator(1 << 20)
            if part.numerator < 1 << 32:
                out.append((tag, 5, [part.numerator, part.denominator]))
    out += [(tag, 2, tags[name]) for name, tag in (("software", 305), ("datetime", 306)) if tags.get(name)]
    out += [(296, 3, [tags["unit"]])] if "unit" in tags else []
    for name, value in tags.items():
        if not name.startswith("tag_"):
            continue
        values = value if isinstance(value, (list, str)) else [value]
        if isinstance(values, str):
            out.append((int(name[4:]), 2, values))
        elif all(isinstance(v, int) for v in values):
            out.append((int(name[4:]), 16 if min(values, default=0) >= 0 else 17, values))
        else:
            out.append((int(name[4:]), 12, values))
    return out


def tiff(tiles: DataFrame, levels: list[dict], image: dict, dest: str, tile: int = TILE, compression: str = "deflate", quality: int = 90) -> None:
    """Stored tiles as a BigTIFF file in the original axes, smaller levels in sub-directories, a page for each of the leading axes' coordinates."""
    by_level = {r["level"]: r for r in levels}
    interleaved = levels[0]["original_axes"].endswith("YXC")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch.itertuples():
                block, start = original(by_level[t.level], t)
                if not interleaved:
                    block, start = block[..., None], [*start, 0]
                y0, x0 = start[-3:-1]
                for where in np.ndindex(block.shape[:-3]):
                    lead = [a + b for a, b in zip(where, start[:-3], strict=True)]
                    plane = block[where]
                    h, w, _ = plane.shape
                    for ty in range(y0 // tile, (y0 + h - 1) // tile + 1):
                        for tx in range(x0 // tile, (x0 + w - 1) // tile + 1):
                            top, left = max(y0, ty * tile), max(x0, tx * tile)
                            part = plane[top - y0 : (ty + 1) * tile - y0, left - x0 : (tx + 1) * tile - x0]
                            rows.append((t.level, ty, tx, lead, top - ty * tile, left - tx * tile, *part.shape, t.dtype, part.tobytes()))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PIECES.split(", ")])

    def joined(pieces: Iterable) -> tuple:
        """The pieces of a tile as one block of the image."""
        pieces = list(pieces)
        p = pieces[0]
        h, w = (max(getattr(q, a) + getattr(q, b) for q in pieces) for a, b in (("y", "h"), ("x", "w")))
        whole = np.zeros((h, w, p.n), p.dtype)
        for q in pieces:
            whole[q.y : q.y + q.h, q.x : q.x + q.w] = np.frombuffer(q.data, q.dtype).reshape(q.h, q.w, q.n)
        inner = ([p.ty * tile, p.tx * tile], [h, w]) if not interleaved else ([p.ty * tile, p.tx * tile, 0], [h, w, p.n])
        return p.level, [*p.lead, *inner[0]], [1] * len(p.lead) + inner[1], p.dtype, whole.tobytes()

    names = [c.split()[0] for c in raster.BLOCKS.split(", ")]

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([joined([p]) for p in batch.itertuples()], columns=names)

    def together(pieces: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([joined(pieces.itertuples())], columns=names)

    pieces = tiles.mapInPandas(cut, _PIECES)
    # a stored tile that ends on a border of exported ones holds them whole
    fits = all(t % (tile * (r["pixel_depth"] if d == "X" else 1)) == 0 or t >= n for r in levels for d, t, n in zip(r["axes"], r["tile"], r["shape"], strict=True) if d in "YX")
    blocks = pieces.mapInPandas(alone, raster.BLOCKS) if fits else pieces.groupBy("level", "lead", "ty", "tx").applyInPandas(together, raster.BLOCKS)
    told = [{"level": r["level"], "shape": list(level_layout(r).shape(tuple(r["shape"]))), "tags": json.loads((r["properties"] or {}).get("tags", "{}"))} for r in levels]
    tiles.sparkSession.dataSource.register(raster.RasterSource)
    out = blocks.write.format("raster").option("codec", "tiff").option("axes", levels[0]["original_axes"]).option("levels", json.dumps(told))
    out.option("image", json.dumps(image)).option("tile", str(tile)).option("compression", compression).option("quality", str(quality)).mode("overwrite").save(dest)
