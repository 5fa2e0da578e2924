"""TIFF, BigTIFF and OME-TIFF files, read segment by segment."""

from __future__ import annotations

import struct
import warnings
import zlib

import numpy as np
import pyarrow as pa

from rasterloom.metadata import ome
from rasterloom.sources import files, jpeg, planes

#: Tags by number.
TAGS = {
    254: "subfile", 256: "width", 257: "height", 258: "bits", 259: "compression", 262: "photometric", 270: "description", 273: "strips",
    277: "samples", 278: "strip_rows", 279: "strip_sizes", 282: "x_resolution", 283: "y_resolution", 284: "planar", 296: "unit",
    305: "software", 306: "datetime", 317: "predictor", 322: "tile_width", 323: "tile_height", 324: "tiles", 325: "tile_sizes", 330: "sub", 339: "format",
    347: "jpeg_tables",
}
#: Struct codes of field types.
CODES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
KINDS = {1: "u", 2: "i", 3: "f"}


def unpackbits_bytes(data: bytes) -> bytes:
    """Runs and literals of bytes (PackBits)."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += data[at + 1 : at + 2] * (257 - n) if n > 128 else b""
            at += 2 if n > 128 else 1
    return bytes(out)


def unlzw(data: bytes) -> bytes:
    """Variable-width LZW, high bit first, codes growing one entry early."""
    out, words, width, held, bits, last = bytearray(), [], 9, 0, 0, None
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        while bits >= width:
            code = held >> (bits - width) & (1 << width) - 1
            bits -= width
            held &= (1 << bits) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                words, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
                continue
            word = words[code] if code < len(words) else last + last[:1]
            if last is not None:
                words.append(last + word[:1])
            out += word
            last = word
            width = 12 if len(words) >= 2047 else 11 if len(words) >= 1023 else 10 if len(words) >= 511 else 9
    return bytes(out)


def inflate(data: bytes, compression: int, size: int) -> bytes:
    if compression == 1:
        return data
    if compression in (8, 32946):
        return zlib.decompress(data)
    if compression == 5:
        return unlzw(data)
    if compression == 32773:
        return unpackbits_bytes(data)
    if compression == 50000:
        return pa.Codec("zstd").decompress(data, size).to_pybytes()
    raise ValueError(f"TIFF compression {compression} is not supported")


def directory(uri: str, order: str, big: bool, at: int, tags: dict[int, str]) -> tuple[dict, int]:
    """The page whose directory lies at a place of a file, with what it takes to read it, and the place of the next one."""
    code, size, wide, o = ("Q", 20, "Q", 8) if big else ("H", 12, "I", 4)
    head = files.read_range(uri, at, struct.calcsize(code))
    (n,) = struct.unpack(order + code, head)
    body = files.read_range(uri, at + len(head), n * size + o)
    page: dict = {"uri": uri, "order": order, "big": big, "samples": 1, "compression": 1, "planar": 1, "predictor": 1, "bits": (8,), "format": (1,)}
    for i in range(n):
        tag, kind, many = struct.unpack_from(order + "HH" + wide, body, i * size)
        if tag not in tags or kind not in CODES:
            continue
        one = struct.calcsize("=" + CODES[kind])
        data = body[i * size + 4 + o : i * size + size]
        if one * many > o:
            data = files.read_range(uri, struct.unpack(order + wide, data)[0], one * many)
        if kind == 2:
            page[tags[tag]] = data[:many].rstrip(b"\0").decode("utf-8", "replace")
            continue
        values = struct.unpack_from(order + CODES[kind] * many, data)
        if kind in (5, 10):
            values = tuple(a / b if b else 0.0 for a, b in zip(values[::2], values[1::2], strict=True))
        several = many > 1 or tags[tag] in ("bits", "format", "strips", "strip_sizes", "tiles", "tile_sizes", "sub", "jpeg_tables")
        page[tags[tag]] = values if several else values[0]
    return page, struct.unpack_from(order + wide, body, n * size)[0]


def pages_of(uri: str, tags: dict[int, str]) -> list[dict]:
    """The pages of a file, in the order of its chain of directories."""
    start = files.read_range(uri, 0, 16)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    if order is None:
        raise ValueError("not a TIFF file")
    big = struct.unpack_from(order + "H", start, 2)[0] == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), start, 8 if big else 4)[0]
    out = []
    while at:
        page, at = directory(uri, order, big, at, tags)
        out.append(page)
    return out


#: What pages of one level have in common.
FORM = ("width", "height", "samples", "bits", "format", "planar")


class TiffFile:
    """The reader protocol on one series of a file: pages of one shape, with smaller levels in sub-directories or later pages.

    In an OME-TIFF a series is an image of the OME-XML, whose planes may lie in any pages of this file and others of its
    folder (sources.planes); planes that are in no file, or in a lost one, are zero, with a warning. Other files have series 0 alone.
    """

    def __init__(self, uri: str, extra_tags: tuple[int, ...] = (), series: int = 0):
        self.uri, self.series, self.tags = uri, series, TAGS | {t: f"tag_{t}" for t in extra_tags}
        pages = pages_of(uri, self.tags)
        self.order, self.big, self.text = pages[0]["order"], pages[0]["big"], self._described(pages[0].get("description", ""))
        self.is_ome = ome.is_ome(self.text)
        described = planes.images(self.text) if self.is_ome else []
        if series >= max(1, len(described)):
            raise ValueError(f"{uri} has no series {series}")
        if described:
            self.lead, same = self._series(pages, described)
            rest = [] if len(described) > 1 else [p for p in pages if all(p is not q for q in same)]
        else:
            same = [p for p in pages if all(p[k] == pages[0][k] for k in FORM[:3])]
            rest = pages[1:]
            self.lead = ("C" if self.multispectral and pages[0]["samples"] == 1 else "Z", (len(same),)) if len(same) > 1 else ("", ())
        self.levels, first = [same], same[0]
        for k in range(len(first.get("sub", ()))):
            self.levels.append([directory(p["uri"], p["order"], p["big"], p["sub"][k], self.tags)[0] if "sub" in p else None for p in same])
            self.levels[-1] = [p or blank(self.levels[-1][0]) for p in self.levels[-1]]
        if len(self.levels) == 1 and len(same) == 1:
            ratio = first["width"] / first["height"]
            smaller = [p for p in rest if p["width"] < first["width"] and "tiles" in p and abs(p["width"] / p["height"] / ratio - 1) < 0.02]
            self.levels += [[p] for p in sorted(smaller, key=lambda p: -p["width"])]
        elif len(self.levels) == 1 and self.multispectral:
            self.levels += self._channel_levels(pages)

    def _described(self, text: str) -> str:
        """The OME-XML, which a file may leave to another one beside it."""
        name = ome.metadata_file(text) if ome.is_ome(text) else None
        if name is None:
            return text
        other = files.beside(self.uri, name)
        if files.read_range(other, 0, 2) in (b"II", b"MM"):
            return pages_of(other, self.tags)[0].get("description", "")
        return files.read_range(other).decode("utf-8")

    def _series(self, own: list[dict], described: list) -> tuple[tuple[str, tuple[int, ...]], list[dict]]:
        """Axes over the planes of this series with their sizes, and the page of each plane; the first plane has a page."""
        pixels, name, mark = described[self.series], self.uri.rstrip("/").rsplit("/", 1)[-1], ome.uuid_of(self.text)
        held: dict[str | None, list[dict]] = {None: own}
        found = planes.intervals(pixels, 1, name, mark)
        for at in found:
            if at.file not in held:
                there = files.beside(self.uri, at.file)
                held[at.file] = pages_of(there, self.tags) if files.exists(there) else []
        some = next((held[at.file][at.page] for at in found if at.page < len(held[at.file])), None) if found else own[0]
        if some is None:
            raise ValueError(f"no page of series {self.series} of {self.uri} is there")
        lead, sizes = planes.plane_axes(pixels, some["samples"])
        if found:
            where = planes.located(planes.intervals(pixels, some["samples"], name, mark), int(np.prod(sizes)), {f: len(p) for f, p in held.items()})
        else:
            # pages of another size than the only image's are its smaller levels
            held[None] = own if len(described) > 1 else [p for p in own if all(p[k] == some[k] for k in FORM[:3])]
            where = planes.following(described, self.series, some["samples"], len(held[None]))
        same = [held[w[0]][w[1]] if w else None for w in where]
        first = next(p for p in same if p)
        if any(p[k] != first[k] for p in same if p for k in FORM):
            raise ValueError(f"the pages of series {self.series} of {self.uri} differ in form")
        if lost := same.count(None):
            warnings.warn(f"{lost} of {len(same)} planes of {self.uri} are in no file and read as zero", stacklevel=3)
        axes = "".join(d for d, k in zip(lead, sizes, strict=True) if k > 1)
        if first["samples"] > 1 and "C" in axes:
            raise ValueError("channels over pages of several samples are not supported")
        return (axes, tuple(k for k in sizes if k > 1)), [p or blank(first) for p in same]

    @property
    def multispectral(self) -> bool:
        """Pages are channels, each with a description of its own."""
        return "<PerkinElmer-QPI-ImageDescription" in self.text

    def _channel_levels(self, pages: list[dict]) -> list[list[dict]]:
        """Smaller levels of a multispectral scan: later pages of one size and the first page's form and type, one a channel."""
        first, n = pages[0], len(self.levels[0])
        w, h = first["width"], first["height"]
        groups: dict[tuple[int, int], list[dict]] = {}
        for p in pages:
            alike = all(p[k] == first[k] for k in ("samples", "bits", "format")) and abs(p["width"] * h - p["height"] * w) < w + h
            if alike and p["width"] < w:
                groups.setdefault((p["width"], p["height"]), []).append(p)
        for size, found in groups.items():
            if len(found) != n and any("tiles" in p for p in found):
                raise ValueError(f"a level of {size[0]} x {size[1]} has {len(found)} of {n} pages")
        return [found for _, found in sorted(groups.items(), reverse=True) if len(found) == n]

    def dtype(self, level: int = 0) -> np.dtype:
        page = self.levels[level][0]
        bits = page["bits"][0]
        if bits not in (1, 2, 4, 8, 16, 32, 64) or len(set(page["bits"])) > 1 or page["format"][0] not in KINDS:
            raise ValueError(f"TIFF samples of {page['bits']} bits and form {page['format']} are not supported")
        return np.dtype(f"{KINDS[page['format'][0]]}{max(1, bits // 8)}")

    def is_rgb(self) -> bool:
        """By the pages' own mark or by an annotation of the OME-XML."""
        marked = self.is_ome and ome.annotation(self.text, "PhotometricInterpretation") == "RGB"
        return marked or self.levels[0][0].get("photometric") == 2

    def describe(self) -> dict:
        lead, sizes = self.lead
        first = self.levels[0][0]
        inner = ("CYX" if first["planar"] == 2 else "YXC") if first["samples"] > 1 else "YX"

        def shape(page: dict) -> tuple[int, ...]:
            at = {"Y": page["height"], "X": page["width"], "C": page["samples"]}
            return (*sizes, *[at[d] for d in inner])

        levels = [{"level": i, "shape": shape(pages[0]), "dtype": self.dtype(i).name, "tags": page_tags(pages[0])} for i, pages in enumerate(self.levels)]
        flags = {"bigtiff": self.big, "byteorder": self.order, "ome": self.is_ome, "multispectral": self.multispectral, "rgb": self.is_rgb()}
        original = {"description": self.text, "software": first.get("software"), "flags": flags}
        if self.text.startswith("Aperio"):
            original["settings"] = ome.aperio(self.text)
        if len(self.levels[0]) > 1:
            original["pages"] = [page_tags(p) for p in self.levels[0]]
        return {"axes": lead + inner, "levels": levels, "image": self.image(), "original": original}

    def image(self) -> dict:
        text, first = self.text, self.levels[0][0]
        if self.is_ome:
            return ome.from_ome_xml(text, self.series)
        if self.multispectral:
            pages = [(p["description"], (p["x_resolution"], p["y_resolution"]) if "x_resolution" in p else None, p.get("photometric") == 2) for p in self.levels[0]]
            return ome.from_page_xml(pages)
        if text.startswith("Aperio"):
            return ome.from_aperio(text)
        n = first["samples"]
        names = ["red", "green", "blue", "alpha"][:n] if n in (3, 4) else [f"Channel {i}" for i in range(n)]
        colors = ome.default_colors(3) + ome.default_colors(1) if n == 4 else ome.default_colors(n)
        return {"channels": [{"id": str(i), "name": x, "color": c} for i, (x, c) in enumerate(zip(names, colors, strict=True))]}

    def _grid(self, page: dict) -> tuple[int, int, int, int, int]:
        """Height and width of a segment, segments down and across, and planes."""
        h = page.get("tile_height", min(page.get("strip_rows", page["height"]), page["height"]))
        w = page.get("tile_width", page["width"])
        return h, w, -(-page["height"] // h), -(-page["width"] // w), page["samples"] if page["planar"] == 2 else 1

    def segments(self, level: int) -> int:
        _, _, down, across, planes = self._grid(self.levels[level][0])
        return len(self.levels[level]) * planes * down * across

    def bounds(self, level: int, i: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """Start and extent of a segment in the image's axes, clipped at its edges."""
        h, w, down, across, planes = self._grid(self.levels[level][0])
        number, within = divmod(i, planes * down * across)
        page = self.levels[level][number]
        plane, rest = divmod(within, down * across)
        row, column = divmod(rest, across)
        _, sizes = self.lead
        where = tuple(int(x) for x in np.unravel_index(number, sizes)) if sizes else ()
        start, extent = (row * h, column * w), (min(h, page["height"] - row * h), min(w, page["width"] - column * w))
        if page["samples"] > 1 and page["planar"] == 2:
            start, extent = (plane, *start), (1, *extent)
        elif page["samples"] > 1:
            start, extent = (*start, 0), (*extent, page["samples"])
        return (*where, *start), ((1,) * len(where) + extent)

    def place(self, level: int, i: int) -> tuple[str, int, int]:
        """File, offset and length of a segment's bytes; length 0: it was never written."""
        _, _, down, across, planes = self._grid(self.levels[level][0])
        number, within = divmod(i, planes * down * across)
        page = self.levels[level][number]
        at, size = ("tiles", "tile_sizes") if "tiles" in page else ("strips", "strip_sizes")
        return page["uri"], page[at][within], page[size][within]

    def segment(self, level: int, i: int) -> tuple[tuple[int, ...], np.ndarray]:
        """Start and pixels of a segment, clipped at the image's edges."""
        uri, at, size = self.place(level, i)
        return self.decode(level, i, files.read_range(uri, at, size) if size else b"")

    def decode(self, level: int, i: int, data: bytes) -> tuple[tuple[int, ...], np.ndarray]:
        """The same from the segment's bytes."""
        h, w, down, across, planes = self._grid(self.levels[level][0])
        page = self.levels[level][i // (planes * down * across)]
        start, extent = TiffFile.bounds(self, level, i)
        interleaved = page["samples"] > 1 and page["planar"] != 2
        inner = page["samples"] if interleaved else 1
        height, width = extent[-3:-1] if interleaved else extent[-2:]
        kind = self.dtype(level)
        if not data:
            return start, np.zeros(extent, kind)
        if page["compression"] == 7:
            block = jpeg.decode(data, bytes(page.get("jpeg_tables", ())), page.get("photometric") == 6)
        else:
            block = samples(data, page, h if "tiles" in page else height, w, inner, kind.newbyteorder(page["order"]))
        return start, block[:height, :width].reshape(extent)


def samples(data: bytes, page: dict, rows: int, width: int, inner: int, kind: np.dtype) -> np.ndarray:
    """The samples (rows, width, inner) of an encoded segment, its predictor undone."""
    bits, predictor = page["bits"][0], page["predictor"]
    line = -(-width * inner * bits // 8)
    raw = inflate(data, page["compression"], rows * line)
    if bits < 8:
        if predictor != 1:
            raise ValueError("a predictor on samples of less than a byte is not supported")
        each = np.unpackbits(np.frombuffer(raw, np.uint8, rows * line).reshape(rows, line), axis=1).reshape(rows, -1, bits)
        return (each @ (1 << np.arange(bits - 1, -1, -1))).astype(np.uint8)[:, : width * inner].reshape(rows, width, inner)
    if predictor == 3:
        if kind.kind != "f":
            raise ValueError("predictor 3 is for floating point samples")
        # differences of bytes, the highest bytes of a row's samples first
        flat = np.cumsum(np.frombuffer(raw, np.uint8, rows * line).reshape(rows, -1, inner), axis=1, dtype=np.uint8)
        planes = flat.reshape(rows, kind.itemsize, width * inner).transpose(0, 2, 1)
        return np.ascontiguousarray(planes).view(kind.newbyteorder(">")).reshape(rows, width, inner).astype(kind.newbyteorder("="))
    if predictor not in (1, 2):
        raise ValueError(f"TIFF predictor {predictor} is not supported")
    block = np.frombuffer(raw, kind, rows * width * inner).reshape(rows, width, inner).astype(kind.newbyteorder("="))
    return np.cumsum(block, axis=1, dtype=block.dtype) if predictor == 2 else block


def blank(page: dict) -> dict:
    """A page of the same form that holds nothing."""
    return page | {k: (0,) * len(page[k]) for k in ("strips", "strip_sizes", "tiles", "tile_sizes") if k in page} | {"description": ""}


def page_tags(page: dict) -> dict:
    """A page's tags but places and tables."""
    return {k: v for k, v in page.items() if k not in ("uri", "order", "big", "strips", "strip_sizes", "tiles", "tile_sizes", "sub", "jpeg_tables", "description")}


class ScannedSlide(TiffFile):
    """A scanner's RGB file read as RGBA, opaque everywhere."""

    def describe(self) -> dict:
        out = super().describe()
        if out["axes"] != "YXC":
            raise ValueError("a scanned slide is an interleaved RGB image")
        for level in out["levels"]:
            level["shape"] = (*level["shape"][:2], 4)
        return out

    def bounds(self, level: int, i: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
        start, extent = super().bounds(level, i)
        return start, (*extent[:2], 4)

    def decode(self, level: int, i: int, data: bytes) -> tuple[tuple[int, ...], np.ndarray]:
        start, block = super().decode(level, i, data)
        opaque = np.full((*block.shape[:2], 1), np.iinfo(block.dtype).max, block.dtype)
        return start, np.concatenate([block[..., :3], opaque], axis=2)
