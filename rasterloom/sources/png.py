"""PNG files, as one level with axes YX or YXC."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from rasterloom.metadata.ome import default_colors
from rasterloom.sources import files

MAGIC = b"\x89PNG\r\n\x1a\n"
#: Samples a pixel by colour type (grey, RGB, palette, grey and alpha, RGBA).
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}

#: First row and column and steps down and across of each pass of an interlaced picture.
PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))


def chunks(data: bytes):
    if data[:8] != MAGIC:
        raise ValueError("not a PNG file")
    at = 8
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        at += 12 + n


def _unfilter(raw: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Undo row filters; only Average and Paeth rows need a pass over single pixels."""
    out = np.zeros_like(raw)
    above = np.zeros(raw.shape[1], np.uint8)
    for y, kind in enumerate(kinds):
        row = raw[y]
        if kind == 0:
            line = row.copy()
        elif kind == 1:
            line = np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            line = row + above
        elif kind in (3, 4):
            given, up, held = row.tolist(), [0] * step + above.tolist(), [0] * step
            for x, v in enumerate(given):
                a, b = held[x], up[x + step]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    c = up[x]
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                held.append(v + guess & 255)
            line = np.array(held[step:], np.uint8)
        else:
            raise ValueError(f"unknown row filter {kind}")
        out[y] = above = line
    return out


def decode(data: bytes) -> np.ndarray:
    """Pixels as (height, width) or (height, width, samples); palettes become RGB, grey with alpha becomes RGBA."""
    palette, body = None, []
    for kind, part in chunks(data):
        if kind == b"IHDR":
            width, height, bits, color, _, _, interlaced = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(part)
    n = SAMPLES[color]
    raw, at = zlib.decompress(b"".join(body)), 0
    pixels = np.zeros((height, width, n), np.uint16 if bits == 16 else np.uint8)
    for y, x, down, across in PASSES if interlaced else [(0, 0, 1, 1)]:
        h, w = -(-(height - y) // down), -(-(width - x) // across)
        if h > 0 and w > 0:
            size = h * (1 + -(-w * n * bits // 8))
            pixels[y::down, x::across] = _plain(raw[at : at + size], h, w, n, bits, color == 0)
            at += size
    if color == 3:
        return palette[pixels[..., 0]]
    if color == 4:
        return pixels[..., [0, 0, 0, 1]]
    return pixels[..., 0] if n == 1 else pixels


def _plain(data: bytes, height: int, width: int, n: int, bits: int, grey: bool) -> np.ndarray:
    """Pixels (height, width, n) of filtered rows; grey of less than a byte is stretched to the whole range."""
    raw = np.frombuffer(data, np.uint8).reshape(height, -1)
    flat = _unfilter(raw[:, 1:], raw[:, 0], max(1, n * bits // 8))
    if bits == 16:
        return flat.reshape(height, -1).view(">u2").reshape(height, width, n)
    if bits == 8:
        return flat.reshape(height, width, n)
    each = np.unpackbits(flat, axis=1).reshape(height, -1, bits)
    pixels = (each @ (1 << np.arange(bits - 1, -1, -1))).astype(np.uint8)[:, : width * n]
    return (pixels * (255 // (2**bits - 1)) if grey else pixels).reshape(height, width, n)


def head(height: int, width: int, samples: int, bits: int) -> bytes:
    color = {1: 0, 2: 4, 3: 2, 4: 6}[samples]
    return MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, color, 0, 0, 0))


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


class PngFile:
    """The reader protocol: describe(), segments(level), segment(level, i)."""

    def __init__(self, uri: str):
        self.uri = uri
        self._head = files.read_range(uri, 0, 33)
        if self._head[:8] != MAGIC:
            raise ValueError("not a PNG file")

    def describe(self) -> dict:
        width, height, bits, color = struct.unpack_from(">IIBB", self._head, 16)
        n = {3: 3, 4: 4}.get(color, SAMPLES[color])
        shape = (height, width) if n == 1 else (height, width, n)
        names = ["Gray"] if n == 1 else ["Red", "Green", "Blue", "Alpha"][:n]
        image = {"channels": [{"id": str(i), "name": x, "color": c} for i, (x, c) in enumerate(zip(names, default_colors(n), strict=True))]}
        level = {"level": 0, "shape": shape, "dtype": "uint16" if bits == 16 else "uint8"}
        return {"axes": "YX" if n == 1 else "YXC", "levels": [level], "image": image, "original": {"bits": bits, "color_type": color} | self.notes()}

    def notes(self) -> dict:
        """Texts, resolution (pixels a metre) and gamma that stand before the pixels."""
        out, at = {}, 33
        while True:
            n, kind = struct.unpack(">I4s", files.read_range(self.uri, at, 8))
            if kind in (b"IDAT", b"IEND"):
                return out
            part = files.read_range(self.uri, at + 8, n) if kind in (b"tEXt", b"zTXt", b"iTXt", b"pHYs", b"gAMA") else b""
            name, _, text = part.partition(b"\0")
            if kind == b"tEXt":
                out[name.decode("latin-1")] = text.decode("latin-1")
            elif kind == b"zTXt":
                out[name.decode("latin-1")] = zlib.decompress(text[1:]).decode("latin-1")
            elif kind == b"iTXt":
                packed, rest = text[0], text[2:].split(b"\0", 2)[2]
                out[name.decode("latin-1")] = (zlib.decompress(rest) if packed else rest).decode("utf-8", "replace")
            elif kind == b"pHYs":
                out["resolution"] = struct.unpack(">II", part[:8])
            elif kind == b"gAMA":
                out["gamma"] = struct.unpack(">I", part)[0] / 100_000
            at += 12 + n

    def segments(self, level: int) -> int:
        return 1

    def segment(self, level: int, i: int) -> tuple[tuple[int, ...], np.ndarray]:
        pixels = decode(files.read_range(self.uri))
        return (0,) * pixels.ndim, pixels
