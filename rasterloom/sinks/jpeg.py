"""Baseline JPEG streams of 8-bit tiles, made by arrays: cosines, quantisation and codes of all blocks at once."""

from __future__ import annotations

import heapq
import struct
from functools import cache

import numpy as np

from rasterloom.sources.jpeg import COSINES, ORDER

#: Quantisation of luma and chroma at quality 50, row by row.
LUMA = [
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMA = [
    17, 18, 24, 47, 99, 99, 99, 99,
    18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99,
    47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
]
_END, _SIXTEEN = 0x00, 0xF0
_LONGEST = 16


@cache
def steps(quality: int) -> np.ndarray:
    """Quantisation of luma and chroma, in row-major places."""
    if not 1 <= quality <= 100:
        raise ValueError(f"a quality of {quality} is not between 1 and 100")
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array([LUMA, CHROMA]) * scale + 50) // 100, 1, 255)


def prefix_code(weights: dict[int, float]) -> tuple[list[int], list[int]]:
    """How many codes have each length of 1 to 16 bits, and the symbols from the shortest code on; no code is all ones."""
    heap = [(w, k, [s]) for k, (s, w) in enumerate(sorted(weights.items()))]
    heap.append((0.0, len(heap), [None]))  # takes the code of ones
    heapq.heapify(heap)
    length = dict.fromkeys([*weights, None], 0)
    tie = len(heap)
    while len(heap) > 1:
        (v, _, a), (w, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        for s in a + b:
            length[s] += 1
        heapq.heappush(heap, (v + w, tie, a + b))
        tie += 1
    counts = [0] * (max(max(length.values()), _LONGEST) + 1)
    for n in length.values():
        counts[n] += 1
    for n in range(len(counts) - 1, _LONGEST, -1):
        while counts[n]:
            # two of the longest codes: one takes their common beginning, the other goes below a shorter code
            shorter = next(k for k in range(n - 2, 0, -1) if counts[k])
            counts[n] -= 2
            counts[n - 1] += 1
            counts[shorter] -= 1
            counts[shorter + 1] += 2
    counts[max(k for k in range(_LONGEST + 1) if counts[k])] -= 1
    return counts[1 : _LONGEST + 1], sorted(weights, key=lambda s: (-weights[s], s))


@cache
def codes(kind: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Of the codes for first (0) or other (1) coefficients: their table as it is written, and code and length by symbol.

    Weights fall with the size of a value and the run of zeros before it, about as those of pictures do.
    """
    if kind == 0:
        weights = {size: 2.0 ** -abs(size - 2.5) for size in range(12)}
    else:
        weights = {run << 4 | size: 2.0 ** (-0.55 * run - 1.1 * size) for run in range(16) for size in range(1, 11)} | {_END: 0.3, _SIXTEEN: 2.0**-10}
    counts, symbols = prefix_code(weights)
    code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    value, at = 0, 0
    for size, many in enumerate(counts, 1):
        for s in symbols[at : at + many]:
            code[s], length[s] = value, size
            value += 1
        at += many
        value <<= 1
    return bytes(counts) + bytes(symbols), code, length


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@cache
def tables(quality: int, samples: int) -> bytes:
    """A stream of tables only, which all tiles of a file share."""
    used = 2 if samples == 3 else 1
    quant = b"".join(bytes([k]) + bytes(steps(quality)[k][ORDER].astype(np.uint8)) for k in range(used))
    huffman = b"".join(bytes([kind << 4]) + codes(kind)[0] for kind in range(2))
    return b"\xff\xd8" + segment(0xDB, quant) + segment(0xC4, huffman) + b"\xff\xd9"


def packed(code: np.ndarray, length: np.ndarray) -> bytes:
    """Codes one after the other, filled up with ones; a byte of ones is followed by a zero byte."""
    ends = np.cumsum(length)
    each = np.repeat(np.arange(len(code)), length)
    place = ends[each] - 1 - np.arange(len(each))
    bits = (code[each] >> place & 1).astype(np.uint8)
    bits = np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def encode(a: np.ndarray, quality: int) -> bytes:
    """A stream without tables of a tile (height, width, 1 or 3) of bytes; three samples are red, green and blue."""
    height, width, n = a.shape
    if a.dtype != np.uint8 or n not in (1, 3):
        raise ValueError("JPEG holds 8-bit pictures of one or three samples")
    full = np.pad(a, ((0, -height % 8), (0, -width % 8), (0, 0)), mode="edge").astype(np.float64)
    if n == 3:
        r, g, b = full[..., 0], full[..., 1], full[..., 2]
        y = 0.299 * r + 0.587 * g + 0.114 * b
        full = np.stack([y - 128, (b - y) / 1.772, (r - y) / 1.402], axis=-1)
    else:
        full = full - 128
    down, across = full.shape[0] // 8, full.shape[1] // 8
    blocks = full.reshape(down, 8, across, 8, n).transpose(0, 2, 4, 1, 3)
    table = steps(quality)[[0, 1, 1][:n]].reshape(n, 8, 8)
    found = np.rint(COSINES @ blocks @ COSINES.T / table).astype(np.int64).reshape(-1, n, 64)[..., ORDER]
    found[..., 0] = np.diff(found[..., 0], axis=0, prepend=0)
    found[..., 1:] = np.clip(found[..., 1:], -1023, 1023)
    lines = found.reshape(-1, 64)
    size = np.frexp(np.abs(lines))[1]
    low = np.where(lines < 0, lines + (1 << size) - 1, lines)
    _, code, length = codes(0)
    first = size[:, 0]
    out = [(np.arange(len(lines)) * 512, code[first] << first | low[:, 0], length[first] + first)]
    _, code, length = codes(1)
    row, k = np.nonzero(lines[:, 1:])
    k = k + 1
    begins = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
    run = k - np.where(begins, 0, np.r_[0, k[:-1]][: len(k)]) - 1
    held = size[row, k]
    symbol = (run % 16) << 4 | held
    out.append((row * 512 + k * 4 + 3, code[symbol] << held | low[row, k], length[symbol] + held))
    more = run // 16
    again, nth = np.repeat(np.arange(len(row)), more), np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
    out.append((row[again] * 512 + k[again] * 4 + nth, np.full(len(again), code[_SIXTEEN]), np.full(len(again), length[_SIXTEEN])))
    last = np.zeros(len(lines), np.int64)
    np.maximum.at(last, row, k)
    ended = np.flatnonzero(last < 63)
    out.append((ended * 512 + 511, np.full(len(ended), code[_END]), np.full(len(ended), length[_END])))
    order = np.argsort(np.concatenate([o[0] for o in out]), kind="stable")
    data = packed(*(np.concatenate([o[i] for o in out])[order] for i in (1, 2)))
    parts = b"".join(bytes([i + 1, 0x11, int(i > 0)]) for i in range(n))
    frame = segment(0xC0, struct.pack(">BHHB", 8, height, width, n) + parts)
    scan = segment(0xDA, bytes([n]) + b"".join(bytes([i + 1, 0]) for i in range(n)) + bytes([0, 63, 0]))
    return b"\xff\xd8" + frame + scan + data + b"\xff\xd9"
