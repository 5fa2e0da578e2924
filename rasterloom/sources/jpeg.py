"""Baseline JPEG pictures as they occur in TIFF segments: Huffman codes are read one by one, all else is array work."""

from __future__ import annotations

import re
import struct

import numpy as np


def zigzag() -> list[int]:
    """Row-major places of coefficients in the order they are written: diagonal by diagonal, back and forth."""
    places = [(y + x, y if (y + x) % 2 else x, y * 8 + x) for y in range(8) for x in range(8)]
    return [p for _, _, p in sorted(places)]


ORDER = zigzag()
_k = np.arange(8)
COSINES = np.where(_k == 0, np.sqrt(1 / 8), 1 / 2)[:, None] * np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16)


def codes(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """For each 16 bits, the length and symbol of the code that they begin with (0, 0: none)."""
    table, at, code = [(0, 0)] * (1 << 16), 0, 0
    for size, many in enumerate(counts, 1):
        for symbol in symbols[at : at + many]:
            low = code << (16 - size)
            table[low : low + (1 << (16 - size))] = [(size, symbol)] * (1 << (16 - size))
            code += 1
        at += many
        code <<= 1
    return table


class Picture:
    """The tables and the frame of a JPEG stream."""

    def __init__(self) -> None:
        self.quant: dict[int, np.ndarray] = {}
        self.huffman: dict[int, list[tuple[int, int]]] = {}
        self.parts: list[tuple[int, int, int, int]] = []  # id, across, down, number of the quantisation table
        self.height = self.width = self.restart = 0
        self.transform: int | None = None
        self.planes: list[np.ndarray] = []

    def read(self, data: bytes) -> None:
        at = 2
        while at + 4 <= len(data):
            if data[at] != 0xFF or data[at + 1] == 0xFF:
                at += 1
                continue
            kind = data[at + 1]
            if kind == 0xD9:
                return
            (size,) = struct.unpack_from(">H", data, at + 2)
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if kind == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.float64)
                    body = body[1 + 64 * (1 + wide) :]
            elif kind == 0xC4:
                while body:
                    many = sum(body[1:17])
                    self.huffman[body[0]] = codes(body[1:17], body[17 : 17 + many])
                    body = body[17 + many :]
            elif kind in (0xC0, 0xC1):
                bits, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                if bits != 8:
                    raise ValueError(f"JPEG pictures of {bits} bits are not supported")
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC2 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
                raise ValueError("only baseline JPEG pictures are supported")
            elif kind == 0xDD:
                (self.restart,) = struct.unpack(">H", body)
            elif kind == 0xEE and body[:5] == b"Adobe":
                self.transform = body[11]
            elif kind == 0xDA:
                end = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]").search(data, at)
                stop = end.start() if end else len(data)
                self.scan(body, data[at:stop])
                at = stop

    def scan(self, head: bytes, data: bytes) -> None:
        """One scan with all components, block by block, then cosines for all blocks at once."""
        if head[0] != len(self.parts):
            raise ValueError("JPEG pictures of several scans are not supported")
        tables = {head[1 + 2 * i]: (self.huffman[head[2 + 2 * i] >> 4], self.huffman[0x10 | head[2 + 2 * i] & 15]) for i in range(head[0])}
        parts = self.parts if len(self.parts) > 1 else [(self.parts[0][0], 1, 1, self.parts[0][3])]
        most = max(p[1] for p in parts), max(p[2] for p in parts)
        across, down = -(-self.width // (8 * most[0])), -(-self.height // (8 * most[1]))
        plan = [(k, *tables[p[0]]) for k, p in enumerate(parts) for _ in range(p[1] * p[2])]
        found: list[tuple[list[int], list[int]]] = [([], []) for _ in parts]
        done = [0] * len(parts)
        left = across * down
        for piece in re.split(rb"\xff[\xd0-\xd7]", data):
            many = min(left, self.restart or left)
            _blocks(piece.replace(b"\xff\x00", b"\xff"), plan, many, found, done)
            left -= many
            if not left:
                break
        if left:
            raise ValueError("a JPEG picture breaks off")
        for k, (_, h, v, table) in enumerate(parts):
            coefficients = np.zeros(across * down * h * v * 64)
            coefficients[found[k][0]] = found[k][1]
            steps = np.zeros(64)
            steps[ORDER] = self.quant[table]
            blocks = (coefficients.reshape(-1, 64) * steps).reshape(-1, 8, 8)
            pixels = np.clip(np.rint(COSINES.T @ blocks @ COSINES + 128), 0, 255)
            plane = pixels.reshape(down, across, v, h, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(down * v * 8, across * h * 8)
            plane = plane.repeat(most[1] // v, 0).repeat(most[0] // h, 1)
            self.planes.append(plane[: self.height, : self.width])


def _blocks(data: bytes, plan: list, many: int, found: list, done: list[int]) -> None:
    """Read `many` units of blocks from one stretch between restarts: places and values of coefficients that are not 0."""
    raw = np.frombuffer(data + bytes(16), np.uint8).astype(np.uint64)
    ahead = (raw[:-4] << np.uint64(32) | raw[1:-3] << np.uint64(24) | raw[2:-2] << np.uint64(16) | raw[3:-1] << np.uint64(8) | raw[4:]).tolist()
    at, last, before = 0, len(data) * 8 + 32, [0] * len(found)
    for _ in range(many):
        for part, dc, ac in plan:
            places, values = found[part]
            base = done[part] * 64
            done[part] += 1
            if at >= last:
                raise ValueError("a JPEG picture breaks off")
            size, bits = dc[ahead[at >> 3] >> (24 - (at & 7)) & 0xFFFF]
            if not size:
                raise ValueError("a JPEG picture has an unknown code")
            at += size
            if bits:
                value = ahead[at >> 3] >> (40 - (at & 7) - bits) & ((1 << bits) - 1)
                at += bits
                before[part] += value if value >> (bits - 1) else value - (1 << bits) + 1
            places.append(base)
            values.append(before[part])
            k = 1
            while k < 64:
                if at >= last:
                    raise ValueError("a JPEG picture breaks off")
                size, symbol = ac[ahead[at >> 3] >> (24 - (at & 7)) & 0xFFFF]
                if not size:
                    raise ValueError("a JPEG picture has an unknown code")
                at += size
                bits = symbol & 15
                k += symbol >> 4
                if not bits:
                    if symbol != 0xF0:
                        break
                    k += 1
                    continue
                value = ahead[at >> 3] >> (40 - (at & 7) - bits) & ((1 << bits) - 1)
                at += bits
                if k > 63:
                    raise ValueError("a JPEG picture has a block of too many values")
                places.append(base + ORDER[k])
                values.append(value if value >> (bits - 1) else value - (1 << bits) + 1)
                k += 1


def decode(data: bytes, tables: bytes = b"", luma: bool = True) -> np.ndarray:
    """Pixels (height, width, samples); tables: a stream that holds tables only; luma: three samples are luma and chroma, unless the stream says so itself."""
    picture = Picture()
    if tables:
        picture.read(tables)
    picture.read(data)
    if not picture.planes:
        raise ValueError("not a JPEG picture")
    out = np.stack(picture.planes, axis=-1)
    if out.shape[2] == 3 and (luma if picture.transform is None else picture.transform == 1):
        y, b, r = out[..., 0], out[..., 1] - 128, out[..., 2] - 128
        out = np.stack([y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b], axis=-1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)
