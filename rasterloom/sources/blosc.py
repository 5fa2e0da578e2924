"""Blosc containers (version 2 of the format), as Zarr chunks hold them."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa

#: Codecs by their number in the flags.
CODECS = {1: "lz4_raw", 2: "snappy", 3: "zlib", 4: "zstd"}


def unshuffled(data: bytes, size: int) -> bytes:
    """Undo the shuffle that puts all first bytes of the elements first, then all second ones; a rest stays behind."""
    n = len(data) // size
    whole = np.frombuffer(data, np.uint8, n * size)
    return whole.reshape(size, n).T.tobytes() + data[n * size :]


def unshuffled_bits(data: bytes, size: int) -> bytes:
    """The same with bits, for as many elements as make whole bytes."""
    n = len(data) // size // 8 * 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, n * size).reshape(size * 8, n // 8), axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little").tobytes() + data[n * size :]


#: Fixed values of Blosc's own codec: bytes of a match beyond what its first byte counts, and the distance from which one has 16 bits.
_LEAST, _FAR = 3, 8191


def unpacked(data: bytes, size: int) -> bytes:
    """Blosc's own codec: runs of literals, and matches with what came before.

    A first byte below 32 counts literals less one. Else its upper three bits count a match's bytes, going on in following
    bytes where they are full, and its lower five and one more byte tell the distance; where these are full too, two more bytes do.
    """
    out, at, first = bytearray(), 0, True
    while at < len(data):
        head = data[at] & 31 if first else data[at]
        at, first = at + 1, False
        if head < 32:
            if at + head + 1 > len(data):
                raise ValueError("a Blosc block breaks off")
            out += data[at : at + head + 1]
            at += head + 1
            continue
        many = (head >> 5) - 1
        if many == 6:
            while data[at] == 255:
                many, at = many + 255, at + 1
            many, at = many + data[at], at + 1
        high, low = (head & 31) << 8, data[at]
        at += 1
        back = high + low + 1
        if low == 255 and high == 31 << 8:
            back = (data[at] << 8 | data[at + 1]) + _FAR + 1
            at += 2
        many += _LEAST
        if back > len(out):
            raise ValueError("a Blosc block looks back beyond its beginning")
        piece = bytes(out[len(out) - back : len(out) - back + many])
        # a match may reach into what it makes itself
        out += piece if len(piece) == many else (piece * (many // len(piece) + 1))[:many]
    if len(out) != size:
        raise ValueError(f"a Blosc block has {len(out)} of {size} bytes")
    return bytes(out)


def inflate(codec: int, data: bytes, size: int) -> bytes:
    if len(data) == size:
        return data
    if codec == 0:
        return unpacked(data, size)
    if codec not in CODECS:
        raise ValueError(f"Blosc codec {codec} is not supported")
    name = CODECS[codec]
    return zlib.decompress(data) if name == "zlib" else pa.Codec(name).decompress(data, size).to_pybytes()


def decode(data: bytes) -> bytes:
    """The bytes of a container: blocks, each in one piece or in one piece for each byte of an element."""
    _, _, flags, size, total, block, packed = struct.unpack_from("<BBBBIII", data)
    if flags & 2:
        return data[16 : 16 + total]
    if packed != len(data):
        raise ValueError("a Blosc chunk breaks off")
    n = -(-total // block) if total else 0
    out = []
    for i, at in enumerate(struct.unpack_from(f"<{n}I", data, 16)):
        whole = min(block, total - i * block)
        pieces = size if not flags & 16 and whole == block and size <= 16 and block // size >= 128 else 1
        parts = []
        for _ in range(pieces):
            (many,) = struct.unpack_from("<I", data, at)
            parts.append(inflate(flags >> 5, data[at + 4 : at + 4 + many], whole // pieces))
            at += 4 + many
        plain = b"".join(parts)
        out.append(unshuffled(plain, size) if flags & 1 and size > 1 else unshuffled_bits(plain, size) if flags & 4 else plain)
    return b"".join(out)
