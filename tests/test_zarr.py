"""Filters of Zarr chunks, and Blosc's own codec."""

import importlib.util
import json
import zlib
from pathlib import Path

import numpy as np
import pytest

from rasterloom.sources import blosc, files, zarr

_spec = importlib.util.spec_from_file_location("files_of_tests", Path(__file__).with_name("test_files.py"))
made = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(made)


def packed(data, longest=600, far=70_000):
    """A slow encoder of Blosc's codec: the longest match at each place, else literals."""
    out, literals, at = bytearray(), bytearray(), 0

    def flush():
        for k in range(0, len(literals), 32):
            part = literals[k : k + 32]
            out.append(len(part) - 1)
            out.extend(part)
        literals.clear()

    while at < len(data):
        best, back = 0, 0
        for start in range(max(0, at - far), at):
            n = 0
            while n < longest and at + n < len(data) and data[start + n] == data[at + n]:
                n += 1
            if n > best:
                best, back = n, at - start
        if best >= 4 and at:
            flush()
            rest = best - 3 + 1  # the three bits count from one
            near = back - 1 < 8191
            distance = back - 1 if near else back - 1 - 8191
            high, low = (distance >> 8, distance & 255) if near else (31, 255)
            out.append(min(rest, 7) << 5 | high)
            if rest >= 7:
                rest -= 7
                while rest >= 255:
                    out.append(255)
                    rest -= 255
                out.append(rest)
            out.append(low)
            if not near:
                out.extend(distance.to_bytes(2, "big"))
            at += best
        else:
            literals.append(data[at])
            at += 1
    flush()
    return bytes(out)


CASES = [b"a", b"abc" * 200, bytes(5000), b"0123456789" * 7 + b"x" * 40 + b"0123456789" * 3, bytes(range(256)) * 4, np.random.default_rng(1).bytes(100)]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_blosc_codec_against_an_encoder(k):
    raw = CASES[k]
    data = packed(raw)
    assert blosc.unpacked(data, len(raw)) == raw
    with pytest.raises((ValueError, IndexError)):
        blosc.unpacked(data[:-1], len(raw))


def test_blosc_codec_over_long_distances():
    rng = np.random.default_rng(2)
    head, filler = rng.bytes(50), rng.bytes(9000)
    data = bytearray()
    for k in range(0, len(head + filler), 32):
        part = (head + filler)[k : k + 32]
        data += bytes([len(part) - 1]) + part
    back = len(head + filler)
    for distance in (back, 8192, 8191):
        match = bytes([7 << 5 | 31, 40, 255]) + (distance - 1 - 8191).to_bytes(2, "big") if distance > 8191 else bytes([7 << 5 | (distance - 1) >> 8, 40, (distance - 1) & 255])
        raw = head + filler
        assert blosc.unpacked(bytes(data) + match, len(raw) + 49) == raw + raw[len(raw) - distance :][:49]
    with pytest.raises(ValueError, match="beyond"):
        blosc.unpacked(bytes([0, 65, 1 << 5, 9]), 4)


def written(path, a, filters, encode):
    files.write_whole(f"{path}/0/0.0", zlib.compress(encode(a)))
    spec = {"shape": a.shape, "chunks": a.shape, "dtype": a.dtype.str, "compressor": {"id": "zlib"}, "order": "C", "fill_value": 0, "zarr_format": 2, "filters": filters}
    files.write_whole(f"{path}/0/.zarray", json.dumps(spec).encode())
    files.write_whole(f"{path}/.zattrs", json.dumps({"multiscales": [{"axes": ["y", "x"], "datasets": [{"path": "0"}]}]}).encode())
    return zarr.ZarrImage(str(path)).segment(0, 0)[1]


def delta(a, kind):
    flat = a.reshape(-1)
    return np.concatenate([flat[:1], np.diff(flat)]).astype(kind)


def summed(name, data):
    return getattr(zlib, name)(data).to_bytes(4, "little") + data


def test_filters(tmp_path):
    a = made.image((30, 40), "uint16")
    plain = lambda x: x.tobytes()
    shuffled = lambda x: np.frombuffer(x.tobytes(), np.uint8).reshape(-1, 2).T.tobytes()
    cases = [
        (a, [{"id": "delta", "dtype": "<u2"}], lambda x: delta(x, "<u2").tobytes()),
        (a.astype("<i4"), [{"id": "delta", "dtype": "<i4", "astype": "<i8"}], lambda x: delta(x.astype("<i8"), "<i8").tobytes()),
        (a / 4, [{"id": "fixedscaleoffset", "dtype": "<f8", "astype": "<u4", "scale": 4, "offset": 10.5}], None),
        (a.astype("<f4"), [{"id": "quantize", "dtype": "<f4", "astype": "<f2", "digits": 3}], None),
        (a.astype("<f8"), [{"id": "astype", "encode_dtype": "<f4", "decode_dtype": "<f8"}], lambda x: x.astype("<f4").tobytes()),
        (a > 30000, [{"id": "packbits"}], lambda x: bytes([-x.size % 8]) + np.packbits(x.reshape(-1)).tobytes()),
        (a, [{"id": "shuffle", "elementsize": 2}], shuffled),
        (a, [{"id": "crc32"}], lambda x: summed("crc32", plain(x))),
        (a, [{"id": "delta", "dtype": "<u2"}, {"id": "shuffle", "elementsize": 2}, {"id": "adler32"}], lambda x: summed("adler32", shuffled(delta(x, "<u2")))),
    ]
    for k, (x, filters, encode) in enumerate(cases):
        if filters[0]["id"] == "fixedscaleoffset":
            x = x + 10.5
            got = written(tmp_path / str(k), x, filters, lambda v: np.rint((v - 10.5) * 4).astype("<u4").tobytes())
        elif filters[0]["id"] == "quantize":
            x = (x % 100).astype("<f4")
            got = written(tmp_path / str(k), x, filters, lambda v: v.astype("<f2").tobytes())
        else:
            got = written(tmp_path / str(k), x, filters, encode)
        assert got.dtype == x.dtype
        np.testing.assert_array_equal(got, x)
    with pytest.raises(ValueError, match="crc32 sum"):
        written(tmp_path / "bad", a, [{"id": "crc32"}], lambda x: b"1234" + plain(x))
    with pytest.raises(ValueError, match="own"):
        written(tmp_path / "own", a, [{"id": "delta", "dtype": "<u2"}, {"id": "own"}], plain)
