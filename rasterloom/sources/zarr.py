"""Multiscale Zarr images (version 2), read chunk by chunk."""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa

from rasterloom.metadata import ome
from rasterloom.sources import blosc, files


def decompress(data: bytes, spec: dict | None, size: int) -> bytes:
    name = (spec or {}).get("id")
    if name is None:
        return data
    if name == "zlib":
        return zlib.decompress(data)
    if name == "gzip":
        return zlib.decompress(data, 31)
    if name == "blosc":
        return blosc.decode(data)
    if name in ("zstd", "lz4", "bz2"):
        return pa.Codec("lz4_raw" if name == "lz4" else name).decompress(data[4:] if name == "lz4" else data, size).to_pybytes()
    raise ValueError(f"Zarr compressor {name!r} is not supported")


#: Filters that can be undone.
FILTERS = ("delta", "fixedscaleoffset", "quantize", "astype", "packbits", "shuffle", "crc32", "adler32")


def unfiltered(data: bytes, spec: dict) -> bytes:
    """Undo one filter of a chunk."""
    name = spec["id"]
    if name in ("crc32", "adler32"):
        told, data = int.from_bytes(data[:4], "little"), data[4:]
        if getattr(zlib, name)(data) != told:
            raise ValueError(f"a chunk doesn't have its {name} sum")
        return data
    if name == "shuffle":
        return blosc.unshuffled(data, spec.get("elementsize", 4))
    if name == "packbits":
        return np.unpackbits(np.frombuffer(data, np.uint8, offset=1))[: (len(data) - 1) * 8 - data[0]].tobytes()
    if name == "astype":
        return np.frombuffer(data, spec["encode_dtype"]).astype(spec["decode_dtype"]).tobytes()
    kind = np.dtype(spec["dtype"])
    values = np.frombuffer(data, spec.get("astype") or kind)
    if name == "delta":
        return np.cumsum(values, dtype=kind).tobytes()
    if name == "fixedscaleoffset":
        return (values / spec["scale"] + spec["offset"]).astype(kind).tobytes()
    return values.astype(kind).tobytes()


class ZarrImage:
    """The reader protocol on a folder with `multiscales` attributes."""

    def __init__(self, uri: str):
        self.uri = uri.rstrip("/")
        self.attributes = json.loads(files.read_range(f"{self.uri}/.zattrs"))
        scales = self.attributes["multiscales"][0]
        self.paths = [d["path"] for d in scales["datasets"]]
        axes = scales.get("axes", ["t", "c", "z", "y", "x"])
        self.axes = "".join((a["name"] if isinstance(a, dict) else a).upper() for a in axes)
        self.arrays = [json.loads(files.read_range(f"{self.uri}/{p}/.zarray")) for p in self.paths]
        for a in self.arrays:
            if unknown := [f.get("id") for f in a.get("filters") or [] if f.get("id") not in FILTERS]:
                raise ValueError(f"Zarr filters {unknown} are not supported")

    def describe(self) -> dict:
        levels = [{"level": i, "shape": tuple(a["shape"]), "dtype": np.dtype(a["dtype"]).newbyteorder("=").name, "tags": a} for i, a in enumerate(self.arrays)]
        image = ome.from_omero(self.attributes)
        if not image["channels"] and "C" in self.axes:
            n = levels[0]["shape"][self.axes.index("C")]
            image = {"channels": [{"id": str(i), "name": f"Channel {i}", "color": c} for i, c in enumerate(ome.default_colors(n))]}
        return {"axes": self.axes, "levels": levels, "image": image, "original": self.attributes}

    def _grid(self, level: int) -> tuple[int, ...]:
        a = self.arrays[level]
        return tuple(-(-n // c) for n, c in zip(a["shape"], a["chunks"], strict=True))

    def segments(self, level: int) -> int:
        return int(np.prod(self._grid(level)))

    def bounds(self, level: int, i: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
        a = self.arrays[level]
        start = tuple(int(k) * c for k, c in zip(np.unravel_index(i, self._grid(level)), a["chunks"], strict=True))
        return start, tuple(min(c, n - s) for n, c, s in zip(a["shape"], a["chunks"], start, strict=True))

    def segment(self, level: int, i: int) -> tuple[tuple[int, ...], np.ndarray]:
        a = self.arrays[level]
        index = tuple(int(x) for x in np.unravel_index(i, self._grid(level)))
        path = f"{self.uri}/{self.paths[level]}/{a.get('dimension_separator', '.').join(map(str, index))}"
        kind = np.dtype(a["dtype"])
        if files.exists(path):
            raw = decompress(files.read_range(path), a["compressor"], int(np.prod(a["chunks"])) * kind.itemsize)
            for f in reversed(a.get("filters") or []):
                raw = unfiltered(raw, f)
            block = np.frombuffer(raw, kind).reshape(a["chunks"], order=a["order"])
        else:
            block = np.full(a["chunks"], a.get("fill_value") or 0, kind)
        start = tuple(k * c for k, c in zip(index, a["chunks"], strict=True))
        clip = tuple(slice(0, n - s) for n, s in zip(a["shape"], start, strict=True))
        return start, block[clip].astype(kind.newbyteorder("="))
