import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterloom import api
from rasterloom.metadata import ome
from rasterloom.operators.pyramid import ssim as pm_ssim
from rasterloom.operators.slide import Slide
from rasterloom.sinks import writers
from rasterloom.sources import blosc, files, jpeg, png, raster, store, tiff


def image(shape, dtype="uint8", seed=0):
    return np.random.default_rng(seed).integers(0, np.iinfo(dtype).max, shape, dtype=dtype)


def write_zarr(path, a, axes, chunks):
    for i in np.ndindex(*[-(-n // c) for n, c in zip(a.shape, chunks, strict=True)]):
        block = np.zeros(chunks, a.dtype)
        piece = a[tuple(slice(k * c, (k + 1) * c) for k, c in zip(i, chunks, strict=True))]
        block[tuple(slice(0, n) for n in piece.shape)] = piece
        files.write_whole(f"{path}/0/" + ".".join(map(str, i)), zlib.compress(block.tobytes()))
    spec = {"shape": a.shape, "chunks": chunks, "dtype": a.dtype.str, "compressor": {"id": "zlib"}, "order": "C", "fill_value": 0, "zarr_format": 2}
    files.write_whole(f"{path}/0/.zarray", json.dumps(spec).encode())
    omero = {"channels": [{"label": f"c{k}", "color": "00FF00", "window": {"start": 1, "end": 9}} for k in range(a.shape[axes.index("C")])]} if "C" in axes else {}
    about = {"multiscales": [{"axes": [{"name": d.lower()} for d in axes], "datasets": [{"path": "0"}]}], "omero": omero}
    files.write_whole(f"{path}/.zattrs", json.dumps(about).encode())


def pixels(df, axes, shape):
    out = np.zeros(shape, np.int64)
    rows = df.toPandas()
    out[tuple(rows[d.lower()] for d in axes)] = rows["intensity"]
    return out


@pytest.mark.parametrize("axes,shape,dtype", [("YX", (70, 90), "uint8"), ("CYX", (3, 40, 50), "uint16"), ("TCZYX", (2, 3, 2, 33, 21), "int8"), ("TCZYX", (1, 3, 1, 33, 21), "uint8")])
def test_zarr_to_store_and_back(spark, tmp_path, axes, shape, dtype):
    a = image(shape, dtype)
    write_zarr(str(tmp_path / "a"), a, axes, tuple(max(1, n // 2) for n in shape))
    slide = api.ingest(spark, str(tmp_path / "a"), str(tmp_path / "s"), "i", "zarr", tiles={"Y": 16, "X": 16})
    np.testing.assert_array_equal(pixels(slide.read_level(0, original_axes=True), axes, shape), a)
    api.export(spark, str(tmp_path / "s"), "i", str(tmp_path / "b"), "zarr")
    back = raster.READERS["zarr"](str(tmp_path / "b"))
    assert back.describe()["axes"] == axes and back.describe()["levels"][0]["shape"] == shape
    got = np.zeros(shape, dtype)
    for k in range(back.segments(0)):
        start, block = back.segment(0, k)
        got[tuple(slice(s, s + n) for s, n in zip(start, block.shape, strict=True))] = block
    np.testing.assert_array_equal(got, a)


@pytest.mark.parametrize("axes,shape,dtype", [("YX", (300, 270), "uint16"), ("CYX", (2, 300, 40), "uint8"), ("TZYX", (2, 3, 20, 30), "int8"), ("YXC", (260, 300, 3), "uint8")])
def test_zarr_to_tiff_and_back(spark, tmp_path, axes, shape, dtype):
    a = image(shape, dtype)
    write_zarr(str(tmp_path / "a"), a, axes, tuple(max(1, n // 2) for n in shape))
    api.ingest(spark, str(tmp_path / "a"), str(tmp_path / "s"), "i", "zarr", tiles={"Y": 256, "X": 256})
    api.export(spark, str(tmp_path / "s"), "i", str(tmp_path / "b.tif"), "tiff")
    slide = api.ingest(spark, str(tmp_path / "b.tif"), str(tmp_path / "s2"), "j", "tiff", tiles={"Y": 64, "X": 100})
    about = tiff.TiffFile(str(tmp_path / "b.tif")).describe()
    assert sorted(about["axes"]) == sorted(axes)
    want = a.transpose([axes.index(d) for d in about["axes"]])
    np.testing.assert_array_equal(pixels(slide.read_level(0, original_axes=True), about["axes"], want.shape), want)


def plain_tiff(path, a, compression, encode, rows=8, order="<", predictor=1):
    h, w = a.shape[:2]
    n = a.shape[2] if a.ndim == 3 else 1
    data = a
    if predictor == 2:
        data = np.diff(a, axis=1, prepend=np.zeros_like(a[:, :1]))
    strips = [encode(data[y : y + rows].astype(a.dtype.newbyteorder(order)).tobytes()) for y in range(0, h, rows)]
    offsets, at = [], 8
    for s in strips:
        offsets.append(at)
        at += len(s)
    tail, entries = b"", []
    base = at + 2 + 12 * 10 + 4
    for tag, kind, values in [(256, 4, [w]), (257, 4, [h]), (258, 3, [a.dtype.itemsize * 8] * n), (259, 3, [compression]), (262, 3, [2 if n == 3 else 1]), (273, 4, offsets),
                              (277, 3, [n]), (278, 4, [rows]), (279, 4, [len(s) for s in strips]), (317, 3, [predictor])]:
        packed = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
        if len(packed) > 4:
            entries.append(struct.pack(f"{order}HHII", tag, kind, len(values), base + len(tail)))
            tail += packed
        else:
            entries.append(struct.pack(f"{order}HHI", tag, kind, len(values)) + packed.ljust(4, b"\0"))
    head = struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, at)
    path.write_bytes(head + b"".join(strips) + struct.pack(f"{order}H", 10) + b"".join(entries) + struct.pack(f"{order}I", 0) + tail)


def packbits(raw):
    return b"".join(bytes([len(raw[i : i + 128]) - 1]) + raw[i : i + 128] for i in range(0, len(raw), 128))


def lzw(raw):
    bits, width, table = [], 9, {bytes([i]): i for i in range(256)}
    put = lambda c: bits.append(f"{c:0{width}b}")
    put(256)
    size, word = 258, b""
    for x in raw:
        if word + bytes([x]) in table:
            word += bytes([x])
            continue
        put(table[word])
        table[word + bytes([x])] = size
        size += 1
        width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
        if size >= 4094:
            put(256)
            size, width, table = 258, 9, {bytes([i]): i for i in range(256)}
        word = bytes([x])
    put(table[word])
    size += 1
    width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
    put(257)
    line = "".join(bits)
    line += "0" * (-len(line) % 8)
    return bytes(int(line[i : i + 8], 2) for i in range(0, len(line), 8))


@pytest.mark.parametrize("compression,encode", [(1, bytes), (8, zlib.compress), (32773, packbits), (5, lzw)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_strip_codecs(tmp_path, compression, encode, order):
    a = image((21, 37), "uint16", 4) // 257
    plain_tiff(tmp_path / "a.tif", a, compression, encode, order=order, predictor=2 if compression != 1 else 1)
    t = tiff.TiffFile(str(tmp_path / "a.tif"))
    got = np.concatenate([t.segment(0, i)[1] for i in range(t.segments(0))])
    np.testing.assert_array_equal(got, a)


def test_scanned_slide_is_opaque_rgba(tmp_path):
    a = image((21, 37, 3))
    plain_tiff(tmp_path / "a.tif", a, 8, zlib.compress)
    t = tiff.ScannedSlide(str(tmp_path / "a.tif"))
    block = t.segment(0, 0)[1]
    assert t.describe()["levels"][0]["shape"] == (21, 37, 4) and (block[..., 3] == 255).all()
    np.testing.assert_array_equal(block[..., :3], a[:8])


def paged_tiff(path, pages):
    """Pages (height, width[, samples]) with their descriptions; those marked tiled have tiles of 16 by 16."""
    body, directories = bytearray(8), []
    for a, text, tiled in pages:
        h, w = a.shape[:2]
        n = a.shape[2] if a.ndim == 3 else 1
        full = np.pad(a, [(0, -h % 16), (0, -w % 16)] + [(0, 0)] * (a.ndim - 2)) if tiled else a
        parts = [full[y : y + 16, x : x + 16].tobytes() for y in range(0, h, 16) for x in range(0, w, 16)] if tiled else [a.tobytes()]
        offsets = []
        for part in parts:
            offsets.append(len(body))
            body += part
        sizes = [len(p) for p in parts]
        cut = [(322, 4, [16]), (323, 4, [16]), (324, 4, offsets), (325, 4, sizes)] if tiled else [(273, 4, offsets), (278, 4, [h]), (279, 4, sizes)]
        tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [a.dtype.itemsize * 8] * n), (259, 3, [1]), (262, 3, [2 if n == 3 else 1]), (277, 3, [n]), (270, 2, text.encode() + b"\0"), *cut]
        entries = b""
        for tag, kind, values in sorted(tags, key=lambda t: t[0]):
            packed = bytes(values) if kind == 2 else struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(packed) > 4:
                at = len(body)
                body += packed
                packed = struct.pack("<I", at)
            entries += struct.pack("<HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
        directories.append((len(body), len(tags)))
        body += struct.pack("<H", len(tags)) + entries + bytes(4)
    starts = [at for at, _ in directories]
    for (at, n), following in zip(directories, [*starts[1:], 0], strict=True):
        struct.pack_into("<I", body, at + 2 + 12 * n, following)
    body[:8] = struct.pack("<2sHI", b"II", 42, starts[0])
    path.write_bytes(bytes(body))


def page_xml(name, color):
    return f'<?xml version="1.0" encoding="utf-16"?><PerkinElmer-QPI-ImageDescription><Name>{name}</Name><Color>{color}</Color></PerkinElmer-QPI-ImageDescription>'


def test_multispectral_pages_are_channels_with_levels(spark, tmp_path):
    texts = [page_xml("DAPI", "0,0,255"), page_xml("FITC", "0,255,0")]
    base, half, quarter = (image((2, *size), "uint16", seed) for seed, size in enumerate([(45, 35), (22, 17), (11, 8)]))
    thumb = (image((9, 7, 3)), page_xml("thumb", ""), False)
    pages = [(a, t, True) for a, t in zip(base, texts, strict=True)] + [thumb]
    pages += [(a, t, True) for level in (half, quarter) for a, t in zip(level, texts, strict=True)] + [(image((12, 30, 3)), page_xml("macro", ""), False)]
    paged_tiff(tmp_path / "a.qptiff", pages)
    about = tiff.TiffFile(str(tmp_path / "a.qptiff")).describe()
    assert about["axes"] == "CYX" and [level["shape"] for level in about["levels"]] == [base.shape, half.shape, quarter.shape]
    slide = api.ingest(spark, str(tmp_path / "a.qptiff"), str(tmp_path / "s"), "i", "tiff", tiles={"Y": 16, "X": 16})
    for level, a in enumerate((base, half, quarter)):
        np.testing.assert_array_equal(pixels(slide.read_level(level, original_axes=True), "CYX", a.shape), a)
    channels = json.loads(slide.properties)["channels"]
    assert [(c["name"], c["min"], c["max"]) for c in channels] == [("DAPI", base[0].min(), base[0].max()), ("FITC", base[1].min(), base[1].max())]


def test_an_incomplete_multispectral_level_is_told(tmp_path):
    base, half = image((2, 40, 32)), image((20, 16))
    paged_tiff(tmp_path / "a.qptiff", [(a, page_xml("x", ""), True) for a in (*base, half)])
    with pytest.raises(ValueError, match="1 of 2 pages"):
        tiff.TiffFile(str(tmp_path / "a.qptiff"))


@pytest.mark.parametrize("kind", range(5))
def test_png_row_filters(kind):
    a = image((9, 7, 3)).astype(np.int64)
    up, left = np.pad(a, ((1, 0), (0, 0), (0, 0)))[:-1], np.pad(a, ((0, 0), (1, 0), (0, 0)))[:, :-1]
    corner = np.pad(up, ((0, 0), (1, 0), (0, 0)))[:, :-1]
    p = left + up - corner
    paeth = np.select([(abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), abs(p - up) <= abs(p - corner)], [left, up], corner)
    rows = ((a - [0, left, up, (left + up) // 2, paeth][kind]) % 256).astype(np.uint8).reshape(9, -1)
    body = zlib.compress(b"".join(bytes([kind]) + r.tobytes() for r in rows))
    data = png.head(9, 7, 3, 8) + png.chunk(b"IDAT", body) + png.chunk(b"IEND", b"")
    np.testing.assert_array_equal(png.decode(data), a)


@pytest.mark.parametrize("shape,bits", [((9, 13), 8), ((3, 2), 8), ((1, 1), 8), ((17, 21, 3), 8), ((10, 11), 1)])
def test_interlaced_png(shape, bits):
    a = image(shape) if bits == 8 else image(shape) % 2 * 255
    body = b""
    for y, x, down, across in png.PASSES:
        part = a[y::down, x::across]
        if part.size:
            rows = part.reshape(len(part), -1)
            body += b"".join(b"\0" + (r if bits == 8 else np.packbits(r > 0)).tobytes() for r in rows)
    n = 3 if len(shape) == 3 else 1
    head = png.MAGIC + png.chunk(b"IHDR", struct.pack(">IIBBBBB", shape[1], shape[0], bits, 2 if n == 3 else 0, 0, 0, 1))
    np.testing.assert_array_equal(png.decode(head + png.chunk(b"IDAT", zlib.compress(body)) + png.chunk(b"IEND", b"")), a)


def test_bands_of_a_png_make_one_valid_stream(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "PNG_BAND", 7 * 50 * 3)
    a = image((40, 50, 3))
    write_zarr(str(tmp_path / "a"), a, "YXC", (20, 25, 3))
    api.ingest(spark, str(tmp_path / "a"), str(tmp_path / "s"), "i", "zarr", tiles={"Y": 16, "X": 16})
    api.export(spark, str(tmp_path / "s"), "i", str(tmp_path / "b.png"), "png", effort=1)
    data = (tmp_path / "b.png").read_bytes()
    np.testing.assert_array_equal(png.decode(data), a)
    assert sum(kind == b"IDAT" for kind, _ in png.chunks(data)) == 7
    x, y = b"some bytes", b"and more of them" * 5000
    assert writers.joined_sums(zlib.adler32(x), zlib.adler32(y), len(y)) == zlib.adler32(x + y)


@pytest.mark.parametrize("shape,dtype", [((50, 70), "uint8"), ((50, 70, 3), "uint8"), ((33, 20, 4), "uint16")])
def test_png_to_store_and_back(spark, tmp_path, shape, dtype):
    a = image(shape, dtype)
    n = shape[2] if len(shape) == 3 else 1
    rows = a.astype(a.dtype.newbyteorder(">")).reshape(shape[0], -1).view(np.uint8)
    body = zlib.compress(b"".join(b"\0" + r.tobytes() for r in rows))
    (tmp_path / "a.png").write_bytes(png.head(*shape[:2], n, a.dtype.itemsize * 8) + png.chunk(b"IDAT", body) + png.chunk(b"IEND", b""))
    slide = api.ingest(spark, str(tmp_path / "a.png"), str(tmp_path / "s"), "i", "png", tiles={"Y": 16, "X": 16})
    assert slide.dimensions == (shape[1], shape[0])
    api.export(spark, str(tmp_path / "s"), "i", str(tmp_path / "b.png"), "png")
    np.testing.assert_array_equal(png.decode((tmp_path / "b.png").read_bytes()), a)


def test_store_commits_last_skips_what_is_there_and_guards_versions(spark, tmp_path):
    a = image((40, 60))
    write_zarr(str(tmp_path / "a"), a, "YX", (20, 20))
    path = str(tmp_path / "s")
    with pytest.raises(KeyError):
        Slide(spark, path, "i")
    slide = api.ingest(spark, str(tmp_path / "a"), path, "i", "zarr", tiles={"Y": 16, "X": 16}, scale_factors=[2.0, 4.0])
    assert slide.level_dimensions == [(60, 40), (30, 20), (15, 10)] and slide.level_downsamples == [1.0, 2.0, 4.0]
    assert slide.best_level_for_downsample(3) == 1
    before = store.tiles(spark, path).count()
    level = store.levels(spark, path).filter("level = 0").first().asDict()
    assert store.save_level(spark, path, level, spark.createDataFrame([], "image_id string, level int, start array<int>, extent array<int>, dtype string, data binary")) is False
    assert store.tiles(spark, path).count() == before
    channels = json.loads(slide.properties)["channels"]
    assert channels == [] or channels[0]["min"] == a.min()
    row = store.images(spark, path).first().asDict()
    store.mark(spark, path, row | {"fmt_version": 1})
    with pytest.warns(UserWarning, match="another format version"):
        assert store.check_version(spark, path, "i") is False
    region = slide.read_region((5, 10), 0, (7, 9)).toPandas()
    assert len(region) == 63 and region["x"].min() == 5 and region["y"].max() == 18
    assert region.set_index(["y", "x"])["intensity"].loc[(12, 7)] == a[12, 7]


def test_tiles_of_a_load_that_broke_off_do_not_count(spark, tmp_path, monkeypatch):
    a = image((40, 60))
    write_zarr(str(tmp_path / "a"), a, "YX", (20, 20))
    path = str(tmp_path / "s")
    with monkeypatch.context() as m:
        m.setattr(store, "mark", lambda *args: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            api.ingest(spark, str(tmp_path / "a"), path, "i", "zarr", tiles={"Y": 8, "X": 8})
    with pytest.raises(KeyError):
        Slide(spark, path, "i")
    slide = api.ingest(spark, str(tmp_path / "a"), path, "i", "zarr", tiles={"Y": 32, "X": 32})
    np.testing.assert_array_equal(pixels(slide.read_level(0, original_axes=True), "YX", a.shape), a)
    assert store.tiles(spark, path).count() == 4


def test_region_reads_only_tiles_in_reach(spark, tmp_path):
    write_zarr(str(tmp_path / "a"), image((64, 64)), "YX", (32, 32))
    slide = api.ingest(spark, str(tmp_path / "a"), str(tmp_path / "s"), "i", "zarr", tiles={"Y": 16, "X": 16})
    plan = slide.read_region((0, 20), 0, (10, 10))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ty)" in plan and "(tx#" in plan


def test_sources_read_only_segments_that_a_region_meets(spark, tmp_path, monkeypatch):
    a = image((3, 64, 48))
    write_zarr(str(tmp_path / "a"), a, "CYX", (1, 16, 16))
    region = {"Y": (20, 40), "X": (30, 33), "C": (1, 3)}
    reader = raster.RasterReader(raster.READERS["zarr"], str(tmp_path / "a"), 0, region)
    assert sorted(i for p in reader.partitions() for i in p.segments) == [c * 12 + y * 3 + x for c in (1, 2) for y in (1, 2) for x in (1, 2)]
    out = np.zeros_like(a)
    for b in raster.blocks(spark, str(tmp_path / "a"), "zarr", 0, region).collect():
        out[tuple(slice(s, s + n) for s, n in zip(b.start, b.extent, strict=True))] = np.frombuffer(b.data, b.dtype).reshape(b.extent)
    want = np.zeros_like(a)
    want[1:3, 20:40, 30:33] = a[1:3, 20:40, 30:33]
    np.testing.assert_array_equal(out, want)
    b = image((40, 70, 3))
    paged_tiff(tmp_path / "b.tif", [(b, "", True)])
    t = tiff.TiffFile(str(tmp_path / "b.tif"))
    for i in range(t.segments(0)):
        start, block = t.segment(0, i)
        assert (start, block.shape) == t.bounds(0, i)
        np.testing.assert_array_equal(block, b[tuple(slice(s, s + n) for s, n in zip(start, block.shape, strict=True))])


@pytest.mark.parametrize("tiles", [{"Y": 100, "X": 70}, {"Y": 256, "X": 100}, {"Y": 30, "X": 512}])
def test_tiff_export_of_any_stored_tile(spark, tmp_path, tiles):
    a = image((300, 530, 3))
    write_zarr(str(tmp_path / "a"), a, "YXC", (128, 100, 3))
    api.ingest(spark, str(tmp_path / "a"), str(tmp_path / "s"), "i", "zarr", tiles=tiles)
    api.export(spark, str(tmp_path / "s"), "i", str(tmp_path / "b.tif"), "tiff")
    t = tiff.TiffFile(str(tmp_path / "b.tif"))
    out = np.zeros_like(a)
    for i in range(t.segments(0)):
        start, block = t.segment(0, i)
        out[tuple(slice(s, s + n) for s, n in zip(start, block.shape, strict=True))] = block
    np.testing.assert_array_equal(out, a)
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith(".")] == []


@pytest.mark.parametrize("axes,shape", [("YXC", (40, 50, 3)), ("CYX", (4, 40, 50))])
def test_channels_side_by_side_through_load_read_and_export(spark, tmp_path, axes, shape):
    a = image(shape)
    write_zarr(str(tmp_path / "a"), a, axes, tuple(max(1, n // 2) for n in shape[:2]) + ((3,) if axes == "YXC" else (50,)))
    slide = api.ingest(spark, str(tmp_path / "a"), str(tmp_path / "s"), "i", "zarr", tiles={"Y": 16, "X": 16}, folded=True)
    n = shape[axes.index("C")]
    level = store.levels(spark, str(tmp_path / "s")).first()
    assert (level.axes, level.pixel_depth, level.shape, level.tile) == ("YX", n, [40, 50 * n], [16, 16 * n]) and slide.dimensions == (50, 40)
    want = a if axes == "YXC" else a.transpose(1, 2, 0)
    np.testing.assert_array_equal(pixels(slide.read_level(0, original_axes=True), axes, shape), a)
    got = slide.read_region((10, 5), 0, (20, 30)).toPandas()
    assert len(got) == 600 * n and (want[got["y"], got["x"], got["c"]] == got["intensity"]).all()
    stats = store.channel_stats(store.level_tiles(spark, str(tmp_path / "s"), level.asDict()), "YX", n).orderBy("c").collect()
    assert [(c["min"], c["max"]) for c in stats] == [(want[..., k].min(), want[..., k].max()) for k in range(n)]
    if n == 3:
        api.export(spark, str(tmp_path / "s"), "i", str(tmp_path / "c.png"), "png")
        np.testing.assert_array_equal(png.decode((tmp_path / "c.png").read_bytes()), want)
        api.export(spark, str(tmp_path / "s"), "i", str(tmp_path / "c.tif"), "tiff", tile=16)
    api.export(spark, str(tmp_path / "s"), "i", str(tmp_path / "c.zarr"), "zarr")
    for name, codec in [("c.zarr", "zarr"), *([("c.tif", "tiff")] if n == 3 else [])]:
        back = api.ingest(spark, str(tmp_path / name), str(tmp_path / "t"), codec, codec)
        np.testing.assert_array_equal(pixels(back.read_level(0, original_axes=True), axes, shape), a)


def test_a_load_with_holes_fails_and_is_swept_up(spark, tmp_path):
    path = str(tmp_path / "s")
    kinds = "image_id string, level int, start array<int>, extent array<int>, dtype string, data binary"
    row = {"image_id": "i", "level": 0, "axes": "YX", "shape": [40, 40], "dtype": "uint8", "tile": [16, 16], "codec": "zstd", "pixel_depth": 1, "original_axes": "YX", "original_shape": [40, 40], "properties": {}}
    whole = [("i", 0, [y, x], [min(20, 40 - y), 20], "uint8", bytes(400)) for y in (0, 20) for x in (0, 20)]
    twice = [*whole[:3], ("i", 0, [20, 0], [20, 20], "uint8", bytes(400))]
    for some, told in ((whole[:3], "missing"), (twice, "missing"), ([("i", 0, [0, 0], [16, 40], "uint8", bytes(640))], "3 of 9 tiles")):
        with pytest.raises(Exception, match=told):
            store.save_level(spark, path, row, spark.createDataFrame(some, kinds))
    assert store.levels(spark, path).count() == 0
    assert store.save_level(spark, path, row, spark.createDataFrame(whole, kinds))
    assert store.vacuum(spark, path) >= 1 and store.vacuum(spark, path) == 0
    assert store.tiles(spark, path).count() == 9


# ---- codecs


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_samples_of_less_than_a_byte(bits):
    a = image((5, 13), "uint8") % (1 << bits)
    flat = np.unpackbits(a[..., None], axis=2)[..., 8 - bits :].reshape(5, -1)
    page = {"bits": (bits,), "predictor": 1, "compression": 1}
    np.testing.assert_array_equal(tiff.samples(np.packbits(flat, axis=1).tobytes(), page, 5, 13, 1, np.dtype("u1"))[..., 0], a)


@pytest.mark.parametrize("kind", ["<f4", ">f4", "<f8"])
@pytest.mark.parametrize("inner", [1, 3])
def test_floating_point_predictor(kind, inner):
    a = np.random.default_rng(2).normal(size=(4, 9, inner)).astype(kind)
    size = a.dtype.itemsize
    planes = np.ascontiguousarray(a.astype(a.dtype.newbyteorder(">"))).view(np.uint8).reshape(4, 9 * inner, size).transpose(0, 2, 1).reshape(4, -1)
    steps = planes.copy()
    steps[:, inner:] -= planes[:, :-inner]
    page = {"bits": (size * 8,), "predictor": 3, "compression": 8}
    np.testing.assert_array_equal(tiff.samples(zlib.compress(steps.tobytes()), page, 4, 9, inner, a.dtype), a)


def test_what_cannot_be_read_is_an_error(tmp_path):
    for page, kind in [({"bits": (8,), "predictor": 4}, "u1"), ({"bits": (16,), "predictor": 3}, "u2"), ({"bits": (4,), "predictor": 2}, "u1")]:
        with pytest.raises(ValueError, match="predictor"):
            tiff.samples(bytes(100), page | {"compression": 1}, 2, 3, 1, np.dtype(kind))
    write_zarr(str(tmp_path / "a"), image((10, 10)), "YX", (10, 10))
    about = json.loads((tmp_path / "a/0/.zarray").read_text())
    (tmp_path / "a/0/.zarray").write_text(json.dumps(about | {"filters": [{"id": "own"}]}))
    with pytest.raises(ValueError, match="own"):
        raster.READERS["zarr"](str(tmp_path / "a"))
    a = image((21, 37))
    plain_tiff(tmp_path / "a.tif", a, 1, lambda raw: b"" if raw == a[8:16].tobytes() else raw)
    t = tiff.TiffFile(str(tmp_path / "a.tif"))
    assert (t.segment(0, 1)[1] == 0).all() and (t.segment(0, 0)[1] == a[:8]).all()


def blosc_chunk(raw, size, block, codec, shuffle, split):
    flags, out = (codec << 5) | shuffle | (0 if split else 16), []
    pack = {1: lambda b: pa.Codec("lz4_raw").compress(b).to_pybytes(), 3: zlib.compress, 4: lambda b: pa.Codec("zstd").compress(b).to_pybytes()}[codec]
    for at in range(0, len(raw), block):
        part = raw[at : at + block]
        n = len(part) // size
        if shuffle == 1:
            part = b"".join(part[k : n * size : size] for k in range(size)) + part[n * size :]
        elif shuffle == 4:
            n = n // 8 * 8
            bits = np.unpackbits(np.frombuffer(part, np.uint8, n * size).reshape(n, size), axis=1, bitorder="little")
            part = np.packbits(bits.T, axis=1, bitorder="little").tobytes() + part[n * size :]
        pieces = size if split and len(part) == block else 1
        step, packed = len(part) // pieces, b""
        for k in range(pieces):
            piece = part[k * step : (k + 1) * step]
            made = min(pack(piece), piece, key=len)
            packed += struct.pack("<I", len(made)) + made
        out.append(packed)
    starts = np.cumsum([16 + 4 * len(out), *map(len, out)])
    return struct.pack("<BBBBIII", 2, 1, flags, size, len(raw), block, int(starts[-1])) + struct.pack(f"<{len(out)}I", *starts[:-1]) + b"".join(out)


@pytest.mark.parametrize("codec", [1, 3, 4])
@pytest.mark.parametrize("shuffle", [0, 1, 4])
@pytest.mark.parametrize("split", [False, True])
def test_blosc(codec, shuffle, split):
    raw = (np.arange(5003, dtype="<u4") // 7).tobytes() + b"xyz"
    assert blosc.decode(blosc_chunk(raw, 4, 4096, codec, shuffle, split)) == raw
    noise = np.random.default_rng(1).bytes(3000)
    assert blosc.decode(blosc_chunk(noise, 1, 1024, codec, shuffle, False)) == noise
    assert blosc.decode(struct.pack("<BBBBIII", 2, 1, 2, 4, 8, 8, 24) + b"12345678") == b"12345678"
    with pytest.raises(ValueError):
        blosc.decode(struct.pack("<BBBBIII", 2, 1, 0, 1, 8, 8, 26) + struct.pack("<II", 20, 2) + b"zz")


def jpeg_of(spark, a, quality=0.95):
    """A JPEG stream made by the JVM, and the pixels that the JVM reads from it."""
    jvm = spark._jvm
    h, w = a.shape[:2]
    kind = 1 if a.ndim == 3 else 10
    picture = jvm.java.awt.image.BufferedImage(w, h, kind)
    raster_ = picture.getRaster()
    flat = spark.sparkContext._gateway.new_array(jvm.int, a.size)
    for i, v in enumerate(a.reshape(-1).tolist()):
        flat[i] = v
    raster_.setPixels(0, 0, w, h, flat)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    out = jvm.java.io.ByteArrayOutputStream()
    writer.setOutput(jvm.javax.imageio.ImageIO.createImageOutputStream(out))
    options = writer.getDefaultWriteParam()
    options.setCompressionMode(2)
    options.setCompressionQuality(quality)
    writer.write(None, jvm.javax.imageio.IIOImage(picture, None, None), options)
    writer.dispose()
    data = bytes(out.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data)).getData()
    none = spark.sparkContext._gateway.new_array(jvm.int, a.size)
    return data, np.array(list(back.getPixels(0, 0, w, h, none))).reshape(a.shape)


def smooth(shape):
    y, x = np.indices(shape[:2])
    a = 128 + 90 * np.sin(y / 9)[..., None] * np.cos(x / 7)[..., None] * np.array([1, 0.6, -0.8][: shape[2] if len(shape) == 3 else 1])
    return (a if len(shape) == 3 else a[..., 0]).astype(np.uint8)


@pytest.mark.parametrize("shape", [(21, 37), (24, 40, 3), (16, 16, 3)])
def test_jpeg_equals_another_decoder(spark, shape):
    data, want = jpeg_of(spark, smooth(shape))
    got = jpeg.decode(data)
    # chroma is spread by repetition here and smoothly there
    assert got.shape == (*shape[:2], shape[2] if len(shape) == 3 else 1)
    error = np.abs(got.reshape(shape).astype(int) - want)
    assert error.max() <= (1 if len(shape) == 2 else 24) and error.mean() < 2.5
    with pytest.raises(ValueError):
        jpeg.decode(data[: len(data) * 2 // 3])
    with pytest.raises(ValueError):
        jpeg.decode(b"\xff\xd8\xff\xd9")


def test_jpeg_segments_of_a_scanned_slide(spark, tmp_path):
    a = smooth((24, 40, 3))
    streams = []
    plain_tiff(tmp_path / "a.tif", a, 7, lambda raw: streams.append(jpeg_of(spark, np.frombuffer(raw, np.uint8).reshape(-1, 40, 3))[0]) or streams[-1])
    t = tiff.TiffFile(str(tmp_path / "a.tif"))
    for page in t.levels[0]:
        page["photometric"] = 6
    got = np.concatenate([t.segment(0, i)[1] for i in range(t.segments(0))])
    assert pm_ssim(got[..., 0], a[..., 0]) > 0.95
    # tables that all segments share stand in a tag of their own
    cut = streams[0].index(b"\xff\xc0")
    tables, rest = streams[0][:cut] + b"\xff\xd9", b"\xff\xd8" + streams[0][cut:]
    split = [rest.index(b"\xff\xc4"), rest.index(b"\xff\xda")]
    huffman, bare = rest[split[0] : split[1]], rest[: split[0]] + rest[split[1] :]
    np.testing.assert_array_equal(jpeg.decode(bare, tables[:-2] + huffman + b"\xff\xd9"), jpeg.decode(streams[0]))
    np.testing.assert_array_equal(tiff.ScannedSlide(str(tmp_path / "a.tif")).segment(0, 0)[1][..., 3], 255)


def test_deep_images_need_their_original_axes(spark, tmp_path):
    write_zarr(str(tmp_path / "a"), image((2, 10, 10)), "ZYX", (1, 10, 10))
    slide = api.ingest(spark, str(tmp_path / "a"), str(tmp_path / "s"), "i", "zarr")
    with pytest.raises(ValueError, match="several coordinates"):
        slide.read_level(0)


def test_api_errors(spark, tmp_path):
    write_zarr(str(tmp_path / "a"), image((10, 10)), "YX", (10, 10))
    with pytest.raises(ValueError, match="compressors"):
        api.ingest(spark, str(tmp_path / "a"), str(tmp_path / "s"), "i", "zarr", compressor={0: "zstd", 1: "zstd"})
    with pytest.raises(NotImplementedError):
        api.export(spark, str(tmp_path / "s"), "i", "x", "svs")
    with pytest.raises(api.MetadataCallbackError):
        api.filtered_metadata("x", lambda t: 1 / 0)
    (tmp_path / "bad").write_bytes(b"nonsense")
    with pytest.raises(ValueError):
        tiff.TiffFile(str(tmp_path / "bad"))


def ome_xml(images=("macro", "label", "main"), notes=("slide barcode", "stain"), ns=True):
    space = ' xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06"' if ns else ""
    body = "".join(f'<Image Name="{n}"><Pixels SizeX="3" PhysicalSizeX="0.5"><Channel Name="a" Color="-16776961"/><Channel SamplesPerPixel="2" EmissionWavelength="488"/></Pixels></Image>' for n in images)
    notes = "".join(f"<CommentAnnotation><Description>{n}</Description></CommentAnnotation>" for n in notes)
    return f"<OME{space}>{body}<StructuredAnnotations>{notes}</StructuredAnnotations></OME>"


@pytest.mark.parametrize("ns", [True, False])
def test_pruning_ome_xml(ns):
    out = ome.prune(ome_xml(ns=ns))
    assert "macro" not in out and "label" not in out and "main" in out and "barcode" not in out and "stain" in out and "ns0" not in out
    assert "StructuredAnnotations" not in ome.prune(ome_xml(notes=("a label",), ns=ns))
    assert ome.prune("<?xml version='1.0'?><OME/>") is None and ome.prune(None) is None
    assert "macro image" in ome.prune(ome_xml(images=("macro image",), ns=ns))


def test_ome_channels():
    got = ome.from_ome_xml(ome_xml(images=("main",)))
    assert [c["name"] for c in got["channels"]] == ["a", "Channel 1", "Channel 2"]
    assert got["channels"][0]["color"] == {"red": 255, "green": 0, "blue": 0, "alpha": 255}
    assert got["channels"][1]["emissionWavelengthUnit"] == "nm" and got["physicalSizeXUnit"] == "µm"
    again = ome.from_ome_xml(ome.to_ome_xml(got, {"X": 3, "Y": 2, "C": 3}, "uint8"))
    assert [c["color"] for c in again["channels"]] == [c["color"] for c in got["channels"]] and again["physicalSizeX"] == 0.5
    assert ome.plain_decimal(1e-7) == "0.0000001"


def test_scanner_and_page_metadata():
    text = "Aperio Image\n46000x32914 |AppMag = 20|MPP = 0.4990|odd|Note = a=b"
    assert ome.aperio(text) == {"AppMag": "20", "MPP": "0.4990", "Note": "a=b"}
    assert ome.from_aperio(text)["physicalSizeX"] == 0.499 and ome.from_aperio(text)["physicalSizeXUnit"] == "µm"
    page = "<PerkinElmer-QPI-ImageDescription><Name>DAPI</Name><Color>0,0,255</Color></PerkinElmer-QPI-ImageDescription>"
    got = ome.from_page_xml([(page, (20000.0, 10000.0), False), (page, None, False)])
    assert len(got["channels"]) == 2 and got["channels"][0]["color"]["blue"] == 255 and got["physicalSizeY"] == 1e-4
    omero = ome.from_omero({"omero": {"channels": [{"label": "x", "color": "FF8000", "window": {"start": 2, "end": 5}}]}})
    assert omero["channels"][0]["min"] == 2 and ome.to_omero(omero)["channels"][0]["color"] == "FF8000"


def test_scanner_settings_as_a_column(spark):
    texts = ["Aperio\nx |AppMag = 20|MPP = 0.5|odd|Note = a=b", "Aperio\r\ny|A=1|B= |A = 2", "one line|A=1", "", "a\n"]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", ome.aperio_column(F.col("t")).alias("m")).collect():
        assert r.m == ome.aperio(r.t)


def test_notes_of_a_png(tmp_path):
    body = png.chunk(b"tEXt", b"Title\0scan") + png.chunk(b"zTXt", b"Note\0\0" + zlib.compress(b"long")) + png.chunk(b"iTXt", b"Name\0\0\0de\0\0" + "é".encode())
    body += png.chunk(b"pHYs", struct.pack(">IIB", 10, 20, 1)) + png.chunk(b"gAMA", struct.pack(">I", 45455))
    (tmp_path / "a.png").write_bytes(png.head(1, 1, 1, 8) + body + png.chunk(b"IDAT", zlib.compress(b"\0\5")) + png.chunk(b"IEND", b""))
    told = png.PngFile(str(tmp_path / "a.png")).describe()["original"]
    assert told == {"bits": 8, "color_type": 0, "Title": "scan", "Note": "long", "Name": "é", "resolution": (10, 20), "gamma": 0.45455}


def test_tags_and_flags_reach_the_store(spark, tmp_path):
    a = image((21, 37, 3))
    plain_tiff(tmp_path / "a.tif", a, 8, zlib.compress)
    assert tiff.TiffFile(str(tmp_path / "a.tif"), extra_tags=(317,)).levels[0][0]["tag_317"] == 1
    slide = api.ingest(spark, str(tmp_path / "a.tif"), str(tmp_path / "s"), "i", "tiff", tile_scale=2)
    tags = json.loads(slide.level_properties(0)["tags"])
    assert (tags["width"], tags["height"], tags["compression"], tags["predictor"]) == (37, 21, 8, 1) and "strips" not in tags
    original = json.loads(store.images(spark, str(tmp_path / "s")).first().original_metadata)
    assert original["flags"] == {"bigtiff": False, "byteorder": "<", "ome": False, "multispectral": False, "rgb": True}


def test_own_writers_and_plugins_can_be_registered(spark, tmp_path, monkeypatch):
    write_zarr(str(tmp_path / "a"), image((10, 10)), "YX", (10, 10))
    api.ingest(spark, str(tmp_path / "a"), str(tmp_path / "s"), "i", "zarr")
    seen = []

    class Point:
        name = "count"

        def load(self):
            return lambda tiles, rows, about, dest, **options: seen.append((tiles.count(), len(rows), dest, options))

    monkeypatch.setattr(api.metadata, "entry_points", lambda group: [Point()] if group == "rasterloom.writers" else [])
    try:
        assert api.load_plugins() == ["count"]
        api.export(spark, str(tmp_path / "s"), "i", "x", "count", effort=3)
        assert seen == [(1, 1, "x", {"effort": 3})]
    finally:
        api.WRITERS.pop("count")


def test_formats_are_pairs(spark, tmp_path, monkeypatch, capsys):
    write_zarr(str(tmp_path / "a"), image((10, 12)), "YX", (10, 12))

    class Pair:
        name = "copied"

        def load(self):
            class Both:
                reader = raster.READERS["zarr"]
                writer = staticmethod(writers.zarr)

            return Both

    monkeypatch.setattr(api.metadata, "entry_points", lambda group: [Pair()] if group == "rasterloom.formats" else [])
    logger = api.get_logger(verbose=True)
    try:
        assert api.load_plugins() == ["copied"]
        api.ingest(spark, str(tmp_path / "a"), str(tmp_path / "s"), "i", "copied")
        api.export(spark, str(tmp_path / "s"), "i", str(tmp_path / "b"), "copied")
        np.testing.assert_array_equal(raster.READERS["copied"](str(tmp_path / "b")).segment(0, 0)[1], image((10, 12)))
        told = capsys.readouterr().out
        assert "level 0 of i: 10x12 cells of uint8" in told and "1 levels of i written to" in told
        api.register_format("readonly", raster.READERS["zarr"])
        with pytest.raises(NotImplementedError):
            api.export(spark, str(tmp_path / "s"), "i", "x", "readonly")
        with pytest.raises(ValueError, match="neither"):
            api.register_format("none")
    finally:
        for name in ("copied", "readonly"):
            raster.READERS.pop(name, None)
            api.WRITERS.pop(name, None)
        for h in list(logger.handlers):
            logger.removeHandler(h)
    assert api.get_logger().level == 30


def test_own_readers_can_be_registered(spark):
    class Ramp:
        def __init__(self, uri):
            self.n = int(uri)

        def describe(self):
            return {"axes": "YX", "levels": [{"level": 0, "shape": (self.n, 4), "dtype": "uint8"}], "image": {"channels": []}, "original": {}}

        def segments(self, level):
            return self.n

        def segment(self, level, i):
            return (i, 0), np.full((1, 4), i, np.uint8)

    raster.register("ramp", Ramp)
    try:
        reader = raster.RasterReader(Ramp, "100", 0)
        rows = [r for p in reader.partitions() for r in reader.read(p)]
        assert len(rows) == 100 and rows[70][1] == [70, 0] and len(reader.partitions()) == 2
    finally:
        del raster.READERS["ramp"]


def test_a_task_of_a_stored_pyramid_runs_one_python_worker(spark, tmp_path, monkeypatch):
    passes = []
    write = store.merge_tiles

    def watched(pieces, *args):
        plan = pieces._jdf.queryExecution().executedPlan().toString()
        passes.append([len(re.findall("InPandas|InArrow", stage)) for stage in plan.split("Exchange")])
        return write(pieces, *args)

    monkeypatch.setattr(store, "merge_tiles", watched)
    a = np.arange(70 * 50, dtype=np.uint8).reshape(70, 50)
    rows = [(y, x, int(a[y, x])) for y in range(70) for x in range(50)]
    image = api.store_cells(spark, spark.createDataFrame(rows, "y int, x int, intensity int"), str(tmp_path), "a", "YX", a.shape, {"intensity": "uint8"}, {"Y": 16, "X": 16})
    api.build_pyramid(spark, str(tmp_path), "a", 0, [2.0, 4.0])
    assert len(passes) == 3 and max(map(max, passes)) == 1
    opened = type(image)(spark, str(tmp_path), "a")
    got = opened.read_level(0).toPandas()
    assert (a[got["y"], got["x"]] == got["intensity"]).all() and len(got) == a.size
    assert [opened.read_level(k).count() for k in (1, 2)] == [35 * 25, 18 * 12]
