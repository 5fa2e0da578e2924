"""Files that many tasks write."""

import importlib.util
import json
import multiprocessing
import os
from pathlib import Path

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from rasterloom import api
from rasterloom.sinks import jpeg
from rasterloom.sinks import tiff as sink
from rasterloom.sinks.shared import SharedFile
from rasterloom.sources import files, raster, store, tiff
from rasterloom.sources import jpeg as source

_spec = importlib.util.spec_from_file_location("files_of_tests", Path(__file__).with_name("test_files.py"))
made = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(made)


def whole(t, level=0):
    out = np.zeros(t.describe()["levels"][level]["shape"], t.dtype(level))
    for i in range(t.segments(level)):
        start, block = t.segment(level, i)
        out[tuple(slice(s, s + n) for s, n in zip(start, block.shape, strict=True))] = block
    return out


def add(file, seed, n):
    rng = np.random.default_rng(seed)
    with file.appender() as out:
        return [(out.part, out.put(data), data) for data in (rng.bytes(int(rng.integers(1, 3000))) for _ in range(n))]


def finished(file, told, tail=b"the end"):
    at = {}

    def end(starts, place):
        at.update(starts)
        return b"HEADHEAD", tail

    file.finish([part for part, _, _ in told], end)
    data = Path(file.dest).read_bytes()
    assert data[:8] == b"HEADHEAD" and data.endswith(tail) and data.index(tail) % 8 == 0
    assert all(data[at[part] + k : at[part] + k + len(d)] == d for part, k, d in told)
    return data


def test_many_processes_add_to_one_file(tmp_path):
    file = SharedFile(str(tmp_path / "new" / "a.bin"), 8)
    with multiprocessing.get_context("fork").Pool(6) as pool:
        told = [x for found in pool.starmap(add, [(file, k, 200) for k in range(6)]) for x in found]
    assert len({k for _, k, _ in told}) == 1200
    finished(file, told)
    assert os.listdir(tmp_path / "new") == ["a.bin"]


def test_parts_are_lined_up_where_a_store_is_no_file_system(tmp_path, monkeypatch):
    monkeypatch.setattr(files, "store_of", lambda uri: (fs.SubTreeFileSystem("/", fs.LocalFileSystem()), uri.lstrip("/")))
    file = SharedFile(str(tmp_path / "a.bin"), 8)
    assert not file.local
    told = [x for k in range(4) for x in add(file, k, 20)]
    assert len({part for part, _, _ in told}) == 4
    add(file, 9, 3)  # an attempt that failed is not named
    finished(file, told)
    assert os.listdir(tmp_path) == ["a.bin"]
    file = SharedFile(str(tmp_path / "b.bin"), 8)
    add(file, 1, 3)
    file.drop()
    file.drop()
    assert os.listdir(tmp_path) == ["a.bin"]


def written(spark, df, path, mode="overwrite", **options):
    spark.dataSource.register(raster.RasterSource)
    df.write.format("raster").options(codec="tiff", **options).mode(mode).save(str(path))


@pytest.mark.parametrize("axes,shape,dtype,compression", [("YX", (100, 70), "uint16", "deflate"), ("CYX", (3, 40, 100), "float32", "none"), ("TZYXC", (2, 2, 50, 33, 3), "uint8", "deflate")])
def test_blocks_are_written_and_read(spark, tmp_path, axes, shape, dtype, compression):
    a = made.image(shape, "uint8").astype(dtype) / (2 if dtype == "float32" else 1)
    a = a.astype(dtype)
    rows = []
    yx = axes.index("Y")
    for where in np.ndindex(*shape[:yx]):
        for y in range(0, shape[yx], 32):
            for x in range(0, shape[yx + 1], 32):
                block = a[where][y : y + 32, x : x + 32]
                rows.append((0, [*where, y, x, *[0] * (block.ndim - 2)], [1] * yx + list(block.shape), dtype, np.ascontiguousarray(block).tobytes()))
    df = spark.createDataFrame(rows, raster.BLOCKS).repartition(5)
    options = {"axes": axes, "levels": json.dumps([{"level": 0, "shape": shape}]), "tile": "32", "compression": compression}
    written(spark, df, tmp_path / "a.tif", **options)
    t = tiff.TiffFile(str(tmp_path / "a.tif"))
    assert t.describe()["axes"] == axes and t.big
    np.testing.assert_array_equal(whole(t), a)
    again = raster.blocks(spark, str(tmp_path / "a.tif"), "tiff", 0)
    written(spark, again, tmp_path / "b.tif", **options)
    np.testing.assert_array_equal(whole(tiff.TiffFile(str(tmp_path / "b.tif"))), a)
    with pytest.raises(Exception, match="a.tif"):
        written(spark, df, tmp_path / "a.tif", "append", **options)
    for some, told in ((df.filter(F.col("start")[yx] > 0), "tiles"), (df.union(df.limit(1)), "twice"), (df.withColumn("start", F.transform("start", lambda v: v + 1)), "no tile of 32"), (df.limit(0), "types")):
        with pytest.raises(Exception, match=told):
            written(spark, some, tmp_path / "c.tif", **options)
    assert sorted(os.listdir(tmp_path)) == ["a.tif", "b.tif"]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    rows = [(0, [y, 0], [16, 16], "uint8", bytes(256 if y else 3)) for y in (0, 16)]
    df = spark.createDataFrame(rows, raster.BLOCKS).repartition(2, F.col("start")[0])
    with pytest.raises(Exception, match="reshape"):
        written(spark, df, tmp_path / "a.tif", axes="YX", levels='[{"level": 0, "shape": [32, 16]}]', tile="16")
    assert os.listdir(tmp_path) == []
    for more, told in (({"axes": "XY"}, "end in YX"), ({"tile": "20"}, "tiles of 20"), ({"compression": "best"}, "best")):
        with pytest.raises(Exception, match=told):
            written(spark, df, tmp_path / "a.tif", **{"axes": "YX", "levels": '[{"level": 0, "shape": [32, 16]}]', **more})


def test_levels_and_tags_come_back(spark, tmp_path):
    a = made.image((100, 90, 3))
    body = made.plain_tiff
    body(tmp_path / "a.tif", a, 8, __import__("zlib").compress)
    slide = api.ingest(spark, str(tmp_path / "a.tif"), str(tmp_path / "s"), "i", "tiff", scale_factors=[2.0], tiles={"Y": 64, "X": 64})
    told = {"x_resolution": 20000.5, "y_resolution": 1 / 3, "unit": 3, "software": "scan 1", "datetime": "2024:01:01 00:00:00", "photometric": 2, "tag_700": [1, 2, 3], "tag_33550": [0.5, 0.25], "tag_42112": "<x/>", "tag_50000": -4}
    rows = [r | {"properties": r["properties"] | ({"tags": json.dumps(told)} if r["level"] == 0 else {})} for r in slide._levels]
    found = store.tiles(spark, str(tmp_path / "s"))
    sink.tiff(found, rows, {}, str(tmp_path / "b.tif"), tile=32)
    t = tiff.TiffFile(str(tmp_path / "b.tif"), extra_tags=(700, 33550, 42112, 50000))
    np.testing.assert_array_equal(whole(t), a)
    assert [level["shape"] for level in t.describe()["levels"]] == [(100, 90, 3), (50, 45, 3)]
    page = t.levels[0][0]
    assert {k: page[k] for k in ("unit", "software", "datetime", "tag_700", "tag_33550", "tag_42112", "tag_50000")} == {"unit": 3, "software": "scan 1", "datetime": "2024:01:01 00:00:00", "tag_700": (1, 2, 3), "tag_33550": (0.5, 0.25), "tag_42112": "<x/>", "tag_50000": -4}
    assert page["x_resolution"] == 20000.5 and abs(page["y_resolution"] - 1 / 3) < 1e-12


def test_white_is_zero_stays_so(spark, tmp_path):
    a = made.image((20, 20))
    made.write_zarr(str(tmp_path / "a"), a, "YX", (20, 20))
    slide = api.ingest(spark, str(tmp_path / "a"), str(tmp_path / "s"), "i", "zarr")
    rows = [r | {"properties": {"tags": '{"photometric": 0}'}} for r in slide._levels]
    sink.tiff(store.tiles(spark, str(tmp_path / "s")), rows, {}, str(tmp_path / "b.tif"))
    assert tiff.TiffFile(str(tmp_path / "b.tif")).levels[0][0]["photometric"] == 0


# ---- JPEG


def picture(shape, noise=0, seed=1):
    a = made.smooth(shape).astype(int)
    return np.clip(a + np.random.default_rng(seed).integers(-noise, noise + 1, a.shape), 0, 255).astype(np.uint8)


@pytest.mark.parametrize("shape", [(64, 48, 3), (16, 16, 1), (33, 21, 3), (8, 8, 1)])
@pytest.mark.parametrize("quality,noise", [(100, 0), (95, 30), (50, 5), (10, 120), (1, 0)])
def test_jpeg_streams_are_read_by_both_decoders(spark, shape, quality, noise):
    a = picture(shape, noise) if shape[2] == 3 else picture(shape[:2], noise)[..., None]
    tables = jpeg.tables(quality, shape[2])
    data = jpeg.encode(a, quality)
    got = source.decode(data, tables)
    jvm = spark.sparkContext._jvm
    marked = b"\xff\xd8" + (b"\xff\xe0\x00\x10JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00") + tables[2:-2] + data[2:]
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(marked)).getData()
    none = spark.sparkContext._gateway.new_array(jvm.int, a.size)
    other = np.array(list(back.getPixels(0, 0, shape[1], shape[0], none))).reshape(a.shape)
    assert np.abs(got.astype(int) - other).max() <= 3
    error = np.abs(got.astype(int) - a).mean()
    assert error < {100: 1.5, 95: 6, 50: 6, 10: 60, 1: 40}[quality]


def test_codes_are_prefix_free_and_complete():
    for kind, many in ((0, 12), (1, 162)):
        table, code, length = jpeg.codes(kind)
        used = [(format(code[s], f"0{length[s]}b")) for s in range(256) if length[s]]
        assert len(used) == many == sum(table[:16]) and max(map(len, used)) <= 16
        assert not any(a != b and b.startswith(a) for a in used for b in used) and not any(set(u) == {"1"} for u in used)


def test_long_runs_and_large_values():
    a = np.zeros((8, 8))
    a[7, 7] = 1
    spots = np.clip(128 + 127 * np.sign(source.COSINES.T @ a @ source.COSINES), 0, 255).astype(np.uint8)[..., None]
    checks = np.where(np.indices((16, 16)).sum(0) % 2, 255, 0).astype(np.uint8)[..., None]
    for block in (spots, checks, np.zeros((8, 8, 1), np.uint8), np.full((8, 16, 1), 255, np.uint8)):
        got = source.decode(jpeg.encode(block, 100), jpeg.tables(100, 1))
        assert np.abs(got.astype(int) - block).max() <= 2
    with pytest.raises(ValueError, match="8-bit"):
        jpeg.encode(np.zeros((8, 8, 4), np.uint8), 90)
    with pytest.raises(ValueError, match="quality"):
        jpeg.tables(0, 1)


@pytest.mark.parametrize("shape,axes", [((300, 270, 3), "YXC"), ((2, 100, 90), "ZYX")])
def test_lossy_export(spark, tmp_path, shape, axes):
    a = picture(shape, 8) if axes == "YXC" else np.stack([picture(shape[1:], 8, k) for k in range(2)])
    made.write_zarr(str(tmp_path / "a"), a, axes, (128, 128, 3) if axes == "YXC" else (1, 64, 64))
    api.ingest(spark, str(tmp_path / "a"), str(tmp_path / "s"), "i", "zarr", tiles={"Y": 64, "X": 64})
    for codec in ("jpeg", "deflate"):
        api.export(spark, str(tmp_path / "s"), "i", str(tmp_path / f"{codec}.tif"), "tiff", compression=codec, tile=128, **({"quality": 85} if codec == "jpeg" else {}))
    t = tiff.TiffFile(str(tmp_path / "jpeg.tif"))
    got = whole(t)
    assert t.describe()["axes"] == axes and t.levels[0][0]["compression"] == 7
    for k in np.ndindex(*([3] if axes == "YXC" else [2])):
        one, two = (got[..., k[0]], a[..., k[0]]) if axes == "YXC" else (got[k], a[k])
        assert made.pm_ssim(one, two) >= 0.87
    assert os.path.getsize(tmp_path / "jpeg.tif") < os.path.getsize(tmp_path / "deflate.tif") / 2
    again = api.ingest(spark, str(tmp_path / "jpeg.tif"), str(tmp_path / "s"), "back", "tiff")
    assert again.dimensions == (shape[axes.index("X")], shape[axes.index("Y")])
