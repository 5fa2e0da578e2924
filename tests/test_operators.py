import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rasterloom.functions import axes, colors, dtypes, paths
from rasterloom.operators import cells, grid, pyramid, ranges, slide, stats


def test_tile_grid_is_row_major_and_clipped(spark):
    shape, tile = (3, 7, 15, 10), (3, 4, 5, 3)
    rows = grid.tile_grid(spark, list("czyx"), shape, tile).orderBy("tile_no").collect()
    want = list(grid.iter_tiles(shape, tile))
    assert len(rows) == 24 == len(want)
    got = [tuple(slice(r[f"{d}_start"], r[f"{d}_stop"]) for d in "czyx") for r in rows]
    assert got == want and [r["tile_no"] for r in rows] == list(range(24))
    assert spark.range(1).select(grid.num_tiles(F.array(*map(F.lit, shape)), F.array(*map(F.lit, tile)))).first()[0] == 24
    assert grid.extents("CYX", (3, 2000, 50)) == (3, 1024, 50)


def test_regions_meet_the_tiles_that_hold_their_cells(spark):
    regions = spark.createDataFrame([(1, 0, 1, 0, 1), (2, 9, 31, 5, 10), (3, 10, 20, 10, 20)], "roi int, y_lo int, y_hi int, x_lo int, x_hi int")
    got = {(r.roi, r.ty, r.tx) for r in grid.covered_tiles(regions, {"y": 10, "x": 5}).collect()}
    want = {(r.roi, y // 10, x // 5) for r in regions.collect() for y in range(r.y_lo, r.y_hi) for x in range(r.x_lo, r.x_hi)}
    assert got == want


def brute_merge(pairs):
    covered = sorted({x for s, e in pairs for x in range(s, e + 1)})
    out = []
    for x in covered:
        if out and out[-1][1] == x - 1:
            out[-1][1] = x
        else:
            out.append([x, x])
    return [tuple(p) for p in out]


def test_merge_ranges_against_covered_points(spark):
    rng = random.Random(3)
    data = [(k, s, s + rng.randrange(12)) for k in range(6) for s in (rng.randrange(200) for _ in range(25))]
    got = ranges.merge_ranges(spark.createDataFrame(data, "axis int, s int, e int"), "axis").collect()
    for k in range(6):
        assert sorted((r.s, r.e) for r in got if r.axis == k) == brute_merge([(s, e) for a, s, e in data if a == k])
    assert ranges.merge_ranges(spark.createDataFrame([], "axis int, s int, e int"), "axis").count() == 0


def test_coverage_by_axis_misses_holes_that_the_tile_count_finds(spark):
    tiles = spark.createDataFrame([("a", 0, 0), ("a", 1, 1)], "image string, ty int, tx int")
    pieces = tiles.select(F.inline(F.array(F.struct(F.lit("y").alias("axis"), (F.col("ty") * 5).alias("s"), (F.col("ty") * 5 + 4).alias("e")),
                                           F.struct(F.lit("x").alias("axis"), (F.col("tx") * 5).alias("s"), (F.col("tx") * 5 + 4).alias("e")))))
    domain = spark.createDataFrame([("y", 0, 9), ("x", 0, 9), ("z", 0, 0)], "axis string, lo int, hi int")
    assert {r.axis: r.covered for r in ranges.covers(pieces, domain, "axis").collect()} == {"y": True, "x": True, "z": False}
    expected = spark.createDataFrame([("a", 4)], "image string, expected long")
    assert [(r.found, r.complete) for r in ranges.tiles_complete(tiles, expected, "image").collect()] == [(2, False)]


def test_colors_pack_back_and_depths(spark):
    rng = random.Random(1)
    values = [0, -1, 1, 2**31 - 1, -(2**31), *(rng.randrange(-(2**31), 2**31) for _ in range(50))]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", colors.rgba_unpack(F.col("v")).alias("c"))
    back = df.select("v", colors.rgba_pack(F.col("c.red"), F.col("c.green"), F.col("c.blue"), F.col("c.alpha")).alias("b"))
    assert all(r.v == r.b for r in back.collect())
    five = spark.range(5).select(colors.default_color(F.col("id"), F.lit(5)).alias("c")).collect()
    assert len({tuple(r.c) for r in five}) == 5
    with pytest.raises(PySparkException):
        spark.range(1).select(colors.pixel_depth(F.lit("CMYK"))).collect()


def test_paths_and_types(spark):
    rows = spark.createDataFrame([("s3://a",), ("gs://a",), ("file:///a",), ("C:\\a",), ("/a",), (None,)], "u string")
    got = rows.select(paths.is_remote(F.col("u")), paths.scheme(F.col("u"))).collect()
    assert [tuple(r) for r in got] == [(True, "s3"), (False, "gs"), (False, "file"), (False, ""), (False, ""), (False, None)]
    assert paths.hadoop_options({"key": "k", "other": "x"}) == {"spark.hadoop.fs.s3a.access.key": "k"}
    assert dtypes.spark_type("uint16") == "int"
    with pytest.raises(ValueError):
        dtypes.spark_type("complex64")


def test_squeeze_fails_on_larger_dimensions(spark):
    rows = spark.createDataFrame([(0, 1, 2, 7), (1, 1, 2, 8)], "z int, y int, x int, intensity int")
    with pytest.raises(PySparkException):
        axes.squeeze(rows, "z").collect()


def test_levels_below_a_downsample(spark):
    rows = spark.createDataFrame([("a", i, w, w) for i, w in enumerate((1000, 500, 250))], "image_id string, level int, width long, height long")
    factors = spark.createDataFrame([("a", f) for f in (0.5, 1.0, 1.5, 2.0, 2.1, 4.0, 99.0)], "image_id string, factor double")
    got = {r.factor: r.position for r in slide.best_levels(slide.downsamples(rows), factors).collect()}
    assert got == {0.5: 0, 1.0: 0, 1.5: 0, 2.0: 0, 2.1: 1, 4.0: 1, 99.0: 2}


def test_attach_keeps_given_ranges(spark):
    channels = spark.createDataFrame([(0, None, None), (1, 5, 6), (2, None, None)], "c int, min int, max int")
    found = stats.minmax(spark.createDataFrame([(0, 3), (0, 9), (1, 1)], "c int, intensity int"), "c")
    assert sorted(tuple(r) for r in stats.attach(channels, found).collect()) == [(0, 3, 9), (1, 5, 6), (2, None, None)]


def test_region_filter_reaches_the_scan(spark, tmp_path):
    spark.range(1000).selectExpr("cast(id % 100 as int) y", "cast(id div 100 as int) x", "1 intensity").write.parquet(str(tmp_path / "c"))
    plan = cells.read_region(spark.read.parquet(str(tmp_path / "c")), (2, 10), (3, 5))._jdf.queryExecution().toString()
    assert all(x in plan for x in ("GreaterThanOrEqual(y,10)", "LessThan(y,15)", "GreaterThanOrEqual(x,2)"))


def smooth_image(h, w, seed=0):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    return (127 + 60 * np.sin(y / 17) + 50 * np.cos(x / 23) + rng.normal(0, 3, (h, w))).clip(0, 255).astype(np.uint8)


def whole_resample(a, factor):
    nh, nw = pyramid.level_shapes(a.shape, "YX", [factor])[0]
    ly, wy = pyramid.kernel(0, nh, a.shape[0] / nh, a.shape[0])
    lx, wx = pyramid.kernel(0, nw, a.shape[1] / nw, a.shape[1])
    return np.clip(np.rint(wy @ a[ly : ly + wy.shape[1], lx : lx + wx.shape[1]] @ wx.T), 0, 255).astype(np.uint8)


@pytest.mark.parametrize("factor", [2.0, 4.0, 2.5])
def test_tiled_resampling_equals_that_of_the_whole_image(spark, factor):
    a = smooth_image(150, 190)
    tiles = [(y // 40, x // 40, y, x, *a[y : y + 40, x : x + 40].shape, "uint8", a[y : y + 40, x : x + 40].tobytes()) for y in range(0, 150, 40) for x in range(0, 190, 40)]
    out = pyramid.resample(spark.createDataFrame(tiles, pyramid.TILE_SCHEMA), a.shape, factor, 32)
    want = whole_resample(a, factor)
    got = np.zeros_like(want)
    for t in out.collect():
        got[t.y0 : t.y0 + t.height, t.x0 : t.x0 + t.width] = np.frombuffer(t.data, np.uint8).reshape(t.height, t.width)
    np.testing.assert_array_equal(got, want)
    assert pyramid.ssim(got, want) > 0.999


def test_progressive_pyramid_is_similar():
    a = smooth_image(320, 320)
    assert pyramid.ssim(whole_resample(whole_resample(a, 2.0), 2.0), whole_resample(a, 4.0)) > 0.95


def test_scaled_sizes_round_half_to_even():
    assert pyramid.level_shapes((3, 5, 7), "CYX", [2.0, 100.0]) == [(3, 2, 4), (3, 1, 1)]
