"""All named queries of the raster engine, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom import api
from rasterloom.functions import axes, colors, dtypes, paths, tables
from rasterloom.metadata import ome
from rasterloom.operators import cells, grid, pyramid, ranges, slide, stats
from rasterloom.session import scratch_path
from rasterloom.sources import store, views
from rasterloom.sources.views import table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

EMB = """emb AS (SELECT vec_id::INT AS y, (generate_subscripts(embedding, 1) - 1)::INT AS x,
    floor((unnest(embedding)::DOUBLE + 1) * 127.5)::INT AS intensity FROM embeddings)"""
CYX = EMB + ", cyx AS (SELECT (x // 16)::INT AS c, y, (x % 16)::INT AS x, intensity FROM emb)"
YXC = EMB + ", yxc AS (SELECT y, (x // 4)::INT AS x, (x % 4)::INT AS c, intensity FROM emb)"
LEVELS = """h AS (SELECT max(vec_id) + 1 AS h FROM embeddings), f AS (SELECT * FROM (VALUES (0, 1.0::DOUBLE), (1, 2.0), (2, 4.0), (3, 8.0)) t(level, factor)),
    lv AS (SELECT level, factor, 4::BIGINT AS c, greatest(1, round_even(h / factor, 0))::BIGINT AS y, greatest(1, round_even(16 / factor, 0))::BIGINT AS x FROM h, f)"""
EVENTS = """ev AS (
    SELECT g.t, g.c, g.y, g.x, coalesce(n, 0)::INT AS intensity
    FROM (SELECT t::INT AS t, c::INT AS c, y::INT AS y, x::INT AS x FROM range(1, 31) a(t), range(5) b(c), range(10) d(y), range(24) e(x)) g
    LEFT JOIN (SELECT day(ts)::INT AS t, (list_position(['click','error','purchase','signup','view'], event_type) - 1)::INT AS c, (user_id % 10)::INT AS y,
                      hour(ts)::INT AS x, count(*) AS n FROM events GROUP BY ALL) k USING (t, c, y, x))"""


def query(sql: str):
    def add(f):
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- pixels


@query(f"WITH {EMB} SELECT y, x, intensity FROM emb WHERE y >= 100 AND y < 140 AND x >= 50 AND x < 90")
def read_region(spark, sf_dir):
    return cells.read_region(views.emb_yx(spark, sf_dir), (50, 100), (40, 40))


@query(f"WITH {EMB} SELECT y, x, intensity FROM emb WHERE y >= 480 AND y < 580 AND x >= 48 AND x < 148")
def read_region_clamped(spark, sf_dir):
    return cells.read_region(views.emb_yx(spark, sf_dir), (48, 480), (100, 100))


@query(f"WITH {EMB} SELECT y, x, 0 AS c, intensity FROM emb")
def read_level(spark, sf_dir):
    return cells.read_level(views.emb_yx(spark, sf_dir), axes="YXC")


def _three_levels(spark, sf_dir):
    base = views.emb_yx(spark, sf_dir)
    half, quarter = pyramid.box_mean(base, 2), pyramid.box_mean(base, 4)
    out = base.withColumn("level", F.lit(0))
    for n, level in ((1, half), (2, quarter)):
        out = out.unionByName(level.withColumn("level", F.lit(n)))
    return out


_BOX = "SELECT (y // {f})::INT AS y, (x // {f})::INT AS x, round_even(sum(intensity) / count(*), 0)::INT AS intensity FROM {t} GROUP BY 1, 2"


@query(f"WITH {EMB}, u AS (SELECT 1 AS level, * FROM ({_BOX.format(f=2, t='emb')}) UNION ALL SELECT 2, * FROM ({_BOX.format(f=4, t='emb')})) SELECT * FROM u")
def level_filter_min(spark, sf_dir):
    return cells.levels_from(_three_levels(spark, sf_dir), 1)


@query(f"WITH {CYX} SELECT 0 AS t, c, y, x, intensity FROM cyx WHERE c >= 1 AND c < 3")
def channel_slice(spark, sf_dir):
    return axes.unsqueeze(views.emb_cyx(spark, sf_dir).filter(cells.slice_predicate({"c": (1, 3)})), "t")


@query(f"WITH {EMB} SELECT x AS y, y AS x, intensity FROM emb")
def axes_swap(spark, sf_dir):
    return axes.swap(views.emb_yx(spark, sf_dir), "y", "x")


@query(f"WITH {CYX} SELECT y, x, c, intensity FROM cyx")
def axes_move(spark, sf_dir):
    return axes.move(views.emb_cyx(spark, sf_dir), "c", 2)


@query(f"WITH {EMB} SELECT y, x, intensity FROM emb")
def axes_squeeze(spark, sf_dir):
    return axes.squeeze(views.emb_yx(spark, sf_dir).withColumn("z", F.lit(0)), "z")


@query(f"WITH {EMB} SELECT 0 AS z, y, x, intensity FROM emb")
def axes_unsqueeze(spark, sf_dir):
    return axes.unsqueeze(views.emb_yx(spark, sf_dir), "z")


@query("""
    WITH s AS (SELECT p_partkey, [p_partkey % 2 + 1, p_size % 3 + 1, p_size % 2 + 1, p_partkey % 5 + 1, 64] AS shape FROM part)
    SELECT p_partkey, (CASE WHEN shape[1] > 1 THEN 'T' ELSE '' END) || (CASE WHEN shape[2] > 1 THEN 'C' ELSE '' END)
        || (CASE WHEN shape[3] > 1 THEN 'Z' ELSE '' END) || 'YX' AS axes FROM s
""")
def axes_canonical(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array(F.expr("p_partkey % 2 + 1"), F.expr("p_size % 3 + 1"), F.expr("p_size % 2 + 1"), F.expr("p_partkey % 5 + 1"), F.lit(64)).alias("shape"))
    return rows.select("p_partkey", axes.canonical_axes(F.col("shape")).alias("axes"))


@query(f"WITH {YXC} SELECT y, (x * 4 + c)::INT AS x, intensity FROM yxc")
def fold_yxc_to_yx(spark, sf_dir):
    return axes.fold(views.emb_yxc(spark, sf_dir), 4)


@query(f"WITH {YXC} SELECT y, x, c, intensity FROM yxc")
def unfold_yx_to_yxc(spark, sf_dir):
    return axes.unfold(views.emb_yx(spark, sf_dir), 4)


@query(f"WITH {CYX} SELECT y, x, c, intensity FROM cyx")
def read_original_axes(spark, sf_dir):
    return cells.read_level(views.emb_cyx(spark, sf_dir), axes="YXC")


@query(f"WITH {EVENTS} SELECT t, c, y, x, intensity FROM ev WHERE t >= 5 AND t < 12 AND c = 2 AND y >= 2 AND y < 6")
def read_tcyx_slice(spark, sf_dir):
    return views.ev_tcyx(spark, sf_dir).filter(cells.slice_predicate({"t": (5, 12), "c": (2, 3), "y": (2, 6)}))


# ---- tiles


@query("""
    WITH h AS (SELECT max(vec_id) + 1 AS h FROM embeddings)
    SELECT ((a // 100) * 3 + b // 24)::BIGINT AS tile_no, a::BIGINT AS y_start, least(a + 100, h)::BIGINT AS y_stop, b::BIGINT AS x_start, least(b + 24, 64)::BIGINT AS x_stop
    FROM h, range(0, h, 100) y(a), range(0, 64, 24) x(b)
""")
def tile_grid(spark, sf_dir):
    return grid.tile_grid(spark, ["y", "x"], (views.emb_height(spark, sf_dir), 64), (100, 24))


@query(f"""
    WITH {LEVELS}, ys AS (SELECT *, unnest(range(0, y, 64)) AS y0 FROM lv), xs AS (SELECT *, unnest(range(0, x, 5)) AS x0 FROM ys)
    SELECT level, ((y0 // 64) * ((x + 4) // 5) + x0 // 5)::BIGINT AS tile_no, y0::BIGINT AS y, x0::BIGINT AS x, least(64, y - y0)::BIGINT AS height, least(5, xs.x - x0)::BIGINT AS width
    FROM xs WHERE y0 < 300 AND y0 + 64 > 100""")
def image_tiles(spark, sf_dir):
    """The tiles of each level that the rows from 100 to 299 meet, by a lateral join."""
    tables.register(spark)
    views.emb_levels(spark, sf_dir).createOrReplaceTempView("rasterloom_levels")
    return spark.sql("""
        SELECT l.level, t.tile_no, t.start[1] AS y, t.start[2] AS x, t.extent[1] AS height, t.extent[2] AS width
        FROM rasterloom_levels l, LATERAL image_tiles(l.axes, l.shape, array(4L, 64L, 5L), map('y', array(100L, 300L))) t""")


@query("""
    WITH h AS (SELECT max(vec_id) + 1 AS h FROM embeddings)
    SELECT ((a // 200) * 2 + b // 48)::BIGINT AS tile_no, a::BIGINT AS y_start, least(a + 200, h)::BIGINT AS y_stop, b::BIGINT AS x_start, least(b + 48, 64)::BIGINT AS x_stop
    FROM h, range(0, h, 200) y(a), range(0, 64, 48) x(b)
""")
def tile_grid_scaled(spark, sf_dir):
    return grid.tile_grid(spark, ["y", "x"], (views.emb_height(spark, sf_dir), 64), (100, 24), scale=2)


@query(f"WITH {LEVELS} SELECT level, (ceil(c / 2.0) * ceil(y / 100.0) * ceil(x / 5.0))::BIGINT AS tiles FROM lv")
def num_tiles(spark, sf_dir):
    tile = F.array(F.lit(2), F.lit(100), F.lit(5))
    return views.emb_levels(spark, sf_dir).select("level", grid.num_tiles(F.col("shape"), tile).alias("tiles"))


@query(f"WITH {EMB} SELECT (y // 100)::INT AS ty, (x // 24)::INT AS tx, count(*) AS cells FROM emb GROUP BY 1, 2")
def tile_assign(spark, sf_dir):
    return grid.with_tiles(views.emb_yx(spark, sf_dir), {"y": 100, "x": 24}).groupBy("ty", "tx").agg(F.count(F.lit(1)).alias("cells"))


_ROI = """roi AS (SELECT s_suppkey AS roi, (s_suppkey * 37 % 400)::INT AS y_lo, (s_suppkey * 37 % 400 + 1 + s_suppkey * 11 % 150)::INT AS y_hi,
    (s_suppkey * 13 % 50)::INT AS x_lo, (s_suppkey * 13 % 50 + 1 + s_suppkey * 7 % 30)::INT AS x_hi FROM supplier)"""


def _regions(spark, sf_dir):
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey as roi", "cast(s_suppkey * 37 % 400 as int) as y_lo", "cast(s_suppkey * 37 % 400 + 1 + s_suppkey * 11 % 150 as int) as y_hi",
        "cast(s_suppkey * 13 % 50 as int) as x_lo", "cast(s_suppkey * 13 % 50 + 1 + s_suppkey * 7 % 30 as int) as x_hi",
    )


@query(f"""WITH {EMB}, {_ROI}, t AS (SELECT (y // 100)::INT AS ty, (x // 24)::INT AS tx, count(*) AS cells FROM emb GROUP BY 1, 2)
    SELECT roi, ty, tx, cells FROM roi JOIN t ON ty * 100 < y_hi AND (ty + 1) * 100 > y_lo AND tx * 24 < x_hi AND (tx + 1) * 24 > x_lo""")
def tile_overlap_roi(spark, sf_dir):
    asked = grid.covered_tiles(_regions(spark, sf_dir), {"y": 100, "x": 24})
    return asked.join(tile_assign(spark, sf_dir), ["ty", "tx"]).select("roi", "ty", "tx", "cells")


# ---- aggregates


@query(f"WITH {CYX} SELECT c, min(intensity) AS min, max(intensity) AS max FROM cyx GROUP BY c")
def channel_minmax(spark, sf_dir):
    return stats.minmax(views.emb_cyx(spark, sf_dir), "c")


@query(f"WITH {CYX} SELECT (y // 64)::INT AS ty, c, min(intensity) AS min, max(intensity) AS max FROM cyx GROUP BY 1, 2")
def tile_minmax_partial(spark, sf_dir):
    return stats.minmax(grid.with_tiles(views.emb_cyx(spark, sf_dir), {"y": 64}), "ty", "c")


@query(f"WITH {EVENTS} SELECT c, min(intensity) AS min, max(intensity) AS max FROM ev GROUP BY c")
def minmax_final_merge(spark, sf_dir):
    return stats.merge_minmax(stats.minmax(grid.with_tiles(views.ev_tcyx(spark, sf_dir), {"t": 7}), "tt", "c"), "c")


@query(f"WITH {LEVELS} SELECT level, c * y * x AS cells, CASE WHEN c * y * x <= 255 THEN 'uint8' WHEN c * y * x <= 65535 THEN 'uint16' ELSE 'uint32' END AS dim_dtype FROM lv")
def dim_dtype(spark, sf_dir):
    return views.emb_levels(spark, sf_dir).select("level", dtypes.cells_of(F.col("shape")).alias("cells"), dtypes.dim_dtype(F.col("shape")).alias("dim_dtype"))


@query(f"""WITH {CYX}, m AS (SELECT c, min(intensity) AS lo, max(intensity) AS hi FROM cyx GROUP BY c)
    SELECT c, 'channel ' || c AS name, CASE WHEN c = 0 THEN 0 ELSE lo END::INT AS min, CASE WHEN c = 0 THEN 255 ELSE hi END::INT AS max FROM m""")
def channel_minmax_attach(spark, sf_dir):
    given = F.when(F.col("c") == 0, F.lit(0)), F.when(F.col("c") == 0, F.lit(255))
    channels = spark.range(4).select(F.col("id").cast("int").alias("c")).select("c", F.concat(F.lit("channel "), "c").alias("name"), given[0].alias("min"), given[1].alias("max"))
    return stats.attach(channels, channel_minmax(spark, sf_dir))


@query("""SELECT ((position(l_returnflag IN 'ANR') - 1) * 2 + CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END)::INT AS c, l_suppkey::INT AS y, month(l_shipdate)::INT AS x,
    sum(l_quantity)::BIGINT AS intensity FROM lineitem GROUP BY 1, 2, 3""")
def raster_from_lineitem(spark, sf_dir):
    return views.li_cyx(spark, sf_dir)


# ---- pyramids


@query(f"WITH {LEVELS} SELECT level, y AS height, x AS width FROM lv")
def pyramid_shapes(spark, sf_dir):
    return views.emb_levels(spark, sf_dir).select("level", slide.size_of("Y").alias("height"), slide.size_of("X").alias("width"))


@query("""WITH r AS (SELECT r_regionkey AS i, ((r_regionkey + 1) * (r_regionkey + 2))::DOUBLE AS factor FROM region)
    SELECT i, factor, factor / coalesce(lag(factor) OVER (ORDER BY i), 1.0) AS step FROM r""")
def progressive_factors(spark, sf_dir):
    rows = table(spark, sf_dir, "region").selectExpr("r_regionkey as i", "cast((r_regionkey + 1) * (r_regionkey + 2) as double) as factor")
    return pyramid.progressive_factors(rows)


@query(f"WITH {EMB} {_BOX.format(f=2, t='emb')}")
def downsample_box_2(spark, sf_dir):
    return pyramid.box_mean(views.emb_yx(spark, sf_dir), 2)


@query(f"WITH {EMB} {_BOX.format(f=4, t='emb')}")
def downsample_box_4(spark, sf_dir):
    return pyramid.box_mean(views.emb_yx(spark, sf_dir), 4)


@query(f"WITH {EMB}, half AS ({_BOX.format(f=2, t='emb')}) {_BOX.format(f=2, t='half')}")
def pyramid_progressive(spark, sf_dir):
    return pyramid.box_mean(pyramid.box_mean(views.emb_yx(spark, sf_dir), 2), 2)


@query(f"WITH {EVENTS} SELECT t, c, (y // 2)::INT AS y, (x // 2)::INT AS x, round_even(sum(intensity) / count(*), 0)::INT AS intensity FROM ev GROUP BY 1, 2, 3, 4")
def pyramid_tcyx(spark, sf_dir):
    return pyramid.box_mean(views.ev_tcyx(spark, sf_dir), 2, "t", "c")


@query("""
    WITH h AS (SELECT max(vec_id) + 1 AS h FROM embeddings), o AS (SELECT h, greatest(1, round_even(h / 2.5, 0))::BIGINT AS n FROM h),
    t AS (SELECT a, least(a + 40, n) AS b, h FROM o, range(0, n, 40) r(a))
    SELECT a::BIGINT AS start, b::BIGINT AS stop, floor(a * 2.5::DOUBLE)::BIGINT AS lo, floor(least(b * 2.5::DOUBLE, h))::BIGINT AS hi FROM t
""")
def source_window(spark, sf_dir):
    h = views.emb_height(spark, sf_dir)
    n = pyramid.level_shapes((h,), "Y", [2.5])[0][0]
    tiles = grid.tile_grid(spark, ["y"], (n,), (40,))
    lo, hi = pyramid.source_window(F.col("y_start"), F.col("y_stop"), F.lit(2.5), F.lit(h))
    return tiles.select(F.col("y_start").alias("start"), F.col("y_stop").alias("stop"), lo.alias("lo"), hi.alias("hi"))


#: Weights of source cells by level, dimension and target, straight from the kernel's definition.
_KERNEL = """n AS (SELECT level, f0, d, n, greatest(1, round_even(n / f0, 0))::INT AS m FROM fs, (SELECT 'y' AS d, max(y) + 1 AS n FROM emb UNION ALL SELECT 'x', 64)),
    c AS (SELECT level, d, n, k, n / m::DOUBLE AS f, (k + 0.5) * (n / m::DOUBLE) - 0.5 AS centre FROM n, unnest(range(m)) t(k)),
    o AS (SELECT *, (f - 1) / 2 AS sigma, centre - floor(centre) AS part, unnest(range(-ceil(2 * (f - 1))::INT - 1, ceil(2 * (f - 1))::INT + 3)) AS off FROM c),
    g AS (SELECT level, d, n, k, abs(floor(centre)::INT + off) % greatest(1, 2 * (n - 1)) AS i,
          (1 - part) * exp(-0.5 * (off / sigma) ** 2) + part * exp(-0.5 * ((off - 1) / sigma) ** 2) AS w FROM o),
    k AS (SELECT level, d, k, CASE WHEN i >= n THEN 2 * (n - 1) - i ELSE i END AS i, sum(w) AS w FROM g GROUP BY ALL),
    ws AS (SELECT level, d, k, i, w / sum(w) OVER (PARTITION BY level, d, k) AS w FROM k),
    small AS (SELECT a.level, a.k::INT AS y, b.k::INT AS x, round_even(sum(a.w * b.w * intensity), 0)::INT AS intensity
        FROM emb JOIN ws a ON a.d = 'y' AND a.i = emb.y JOIN ws b ON b.d = 'x' AND b.i = emb.x AND a.level = b.level GROUP BY ALL)"""


@query(f"WITH {EMB}, fs AS (SELECT 1 AS level, 2.0::DOUBLE AS f0), {_KERNEL} SELECT y, x, intensity FROM small")
def bilinear_pyramid(spark, sf_dir):
    """Smoothed linear resampling by 2 on tiles."""
    h = views.emb_height(spark, sf_dir)
    tiles = pyramid.tiles_of(views.emb_yx(spark, sf_dir), (h, 64), 32)
    return pyramid.cells_in(pyramid.resample(tiles, (h, 64), 2.0, 32))


# ---- slide


def _levels(spark, sf_dir):
    return slide.dimensions(views.emb_levels(spark, sf_dir))


@query(f"WITH {LEVELS} SELECT level, x AS width, y AS height FROM lv")
def level_dimensions(spark, sf_dir):
    return _levels(spark, sf_dir).select("level", "width", "height")


_DOWN = "d AS (SELECT level, (first_value(x) OVER (ORDER BY level) / x + first_value(y) OVER (ORDER BY level) / y) / 2 AS downsample FROM lv)"


@query(f"WITH {LEVELS}, {_DOWN} SELECT level, downsample FROM d")
def level_downsamples(spark, sf_dir):
    return slide.downsamples(_levels(spark, sf_dir)).select("level", "downsample")


@query(f"""WITH {LEVELS}, {_DOWN}, q AS (SELECT n_nationkey AS id, 0.5 + n_nationkey / 2.0 AS factor FROM nation)
    SELECT id, factor::DOUBLE AS factor, coalesce((SELECT max(level) FROM d WHERE downsample < factor), 0)::INT AS position FROM q""")
def best_level(spark, sf_dir):
    factors = table(spark, sf_dir, "nation").select(F.lit("emb").alias("image_id"), F.col("n_nationkey").alias("id"), (F.lit(0.5) + F.col("n_nationkey") / 2.0).cast("double").alias("factor"))
    found = slide.best_levels(slide.downsamples(_levels(spark, sf_dir)), factors)
    return factors.join(found, ["image_id", "factor"]).select("id", "factor", "position")


@query(f"WITH {LEVELS} SELECT 'emb' AS image_id, list(level ORDER BY level) AS levels FROM lv")
def levels_sorted(spark, sf_dir):
    return _levels(spark, sf_dir).groupBy("image_id").agg(F.sort_array(F.collect_list("level")).alias("levels"))


@query(f"""WITH {LEVELS}, k AS (SELECT n_nationkey AS level, n_regionkey + 2 AS depth FROM nation WHERE n_nationkey % 2 = 0)
    SELECT level, coalesce(depth, 1)::INT AS depth FROM lv LEFT JOIN k USING (level)""")
def level_pixel_depth(spark, sf_dir):
    """A level's recorded depth, 1 where none is recorded."""
    known = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("level"), (F.col("n_regionkey") + 2).alias("pixel_depth"))
    return slide.with_depths(_levels(spark, sf_dir).drop("pixel_depth"), known).select("level", F.col("pixel_depth").alias("depth"))


@query(f"WITH {LEVELS} SELECT level FROM lv WHERE level NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def levels_to_create(spark, sf_dir):
    """Planned levels that a store does not have yet."""
    have = table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.lit("emb").alias("image_id"), F.col("n_nationkey").alias("level"))
    return slide.missing_levels(_levels(spark, sf_dir), have).select("level")


# ---- intervals

_RANGES = "r AS (SELECT (o_custkey % 20)::INT AS axis, o_orderkey * 7 % 5000 AS s, o_orderkey * 7 % 5000 + o_orderkey % 4 AS e FROM orders)"
_MERGE = """m AS (SELECT *, max(e) OVER (PARTITION BY axis ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {t}),
    i AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY axis ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m),
    g AS (SELECT axis, min(s) AS s, max(e) AS e FROM i GROUP BY axis, k)"""


@query(f"WITH {_RANGES}, {_MERGE.format(t='r')} SELECT axis, s, e FROM g")
def merge_ranges(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("cast(o_custkey % 20 as int) as axis", "o_orderkey * 7 % 5000 as s", "o_orderkey * 7 % 5000 + o_orderkey % 4 as e")
    return ranges.merge_ranges(rows, "axis")


_FRAGMENTS = """b AS (SELECT l_suppkey % 16 AS k, l_partkey % 40 AS p FROM lineitem), r AS (
    SELECT 'Y' AS axis, k * 32 AS s, k * 32 + 31 AS e FROM b UNION SELECT 'X', p * 2, p * 2 FROM b)"""


def _fragments(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey % 16 as k", "l_partkey % 40 as p")
    each = F.array(F.struct((F.col("k") * 32).alias("s"), (F.col("k") * 32 + 31).alias("e")), F.struct((F.col("p") * 2).alias("s"), (F.col("p") * 2).alias("e")))
    spread = rows.select(F.posexplode(each).alias("at", "r"))
    return spread.select(F.when(F.col("at") == 0, "Y").otherwise("X").alias("axis"), "r.s", "r.e")


@query(f"WITH {_FRAGMENTS}, {_MERGE.format(t='r')} SELECT axis, s, e FROM g")
def merge_ned_ranges(spark, sf_dir):
    return ranges.merge_ranges(_fragments(spark, sf_dir).distinct(), "axis")


@query(f"WITH {_FRAGMENTS}, {_MERGE.format(t='r')} SELECT axis, count(*) = 1 AND min(s) = 0 AND max(e) = CASE axis WHEN 'Y' THEN 511 ELSE 78 END AS covered FROM g GROUP BY axis")
def validate_coverage(spark, sf_dir):
    domain = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(0).alias("lo"), F.lit(hi).alias("hi")) for a, hi in (("Y", 511), ("X", 78))])))
    return ranges.covers(_fragments(spark, sf_dir).distinct(), domain, "axis")


@query("""SELECT l_linenumber AS image, 640::BIGINT AS expected, count(DISTINCT (l_suppkey % 16, l_partkey % 40)) AS found,
    count(DISTINCT (l_suppkey % 16, l_partkey % 40)) = 640 AS complete FROM lineitem GROUP BY 1""")
def validate_tiles_exact(spark, sf_dir):
    tiles = table(spark, sf_dir, "lineitem").selectExpr("l_linenumber as image", "l_suppkey % 16 as ty", "l_partkey % 40 as tx")
    expected = tiles.select("image").distinct().withColumn("expected", F.lit(640).cast("long"))
    return ranges.tiles_complete(tiles, expected, "image")


@query("""
    WITH t AS (SELECT DISTINCT l_linenumber AS image, l_suppkey % 16 AS ty, l_partkey % 40 AS tx FROM lineitem WHERE l_partkey % 11 <> l_suppkey % 3),
    r AS (SELECT image, ty FROM t GROUP BY ALL HAVING count(*) = 40)
    SELECT image, min(ty) AS ty, count(*) AS lines FROM r GROUP BY 1""")
def first_complete_row(spark, sf_dir):
    """Of each image, the first row of tiles that is there in full, of a grid with holes."""
    tiles = table(spark, sf_dir, "lineitem").filter("l_partkey % 11 <> l_suppkey % 3").selectExpr("l_linenumber as image", "l_suppkey % 16 as ty", "l_partkey % 40 as tx")
    return ranges.first_complete(tiles, "image", ["ty"], ["tx"], 40)


# ---- scalars


@query("""
    WITH k AS (SELECT p_partkey, 1 + p_size % 5 AS n, unnest(range(1 + p_size % 5)) AS i FROM part)
    SELECT p_partkey, n::INT AS n, i::INT AS i, CASE n WHEN 1 THEN 255 WHEN 3 THEN CASE i WHEN 0 THEN 255 ELSE 0 END ELSE (i + 1) * 73 % 256 END::INT AS red,
           CASE n WHEN 1 THEN 255 WHEN 3 THEN CASE i WHEN 1 THEN 255 ELSE 0 END ELSE (i + 1) * 151 % 256 END::INT AS green,
           CASE n WHEN 1 THEN 255 WHEN 3 THEN CASE i WHEN 2 THEN 255 ELSE 0 END ELSE (i + 1) * 199 % 256 END::INT AS blue, 255 AS alpha FROM k""")
def default_colors(spark, sf_dir):
    """Colours of the channels of one image a part, with one to five channels."""
    images = table(spark, sf_dir, "part").select("p_partkey", F.expr("1 + p_size % 5").cast("int").alias("n"))
    rows = images.select("p_partkey", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return rows.withColumn("color", colors.default_color(F.col("i"), F.col("n"))).select("p_partkey", "n", "i", "color.*")


_VALUES = "v AS (SELECT c_custkey, c_custkey * 2654435761 % 4294967296 AS v FROM customer)"


@query(f"WITH {_VALUES} SELECT c_custkey, ((v >> 24) & 255)::INT AS red, ((v >> 16) & 255)::INT AS green, ((v >> 8) & 255)::INT AS blue, (v & 255)::INT AS alpha FROM v")
def rgba_unpack(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_custkey * 2654435761 % 4294967296 as v")
    return rows.select("c_custkey", colors.rgba_unpack(F.col("v")).alias("c")).select("c_custkey", "c.*")


@query(f"WITH {_VALUES} SELECT c_custkey, CASE WHEN v >= 2147483648 THEN v - 4294967296 ELSE v END AS packed FROM v")
def rgba_pack_signed(spark, sf_dir):
    return rgba_unpack(spark, sf_dir).select("c_custkey", colors.rgba_pack(F.col("red"), F.col("green"), F.col("blue"), F.col("alpha")).alias("packed"))


@query("SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 3 ELSE 4 END AS depth FROM nation")
def pixel_depth(spark, sf_dir):
    layout = F.get(F.array(*[F.lit(x) for x in ("NONE", "RGB", "BGR", "RGBA", "BGRA")]), F.expr("n_nationkey % 5"))
    return table(spark, sf_dir, "nation").select("n_nationkey", colors.pixel_depth(layout).alias("depth"))


@query("""WITH p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'YX' WHEN 1 THEN 'ZYX' ELSE 'TCYX' END AS axes, p_size % 2 * 2 + 1 AS depth FROM part),
    a AS (SELECT p_partkey, unnest(string_split(axes, '')) AS axis, depth FROM p)
    SELECT p_partkey, axis, axis AS source FROM a UNION ALL SELECT p_partkey, axis, 'C' FROM a WHERE axis = 'X' AND depth > 1""")
def axes_translation(spark, sf_dir):
    """Which original axes each stored axis holds: X also C where channels lie side by side."""
    names = F.get(F.array(F.lit("YX"), F.lit("ZYX"), F.lit("TCYX")), F.expr("cast(p_partkey % 3 as int)"))
    held = axes.axes_held(names, F.expr("p_size % 2 * 2 + 1"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(held).alias("axis", "from")).select("p_partkey", "axis", F.explode("from").alias("source"))


_URIS = "u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 's3://b/' WHEN 1 THEN 'gs://b/' WHEN 2 THEN 'C:/' WHEN 3 THEN 'file:///' ELSE '' END || url AS uri FROM pages)"


def _uris(spark, sf_dir):
    start = F.get(F.array(*[F.lit(x) for x in ("s3://b/", "gs://b/", "C:/", "file:///", "")]), F.expr("page_id % 5").cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(start, "url").alias("uri"))


@query(f"WITH {_URIS} SELECT page_id, starts_with(uri, 's3://') OR starts_with(uri, 'gcs://') OR starts_with(uri, 'azure://') AS remote FROM u")
def remote_protocol(spark, sf_dir):
    return _uris(spark, sf_dir).select("page_id", paths.is_remote(F.col("uri")).alias("remote"))


@query(f"""WITH {_URIS}, s AS (SELECT page_id, lower(regexp_extract(uri, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS s FROM u)
    SELECT page_id, CASE WHEN length(s) < 2 THEN '' ELSE s END AS scheme, length(s) < 2 OR s = 'file' AS local FROM s""")
def path_scheme(spark, sf_dir):
    return _uris(spark, sf_dir).select("page_id", paths.scheme(F.col("uri")).alias("scheme"), paths.is_local(F.col("uri")).alias("local"))


_ORDERS = ("YX", "ZYX", "CYX", "TYX", "CZYX", "TCYX", "TZYX", "TCZYX")
_GIVEN = "p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'XYC' WHEN 1 THEN 'YXZ' WHEN 2 THEN 'TXYC' ELSE 'XYTZC' END AS given FROM part)"
_GIVEN_ORDERS = "t AS (SELECT unnest(['YX','ZYX','CYX','TYX','CZYX','TCYX','TZYX','TCZYX']) AS target, unnest(range(8)) AS i)"


def _given(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("XYC", "YXZ", "TXYC", "XYTZC")])
    return table(spark, sf_dir, "part").select("p_partkey", F.get(names, F.expr("cast(p_partkey % 4 as int)")).alias("given"))


@query(f"WITH {_GIVEN}, {_GIVEN_ORDERS} SELECT p_partkey, given, target, levenshtein(given, target)::INT AS distance FROM p, t")
def axes_distance(spark, sf_dir):
    return _given(spark, sf_dir).select("p_partkey", "given", F.inline(axes.distances(F.col("given"), _ORDERS))).select("p_partkey", "given", "target", "distance")


@query(f"""WITH {_GIVEN}, {_GIVEN_ORDERS} SELECT p_partkey, given, arg_min(target, levenshtein(given, target) * 100 + i) AS target, min(levenshtein(given, target))::INT AS distance
    FROM p, t GROUP BY ALL""")
def axes_nearest(spark, sf_dir):
    """The order that is fewest edits away; the first of several."""
    return _given(spark, sf_dir).withColumn("n", axes.nearest(F.col("given"), _ORDERS)).select("p_partkey", "given", "n.target", "n.distance")


@query("SELECT n_nationkey, (((n_nationkey * 658931 % 16777216)::BIGINT) * 256 + 255)::BIGINT AS color FROM nation")
def omero_hex_color(spark, sf_dir):
    text = F.lpad(F.hex(F.expr("cast(n_nationkey as bigint) * 658931 % 16777216")), 6, "0")
    return table(spark, sf_dir, "nation").select("n_nationkey", colors.hex_color(text).alias("color"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT p_partkey, 'm' || p_size AS magnification, p_retailprice AS mpp FROM part")
def aperio_properties(spark, sf_dir):
    """Settings of scanner descriptions, parsed as a map."""
    text = F.concat(F.lit("Scanner v1\n10x10 |AppMag = m"), "p_size", F.lit("|odd|MPP = "), F.col("p_retailprice").cast("string"))
    found = ome.aperio_column(text)
    return table(spark, sf_dir, "part").select("p_partkey", found["AppMag"].alias("magnification"), found["MPP"].cast("double").alias("mpp"))


@query("""SELECT p_partkey, p_size % 3 <> 1 AS kept_image, p_size % 2 = 0 AS kept_comment FROM part""")
def prune_ome_xml(spark, sf_dir):
    """Label images and comments about labels go from OME-XML; what is left is read back with XPath."""
    name = F.get(F.array(F.lit("scan"), F.lit("label"), F.lit("macro image")), F.expr("p_size % 3"))
    note = F.when(F.expr("p_size % 2 = 0"), "stain").otherwise("slide barcode")
    text = F.concat(F.lit('<OME><Image Name="'), name, F.lit('"/><Image Name="main"/><StructuredAnnotations><CommentAnnotation><Description>'), note, F.lit("</Description></CommentAnnotation></StructuredAnnotations></OME>"))
    pruned = table(spark, sf_dir, "part").select("p_partkey", ome.prune_column(text).alias("xml"))
    return pruned.select("p_partkey", (F.size(F.xpath("xml", F.lit("//Image"))) == 2).alias("kept_image"), (F.size(F.xpath("xml", F.lit("//Description"))) == 1).alias("kept_comment"))


# ---- stored images


def _stored(spark, sf_dir, extent: int = 64):
    """The embedding raster saved as tiles of a stored image; returns (store path, image id)."""
    path = scratch_path(spark, "store")
    h = views.emb_height(spark, sf_dir)
    shape, tile = [h, 64], [min(extent, h), min(extent, 64)]
    packed = pyramid.tiles_of(views.emb_yx(spark, sf_dir), (h, 64), extent)
    blocks = packed.select(F.lit("emb").alias("image_id"), F.lit(0).alias("level"), F.array("y0", "x0").alias("start"), F.array("height", "width").alias("extent"), "dtype", "data")
    row = {"image_id": "emb", "level": 0, "axes": "YX", "shape": shape, "dtype": "uint8", "tile": tile, "codec": "zstd", "pixel_depth": 1,
           "original_axes": "YX", "original_shape": shape, "properties": {"level": "0"}}
    store.save_level(spark, path, row, blocks, in_tiles=True)
    image = {"channels": [{"id": "0", "name": "Gray", "color": ome.default_colors(1)[0]}]}
    store.mark(spark, path, {"image_id": "emb", "fmt_version": store.FORMAT_VERSION, "axes": "YX", "channels": ["Gray"], "metadata": store.as_json(image), "original_metadata": "{}", "valid": True})
    return path, "emb"


def _back(spark, sf_dir, codec: str):
    """Export the stored raster, load the file as a new image, and read its cells."""
    path, image = _stored(spark, sf_dir, 256)
    dest = f"{path}/emb.{codec}"
    api.export(spark, path, image, dest, codec)
    again = api.ingest(spark, dest, f"{path}/again", "copy", codec, tiles={"Y": 100, "X": 40})
    return again.read_level(0).select("y", "x", F.col("intensity").cast("int").alias("intensity"))


_SAME = f"WITH {EMB} SELECT y, x, intensity FROM emb"


@query(f"WITH {EMB} SELECT y, x, 0 AS c, intensity::SMALLINT AS intensity FROM emb WHERE y >= 100 AND y < 190 AND x >= 10 AND x < 50")
def store_read_region(spark, sf_dir):
    path, image = _stored(spark, sf_dir, 32)
    return slide.Slide(spark, path, image).read_region((10, 100), 0, (40, 90))


@query(f"""
    WITH {EMB}, r AS (SELECT n_nationkey, n_nationkey * 17 AS y0, n_nationkey * 5 % 60 AS x0 FROM nation)
    SELECT n_nationkey, count(*) AS cells, sum(intensity)::DOUBLE AS total, max(x)::INT AS right FROM r JOIN emb ON y >= y0 AND y < y0 + 40 AND x >= x0 AND x < x0 + 9 GROUP BY 1""")
def stored_image_cells(spark, sf_dir):
    """Sums over regions of a stored image, one a nation, by a lateral join that reads only what each region meets."""
    path, image = _stored(spark, sf_dir, 32)
    tables.register(spark)
    regions = table(spark, sf_dir, "nation").selectExpr("n_nationkey", "n_nationkey * 17 as y0", "n_nationkey * 5 % 60 as x0")
    regions.withColumns({"path": F.lit(path), "image": F.lit(image)}).createOrReplaceTempView("rasterloom_regions")
    return spark.sql("""
        SELECT r.n_nationkey, count(*) AS cells, sum(c.intensity) AS total, max(c.x) AS right
        FROM rasterloom_regions r, LATERAL stored_image_cells(r.path, r.image, 0, map('y', array(r.y0, r.y0 + 40), 'x', array(r.x0, r.x0 + 9))) c
        GROUP BY r.n_nationkey""")


@query(f"WITH {EMB} SELECT y, x, 0 AS c, (intensity * 7 + x)::INT AS mark FROM emb WHERE y >= 30 AND y < 130 AND x >= 20 AND x < 41")
def stored_attribute(spark, sf_dir):
    """One of two attributes of a stored image's cells, in a region."""
    cells_ = views.emb_yx(spark, sf_dir).withColumn("mark", F.col("intensity") * 7 + F.col("x"))
    shape, kinds = (views.emb_height(spark, sf_dir), 64), {"intensity": "uint8", "mark": "int32"}
    opened = api.store_cells(spark, cells_, scratch_path(spark, "store"), "emb", "YX", shape, kinds, {"Y": 64, "X": 32})
    return opened.read_region((20, 30), 0, (21, 100), "mark")


@query(_SAME)
def png_roundtrip(spark, sf_dir):
    return _back(spark, sf_dir, "png")


@query(_SAME)
def tiff_roundtrip(spark, sf_dir):
    return _back(spark, sf_dir, "tiff")


@query(_SAME)
def zarr_roundtrip(spark, sf_dir):
    return _back(spark, sf_dir, "zarr")


@query(f"""WITH {EMB}, fs AS (SELECT 1 AS level, 2.0::DOUBLE AS f0 UNION ALL SELECT 2, 4.0), {_KERNEL}
    SELECT level, y, x, intensity FROM small UNION ALL SELECT 0, y, x, intensity FROM emb""")
def stored_pyramid(spark, sf_dir):
    """A stored image with two generated levels: cells by level."""
    path, image = _stored(spark, sf_dir, 64)
    api.build_pyramid(spark, path, image, 0, [2.0, 4.0])
    opened = slide.Slide(spark, path, image)
    each = [opened.read_level(k).select(F.lit(level).alias("level"), "y", "x", "intensity") for k, level in enumerate(opened.levels)]
    return reduce(DataFrame.unionByName, each)
