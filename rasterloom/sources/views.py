"""Rasters made from the relational tables: cells with columns t, c, z, y, x (those that the raster has) and intensity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Channels of the event raster, in order.
EVENTS = ("click", "error", "purchase", "signup", "view")
WIDTH = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quantised(value: Column) -> Column:
    return F.floor((value.cast("double") + 1) * 127.5).cast("int")


def emb_yx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of pixels an embedding; a filter on y reaches the scan, as y is the vector's id."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("x", "v"))
    return rows.select("y", "x", quantised(F.col("v")).alias("intensity"))


def emb_cyx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emb_yx(spark, sf_dir).select(F.expr("cast(x div 16 as int)").alias("c"), "y", (F.col("x") % 16).alias("x"), "intensity")


def emb_yxc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emb_yx(spark, sf_dir).select("y", F.expr("cast(x div 4 as int)").alias("x"), (F.col("x") % 4).alias("c"), "intensity")


def ev_tcyx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day, type, user digit and hour, zero where there are none."""
    kind = F.array_position(F.array(*[F.lit(e) for e in EVENTS]), F.col("event_type")) - 1
    keys = [F.day("ts").alias("t"), kind.cast("int").alias("c"), (F.col("user_id") % 10).cast("int").alias("y"), F.hour("ts").alias("x")]
    counts = table(spark, sf_dir, "events").select(*keys).groupBy("t", "c", "y", "x").agg(F.count(F.lit(1)).alias("n"))
    full = spark.range(1).select()
    for name, low, high in (("t", 1, 30), ("c", 0, 4), ("y", 0, 9), ("x", 0, 23)):
        full = full.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias(name))
    return full.join(counts, ["t", "c", "y", "x"], "left").select("t", "c", "y", "x", F.coalesce("n", F.lit(0)).cast("int").alias("intensity"))


def li_cyx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered quantities by return flag and line status, supplier and month."""
    c = (F.instr(F.lit("ANR"), F.col("l_returnflag")) - 1) * 2 + F.when(F.col("l_linestatus") == "F", 0).otherwise(1)
    rows = table(spark, sf_dir, "lineitem").select(c.cast("int").alias("c"), F.col("l_suppkey").cast("int").alias("y"), F.month("l_shipdate").alias("x"), "l_quantity")
    return rows.groupBy("c", "y", "x").agg(F.sum("l_quantity").cast("bigint").alias("intensity"))


def emb_height(spark: SparkSession, sf_dir: str) -> int:
    return int(table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0]) + 1


def emb_levels(spark: SparkSession, sf_dir: str, factors: tuple[float, ...] = (1.0, 2.0, 4.0, 8.0)) -> DataFrame:
    """Levels of a pyramid over the embedding raster: image_id, level, axes, shape, pixel_depth."""
    from rasterloom.operators.pyramid import scaled

    height = table(spark, sf_dir, "embeddings").agg((F.max("vec_id") + 1).alias("h"))
    rows = height.select("h", F.posexplode(F.array(*[F.lit(f) for f in factors])).alias("level", "factor"))
    shape = F.array(F.lit(4).cast("long"), scaled(F.col("h"), F.col("factor")), scaled(F.lit(16), F.col("factor")))
    return rows.select(F.lit("emb").alias("image_id"), "level", F.lit("CYX").alias("axes"), shape.alias("shape"), F.lit(1).alias("pixel_depth"))
