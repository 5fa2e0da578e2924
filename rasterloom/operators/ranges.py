"""Merging of closed integer ranges, and coverage checks built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _merged(ranges: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col(start) > before + 1), 1).otherwise(0)
    island = F.sum("__opens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = ranges.withColumn("__opens", opens).withColumn("__island", island)
    return marked.groupBy(*by, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def merge_ranges(ranges: DataFrame, *by: str, start: str = "s", end: str = "e") -> DataFrame:
    """Ranges that overlap or follow each other become one, per group.

    Of ranges with one start only the longest counts, found map-side first. They are merged within stretches of starts,
    so a group that holds most ranges is spread over tasks; what the stretches leave, mostly few, is merged by group.
    """
    parts = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    longest = ranges.groupBy(*by, start).agg(F.max(end).alias(end))
    placed = longest.repartitionByRange(parts, *by, start).withColumn("__part", F.spark_partition_id())
    return _merged(_merged(placed, [*by, "__part"], start, end).drop("__part"), list(by), start, end)


def covers(ranges: DataFrame, domain: DataFrame, *by: str) -> DataFrame:
    """Per axis of domain (lo, hi): whether its ranges merge to just that domain; an axis without ranges is not covered."""
    merged = merge_ranges(ranges, *by).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("s"), F.max("e").alias("e"))
    out = domain.join(merged, list(by), "left")
    whole = (F.col("n") == 1) & (F.col("s") == F.col("lo")) & (F.col("e") == F.col("hi"))
    return out.select(*by, F.coalesce(whole, F.lit(False)).alias("covered"))


def tiles_complete(tiles: DataFrame, expected: DataFrame, *by: str) -> DataFrame:
    """Whether as many different tiles are there as expected; finds holes that the check by axis misses."""
    index = [c for c in tiles.columns if c not in by]
    found = tiles.groupBy(*by).agg(F.count_distinct(*[F.col(c) for c in index]).alias("found"))
    out = expected.join(found, list(by), "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return out.select(*by, "expected", "found", (F.col("expected") == F.col("found")).alias("complete"))


def complete_lines(tiles: DataFrame, keys: list[str], along: list[str], expected: int) -> DataFrame:
    """The lines of a tile grid (one coordinate of each key) of which all tiles along the other axes are there; repeats count once."""
    lines = tiles.select(*keys, *along).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return lines.filter(F.col("n") == expected).drop("n")


def first_complete(tiles: DataFrame, group: str, keys: list[str], along: list[str], expected: int) -> DataFrame:
    """Of each group with a complete line: its first one, as columns of the keys, and how many there are."""
    lines = complete_lines(tiles, [group, *keys], along, expected)
    return lines.groupBy(group).agg(F.min(F.struct(*keys)).alias("first"), F.count(F.lit(1)).alias("lines")).select(group, "first.*", "lines")
