"""Channel statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def minmax(cells: DataFrame, *by: str) -> DataFrame:
    """Least and largest intensity by the given columns; Spark reduces within tasks before it shuffles."""
    return cells.groupBy(*by).agg(F.min("intensity").alias("min"), F.max("intensity").alias("max"))


def merge_minmax(partial: DataFrame, *by: str) -> DataFrame:
    return partial.groupBy(*by).agg(F.min("min").alias("min"), F.max("max").alias("max"))


def attach(channels: DataFrame, stats: DataFrame, on: str = "c") -> DataFrame:
    """Channel records with statistics; a range that the source gave wins."""
    measured = stats.select(on, F.col("min").alias("__min"), F.col("max").alias("__max"))
    out = channels.join(measured, on, "left")
    return out.withColumn("min", F.coalesce("min", "__min")).withColumn("max", F.coalesce("max", "__max")).drop("__min", "__max")
