"""Connected components of links, as DataFrame steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import pin

_MAX_STEPS = 60


def _hung_on_least(edges: DataFrame, own: bool) -> DataFrame:
    """Tie each node's neighbours (and the node itself, if own) to the least of them.

    The least neighbour is an aggregate that is joined back, so a node with very many links needs no task of its own.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    if own:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of the undirected edges; component: its smallest node.

    Alternates large-star and small-star steps; each round is written to the shared folder, and the loop ends when
    a round changes no edge. Nodes without a link are not listed.
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    now = pin(spark, now, "links")
    seen = None
    for _ in range(_MAX_STEPS):
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(state) == seen or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        seen = tuple(state)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = _hung_on_least(large.distinct(), own=True)
        now = pin(spark, small.distinct(), "links")
    raise RuntimeError("components did not settle")


def forest(left_ids: np.ndarray, right_ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Links that tie the same nodes together as the pairs (left[i], right[j]) do, at most one a node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = up = parent[up]
            x = up
        return x

    for x, y in zip(left_ids[i].tolist(), right_ids[j].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(x, r) for x in parent if (r := root(x)) != x]
