"""Operator 2: shards from a Feistel permutation with cycle walking over global row numbers.

Rows are numbered by (doc_id, text hash), so the numbers depend on the rows alone. A keyed Feistel network on
Z_a x Z_b, a*b barely above n, permutes [0, a*b); values of n and more are fed back until they fall below n
(cycle walking), which gives a permutation of [0, n). Position p goes to shard p mod k, slot p div k: shard
sizes in rows differ by one at most (law `rows`), slots are gapless, and both are computable from a row number.

Defined cases: a null text has no bytes and the checksum of empty text; null doc_ids come first; repeated rows
each take a position of their own; an empty table gives an empty result; other columns pass through, and
columns of the input that bear a result's name, in any case, are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import number_rows, table, unpacked

ROUNDS = 8


def domain(n: int) -> tuple[int, int]:
    """The sides a, b of the smallest near-square grid of at least n cells."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def feistel(x: Column, a: int, b: int, seed: int, rounds: int = ROUNDS) -> Column:
    """One pass of the network over [0, a*b); even rounds change the left half, odd rounds the right."""
    right = F.pmod(x, F.lit(b))
    left = ((x - right) / F.lit(b)).cast("long")
    start = F.struct(left.alias("l"), right.alias("r"))

    def turn(acc: Column, i: Column) -> Column:
        into_left = F.pmod(acc.l + F.pmod(F.xxhash64(acc.r, i, F.lit(seed)), F.lit(a)), F.lit(a))
        into_right = F.pmod(acc.r + F.pmod(F.xxhash64(acc.l, i, F.lit(seed)), F.lit(b)), F.lit(b))
        even = (i % 2) == 0
        return F.struct(F.when(even, into_left).otherwise(acc.l).alias("l"), F.when(even, acc.r).otherwise(into_right).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, turn, lambda acc: acc.l * F.lit(b) + acc.r)


def walk(x: Column, n: int, seed: int, steps: int) -> Column:
    """x while it is below n, else its image; steps times. A fold, so the expression does not grow with the steps."""
    a, b = domain(n)
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), x, lambda acc, _: F.when(acc >= n, feistel(acc, a, b, seed)).otherwise(acc))


def walk_length(spark: SparkSession, n: int, seed: int) -> int:
    """A number of steps after which every walk that starts below n has come below n again.

    Only the a*b - n < sqrt(n) + 1 values outside are followed, as a DataFrame. A chain of values outside that leads
    inside is one shorter with each step, so once a step leaves their number as it is, what remains are cycles
    outside, which no walk from inside meets.
    """
    a, b = domain(n)
    steps, outside = 1, spark.range(n, a * b)
    while True:
        left = [F.count_if(walk(F.col("id"), n, seed, k) >= n) for k in (steps, steps + 1)]
        now, then = outside.agg(*[c.alias(f"c{i}") for i, c in enumerate(left)]).first()
        if now == then:
            return steps
        steps *= 2


def permute(df: DataFrame, row_no: str, n: int, seed: int, name: str = "position") -> DataFrame:
    """Add the permuted position of each row number."""
    a, b = domain(n)
    first = df.withColumn(name, feistel(F.col(row_no), a, b, seed))
    return first.withColumn(name, walk(F.col(name), n, seed, walk_length(df.sparkSession, n, seed)))


def shard(df: DataFrame, shards: int = 8, seed: int = 20240501, keep_text: bool = True) -> DataFrame:
    """Deal rows with doc_id and text into shards; adds size, text_crc32, law, shard, slot, grown_shard."""
    spark = df.sparkSession
    text, own = F.coalesce(F.col("text"), F.lit("")), ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    held = F.struct(*[c for c in df.columns if keep_text or c != "text"]).alias("__in")
    sized = df.select(
        held, F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    rows, n = number_rows(spark, sized, [F.col("id"), F.col("hash")], "row")
    placed = permute(rows, "row", n, seed, "position")
    return placed.select(
        *unpacked(placed, *own),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod(F.col("position"), F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"position div {int(shards)}").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(docs, keep_text=False)
