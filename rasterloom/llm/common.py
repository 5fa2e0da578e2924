"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

_ROW_BITS = 33
#: Repeats of a row that are numbered in one array.
_REPEATS = 1000
#: Folders that pin() wrote in this thread and nothing deleted yet; a build within settled() has a list of its own.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the cluster names none, a local session gets a folder of its own; any other session is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    made().append(path)
    return path


def made() -> list[str]:
    if (held := _made.get()) is None:
        _made.set(held := [])
    return held


def pin(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete what was pinned in this thread; for a caller that has written its results."""
    held = made()
    for path in held:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    held.clear()


def settled(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """Pin what build() gives and delete what build() itself pinned on the way; builds of other threads are left alone."""
    before = _made.set([])
    try:
        df = build()
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        clear(spark)
    finally:
        left = made()
        _made.reset(before)
        made().extend(left)
    made().append(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, *needed: Column) -> DataFrame:
    """All columns in one struct `__in`, beside the needed ones: no column of the input can clash with an operator's own."""
    return df.select(F.struct("*").alias("__in"), *needed)


def unpacked(df: DataFrame, *own: str) -> list[Column]:
    """The columns held in `__in`, but those that bear a name of own, in any case."""
    taken = {c.lower() for c in own}
    return [F.col("__in").getField(c).alias(c) for c in df.schema["__in"].dataType.names if c.lower() not in taken]


def _exact(value: Column, kind: DataType) -> list[Column]:
    """What tells values apart for xxhash64, which passes over nulls, also within arrays and structs, and over where an array ends."""
    if isinstance(kind, StructType):
        return [value.isNull(), *[c for f in kind for c in _exact(value.getField(f.name), f.dataType)]]
    if isinstance(kind, ArrayType) and not isinstance(kind.elementType, (ArrayType, MapType, StructType)):
        return [value.isNull(), F.size(value), F.transform(value, lambda x: x.isNull()), value]
    if isinstance(kind, (ArrayType, MapType)):
        micros = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
        value = F.to_json(F.struct(value), {"timestampFormat": f"{micros}XXX", "timestampNTZFormat": micros})
    return [value.isNull(), value]


def row_key(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a whole row, as columns h1 and h2; only equal rows share both."""
    each = [c for f in df.schema for c in _exact(F.col(f.name), f.dataType)]
    return [F.xxhash64(F.lit(k), *each).alias(f"h{k}") for k in (1, 2)]


def unique_rows(df: DataFrame) -> DataFrame:
    """h1, h2 and the packed row, equal rows once; they meet map-side first."""
    return packed(df, *row_key(df)).dropDuplicates(["h1", "h2"])


def repeated(df: DataFrame, n: str, name: str) -> DataFrame:
    """Each row n times, numbered from 0; what one row makes beyond some thousand is spread over tasks."""
    few = df.filter(F.col(n) <= _REPEATS).withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))
    many = df.filter(F.col(n) > _REPEATS).withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({n} - 1) div {_REPEATS}"))))
    many = many.repartition("__part").withColumn(name, F.explode(F.sequence(F.col("__part") * _REPEATS, F.least(n, (F.col("__part") + 1) * _REPEATS) - 1)))
    return few.unionByName(many.drop("__part")).drop(n)


def number_rows(spark: SparkSession, df: DataFrame, keys: list[Column], name: str = "row_no") -> tuple[DataFrame, int]:
    """Number rows 0..n-1 in the order of keys, without gathering them in one task; returns (rows, n).

    Rows are range-partitioned and written once, so partition numbers hold on reruns; only one count a
    partition is summed up. Rows equal in all keys may get each other's numbers; a salt splits runs of them
    over partitions, so one very frequent key fills no single task.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f"__k{i}" for i in range(len(keys))]
    keyed = packed(df, *[k.alias(n) for k, n in zip(keys, names, strict=True)], F.monotonically_increasing_id().alias("__salt"))
    order = [*names, "__salt"]
    placed = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop(*order)
    placed = placed.select("__in", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("__at"))
    placed = pin(spark, placed, "numbered")
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    # starts has one row a shuffle partition, whatever the input
    rows = placed.join(F.broadcast(starts), "__part")
    return rows.select(*unpacked(rows), (F.col("__start") + F.col("__at")).alias(name)), placed.count()


def running_sums(spark: SparkSession, df: DataFrame, group: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """df, which has its own names for group and order, with sums over the rows before each row in its group.

    Rows are range-partitioned by group and order and written once. Sums run within each partition and group, and
    each group's sums by partition are added up, one row a partition. So a group that holds a third of all rows is
    spread over tasks. Rows equal in group and order stay together; let order tell apart what may occur very often.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, group, *order).withColumn("__part", F.spark_partition_id())
    placed = pin(spark, placed.select("*", *[v.cast("long").alias(f"__{k}") for k, v in sums.items()]), "placed")
    before = Window.partitionBy("__part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.select("*", *[F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__in_{k}") for k in sums])
    over = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("__part", group).agg(*[F.sum(f"__{k}").alias(f"__{k}") for k in sums])
    starts = starts.select("__part", group, *[F.coalesce(F.sum(f"__{k}").over(over), F.lit(0)).alias(f"__from_{k}") for k in sums])
    out = inside.join(starts, ["__part", group])
    return out.select(*df.columns, *[(F.col(f"__from_{k}") + F.col(f"__in_{k}")).alias(k) for k in sums])


def sampled(docs: DataFrame, bound: int, by: Column | None = None) -> DataFrame:
    """Of rows (doc_id, text), by group, the `bound` ones of the lowest hashes of doc_id, text and the number of the repeat.

    Equal rows are counted before they are numbered, so neither a frequent doc_id nor a frequent row gathers in a
    task. The chosen keys are broadcast: bound rows a group, of which the caller keeps the number bounded.
    Returns (doc_id, text, by).
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), (F.lit(0) if by is None else by).alias("by"))
    totals = keyed.groupBy("by").agg(F.count(F.lit(1)).alias("total"))
    counted = keyed.groupBy("by", "doc_id", "h").agg(F.count(F.lit(1)).alias("n"))
    each = repeated(counted, "n", "nth").withColumn("spot", F.pmod(F.xxhash64("doc_id", "h", "nth", F.lit(29)), F.lit(1 << 62)))
    # so many more than bound that fewer are left once in a thousand million times
    share = F.least(F.lit(1.0), F.lit(bound + 6 * bound**0.5) / F.col("total"))
    below = each.join(F.broadcast(totals), "by").filter(F.col("spot") <= share * float(1 << 62))
    rank = F.row_number().over(Window.partitionBy("by").orderBy("spot", "doc_id", "h", "nth"))
    taken = below.withColumn("rank", rank).filter(F.col("rank") <= bound).groupBy("by", "doc_id", "h").agg(F.count(F.lit(1)).alias("copies"))
    taken = F.broadcast(taken.withColumnsRenamed({"doc_id": "taken_id", "h": "taken_h", "by": "taken_by"}))
    same = F.col("doc_id").eqNullSafe(F.col("taken_id")) & (F.col("h") == F.col("taken_h")) & (F.col("by") == F.col("taken_by"))
    found = keyed.join(taken, same).groupBy("by", "doc_id", "h").agg(F.first("text").alias("text"), F.first("copies").alias("copies"))
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc_id", "text", "by")
