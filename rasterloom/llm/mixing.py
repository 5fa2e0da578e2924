"""Operator 10: time-varying curriculum over sources with target weights.

Each source has a weight and a schedule, the weight's course over training time [0, 1] as a piecewise linear
curve. The targets share the demand by weight; a target stops at `max_repeats` times its source's size, the
excess being reshared among the others. Within a source, documents stand in the order of a hash of doc_id, so
each holds an interval of the source's cumulative words, once per pass over the source. A copy is taken if its
middle lies below the target; its training position is where the integrated schedule has demanded the words up
to its middle. Taken copies are range-sorted by position.

Words are counted once. Cumulative words are running sums over range partitions of (source, hash, doc_id, size, row),
so neither a source nor a doc_id (null or not) that holds most rows fills a task, and the result does not depend on
partitioning. Texts do not take part; where they are wanted, they are joined at the end.

Defined cases: a null text has no words; a null source is a source of its own, last in order; rows with the
same doc_id and size are interchangeable; documents without words are taken once or twice at no cost; an empty
table gives an empty result; other columns pass through, but those that bear a result's name in any case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import pin, repeated, row_key, running_sums, table, unique_rows, unpacked

TOKEN = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Course of each weight at equally spaced times; only its shape counts, the area is set by the weight.
SCHEDULES = ((1.0, 2.0, 3.0), (1.0, 1.0, 1.0), (3.0, 2.0, 1.0))
SHARE = 1.5
MAX_REPEATS = 2


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Per source (key __src, words source_size): its weight class and target.

    Resharing the excess by weight ends at target = min(cap, level * weight). With sources in order of
    cap/weight, the level is that of the first source which can't be filled to its cap; one row a source.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    order = Window.orderBy(F.col("__src").isNull(), "__src")
    ranked = sizes.withColumn("class", ((F.row_number().over(order) - 1) % len(weights)).cast("int"))
    ranked = ranked.withColumn("weight", F.get(cycle, F.col("class"))).withColumn("cap", F.col("source_size") * max_repeats)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("__src").isNull(), "__src")
    before, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    filled = ranked.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0)))
    filled = filled.withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    filled = filled.withColumn("level", (F.sum("source_size").over(whole) * F.lit(share) - F.col("full")) / F.col("open"))
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(whole)["level"]
    target = F.least(F.col("cap").cast("double"), level * F.col("weight"))
    return filled.select("__src", "class", "source_size", F.coalesce(target, F.col("cap").cast("double")).alias("target"))


def demanded_at(share_of_target: Column, klass: Column, schedules: tuple = SCHEDULES) -> Column:
    """The time by which a source's schedule, integrated, has demanded this share of its target."""
    out = None
    for k, knots in enumerate(schedules):
        width = 1.0 / (len(knots) - 1)
        areas = [(p + q) / 2 * width for p, q in zip(knots, knots[1:], strict=False)]
        total, done, at = sum(areas), 0.0, None
        for i, (p, q) in enumerate(zip(knots, knots[1:], strict=False)):
            need = F.greatest(share_of_target * total - done, F.lit(0.0))
            slope = (q - p) / width
            # p*t + slope*t*t/2 = need, in a form that also holds for slope 0
            into = 2 * need / (p + F.sqrt(F.greatest(F.lit(p * p) + 2 * slope * need, F.lit(1e-300))))
            here = F.lit(i * width) + F.least(into, F.lit(width))
            at = here if at is None else F.when(share_of_target * total <= done, at).otherwise(here)
            done += areas[i]
        out = F.when(klass == k, at) if out is None else out.when(klass == k, at)
    return out


def plan(docs: DataFrame, size: Column | None = None, weights: tuple = WEIGHTS, schedules: tuple = SCHEDULES, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """A slim row for each row of docs (doc_id, source, and text if no size is given).

    Returns h1, h2 (the key of the row, common.row_key), doc_id, source, size, source_size, target and positions, one
    for each time the row is taken. Words are counted once, and no text travels.
    """
    spark = docs.sparkSession
    counted = words(F.col("text")) if size is None else size.cast("long")
    slim = pin(spark, docs.select(*row_key(docs), "doc_id", "source", counted.alias("size")), "sizes")
    # equal rows lie next to each other, so one row stands for them until positions are given out
    src = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    groups = slim.groupBy("h1", "h2", "doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("src", src).withColumn("order", order)
    groups = running_sums(spark, groups, "src", ["order", "doc_id", "size", "h1", "h2"], {"at": F.col("size") * F.col("n")})
    goal = targets(slim.groupBy(F.col("source").alias("__src")).agg(F.sum("size").alias("source_size")), weights, share, max_repeats)
    goal = goal.select(F.when(F.col("__src").isNull(), "n").otherwise(F.concat(F.lit("s"), "__src")).alias("src"), "class", F.col("source_size").cast("long"), "target")
    rows = repeated(groups.join(goal, "src"), "n", "nth").withColumn("at", F.col("at") + F.col("nth") * F.col("size"))
    passes = F.sequence(F.lit(0), F.lit(max_repeats - 1))
    middles = F.transform(passes, lambda i: i.cast("long") * F.col("source_size") * 2 + F.col("at") * 2 + F.col("size"))
    rows = rows.withColumn("middles", F.filter(middles, lambda m: m < F.col("target") * 2))
    positions = F.transform("middles", lambda m: demanded_at(m / (F.col("target") * 2), F.col("class"), schedules))
    return rows.select("h1", "h2", "doc_id", "source", "size", "source_size", "target", positions.alias("positions"))


def assign(docs: DataFrame, size: Column | None = None, **options) -> DataFrame:
    """All rows of docs with size, source_size, target, copies and positions; options as for plan()."""
    own = ("size", "source_size", "target", "copies", "positions")
    planned = plan(docs, size, **options).drop("doc_id", "source")
    rows = planned.join(unique_rows(docs), ["h1", "h2"])
    return rows.select(*unpacked(rows, *own), "size", "source_size", "target", F.size("positions").alias("copies"), "positions")


def training_order(docs: DataFrame, size: Column | None = None, **options) -> DataFrame:
    """One row of docs for each time it is taken, with its position, range-sorted by that; options as for plan().

    Each text is joined to its positions once and then sorted into place.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    taken = plan(docs, size, **options).select("h1", "h2", F.col("doc_id").alias("__id"), F.explode("positions").alias("__position"))
    rows = taken.join(unique_rows(docs), ["h1", "h2"])
    rows = rows.repartitionByRange(parts, "__position", "__id").sortWithinPartitions("__position", "__id")
    return rows.select(*unpacked(rows, "position"), F.col("__position").alias("position"))


def op10_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    first = F.coalesce(F.get("positions", F.lit(0)), F.lit(2.0))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.withColumn("first", first).repartitionByRange(parts, "first", "doc_id").sortWithinPartitions("first", "doc_id")
    return ordered.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("positions")).cast("long").alias("taken"))


ORACLES = {
    "op10_curriculum_mix": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   md5(coalesce(doc_id::VARCHAR, 'null')) AS h
            FROM documents),
        s AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight
            FROM d GROUP BY source),
        r AS (
            SELECT *, 2 * source_size AS cap,
                   coalesce(sum(2 * source_size) OVER w, 0)::DOUBLE AS filled,
                   (sum(weight) OVER ()) - coalesce(sum(weight) OVER w, 0) AS unfilled,
                   sum(source_size) OVER ()::DOUBLE AS total
            FROM s WINDOW w AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        v AS (SELECT *, (total * 1.5::DOUBLE - filled) / unfilled AS level FROM r),
        l AS (SELECT min_by(level, cap / weight) AS level FROM v WHERE level * weight <= cap),
        t AS (SELECT v.source, v.source_size, least(v.cap::DOUBLE, coalesce(l.level * v.weight, v.cap::DOUBLE)) AS target FROM v CROSS JOIN l),
        p AS (
            SELECT *, (coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS at
            FROM d)
        SELECT p.doc_id, p.size, t.source_size, t.target,
               (p.size * ((2 * p.at + p.size < 2 * t.target)::BIGINT + (2 * t.source_size + 2 * p.at + p.size < 2 * t.target)::BIGINT))::BIGINT AS taken
        FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
    """,
}
