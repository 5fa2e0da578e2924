"""Operator 11: how far the word use of each source lies from that of the other sources of its language.

Terms are runs of letters: ASCII letters, of which A-Z are lowered, and all that lies beyond ASCII. A language keeps the
terms that at least `least_docs` of its documents hold. A group is a (lang, source) that occurs. Each group, and each
language as a whole, gives each kept term the smoothed share p = 1 + floor(SCALE * (n + SMOOTH) / (N + SMOOTH * V)): n
occurrences of the term, N of all kept terms, V kept terms. Two reports come of it:

pair  the sum over all kept terms of the absolute difference of p, for each two sources of a language
term  the terms that a group uses more than its language does, by that difference; only the first `top` a group

Everything is relational. Matches are exploded and grouped, map-side first. Groups meet the kept vocabulary of their
language in a join by language and salt, so a language that holds most rows is spread over all tasks; counts fill what
of that grid occurs, zeros the rest. The grid is joined with itself by language and term, and each two sources sum up,
map-side first. So the grid has groups x V rows of a language, and its self-join half of sources^2 x V. Ranks are windows
within a group; that of `term` keeps no more than `top` rows a task before it shuffles. Arithmetic is in integers and
decimals, so it is exact.

Defined cases: null text, lang and source are empty; a group without terms is a group, with p from n = N = 0; a language
without kept terms has pairs of value 0 and no terms; a source alone in its language has no pairs; repeated rows count
each; ties go by the item's bytes; an empty table gives no rows; other columns are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import pin, table

#: What is left of all characters without ASCII that is no letter; Java is quick with a union of ranges, slow with its complement.
TERM = r"[A-Za-z\x{80}-\x{10FFFF}]+"
LEAST_DOCS = 30
SMOOTH = 5
SCALE = 1_000_000_000
TOP = 50
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def terms(text: Column) -> Column:
    """All terms of a text, in order; where it is all ASCII, lower() lowers nothing but A-Z, at less cost than translate()."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * kept)); decimals, as SCALE * n leaves 64 bits from 9.2e9 occurrences on."""
    upper = (n.cast("decimal(19,0)") + F.lit(SMOOTH)) * F.lit(SCALE).cast("decimal(10,0)")
    lower = total.cast("decimal(19,0)") + F.lit(SMOOTH) * kept.cast("decimal(12,0)")
    return F.lit(1).cast("long") + F.call_function("div", upper, lower)


def vocabulary(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """The kept terms (lang, term) of docs (lang, text)."""
    held = docs.select("lang", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    return held.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") >= least_docs).select("lang", "term")


def occurrences(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n) for each term that occurs in docs (lang, source, text)."""
    each = docs.select("lang", "source", F.explode(terms(F.col("text"))).alias("term"))
    return each.groupBy("lang", "source", "term").agg(F.count(F.lit(1)).alias("n"))


def grid(groups: DataFrame, kept: DataFrame, counted: DataFrame) -> DataFrame:
    """(lang, source, term, p) for each group (with total and v) and each kept term of its language."""
    salts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)))
    spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    cells = salted.join(spread, ["lang", "salt"]).join(counted, ["lang", "source", "term"], "left")
    return cells.select("lang", "source", "term", share(F.coalesce("n", F.lit(0)), F.col("total"), F.col("v")).alias("p"))


def ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def pairs(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """(lang, source, item, value): item is each other source of the language."""
    left, right = cells.select("lang", "term", "source", "p"), cells.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    met = left.join(right, ["lang", "term"]).filter(F.col("source") < F.col("item"))
    summed = met.groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("q"))).alias("value"))
    both = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    # languages that keep no term have no cells
    bare = groups.filter("v = 0").select("lang", "source")
    zeros = bare.join(bare.withColumnRenamed("source", "item"), "lang").filter("source <> item").withColumn("value", F.lit(0).cast("long"))
    return summed.select("lang", F.explode(both).alias("pair"), "value").select("lang", "pair.source", "pair.item", "value").unionByName(zeros)


def leading_terms(groups: DataFrame, counted: DataFrame) -> DataFrame:
    """(lang, source, item, value) of terms that a group uses more than its language does."""
    whole = counted.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    used = counted.join(whole, ["lang", "term"]).join(groups, ["lang", "source"]).join(langs, "lang")
    used = used.withColumn("value", share(F.col("n"), F.col("total"), F.col("v")) - share(F.col("lang_n"), F.col("lang_total"), F.col("v")))
    return used.filter(F.col("value") > 0).select("lang", "source", F.col("term").alias("item"), "value")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """Both reports over docs (text, lang, source): (lang, source, part, item, value, rank)."""
    spark = docs.sparkSession
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    kept = pin(spark, vocabulary(docs, least_docs), "kept")
    counted = pin(spark, occurrences(docs).join(kept, ["lang", "term"]).select("lang", "source", "term", "n"), "counted")
    totals = counted.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = pin(spark, groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "v")]), "groups")
    apart = ranked(pairs(groups, grid(groups, kept, counted))).withColumn("part", F.lit("pair"))
    leading = ranked(leading_terms(groups, counted)).filter(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return apart.unionByName(leading).select("lang", "source", "part", "item", "value", "rank")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLES = {
    "op11_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents),
        e AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
        k AS (SELECT lang, term FROM e GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT e.lang, e.source, e.term, count(*) AS n FROM e JOIN k USING (lang, term) GROUP BY ALL),
        z AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        p AS (
            SELECT lang, source, term, n,
                   1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p,
                   1 + (1000000000::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + 5))
                       // (sum(n) OVER (PARTITION BY lang) + 5 * (SELECT count(*) FROM k WHERE k.lang = z.lang)) AS q
            FROM z),
        f AS (
            SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        r AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value::BIGINT AS value,
               (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
        FROM r QUALIFY part = 'pair' OR rank <= 50
    """,
}
