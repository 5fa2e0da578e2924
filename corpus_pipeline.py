"""A training corpus from the documents table, in five stages; each stage's result is written and read again.

1 language     documents without letters, or whose n-grams no learned language holds, go
2 near_dup     one document of each group of near copies stays
3 decontaminate documents that hold a window of a benchmark item go
4 mix          sources are brought to target weights; a document may come twice; range-sorted by training position
5 shard        every row gets a shard and a slot

Stage 2 decides row by row, also where rows share a doc_id: of a group one row stays, that of the smallest doc_id, and
different texts of one doc_id are different documents. Rows with a null doc_id come last in their group; rows without
words, which no group has, pass. Null texts go in stage 1. Columns beyond those of documents pass through. What a
stage pins on its way is deleted when its result is written.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import decontaminate, langid, mixing, near_dup, sharding
from rasterloom.llm.common import packed, row_key, settled, table, unique_rows, unpacked

#: A document stays if at least this share of its n-grams belongs to its language.
LEAST_SUPPORT = 0.2


def has_words() -> Column:
    """Whether a text has any of what op 7's words are made of: digits, ASCII letters and all beyond ASCII."""
    return F.coalesce(F.rlike("text", F.lit(r"[0-9A-Za-z\u0080-\x{10FFFF}]")), F.lit(False))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.filter(~langid.held_out()).select("doc_id", "text", "lang"))
    told = langid.predict(packed(docs, F.col("text")), model)
    return told.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("support") >= LEAST_SUPPORT)).select(*unpacked(told))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    marked = near_dup.near_duplicates(docs.select("doc_id", "text", *row_key(docs)), "h1", "h2").filter("group IS NOT NULL")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h1", "h2")).alias("first")
    best = marked.groupBy("group").agg(first).select("first.h1", "first.h2")
    rows = unique_rows(docs.filter(has_words())).join(best, ["h1", "h2"], "left_semi")
    return rows.select(*unpacked(rows)).unionByName(docs.filter(~has_words()))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    marked = decontaminate.mark(packed(docs, F.col("text")), table(spark, sf_dir, "benchmark"))
    return marked.filter(F.col("n_hit") == 0).select(*unpacked(marked))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed_rows = mixing.training_order(packed(docs, F.col("doc_id"), F.col("source"), F.col("text")))
    return mixed_rows.select(*unpacked(mixed_rows))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs)


STAGES = [
    ("language", language),
    ("near_dup", near_duplicates),
    ("decontaminate", decontaminated),
    ("mix", mixed),
    ("shard", sharded),
]

#: SQL can express neither the learned filters nor the checksums.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(spark, partial(stage, spark, docs, sf_dir), f"stage-{name}")
    return docs
