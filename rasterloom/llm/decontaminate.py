"""Operator 5: benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to ASCII-lowered words joined by single spaces. A window is WINDOW consecutive words of an
item (an item of fewer words is one window). One automaton over all windows scans each normalised text once; the
spaces before and after a window keep matches on word limits. Words inside any match are hit; runs of them are
mapped back to offsets of the original text.

The automaton is built in each Python worker from the items, which are broadcast after a check of their size.
Beyond MAX_ITEM_CHARS the items are dealt into blocks below that bound, each scanned with an automaton of its own.

Defined cases: a null text or one without words is never hit; items without words and null items are left out,
items with a null item_id hit words but are not listed; repeated items count once; an empty benchmark hits
nothing; other columns pass through.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import packed, table, unpacked
from rasterloom.llm.words import norm_words

WINDOW = 10
MAX_ITEM_CHARS = 20_000_000
_FOUND = "n_words long, runs array<struct<`from`:int,`to`:int>>, items array<string>, spans array<struct<start:int,`end`:int>>"
_ORIGINAL = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_built: dict[str, object] = {}


def build(items: list[tuple[str | None, str]], width: int = WINDOW):
    """An automaton whose values are a window's word count and the items that hold it."""
    held: dict[str, tuple[int, set]] = {}
    for item, text in items:
        words = norm_words(text)
        n = min(width, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            key = " " + b" ".join(words[i : i + n]).decode("utf-8", "surrogatepass") + " "
            held.setdefault(key, (n, set()))[1].add(item)
    if not held:
        return None
    machine = ahocorasick.Automaton()
    for key, value in held.items():
        machine.add_word(key, value)
    machine.make_automaton()
    return machine


def scan(machine, text: str | None) -> tuple[int, list, list, list]:
    """Word count, hit runs of words, item ids found, hit spans of the original text."""
    words = norm_words(text)
    if machine is None or not words:
        return len(words), [], [], []
    line = " " + b" ".join(words).decode("utf-8", "surrogatepass") + " "
    found = list(machine.iter(line))
    if not found:
        return len(words), [], [], []
    spaces = np.flatnonzero(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
    ends = np.searchsorted(spaces, [at for at, _ in found])
    edge, items = np.zeros(len(words) + 1, np.int64), set()
    for end, (_, (n, holders)) in zip(ends, found, strict=True):
        edge[end - n] += 1
        edge[end] -= 1
        items |= holders
    hit = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])
    starts, stops = np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1)
    places = [m.span() for m in _ORIGINAL.finditer(text)]
    runs = [{"from": int(a), "to": int(b)} for a, b in zip(starts, stops, strict=True)]
    spans = [{"start": places[r["from"]][0], "end": places[r["to"] - 1][1]} for r in runs]
    return len(words), runs, sorted(x for x in items if x is not None), spans


def _scanner(held, width: int):
    @F.pandas_udf(_FOUND)
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if held.id not in _built:
            _built.clear()
            _built[held.id] = build(held.value, width)
        for batch in texts:
            yield pd.DataFrame([scan(_built[held.id], t) for t in batch], columns=["n_words", "runs", "items", "spans"])

    return found


class _Items:
    """Broadcast items with an id that workers keep their automaton by."""

    def __init__(self, spark: SparkSession, items: list):
        self._cast, self.id = spark.sparkContext.broadcast(items), uuid.uuid4().hex

    @property
    def value(self) -> list:
        return self._cast.value


def item_blocks(benchmark: DataFrame, max_chars: int = MAX_ITEM_CHARS) -> Iterator[list[tuple[str | None, str]]]:
    """The items, collected in blocks of at most about max_chars; the number of blocks follows their size."""
    items = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // max_chars) or 1
    for k in range(n):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        yield [(r[0], r[1]) for r in block.collect()]


def mark(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, max_chars: int = MAX_ITEM_CHARS) -> DataFrame:
    """Add n_words, n_hit, items, spans (of the original text) to each row of docs."""
    spark, out, names = docs.sparkSession, packed(docs, F.col("text").alias("__text")), []
    for k, items in enumerate(item_blocks(benchmark, max_chars)):
        names.append(f"__found{k}")
        out = out.withColumn(names[-1], _scanner(_Items(spark, items), width)("__text"))

    def merged(field: str) -> Column:
        return F.concat(*[F.col(f"{n}.{field}") for n in names]) if len(names) > 1 else F.col(f"{names[0]}.{field}")

    if len(names) == 1:
        n_hit = F.aggregate(merged("runs"), F.lit(0), lambda acc, r: acc + r["to"] - r["from"])
    else:
        n_hit = F.size(F.array_distinct(F.flatten(F.transform(merged("runs"), lambda r: F.sequence(r["from"], r["to"] - 1)))))
    return out.select(*unpacked(out, "n_words", "n_hit", "items", "spans"), F.col(f"{names[0]}.n_words").alias("n_words"), n_hit.cast("long").alias("n_hit"),
                      F.array_sort(F.array_distinct(merged("items"))).alias("items"), merged("spans").alias("spans"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = mark(docs, table(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLES = {
    "op5_decontaminate": r"""
        WITH word AS (
            SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        item AS (
            SELECT DISTINCT item_id::VARCHAR AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
        cut AS (
            SELECT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
            FROM item, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
        size AS (SELECT DISTINCT n FROM cut),
        place AS (
            SELECT row, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
            FROM word, size, unnest(range(1, len(w) - n + 2)) AS u(i)),
        hit AS (SELECT row, i, place.n, item_id FROM place JOIN cut USING (gram) WHERE place.n = cut.n),
        hits AS (SELECT row, count(DISTINCT j) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT row, i, n FROM hit)) GROUP BY row),
        items AS (SELECT row, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT row, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY row)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM word LEFT JOIN hits USING (row) LEFT JOIN items USING (row)
    """,
}
