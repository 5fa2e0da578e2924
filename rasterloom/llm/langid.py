"""Operator 3: language identification by language-bitmask n-gram filters.

Each language has a set of character 3- and 4-grams and a Bloom filter of it. The filters are bit-sliced: slot i
holds one bit a language, so the AND of an n-gram's slots gives all languages that contain it at once. Over a
text, the n-grams per language are counted (popcounts), corrected for each filter's false-positive rate, and the
language with the largest corrected share decides.

An n-gram belongs to a language if its share of that language's training texts is at least SHARE of its largest
share in any language. The fit reads a sample of FIT_TEXTS texts a language (those of the lowest hashes of doc_id, text
and repeat) and keeps all their n-grams: slots are filled by an aggregate, so the model has 2**SLOT_BITS slots of 8
bytes per 64 languages however many n-grams there are, which is 8 MB; it is collected 64 languages at a time and broadcast.
Prediction covers whole texts of all rows.

Defined cases: a text that is null or has no letter gets `und`, score 0; ties go to the first language in order;
with nothing to learn from, all rows get `und`; any number of languages can be learnt; other columns pass through, but those that bear a result's name in any case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.llm import grams
from rasterloom.llm.common import packed, pin, sampled, table, unpacked

SIZES = (3, 4)
FIT_TEXTS = 4000
SHARE = 0.5
SLOT_BITS = 20
PROBES = 2
UNKNOWN = "und"


class Filters:
    """Bit-sliced Bloom filters: slots[w, i] has bit l of word w set if language 64*w + l has slot i set."""

    def __init__(self, langs: list[str], slots: np.ndarray):
        self.langs, self.slots = langs, slots
        self.bits = slots.shape[1].bit_length() - 1
        fill = np.array([self.bit(slots[i // 64], i % 64).mean() for i in range(len(langs))])
        self.false_rate = fill**PROBES

    @staticmethod
    def bit(masks: np.ndarray, i: int) -> np.ndarray:
        return (masks >> np.uint64(i)) & np.uint64(1)

    def probes(self, keys: np.ndarray) -> list[np.ndarray]:
        low = np.uint64((1 << self.bits) - 1)
        return [(keys >> np.uint64(k * 24)) & low for k in range(PROBES)]

    def shares(self, keys: np.ndarray) -> np.ndarray:
        """Corrected share of the keys that each language's set contains."""
        found = []
        at = self.probes(keys)
        for word, slots in enumerate(self.slots):
            masks = slots[at[0]]
            for probe in at[1:]:
                masks = masks & slots[probe]
            kinds, times = np.unique(masks, return_counts=True)
            found += [int(times[self.bit(kinds, i) == 1].sum()) for i in range(min(64, len(self.langs) - 64 * word))]
        raw = np.array(found) / len(keys)
        return np.clip((raw - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0, 1)

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, its part of all corrected shares, its own corrected share."""
        line = grams.letter_line(text or "")
        keys = grams.hashes(line, SIZES)
        if not len(keys) or not self.langs:
            return UNKNOWN, 0.0, 0.0
        shares = self.shares(keys)
        best = int(shares.argmax())
        return self.langs[best], float(shares[best] / shares.sum()) if shares[best] > 0 else 0.0, float(shares[best])


def slots_of(grams_of: DataFrame, bits: int = SLOT_BITS) -> DataFrame:
    """Filled slots (word, slot, mask) of rows (number of a language, key)."""
    low = F.lit((1 << bits) - 1)
    probes = F.array(*[F.shiftrightunsigned("key", k * 24).bitwiseAND(low) for k in range(PROBES)])
    each = grams_of.select(F.expr("number div 64").alias("word"), F.expr("shiftleft(1L, number % 64)").alias("mask"), F.explode(probes).alias("slot"))
    return each.groupBy("word", "slot").agg(F.expr("bit_or(mask)").alias("mask"))


def fit(texts: DataFrame, fit_texts: int = FIT_TEXTS, bits: int = SLOT_BITS) -> Filters:
    """Learn from rows (doc_id, text, lang); rows with a null text or lang teach nothing."""
    rows = texts.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    # one row a language
    found = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    sizes = {r["lang"]: min(r["n"], fit_texts) for r in found}
    langs = sorted(sizes)
    slots = np.zeros((max(1, -(-len(langs) // 64)), 1 << bits), np.uint64)
    if not langs:
        return Filters(langs, slots)

    def in_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, own in batch.groupby("by")["text"]:
                each = [np.unique(grams.hashes(grams.letter_line(t), SIZES)) for t in own]
                keys, times = np.unique(np.concatenate([*each, np.zeros(0, np.uint64)]), return_counts=True)
                yield pd.DataFrame({"lang": lang, "key": keys.view(np.int64), "n": times})

    sample = sampled(rows, fit_texts, F.col("lang")).select("by", "text")
    counted = sample.mapInPandas(in_texts, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    numbers = texts.sparkSession.createDataFrame([(k, i, float(sizes[k])) for i, k in enumerate(langs)], "lang string, number long, total double")
    rated = counted.join(numbers, "lang").withColumn("share", F.col("n") / F.col("total"))
    rated = rated.withColumn("most", F.max("share").over(Window.partitionBy("key"))).filter(F.col("share") >= F.col("most") * SHARE)
    filled = slots_of(rated.select("number", "key"), bits)
    if len(slots) > 1:
        filled = pin(texts.sparkSession, filled, "slots")
    for word in range(len(slots)):
        part = filled.filter(F.col("word") == word).select("slot", "mask").toPandas()
        slots[word, part["slot"].to_numpy(np.int64)] = part["mask"].to_numpy(np.int64).view(np.uint64)
    return Filters(langs, slots)


def predict(docs: DataFrame, model: Filters) -> DataFrame:
    """Add lang_pred, score, support to each row, from its text alone."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, support double")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([held.value.predict(t) for t in texts], columns=["lang_pred", "score", "support"])

    rows = packed(docs, F.col("text").alias("__text")).withColumn("__told", told("__text"))
    return rows.select(*unpacked(rows, "lang_pred", "score", "support"), "__told.*")


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op3_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
