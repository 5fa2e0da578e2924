"""Operator 13: importance resampling towards a target distribution, by tries of words within tasks.

Words are those of words.norm_words(). Features of a text are its runs of one to three words; a feature's bucket is the
CRC-32 of its bytes (words joined by a blank) modulo `buckets`. A bucket's gain is how much more often the target has it
than the corpus, as a floored smoothed log ratio. A document's weight is the sum of its features' gains; with Gumbel noise
from a hash of doc_id, the highest scores are a sample without replacement, drawn in proportion to exp(weight).

A task holds the runs of words it meets in a trie of three levels, as numpy arrays: a node is (parent, word), known by
sorting these pairs, with its count and its CRC state. As CRC is linear, a child's state follows from its parent's by a
table look-up for the length of " word" and the CRC of that, so no run is put together as bytes. A trie covers CHUNK
words and is then added to the task's bucket totals; totals of tasks are summed by bucket, at most `buckets` rows a task. To score,
a task walks the same paths with the gains attached to nodes and sums them by document. The gains, one number a bucket, are
all that is broadcast. Texts longer than a chunk go on in the next one, which begins with the last two words of the last.

Defined cases: a null or wordless text has no features and weight 0; documents with less than `least_words` words
are never drawn and have no rank; rows that repeat a doc_id have the same noise, and are drawn by weight, then by their numbers of
features; a null doc_id has the noise of `null` and comes last among ties; an empty target makes all gains depend on the corpus
alone; an empty table gives no rows; other columns pass through, but those that bear a result's name in any case.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import number_rows, packed, pin, table, unpacked
from rasterloom.llm.words import norm_words

BUCKETS = 10_000
SCALE = 1000
PERCENT = 5
LEAST_WORDS = 20
SEED = 42
#: Words of a trie, characters of a text that are cut into words at a time, and words that a task remembers.
CHUNK, PIECE, KEPT = 1 << 19, 1 << 20, 500_000
#: Bytes of " word" up to which a CRC state is moved on by table.
TABLED = 64
_shift: np.ndarray | None = None


def shift_tables() -> np.ndarray:
    """[k, j, b]: what k zero bytes make of a CRC whose byte j is b; the CRC of A+B is that of A moved by len(B), xor that of B."""
    global _shift
    if _shift is None:
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
        tables = np.zeros((TABLED + 1, 4, 256), np.uint32)
        tables[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
        for k in range(1, TABLED + 1):
            tables[k] = (tables[k - 1] >> 8) ^ step[tables[k - 1] & 255]
        _shift = tables
    return _shift


class Words(dict):
    """Codes of words, with the CRC of each word, that of " word", and the length of that."""

    def __init__(self) -> None:
        self.crc, self.joined, self.size, self.spelt = array("I"), array("I"), array("I"), []

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self.spelt)
        self.spelt.append(word)
        self.crc.append(zlib.crc32(word))
        self.joined.append(zlib.crc32(b" " + word))
        self.size.append(len(word) + 1)
        return code

    def forget(self) -> None:
        self.clear()
        self.__init__()


class Trie:
    """Runs of one to three words that end at each place of a line of words, as nodes of three levels.

    line: codes of words; doc: the ascending number of each word's text; known: words at the start that an earlier trie
    has counted. levels: for each length of runs the CRC states of nodes, the places where a run of this length ends, and
    the node of each such place.
    """

    def __init__(self, words: Words, line: np.ndarray, doc: np.ndarray, known: int):
        codes, node = np.unique(line, return_inverse=True)
        joined, size = (np.frombuffer(a, np.uint32)[codes] for a in (words.joined, words.size))
        state, places = np.frombuffer(words.crc, np.uint32)[codes], np.arange(len(line))
        word, of_place = node, node
        self.levels, self.known, self.doc = [(state, places, node)], known, doc
        for back in (1, 2):
            places = np.flatnonzero(doc[back:] == doc[:-back]) + back
            pairs, node = np.unique(of_place[places - 1] * len(codes) + word[places], return_inverse=True)
            parent, last = np.divmod(pairs, max(len(codes), 1))
            state = self.joined_state(words, state[parent], codes, last, joined, size)
            of_place = np.zeros(len(line), np.int64)
            of_place[places] = node
            self.levels.append((state, places, node))

    @staticmethod
    def joined_state(words: Words, state: np.ndarray, codes: np.ndarray, last: np.ndarray, joined: np.ndarray, size: np.ndarray) -> np.ndarray:
        tables, k = shift_tables(), np.minimum(size[last], TABLED)
        out = tables[k, 0, state & 255] ^ tables[k, 1, (state >> 8) & 255] ^ tables[k, 2, (state >> 16) & 255] ^ tables[k, 3, state >> 24] ^ joined[last]
        for i in np.flatnonzero(size[last] > TABLED):
            out[i] = zlib.crc32(b" " + words.spelt[codes[last[i]]], int(state[i]))
        return out

    def totals(self, buckets: int) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for state, places, node in self.levels:
            counts = np.bincount(node[places >= self.known], minlength=len(state))
            # counts are below 2^53, so their sums as doubles are exact
            out += np.bincount(state % buckets, weights=counts, minlength=buckets).astype(np.int64)
        return out

    def weights(self, gains: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Words and sum of gains of each text."""
        out = np.zeros(texts, np.int64)
        for state, places, node in self.levels:
            fresh = places >= self.known
            out += np.bincount(self.doc[places[fresh]], weights=gains[state % len(gains)][node[fresh]], minlength=texts).astype(np.int64)
        return np.bincount(self.doc[self.known :], minlength=texts), out


def word_pieces(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, some at a time; it is cut at blanks, or at any other ASCII between words if it has none."""
    text, at = text or "", 0
    while len(text) - at > PIECE:
        cut = text.rfind(" ", at + 1, at + PIECE)
        cut = cut if cut > 0 else next((i for i in range(at + PIECE, len(text)) if text[i].isascii() and not text[i].isalnum()), len(text))
        yield norm_words(text[at:cut])
        at = cut
    yield norm_words(text[at:])


def tries(words: Words, texts: Iterable[str | None]) -> Iterator[Trie]:
    """Tries that cover all words of the texts, CHUNK or a few more words each."""
    line: list[int] = []
    doc: list[np.ndarray] = []
    known = 0
    for k, text in enumerate(texts):
        for piece in word_pieces(text):
            for i in range(0, len(piece), CHUNK):
                some = piece[i : i + CHUNK]
                line += map(words.__getitem__, some)
                doc.append(np.full(len(some), k))
                if len(line) >= CHUNK:
                    numbers = np.concatenate(doc)
                    yield Trie(words, np.array(line, np.int64), numbers, known)
                    line, doc = line[-2:], [numbers[-2:]]
                    known = len(line)
                    if len(words.spelt) > KEPT:
                        held = [words.spelt[c] for c in line]
                        words.forget()
                        line = [words[w] for w in held]
    if len(line) > known:
        yield Trie(words, np.array(line, np.int64), np.concatenate(doc), known)


def bucket_totals(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts by bucket, without those of none."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, out = Words(), np.zeros(buckets, np.int64)
        for batch in batches:
            for trie in tries(words, batch["text"]):
                out += trie.totals(buckets)
            if len(words.spelt) > KEPT:
                words.forget()
        held = np.flatnonzero(out)
        yield pd.DataFrame({"bucket": held, "n": out[held]})

    return texts.select("text").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for each bucket, from the totals of both."""
    spark = corpus.sparkSession
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    both = pin(spark, both.select("bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("s", "t")]), "totals")
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    top = (F.col("t") + 1).cast("double") * F.lit(float(all_s + buckets))
    return both.select("bucket", F.floor(SCALE * F.log(top / ((F.col("s") + 1).cast("double") * F.lit(float(all_t + buckets))))).cast("long").alias("gain"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Floored Gumbel noise from a hash of doc_id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scored(docs: DataFrame, gain: DataFrame, seed: int = SEED) -> DataFrame:
    """All rows of docs with n_words, n_features, weight and score; gain: (bucket, gain) for each bucket, which is collected."""
    rows = gain.orderBy("bucket").collect()
    held = docs.sparkSession.sparkContext.broadcast(np.array([r.gain for r in rows], np.float64))

    @F.pandas_udf("words long, weight long")
    def walked(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = Words()
        for texts in batches:
            n, weight = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for trie in tries(words, texts):
                more, sums = trie.weights(held.value, len(texts))
                n, weight = n + more, weight + sums
            if len(words.spelt) > KEPT:
                words.forget()
            yield pd.DataFrame({"words": n, "weight": weight})

    out = packed(docs, F.col("doc_id").alias("__id"), walked("text").alias("__w"))
    n = F.col("__w.words")
    features = F.greatest(n, F.lit(0)) + F.greatest(n - 1, F.lit(0)) + F.greatest(n - 2, F.lit(0))
    own = ("n_words", "n_features", "weight", "score")
    return out.select(
        *unpacked(out, *own, "rank"), n.alias("n_words"), features.cast("long").alias("n_features"), F.col("__w.weight").alias("weight"),
        (F.col("__w.weight") + noise(F.col("__id"), seed)).alias("score"),
    )


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """All rows of docs (doc_id, and others but text) with n_words, n_features, weight, score and rank; rank is null where a row isn't drawn."""
    spark = docs.sparkSession
    gain = gains(bucket_totals(docs, buckets), bucket_totals(target, buckets), buckets)
    rows = pin(spark, scored(docs, gain, seed).drop("text"), "scored")
    drawn = (F.col("n_words") >= least_words).alias("fit")
    fit = rows.filter(drawn).count()
    # those that can't be drawn come last, so ranks of the others are their row numbers
    keys = [~drawn, -F.col("score"), F.col("doc_id").isNull(), F.col("doc_id"), -F.col("weight"), -F.col("n_features")]
    numbered, _ = number_rows(spark, rows, keys, "__no")
    rank = F.when(F.col("__no") < percent * fit // 100, F.col("__no") + 1).cast("long")
    return numbered.withColumn("rank", rank).drop("__no")


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")
