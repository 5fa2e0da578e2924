"""Operator 6: token counts by rank-synchronous merging of ragged arrays.

The vocabulary is a word-level BPE file: text is NFC-normalised, lowered and cut by a pattern that drops white
space; a pre-token's bytes are its first symbols, the last bearing the end-of-word mark. A batch's new
pre-tokens are one array of symbols with word limits. In each step every word finds its pair of lowest rank and
merges all its occurrences at once, left to right where they overlap. A merge's product takes part only in
merges of higher rank, so this gives what merging one pair at a time gives. In pre-tokens of more than LONG bytes all
pairs are merged at once that are of lowest rank as far as any symbol reaches. Surviving symbols are counted.
Counts of pre-tokens are kept from batch to batch in each worker, up to KEPT of them.

Defined cases: a null text is empty (no bytes, no tokens); the special strings inside texts are one token each;
very long pre-tokens are merged like others; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import packed, table, unpacked

LIMIT = 2048
KEPT = 1_000_000
#: Bytes beyond which a pre-token is merged by merge_long().
LONG = 128
#: Texts merged together, in characters; bounds a worker's pre-tokens.
BATCH_CHARS = 2_000_000
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
ASCII_PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0d a-z0-9]+"
_NONE = np.iinfo(np.int64).max
_loaded: dict[str, RankMerger] = {}


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


def least_ahead(line: np.ndarray, size: int) -> np.ndarray:
    """The least of each value and the size - 1 values after it."""
    span, step = line.copy(), 1
    while 2 * step <= size:
        span[:-step] = np.minimum(span[:-step], span[step:])
        step *= 2
    out, rest = span.copy(), size - step
    if rest:
        out[:-rest] = np.minimum(out[:-rest], span[rest:])
    return out


class RankMerger:
    """Merge tables of one vocabulary file, and the counts of pre-tokens seen."""

    def __init__(self, spec: dict):
        vocab, mark = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        symbols = byte_symbols()
        self.first = np.array([vocab[s] for s in symbols])
        self.last = np.array([vocab[s + mark] for s in symbols])
        pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
        self.width = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs])
        made = np.array([vocab[a + b] for a, b in pairs])
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.wide, self.ascii = regex.compile(PRETOKEN), re.compile(ASCII_PRETOKEN)
        self.reach = max(len(t.removesuffix(mark)) for t in vocab)
        self.counts: dict[str, int] = {}

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and how many special strings it holds."""
        parts = self.special.split(text) if "<|" in text else [text]
        out: list[str] = []
        for part in parts:
            if part.isascii():
                out += self.ascii.findall(part.lower())
            else:
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                out += self.wide.findall(part.lower())
        return out, len(parts) - 1

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge(self, words: list[str]) -> np.ndarray:
        """The number of symbols left of each word."""
        raw = [w.encode("utf-8", "replace") for w in words]
        sizes = np.array([len(b) for b in raw])
        total = np.zeros(len(raw), np.int64)
        for some, merged in ((np.flatnonzero(sizes <= LONG), self.merge_words), (np.flatnonzero(sizes > LONG), self.merge_long)):
            if len(some):
                total[some] = merged([raw[i] for i in some], sizes[some])
        return total

    def symbols(self, raw: list[bytes], sizes: np.ndarray) -> np.ndarray:
        flat = np.frombuffer(b"".join(raw), np.uint8)
        sym, ends = self.first[flat].copy(), np.cumsum(sizes) - 1
        sym[ends] = self.last[flat[ends]]
        return sym

    @staticmethod
    def every_second(at: np.ndarray) -> np.ndarray:
        """Of runs of pairs that overlap, every second one from the left."""
        begins = at & ~np.r_[False, at[:-1]]
        places = np.arange(len(at))
        return at & ((places - np.maximum.accumulate(np.where(begins, places, 0))) % 2 == 0)

    def merge_words(self, raw: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """Each step merges the pair of lowest rank of every word."""
        total, sym = sizes.copy(), self.symbols(raw, sizes)
        word = np.repeat(np.arange(len(raw)), sizes)
        while len(sym) > 1:
            rank = self.rank_of(sym[:-1], sym[1:])
            rank[word[:-1] != word[1:]] = _NONE
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(np.r_[rank, _NONE], starts)
            each = np.diff(np.r_[starts, len(word)])
            at = (rank == np.repeat(lowest, each)[:-1]) & (rank != _NONE)
            if not at.any():
                break
            at = self.every_second(at)
            sym[:-1][at] = self.made[rank[at]]
            stay = np.r_[True, ~at]
            total -= np.bincount(word[~stay], minlength=len(raw))
            live = np.repeat(lowest != _NONE, each)
            sym, word = sym[stay & live], word[stay & live]
        return total

    def merge_long(self, raw: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """Each step merges all pairs that no pair of lower rank can reach, so a word of a million bytes takes few hundred steps.

        What undoes a pair before its turn is a chain of merges of lower ranks that ends in one symbol over both the
        chain's first pair and a part of this one. No symbol has more than `reach` bytes, so a pair whose rank is the
        least of the `reach` pairs on either side is merged in any order. Of a run of overlapping equal pairs, all
        must be least, so that every second one can be told from the run's start. Words are kept apart by `reach`
        marks that pair with nothing.
        """
        gap, mark = np.full(self.reach, -1), len(raw)
        ends = np.cumsum(sizes)
        parts = np.split(self.symbols(raw, sizes), ends[:-1])
        sym = np.concatenate([x for part in parts for x in (part, gap)])
        word = np.concatenate([np.full(n, k) for i, size in enumerate(sizes) for n, k in ((size, i), (self.reach, mark))])
        rank = self.rank_between(sym[:-1], sym[1:])
        while len(rank):
            least = np.minimum(least_ahead(rank, self.reach + 1), least_ahead(rank[::-1], self.reach + 1)[::-1])
            ready = (rank == least) & (rank != _NONE)
            if not ready.any():
                break
            # a run of equal overlapping pairs goes as a whole
            same = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
            ready &= np.repeat(np.logical_and.reduceat(ready, same), np.diff(np.r_[same, len(rank)]))
            if not ready.any():
                raise RuntimeError("no run of pairs can be merged")
            at = np.flatnonzero(self.every_second(ready))
            sym[at] = self.made[rank[at]]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            stale = np.zeros(len(sym), bool)
            stale[at] = stale[np.maximum(at - 1, 0)] = True
            sym, word, rank = sym[stay], word[stay], np.r_[rank, _NONE][stay][:-1]
            stale = np.flatnonzero(stale[stay][:-1])
            rank[stale] = self.rank_between(sym[stale], sym[stale + 1])
        return np.bincount(word, minlength=mark + 1)[:mark]

    def rank_between(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where((left < 0) | (right < 0), _NONE, self.rank_of(left, right))

    def count(self, texts: list[str]) -> list[int]:
        if len(self.counts) > KEPT:
            self.counts.clear()
        cut = [self.pretokens(t) for t in texts]
        new = list({w for words, _ in cut for w in words if w not in self.counts})
        if new:
            self.counts.update(zip(new, self.merge(new).tolist(), strict=True))
        return [sum(map(self.counts.__getitem__, words)) + special for words, special in cut]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Add n_bytes, n_tokens, over_limit to each row; path: a vocabulary file, read by the driver and broadcast."""
    with open(path, encoding="utf-8") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if path not in _loaded:
            _loaded[path] = RankMerger(json.loads(held.value))
        for texts in batches:
            out, part, chars = [], [], 0
            for text in texts:
                part.append(text or "")
                chars += len(part[-1])
                if chars > BATCH_CHARS:
                    out += _loaded[path].count(part)
                    part, chars = [], 0
            yield pd.Series(out + _loaded[path].count(part), dtype="int64")

    text = F.col("text").alias("__text")
    rows = packed(docs, text).withColumn("__bytes", F.coalesce(F.octet_length("__text"), F.lit(0)).cast("long")).withColumn("__tokens", counted("__text"))
    own = F.col("__bytes").alias("n_bytes"), F.col("__tokens").alias("n_tokens"), (F.col("__tokens") > limit).alias("over_limit")
    return rows.select(*unpacked(rows, "n_bytes", "n_tokens", "over_limit"), *own)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, str(public_tokenizers.path("word_bpe_49k.json"))).drop("text")
