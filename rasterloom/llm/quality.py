"""Operator 8: quality classifier from weak labels.

Heuristic labellers each vote good, bad or nothing on a document. Expectation-maximisation estimates each one's
accuracy on good and on bad documents and the share of good ones, from the counts of vote patterns over all
documents (at most 3**labellers rows, whatever the corpus). The posteriors of a sample, the FIT_TEXTS rows of lowest
hashes, are the soft targets of a logistic scorer on hashed character n-grams of the whole text, which then scores
every document. No given label is read.

Defined cases: a null text counts as empty; texts of fewer than three characters score 0; repeated rows count as
often as they occur; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import grams
from rasterloom.llm.common import packed, sampled, table, unpacked

FIT_TEXTS = 6000
#: Least quality of a kept document; below one half, so that texts too short to tell are kept.
KEEP = 0.3
BITS = 15
GRAM = 3
STEPS = 120
EM_STEPS = 200
SYMBOLS = "%*&#$|!<>{}[]\\^~=_@+"
ENDS = ".,;:?!"
#: Characters whose counts are taken in one array.
_CHARS = 1_000_000
#: Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = ("a an and are as at be by for from in is it of on or that the this to was with "
                  "au aux de des du elle en et la le les par pour que qui sur un une "
                  "das dem den der die ein eine für ist mit nicht sich sie und von zu "
                  "al con del el es las los no por se su y").split()  # fmt: skip
LABELLERS = ("symbols", "capitals", "variety", "repeats", "function_words", "sentences", "marks", "plain_words")


def _among(codes: np.ndarray, chars: str) -> np.ndarray:
    """Which code points are among the (ASCII) chars."""
    held = np.zeros(129, bool)
    held[[ord(c) for c in chars]] = True
    return held[np.minimum(codes, 128)]


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts, a line feed after each, and where each text starts."""
    return grams.codes_of("\n".join([*texts, ""])), np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])


def word_hashes(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (a run without white space and punctuation), and the number of its text."""
    inside = ~_among(codes, string.whitespace + string.punctuation)
    first = inside & ~np.r_[False, inside[:-1]]
    place = np.arange(len(codes))
    within = (place - np.maximum.accumulate(np.where(first, place, 0)))[inside]
    if not len(within):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    power = np.cumprod(np.full(int(within.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
    begins = np.flatnonzero(within == 0)
    return grams.mixed(np.add.reduceat(codes[inside] * power[within], begins)), np.searchsorted(starts, np.flatnonzero(first), "right") - 1


_COMMON = np.sort(word_hashes(*_joined(FUNCTION_WORDS))[0])


def votes_on(texts: list[str]) -> np.ndarray:
    """Votes of all labellers (columns, as in LABELLERS) on texts: 1 good, 0 bad, -1 none. Counts are made for all texts at once."""
    codes, starts = _joined(texts)
    each = np.diff(np.r_[starts, len(codes)]) - 1
    count = lambda hit: np.add.reduceat(hit, starts, dtype=np.int64)
    after = np.r_[codes[1:], 10]
    blank, end = _among(after, string.whitespace), _among(after, ENDS)
    plain = grams.letters()[codes] & (blank | (end & np.r_[blank[1:], True]))
    words, text = word_hashes(*_joined([t.lower() for t in texts]))
    n = np.bincount(text, minlength=len(texts))
    again = np.bincount(text[1:][(words[1:] == words[:-1]) & (text[1:] == text[:-1])], minlength=len(texts))
    common = np.bincount(text[_COMMON[np.minimum(np.searchsorted(_COMMON, words), len(_COMMON) - 1)] == words], minlength=len(texts))
    order = np.lexsort((words, text))
    w, t = words[order], text[order]
    kinds = np.bincount(t[np.r_[True, (w[1:] != w[:-1]) | (t[1:] != t[:-1])][: len(t)]], minlength=len(texts))
    symbols, per_char, per_word = count(_among(codes, SYMBOLS)), np.maximum(each, 1), np.maximum(n, 1)
    enough = n >= 20
    capitals, stops = count((codes >= 65) & (codes <= 90)) / per_char, count(codes == 46) / per_word
    variety, repeats, known, whole = kinds / np.sqrt(per_word), again / per_word, common / per_word, count(plain) / per_word

    def vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.where(bad, 0, np.where(good, 1, -1))

    return np.stack([
        vote(symbols / per_char > 0.02, symbols / per_char < 0.004),
        vote(enough & (capitals > 0.2), capitals < 0.1),
        vote(enough & (variety < 2.5), enough & (variety > 4.0)),
        vote(enough & (repeats > 0.2), enough & (repeats < 0.05)),
        vote(enough & (known < 0.04), known > 0.12),
        vote(enough & ((stops < 0.01) | (stops > 0.5)), enough & (stops > 0.02) & (stops < 0.3)),
        vote(symbols / per_word > 0.15, symbols / per_word < 0.03),
        vote(enough & (whole < 0.8), enough & (whole > 0.95)),
    ], axis=1)


def voted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Votes as text, a digit a labeller: 0 none, 1 bad, 2 good."""
    for batch in texts:
        out, part, chars = [], [], 0
        for text in batch:
            part.append(text or "")
            chars += len(part[-1])
            if chars > _CHARS:
                out.append(votes_on(part))
                part, chars = [], 0
        if part:
            out.append(votes_on(part))
        told = (np.concatenate([*out, np.zeros((0, len(LABELLERS)), int)]) + 49).astype(np.uint8)
        yield pd.Series([row.tobytes().decode() for row in told], dtype="object")


def patterns_of(votes: Iterable[str]) -> np.ndarray:
    """The text form of votes as an array."""
    return np.frombuffer("".join(votes).encode(), np.uint8).reshape(-1, len(LABELLERS)).astype(int) - 49


def estimate(patterns: np.ndarray, counts: np.ndarray, steps: int = EM_STEPS) -> tuple[float, np.ndarray]:
    """EM over vote patterns: share of good documents, and per class (0 bad, 1 good) each labeller's chance of a good vote.

    Votes are taken as independent given the class; a labeller without a vote says nothing. One document each way
    is added to every count. Starts from documents with a bad vote as bad, so class 1 is the good one.
    """
    good, bad = patterns == 1, patterns == 0
    mine, share, chances = np.where(bad.any(axis=1), 0.05, 0.95), 0.5, np.zeros((2, patterns.shape[1]))
    for _ in range(steps):
        share = ((counts * mine).sum() + 1) / (counts.sum() + 2)
        for k, w in enumerate((counts * (1 - mine), counts * mine)):
            chances[k] = (w @ good + 1) / (w @ (good | bad) + 2)
        mine = posterior(patterns, share, chances)
    return share, chances


def posterior(patterns: np.ndarray, share: float, chances: np.ndarray) -> np.ndarray:
    good, bad = patterns == 1, patterns == 0
    odds = np.log(share / (1 - share)) + good @ np.log(chances[1] / chances[0]) + bad @ np.log((1 - chances[1]) / (1 - chances[0]))
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of a whole text: indices and values, roots of counts scaled to length 1."""
    codes = grams.codes_of((text or "").lower()).astype(np.uint64)
    if len(codes) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0)
    h = np.zeros(len(codes) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        h = h * np.uint64(0x100000001B3) + codes[i : i + len(h)]
    counts = np.bincount((grams.mixed(h) >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
    at = np.flatnonzero(counts)
    value = np.sqrt(counts[at])
    # hashed like n-grams: steps of the shares of the most frequent n-gram and of the different ones
    shape = np.array([counts.max() / len(h), min(1.0, len(at) / np.sqrt(len(h)) / 8)])
    steps = (shape * 10).astype(np.uint64) + np.arange(2, dtype=np.uint64) * np.uint64(100)
    extra = (grams.mixed(steps + np.uint64(1 << 40)) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.concatenate([at, extra]), np.concatenate([value / np.linalg.norm(value), [0.3, 0.3]])


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by full-batch AdaGrad; weights and bias."""
    doc = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
    at = np.concatenate([a for a, _ in rows])
    value = np.concatenate([v for _, v in rows])
    w, b = np.zeros(1 << BITS), 0.0
    sum_w, sum_b = np.full(1 << BITS, 1e-8), 1e-8
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, value * w[at], len(rows)) + b, -500, 500)))
        slope = (p - target) / len(rows)
        grad = np.bincount(at, value * slope[doc], 1 << BITS) + 1e-6 * w
        sum_w += grad**2
        sum_b += slope.sum() ** 2
        w -= 0.5 * grad / np.sqrt(sum_w)
        b -= 0.5 * slope.sum() / np.sqrt(sum_b)
    return w, b


def fit(docs: DataFrame, fit_texts: int = FIT_TEXTS) -> tuple[dict, np.ndarray, float]:
    """Estimated chances of votes by class and the scorer's weights and bias, from rows (doc_id, text)."""
    votes = F.pandas_udf(voted, "string")("text").alias("votes")
    counted = docs.select(votes).groupBy("votes").agg(F.count(F.lit(1)).alias("n")).orderBy("votes").collect()
    if not counted:
        return {}, np.zeros(1 << BITS), 0.0
    patterns, counts = patterns_of(r["votes"] for r in counted), np.array([float(r["n"]) for r in counted])
    share, chances = estimate(patterns, counts)
    sample = sampled(docs.select("doc_id", "text"), fit_texts).select("text", votes)

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            each = [features(t) for t in batch["text"]]
            mine = posterior(patterns_of(batch["votes"]), share, chances)
            yield pd.DataFrame({"at": [a.astype(np.int32).tobytes() for a, _ in each], "value": [v.astype(np.float32).tobytes() for _, v in each], "target": mine})

    got = sorted(sample.mapInPandas(featured, "at binary, value binary, target double").collect())
    vectors = [(np.frombuffer(r["at"], np.int32).astype(np.int64), np.frombuffer(r["value"], np.float32).astype(np.float64)) for r in got]
    w, b = train(vectors, np.array([r["target"] for r in got])) if got else (np.zeros(1 << BITS), 0.0)
    model = {"share": share, "names": LABELLERS, "chances": chances}
    return model, w, b


def score(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """Add quality (0 to 1) to each row."""
    held = docs.sparkSession.sparkContext.broadcast((weights, bias))

    @F.pandas_udf("double")
    def rated(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, b = held.value
        for texts in batches:
            out = []
            for text in texts:
                at, value = features(text)
                out.append(float(1 / (1 + np.exp(-np.clip(value @ w[at] + b, -500, 500)))) if len(at) else 0.0)
            yield pd.Series(out, dtype="float64")

    rows = packed(docs, F.col("text").alias("__text")).withColumn("__quality", rated("__text"))
    return rows.select(*unpacked(rows, "quality"), F.col("__quality").alias("quality"))


def op8_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    _, weights, bias = fit(docs)
    return score(docs, weights, bias).select("doc_id", "quality", (F.col("quality") >= KEEP).alias("kept"))
