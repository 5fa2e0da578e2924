"""Language identification and quality, on invented texts."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import common, grams, langid, quality

SOUNDS = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["ŝe", "ru", "vo", "pa"], "cc": ["αβ", "γδ", "εη"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [(i, text(rng, lang, rng.randrange(3, 60)), lang, "s") for i in range(240) for lang in [rng.choice(list(SOUNDS))]]


SCHEMA = "doc_id long, text string, lang string, Score string"


def test_languages_of_held_out_texts(spark, rows):
    docs = spark.createDataFrame(rows + [(900, None, "aa", "s"), (901, "12 !?", "aa", "s"), (902, rows[0][1], None, "s"), (None, rows[0][1], rows[0][2], "s"), (903, "ka " * 50_000, "aa", "s")], SCHEMA)
    model = langid.fit(docs.filter(~langid.held_out()))
    result = langid.predict(docs, model)
    assert result.columns == ["doc_id", "text", "lang", "lang_pred", "score", "support"]
    got = result.collect()
    assert len(got) == len(rows) + 5
    told = {r.doc_id: r for r in got}
    assert np.mean([told[i].lang_pred == lang for i, _, lang, _ in rows]) > 0.98
    assert (told[900].lang_pred, told[900].score) == (told[901].lang_pred, told[901].score) == ("und", 0.0)
    assert told[903].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None, "s")], SCHEMA)
    model = langid.fit(docs)
    assert [r.lang_pred for r in langid.predict(docs, model).collect()] == ["und"]
    assert langid.predict(docs.limit(0), model).count() == 0


def filters_of(spark, keys, langs, bits):
    rows = spark.createDataFrame([(int(n), int(k)) for n, k in zip(langs, keys.view(np.int64), strict=True)], "number long, key long")
    slots = np.zeros((2, 1 << bits), np.uint64)
    for r in langid.slots_of(rows, bits).collect():
        slots[r.word, r.slot] = r.mask % 2**64
    return slots


def test_bitmasks_equal_one_filter_a_language(spark):
    rng = np.random.default_rng(1)
    keys, langs = rng.integers(0, 2**64, 3000, dtype=np.uint64), rng.integers(0, 70, 3000)
    model = langid.Filters([f"l{i:02}" for i in range(70)], filters_of(spark, keys, langs, 14))
    asked = np.concatenate([keys[:200], rng.integers(0, 2**64, 200, dtype=np.uint64)])
    for lang in range(70):
        held = [set(p[langs == lang].tolist()) for p in model.probes(keys)]
        slots = held[0] | held[1]
        assert model.false_rate[lang] == (len(slots) / 2**14) ** 2
        raw = np.mean([all(int(p[k]) in slots for p in model.probes(asked)) for k in range(len(asked))])
        want = max(0, (raw - model.false_rate[lang]) / (1 - model.false_rate[lang]))
        assert model.shares(asked)[lang] == pytest.approx(want)


def text_grams(t):
    """n-grams of a text's words with a gap at either end, gaps inside none."""
    line = "\0" + "\0".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + "\0"
    return {line[i : i + n] for n in langid.SIZES for i in range(len(line) - n + 1) if "\0" not in line[i + 1 : i + n - 1]}


def test_model_and_predictions_against_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.fit(docs)
    share, langs = {}, sorted({r[2] for r in rows})
    for lang in langs:
        own = [text_grams(t) for _, t, k, _ in rows if k == lang]
        for g in set().union(*own):
            share.setdefault(g, {})[lang] = sum(g in x for x in own) / len(own)
    keys = [g for g in share]
    number = {g: grams.hashes(np.array([ord(c) for c in g], np.uint64), (len(g),))[0] for g in keys}
    chosen = [(langs.index(lang), number[g]) for g in keys for lang, v in share[g].items() if v >= max(share[g].values()) * langid.SHARE]
    want = np.zeros_like(model.slots)
    for lang, key in chosen:
        for probe in model.probes(np.array([key])):
            want[0, probe[0]] |= np.uint64(1 << lang)
    np.testing.assert_array_equal(model.slots, want)
    for r in langid.predict(docs, model).limit(60).collect():
        line = grams.letter_line(r.text)
        at = [[int(p[0]) for p in model.probes(np.array([k]))] for k in grams.hashes(line, langid.SIZES)]
        raw = np.array([np.mean([all(int(want[0, p]) >> lang & 1 for p in a) for a in at]) for lang in range(len(langs))])
        fixed = np.maximum(0, (raw - model.false_rate) / (1 - model.false_rate))
        assert r.lang_pred == langs[int(fixed.argmax())] and r.score == pytest.approx(fixed.max() / fixed.sum()) and r.support == pytest.approx(fixed.max())


@pytest.mark.parametrize("hot", [7, None])
def test_one_doc_id_on_all_rows_neither_empties_nor_overfills_the_sample(spark, hot):
    docs = spark.createDataFrame([(hot, f"text {i}", "ab"[i % 3 == 0]) for i in range(3000)], "doc_id long, text string, lang string")
    got = common.sampled(docs, 400, F.col("lang")).groupBy("by").count().collect()
    assert {r.by: r["count"] for r in got} == {"a": 400, "b": 400}


def test_any_number_of_languages(spark):
    letters = "abcdefghijklmnopqrst"
    word = lambda k: "".join(letters[(k // 20**i) % 20] * (i + 1) for i in range(3))
    rows = [(1000 * k + i, f"{word(k)} {word(k)}x{letters[i]} y{word(k)}", f"l{k:03}") for k in range(300) for i in range(3)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 300 and model.slots.shape[0] == 5
    assert [model.predict(f"{word(k)} {word(k)}")[0] for k in (0, 63, 64, 200, 299)] == [f"l{k:03}" for k in (0, 63, 64, 200, 299)]


def test_letter_lines():
    line = grams.letter_line("Ab-3 cd")
    assert line.tolist() == [0, 97, 98, 0, 99, 100, 0]
    assert len(grams.letter_line("12 -")) == 0 and len(grams.hashes(grams.letter_line(""), (3, 4))) == 0


def brute_votes(text):
    text = text or ""
    words = [w for w in re.split(r"[\s!-/:-@\[-`{-~]+", text.lower()) if w]
    chars, n = max(1, len(text)), max(1, len(words))
    vote = lambda bad, good: 0 if bad else 1 if good else -1
    enough = len(words) >= 20
    marks, capitals = sum(c in quality.SYMBOLS for c in text), sum("A" <= c <= "Z" for c in text)
    variety, again = len(set(words)) / n**0.5, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    known, stops = sum(w in quality.FUNCTION_WORDS for w in words) / n, text.count(".") / n
    plain = len(re.findall(r"[^\W\d_][.,;:?!]?(?=\s|$)", text)) / n
    return [
        vote(marks / chars > 0.02, marks / chars < 0.004), vote(enough and capitals / chars > 0.2, capitals / chars < 0.1), vote(enough and variety < 2.5, enough and variety > 4),
        vote(enough and again > 0.2, enough and again < 0.05), vote(enough and known < 0.04, known > 0.12), vote(enough and (stops < 0.01 or stops > 0.5), enough and 0.02 < stops < 0.3),
        vote(marks / n > 0.15, marks / n < 0.03), vote(enough and plain < 0.8, enough and plain > 0.95),
    ]


def test_votes_against_brute_force(spark):
    rng = random.Random(8)
    pieces = ["the ", "la ", "Ärger", "x. ", "stone ", "%%", "\n", "AB ", "é, ", "7", "it it ", "word! ", "\t", "中文 ", "a_b "]
    texts = [None, "", " ", ".", "a", "the"] + ["".join(rng.choice(pieces[: rng.randrange(1, 16)]) for _ in range(rng.randrange(1, 90))) for _ in range(400)] + ["the stone. " * 200_000]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.pandas_udf(quality.voted, "string")("text").alias("v")).collect()
    for r in got:
        assert quality.patterns_of([r.v])[0].tolist() == brute_votes(r.text)


def test_scores_are_those_of_the_linear_model(spark):
    rng = np.random.default_rng(3)
    w, b = rng.normal(size=1 << quality.BITS), 0.3
    texts = ["", "ab", "a river of stones", "%%% " * 40, "x" * 100_000]
    for r in quality.score(spark.createDataFrame([(t,) for t in texts], "text string"), w, b).collect():
        at, value = quality.features(r.text)
        assert r.quality == pytest.approx(1 / (1 + np.exp(-(sum(v * w[i] for i, v in zip(at, value, strict=True)) + b))) if len(r.text) >= 3 else 0.0)


def test_em_finds_accuracies():
    rng = np.random.default_rng(5)
    good = rng.random(20_000) < 0.8
    chance_good, chance_bad = np.array([0.99, 0.98, 0.97, 0.99]), np.array([0.3, 0.2, 0.4, 0.5])
    votes = (rng.random((20_000, 4)) < np.where(good[:, None], chance_good, chance_bad)).astype(int)
    votes[rng.random(votes.shape) < 0.2] = -1
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    share, chances = quality.estimate(patterns, counts.astype(float))
    assert abs(share - 0.8) < 0.03 and np.abs(chances[1] - chance_good).max() < 0.03 and np.abs(chances[0] - chance_bad).max() < 0.06
    told = quality.posterior(patterns, share, chances)[at.reshape(-1)] > 0.5
    assert (told == good).mean() > 0.95


def test_quality_of_plain_and_broken_texts(spark):
    rng = random.Random(1)
    vocab = ["river", "house", "green", "walks", "the", "of", "and", "to", "was", "a", "bird", "seven", "stones", "over", "under", "night"]
    plain = lambda: ". ".join(" ".join(rng.choice(vocab) + rng.choice("abcdefgh") * rng.randrange(2) for _ in range(9)) for _ in range(rng.randrange(4, 12))) + "."
    broken = lambda: rng.choice([" ".join(w + rng.choice(["%%%", "***", "&&&"]) for w in plain().split()), plain().upper().replace(" ", "!! "), (rng.choice(vocab) + " ") * 200])
    rows = [(i, plain() if i % 5 else broken(), "x") for i in range(500)] + [(900, None, "x"), (901, "", "x"), (1, "same", "x"), (1, "same", "x"), (903, "stones walk over the river. " * 20_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, votes string").withColumn("Quality", F.lit("x"))
    model, w, b = quality.fit(docs)
    got = {r.doc_id: r.quality for r in quality.score(docs, w, b).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(i % 5) for i in range(2, 500)]) > 0.97
    assert got[900] == got[901] == 0.0 and 0.5 < model["share"] < 1
    empty, w0, b0 = quality.fit(docs.limit(0))
    assert empty == {} and quality.score(docs.limit(0), w0, b0).count() == 0


@pytest.mark.parametrize("hot", [7, None])
def test_the_scorer_is_fit_on_a_bounded_sample_whatever_repeats(spark, monkeypatch, hot):
    rows = [(hot, f"the {i} stones of a river") for i in range(700)] + [(hot, "the same")] * 1300 + [(100 + i, f"a {i} green house") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fitted, train = [], quality.train
    monkeypatch.setattr(quality, "train", lambda vectors, target: fitted.append(len(vectors)) or train(vectors, target))
    quality.fit(docs, 200)
    assert fitted == [200]
    got = common.sampled(docs, 200).collect()
    assert len(got) == 200 and 60 < sum(r.doc_id == hot for r in got) < 140 and 35 < sum(r.text == "the same" for r in got) < 95
    assert sorted([r[:2] for r in common.sampled(docs.limit(5), 200).collect()], key=str) == sorted(map(tuple, docs.limit(5).collect()), key=str)
