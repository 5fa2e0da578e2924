"""Source divergence, token files and importance resampling."""

import hashlib
import json
import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rasterloom.llm import divergence, resampling, token_files
from rasterloom.llm.common import fresh_path
from rasterloom.llm.words import norm_words

WORD_BPE, BYTE_BPE = (str(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))

# ---- source divergence


def divergence_by_hand(rows, least_docs, top):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    held, groups = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        held[lang].update(set(words))
        groups[lang, source].update(words)
    out = set()
    for lang in held:
        kept = [t for t, n in held[lang].items() if n >= least_docs]
        own = {s: {t: c[t] for t in kept} for (g, s), c in groups.items() if g == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}

        def shares(counts, v=len(kept)):
            return {t: 1 + 1_000_000_000 * (n + 5) // (sum(counts.values()) + 5 * v) for t, n in counts.items()}

        p, q = {s: shares(c) for s, c in own.items()}, shares(whole)
        for s in own:
            apart = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in own if o != s]
            more = [(q[t] - p[s][t], t.encode(), t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(apart)), ("term", sorted(more)[:top])):
                out |= {(lang, s, part, item, -value, i + 1) for i, (value, _, item) in enumerate(found)}
    return out


DOCS = "text string, lang string, source string, term int, rank string, n int, P int"


def audited(spark, rows, **options):
    df = divergence.audit(spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], DOCS), **options)
    got = [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_divergence_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("cat", "Ünder", "straße", "İx", "日本", "z") for b in ("", "s", "ÉE", "😀")] + ["A1b2", "x_y", "don't", "ﬁ"]
    rows = []
    for _ in range(300):
        lang = rng.choice(["en", "de", None, "", "few"])
        source = rng.choice(["s1", "s2", None, "é", "z"]) if lang != "few" else rng.choice("abc")
        n = rng.choice([0, 1, 5, 30])
        rows.append((rng.choice([None, "", "... 12"]) if not n or (lang == "few" and rng.random() < 0.9) else " ".join(rng.choice(words) for _ in range(n)), lang, source))
    rows += [("one two one", "en", "hot")] * 90 + [("lonely " * 40, "xx", "only")] * 12
    for least, top in ((10, 50), (25, 3)):
        want = divergence_by_hand(rows, least, top)
        assert audited(spark, rows, least_docs=least, top=top) == want
    assert {r[2] for r in want if r[0] == "few"} == {"pair"} and {r[4] for r in want if r[0] == "few"} == {0}
    assert not [r for r in want if r[0] == "xx" and r[2] == "pair"]


def test_divergence_of_nothing_and_of_a_very_long_text(spark):
    assert audited(spark, []) == set()
    assert audited(spark, [(None, None, None), ("", "", "b")], least_docs=1) == {("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)}
    rows = [("word " * 400_000, "en", "a"), ("x" * 1_000_000 + " word", "en", "b")]
    assert audited(spark, rows, least_docs=1) == divergence_by_hand(rows, 1, 50)


def test_shares_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    n, total, kept = 7_777_777_777_777, 123_456_789_012_345_678, 1_234_567
    row = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(kept).cast("long")).alias("p")).first()
    assert row.p == 1 + 1_000_000_000 * (n + 5) // (total + 5 * kept)


# ---- token files

TEXTS = [
    None, "", " ", "Hello, World! it's  fine\n\nnew\r\nline\ttab", "é ́x ạ́ ạ́", "ΑΣ ΣΑΣ. Σ", "İstanbul STRASSE ﬁn", "日本語 テスト 한국어",
    "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|> <|endof text|>", "\x1c!\x1c \x00  x y　z", "😀👩‍👩‍👧 !!! ### 12345 1½ ²", "don't WE'LL x's 'S", "a" * 3000, "word " * 5000,
]


def library_ids(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def written(spark, rows, path=WORD_BPE, schema="doc_id long, text string, ids int, START string"):
    folder = fresh_path(spark, "ids")
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], schema)
    token_files.write_ids(df, path, folder)
    return folder, sorted(token_files.read_ids(spark, folder).collect(), key=lambda r: r.start)


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_token_files_hold_what_the_library_gives(spark, path):
    rows = [(i * 7 % 31, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (5, "again"), (5, "again"), (5, "other"), (-3, "first")]
    folder, got = written(spark, rows, path)
    want = {(d, tuple([*ids, 2])) for (d, _), ids in zip(rows, library_ids(path, [t for _, t in rows]), strict=True)}
    assert len(got) == len(rows) and {(r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got} == want
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got]).tolist()[:-1]] and all(r.n_tokens * 4 == len(r.ids) for r in got)
    # the files by themselves
    files = token_files.manifest(spark, folder).orderBy("base_docs").collect()
    flat = np.concatenate([np.memmap(f.file.removeprefix("file://") + ".bin", f"<u{f.width}", "r") for f in files])
    assert flat.tolist() == [x for r in got for x in np.frombuffer(r.ids, "<u4").tolist()] and {f.width for f in files} == {2}
    ends = [f.base_tokens + e for f in files for e in np.memmap(f.file.removeprefix("file://") + ".idx", token_files.ENTRY, "r")["end"].tolist()]
    assert ends == [r.start + r.n_tokens for r in got]


def test_token_files_of_nothing_and_of_one_frequent_row(spark):
    folder, got = written(spark, [])
    assert got == [] and token_files.manifest(spark, folder).count() == 0
    folder, got = written(spark, [(7, "same text")] * 400 + [(1, "x")])
    assert len(got) == 401 and len({r.ids for r in got}) == 2 and got[0].doc_id == 1
    assert token_files.manifest(spark, folder).count() > 1


def test_ranges_and_batches_of_a_file(spark, monkeypatch):
    folder, got = written(spark, [(i, "w " * (i % 5)) for i in range(100)])
    monkeypatch.setattr(token_files, "RANGE", 7)
    again = sorted(token_files.read_ids(spark, folder).collect(), key=lambda r: r.start)
    assert again == got


def test_words_may_be_encoded_one_by_one_only_where_white_space_is_dropped(monkeypatch):
    specs = {p: open(p, encoding="utf-8").read() for p in (WORD_BPE, BYTE_BPE)}
    assert token_files.uses_words(json.loads(specs[WORD_BPE])) and not token_files.uses_words(json.loads(specs[BYTE_BPE]))
    word = json.loads(specs[WORD_BPE])
    assert token_files.cuts_marks(word) and not token_files.cuts_marks(word | {"normalizer": None}) and not token_files.cuts_marks(word | {"pre_tokenizer": {"type": "WhitespaceSplit"}})
    # the same vocabulary where marks belong to words
    other = json.dumps(word | {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, word["pre_tokenizer"]["pretokenizers"][1]]}})
    texts = ["one, two. Three!! (four) don't", "a,b ,c", ""]
    assert [np.frombuffer(i, "<u2").tolist() for i in token_files.Encoder(other).encode(texts)] == [e.ids for e in Tokenizer.from_str(other).encode_batch(texts, add_special_tokens=False)]
    rng = random.Random(8)
    alphabet = "abE's  \n\r\t\u0323\u0301 \u03a3\u00df\u0130\u212b1!,.)(<|>\u00e9\u65e5\U0001f600"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(2000)] + [t or "" for t in TEXTS]
    encoder, want = token_files.Encoder(specs[WORD_BPE]), library_ids(WORD_BPE, texts)
    for piece, kept in ((1 << 20, 500_000), (5, 500_000), (64, 20)):
        monkeypatch.setattr(token_files, "PIECE", piece)
        monkeypatch.setattr(token_files, "KEPT", kept)
        assert [np.frombuffer(ids, "<u2").tolist() for ids in encoder.encode(texts)] == want
        assert [np.frombuffer(encoder.encode([t])[0], "<u2").tolist() for t in texts[-30:]] == want[-30:]
    assert all("".join(token_files.pieces(t, n)) == t for t in texts for n in (1, 3, 50))


def test_letters_and_marks_are_cut_apart_only_where_the_library_does():
    # letters that become a letter and a mark, capitals that stay apart from an accent, lower case of two characters, added tokens in both cases
    texts = ["\u0958! \u0958\u0958, a\u0958.", "J\u030c J\u030c! j\u030c. A\u0338!", "\u0130! I\u0307, \u0131.", "\u03a3.\u0391 \u0391\u03a3.", "Foo<|endoftext|>, Bar! <|ENDOFTEXT|>. x", "don't, 'S. \u00c9T\u00c9!? \u00f7! a\u00d7."]
    texts += [f"{c}! A{c}. a{c}b, {c}{c}" for c in map(chr, range(0x80, 0x3000))]
    encoder = token_files.Encoder(open(WORD_BPE, encoding="utf-8").read())
    assert [np.frombuffer(ids, "<u2").tolist() for ids in encoder.encode(texts)] == library_ids(WORD_BPE, texts)


def test_a_worker_holds_no_more_after_many_different_words():
    # in a process of its own, whose memory nothing else has grown
    code = f"""
import random
from rasterloom.llm import token_files

def held():
    return sum(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith(("Pss_Anon", "Pss_Shmem"))) >> 10

rng = random.Random(3)
encoder = token_files.Encoder(open({WORD_BPE!r}, encoding="utf-8").read())
for k in range(12):
    encoder.encode([" ".join("".join(rng.choices("aeioulnrst", k=9)) for _ in range(50_000))])
    if k == 2:
        before = held()
print(held() - before)
"""
    grown = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)})
    assert int(grown.stdout) < 40


# ---- importance resampling


def features(text):
    words = norm_words(text)
    return len(words), [b" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def resampled_by_hand(docs, target, buckets, percent, least):
    def totals(texts):
        return Counter(zlib.crc32(f) % buckets for t in texts for f in features(t)[1])

    s, t = totals(x for _, x in docs), totals(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    rows = []
    for d, text in docs:
        n, own = features(text)
        h = int(hashlib.sha256(f"42:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(f) % buckets] for f in own)
        rows.append((d, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(fit[: percent * len(fit) // 100])}
    return Counter((*r, rank.get(id(r))) for r in rows)


def some_text(rng, n):
    return rng.choice([" ", "\n", ", "]).join(rng.choice(["the", "Cat", "é", "日本", "x1", "ÄÖ", "w" * 90, "v" * 63, "u" * 64]) for _ in range(n))


def test_resampling_against_brute_force(spark):
    rng = random.Random(4)
    docs = [(i, some_text(rng, rng.choice([0, 1, 2, 3, 19, 20, 21, 300]))) for i in range(200)] + [(None, some_text(rng, 50)), (3, None), (900, "--- !"), (901, "a" * 500_000)]
    target = [some_text(rng, 40) for _ in range(20)] + [None, ""]
    df = spark.createDataFrame([(*d, 1, "x", 2.0) for d in docs], "doc_id long, text string, rank int, SCORE string, bucket double").repartition(5)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    for buckets, percent, least in ((10_000, 5, 20), (7, 50, 1)):
        out = resampling.resample(df, bench, percent=percent, least_words=least, buckets=buckets)
        assert out.columns == ["doc_id", "bucket", "n_words", "n_features", "weight", "score", "rank"]
        got = Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in out.collect())
        assert got == resampled_by_hand(docs, target, buckets, percent, least)


def test_resampling_ties_repeats_and_empty_tables(spark):
    bench = spark.createDataFrame([("some target words",)], "text string")
    one = "a b c d e f g h i j k l m n o p q r s t u"
    df = spark.createDataFrame([(5, one)] * 30 + [(6, None)], "doc_id long, text string")
    got = resampling.resample(df, bench, percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 16)) and len(got) == 31
    empty = df.limit(0)
    assert resampling.resample(empty, bench).collect() == []
    alone = resampling.resample(df, empty).collect()
    assert len(alone) == 31 and len({r.weight for r in alone if r.doc_id == 5}) == 1


@pytest.mark.parametrize(("chunk", "piece", "kept"), [(3, 1 << 20, 10), (50, 40, 3), (1 << 19, 7, 500_000)])
def test_tries_go_on_where_a_long_text_was_cut(monkeypatch, chunk, piece, kept):
    monkeypatch.setattr(resampling, "CHUNK", chunk)
    monkeypatch.setattr(resampling, "PIECE", piece)
    monkeypatch.setattr(resampling, "KEPT", kept)
    rng = random.Random(6)
    texts = [some_text(rng, rng.choice([0, 1, 2, 3, 100, 400])) for _ in range(60)] + [None, "no-blank," * 50]
    buckets = 211
    gain = np.array([rng.randrange(-9000, 9000) for _ in range(buckets)], np.float64)
    words, totals = resampling.Words(), np.zeros(buckets, np.int64)
    n, weight = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for trie in resampling.tries(words, texts):
        totals += trie.totals(buckets)
        more, sums = trie.weights(gain, len(texts))
        n, weight = n + more, weight + sums
    own = [features(t) for t in texts]
    want = Counter(zlib.crc32(f) % buckets for _, fs in own for f in fs)
    assert totals.tolist() == [want[b] for b in range(buckets)]
    assert n.tolist() == [k for k, _ in own] and weight.tolist() == [sum(int(gain[zlib.crc32(f) % buckets]) for f in fs) for _, fs in own]
