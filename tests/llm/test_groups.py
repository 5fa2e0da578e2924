"""Sharding, mixing, embeddings, near-duplicates, components and the pipeline."""

import math
import random
import re
import struct
import time
import zlib
from collections import Counter
from datetime import datetime
from hashlib import md5

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rasterloom.llm import common, components, embeddings, mixing, near_dup, sharding
from rasterloom.llm.words import norm_words


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 97, 1000])
def test_permutation_is_one(spark, n):
    rows = spark.range(n).withColumnRenamed("id", "row")
    got = [r.position for r in sharding.permute(rows, "row", n, seed=5).orderBy("row").collect()]
    assert sorted(got) == list(range(n))
    again = [r.position for r in sharding.permute(rows, "row", n, seed=5).orderBy("row").collect()]
    assert got == again and (n < 50 or got != sorted(got))
    if n >= 97:
        other = [r.position for r in sharding.permute(rows, "row", n, seed=6).orderBy("row").collect()]
        assert other != got


DOCS = [(i, f"text {i % 40} é", "v") for i in range(203)] + [(7, None, "v"), (None, "", "v"), (9, "same", "v"), (9, "same", "v"), (9, "x" * 200_000, "v")]


def spark_hash(*values):
    """Spark's xxhash64 of longs (as int), ints (as (int,)) and strings."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<i", *v) if isinstance(v, tuple) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def brute_position(x, n, seed):
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    while True:
        left, right = divmod(x, b)
        for i in range(8):
            if i % 2 == 0:
                left = (left + spark_hash(right, (i,), (seed,)) % a) % a
            else:
                right = (right + spark_hash(left, (i,), (seed,)) % b) % b
        x = left * b + right
        if x < n:
            return x


def brute_places(rows):
    """doc_id, checksum, shard and slot of each row: numbered by (doc_id, hash of the text), nulls first, and permuted row by row."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, 42 if r[1] is None else spark_hash(r[1])))
    spots = [brute_position(k, len(order), 20240501) for k in range(len(order))]
    return sorted((str(r[0]), zlib.crc32((r[1] or "").encode()), p % 8, p // 8) for r, p in zip(order, spots, strict=True))


def test_shards_are_even_gapless_and_reproducible(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, Slot string").withColumn("__part", F.lit(3)).withColumn("row", F.lit(1))
    result = sharding.shard(docs)
    assert result.columns[:4] == ["doc_id", "text", "__part", "row"] and result.columns.count("slot") == 1 and "Slot" not in result.columns
    got = result.collect()
    assert len(got) == len(DOCS)
    by = [sorted(r.slot for r in got if r.shard == k) for k in range(8)]
    assert all(s == list(range(len(s))) for s in by) and max(map(len, by)) - min(map(len, by)) <= 1
    for r in got:
        data = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
    place = lambda df, **k: sorted((str(r.doc_id), r.text_crc32, r.shard, r.slot) for r in sharding.shard(df, **k).collect())
    assert place(docs) == place(docs.repartition(7), keep_text=False)
    assert sorted((str(r.doc_id), r.text_crc32, r.shard, r.slot) for r in got) == brute_places(DOCS)
    assert sharding.shard(docs.limit(0)).count() == 0


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    rest, demand, done = set(names), 1.5 * sum(sizes.values()), {}
    while rest:
        level = demand / sum(w[s] for s in rest)
        full = {s for s in rest if level * w[s] > 2 * sizes[s]}
        if not full:
            return done | {s: level * w[s] for s in rest}
        done |= {s: 2.0 * sizes[s] for s in full}
        demand -= sum(2 * sizes[s] for s in full)
        rest -= full
    return done


def mixed_rows(seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "b", "ä", "Z", "", None]) if i % 3 else "hot", " ".join(["w"] * rng.randrange(0, 40)), "z") for i in range(600)]
    return rows + [(4, "b", None, "z"), (5, "one", "w", "z"), (None, "a", "w w\x1fw\u00a0w", "z"), (9, "hot", "w w", "z"), (9, "hot", "w w", "z"), (10, "long", "w " * 20_000, "z")]


def test_mix_reaches_targets_and_repeats_no_document_more_than_twice(spark):
    rows = mixed_rows()
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, Target string").withColumn("class", F.lit(1)).withColumn("h1", F.lit("z")).withColumn("size", F.lit(9))
    result = mixing.assign(docs)
    assert result.columns == ["doc_id", "source", "text", "class", "h1", "size", "source_size", "target", "copies", "positions"]
    got = result.collect()
    assert len(got) == len(rows) and all(r.size == len([w for w in re.split("[ \t\n\x0b\x0c\r]", r.text or "") if w]) for r in got)
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = brute_targets(sizes)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert all(r.target == pytest.approx(want[s]) and r.source_size == sizes[s] for r in own)
        taken = sum(r.copies * r.size for r in own)
        assert abs(taken - want[s]) <= max(r.size for r in own) / 2 + 1e-6
    assert all(r.copies in (0, 1, 2) and list(r.positions) == sorted(r.positions) and all(0 <= p <= 1 for p in r.positions) for r in got)
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, mixing.assign(docs.repartition(9)).collect()))
    assert mixing.assign(docs.limit(0)).count() == 0


def brute_copies(rows):
    """(doc_id, size) and how often each is taken: rows (doc_id, source, size) in hash order, by the middles below the target."""
    total = Counter()
    for _, source, size in rows:
        total[source] += size
    want, out = brute_targets(total), Counter()
    for s in total:
        at = 0
        for i, _, size in sorted((r for r in rows if r[1] == s), key=lambda r: (md5(("null" if r[0] is None else str(r[0])).encode()).hexdigest(), r[0] or 0, r[2])):
            out[i, size] += sum(2 * k * total[s] + 2 * at + size < 2 * want[s] for k in (0, 1))
            at += size
    return out


def test_mix_against_brute_force_where_one_doc_id_holds_most_rows(spark):
    rows = [(None, "a", k % 7) for k in range(1500)] + [(3, "a", 5)] * 1200 + [(k, "bc"[k % 2], 1 + k % 11) for k in range(200)] + [(k, None, 2) for k in range(50)]
    got = mixing.plan(spark.createDataFrame(rows, "doc_id long, source string, n int"), F.col("n")).collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        taken[r.doc_id, r.size] += len(r.positions)
    assert taken == brute_copies(rows)


def test_positions_follow_the_schedules(spark):
    docs = spark.createDataFrame([(i, s, 10) for i in range(4000) for s in ("a", "b", "c")], "doc_id long, source string, size long")
    rows = mixing.training_order(docs, F.col("size")).select("source", "position").toPandas()
    assert rows["position"].is_monotonic_increasing
    half = {s: float((g["position"] < 0.5).mean()) for s, g in rows.groupby("source")}
    # areas of the first half of 1, 2, 3 and 1, 1, 1 and 3, 2, 1
    assert half["a"] == pytest.approx(3 / 8, abs=0.02) and half["b"] == pytest.approx(1 / 2, abs=0.02) and half["c"] == pytest.approx(5 / 8, abs=0.02)


# ---- components and embeddings


def brute_components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["path", "random", "star", "none"])
def test_components(spark, kind):
    rng = random.Random(kind)
    links = {"path": [(i, i + 1) for i in range(120)], "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)], "star": [(500, i) for i in range(300)], "none": []}[kind]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute_components({x for p in links for x in p}, links)
    loops = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    assert got == {k: v for k, v in want.items() if k not in loops}


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base, base[:20] + rng.normal(scale=0.05, size=(20, 16)), base[:5] + rng.normal(scale=0.13, size=(5, 16)), np.repeat(base[:1], 30, 0) + rng.normal(scale=0.03, size=(30, 16)), base[3:4] * 7])
    rows = [(int(i), [float(f) for f in np.float32(v)], int(i % 2) if 0 < i < 40 else 0) for i, v in enumerate(x)]
    rows += [(500, None, 0), (501, [0.0] * 16, 0), (502, [float("nan")] * 16, 0), (503, [None] + [1.0] * 15, 0), (504, rows[0][1], None), (505, rows[0][1], 0), (506, rows[0][1], 0), (507, rows[0][1][:8], 0), (508, [float("inf")] + [1.0] * 15, 0), (509, [], 0)]
    rows += [(510, [1.0] * 15, 0), (511, [-0.0] + [1.0] * 15, 0), (512, [0.0] + [1.0] * 15, 0), (513, [1.0] * 15 + [None], 0)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    ok = [(i, np.array(v, float), lab) for i, v, lab in rows if lab is not None and v and all(f is not None and np.isfinite(f) for f in v) and any(v)]
    links = [(a[0], b[0]) for k, a in enumerate(ok) for b in ok[:k] if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.98]
    want = brute_components([r[0] for r in rows], links)
    assert len(links) > 100 and len(got) == len(rows)
    for i, r in got.items():
        assert (r.n_links, r.component_id, r.kept) == (sum(i in p for p in links), want[i], want[i] == i)


def test_components_that_lie_in_several_blocks(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(12, 16))
    x = np.concatenate([base.repeat(9, 0) + rng.normal(scale=0.06, size=(108, 16)), base[:1].repeat(60, 0) + rng.normal(scale=0.08, size=(60, 16))]).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.98).sum(1) - 1
    reps = common.number_rows(spark, embeddings.representatives(rows), [F.col("vec_id")], "id")[0]
    for block in (7, 64, 2048):
        counts, links = embeddings.link(reps, block=block)
        got = {r.id: r.links for r in counts.collect()}
        assert [got.get(i, 0) for i in range(len(x))] == want.tolist() and want.max() > 20
        tied = brute_components(range(len(x)), [tuple(r) for r in links.collect()])
        assert tied == brute_components(range(len(x)), [(i, j) for i in range(len(x)) for j in range(i) if unit[i] @ unit[j] >= 0.98])


def test_row_keys_tell_unlike_rows_apart(spark):
    kind = "a array<int>, b array<int>, s struct<x: int, y: int>, m map<string, int>, n array<struct<x: int, y: int>>, t timestamp"
    at = datetime(2020, 1, 1, 0, 0, 0, 1)
    some = [[1], [2], (1, 2), {"k": 1}, [(1, 2)], at]
    other = [([1, 2], []), ([1, None], [2]), ([None, 1], [2]), (None, [2]), ([], [2]), ([1], [])]
    rows = [some, *[[a, b, *some[2:]] for a, b in other]]
    rows += [[*some[:k], v, *some[k + 1 :]] for k, vs in {2: [(1, None), (None, 1), (None, None), None], 3: [{"k": None}, {}, None], 4: [[(1, None)], [(None, 1)], [None], []], 5: [None, at.replace(microsecond=2)]}.items() for v in vs]
    df = spark.createDataFrame([tuple(r) for r in [*rows, *rows]], kind)
    assert df.select(*common.row_key(df)).distinct().count() == len(rows)
    within = spark.createDataFrame([tuple(r) for r in rows], kind).select(F.struct("*").alias("all"), F.array(F.struct("t")).alias("deep"))
    assert within.select(*common.row_key(within)).distinct().count() == len(rows)


def test_vectors_of_an_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("dims", [2, 16, 64])
def test_pairs_at_the_threshold_share_a_table_and_spread_ones_rarely_do(dims):
    rng, radius = np.random.default_rng(5), math.sqrt(0.04)
    x = rng.normal(size=(2000, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    by = embeddings.tables([(5000, embeddings.distances(x[:256], radius))], dims, radius)
    if dims == 2:  # 5000 vectors on a circle lie too close together for any table
        assert by is None
        return
    a, b = (embeddings.codes(v, by, radius) for v in (x, y))
    shared = (a == b).mean()
    assert (a == b).any(axis=1).all() and shared == pytest.approx(embeddings.near_share(dims, radius, by.cell) ** by.depth, rel=0.1)
    if dims == 64:
        other = (a == np.roll(b, 1, axis=0)).any(axis=1)
        assert other.mean() < 0.01
        assert embeddings.tables([(10**8, embeddings.distances(x[:256], radius))], dims, radius).many < 8 * by.many


def leaning(n, mean_cosine, dims=64, seed=4):
    """Vectors around one direction, so that two of them have this cosine on average."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    x = math.sqrt(1 - mean_cosine) * x / np.linalg.norm(x, axis=1, keepdims=True)
    x[:, 0] += math.sqrt(mean_cosine)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("mean_cosine", [0.0, 0.3, 0.5, 0.7])
def test_tables_follow_the_distances_of_a_label(mean_cosine):
    radius = math.sqrt(0.04)
    x = leaning(3000, mean_cosine)
    y = x + np.random.default_rng(3).normal(scale=0.2 / 8 * 0.9, size=x.shape)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    linked = (x * y).sum(1) >= 0.98
    by = embeddings.tables([(len(x), embeddings.distances(x[:256], radius))], 64, radius)
    a, b = (embeddings.codes(v, by, radius) for v in (x, y))
    assert linked.mean() > 0.5 and (a == b).any(axis=1)[linked].mean() >= 0.999
    # by chance a vector meets few others in any of its tables
    met = sum((a[:, None, t] == a[None, :300, t]).sum() - 300 for t in range(by.many))
    assert met / 300 < 4 * embeddings.CHANCE
    # the second round verifies few pairs
    ways = embeddings.directions(64)
    near = embeddings.collisions(x[:1000] @ ways, x[1000:2000] @ ways, embeddings.WIDTH * radius / 8) >= embeddings.needed()
    assert near.mean() < 0.05


@pytest.mark.parametrize("mean_cosine", [0.0, 0.7])
def test_both_ways_to_compare_give_all_links(spark, monkeypatch, mean_cosine):
    x = leaning(1500, mean_cosine)
    x = np.concatenate([x, x[:200] + np.random.default_rng(1).normal(scale=0.02, size=(200, 64))]).astype(np.float32)
    label = np.arange(len(x)) % 100 // 50
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    rows = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<float>, label int")
    for pair, used in ((1.0, 1), (0.0, 0)):
        monkeypatch.setattr(embeddings, "PAIR", pair)
        slim = embeddings.representatives(rows).withColumn("kind", F.xxhash64("label"))
        assert len(embeddings.planned(slim, math.sqrt(0.04))) == used
        got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(rows).collect()}
        assert [got[i] for i in range(len(x))] == (true.sum(1) - 1).tolist()


def test_spread_vectors_of_one_label_meet_few_others(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(6000, 64))
    x = np.concatenate([base, base[:50] + rng.normal(scale=0.05, size=(50, 64))]).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    reps = common.number_rows(spark, embeddings.representatives(rows), [F.col("vec_id")], "id")[0]
    counts, _ = embeddings.link(reps)
    assert counts.count() == 100 and counts.agg(F.max("links")).first()[0] == 1


def test_collision_counts():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(30, 7)), rng.normal(size=(25, 7))
    want = (np.abs(a[:, None, :] - b[None, :, :]) <= 0.5).sum(2)
    np.testing.assert_array_equal(embeddings.collisions(a, b, 0.5), want)
    assert embeddings.needed() < embeddings.PROJECTIONS


# ---- near-duplicates


def test_registers_estimate_weighted_similarity():
    rng = np.random.default_rng(9)
    key = np.arange(1, 400, dtype=np.uint64) * np.uint64(2654435761)
    x, y = rng.integers(1, 6, 399), rng.integers(1, 6, 399)
    x[:80], y[320:] = 0, 0
    want = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    seen = []
    for seed in range(6):
        k = near_dup.mixed(key + np.uint64(seed * 7919))
        bags = [(k[v > 0], v[v > 0]) for v in (x, y)]
        held = near_dup.bag_minhash(np.repeat([0, 1], [len(b[0]) for b in bags]), np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags]), 2)
        assert np.isfinite(held).all()
        seen.append((held[0] == held[1]).mean())
    assert np.mean(seen) == pytest.approx(want, abs=0.05)


def exact_similarity(a, b):
    from collections import Counter

    def bag(t):
        w = norm_words(t)
        n = min(5, len(w))
        return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else Counter()

    x, y = bag(a), bag(b)
    both, whole = sum((x & y).values()), sum((x | y).values())
    return both / whole if whole else 0.0


def copies(seed=11):
    """A hot group of copies each edited in some places, pairs of copies, repeated lines and lone texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(4))
    text = lambda n: [word() for _ in range(n)]

    def edited(w, n):
        w = list(w)
        for _ in range(n):
            w[rng.randrange(len(w))] = word()
        return w

    hot, out = text(120), []
    out += [" ".join(edited(hot, rng.randrange(0, 6))) for _ in range(150)]
    for _ in range(25):
        w = text(rng.choice([4, 6, 30, 300]))
        out += [" ".join(w), " ".join(edited(w, rng.randrange(3))).upper(), ", ".join(w)]
    line = " ".join(text(12))
    out += [" ".join([line] * n) for n in (3, 10, 11, 12)] + [" ".join(text(50)) for _ in range(20)]
    return out


def brute_groups(rows):
    """component_id of each row (doc_id, text): links between texts, not between doc_ids."""
    texts = {}
    for i, t in rows:
        if key := tuple(norm_words(t)):
            texts.setdefault(key, []).append(i)
    links = [(a, b) for k, a in enumerate(texts) for b in list(texts)[:k] if exact_similarity(b" ".join(a).decode(), b" ".join(b).decode()) >= 0.8]
    root = brute_components(list(texts), links)
    least = {}
    for key, ids in texts.items():
        for i in ids:
            least[root[key]] = min(least.get(root[key], (1, 0)), (i is None, i or 0))
    head = lambda t, i: i if not (k := tuple(norm_words(t))) else None if least[root[k]][0] else least[root[k]][1]
    return Counter((i, t, head(t, i)) for i, t in rows)


def test_groups_against_brute_force(spark):
    texts = copies()
    rows = [(i * 3 % 1009, t) for i, t in enumerate(texts)]
    rows += [(2000, None), (2001, ""), (2002, ""), (2003, "?!"), rows[5], rows[5], (None, texts[0]), (None, "quite alone here"), (None, "QUITE alone, here"), (3000, "long " * 30_000), (3001, "long " * 29_000)]
    rows += [(7000, texts[160]), (7000, texts[170]), (1, texts[170]), (None, texts[190] + " more"), (0, None)]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, Kept string, node int")
    got = near_dup.near_duplicates(docs.withColumn("n", F.col("text")), "n", "node").collect()
    assert Counter((r.doc_id, r.n, r.component_id) for r in got) == brute_groups(rows)
    assert all(r.kept == (r.component_id == r.doc_id if r.component_id is not None else True) for r in got)


def test_repeated_rows_of_a_near_copy_are_verified_once(spark, monkeypatch):
    rng = random.Random(4)
    a = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    b = [*a[:-1], "other"]
    rows = [(1, " ".join(a))] * 2000 + [(2, " ".join(b))] * 2000 + [(3, " ".join(b).upper()), (1, "another text of the first id")]
    seen = []
    once = near_dup.verified
    monkeypatch.setattr(near_dup, "verified", lambda pairs, texts: seen.append((pairs.count(), texts.count())) or once(pairs, texts))
    began = time.time()
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert time.time() - began < 90 and seen == [(1, 2)]
    assert Counter(r.component_id for r in got) == {1: 4002} and len({r.group for r in got}) == 2


def test_near_duplicates_of_an_empty_table(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_builds_of_two_threads_leave_each_other_alone(spark):
    import os
    import threading
    from concurrent.futures import ThreadPoolExecutor

    meet = threading.Barrier(2, timeout=60)

    def build(k):
        def own():
            held = common.pin(spark, spark.range(100 * k), f"t{k}")
            meet.wait()
            return held

        def late():
            out = own()
            if k == 2:
                first.result(60)  # the other build has ended and deleted what it pinned
            return out

        n = common.settled(spark, late, f"settled{k}").count()
        left = list(common.made())
        common.clear(spark)
        return n, left

    with ThreadPoolExecutor(2) as pool:
        first = pool.submit(build, 1)
        second = pool.submit(build, 2)
        (n, one), (m, two) = first.result(120), second.result(120)
    assert (n, m) == (100, 200) and [len(x) for x in (one, two)] == [1, 1] and "settled1" in one[0] and "settled2" in two[0]
    assert not any(os.path.exists(p.removeprefix("file://").removeprefix("file:")) for p in one + two)
    with pytest.raises(ZeroDivisionError):
        common.settled(spark, lambda: common.pin(spark, spark.range(1), "x") and 1 / 0, "y")
    assert any("/x-" in p for p in common.made())


# ---- the pipeline


def test_pipeline_against_its_parts_by_brute_force(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "tu", "ren", "sop"]) for _ in range(3))
    text = lambda n: " ".join(word() for _ in range(n))
    item = text(14)
    rows = [(i, text(60), "aa", f"s{i % 4}", 0, 5) for i in range(120)]
    rows += [(200 + i, rows[i][1] + " " + word(), "aa", "s1", 0, 5) for i in range(10)]
    rows += [(300, text(30) + " " + item + " " + text(9), "aa", "s2", 0, 5), (301, "12 34 ++", "aa", "s2", 0, 5), (302, None, "aa", "s2", 0, 5), (5, rows[5][1], "aa", "s1", 0, 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = pipeline.run(spark, str(tmp_path)).collect()
    kept = [(i, s, len(t.split())) for i, t, _, s, *_ in rows[:120]]
    want = brute_copies(kept)
    assert Counter(r.doc_id for r in got) == {i: n for (i, _), n in want.items() if n}
    assert all(r.text == rows[r.doc_id][1] and r.n_chars == 0 for r in got)
    by = [sorted(r.slot for r in got if r.shard == k) for k in range(8)]
    assert all(s == list(range(len(s))) for s in by) and max(map(len, by)) - min(map(len, by)) <= 1


def test_near_copies_go_row_by_row_where_rows_share_a_doc_id(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(7)
    a, b, c, d, e = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(5))
    rows = [(3, d, 1), (7, a, 2), (7, b, 3), (9, c, 4), (9, d + " more", 5), (11, e, 6), (11, e, 6), (None, d, 7), (None, d, 7), (12, a, 8)]
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t), k) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long, __row int")
    got = pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    # of text d one row stays, that of id 3; repeated rows are one; a null id gives way
    assert sorted(r["__row"] for r in got.collect()) == [1, 2, 3, 4, 6]


def test_running_sums_and_repeats(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aab"), k, rng.randrange(9)) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, k int, v int")
    got = common.running_sums(spark, df, "g", ["k"], {"before": F.col("v")}).collect()
    assert len(got) == 500 and all(r.before == sum(v for g, k, v in rows if g == r.g and k < r.k) for r in got)
    many = spark.createDataFrame([("a", 1), ("b", 2500), ("c", 1000)], "g string, n long")
    assert sorted(map(tuple, common.repeated(many, "n", "i").collect())) == [("a", 0)] + [("b", i) for i in range(2500)] + [("c", i) for i in range(1000)]


def test_row_keys_tell_rows_apart_that_differ_in_place_of_a_null(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "x", None), (1, None, "x")], "a long, b string, c string")
    assert common.unique_rows(df).count() == 2


def test_settled_results_stay_when_the_way_there_is_deleted(spark):
    before = len(common.made())
    out = common.settled(spark, lambda: common.pin(spark, common.pin(spark, spark.range(5), "a"), "b"), "c")
    assert out.count() == 5 and len(common.made()) == before + 1


def test_stages_of_the_pipeline_on_an_empty_table(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_worker_holds_a_bounded_number_of_words():
    import xxhash

    words = [f"w{i}".encode() for i in range(250_000)]
    got = near_dup.shingles(words, 1)
    assert len(near_dup._hashes) <= 100_000
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    out = (np.full(len(h), 1, np.uint64) + h) * near_dup._PRIMES[0]
    assert (got == near_dup.mixed(out ^ (out >> np.uint64(29)))).all()
