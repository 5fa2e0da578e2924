"""Operator 7: document near-duplicates by BagMinHash over 5-word shingles.

A document is the multiset of its 5-word shingles over ASCII-lowered words (all words as one shingle if there are
fewer). BagMinHash: each shingle drives Poisson processes over its discretised weight. The weight axis is cut into
dyadic pieces [0,1), [1,2), [2,4), ...; a piece's points come in order of time at a rate of its width, each with a
register and a height in the piece, and count if the height is below the shingle's weight. A register keeps its
earliest point, so two registers agree with the probability of the weighted Jaccard similarity. A process stops at
the latest time that any register of its document still holds, so cost is about one point a shingle.

Texts of equal words are one node, a class, whatever their rows; each class is compared by one text. Nodes that
share a band of ROWS registers meet in a bucket. A pair passes a filter of sizes and of 128 one-bit registers, then
multiset overlap is verified on the texts. To keep a bucket's pairs linear in its rows, each node is first paired
with the bucket's leader and with the REACH nodes before it (all pairs, for buckets of up to REACH + 1 nodes).
Larger buckets whose nodes those links leave in several components get all their pairs across components compared,
block by block, so no link of different texts is lost. Components of verified links are the groups; the smallest
doc_id of each is its component_id.

Defined cases: rows that are null or without words link with nothing and are kept; rows are decided one by one, so
rows that share a doc_id but not the words can lie in different groups; repeated rows share a group and a decision;
a null doc_id names no group that has another (a group of such rows only has a null component_id, and they are
kept); an empty table gives no rows; other columns are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import number_rows, pin, settled, table
from rasterloom.llm.components import components, forest
from rasterloom.llm.grams import mixed
from rasterloom.llm.words import norm_words

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: Of 128 one-bit registers, so many may differ: five deviations above what a pair at the threshold shows.
BITS_APART = 30
REACH = 3
BLOCK = 256
_ELEMENTS = 200_000
_KEPT = 1_000_000
#: Words whose hashes a worker holds, some 15 MB; workers live on between tasks, so all words of a corpus would add up in them.
_WORDS = 100_000
_FIELDS = "key binary, n long, bands array<long>, s1 long, s2 long"
_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _WordHashes()


def shingles(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """64-bit hashes of all runs of width words, repeats included."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out + h[i : i + len(out)]) * _PRIMES[i % 5]
        out ^= out >> np.uint64(29)
    return mixed(out)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles of a text, in order, and how often each occurs."""
    return np.unique(shingles(norm_words(text)), return_counts=True)


def overlap(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags."""
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(x[1][i], y[1][j]).sum())
    whole = int(x[1].sum() + y[1].sum()) - both
    return both / whole if whole else 0.0


def similarity(a: str | None, b: str | None) -> float:
    return overlap(bag(a), bag(b))


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def bag_minhash(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """Registers (n_docs x registers) of earliest point times; the time's bits name the point."""
    held = np.full((n_docs, registers), np.inf)
    flat = held.reshape(-1)
    pieces = [(doc, key, weight, np.zeros(len(doc)), np.ones(len(doc)))]
    low = 1
    while (more := weight > low).any():
        pieces.append((doc[more], mixed(key[more] + np.uint64(low)), weight[more], np.full(more.sum(), float(low)), np.full(more.sum(), float(low))))
        low *= 2
    d, seed, w, floor, wide = (np.concatenate(x) for x in zip(*pieces, strict=True))
    t, step = np.zeros(len(d)), 0
    while len(d):
        many = 1 if len(d) > 20_000 else 16
        ks = np.arange(step, step + many, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        one = mixed(seed[:, None] + ks[None, :])
        two = mixed(one ^ np.uint64(0xC2B2AE3D27D4EB4F))
        gap = -np.log(_uniform(one)) / (registers * wide[:, None])
        gap[:, 0] += t
        times = np.cumsum(gap, axis=1)
        reg = (two & np.uint64(0xFFFFFFFF)) % np.uint64(registers)
        height = floor[:, None] + wide[:, None] * ((two >> np.uint64(32)).astype(np.float64) * 2.0**-32)
        at = d[:, None] * registers + reg.astype(np.int64)
        counts = height < w[:, None]
        np.minimum.at(flat, at[counts], times[counts])
        step += many
        t = times[:, -1]
        live = np.unique(d)
        bound = np.zeros(n_docs)
        bound[live] = held[live].max(axis=1)
        go = t < bound[d]
        d, seed, w, floor, wide, t = (x[go] for x in (d, seed, w, floor, wide, t))
    return held


def _signed(texts: list[str | None]) -> list[tuple]:
    bags, out = [], []
    for text in texts:
        words = norm_words(text)
        key, count = np.unique(shingles(words), return_counts=True)
        bags.append((key, count))
        out.append((hashlib.blake2b(b" ".join(words), digest_size=16).digest(), max(0, len(words) - WIDTH + 1) or min(1, len(words))))
    sizes = [len(k) for k, _ in bags]
    held = bag_minhash(np.repeat(np.arange(len(bags)), sizes), np.concatenate([k for k, _ in bags]), np.concatenate([c for _, c in bags]), len(bags))
    marks = mixed(held.view(np.uint64))
    bands = np.zeros((len(bags), BANDS), np.uint64)
    for r in range(ROWS):
        bands = mixed(bands * np.uint64(31) + marks[:, r::ROWS])
    bits = (marks[:, :128] & np.uint64(1)) << (np.arange(128, dtype=np.uint64) % np.uint64(64))
    s1, s2 = (np.bitwise_or.reduce(bits[:, k : k + 64], axis=1).view(np.int64) for k in (0, 64))
    bands = bands.view(np.int64)
    return [(key, n, bands[i] if n else [], s1[i], s2[i]) for i, (key, n) in enumerate(out)]


def signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows, part, chars = [], [], 0
        for text in texts:
            part.append(text)
            chars += len(text or "")
            if chars > 6 * _ELEMENTS:
                rows += _signed(part)
                part, chars = [], 0
        if part:
            rows += _signed(part)
        yield pd.DataFrame(rows, columns=["key", "n", "bands", "s1", "s2"])


def _close(a: str, b: str):
    """Whether structs or row prefixes a and b pass the filters of size and of one-bit registers."""
    apart = F.bit_count(F.col(f"{a}s1").bitwiseXOR(F.col(f"{b}s1"))) + F.bit_count(F.col(f"{a}s2").bitwiseXOR(F.col(f"{b}s2")))
    sizes = F.least(f"{a}n", f"{b}n") >= F.greatest(f"{a}n", f"{b}n") * SIMILARITY
    return (F.col(f"{a}node") != F.col(f"{b}node")) & sizes & (apart <= BITS_APART)


def _pair(a: str, b: str) -> list:
    return [F.least(f"{a}node", f"{b}node").alias("a"), F.greatest(f"{a}node", f"{b}node").alias("b")]


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar enough; texts holds one row a node."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = both.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bags: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # a node of a hot bucket is in many pairs
        held = 0

        def known(node: int, text: str) -> tuple[np.ndarray, np.ndarray]:
            nonlocal held
            if node not in bags:
                if held > _KEPT:
                    bags.clear()
                    held = 0
                bags[node] = bag(text)
                held += len(bags[node][0])
            return bags[node]

        for batch in batches:
            pairs = zip(batch["a"], batch["ta"], batch["b"], batch["tb"], strict=True)
            good = [overlap(known(a, x or ""), known(b, y or "")) >= SIMILARITY for a, x, b, y in pairs]
            yield batch.loc[good, ["a", "b"]]

    return both.select("a", "b", "ta", "tb").mapInPandas(keep, "a long, b long")


def bucketed(nodes: DataFrame) -> DataFrame:
    """Nodes (node, n, s1, s2, bands) with each bucket of two nodes or more that they are in, its size, and whether they lead it.

    Only bucket, node and order travel for all bands; what most rows lack, a bucket of several nodes, is known first.
    """
    rows = nodes.select("node", F.posexplode("bands").alias("band", "hash")).select(F.xxhash64("band", "hash").alias("bucket"), "node")
    rows = rows.withColumn("at", F.xxhash64("node", "bucket"))
    heads = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("at").alias("least")).filter("size > 1")
    found = rows.join(heads, "bucket").select("bucket", "node", "size", (F.col("at") == F.col("least")).alias("leads"))
    return found.join(nodes.select("node", "n", "s1", "s2"), "node")


def near_pairs(members: DataFrame) -> DataFrame:
    """Filtered pairs of nodes with their bucket's leader and the REACH nodes before them."""
    mine = F.struct("node", "n", "s1", "s2")
    leads = members.filter("leads").select("bucket", mine.alias("lead"))
    led = members.filter(~F.col("leads")).join(leads, "bucket").filter(_close("", "lead.")).select(*_pair("", "lead."))
    parts = F.ceil(F.col("size") / 1024)
    rows = members.withColumn("part", F.pmod(F.xxhash64("node", F.lit(3)), parts))
    before = Window.partitionBy("bucket", "part").orderBy("node").rowsBetween(-REACH, -1)
    near = rows.withColumn("before", F.collect_list(mine).over(before)).withColumn("o", F.explode("before")).filter(_close("", "o.")).select(*_pair("", "o."))
    return led.unionByName(near).distinct()


def rest_members(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of buckets of more than REACH + 1 nodes that lie in several components, with the nodes' components."""
    large = members.filter(F.col("size") > REACH + 1).drop("leads")
    large = large.join(roots, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = large.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least <> most")
    return large.join(several.select("bucket"), "bucket")


def elements(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The shingles of each text as a sorted set, repeats numbered: sets overlap as the multisets do."""
    for batch in texts:
        out = []
        for text in batch:
            key, count = bag(text)
            start = np.cumsum(count) - count
            nth = (np.arange(count.sum()) - np.repeat(start, count)).astype(np.uint64)
            out.append(np.sort(mixed(np.repeat(key, count) + nth * _PRIMES[0]).view(np.int64)))
        yield pd.Series(out)


def with_shared(rest: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows of rest_members() with the nodes' elements, and how many of them any other node there has.

    Nodes that share too little to be linked at all go. Counts are summed within tasks first, so a shingle that all
    nodes have is no burden.
    """
    own = texts.join(rest.select("node").distinct(), "node", "left_semi").select("node", F.pandas_udf(elements, "array<long>")("text").alias("elements"))
    own = pin(rest.sparkSession, own, "elements")
    once = own.select("node", F.explode("elements").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("times"), F.min("node").alias("node"))
    alone = once.filter("times = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    rated = own.join(alone, "node", "left").select("node", "elements", (F.size("elements") - F.coalesce("alone", F.lit(0))).alias("shared"))
    return rest.join(rated.filter(F.col("shared") >= F.size("elements") * SIMILARITY), "node")


def rest_links(rest: DataFrame) -> DataFrame:
    """Links (a, b) across components within the buckets of with_shared(), enough of them to tie what any link ties.

    Blocks of a bucket meet in tasks of their own. Two nodes share at most what each shares with any node at all;
    pairs that pass that bound and the one-bit registers are verified there on the elements, so near copies that
    are each edited in places of their own, of which a hot bucket may hold very many, make no rows.
    """
    rows = rest.withColumn("blocks", F.ceil(F.col("size") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "shared", "s1", "s2", "component", "elements")

    def across(cell: pd.DataFrame) -> pd.DataFrame:
        i, j = int(cell["i"].iloc[0]), int(cell["j"].iloc[0])
        one, two = cell[cell["block"] == i].reset_index(drop=True), cell[cell["block"] == j].reset_index(drop=True)
        get = lambda t, c: t[c].to_numpy(np.int64)
        n, m = one["elements"].map(len).to_numpy(), two["elements"].map(len).to_numpy()
        most = np.minimum(get(one, "shared")[:, None], get(two, "shared")[None, :])
        near = most >= SIMILARITY * (n[:, None] + m[None, :] - most)
        near &= get(one, "component")[:, None] != get(two, "component")[None, :]
        p, q = np.nonzero(near)
        apart = sum(np.bitwise_count(get(one, c)[p] ^ get(two, c)[q]).astype(np.int16) for c in ("s1", "s2"))
        p, q = p[apart <= BITS_APART], q[apart <= BITS_APART]
        good = np.zeros(len(p), bool)
        for x in np.unique(p):
            mine, at = one["elements"][x], np.flatnonzero(p == x)
            sizes = m[q[at]]
            theirs = np.concatenate([two["elements"][y] for y in q[at]])
            found = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
            both = np.add.reduceat(found, np.cumsum(sizes) - sizes, dtype=np.int64)
            good[at] = both >= SIMILARITY * (len(mine) + sizes - both)
        a, b = get(one, "node"), get(two, "node")
        return pd.DataFrame(forest(a, b, p[good], q[good]), columns=["a", "b"]).astype("int64")

    parts = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "bucket", "i", "j").groupBy("bucket", "i", "j").applyInPandas(across, "a long, b long").distinct()


def node_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """One text a node (node, first_id, text_hash), however often its row is repeated; repeats meet map-side first."""
    rows = docs.select(F.col("doc_id").alias("row_id"), "text", F.xxhash64("text").alias("row_hash"))
    same = F.col("row_id").eqNullSafe(F.col("first_id")) & (F.col("row_hash") == F.col("text_hash"))
    return rows.join(nodes, same).groupBy("node").agg(F.first("text").alias("text"))


def linked(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component) of the nodes that are linked to others."""
    spark = docs.sparkSession
    members = pin(spark, bucketed(nodes), "buckets")
    met = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "first_id", "text_hash")
    texts = pin(spark, node_texts(docs, met), "texts")
    tried = pin(spark, near_pairs(members), "pairs")
    links = pin(spark, verified(tried, texts), "links")
    roots = components(links)
    rest = pin(spark, rest_members(members, roots), "rest")
    if rest.take(1):
        roots = components(links.unionByName(rest_links(with_shared(rest, texts))))
    return roots


def near_duplicates(docs: DataFrame, *carry: str) -> DataFrame:
    """Per row of docs (doc_id, text): component_id, kept, n_shingles and group, beside the columns to carry.

    group numbers the groups, and is null for rows without words. Nodes are numbered in the order of their smallest
    doc_id, so a component's smallest node has its smallest doc_id.
    """
    spark = docs.sparkSession
    held = [F.struct(*carry).alias("__carry")] if carry else []
    marks = docs.select("doc_id", *held, F.xxhash64("text").alias("text_hash"), F.pandas_udf(signed, _FIELDS)("text").alias("m"))
    marks = pin(spark, marks.select(*[c for c in marks.columns if c != "m"], "m.*"), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")

    def headed() -> DataFrame:
        classes = marks.filter("n > 0").groupBy("key").agg(first, *[F.first(c).alias(c) for c in ("n", "bands", "s1", "s2")])
        classes = classes.select("key", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("text_hash"), "n", "bands", "s1", "s2")
        nodes, _ = number_rows(spark, classes, [F.col("first_id").isNull(), F.col("first_id"), F.col("key")], "node")
        roots = linked(docs, nodes)
        heads = roots.join(nodes.select(F.col("node").alias("component"), F.col("first_id").alias("head")), "component")
        heads = nodes.select("key", "node", "first_id").join(heads, "node", "left")
        return heads.select("key", F.coalesce("component", "node").alias("group"), F.when(F.col("component").isNull(), F.col("first_id")).otherwise(F.col("head")).alias("head"))

    heads = settled(spark, headed, "groups")
    out = marks.withColumn("key", F.when(F.col("n") > 0, F.col("key"))).join(heads, "key", "left")
    component = F.when(F.col("n") > 0, F.col("head")).otherwise(F.col("doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, component.isNull())
    return out.select("doc_id", *[F.col("__carry").getField(c).alias(c) for c in carry], component.alias("component_id"), kept.alias("kept"), F.col("n").alias("n_shingles"), "group")


def op7_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("group")
