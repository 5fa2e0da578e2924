"""Operator 4: embedding near-duplicates by collision-counting projections.

Vectors of equal labels are scaled to length 1 and projected on random directions; a pair at the threshold lies at
distance sqrt(2 - 2*cos), so its differences there have a known distribution. Two rounds count collisions.

The first finds which vectors can be linked at all. Each projection is cut into cells of some deviations of a pair
at the threshold, and `depth` projections together make a table; a pair collides in a table if it shares all its
cells. A pair at the threshold collides in one table at least with probability TABLE_RECALL. Vectors are tied to the smallest id
of each of their buckets, and the components of these ties hold all links. How wide cells and how deep tables have to be, so
that vectors that aren't linked rarely collide, is told by the distances of pairs of a sample: of the LABELS largest labels,
SAMPLE vectors each, which the driver collects. Vectors of a label that all point the same way need deeper tables and so more
of them than spread ones. Where the tables would cost more than to compare all pairs of the largest label, this round is left
out and a label is one component: that is so for labels of some ten thousand vectors, and up to the more, the closer together
a label's vectors lie. Both ways give the same links.

The second counts within components. Sorted by (component, first projection), rows are cut into blocks of BLOCK rows;
blocks meet that share a component and whose ranges of it come as near as a pair at the threshold can be. There, for each of PROJECTIONS
projections in sorted order, a pair collides if one lies in the window of +-WIDTH around the other; NEEDED is the
largest count that a pair at the threshold reaches with probability RECALL. Pairs that reach it are verified by
cosine in double precision. A block pair gives, per vector, its number of links, and the links of a spanning forest:
no result grows with the square of a group, though the comparisons within a group of vectors that are all near each
other do. Equal vectors of a label are one representative with a count.

Defined cases: a null label, a null or zero vector, or one with null or non-finite components links with nothing;
vectors of different lengths link with nothing; equal vectors link; rows are nodes of their own, also where
they share a vec_id; a null vec_id is an id before all others; an empty table gives no rows; other columns are not used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import number_rows, pin, row_key, settled, table
from rasterloom.llm.components import components, forest
from rasterloom.llm.grams import mixed

COSINE = 0.98
PROJECTIONS = 32
#: Window half-width in deviations of a pair at the threshold.
WIDTH = 2.25
RECALL = 1 - 1e-9
BLOCK = 2048
#: Widths of cells that are tried, and the deepest tables.
CELLS, DEEPEST = (3, 4, 5, 6, 8, 10, 13, 16), 80
TABLE_RECALL = 1 - 1e-6
#: A vector collides by chance with so many vectors, in all its tables taken together.
CHANCE = 0.05
#: Labels and vectors of each from which distances are learnt.
LABELS, SAMPLE = 16, 256
#: Measured costs in seconds: to compare a pair, of a row of a bucket, of a cell and, in it, of a dimension.
PAIR, ROW, PER_CELL, PER_DIM = 3e-8, 5e-6, 1e-8, 2e-10
SEED = 7
_ROWS, _PART = 64, 500


def needed(projections: int = PROJECTIONS, width: float = WIDTH, recall: float = RECALL) -> int:
    """The largest collision count that a pair at the threshold reaches with probability recall."""
    p, missed = math.erf(width / math.sqrt(2)), 0.0
    for k in range(projections + 1):
        missed += math.comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if missed > 1 - recall:
            return k
    return projections


def near_share(dims: int, radius: float, cell: float) -> float:
    """The least chance of a pair within radius to share a cell of one projection."""
    # mean size of one coordinate of a vector of length 1
    mean = math.exp(math.lgamma(dims / 2) - math.lgamma((dims + 1) / 2)) / math.sqrt(math.pi)
    return 1 - mean * math.sqrt(dims) / cell


def far_shares(dims: int, radius: float, cell: float, apart: np.ndarray) -> np.ndarray:
    """The same of pairs that lie so far apart, whose differences in a projection are about normal."""
    z = cell * radius / np.maximum(apart, 1e-12)
    inside = np.array([math.erf(v / math.sqrt(2)) for v in z])
    return inside - math.sqrt(2 / math.pi) / z * (1 - np.exp(-z * z / 2))


@dataclass(frozen=True)
class Tables:
    """Width of cells, projections of a table, tables, and seconds that they cost a vector."""

    cell: float
    depth: int
    many: int
    cost: float


def tables(labels: list[tuple[int, np.ndarray]], dims: int, radius: float) -> Tables | None:
    """The cheapest tables for labels of so many vectors, whose pairs lie so far apart; None if none keep unlinked vectors apart."""
    best = None
    for cell in CELLS:
        near = near_share(dims, radius, cell)
        if near <= 0:
            continue
        spread = [(n, far_shares(dims, radius, cell, apart)) for n, apart in labels]
        for depth in range(1, DEEPEST + 1):
            many = math.ceil(math.log(1 - TABLE_RECALL) / math.log1p(-(near**depth)))
            cost = many * (ROW + depth * (PER_CELL + dims * PER_DIM))
            if best and cost >= best.cost:
                break
            if all(n * many * (far**depth).mean() <= CHANCE for n, far in spread if len(far)):
                best = Tables(cell, depth, many, cost)
                break
    return best


def distances(units: np.ndarray, radius: float) -> np.ndarray:
    """Distances of all pairs of a sample that are not linked, as 64 means of equally many."""
    a, b = np.triu_indices(len(units), 1)
    found = np.sort(np.sqrt(np.maximum(0, 2 - 2 * (units @ units.T)[a, b])))
    found = found[found > radius]
    return np.array([part.mean() for part in np.array_split(found, 64) if len(part)])


def planned(slim: DataFrame, radius: float) -> dict[int, Tables]:
    """For each number of dimensions that a large label has, the tables that cost less than comparing its pairs, if there are any."""
    keyed = slim.select("kind", F.size("embedding").alias("dims"), "embedding", F.pmod(F.xxhash64("embedding", F.lit(SEED)), F.lit(1 << 62)).alias("spot"))
    large = keyed.groupBy("kind", "dims").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind").limit(LABELS)
    # LABELS rows
    some = keyed.join(F.broadcast(large), ["kind", "dims"]).filter(F.col("spot") <= F.least(F.lit(1.0), F.lit(SAMPLE + 6 * SAMPLE**0.5) / F.col("n")) * float(1 << 62))
    rank = F.row_number().over(Window.partitionBy("kind", "dims").orderBy("spot"))
    held: dict[int, dict[int, tuple[int, list]]] = {}
    for r in some.withColumn("rank", rank).filter(F.col("rank") <= SAMPLE).select("kind", "dims", "n", "embedding").toLocalIterator():
        held.setdefault(r.dims, {}).setdefault(r.kind, (r.n, []))[1].append(r.embedding)
    out = {}
    for dims, labels in held.items():
        told = []
        for n, vectors in labels.values():
            x = np.array(vectors, np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)
            told.append((n, distances(x / np.linalg.norm(x, axis=1, keepdims=True), radius)))
        best = tables(told, dims, radius)
        if best and best.cost < max(n for n, _ in told) / 2 * PAIR:
            out[dims] = best
    return out


def codes(units: np.ndarray, by: Tables, radius: float, seed: int = SEED) -> np.ndarray:
    """Per row and table a hash of the table and its cells."""
    dims, depth, many = units.shape[1], by.depth, by.many
    rng = np.random.default_rng((seed, dims))
    ways = rng.standard_normal((dims, many * depth))
    ways *= math.sqrt(dims) / (by.cell * radius * np.linalg.norm(ways, axis=0))
    shift = rng.random(many * depth)
    factors = rng.integers(0, 1 << 64, (depth, many), np.uint64) | np.uint64(1)
    out = np.empty((len(units), many), np.uint64)
    for top in range(0, len(units), _PART):
        cells = units[top : top + _PART] @ ways
        cells += shift
        cells = np.floor(cells, out=cells).astype(np.int64).view(np.uint64).reshape(-1, many, depth)
        sums = np.broadcast_to(np.arange(many, dtype=np.uint64), cells.shape[:2]).copy()
        for k in range(depth):
            sums += cells[:, :, k] * factors[k]
        out[top : top + _PART] = mixed(sums)
    return out


def together(placed: DataFrame) -> DataFrame:
    """(id, component) of the rows (id, buckets) that share a bucket with others, directly or over others."""
    rows = placed.select("id", F.explode("buckets").alias("bucket"))
    heads = rows.groupBy("bucket").agg(F.min("id").alias("head"), F.max("id").alias("last")).filter("head <> last")
    ties = rows.join(heads, "bucket").filter("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct()
    return components(ties).select(F.col("node").alias("id"), "component")


def directions(dims: int, projections: int = PROJECTIONS, seed: int = SEED) -> np.ndarray:
    d = np.random.default_rng(seed + dims).standard_normal((dims, projections))
    return d / np.linalg.norm(d, axis=0)


def collisions(left: np.ndarray, right: np.ndarray, half: float) -> np.ndarray:
    """Per pair of rows, in how many columns they lie within half of each other.

    Each column of right is sorted; a row of left has a window of ranks there, and a rank is in it if its unsigned
    distance from the window's start is below the window's size. Fewer than 2**16 rows a side.
    """
    count = np.zeros((len(left), len(right)), np.int8)
    windows = []
    for j in range(left.shape[1]):
        order = np.argsort(right[:, j], kind="stable")
        line, rank = right[order, j], np.empty(len(right), np.uint16)
        rank[order] = np.arange(len(right), dtype=np.uint16)
        lo, hi = np.searchsorted(line, left[:, j] - half, "left"), np.searchsorted(line, left[:, j] + half, "right")
        windows.append((rank[None, :], lo.astype(np.uint16)[:, None], (hi - lo).astype(np.uint16)[:, None]))
    for top in range(0, len(left), _ROWS):
        some = slice(top, min(top + _ROWS, len(left)))
        far, hit = np.empty(count[some].shape, np.uint16), np.empty(count[some].shape, bool)
        for rank, lo, size in windows:
            np.subtract(rank, lo[some], out=far)
            np.less(far, size[some], out=hit)
            np.add(count[some], hit.view(np.int8), out=count[some])
    return count


def _usable(vector: str = "embedding"):
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def representatives(rows: DataFrame) -> DataFrame:
    """Usable vectors, equal ones of a label as one row: vec_id, copies, label, embedding, and h1 and h2, the key of the last two."""
    usable = rows.filter(F.col("label").isNotNull() & F.coalesce(_usable(), F.lit(False)))
    reps = usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))
    return reps.select("*", *row_key(reps.select("label", "embedding")))


def link(reps: DataFrame, cosine: float = COSINE, projections: int = PROJECTIONS, width: float = WIDTH, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Links among representatives: (id, linked vectors) counts, and (a, b) forest links."""
    spark = reps.sparkSession
    radius = math.sqrt(2 - 2 * cosine)
    least = needed(projections, width)
    slim = reps.select("id", "copies", "embedding", F.xxhash64("label").alias("kind"))
    by = planned(slim, radius)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = [np.asarray(e, np.float64) for e in batch["embedding"]]
            for dims in {len(v) for v in vectors}:
                own = [i for i, v in enumerate(vectors) if len(v) == dims]
                unit = np.stack([vectors[i] / np.abs(vectors[i]).max() for i in own])
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                out = batch[["id", "copies", "kind"]].iloc[own].assign(dims=dims, first=unit @ directions(dims, projections)[:, 0])
                out["unit"] = [u.tobytes() for u in unit]
                kind = mixed(batch["kind"].to_numpy(np.int64)[own].view(np.uint64) + np.uint64(dims))
                none = np.zeros((len(own), 0), np.uint64)
                out["buckets"] = list((mixed(codes(unit, by[dims], radius) ^ kind[:, None]) if dims in by else none).view(np.int64))
                yield out

    columns = "id long, copies long, kind long, dims int, first double, unit binary, buckets array<long>"
    flat = pin(spark, slim.mapInPandas(project, columns), "projected")
    kept, tied = ["id", "copies", "dims", "first", "unit"], F.col("dims").isin(list(by))
    whole = flat.filter(~tied).select(*kept, F.col("kind").alias("component")) if by else flat.select(*kept, F.col("kind").alias("component"))
    if by:
        near = pin(spark, together(flat.filter(tied)), "near-vectors")
        whole = whole.unionByName(flat.filter(tied).select(*kept).join(near, "id"))
    flat = whole
    placed, _ = number_rows(spark, flat, [F.col("dims"), F.col("component"), F.col("first"), F.col("id")], "row_no")
    group = ["dims", "component"]
    # a block may hold many small components, or a part of a large one
    blocked = placed.withColumn("block", F.expr(f"row_no div {int(block)}")).drop("row_no")
    ranges = blocked.groupBy(*group, "block").agg(F.min("first").alias("lo"), F.max("first").alias("hi"))
    # blocks lie in order of the first projection, so those in reach are a run: from the block itself to the last that starts in reach
    starts = ranges.select(*group, F.col("lo").alias("at"), F.col("block").alias("start"), F.lit(None).cast("long").alias("query"))
    asks = ranges.select(*group, (F.col("hi") + radius).alias("at"), F.lit(None).cast("long").alias("start"), F.col("block").alias("query"))
    up_to = Window.partitionBy(*group).orderBy("at", F.col("start").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = starts.unionByName(asks).withColumn("last", F.max("start").over(up_to)).filter(F.col("query").isNotNull())
    last = last.select(*group, F.col("query").alias("block"), "last")
    # each block goes as right side to all queries that reach it, and as left side to all blocks it reaches
    left = blocked.join(last, [*group, "block"]).withColumn("right", F.explode(F.sequence("block", "last"))).withColumn("side", F.lit(0)).withColumnRenamed("block", "left").drop("last")
    pairs = last.select(*group, F.col("block").alias("left"), F.explode(F.sequence("block", "last")).alias("right"))
    right = blocked.withColumnRenamed("block", "right").join(pairs.filter("left <> right"), [*group, "right"]).withColumn("side", F.lit(1))
    cells = left.unionByName(right.select(*left.columns))

    def verify(cell: pd.DataFrame) -> pd.DataFrame:
        one, two = cell[cell["side"] == 0], cell[cell["side"] == 1]
        same = not len(two)
        two = one if same else two
        dims = int(cell["dims"].iloc[0])
        u = np.frombuffer(b"".join(one["unit"]), np.float64).reshape(-1, dims)
        v = u if same else np.frombuffer(b"".join(two["unit"]), np.float64).reshape(-1, dims)
        ways = directions(dims, projections)
        near = collisions(u @ ways, v @ ways, width * radius / math.sqrt(dims)) >= least
        near &= one["component"].to_numpy(np.int64)[:, None] == two["component"].to_numpy(np.int64)[None, :]
        if same:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        true = np.einsum("ij,ij->i", u[i], v[j]) >= cosine
        i, j = i[true], j[true]
        a, b = one["id"].to_numpy(np.int64), two["id"].to_numpy(np.int64)
        links = np.bincount(i, two["copies"].to_numpy(np.float64)[j], len(a))
        back = np.bincount(j, one["copies"].to_numpy(np.float64)[i], len(b))
        tree = forest(a, b, i, j)
        ids = np.concatenate([a[links > 0], b[back > 0], [x for x, _ in tree]]).astype(np.int64)
        many = np.concatenate([links[links > 0], back[back > 0], np.zeros(len(tree))]).astype(np.int64)
        other = pd.array([None] * (len(ids) - len(tree)) + [y for _, y in tree], dtype="Int64")
        return pd.DataFrame({"id": ids, "links": many, "other": other})

    found = pin(spark, cells.groupBy("dims", "left", "right").applyInPandas(verify, "id long, links long, other long"), "vector-links")
    counts = found.filter(F.col("other").isNull()).groupBy("id").agg(F.sum("links").alias("links"))
    return counts, found.filter(F.col("other").isNotNull()).select(F.col("id").alias("a"), F.col("other").alias("b"))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per row of vectors (vec_id, embedding, label): n_links, component_id, kept."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding", "label")

    def headed() -> DataFrame:
        # rows of one vec_id that differ in label are nodes of their own, with numbers in the order of vec_id
        reps, _ = number_rows(spark, representatives(rows), [F.col("vec_id"), F.col("label")], "id")
        counts, links = link(reps, cosine)
        heads = components(links).join(reps.select(F.col("id").alias("component"), F.col("vec_id").alias("head")), "component")
        heads = reps.join(counts, "id", "left").join(heads.withColumnRenamed("node", "id"), "id", "left")
        return heads.select("h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("head", "vec_id").alias("head"))

    heads = settled(spark, headed, "vector-groups")
    out = rows.select("vec_id", *row_key(rows.select("label", "embedding"))).join(heads, ["h1", "h2"], "left")
    component = F.coalesce("head", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op4_collision_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLES = {
    "op4_collision_neighbours": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
              WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
        r AS (SELECT vec_id AS n, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON r.n = l.a),
        c AS (SELECT n AS vec_id, min(c) AS component_id FROM r GROUP BY n),
        k AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
        SELECT vec_id, coalesce(k.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings LEFT JOIN k USING (vec_id) JOIN c USING (vec_id)
    """,
}
