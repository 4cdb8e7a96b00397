"""Near-duplicate embeddings by E8 lattice hashing, and nearest neighbours by a forest of random-projection trees."""

from __future__ import annotations

import functools
import heapq
import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import closed_groups, components, map_batches, materialise, ready, table

COSINE = 0.98
#: Lattice tables, lattice points (of 8 projections each) that a cell is made of, scale of the projections (points have minimal distance sqrt(2)), and
#: neighbouring cells probed. Of pairs with a cosine of exactly 0.98, 0.999 share a cell (test); of random pairs, some 4 in a million, at any size.
LATTICES, POINTS, SCALE, PROBES = 8, 3, 0.5, 2
#: Members of a lattice cell that one block of work holds at most, and of a group whose pairs are listed rather than laid out as a matrix.
BLOCK, SMALL = 1024, 32
#: Index rows of a block of work, regions that these blocks are taken from at most, and queries compared at once.
INDEX_BLOCK, HOMES, QUERY_CHUNK = 4096, 256, 128
#: Trees, rows they are grown from at most, rows wanted in a leaf, and share of all vectors that a query looks at. On vectors without any
#: structure the nearest ones are spread over so many leaves that no much smaller share reaches a recall of 0.9 in tables of hundreds of rows.
TREES, FOREST_SAMPLE, LEAF_ROWS, SHARE = 12, 20_000, 32, 0.72


def usable(vector: Column) -> Column:
    """Not null, no null, NaN or infinite component, and some component that is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def identity(vector: Column) -> Column:
    return F.sha2(F.concat_ws(",", F.transform(vector, lambda x: x.cast("string"))).cast("binary"), 256)


# ---- E8 lattice -----------------------------------------------------------------------------------------------------------


@functools.cache
def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or all +-1/2 with an even number of minus signs."""
    pairs = [
        [s if k == i else t if k == j else 0 for k in range(8)]
        for i, j in itertools.combinations(range(8), 2) for s, t in itertools.product((1, -1), repeat=2)
    ]
    halves = [s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(pairs + halves, dtype=float)


def nearest_d8(y: np.ndarray) -> np.ndarray:
    """Round; where the sum comes out odd, round the worst coordinate the other way."""
    z = np.rint(y)
    off = y - z
    odd = np.flatnonzero(z.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    z[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return z


def nearest_e8(y: np.ndarray) -> np.ndarray:
    whole, half = nearest_d8(y), nearest_d8(y - 0.5) + 0.5
    closer = ((y - whole) ** 2).sum(axis=1) <= ((y - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


@functools.cache
def projections(dimension: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1000 + dimension)
    return rng.normal(size=(LATTICES, POINTS, dimension, 8)) * SCALE, rng.uniform(0, 2, size=(LATTICES, POINTS, 8))


def directions(x: np.ndarray) -> np.ndarray:
    """Unit vectors; the largest component is divided out first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cells(x: np.ndarray) -> np.ndarray:
    """For unit vectors: hashes of the own and the probed cells, a row of LATTICES * (1 + PROBES). A probed cell has one of the points of
    the own one replaced by a neighbour; those that the vector is nearest to are taken."""
    maps, shifts = projections(x.shape[1])
    rows, out = np.arange(len(x)), []
    for k in range(LATTICES):
        own, near, gain = [], [], []
        for m, shift in zip(maps[k], shifts[k]):
            y = x @ m + shift
            z = nearest_e8(y)
            toward = (y - z) @ minimal_vectors().T
            best = np.argsort(-toward, axis=1, kind="stable")[:, :PROBES]
            own.append(z)
            near.append(z[:, None, :] + minimal_vectors()[best])
            gain.append(np.take_along_axis(toward, best, axis=1))
        own, near = np.stack(own, axis=1), np.stack(near, axis=1)
        points = [own]
        for best in np.argsort(-np.concatenate(gain, axis=1), axis=1, kind="stable")[:, :PROBES].T:
            other = own.copy()
            other[rows, best // PROBES] = near[rows, best // PROBES, best % PROBES]
            points.append(other)
        points = np.stack(points, axis=1).reshape(len(x), 1 + PROBES, 8 * POINTS)
        h = np.full(points.shape[:2], k + 1 + 100 * x.shape[1], dtype=np.uint64)
        for i in range(8 * POINTS):
            h = (h ^ (2 * points[:, :, i]).astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out.append(h.view(np.int64))
    return np.concatenate(out, axis=1)


def counted_here(c: np.ndarray, nodes: np.ndarray, a: np.ndarray, b: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Which of the pairs a, b have no earlier common cell than ``here``, in the order of the cells of the smaller id."""
    out = np.ones(len(a), dtype=bool)
    for s in range(0, len(a), 4096):
        p, q = a[s : s + 4096], b[s : s + 4096]
        u, v = c[np.where(nodes[p] < nodes[q], p, q)], c[np.where(nodes[p] < nodes[q], q, p)]
        first = (u[:, :, None] == v[:, None, :]).any(axis=2).argmax(axis=1)
        out[s : s + 4096] = u[np.arange(len(u)), first] == here[s : s + 4096]
    return out


def linked_groups(pdf: pd.DataFrame, keys: list[str], cosine: float) -> pd.DataFrame:
    """Links (a, b, n) within the groups of equal keys, which follow one another: b is a node that a is linked to or reaches, n how many
    vectors a is linked to in pairs that are counted here. The pairs of all small groups are taken together."""
    cell, lo, hi, own, nodes, mult = (pdf[k].to_numpy() for k in ("cell", "lo", "hi", "own", "node", "mult"))
    c, x = np.stack(pdf["cells"].to_numpy()), pdf["vector"].to_numpy()
    values = pdf[keys].to_numpy()
    cuts = np.concatenate(([0], np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1, [len(pdf)]))
    sizes = np.diff(cuts)
    out = []
    few = np.repeat((sizes <= SMALL) & (sizes > 1), sizes)
    at = np.flatnonzero(few)
    left = np.repeat(cuts[1:], sizes)[at] - at - 1  # members of the group that come after each
    i = np.repeat(at, left)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(left) - left, left)
    # of two blocks, only pairs across them
    across = (lo[i] == hi[i]) | (own[i] != own[j])
    i, j = i[across], j[across]
    for s in range(0, len(i), 65_536):
        a, b = i[s : s + 65_536], j[s : s + 65_536]
        same = np.array([len(u) == len(v) for u, v in zip(x[a], x[b])], dtype=bool)
        a, b = a[same], b[same]
        near = np.zeros(len(a), dtype=bool)
        lengths = np.array([len(v) for v in x[a]])
        for d in np.unique(lengths):
            of = np.flatnonzero(lengths == d)
            near[of] = np.einsum("ij,ij->i", directions(np.stack(x[a[of]])), directions(np.stack(x[b[of]]))) >= cosine
        a, b = a[near], b[near]
        new = counted_here(c, nodes, a, b, cell[a])
        low = np.minimum(nodes[a], nodes[b])
        out.append(pd.DataFrame({"a": np.concatenate([nodes[a], nodes[b]]), "b": np.concatenate([low, low]), "n": np.concatenate([mult[b] * new, mult[a] * new])}))
    for s, e in zip(cuts[:-1], cuts[1:]):
        if e - s > SMALL:
            out.append(linked_blocks(np.stack(x[s:e]), c[s:e], nodes[s:e], mult[s:e], own[s:e], lo[s], hi[s], cell[s], cosine))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({k: np.zeros(0, np.int64) for k in "abn"})


def linked_blocks(x, c, nodes, mult, own, lo, hi, cell, cosine: float) -> pd.DataFrame:
    """The same for one large group: the members of block lo against those of block hi."""
    x = directions(x)
    left = np.flatnonzero(own == lo)
    right = np.flatnonzero(own == hi)
    near = x[left] @ x[right].T >= cosine
    if lo == hi:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    i, j = left[i], right[j]
    new = counted_here(c, nodes, i, j, np.full(len(i), cell))
    counts = np.zeros(len(x), dtype=np.int64)
    np.add.at(counts, i[new], mult[j[new]])
    np.add.at(counts, j[new], mult[i[new]])
    root = nodes.copy()
    while True:
        was = root.copy()
        np.minimum.at(root, i, was[j])
        np.minimum.at(root, j, was[i])
        if (root == was).all():
            break
    touched = np.union1d(i, j)
    return pd.DataFrame({"a": nodes[touched], "b": root[touched], "n": counts[touched]})


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row (id, n_links, component_id, kept) for each row: links are pairs of equal, not null label with cosine >= ``cosine``.

    Equal vectors of a label are one vector with a multiplicity, which counts in n_links. Null, zero and non-finite vectors and
    vectors of different lengths link with nothing; so do rows with null label or null id. ``kept``: the row has the smallest id of its component; a null id is
    kept, and its component is null. Empty table: empty result. Rows that repeat an id count as other vectors. Other columns are not looked at. A cell with
    many members is worked on in pairs of blocks, so that no task holds it, and every linked pair is counted where its first common cell is.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    linkable = usable(F.col("vector")) & F.col("label").isNotNull() & F.col("id").isNotNull()
    rows = materialise(rows.withColumn("sha", F.when(linkable, identity(F.col("vector")))), "lattice-rows")
    found = materialise(
        rows.where("sha is not null").groupBy("label", "sha")
        .agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("mult"), F.first("vector").alias("vector")), "lattice-vectors"
    )

    def place(batches):
        for pdf in batches:
            parts = []
            for _, group in pdf.groupby(pdf["vector"].map(len)):
                parts.append(group.assign(cells=list(cells(directions(np.stack(group["vector"].to_numpy()))))))
            if parts:
                yield pd.concat(parts)[["node", "label", "mult", "vector", "cells"]]

    label_type = rows.schema["label"].dataType.simpleString()
    placed = materialise(
        map_batches(found.select("node", "label", "mult", "vector"), place, f"node long, label {label_type}, mult long, vector array<double>, cells array<long>"),
        "lattice-cells",
    )
    members = placed.select("node", "label", F.explode(F.array_distinct("cells")).alias("cell"))
    crowded = materialise(
        members.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .select("label", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "lattice-crowded"
    )
    dealt = (
        members.join(crowded, ["label", "cell"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("node", "label", "cell", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    )
    work = dealt.join(placed, ["node", "label"])
    parts = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = ["label", "cell", "lo", "hi"]
    work = work.repartition(parts, *keys).sortWithinPartitions(*keys)
    links = materialise(map_batches(work, lambda b: (linked_groups(g, keys, cosine) for g in closed_groups(b, keys)), "a long, b long, n long"), "lattice-links")
    counts = links.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    labels = components(links.where("a <> b").select("a", "b"))
    known = materialise(
        found.select("label", "sha", "node", "mult").join(counts, "node", "left").join(labels, "node", "left")
        .select("label", "sha", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")), "lattice-known"
    )
    return rows.join(known, ["label", "sha"], "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").cast("long").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
    )


def near_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


NEAR_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.other),
parts AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM parts LEFT JOIN counts USING (vec_id)
"""


# ---- forest of random-projection trees -----------------------------------------------------------------------------------


class Forest:
    """Complete trees of one depth: a random unit vector and the median of the sample's projections at each inner node."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        inner = 2**depth - 1
        self.trees, self.depth = trees, depth
        self.normals = rng.normal(size=(trees, inner, sample.shape[1]))
        self.normals /= np.linalg.norm(self.normals, axis=2, keepdims=True)
        self.cuts = np.zeros((trees, inner))
        for t in range(trees):
            held = {0: sample}
            for node in range(inner):
                x = held.pop(node)
                p = x @ self.normals[t, node]
                self.cuts[t, node] = np.median(p) if len(p) else 0.0
                held[2 * node + 1], held[2 * node + 2] = x[p < self.cuts[t, node]], x[p >= self.cuts[t, node]]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree."""
        out = np.zeros((len(x), self.trees), dtype=np.int64)
        for t in range(self.trees):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                right = (x * self.normals[t, node]).sum(axis=1) >= self.cuts[t, node]
                node = 2 * node + 1 + right
            out[:, t] = node - (2**self.depth - 1)
        return out

    def search(self, q: np.ndarray, sizes: np.ndarray, share: float) -> np.ndarray:
        """Leaves of all trees from one queue, by the sum of squared distances to the cuts that are between them and the query, until they hold about the
        wanted share of all vectors: a table (trees, leaves) of booleans."""
        queue = [(0.0, t, 0) for t in range(self.trees)]
        inner, total = 2**self.depth - 1, max(1, sizes[0].sum())
        seen, found = np.zeros(self.trees), np.zeros(sizes.shape, dtype=bool)
        while queue and (not found.any() or 1 - np.prod(1 - seen / total) < share):
            beyond, t, node = heapq.heappop(queue)
            while node < inner:
                off = float(q @ self.normals[t, node] - self.cuts[t, node])
                near, far = (2 * node + 2, 2 * node + 1) if off >= 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (beyond + off * off, t, far))
                node = near
            if sizes[t, node - inner]:
                found[t, node - inner] = True
                seen[t] += sizes[t, node - inner]
        return found


def nearest_of(x: np.ndarray, leaves: np.ndarray, nodes: np.ndarray, q: np.ndarray, wanted: np.ndarray, k: int):
    """For each query, the k + 1 nearest rows of those in a wanted leaf of some tree (by distance, then node), as places of queries and rows, and
    distances. Candidates are told apart by products of matrices; those near the last are measured again by differences."""
    inside = np.zeros((len(q), len(x)), dtype=bool)
    for t in range(leaves.shape[1]):
        inside |= wanted[:, t][:, leaves[:, t]]
    # a power of two, so that nothing is rounded otherwise
    unit = 2.0 ** math.floor(math.log2(max(np.abs(x).max(), np.abs(q).max())))
    xs, qs = x / unit, q / unit
    norms, own = (xs * xs).sum(axis=1), (qs * qs).sum(axis=1)
    rough = np.where(inside, own[:, None] - 2 * (qs @ xs.T) + norms, np.inf)
    last = np.partition(rough, k, axis=1)[:, k] if len(x) > k + 1 else np.full(len(q), np.inf)
    i, j = np.nonzero(inside & (rough <= (last + 1e-9 * (own + norms.max()))[:, None]))
    d = np.sqrt(((xs[j] - qs[i]) ** 2).sum(axis=1)) * unit
    order = np.lexsort((nodes[j], d, i))
    i, j, d = i[order], j[order], d[order]
    kept = np.arange(len(i)) - np.searchsorted(i, i) <= k
    return i[kept], j[kept], d[kept]


def neighbours(
    df: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", share: float = SHARE,
    trees: int = TREES, leaf_rows: int = LEAF_ROWS, sample_rows: int = FOREST_SAMPLE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows, by Euclidean distance, of each row for which ``queries`` holds.

    The trees are grown from at most ``sample_rows`` vectors picked by hash; every vector is in the index. Candidates of the leaves that the shared
    queue yields are ranked by their exact distance, each measured once, whatever number of trees has it; ties go to the smaller id. Null, zero and non-finite
    vectors, null ids and vectors of another length than most take no part. Rows that repeat id and vector are one. Of equal vectors, the k + 1 smallest ids are
    kept, which is all that a result can hold. Fewer than k candidates: all of them. No queries or an empty table: empty result. Other columns are not looked at.

    Every index row is in one block of one region (a region being leaves of the first tree that lie together); a query goes to the blocks of the
    regions that hold some of its leaves, and streams through them. Tables of leaves by regions are bounded by the sample and ``HOMES``.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.where(usable(F.col("vector")) & F.col("id").isNotNull())
    lengths = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not lengths:
        return empty
    rows = materialise(rows.where(F.size("vector") == lengths[0]["d"]).withColumn("sha", identity(F.col("vector"))).dropDuplicates(["id", "sha"]), "forest-rows")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16)))
    some = salted.withColumn("r", F.row_number().over(Window.partitionBy("sha", "salt").orderBy("id"))).where(F.col("r") <= k + 1)
    fewest = some.withColumn("r", F.row_number().over(Window.partitionBy("sha").orderBy("id"))).where(F.col("r") <= k + 1)
    vectors = materialise(
        fewest.groupBy("sha").agg(F.min("id").alias("node"), F.sort_array(F.collect_list("id")).alias("ids"), F.first("vector").alias("vector")), "forest-vectors"
    )
    total = vectors.count()
    picked = vectors.where(F.pmod(F.xxhash64("sha"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, 0.98 * sample_rows / max(1, total))))
    sample = np.array([r["vector"] for r in picked.select("vector").orderBy("vector").limit(sample_rows).collect()]).reshape(-1, lengths[0]["d"])
    depth = max(0, math.ceil(math.log2(max(1, total / leaf_rows))))
    depth = min(depth, int(math.log2(max(1, len(sample) / 8))))
    forest = Forest(sample, trees, depth)

    fold = max(0, depth - int(math.log2(HOMES)))

    def place(batches):
        for pdf in batches:
            x = np.stack(pdf["vector"].to_numpy()) if len(pdf) else np.zeros((0, sample.shape[1]))
            leaves = forest.leaves(x).astype(np.int32)
            yield pdf.assign(leaves=list(leaves), home=leaves[:, 0] >> fold)

    placed = materialise(map_batches(vectors.select("node", "ids", "vector"), place, "node long, ids array<long>, vector array<double>, leaves array<int>, home int"), "forest-leaves")
    cells_ = materialise(placed.select("home", F.posexplode("leaves").alias("tree", "leaf")).groupBy("home", "tree", "leaf").count(), "forest-cells")
    shape = (trees, 2**depth)

    def region(pdf: pd.DataFrame) -> pd.DataFrame:
        has = np.zeros(shape, dtype=bool)
        has[pdf["tree"], pdf["leaf"]] = True
        return pd.DataFrame({"home": pdf["home"].iloc[:1], "n": [int(pdf["count"][pdf["tree"] == 0].sum())], "has": [np.packbits(has).tobytes()]})

    sizes = np.zeros(shape, dtype=np.int64)
    for r in cells_.groupBy("tree", "leaf").agg(F.sum("count").alias("n")).collect():
        sizes[r["tree"], r["leaf"]] = r["n"]
    regions = ready(cells_).groupBy("home").applyInPandas(region, "home int, n long, has binary").collect()
    homes, held = [r["home"] for r in regions], np.array([np.frombuffer(r["has"], dtype=np.uint8) for r in regions]).reshape(len(regions), -1)
    blocks_of = {r["home"]: math.ceil(r["n"] / INDEX_BLOCK) for r in regions}

    def search(batches):
        for pdf in batches:
            out = []
            for qid, q in zip(pdf["id"], pdf["vector"]):
                bits = np.packbits(forest.search(q, sizes, share))
                out += [(homes[h], blocks_of[homes[h]], qid, q, bits.tobytes()) for h in np.flatnonzero((held & bits).any(axis=1))]
            yield pd.DataFrame(out, columns=["home", "blocks", "id", "vector", "bits"])

    asked = map_batches(rows.where("asks").select("id", "vector"), search, "home int, blocks int, id long, vector array<double>, bits binary")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    counted = spark.createDataFrame(list(blocks_of.items()), "home int, blocks int")
    index = placed.join(F.broadcast(counted), "home").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))  # HOMES rows at most
    columns = ["home", "block", "asks", "id", "ids", "vector", "leaves", "bits"]
    work = index.select("home", "block", F.lit(False).alias("asks"), F.col("node").alias("id"), "ids", "vector", "leaves", F.lit(None).cast("binary").alias("bits")).unionByName(
        asked.select("home", "block", F.lit(True).alias("asks"), "id", F.lit(None).cast("array<long>").alias("ids"), "vector", F.lit(None).cast("array<int>").alias("leaves"), "bits")
    ).select(*columns)
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    work = work.repartition(parts, "home", "block").sortWithinPartitions("home", "block", "asks")

    def rank(batches):
        here, parts, block = None, [], None
        for pdf in batches:
            keys = pdf["home"].to_numpy().astype(np.int64) << 32 | pdf["block"].to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(pdf)]))
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if keys[a] != here:
                    here, parts, block = keys[a], [], None
                some = pdf.iloc[a:b]
                asks = some["asks"].to_numpy(dtype=bool)
                if not asks.all():
                    parts.append(some[~asks])
                if asks.any() and parts:
                    if block is None:
                        whole = pd.concat(parts)
                        block = np.stack(whole["vector"].to_numpy()), np.stack(whole["leaves"].to_numpy()), whole["id"].to_numpy(), whole["ids"].to_numpy()
                    yield from ranked(block, some[asks])

    def ranked(block, asks):
        x, leaves, nodes, ids = block
        for s in range(0, len(asks), QUERY_CHUNK):
            part = asks.iloc[s : s + QUERY_CHUNK]
            bits = np.stack([np.frombuffer(b, dtype=np.uint8) for b in part["bits"]])
            wanted = np.unpackbits(bits, axis=1, count=shape[0] * shape[1]).reshape(len(part), *shape).astype(bool)
            i, j, d = nearest_of(x, leaves, nodes, np.stack(part["vector"].to_numpy()), wanted, k)
            yield pd.DataFrame({"query_id": part["id"].to_numpy()[i], "ids": ids[j], "score": d})

    found = map_batches(work, rank, "query_id long, ids array<long>, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id").distinct()
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
