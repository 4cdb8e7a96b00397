"""Near-duplicate texts by Order MinHash, candidates verified by banded alignment.

A text is a sequence of five-word shingles; where one repeats, its n-th occurrence is labelled n, so that a text holds each labelled shingle
once. One Order MinHash value keeps the ``PICKED`` labelled shingles with the smallest hashes and hashes them in text order, so texts share it if they
have the same shingles in the same order. Texts with an equal value in one of ``TABLES`` tables are candidates, and so are texts of up to ``FEW``
shingles that are equal after one or two of these are left out: with so few, every link is of that kind. Two texts are linked if their edit similarity
is 0.8 or more: twice the longest common subsequence of their labelled shingles, found by banded alignment, as a share of both lengths.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import components, discard, map_batches, materialise, table, whole_groups

WORDS = 5
THRESHOLD = 0.8
TABLES = 28
PICKED = 3
#: Texts of so many shingles at most find each other by their shingles themselves: a link of 0.8 between two such leaves out two of each at most.
FEW = 8
#: Tables of the first round, which contracts the large groups.
FIRST_TABLES = 3
#: Members of a bucket, and shingles that they hold, in one block of work.
BLOCK, BLOCK_SHINGLES = 512, 2_000_000
#: How often texts without a possible partner are peeled off after each round; each time others lose shared shingles.
PEELS = 2
_SEEDS = np.random.default_rng(41).integers(1, 2**63, size=(TABLES, 2), dtype=np.uint64) | np.uint64(1)
_STEP = np.array([pow(0x9E3779B97F4A7C15, k, 2**64) for k in range(1, WORDS + 1)], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Hashes of the shingles in text order; a text of one to four words is one shingle, a blank one has none."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(w) - WORDS + 1)
    out = np.full(n, len(w) if len(w) < WORDS else 0, dtype=np.uint64)
    for k in range(min(WORDS, len(w))):
        out += w[k : k + n] * _STEP[k]
    return mixed(out)


def labelled(s: np.ndarray) -> np.ndarray:
    """Hashes of the shingles with the number of earlier occurrences."""
    order = np.argsort(s, kind="stable")
    start = np.concatenate(([True], s[order][1:] != s[order][:-1]))[: len(s)]
    if start.all():
        return mixed(s)
    label = np.empty(len(s), dtype=np.uint64)
    label[order] = np.arange(len(s)) - np.maximum.accumulate(np.where(start, np.arange(len(s)), 0))
    return mixed(s + label * np.uint64(0xD1B54A32D192ED03))


def sketch(s: np.ndarray) -> np.ndarray:
    """The keys of a text's labelled shingles: the Order MinHash value of each table, and the exact keys of a text of few."""
    out = order_min_hash(s)
    return (np.concatenate([out, exact_keys(s)]) if len(s) <= FEW else out).view(np.int64)


def order_min_hash(s: np.ndarray) -> np.ndarray:
    ranked = mixed(s[None, :] * _SEEDS[:, :1] + _SEEDS[:, 1:])
    k = min(PICKED, len(s))
    picked = np.argpartition(ranked, k - 1, axis=1)[:, :k] if k < len(s) else np.tile(np.arange(k), (TABLES, 1))
    picked.sort(axis=1)
    out = np.arange(1, TABLES + 1, dtype=np.uint64)
    for j in range(k):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + s[picked[:, j]])
    return out


def exact_keys(s: np.ndarray) -> np.ndarray:
    """Hashes of the sequence, and of the sequence without one or two of its shingles."""
    n = len(s)
    left_out = [(), *((i,) for i in range(n) if n > 1), *((i, j) for i in range(n) for j in range(i) if n > 2)]
    out = np.full(len(left_out), 0x452821E638D01377, dtype=np.uint64)
    for row, gone in enumerate(left_out):
        for x in np.delete(s, gone):
            out[row : row + 1] = mixed(out[row : row + 1] * np.uint64(0x9E3779B97F4A7C15) + x)
    return out


def increasing(where: list[int]) -> int:
    """Length of the longest increasing subsequence."""
    tails: list[int] = []
    for x in where:
        i = bisect_left(tails, x)
        if i == len(tails):
            tails.append(x)
        else:
            tails[i] = x
    return len(tails)


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Edit similarity of two sequences of labelled shingles, or less where it is under the threshold: an alignment that reaches the threshold
    leaves no room outside the band, so that the banded one is exact there."""
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    order = np.argsort(ia)
    ia, ib = ia[order], ib[order]
    both = len(a) + len(b)
    if not both or 2 * len(ib) < threshold * both:
        return 0.0
    band = max(len(a), len(b)) - threshold / 2 * both
    at = ib[np.abs(ia - ib) <= band + 1]
    n = len(at) if len(at) < 2 or (at[1:] > at[:-1]).all() else increasing(at.tolist())
    return 2 * n / both


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sha, keys) of every row; null and blank texts have no keys."""

    def run(batches):
        for pdf in batches:
            hashes = WordHashes()
            keys = []
            for t in pdf["text"]:
                s = labelled(shingles(t, hashes))
                keys.append(sketch(s) if len(s) else None)
            yield pd.DataFrame({"id": pdf["id"], "sha": pdf["sha"], "keys": keys})

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.sha2(F.col(text_col).cast("binary"), 256).alias("sha"), F.col(text_col).alias("text"))
    return map_batches(src, run, "id long, sha string, keys array<long>")


def accepted(pairs: DataFrame, seqs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that banded alignment confirms."""

    def run(batches):
        for pdf in batches:
            linked = [
                similarity(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), threshold) >= threshold
                for x, y in zip(pdf["x"], pdf["y"])
            ]
            yield pdf.loc[linked, ["a", "b"]]

    both = (
        materialise(pairs, "omh-pairs").join(seqs.select(F.col("node").alias("a"), F.col("seq").alias("x")), "a")
        .join(seqs.select(F.col("node").alias("b"), F.col("seq").alias("y")), "b")
        .select("a", "b", "x", "y")
    )
    return materialise(map_batches(both, run, "a long, b long"), "omh-links")


def possible(threshold: float, n: str, u: str, n2: str, u2: str) -> Column:
    """Whether two texts can be linked: neither has its u unshared shingles in common with the other."""
    most = F.least(F.col(n) - F.col(u), F.col(n2) - F.col(u2))
    return 2 * most >= (threshold - 1e-9) * (F.col(n) + F.col(n2))


def alive(entries: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Entries, with the components that labels give, of the buckets that hold more than one component."""
    if labels is not None:
        entries = entries.join(labels, "node", "left").select("key", "t", "node", F.coalesce("component", "node").alias("comp"), "n", "u")
    entries = materialise(entries, "omh-entries")
    keys = materialise(entries.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key"), "omh-alive")
    return materialise(entries.join(keys, "key").select("key", "t", "node", "comp", "n", "u"), "omh-entries")


def peeled(entries: DataFrame, seqs: DataFrame, threshold: float) -> DataFrame:
    """Count u, the shingles of a text that no other text of these buckets has, and drop the texts that hence have no
    partner: whoever links to a text of n shingles has ``threshold / (2 - threshold)`` * n of them at least."""

    def spread(batches):
        for pdf in batches:
            yield pd.DataFrame({"node": pdf["node"], "h": [np.frombuffer(x, dtype=np.int64) for x in pdf["seq"]]})

    nodes = materialise(entries.select("node").distinct(), "omh-nodes")
    held = map_batches(seqs.join(nodes, "node", "left_semi").select("node", "seq"), spread, "node long, h array<long>")
    alone = (
        held.select("node", F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("texts"), F.min("node").alias("node"))
        .where("texts = 1").groupBy("node").agg(F.count(F.lit(1)).cast("int").alias("alone"))
    )
    counted = entries.drop("u").join(materialise(alone, "omh-alone"), "node", "left").withColumn("u", F.coalesce("alone", F.lit(0)))
    return alive(counted.where(F.col("u") <= (1 - threshold / (2 - threshold) + 1e-9) * F.col("n")).select("key", "t", "node", "comp", "n", "u"))


def compared(entries: DataFrame, seqs: DataFrame, threshold: float) -> DataFrame:
    """Links between the components of each bucket. Members are dealt to blocks of about BLOCK texts or BLOCK_SHINGLES shingles, whichever is less, and the
    blocks compared two by two, so that no task holds a large bucket; a pair is a row only if it is a link that joins two components."""
    sizes = materialise(
        entries.groupBy("key").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.col("n").cast("long")) / BLOCK_SHINGLES)).cast("int").alias("blocks")), "omh-sizes"
    )
    work = (
        entries.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "comp", "n", "u")
        .join(seqs, "node")
    )
    parts = max(8, int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    work = work.repartition(parts, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return materialise(map_batches(work, lambda b: whole_groups(b, ["key", "lo", "hi"], lambda g: linked(g, threshold)), "a long, b long"), "omh-links")


def linked(group: pd.DataFrame, threshold: float) -> pd.DataFrame | None:
    n, u, comp, node = (group[c].to_numpy() for c in ("n", "u", "comp", "node"))
    left = np.flatnonzero(group["own"] == group["lo"].iloc[0])
    right = np.flatnonzero(group["own"] == group["hi"].iloc[0])
    i, j = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
    most = np.minimum((n - u)[i], (n - u)[j])
    open_ = (comp[i] != comp[j]) & (2 * most >= (threshold - 1e-9) * (n[i] + n[j]))
    if group["lo"].iloc[0] == group["hi"].iloc[0]:
        open_ &= i < j
    i, j = i[open_], j[open_]
    if not len(i):
        return None
    seq = [np.frombuffer(x, dtype=np.uint64) for x in group["seq"]]
    if len(i) > 64:
        # shingles in common, counted for all pairs of the blocks at once
        every, where = np.unique(np.concatenate(seq), return_inverse=True)
        doc = np.repeat(np.arange(len(seq)), [len(x) for x in seq])
        shared = np.flatnonzero(np.bincount(where, minlength=len(every)) > 1)
        number = np.full(len(every), -1)
        number[shared] = np.arange(len(shared))
        column = number[where]
        common = np.zeros((len(seq), len(seq)), dtype=np.float32)
        for c in range(0, len(shared), 4096):
            inside = (column >= c) & (column < c + 4096)
            m = np.zeros((len(seq), 4096), dtype=np.float32)
            m[doc[inside], column[inside] - c] = 1
            common += m @ m.T
        k = common[i, j]
        enough = 2 * k >= (threshold - 1e-9) * (n[i] + n[j])
        i, j = i[enough], j[enough]
    root = dict(zip(comp.tolist(), comp.tolist()))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist()):
        x, y = find(int(comp[a])), find(int(comp[b]))
        if x != y and similarity(seq[a], seq[b], threshold) >= threshold:
            root[max(x, y)] = min(x, y)
            out.append((node[a], node[b]))
    return pd.DataFrame(out, columns=["a", "b"])


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(id, sha) of every row, sha being that of its text, and the class of every text: (sha, class)."""
    base = materialise(sketches(docs, id_col, text_col), "omh")
    exact = materialise(
        base.where("sha is not null").groupBy("sha").agg(F.min("id").alias("id"), F.first("keys").alias("keys"))
        .select("sha", F.coalesce("id", F.xxhash64("sha")).alias("node"), "keys"), "omh-texts"
    )
    buckets = (
        exact.where("keys is not null").select("node", F.posexplode("keys").alias("t", "key"))
        .groupBy("key", "node").agg(F.min("t").alias("t"))
    )
    buckets = materialise(buckets, "omh-buckets")
    shared = materialise(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "omh-shared")
    found = buckets.join(shared, "key").select("key", "t", "node")
    needed = materialise(found.select("node").distinct(), "omh-nodes")
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.sha2(F.col(text_col).cast("binary"), 256))).alias("node"), F.col(text_col).alias("text"))

    def sequences(batches):
        for pdf in batches:
            hashes = WordHashes()
            yield pd.DataFrame({"node": pdf["node"], "seq": [labelled(shingles(t, hashes)).tobytes() for t in pdf["text"]]})

    seqs = map_batches(texts.join(needed, "node", "left_semi"), sequences, "node long, seq binary")
    seqs = materialise(seqs.dropDuplicates(["node"]), "omh-sequences")
    lengths = seqs.select("node", F.length("seq").alias("bytes"))
    entries = materialise(
        found.join(lengths, "node").select("key", "t", "node", F.col("node").alias("comp"), (F.col("bytes") / 8).cast("int").alias("n"), F.lit(0).alias("u")), "omh-entries"
    )
    discard(buckets, shared, needed)
    links: DataFrame | None = None
    for step in range(2):
        # the first pivots are the smallest ids, so that tables agree on them; the next are picked by hash
        pivot = F.min("node") if step == 0 else F.min_by("node", F.xxhash64("node", F.lit(step)))
        chosen = entries.where(F.col("t") < FIRST_TABLES) if step == 0 else entries
        pivots = materialise(
            chosen.groupBy("key").agg(pivot.alias("pivot"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
            .select("key", "pivot"), "omh-pivots"
        )
        own = pivots.join(entries.select("key", F.col("node").alias("pivot"), F.col("comp").alias("own"), F.col("n").alias("n_p"), F.col("u").alias("u_p")), ["key", "pivot"])
        own = materialise(own, "omh-pivots")
        pairs = (
            chosen.join(own, "key").where((F.col("comp") != F.col("own")) & possible(threshold, "n", "u", "n_p", "u_p"))
            .select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
        )
        found = accepted(pairs, seqs, threshold)
        links = found if links is None else links.unionByName(found)
        entries = alive(entries.drop("comp"), components(links))
        for _ in range(PEELS):
            entries = peeled(entries, seqs, threshold)
        discard(pivots, own)
    links = links.unionByName(compared(entries, seqs, threshold))
    labels = components(links)
    found = exact.select("sha", "node").join(labels, "node", "left").select("sha", F.coalesce("component", "node").alias("class"))
    found = materialise(found, "omh-classes")
    discard(exact, seqs, entries)
    rows = base.select("id", "sha")
    rows._shared_path = base._shared_path
    return rows, found


def own_id(id_: str = "id", sha: str = "sha") -> Column:
    return F.coalesce(F.col(id_), F.xxhash64(F.coalesce(F.col(sha), F.lit(""))))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row (id, class_id, kept) for each row of docs: class_id is the smallest id among the texts reached by links.

    Equal texts are one text from the start. Null texts stand alone each by its id; empty texts are copies of one another, texts of one to four words
    are linked if they have equal words. Texts that share an id are taken as one document. A null id takes a number
    hashed from its text. ``kept`` holds for the rows whose id is the class id, so repeated rows are all kept or all not. Other columns are not looked at.
    An empty table gives an empty result.

    Large buckets: all members are compared with a pivot, in two rounds; pairs within one component need no comparison. Texts with more
    unshared shingles than a link allows are peeled off, which is exact. What pairs are left are compared block by block, none is dropped.
    """
    rows, found = classes(docs, id_col, text_col, threshold)
    return rows.join(found, "sha", "left").select(
        F.col("id").alias(id_col), F.coalesce("class", own_id()).alias("class_id"), (own_id() == F.coalesce("class", own_id())).alias("kept")
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs without near copies, all columns kept: of each class, one row that has the class id. Rows of null text all stay. Rows that
    repeat, or have a null id, leave one. Columns of docs whose names begin with ``_omh_`` are not allowed."""
    rows, found = classes(docs, id_col, text_col, threshold)
    many = materialise(
        rows.where("sha is not null").join(found, "sha").groupBy("class", "id", "sha").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("best", own_id() == F.col("class")), "omh-members"
    )
    discard(rows, found)
    # rows that the class id does not tell apart
    several = many.where("best").groupBy("class").agg(F.sum("n").alias("rows")).where("rows > 1").select("class")
    unclear = materialise(many.where("best").join(several, "class").select("class", "id", "sha"), "omh-unclear")
    other = materialise(many.where("not best").select("id", "sha").unionByName(unclear.select("id", "sha")), "omh-other")
    discard(many)
    # texts are long, so each of the two joins moves them once at most; what the first has shuffled goes before the second begins
    keyed = docs.withColumn("_omh_sha", F.sha2(F.col(text_col).cast("binary"), 256)).withColumn("_omh_id", F.col(id_col).cast("long"))
    same = (F.col("_omh_sha") == F.col("_omh_s")) & F.col("_omh_id").eqNullSafe(F.col("_omh_i"))
    names = {"sha": "_omh_s", "id": "_omh_i", "class": "_omh_class"}
    chosen = materialise(keyed.join(unclear.withColumnsRenamed(names), same).dropDuplicates(["_omh_class"]).select(*docs.columns), "omh-chosen")
    discard(unclear)
    return keyed.join(other.withColumnsRenamed(names), same, "left_anti").select(*docs.columns).unionByName(chosen)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH RECURSIVE texts AS (SELECT text, min(doc_id) AS node FROM documents WHERE text IS NOT NULL GROUP BY text),
words AS (SELECT node, string_split_regex(trim(lower(text), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '\\s+') AS w FROM texts WHERE regexp_matches(text, '\\S')),
lists AS (SELECT node, list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')) AS s FROM words),
spread AS (SELECT node, len(s) AS n, unnest(s) AS shingle FROM lists),
each AS (SELECT node, n, shingle, row_number() OVER (PARTITION BY node, shingle) AS label FROM spread),
links AS (
  SELECT a.node AS a, b.node AS b FROM each a JOIN each b ON a.shingle = b.shingle AND a.label = b.label AND a.node <> b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 2 * count(*) >= 0.8 * (a.n + b.n)
),
reach AS (SELECT node, node AS other FROM texts UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.other),
classes AS (SELECT node, min(other) AS class_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, d.doc_id = coalesce(class_id, d.doc_id) AS kept
FROM documents d LEFT JOIN texts USING (text) LEFT JOIN classes USING (node)
"""
