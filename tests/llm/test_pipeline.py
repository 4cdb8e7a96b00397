"""The stages one after the other, each held against what it should do to its own input."""

import os

import pytest

import __spark_entry__
import corpus_pipeline
from tidewater.llm import pii, registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        kept.append((name, out.columns, [r.asDict() for r in out.collect()]))
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert names == ["quality", "near duplicates", "personal data", "mixture", "pieces"]
    for _, columns, _ in kept[:-1]:
        assert columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good, single, clean, mixed, encoded = (rows for *_, rows in kept)
    assert 0 < len(single) < len(good) and len(clean) == len(single)
    before = {r["doc_id"]: r["text"] for r in single}
    for r in clean:
        assert not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        if not pii.base_spans(before[r["doc_id"]]):
            assert r["text"] == before[r["doc_id"]]
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in clean}
    assert len(encoded) == len(mixed) and all(r["n_pieces"] == len(r["piece_ids"]) for r in encoded)


def brute_force_groups(rows):
    """Groups of near copies: equal texts, and edit similarity of five-word shingles."""
    from collections import Counter

    texts = {}
    for r in rows:
        texts.setdefault(r["text"], []).append(r["doc_id"])
    node = {t: min(ids) for t, ids in texts.items() if t is not None}
    parent = {i: i for i in node.values()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = {}
    for t, i in node.items():
        w = t.lower().split()
        bags[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)) if w)
    ids = sorted(bags)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if bags[a] and bags[b] and 2 * (bags[a] & bags[b]).total() >= 0.8 * (bags[a].total() + bags[b].total()):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {r["doc_id"]: find(node[r["text"]]) if r["text"] is not None else r["doc_id"] for r in rows}


def test_each_stage_against_a_plain_version(spark):
    """Kept documents are those of the model's score; copies those of brute force; texts without mentions stay; draws are the quantiles; ids decode."""
    from pyspark.sql import functions as F

    from tidewater.llm import pieces, quality
    from tidewater.llm.common import table

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    model = quality.train(docs, table(spark, FOLDER, "labels"), quality.learnable)
    good = {r["doc_id"] for r in quality.score(docs, model).collect() if r["score"] >= 0.3}
    assert {r["doc_id"] for r in stages["quality"](spark, docs, FOLDER).collect()} == good
    groups = brute_force_groups(rows)
    assert {r["doc_id"] for r in stages["near duplicates"](spark, docs, FOLDER).collect()} == set(groups.values())
    clean = {r["doc_id"]: r["text"] for r in stages["personal data"](spark, docs, FOLDER).collect()}
    for r in rows:
        if not pii.base_spans(r["text"]):
            assert clean[r["doc_id"]] == r["text"]
        else:
            assert not pii.base_spans(clean[r["doc_id"]])
    ids = stages["pieces"](spark, docs, FOLDER)
    vocabulary = pieces.Pieces.load(pieces.default_model())
    text = {r["doc_id"]: r["text"] for r in rows}
    for r in ids.collect():
        assert pieces.decode(r["piece_ids"], vocabulary) == text[r["doc_id"]] and r["round_trip"]
    mixed = stages["mixture"](spark, docs, FOLDER)
    assert mixed.where(~F.col("doc_id").isin([r["doc_id"] for r in rows])).count() == 0


@pytest.mark.parametrize("rows", [
    [],
    [(None, None, None, None, None, 1), (None, "", None, "a", 0, 1), (1, "a b", "en", "a", 3, 1), (1, "a b", "en", "a", 3, 1), (2, "w " * 30_000, "en", None, None, 1)],
])
def test_stages_on_odd_input(spark, rows):
    """Empty tables, nulls, empty and long texts, repeated rows, other columns: no stage fails, and columns stay those of documents."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, piece_ids int")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        got = out.collect()
        if name != "pieces":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "near duplicates" and rows:
            assert sorted((r["doc_id"] or 0, len(r["text"] or "-")) for r in got) == [(0, 1), (0, 1), (1, 3), (2, 60_000)]
        if name in ("personal data", "pieces"):
            assert len(got) == len(rows)


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


def test_entry_has_all():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in registry.queries()} == {f"op{k}" for k in range(1, 11)} and set(registry.queries()) | {"pipeline"} <= names
    assert set(registry.oracle_sql()) <= set(registry.queries())
