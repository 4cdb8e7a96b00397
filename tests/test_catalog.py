"""Every catalogue query against the SQL that stands beside it."""

import os

import duckdb
import pytest

from tidewater import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, list):
        return [plain(y) for y in x]
    return x.isoformat() if hasattr(x, "isoformat") else x


def rows(t):
    names = sorted(t.column_names)
    return sorted(repr([plain(r[c]) for c in names]) for r in t.to_pylist())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, FOLDER).toArrow(), duck.sql(catalog.SQL[name]).to_arrow_table()
    assert sorted(ours.column_names) == sorted(theirs.column_names)
    assert rows(ours) == rows(theirs)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_flagship(spark):
    df = catalog.flagship(spark, FOLDER)
    assert df.columns == ["sym", "hour", "o", "h", "l", "c", "v", "vwap", "spread"]
    assert df.count() > 0


def test_count_guard():
    assert len(catalog.QUERIES) >= 110 and len(catalog.SQL) >= 107
