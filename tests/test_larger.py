"""Queries and operators on values and tables beyond those of the test tables."""

import datetime
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewater import catalog
from tidewater.operators import tables as B

SORTS = ["sort_places", "sort_places_down", "sort_places_lines"]


def test_products_beyond_the_decimal(spark, tmp_path):
    """Groups 1 and 2: a product that the decimal holds. 3: one that it doesn't. 4: one beyond doubles."""
    lines = [(1, 0.25)] * 3 + [(501, 0.1)] + [(2, 0.07)] * 40 + [(3, 0.1)] * 600 + [(4, 0.1)] * 8000
    spark.createDataFrame([(k,) for k in (1, 501, 2, 3, 4, 5)], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r["g"]: r["prd"] for r in catalog.QUERIES["agg_prd"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert got[3] == pytest.approx(1.1**600, rel=1e-12) and got[3] > 1e22 and got[4] == math.inf
    con = duckdb.connect()
    for t, where in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet' WHERE {where} NOT IN (3, 4)")
    assert {g: v for g, v in got.items() if g < 3} == dict(con.sql(catalog.SQL["agg_prd"]).fetchall())


@pytest.mark.parametrize("most", [1_000, 7_000, 100_000])
def test_numbered_in_many_ranges(spark, monkeypatch, most):
    """Sizes of ranges fit the rows, also where the ends of ranges come from a sample and the rows have columns that the order hasn't."""
    monkeypatch.setattr(B, "RANGE_MOST", most, raising=False)
    monkeypatch.setattr(B, "RANGE_LEAST", 100, raising=False)
    df = spark.range(40_000).select(F.col("id"), F.xxhash64("id").alias("v"), (F.col("id") % 7).cast("string").alias("s"), (F.col("id") * 3).alias("x"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = B.numbered(df, ["s", "v"]).select("id", "_at", "x", "s", "v").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["_at"] for r in sorted(got, key=lambda r: (r["s"], r["v"]))] == list(range(40_000))
    assert all(r["x"] == 3 * r["id"] for r in got)


def test_numbered_up_and_down(spark, monkeypatch):
    """As the sorts have it: NULLs first on the way up, last on the way down; NaN above all; many equals."""
    monkeypatch.setattr(B, "RANGE_MOST", 100)
    rng = random.Random(3)
    times = [None, *(datetime.datetime(2024, 10, 27, 0, 59, 59, k) + datetime.timedelta(hours=k % 3) for k in range(40))]
    rows = [(k, rng.choice([None, "", "a", 'b"\\', "é"]), rng.choice([None, math.nan, -0.0, 0.0, math.inf, -1.5, 2.25]), rng.choice(times)) for k in range(4_000)]
    df = spark.createDataFrame(rows, "k int, s string, x double, t timestamp").repartition(3)
    for down in ([], ["s"], ["s", "x", "t"], ["t", "x"]):
        up = [c for c in ("s", "x", "t") if c not in down]
        want = [r["k"] for r in df.orderBy(*(F.desc_nulls_last(c) for c in down), *(F.asc_nulls_first(c) for c in up), "k").collect()]
        got = B.numbered(df, [*up, "k"], down=down).select("k", "_at").collect()
        assert [r["k"] for r in sorted(got, key=lambda r: r["_at"])] == want
        assert sorted(r["_at"] for r in got) == list(range(4_000))


@pytest.mark.parametrize("name", SORTS)
def test_sorts_in_ranges(spark, tmp_path, monkeypatch, name):
    """Same rows as the SQL in many ranges; only sizes of ranges come together in one task."""
    monkeypatch.setattr(B, "RANGE_MOST", 500, raising=False)
    rng, day = random.Random(4), datetime.datetime(1995, 1, 1)
    flags = lambda k: (rng.choice("ANR"), rng.choice("FO"), day + datetime.timedelta(days=rng.randrange(90)))
    lines = [(k // 4, rng.randrange(50), rng.randrange(9), k % 4 + 1, 1.0 * rng.randrange(50), 9.5 * rng.randrange(50), 0.01 * rng.randrange(9), 0.02, *flags(k)) for k in range(6_000)]
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(lines, kinds).write.parquet(str(tmp_path / "lineitem.parquet"))
    orders = [(k, rng.choice(["1-URGENT", "2-HIGH", "5-LOW"]), 1.5 * rng.randrange(400)) for k in range(6_000)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderpriority string, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    df = catalog.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(map(tuple, df.collect())) == sorted(con.sql(catalog.SQL[name]).fetchall())
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    alone = [below for line, below in zip(plan, plan[1:]) if "Exchange SinglePartition" in line]
    assert alone and all("HashAggregate" in below for below in alone)
