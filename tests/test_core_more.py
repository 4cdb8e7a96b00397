"""Places, ways to amend, ties, and option values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewater.functions import aggregates as A
from tidewater.functions import math as M
from tidewater.operators import grouping as G
from tidewater.operators import joins as J
from tidewater.operators import tables as B
from tidewater.streaming import pubsub as P


def test_numbered_rows(spark):
    rng = random.Random(1)
    values = [(rng.randrange(40), k) for k in range(500)]
    got = {r["k"]: r["_at"] for r in B.numbered(spark.createDataFrame(values, "v int, k int").repartition(5), ["v", "k"]).collect()}
    assert got == {k: i for i, (_, k) in enumerate(sorted(values))}
    assert B.numbered(spark.createDataFrame([], "v int, k int"), ["v"]).count() == 0


@pytest.mark.parametrize("rows", [[], [(1, 1)], [(k, k // 3) for k in range(200)], [(k, 0 if k == 150 else k) for k in range(200)], [(k, None if k < 3 else k) for k in range(50)]])
def test_is_sorted(spark, rows):
    values = [v for _, v in rows]
    want = all((a is None, a or 0) <= (b is None, b or 0) or a is None for a, b in zip(values, values[1:]))
    df = spark.createDataFrame(rows, "k int, v int").repartition(7)
    assert B.is_sorted(df, ["v"], ["k"]).first()["sorted"] is want


def test_first_and_last_of_nulls(spark):
    df = spark.createDataFrame([(1, None, 1), (1, 5.0, 2), (1, None, 3), (2, 7.0, 1)], "g int, x double, o int")
    got = {r["g"]: (r["a"], r["b"]) for r in df.groupBy("g").agg(A.first("x", "o").alias("a"), A.last("x", "o").alias("b")).collect()}
    assert got == {1: (None, None), 2: (7.0, 7.0)}
    plan = df.groupBy("g").agg(A.first("x", "o").alias("a"))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_argmax(spark):
    df = spark.createDataFrame([(1, "b", -(2**63)), (2, "c", -(2**63)), (3, "c", None), (4, None, None)], "i int, s string, n long")
    assert tuple(df.agg(A.argmax("s", "i").alias("s"), A.argmax("n", "i").alias("n"), A.argmin("s", "i").alias("l")).first()) == (2, 1, 1)
    assert df.where("s is null").agg(A.argmax("s", "i").alias("s")).first()["s"] is None


def test_scatter_ways(spark):
    df = spark.createDataFrame([(0, 5), (1, 5), (2, 5)], "i int, x int")
    more = spark.createDataFrame([(0, 3), (0, 9), (2, 6), (7, 1)], "at int, v int")
    for how, want in (("add", [17, 5, 11]), ("min", [3, 5, 5]), ("max", [9, 5, 6])):
        assert [r["x"] for r in G.scatter(df, "i", more, "at", "v", "x", how).orderBy("i").collect()] == want
    with pytest.raises(ValueError):
        G.scatter(df, "i", more, "at", "v", "x", "mean")


def test_window_join_ties(spark):
    t = spark.createDataFrame([(1, 10)], "id int, time int")
    q = spark.createDataFrame([(5, k, float(k)) for k in range(20)], "time int, seq int, px double").repartition(4)
    made = J.wj(F.col("time") - 10, F.col("time"), ["time"], t, q, {"a": ("first", "px"), "b": ("last", "px")}, ["id"], 7, order=["seq"])
    assert tuple(made.select("a", "b").first()) == (0.0, 19.0)


def test_first_match_takes_the_first_by_order(spark):
    x = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    y = spark.createDataFrame([(1, 3, "c", {"a": 1}), (1, 1, "a", {"b": 1}), (None, 1, "n", None)], "k int, o int, v string, m map<string,int>")
    got = {r["k"]: r["v"] for r in J.lj(x, B.xkey("k", y), ["o"]).collect()}
    assert got == {1: "a", 2: None, None: "n"}


def test_keyless_asof_is_cut(spark):
    rng = random.Random(2)
    x, y = sorted(rng.sample(range(1000), 60)), sorted(rng.sample(range(1000), 80))
    left = spark.createDataFrame([(t, i) for i, t in enumerate(x)], "time int, id int")
    right = spark.createDataFrame([(t, t * 10) for t in y], "time int, v int")
    got = {r["id"]: r["v"] for r in J.aj(["time"], left, right).collect()}
    assert got == {i: max((u * 10 for u in y if u <= t), default=None) for i, t in enumerate(x)}
    assert J.aj(["time"], left.limit(0), right).count() == 0


def test_option_values(spark):
    cdf = lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2)))
    rows = [(s, k, t, v, c) for s in (80.0, 100.0) for k in (90.0, 110.0) for t in (0.1, 2.0) for v in (0.2, 0.5) for c in (True, False)]
    df = spark.createDataFrame(rows, "s double, k double, t double, v double, c boolean")
    made = M.black_scholes(*(F.col(c) for c in "sktvc"))
    for r in df.select("*", *(x.alias(n) for n, x in made.items())).collect():
        d1 = (math.log(r.s / r.k) + (0.045 + r.v**2 / 2) * r.t) / (r.v * math.sqrt(r.t))
        d2, kept = d1 - r.v * math.sqrt(r.t), r.k * math.exp(-0.045 * r.t)
        price = r.s * cdf(d1) - kept * cdf(d2) if r.c else kept * cdf(-d2) - r.s * cdf(-d1)
        assert r.price == pytest.approx(price, abs=0.006) and r.delta == pytest.approx(cdf(d1) - (not r.c), abs=1e-4)


def test_drain_leaves_nothing_on_the_driver(spark, tmp_path):
    spark.createDataFrame([(k, k % 3) for k in range(90)], "v int, g int").write.parquet(str(tmp_path / "in"))
    df = P.follow_file(spark, str(tmp_path / "in"), "*.parquet")
    assert {r["g"]: r["n"] for r in P.drain(df.groupBy("g").agg(F.count(F.lit(1)).alias("n"))).collect()} == {0: 30, 1: 30, 2: 30}
    assert P.drain(df.where("v < 10"), "append").count() == 10
