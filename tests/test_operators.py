import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import grouping as G
from tidewater.operators import joins as J
from tidewater.operators import tables as B


@pytest.fixture(scope="module")
def market(spark):
    trade = spark.createDataFrame([("a", 3, 100), ("b", 4, 200), ("a", 9, 300)], "sym string, time long, px long")
    quote = spark.createDataFrame([("a", 1, 10, 15, 0), ("a", 5, 11, 16, 1), ("b", 2, 20, 25, 2), ("a", 8, 12, 18, 3)], "sym string, time long, bid long, ask long, n long")
    return trade, quote


def column(df, name, by):
    return [r[name] for r in df.orderBy(*by).collect()]


def test_keyed_joins(spark):
    lt = spark.createDataFrame([(0, "a", 10), (1, "b", 20), (2, "c", 30), (3, "a", 40)], "i long, s string, p long")
    kv = B.xkey("s", spark.createDataFrame([("a", 100, 0), ("b", 200, 1), ("a", 999, 2)], "s string, x long, n long"))
    assert column(J.lj(lt, kv, ["n"]), "x", ["i"]) == [100, 200, None, 100]
    assert J.ij(lt, kv, ["n"]).count() == 3
    assert J.ej("s", lt, B.unkey(kv), ["n"]).count() == 3
    x = spark.createDataFrame([(1, 2), (3, 4)], "a long, b long")
    y = spark.createDataFrame([(5, 7), (6, 8)], "b long, c long")
    assert column(J.uj(x, y), "c", ["b"]) == [None, None, 7, 8]
    p = spark.createDataFrame([(0, "a", 1), (1, "b", 1), (2, "c", 1)], "i long, s string, p long")
    assert column(J.pj(p, B.xkey("s", spark.createDataFrame([("a", 10), ("b", 20)], "s string, p long"))), "p", ["i"]) == [11, 21, 1]
    with pytest.raises(ValueError):
        J.pj(p, B.xkey("s", kv.df))


def test_values_overwrite(spark):
    t = spark.createDataFrame([("a", 1), ("z", 2)], "s string, v long")
    kv = B.xkey("s", spark.createDataFrame([("a", 7)], "s string, v long"))
    assert column(J.lj(t, kv), "v", ["s"]) == [7, None]


def test_as_of(market):
    trade, quote = market
    assert column(J.aj(["sym", "time"], trade, quote, ["n"]), "bid", ["time"]) == [10, 20, 12]
    assert column(J.aj0(["sym", "time"], trade, quote, ["n"]), "time", ["px"]) == [1, 2, 8]
    assert J.asof(quote, {"sym": "a", "time": 6}, "time", ["n"]).first()["bid"] == 11
    assert J.asof(quote, {"sym": "a", "time": 0}, "time", ["n"]).count() == 0


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("width", [None, 7])
def test_as_of_against_brute_force(spark, seed, keys, width):
    rng = random.Random(seed)
    x = [(i, rng.choice(["a", "b", "c", None]), rng.choice([*range(40), None])) for i in range(60)]
    y = [(i, rng.choice(["a", "b", None]), rng.choice([*range(40), None]), rng.choice([1, 2, None])) for i in range(50)]
    left = spark.createDataFrame(x, "i long, k string, t long")
    right = spark.createDataFrame(y, "n long, k string, t long, v long")
    got = {r["i"]: (r["n"], r["v"]) for r in J.aj([*keys, "t"], left.select("i", *keys, "t"), right.select("n", *keys, "t", "v"), ["n"], slice_width=width).collect()}
    for i, k, t in x:
        best = [r for r in y if t is not None and r[2] is not None and r[2] <= t and (not keys or r[1] == k)]
        want = max(best, key=lambda r: (r[2], r[0]), default=None)
        assert got[i] == ((want[0], want[3]) if want else (None, None))


def test_window_join(market):
    trade, quote = market
    many = {"s": ("sum", "bid"), "n": ("count", None), "a": ("avg", "bid"), "hi": ("max", "ask")}
    got = J.wj(F.col("time") - 2, F.col("time"), ["sym", "time"], trade, quote, many, ["px"], 3).orderBy("px").collect()
    assert [(r["s"], r["n"], r["a"], r["hi"]) for r in got] == [(10, 1, 10, 15), (20, 1, 20, 25), (12, 1, 12, 18)]
    free = J.wj(F.col("time") - 2, F.col("time"), ["time"], trade, quote, {"b": ("max", "bid")}, ["px"], 3)
    assert column(free, "b", ["px"]) == [20, 20, 12]


@pytest.mark.parametrize("width", [1, 4, 100])
def test_window_join_against_brute_force(spark, width):
    rng = random.Random(width)
    t = [(i, rng.choice("ab"), rng.randrange(50), rng.randrange(-2, 9)) for i in range(40)]
    q = [(rng.choice("ab"), rng.randrange(50), rng.random()) for _ in range(80)]
    left = spark.createDataFrame(t, "i long, k string, t long, w long")
    right = spark.createDataFrame(q, "k string, t long, v double")
    made = J.wj(F.col("t") - F.col("w"), F.col("t"), ["k", "t"], left, right, {"n": ("count", None), "s": ("sum", "v"), "lo": ("min", "v")}, ["i"], width)
    got = {r["i"]: r for r in made.collect()}
    for i, k, at, w in t:
        inside = [v for kk, tt, v in q if kk == k and at - w <= tt <= at]
        assert (got[i]["n"], got[i]["lo"]) == (len(inside), min(inside, default=None))
        assert got[i]["s"] == pytest.approx(sum(inside))
    with pytest.raises(ValueError):
        J.wj(F.col("t"), F.col("t"), ["k", "t"], left, right, {"m": ("mode", "v")}, ["i"], 1)


def test_grouping(spark):
    st = spark.createDataFrame(list(zip(range(5), "ababa", range(1, 6))), "i long, s string, v long")
    totals = G.qby(st, "s", {"total": F.sum("v")})
    assert {r["s"]: r["total"] for r in totals.df.collect()} == {"a": 9, "b": 6}
    from tidewater.functions.aggregates import sum_

    assert column(st.select("i", G.fby(sum_, "v", "s").alias("t")), "t", ["i"]) == [9, 6, 9, 6, 9]
    nested = G.xgroup("s", st, "i")
    assert {r["s"]: r["v"] for r in nested.collect()} == {"a": [1, 3, 5], "b": [2, 4]}
    assert sorted((r["s"], r["v"]) for r in G.ungroup(nested).collect()) == [("a", 1), ("a", 3), ("a", 5), ("b", 2), ("b", 4)]
    assert {r["s"]: r["v"] for r in G.last_by(st, "s", "i").df.collect()} == {"a": 5, "b": 4}


def test_shape(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "y", 5)], "a long, b string, c long")
    assert B.xcols(["c"], df).columns == ["c", "a", "b"]
    assert B.take_columns(["a", "z"], df).collect()[0]["z"] is None
    assert B.iskeyed(B.xkey("a", df)) and B.keys(B.xkey("a", df)) == ["a"] and B.istable(df)
    assert [r["c"] for r in B.meta(B.sortcol("a", df)).where("a = 's'").collect()] == ["a"]
    assert B.insert(df, df).count() == 4
    with pytest.raises(ValueError):
        B.insert(df, df.select("a"))
    with pytest.raises(ValueError):
        B.xkey("nope", df)
    assert B.match(df, df.orderBy("b")) and not B.match(df, df.limit(1))
    assert [r["c"] for r in B.xasc("c", df).collect()] == [None, 5] and [r["c"] for r in B.xdesc("c", df).collect()] == [5, None]
    assert sorted(r["a"] for r in B.take(5, df, ["a"]).collect()) == [1, 1, 1, 2, 2]
    assert sorted(r["a"] for r in B.take(-3, df, ["a"]).collect()) == [1, 2, 2]
    assert B.flip({"a": [1, 2], "b": "k"}, spark).count() == 2
    with pytest.raises(ValueError):
        B.flip({"a": [1, 2], "b": [1]}, spark)
    assert B.is_sorted(df, ["a"], ["a"]).first()["sorted"]
