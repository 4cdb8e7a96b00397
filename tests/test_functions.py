import math

import pytest
from pyspark.sql import functions as F

from tidewater.functions import aggregates as A
from tidewater.functions import lists as L
from tidewater.functions import market as K
from tidewater.functions import math as M
from tidewater.functions import strings as S
from tidewater.functions import temporal as T
from tidewater.functions import windows as W


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def series(spark, values, kind="double"):
    return spark.createDataFrame([(i, float(v) if kind == "double" and v is not None else v) for i, v in enumerate(values)], f"i long, x {kind}")


def over(spark, values, f, kind="double"):
    df = series(spark, values, kind)
    return [r["v"] for r in df.select("i", f(W.spec([], ["i"])).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "c, want",
    [
        (lambda: M.mod(F.lit(7), 3), 1), (lambda: M.mod(F.lit(-7), 3), 2), (lambda: M.mod(F.lit(5), 0), 5), (lambda: M.div(F.lit(7), 3), 2), (lambda: M.div(F.lit(-7), 2), -4),
        (lambda: M.fdiv(1, 0), None), (lambda: M.fdiv(1, 0, strict=True), math.inf), (lambda: M.fdiv(-1, 0, strict=True), -math.inf), (lambda: M.round_half_up(2, F.lit(3.14159)), 3.14),
        (lambda: M.round_half_up(0, F.lit(-2.5)), -2.0), (lambda: M.sqrt(F.lit(-1.0)), None), (lambda: M.log(F.lit(0.0)), None), (lambda: M.floor(F.lit(-2.3)), -3), (lambda: M.ceiling(F.lit(-2.9)), -2),
        (lambda: M.smaller(F.lit(None).cast("int"), 3), None), (lambda: M.fill(7, F.lit(None).cast("int")), 7), (lambda: M.cast("long", F.lit(2.9)), 2), (lambda: M.cast("long", F.lit("x")), None), (lambda: M.reciprocal(4), 0.25),
    ],
)
def test_scalars(spark, c, want):
    assert one(spark, c()) == want


def test_strict_zero_by_zero(spark):
    assert math.isnan(one(spark, M.fdiv(0, 0, strict=True)))


def test_xbar(spark):
    assert [r[0] for r in spark.createDataFrame([(0,), (5,), (12,), (23,)], "x long").select(M.xbar(10, F.col("x"))).collect()] == [0, 0, 10, 20]


def test_normal_distribution(spark):
    for x in (-2.0, -0.5, 0.0, 1.0, 2.5):
        assert one(spark, M.ncdf(F.lit(x))) == pytest.approx(0.5 * (1 + math.erf(x / math.sqrt(2))), abs=1e-6)


def test_black_scholes_parity(spark):
    c = M.black_scholes(100.0, 95.0, 0.5, 0.2, F.lit(True))
    p = M.black_scholes(100.0, 95.0, 0.5, 0.2, F.lit(False))
    call, put = one(spark, c["price"]), one(spark, p["price"])
    assert call - put == pytest.approx(100 - 95 * math.exp(-0.045 * 0.5), abs=0.02)
    assert one(spark, c["delta"]) - one(spark, p["delta"]) == pytest.approx(1, abs=1e-3)


def test_aggregates(spark):
    df = series(spark, [2, 4, 4, 4, 5, 5, 7, 9])
    assert df.agg(A.dev("x")).first()[0] == 2.0
    assert df.agg(A.svar("x")).first()[0] == pytest.approx(4.571428571428571)
    assert series(spark, [1, 2, 3, 4]).agg(A.med("x")).first()[0] == 2.5
    w = spark.createDataFrame([(10, 1), (20, 2), (30, 3)], "w long, x long")
    assert w.agg(A.wavg("w", "x")).first()[0] == pytest.approx(7 / 3)
    assert w.agg(A.cov("x", "x")).first()[0] == pytest.approx(2 / 3)
    empty = df.limit(0)
    assert empty.agg(A.sum_("x"), A.prd("x"), A.avg("x"), A.min_("x"), A.count()).first()[:] == (0.0, 1.0, None, None, 0)
    assert empty.agg(A.all_(F.col("x") > 0), A.any_(F.col("x") > 0)).first()[:] == (True, False)


def test_first_and_last_keep_nulls(spark):
    df = spark.createDataFrame([(0, None), (1, 5), (2, None)], "i long, x long")
    assert df.agg(A.first("x", "i"), A.last("x", "i"), A.argmax("x", "i")).first()[:] == (None, None, 1)


@pytest.mark.parametrize(
    "values, f, want",
    [
        ([1, 3, 6, 10], lambda w: W.deltas("x", w), [1, 2, 3, 4]), ([1, 2, 4, 8], lambda w: W.ratios("x", w), [1, 2, 2, 2]), ([1, 1, 2, 2, 3], lambda w: W.differ("x", w), [True, False, True, False, True]),
        ([1, 2, 3, 4, 5], lambda w: W.xprev(2, "x", w), [None, None, 1, 2, 3]), ([1, 2, 3, 4, 5], lambda w: W.mcount(3, w), [1, 2, 3, 3, 3]), ([1, 2, 3, 4, 5], lambda w: W.msum(3, "x", w), [1, 3, 6, 9, 12]),
        ([1, 2, 3, 4, 5], lambda w: W.mavg(3, "x", w), [1, 1.5, 2, 3, 4]), ([5, 3, 4, 1, 2], lambda w: W.mmin(3, "x", w), [5, 3, 3, 1, 1]), ([1, 3, 2, 5, 4], lambda w: W.mmax(3, "x", w), [1, 3, 3, 5, 5]),
        ([1, None, 3, 4], lambda w: W.msum(2, "x", w), [1, 1, 3, 7]), ([1, None, 3, 4], lambda w: W.mavg(2, "x", w), [1, 1, 3, 3.5]), ([1, None, 3, 4], lambda w: W.mmin(2, "x", w), [1, 1, 3, 3]),
        ([None, None], lambda w: W.msum(2, "x", w), [0, 0]), ([None, None], lambda w: W.mavg(2, "x", w), [None, None]), ([1, 2, 3, 4], lambda w: W.movavg(2, "x", w), [None, 1.5, 2.5, 3.5]),
        ([1, 2, 3, 4], lambda w: W.movsum(2, "x", w), [None, 3, 5, 7]), ([1, 2, 3], lambda w: W.sums("x", w), [1, 3, 6]), ([1, 2, 3], lambda w: W.prds("x", w), [1, 2, 6]), ([3, 1, 2], lambda w: W.maxs("x", w), [3, 3, 3]),
    ],
)
def test_windows(spark, values, f, want):
    assert over(spark, values, f) == want


def test_ranks(spark):
    df = series(spark, [30, 10, 20])
    got = df.select("i", W.rank(W.spec([], ["x", "i"])).alias("r")).orderBy("i").collect()
    assert [r["r"] for r in got] == [2, 0, 1]
    five = series(spark, [10, 20, 30, 40, 50])
    assert [r["r"] for r in five.select("i", W.xrank(2, W.spec([], ["x", "i"])).alias("r")).orderBy("i").collect()] == [0, 0, 0, 1, 1]


def test_ema(spark):
    df = series(spark, [1, 2, 3, 4])
    got = W.ema(df, 0.5, "x", "z", [], ["i"]).orderBy("i").collect()
    assert [r["z"] for r in got] == [1, 1.5, 2.25, 3.125]


def test_ema_long_groups_and_nulls(spark):
    values = [None if k % 11 == 3 else math.sin(k) * 10 for k in range(3000)]
    df = spark.createDataFrame([(g, k, v) for g in (1, 2) for k, v in enumerate(values)], "g long, i long, x double")
    for alpha in (0.02, 0.9, 1.0):
        want, z = [], None
        for v in values:
            z = z if v is None else v if z is None else alpha * v + (1 - alpha) * z
            want.append(z)
        got = W.ema(df, alpha, "x", "z", ["g"], ["i"]).where("g = 2").orderBy("i").collect()
        assert [r["z"] for r in got] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("how", ["sum", "count", "avg", "min", "max"])
@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_wide_windows(spark, how, n):
    values = [None if k % 7 == 2 else float((k * 37) % 23) for k in range(33)]
    got = W.moving(series(spark, values), n, "x", "m", how, [], ["i"]).orderBy("i").collect()
    for k, r in enumerate(got):
        have = [v for v in values[max(0, k - n + 1) : k + 1] if v is not None]
        want = {"sum": sum(have), "count": len(have), "avg": sum(have) / len(have) if have else None, "min": min(have, default=None), "max": max(have, default=None)}[how]
        assert r["m"] == pytest.approx(want) if want is not None else r["m"] is None


def test_rotate_and_rvol(spark):
    df = series(spark, [1, 2, 3, 4, 5])
    assert [r["y"] for r in W.rotate(df, 2, "x", "y", [], ["i"]).orderBy("i").collect()] == [3, 4, 5, 1, 2]
    assert W.rvol(series(spark, [1.0, math.e, math.e]), "x", [], ["i"]).first()["rvol"] == pytest.approx(1.0)


@pytest.mark.parametrize(
    "c, want",
    [
        (lambda: S.ss(F.lit("abracadabra"), "ra"), [2, 9]), (lambda: S.ss(F.lit("aaa"), "aa"), [0, 1]), (lambda: S.ss(F.lit("a"), "abc"), []), (lambda: S.ssr(F.lit("abracadabra"), "ra", "XX"), "abXXcadabXX"),
        (lambda: S.like(F.lit("abcde"), "a*e"), True), (lambda: S.like(F.lit("abcde"), "a?e"), False), (lambda: S.like(F.lit("a.b"), "a.?"), True), (lambda: S.trim(F.lit("  ab ")), "ab"), (lambda: S.vs(".", F.lit("a.b..c")), ["a", "b", "", "c"]),
        (lambda: S.sv("-", F.array(F.lit("a"), F.lit("b"))), "a-b"), (lambda: S.decode_base(10, F.array(F.lit(1), F.lit(2), F.lit(3))), 123), (lambda: S.encode_base(10, F.lit(123), 4), [0, 1, 2, 3]), (lambda: S.pad(-4, F.lit("ab")), "  ab"),
        (lambda: S.pad(3, F.lit("abcde")), "abc"), (lambda: S.hex_(F.lit("az")), "617a"), (lambda: S.unhex(F.lit("617a")), "az"), (lambda: S.comma(F.lit(1234567)), "1,234,567"), (lambda: S.fixed(2, F.lit(1234.5)), "1234.50"), (lambda: S.identifier(F.lit("1 a-b")), "a1ab"),
    ],
)
def test_strings(spark, c, want):
    assert one(spark, c()) == want


@pytest.mark.parametrize(
    "c, want",
    [
        (lambda: T.ymd2d(F.lit(2000), F.lit(1), F.lit(1)), 0), (lambda: T.ymd2d(F.lit(2024), F.lit(1), F.lit(15)), 8780), (lambda: T.ymd2d(F.lit(2020), F.lit(2), F.lit(29)), 7364), (lambda: T.dow(T.date_of(F.lit(0))), "Sat"),
        (lambda: T.dstr(F.lit(8780)), "2024.01.15"), (lambda: T.pdate(F.lit("2024.01.15")), 8780), (lambda: T.pdate(F.lit("nonsense")), None), (lambda: T.hms(F.lit(9), F.lit(30), F.lit(15)), 34215000), (lambda: T.minute(F.lit(34215000)), 570),
        (lambda: T.minbar(F.lit(5), T.hms(F.lit(9), F.lit(37), F.lit(0))), 34500000), (lambda: T.stime(F.lit(34215007)), "09:30:15.007"), (lambda: T.ptime(F.lit("09:30:15.007")), 34215007),
        (lambda: T.pstr(T.tstamp(F.lit(8780), F.lit(34200000))), "2024.01.15D09:30:00.000"), (lambda: T.tsms(T.ptstamp(F.lit("2024.01.15D09:30:00.250"))), 34200250), (lambda: T.ddiff(T.date_of(F.lit(9)), T.date_of(F.lit(4))), 5),
    ],
)
def test_temporal(spark, c, want):
    assert one(spark, c()) == want


def arr(*v):
    return F.array(*map(F.lit, v))


@pytest.mark.parametrize(
    "c, want",
    [
        (lambda: L.til(F.lit(4)), [0, 1, 2, 3]), (lambda: L.til(F.lit(0)), []), (lambda: L.where(arr(True, False, True)), [0, 2]), (lambda: L.replicate(arr(2, 0, 1)), [0, 0, 2]), (lambda: L.find(arr(5, 6), 6), 1), (lambda: L.find(arr(5, 6), 9), None),
        (lambda: L.bin_(arr(1, 3, 5), 4), 1), (lambda: L.bin_(arr(1, 3, 5), 0), -1), (lambda: L.take(5, arr(1, 2)), [1, 2, 1, 2, 1]), (lambda: L.take(-3, arr(1, 2, 3, 4)), [2, 3, 4]), (lambda: L.drop(1, arr(1, 2, 3)), [2, 3]), (lambda: L.drop(-1, arr(1, 2, 3)), [1, 2]),
        (lambda: L.sublist(5, arr(1, 2)), [1, 2]), (lambda: L.rotate(1, arr(1, 2, 3)), [2, 3, 1]), (lambda: L.cut([0, 2], arr(1, 2, 3)), [[1, 2], [3]]), (lambda: L.reshape(2, 3, arr(1, 2, 3, 4, 5, 6)), [[1, 2, 3], [4, 5, 6]]),
        (lambda: L.flip(F.array(arr(1, 2), arr(3, 4))), [[1, 3], [2, 4]]), (lambda: L.inter(arr(1, 1, 2), arr(1)), [1, 1]), (lambda: L.except_(arr(1, 1, 2), arr(2)), [1, 1]), (lambda: L.iasc(arr(30, 10, 20)), [1, 2, 0]), (lambda: L.idesc(arr(10, 30, 10)), [1, 0, 2]),
        (lambda: L.rank(arr(30, 10, 20)), [2, 0, 1]), (lambda: L.amend(arr(1, 2, 3), 1, lambda v: v + 10), [1, 12, 3]), (lambda: L.splice(arr(1, 2, 3), 1, 2, arr(7, 8)), [1, 7, 8, 3]), (lambda: L.scan(lambda a, v: a + v, 0, arr(1, 2, 3), "bigint"), [1, 3, 6]),
        (lambda: L.fold(lambda a, v: a + v, F.lit(0), arr(1, 2, 3)), 6), (lambda: L.dot(arr(1, 2), arr(3, 4)), 11.0), (lambda: L.mmu(F.array(arr(1, 2), arr(3, 4)), F.array(arr(1, 0), arr(0, 1))), [[1, 2], [3, 4]]), (lambda: L.primes(20), [2, 3, 5, 7, 11, 13, 17, 19]),
        (lambda: L.odometer(2, 3), [[0, 0, 0, 1, 1, 1], [0, 1, 2, 0, 1, 2]]), (lambda: L.unit_matrix(2), [[1, 0], [0, 1]]), (lambda: L.cross(arr(1, 2), arr(3)), [[1, 3], [2, 3]]),
        (lambda: L.merge(L.make(arr("a", "b"), arr(1, 2)), L.make(arr("b", "c"), arr(9, 3))), {"a": 1, "b": 9, "c": 3}), (lambda: L.drop_keys(arr("a"), L.make(arr("a", "b"), arr(1, 2))), {"b": 2}), (lambda: L.take_keys(arr("a", "z"), L.make(arr("a", "b"), arr(1, 2))), {"a": 1, "z": None}),
        (lambda: L.combine(lambda a, b: a + b, 0, L.make(arr("a", "b"), arr(1, 2)), L.make(arr("b", "c"), arr(5, 6))), {"a": 1, "b": 7, "c": 6}), (lambda: L.json_value(F.lit('{"k": 69}'), "$.k", "int"), 69), (lambda: L.json_value(F.lit("no json"), "$.k"), None),
    ],
)
def test_lists(spark, c, want):
    assert one(spark, c()) == want


def test_market(spark):
    q = spark.createDataFrame([("a", 10.0, 12.0, 100, 100), ("a", 20.0, 24.0, 300, 100)], "sym string, bid double, ask double, bsz long, asz long")
    assert [tuple(r) for r in q.select(K.mid(), K.spread(), K.imbal(), K.micro()).collect()] == [(11, 2, 0, 11), (22, 4, 0.5, 23)]
    t = spark.createDataFrame([(10.0, 1), (20.0, 3)], "px double, sz long")
    assert t.agg(K.vwap(), K.twap()).first()[:] == (17.5, 15.0)
    m = spark.createDataFrame([(11.0, 10.0, 12.0, 100), (13.0, 10.0, 12.0, 100), (9.0, 10.0, 12.0, 100)], "px double, bid double, ask double, sz long")
    assert [tuple(r) for r in m.select(K.tsign(), K.effspread(), K.signedvol()).collect()] == [(0, 0, 0), (1, 4, 100), (-1, 4, -100)]
