"""Seeded synthetic sessions of quotes, trades and options, made on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions.math import black_scholes, round_half_up

#: Symbols with first price, daily volatility, quoted half spread in basis points and share of the volume, made by a rule: the dearer a symbol, the
#: calmer, narrower and less traded it is.
UNIVERSE = [(3 * chr(65 + k), round(12.0 * 1.5**k, 2), round(0.05 - 0.003 * k, 3), round(9.0 / (1 + k), 2), (10 - k) / 55) for k in range(10)]
OPEN, SESSION = 34_200_000, 23_400_000
#: Days to expiry: one week, doubled again and again.
TENORS = [7 * 2**k for k in range(7)]


def _universe(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(UNIVERSE, "sym string, base double, vol double, bps double, share double")


def _normal(salt: int, *parts: Column) -> Column:
    """A standard normal number from hashes, the same whenever it is computed."""
    u = [(F.pmod(F.xxhash64(F.lit(salt + k), *parts), F.lit(2**52)) + 1) / F.lit(float(2**52 + 1)) for k in (0, 1)]
    return F.sqrt(-2 * F.ln(u[0])) * F.cos(2 * 3.141592653589793 * u[1])


def _uniform(salt: int, *parts: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), *parts), F.lit(2**52)) / F.lit(float(2**52))


def _time(u: Column) -> Column:
    """Busy at the open and the close: the inverse of a U-shaped density."""
    s = 2 * u - 1
    return (OPEN + SESSION * (0.5 + 0.5 * F.signum(s) * F.pow(F.abs(s), F.lit(0.6)))).cast("long")


def quotes(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """About 2n quotes (sym, time, bid, ask, bsz, asz): time in ms of the day, mid a geometric walk, half spread one cent at least."""
    rows = _universe(spark).withColumn("i", F.explode(F.sequence(F.lit(0), F.greatest(F.round(2 * n * F.col("share")).cast("int") - 1, F.lit(0)))))
    at = rows.withColumn("time", _time(_uniform(seed, F.col("sym"), F.col("i"))))
    step = _normal(seed + 10, F.col("sym"), F.col("i")) * F.col("vol") / F.sqrt(2 * n * F.col("share") + 1)
    walk = F.sum(step).over(Window.partitionBy("sym").orderBy("time", "i").rowsBetween(Window.unboundedPreceding, 0))
    mid = F.col("base") * F.exp(walk)
    half = F.greatest(F.lit(0.01), mid * F.col("bps") / 10000)
    size = lambda salt: (100 * (1 + F.floor(20 * F.pow(_uniform(salt, F.col("sym"), F.col("i")), F.lit(3))))).cast("long")
    return at.select("sym", "time", round_half_up(2, mid - half).alias("bid"), round_half_up(2, mid + half).alias("ask"), size(seed + 20).alias("bsz"), size(seed + 30).alias("asz"))


def trades(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """About n trades (sym, time, px, sz) at the quote in force: 12 % at the mid, else at the ask or bid; 3 % are blocks. Before the
    first quote the base price holds."""
    from tidewater.operators.joins import aj

    rows = _universe(spark).withColumn("i", F.explode(F.sequence(F.lit(0), F.greatest(F.round(n * F.col("share")).cast("int") - 1, F.lit(0)))))
    at = rows.select("sym", _time(_uniform(seed + 40, F.col("sym"), F.col("i"))).alias("time"), "base", "i")
    joined = aj(["sym", "time"], at, quotes(spark, n, seed).select("sym", "time", "bid", "ask"))
    u, v = _uniform(seed + 50, F.col("sym"), F.col("i")), _uniform(seed + 60, F.col("sym"), F.col("i"))
    px = F.when(u < 0.12, round_half_up(2, (F.col("bid") + F.col("ask")) / 2)).when(u < 0.56, F.col("ask")).otherwise(F.col("bid"))
    sz = (100 * (1 + F.floor(10 * F.pow(v, F.lit(3))))).cast("long") * F.when(v > 0.97, 20).otherwise(1)
    return joined.select("sym", "time", F.coalesce(px, F.col("base")).alias("px"), sz.alias("sz"))


def options(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """n contracts: ten tenors, strikes on a grid of 2.5 from 70 to 130 % of the spot, a smile of volatilities, Black-Scholes prices and greeks."""
    u = lambda k: _uniform(seed + k, F.col("id"))
    pick = F.broadcast(_universe(spark).withColumn("slot", F.row_number().over(Window.orderBy("sym")) - 1))
    rows = spark.range(n).withColumn("slot", F.floor(u(1) * len(UNIVERSE)).cast("int")).join(pick, "slot")
    rows = rows.withColumn("expiry", F.element_at(F.array(*map(F.lit, TENORS)), F.floor(u(2) * len(TENORS)).cast("int") + 1).cast("long"))
    rows = rows.withColumn("spot", F.col("base")).withColumn("strike", 2.5 * F.round(F.col("spot") * (0.7 + 0.6 * u(3)) / 2.5))
    rows = rows.withColumn("right", F.when(u(4) < 0.5, "C").otherwise("P"))
    away = F.ln(F.col("strike") / F.col("spot"))
    rows = rows.withColumn("iv", round_half_up(4, F.col("vol") * 15.87 * (1 + 0.8 * away * away - 0.2 * away)))
    greeks = black_scholes(F.col("spot"), F.col("strike"), F.col("expiry") / 365, F.col("iv"), F.col("right") == "C")
    rows = rows.withColumns(greeks)
    half = F.greatest(F.lit(0.01), 0.01 * F.col("price"))
    return rows.select(
        "sym", "right", "expiry", "strike", "spot", "iv", "price", round_half_up(2, F.greatest(F.lit(0.0), F.col("price") - half)).alias("bid"),
        round_half_up(2, F.col("price") + half).alias("ask"), "delta", "gamma", "vega", "theta",
        F.floor(1000 * F.pow(u(5), F.lit(4))).cast("long").alias("volume"), F.floor(5000 * F.pow(u(6), F.lit(2))).cast("long").alias("oi"),
    )


def roll(spark: SparkSession, n: int, m: int, seed: int = 1) -> DataFrame:
    """n numbers below m, with repeats: (i, x)."""
    return spark.range(n).select(F.col("id").alias("i"), F.floor(F.rand(seed) * m).cast("long").alias("x"))


def deal(spark: SparkSession, n: int, m: int, seed: int = 1) -> DataFrame:
    """n different numbers below m, in random order: (x)."""
    if n > m:
        raise ValueError("cannot deal more numbers than there are")
    return spark.range(m).select(F.col("id").alias("x"), F.rand(seed).alias("_r")).orderBy("_r").limit(n).select("x")
