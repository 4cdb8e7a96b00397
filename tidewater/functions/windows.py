"""Running, shifted, ranking and moving functions over an explicit order.

Each takes a window specification with partition and order, or the two as lists of columns, and gives a column. The order must be total for the result
to be determined; add a unique column. Frames count rows.
"""

from __future__ import annotations

import math as _m
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewater.functions.math import fdiv


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def spec(partition: Sequence[str | Column] = (), order: Sequence[str | Column] = ()) -> WindowSpec:
    """NULLs come first, as everywhere here."""
    keys = [c.asc_nulls_first() if isinstance(c, Column) else F.col(c).asc_nulls_first() for c in order]
    return Window.partitionBy(*partition).orderBy(*keys)


def _so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _past(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def sums(x, w: WindowSpec) -> Column:
    return F.coalesce(F.sum(_c(x)).over(_so_far(w)), F.lit(0))


def prds(x, w: WindowSpec) -> Column:
    return F.coalesce(F.product(_c(x)).over(_so_far(w)), F.lit(1.0))


def mins(x, w: WindowSpec) -> Column:
    return F.min(_c(x)).over(_so_far(w))


def maxs(x, w: WindowSpec) -> Column:
    return F.max(_c(x)).over(_so_far(w))


def prev(x, w: WindowSpec) -> Column:
    return F.lag(_c(x)).over(w)


def next_(x, w: WindowSpec) -> Column:
    return F.lead(_c(x)).over(w)


def xprev(n: int, x, w: WindowSpec) -> Column:
    """Shifted by n rows, by -n forward; NULL outside."""
    return F.lag(_c(x), n).over(w) if n >= 0 else F.lead(_c(x), -n).over(w)


def deltas(x, w: WindowSpec) -> Column:
    """x - previous; the first row keeps its value."""
    first = F.row_number().over(w) == 1
    return F.when(first, _c(x)).otherwise(_c(x) - prev(x, w))


def ratios(x, w: WindowSpec) -> Column:
    first = F.row_number().over(w) == 1
    return F.when(first, _c(x).cast("double")).otherwise(fdiv(_c(x), prev(x, w)))


def differ(x, w: WindowSpec) -> Column:
    """Whether x is not what it was a row before; true in the first row. NULL equals NULL."""
    return (F.row_number().over(w) == 1) | ~_c(x).eqNullSafe(prev(x, w))


def each_prior(f, x, w: WindowSpec) -> Column:
    return f(_c(x), prev(x, w))


def rank(w: WindowSpec) -> Column:
    """Place in the sorted order from 0, a permutation: no two rows share one."""
    return (F.row_number().over(w) - 1).cast("long")


def xrank(n: int, w: WindowSpec, partition: Sequence[str] = ()) -> Column:
    """floor(n * rank / count): buckets 0 to n - 1."""
    return F.floor(n * rank(w) / F.count(F.lit(1)).over(Window.partitionBy(*partition))).cast("long")


def mcount(n: int, w: WindowSpec) -> Column:
    return F.count(F.lit(1)).over(_past(w, n))


def msum(n: int, x, w: WindowSpec) -> Column:
    """NULLs are absent; 0 where there is nothing else."""
    return F.coalesce(F.sum(_c(x)).over(_past(w, n)), F.lit(0))


def mavg(n: int, x, w: WindowSpec) -> Column:
    return F.avg(_c(x)).over(_past(w, n))


def mvar(n: int, x, w: WindowSpec) -> Column:
    return F.var_pop(_c(x)).over(_past(w, n))


def mdev(n: int, x, w: WindowSpec) -> Column:
    return F.stddev_pop(_c(x)).over(_past(w, n))


def mmin(n: int, x, w: WindowSpec) -> Column:
    return F.min(_c(x)).over(_past(w, n))


def mmax(n: int, x, w: WindowSpec) -> Column:
    return F.max(_c(x)).over(_past(w, n))


def mprd(n: int, x, w: WindowSpec) -> Column:
    return F.exp(F.sum(F.ln(_c(x))).over(_past(w, n)))


def padded(n: int, value: Column, w: WindowSpec) -> Column:
    """NULL in the first n - 1 rows."""
    return F.when(F.row_number().over(w) >= n, value)


def movavg(n: int, x, w: WindowSpec) -> Column:
    return padded(n, mavg(n, x, w), w)


def movsum(n: int, x, w: WindowSpec) -> Column:
    return padded(n, msum(n, x, w), w)


def movmax(n: int, x, w: WindowSpec) -> Column:
    return padded(n, mmax(n, x, w), w)


def movmin(n: int, x, w: WindowSpec) -> Column:
    return padded(n, mmin(n, x, w), w)


def rollstd(n: int, x, w: WindowSpec) -> Column:
    return padded(n, mdev(n, x, w), w)


def ret(x, w: WindowSpec) -> Column:
    """Relative change; NULL in the first row."""
    return fdiv(_c(x) - prev(x, w), prev(x, w))


def logret(x, w: WindowSpec) -> Column:
    return F.ln(_c(x)) - F.ln(prev(x, w))


def slices(n: int, x, w: WindowSpec) -> Column:
    """The last n values as an array; NULL where there are fewer rows."""
    return padded(n, F.collect_list(_c(x)).over(_past(w, n)), w)


# ---- operators that need more than one window ----------------------------------------------------------------------------


def moving(
    df: DataFrame, n: int, x: str, out: str, how: str, partition: Sequence[str] = (), order: Sequence[str] = ()
) -> DataFrame:
    """Moving sum, count, avg, min or max of n rows in time that does not depend on n.

    Rows are cut into blocks of n. A window covers the end of one block and the start of the next, so that it is a suffix of the one
    combined with a prefix of the other; both come from running aggregates within blocks. Worth it where n is large: a plain sliding frame
    is evaluated anew for each row.
    """
    if how not in ("sum", "count", "avg", "min", "max"):
        raise ValueError(f"unknown aggregate {how!r}")
    value = F.col(x)
    parts = {"min": [("min", F.min)], "max": [("max", F.max)], "sum": [("sum", F.sum)], "count": [("count", F.count)], "avg": [("sum", F.sum), ("count", F.count)]}[how]
    keys, by = list(partition), [F.col(c).asc_nulls_first() for c in order]
    at = df.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)) - 1).withColumn("_block", F.floor(F.col("_at") / n))
    ahead = Window.partitionBy(*keys, "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy(*keys, "_block").orderBy("_at").rowsBetween(0, Window.unboundedFollowing)
    for name, f in parts:
        at = at.withColumn(f"_p_{name}", f(value).over(ahead)).withColumn(f"_s_{name}", f(value).over(behind))
    back = Window.partitionBy(*keys).orderBy("_at")
    # a window that is a whole block, or starts before the first row, is the prefix alone
    cross = (F.col("_at") >= n - 1) & (F.pmod(F.col("_at") + 1, F.lit(n)) != 0)

    def joined(name: str) -> Column:
        before = F.when(cross, F.lag(f"_s_{name}", n - 1).over(back)) if n > 1 else F.lit(None).cast(at.schema[f"_p_{name}"].dataType)
        here = F.col(f"_p_{name}")
        if name == "min":
            return F.least(here, before)
        if name == "max":
            return F.greatest(here, before)
        return F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))

    result = fdiv(joined("sum"), joined("count")) if how == "avg" else joined(parts[0][0])
    return at.withColumn(out, result).drop("_at", "_block", *(f"_{s}_{name}" for s in "ps" for name, _ in parts))


def ema(df: DataFrame, alpha: float, x: str, out: str, partition: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Exponential moving average: z0 = x0, z = alpha * x + (1 - alpha) * previous z. A NULL keeps the previous z.

    Rows are cut into blocks. In a block the recurrence is a running sum with scaled weights; what a block carries over to the next is folded
    over one number a block. So no group of rows is ever gathered in one value, only its block ends.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be above 0 and at most 1")
    keys, by = list(partition), [F.col(c).asc_nulls_first() for c in order]
    over = Window.partitionBy(*keys).orderBy(*by)
    value = F.col(x).cast("double")
    # position among the rows that have a value: others repeat what came before
    at = df.withColumn("_n", F.count(value).over(over.rowsBetween(Window.unboundedPreceding, 0)))
    at = at.withColumn("_has", value.isNotNull())
    keep = 1 - alpha
    size = 1 if keep == 0 else max(1, min(512, int(200 / -_m.log(keep))))
    weight = F.when(F.col("_n") == 1, F.lit(1.0)).otherwise(F.lit(alpha))
    at = at.withColumn("_block", F.floor((F.col("_n") - 1) / size)).withColumn("_i", F.pmod(F.col("_n") - 1, F.lit(size)))
    scaled = F.when(F.col("_has"), weight * value * F.pow(F.lit(keep), -F.col("_i"))) if keep else F.when(F.col("_has"), weight * value)
    within = Window.partitionBy(*keys, "_block").orderBy("_n", F.desc("_has")).rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumn("_own", F.sum(scaled).over(within) * (F.pow(F.lit(keep), F.col("_i")) if keep else F.lit(1.0)))
    ends = at.where("_n > 0").groupBy(*keys, "_block").agg(F.max_by("_own", "_i").alias("_end"))
    grouped = ends.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_block", "_end"))).alias("_ends"))
    carried = F.aggregate(
        "_ends",
        F.struct(F.lit(0.0).alias("z"), F.array().cast("array<double>").alias("all")),
        lambda a, e: F.struct(
            (e["_end"] + a["z"] * keep**size).alias("z"), F.concat(a["all"], F.array(a["z"])).alias("all")
        ),
        lambda a: a["all"],
    )
    starts = grouped.select(*keys, F.posexplode(carried).alias("_block", "_in"))
    cond = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*keys, "_block")]
    joined = at.alias("l").join(starts.alias("r"), cond, "left")
    z = F.col("_own") + F.coalesce("_in", F.lit(0.0)) * (F.pow(F.lit(keep), F.col("_i") + 1) if keep else F.lit(0.0))
    names = [c for c in df.columns if c != out]
    return joined.select(*(F.col(f"l.{c}") for c in names), F.when(F.col("_n") > 0, z).alias(out))


def rotate(df: DataFrame, n: int, x: str, out: str, partition: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Cyclic shift left by n rows within the partition."""
    keys, by = list(partition), [F.col(c).asc_nulls_first() for c in order]
    over = Window.partitionBy(*keys)
    at = df.withColumn("_at", F.row_number().over(over.orderBy(*by)) - 1).withColumn("_all", F.count(F.lit(1)).over(over))
    other = at.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_at").alias("_from"), F.col(x).alias("_value"))
    cond = F.pmod(F.col("_at") + n, F.col("_all")) == F.col("_from")
    for i, k in enumerate(keys):
        cond &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    names = [c for c in df.columns if c != out]
    return at.join(other, cond).select(*names, F.col("_value").alias(out))


def rvol(df: DataFrame, x: str, partition: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Realised volatility: square root of the sum of squared log returns, by partition; column rvol."""
    w = spec(partition, order)
    return df.withColumn("_r", logret(x, w)).groupBy(*partition).agg(F.sqrt(F.coalesce(F.sum(F.col("_r") * F.col("_r")), F.lit(0.0))).alias("rvol"))
