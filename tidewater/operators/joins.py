"""Joins: first-match joins with keyed tables, as-of joins and window joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.tables import KeyedTable, xkey


def first_rows(kt: KeyedTable, order: Sequence[str] = ()) -> DataFrame:
    """One row for each key: the first by the order, or any if none is given (for keys known to be unique)."""
    if not order:
        return kt.df.dropDuplicates(list(kt.key))
    # the limit of one row a key is applied before the shuffle as well
    at = F.row_number().over(Window.partitionBy(*kt.key).orderBy(*order))
    return kt.df.withColumn("_at", at).where("_at = 1").drop("_at")


def _joined(t: DataFrame, kt: KeyedTable, order: Sequence[str], how: str, drop_order: bool = True) -> tuple[DataFrame, list[str]]:
    values = [c for c in kt.values]
    right = first_rows(kt, order).select(
        *(F.col(k).alias(f"_k_{k}") for k in kt.key), *(F.col(v).alias(f"_v_{v}") for v in values), F.lit(True).alias("_hit")
    )
    cond = F.lit(True)
    for k in kt.key:
        cond &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return t.join(right, cond, how), values


def lj(t: DataFrame, kt: KeyedTable, order: Sequence[str] = ()) -> DataFrame:
    """All rows of t with the values of the first row of kt that has their key; these overwrite columns of the same name, with NULL if
    there is no such row. Never multiplies rows."""
    joined, values = _joined(t, kt, order, "left")
    return joined.select(*(F.col(f"_v_{c}").alias(c) if c in values else F.col(c) for c in t.columns), *(F.col(f"_v_{c}").alias(c) for c in values if c not in t.columns))


def ij(t: DataFrame, kt: KeyedTable, order: Sequence[str] = ()) -> DataFrame:
    """As lj, for rows whose key is there."""
    joined, values = _joined(t, kt, order, "inner")
    return joined.select(*(F.col(f"_v_{c}").alias(c) if c in values else F.col(c) for c in t.columns), *(F.col(f"_v_{c}").alias(c) for c in values if c not in t.columns))


def ej(on: str | Sequence[str], x: DataFrame, y: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Equality join with the first match."""
    return ij(x, xkey(on, y), order)


def uj(x: DataFrame, y: DataFrame) -> DataFrame:
    """Rows of both, columns of both, NULL where a table has no such column."""
    return x.unionByName(y, allowMissingColumns=True)


def pj(t: DataFrame, kt: KeyedTable, order: Sequence[str] = ()) -> DataFrame:
    """Adds the values of the matching row, 0 without one; t must have the columns."""
    missing = [c for c in kt.values if c not in t.columns]
    if missing:
        raise ValueError(f"no column {missing[0]} to add to")
    joined, values = _joined(t, kt, order, "left")
    return joined.select(*((F.col(c) + F.coalesce(F.col(f"_v_{c}"), F.lit(0))).alias(c) if c in values else F.col(c) for c in t.columns))


def cross(x: DataFrame, y: DataFrame) -> DataFrame:
    """All pairs. The result is as large as both inputs multiplied: for small tables."""
    return x.crossJoin(y)


# ---- as-of ----------------------------------------------------------------------------------------------------------------


def aj(
    on: Sequence[str], x: DataFrame, y: DataFrame, order: Sequence[str] = (), keep_time: bool = False, slice_width=None
) -> DataFrame:
    """As-of join: for each row of x the last row of y with equal keys and a time not after x's.

    ``on``: keys, then the time. Among rows of y with one time, the last by ``order`` counts. Columns of y overwrite those of x,
    with NULL if there is no such row. ``keep_time`` takes y's time into the result (aj0).

    Both tables are put together and the last row of y is carried along a window, so that one shuffle by key and one sort that
    can spill do it. A key with very many rows would be one task: ``slice_width`` (in units of the time, seconds for
    timestamps) cuts it into slices of time, each carried along on its own; the last row of y in each slice, one row a slice, is then carried
    over to the following slices. Without keys, the span of x's times is always cut, into as many slices as there are shuffle partitions
    if no width is given; the rows of slice ends are then as few.
    """
    *keys, time = on
    values = [c for c in y.columns if c not in on]
    clock = lambda t: F.unix_micros(t.cast("timestamp")) / 1e6 if dict(x.dtypes)[time].startswith("timestamp") else t
    kept = F.struct(F.col(time).alias("_t"), *(F.col(v).alias(v) for v in values))
    place = F.struct(*order) if order else F.lit(0)
    left = x.select(*(F.col(k) for k in keys), F.col(time).alias("_time"), F.lit(1).alias("_side"), F.lit(None).cast(y.select(place.alias("p")).schema["p"].dataType).alias("_place"), F.struct(*x.columns).alias("_x"), F.lit(None).cast(y.select(kept.alias("s")).schema["s"].dataType).alias("_y"))
    right = y.where(F.col(time).isNotNull()).select(*(F.col(k) for k in keys), F.col(time).alias("_time"), F.lit(0).alias("_side"), place.alias("_place"), F.lit(None).cast(left.schema["_x"].dataType).alias("_x"), kept.alias("_y"))
    both = left.unionByName(right)
    by = list(keys)
    if not keys and slice_width is None:
        low, high = x.agg(F.min(clock(F.col(time))).cast("double"), F.max(clock(F.col(time))).cast("double")).first()
        slice_width = ((high - low) / int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")) if low is not None else 0) or 1.0
    if slice_width is not None:
        both = both.withColumn("_slice", F.floor(clock(F.col("_time")) / slice_width))
        by.append("_slice")
    seen = F.last("_y", ignorenulls=True).over(Window.partitionBy(*by).orderBy(F.col("_time").asc_nulls_first(), "_side", F.col("_place").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    carried = both.withColumn("_y", seen).where("_side = 1")
    if slice_width is not None:
        ends = right.withColumn("_slice", F.floor(clock(F.col("_time")) / slice_width)).groupBy(*by).agg(F.max_by("_y", F.struct("_time", "_place")).alias("_end"))
        wanted = carried.select(*by).distinct().withColumn("_end", F.lit(None).cast(ends.schema["_end"].dataType)).withColumn("_ask", F.lit(0))
        slices = wanted.unionByName(ends.withColumn("_ask", F.lit(1)))
        before = F.last("_end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_slice", "_ask").rowsBetween(Window.unboundedPreceding, 0))
        found = slices.withColumn("_before", before).where("_ask = 0").select(*(F.col(c).alias(f"_b{i}") for i, c in enumerate(by)), "_before")
        cond = F.lit(True)
        for i, c in enumerate(by):
            cond &= F.col(c).eqNullSafe(F.col(f"_b{i}"))
        carried = carried.join(found, cond, "left").withColumn("_y", F.coalesce("_y", "_before"))
    out: list[Column] = []
    for c in x.columns:
        if c == time:
            out.append((F.col("_y._t") if keep_time else F.col(f"_x.{c}")).alias(c))
        else:
            out.append((F.col(f"_y.{c}") if c in values else F.col(f"_x.{c}")).alias(c))
    return carried.select(*out, *(F.col(f"_y.{c}").alias(c) for c in values if c not in x.columns))


def aj0(on: Sequence[str], x: DataFrame, y: DataFrame, order: Sequence[str] = (), slice_width=None) -> DataFrame:
    return aj(on, x, y, order, keep_time=True, slice_width=slice_width)


def taq(trades: DataFrame, quotes: DataFrame, order: Sequence[str] = (), sym: str = "sym", time: str = "time") -> DataFrame:
    """Trades with the quote in force."""
    return aj([sym, time], trades, quotes, order)


def asof(df: DataFrame, at: Mapping[str, object], time: str, order: Sequence[str] = ()) -> DataFrame:
    """The last row that has the given keys and a time not after the given one; no row if there is none. Keys and time are left out."""
    cond = F.col(time) <= F.lit(at[time])
    for k, v in at.items():
        if k != time:
            cond &= F.col(k).eqNullSafe(F.lit(v))
    return df.where(cond).orderBy(F.col(time).desc(), *(F.col(c).desc() for c in order)).limit(1).drop(*at)


# ---- windows --------------------------------------------------------------------------------------------------------------


def wj(
    begin: Column, end: Column, on: Sequence[str], t: DataFrame, q: DataFrame, aggregates: Mapping[str, tuple[str, str | None]],
    row: Sequence[str], slice_width: float, order: Sequence[str] = (),
) -> DataFrame:
    """Window join: for each row of t, aggregates of the rows of q with equal keys and a time in [begin, end].

    ``on``: keys, then the time. ``aggregates``: name -> (function, column of q), with count, sum, avg, min, max, first, last. Empty windows stay:
    count and sum are 0, the others NULL. ``row`` identifies a row of t. The join is by key and slice of time of the given width,
    each row of t going to the slices that its window touches, so that the slices of a hot key are different tasks; first
    and last go by time, then by ``order``, columns of q.
    """
    *keys, time = on
    known = {"count", "sum", "avg", "min", "max", "first", "last"}
    if bad := [f for f, _ in aggregates.values() if f not in known]:
        raise ValueError(f"unknown aggregate {bad[0]!r}")
    stamp = dict(q.dtypes)[time].startswith("timestamp")
    clock = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6 if stamp else c
    bounds = t.select(*row, *keys, begin.alias("_b"), end.alias("_e"))
    lo, hi = F.floor(clock(F.col("_b")) / slice_width), F.floor(clock(F.col("_e")) / slice_width)
    touched = bounds.where("_b <= _e").withColumn("_slice", F.explode(F.sequence(lo, hi)))
    used = sorted({c for _, c in aggregates.values() if c} | set(order))
    place = F.struct("_t", *(f"_c_{c}" for c in order)) if order else F.col("_t")
    side = q.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(time).alias("_t"), F.floor(clock(F.col(time)) / slice_width).alias("_s"), *(F.col(c).alias(f"_c_{c}") for c in used))
    cond = (F.col("_slice") == F.col("_s")) & (F.col("_t") >= F.col("_b")) & (F.col("_t") <= F.col("_e"))
    for i, k in enumerate(keys):
        cond &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    made = {
        "count": lambda c: F.count(F.lit(1)), "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max,
        "first": lambda c: F.min_by(c, place), "last": lambda c: F.max_by(c, place),
    }
    found = touched.join(side, cond).groupBy(*(F.col(r).alias(f"_r{i}") for i, r in enumerate(row))).agg(
        *(made[f](F.col(f"_c_{c}") if c else F.lit(1)).alias(f"_a_{name}") for name, (f, c) in aggregates.items())
    )
    same = F.lit(True)
    for i, r in enumerate(row):
        same &= F.col(r).eqNullSafe(F.col(f"_r{i}"))
    zero = lambda name, f: F.coalesce(F.col(f"_a_{name}"), F.lit(0)) if f in ("count", "sum") else F.col(f"_a_{name}")
    return t.join(found, same, "left").select(*(F.col(c) for c in t.columns if c not in aggregates), *(zero(n, f).alias(n) for n, (f, _) in aggregates.items()))


def wj_any(begin: Column, end: Column, on: Sequence[str], t: DataFrame, q: DataFrame, column: str, out: str, f, row: Sequence[str], slice_width: float) -> DataFrame:
    """Window join with any function of the array of values in the window, in order of time: ``f(array column) -> column``."""
    *keys, time = on
    stamp = dict(q.dtypes)[time].startswith("timestamp")
    clock = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6 if stamp else c
    bounds = t.select(*row, *keys, begin.alias("_b"), end.alias("_e")).where("_b <= _e")
    touched = bounds.withColumn("_slice", F.explode(F.sequence(F.floor(clock(F.col("_b")) / slice_width), F.floor(clock(F.col("_e")) / slice_width))))
    side = q.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(time).alias("_t"), F.floor(clock(F.col(time)) / slice_width).alias("_s"), F.col(column).alias("_v"))
    cond = (F.col("_slice") == F.col("_s")) & (F.col("_t") >= F.col("_b")) & (F.col("_t") <= F.col("_e"))
    for i, k in enumerate(keys):
        cond &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    found = touched.join(side, cond).groupBy(*(F.col(r).alias(f"_r{i}") for i, r in enumerate(row))).agg(F.transform(F.array_sort(F.collect_list(F.struct("_t", "_v"))), lambda p: p["_v"]).alias("_all"))
    same = F.lit(True)
    for i, r in enumerate(row):
        same &= F.col(r).eqNullSafe(F.col(f"_r{i}"))
    empty = F.array().cast(found.schema["_all"].dataType)
    return t.join(found, same, "left").select(*(F.col(c) for c in t.columns), f(F.coalesce("_all", empty)).alias(out))
