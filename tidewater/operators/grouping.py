"""Grouping: aggregates by key, nesting, and aggregates spread back over rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.tables import KeyedTable


def _names(by: str | Sequence[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def qby(df: DataFrame, by: str | Sequence[str], items: Mapping[str, Column]) -> KeyedTable:
    """Aggregates by key."""
    return KeyedTable(df.groupBy(*_names(by)).agg(*(c.alias(n) for n, c in items.items())), tuple(_names(by)))


def last_by(df: DataFrame, by: str | Sequence[str], order: str | Sequence[str]) -> KeyedTable:
    """The last row of each group."""
    by = _names(by)
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*(F.col(c).desc_nulls_last() for c in _names(order))))
    picked = df.withColumn("_at", at).where("_at = 1")
    return KeyedTable(picked.select(*by, *(c for c in df.columns if c not in by)), tuple(by))


def group(df: DataFrame, column: str, place: str) -> DataFrame:
    """(value, places): the places of each value, ascending."""
    return df.groupBy(column).agg(F.sort_array(F.collect_list(place)).alias("places"))


def xgroup(by: str | Sequence[str], df: DataFrame, order: str | Sequence[str]) -> DataFrame:
    """The other columns become lists, in the order."""
    by = _names(by)
    rest = [c for c in df.columns if c not in by]
    rows = F.array_sort(F.collect_list(F.struct(F.struct(*_names(order)).alias("_o"), F.struct(*rest).alias("_r"))))
    nested = df.groupBy(*by).agg(rows.alias("_rows"))
    return nested.select(*by, *(F.col(f"_rows._r.{c}").alias(c) for c in rest))


def ungroup(df: DataFrame) -> DataFrame:
    """Lists become rows; columns that are no lists are repeated."""
    lists = [f.name for f in df.schema.fields if f.dataType.typeName() == "array"]
    if not lists:
        return df
    rest = [c for c in df.columns if c not in lists]
    zipped = df.select(*rest, F.explode(F.arrays_zip(*lists)).alias("_z"))
    return zipped.select(*(F.col(f"_z.{c}").alias(c) if c in lists else F.col(c) for c in df.columns))


def fby(aggregate: Callable[..., Column], x: str, by: str | Sequence[str]) -> Column:
    """An aggregate by group, on every row of the group."""
    return aggregate(F.col(x), over=Window.partitionBy(*_names(by)))


def scatter(df: DataFrame, place: str, updates: DataFrame, at: str, value: str, column: str, how: str = "add") -> DataFrame:
    """Amend the rows at the given places by values: add them, or take the min or max of what is there and of them. A place may come often;
    updates are aggregated before the join. Rows without an update stay as they are."""
    made = {"add": F.sum, "min": F.min, "max": F.max}
    if how not in made:
        raise ValueError(f"unknown way to amend {how!r}")
    summed = updates.groupBy(F.col(at).alias("_at")).agg(made[how](value).alias("_new"))
    joined = df.join(summed, df[place] == summed["_at"], "left")
    new = {"add": F.col(column) + F.coalesce("_new", F.lit(0)), "min": F.least(column, "_new"), "max": F.greatest(column, "_new")}[how]
    return joined.select(*(new.alias(c) if c == column else df[c] for c in df.columns))


def bysym(df: DataFrame, sym: str) -> DataFrame:
    """Rows of a symbol in one partition, for repeated lookups by symbol."""
    return df.repartition(sym).sortWithinPartitions(sym)


def symrows(df: DataFrame, sym: str, value) -> DataFrame:
    return df.where(F.col(sym) == value)


def matrix_multiply(x: DataFrame, y: DataFrame) -> DataFrame:
    """Product of matrices held as rows (i, j, v)."""
    right = y.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("v").alias("w"))
    return x.join(right, "j").groupBy("i", F.col("k")).agg(F.sum(F.col("v") * F.col("w")).alias("v")).select("i", F.col("k").alias("j"), "v")
