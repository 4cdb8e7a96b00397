"""Tables: keyed tables, shape, rows, sorting and sets."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

ATTRIBUTE = "attribute"
#: Rows of a range of an order: on average no more than the one, and no less than the other for the sake of more tasks. Rows sampled for each range.
RANGE_MOST, RANGE_LEAST, RANGE_SAMPLE = 1_250_000, 10_000, 100


@dataclass(frozen=True)
class KeyedTable:
    """A table of which some columns are the key."""

    df: DataFrame
    key: tuple[str, ...]

    @property
    def values(self) -> tuple[str, ...]:
        return tuple(c for c in self.df.columns if c not in self.key)

    @property
    def columns(self) -> list[str]:
        return [*self.key, *self.values]


def xkey(key: str | Sequence[str], df: DataFrame | KeyedTable) -> KeyedTable:
    df = unkey(df)
    key = (key,) if isinstance(key, str) else tuple(key)
    missing = [k for k in key if k not in df.columns]
    if missing:
        raise ValueError(f"no column {missing[0]}")
    return KeyedTable(df.select(*key, *(c for c in df.columns if c not in key)), key)


def unkey(t: DataFrame | KeyedTable) -> DataFrame:
    return t.df.select(*t.columns) if isinstance(t, KeyedTable) else t


def istable(x) -> bool:
    return isinstance(x, DataFrame)


def iskeyed(x) -> bool:
    return isinstance(x, KeyedTable)


def isdict(x) -> bool:
    return isinstance(x, (Mapping, KeyedTable))


def cols(t: DataFrame | KeyedTable) -> list[str]:
    return t.columns


def keys(t: DataFrame | KeyedTable) -> list[str]:
    return list(t.key) if isinstance(t, KeyedTable) else []


def meta(t: DataFrame | KeyedTable) -> DataFrame:
    """(c, t, a): column, type and layout mark, in the order of the columns."""
    df = unkey(t)
    spark = df.sparkSession
    rows = [(f.name, f.dataType.simpleString(), f.metadata.get(ATTRIBUTE)) for f in df.schema.fields]
    return spark.createDataFrame(rows, "c string, t string, a string")


def marked(df: DataFrame, column: str, mark: str) -> DataFrame:
    """Remember that a column is sorted (s), unique (u), parted (p) or grouped (g); it tells readers, and orders nothing itself."""
    if mark not in "supg" or len(mark) != 1:
        raise ValueError(f"unknown mark {mark!r}")
    return df.withMetadata(column, {ATTRIBUTE: mark})


def sortcol(column: str, df: DataFrame) -> DataFrame:
    return marked(df.orderBy(F.col(column).asc_nulls_first()), column, "s")


def partcol(column: str, df: DataFrame) -> DataFrame:
    """Rows of one value together."""
    return marked(df.repartition(column).sortWithinPartitions(F.col(column).asc_nulls_first()), column, "p")


def groupcol(column: str, df: DataFrame) -> DataFrame:
    return marked(df, column, "g")


def xcols(first: str | Sequence[str], df: DataFrame) -> DataFrame:
    first = [first] if isinstance(first, str) else list(first)
    return df.select(*first, *(c for c in df.columns if c not in first))


def xcolall(names: Sequence[str], df: DataFrame) -> DataFrame:
    return df.toDF(*names)


def take_columns(names: Sequence[str], df: DataFrame) -> DataFrame:
    """A name that is no column gives NULLs."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).alias(c) for c in names))


def drop_columns(names: Sequence[str], df: DataFrame) -> DataFrame:
    return df.drop(*names)


def rows(df: DataFrame) -> DataFrame:
    return df.select(F.struct("*").alias("row"))


def qwhere(df: DataFrame, mask: Column) -> DataFrame:
    """Rows where the mask holds; NULL does not."""
    return df.where(mask)


def qselect(df: DataFrame, items: Mapping[str, Callable[[DataFrame], Column]], aggregates: bool = False) -> DataFrame:
    """Computed columns; with ``aggregates`` all are aggregates, and the result is one row."""
    made = [f(df).alias(name) for name, f in items.items()]
    return df.agg(*made) if aggregates else df.select(*made)


def insert(df: DataFrame, more: DataFrame) -> DataFrame:
    """Append rows; the columns must be the same."""
    if df.columns != more.columns:
        raise ValueError(f"columns differ: {df.columns} and {more.columns}")
    return df.union(more)


def append_by_name(df: DataFrame, more: DataFrame) -> DataFrame:
    return df.unionByName(more)


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "_at", down: Sequence[str | Column] = ()) -> DataFrame:
    """Rows with their place in the order, from 0: by ``down`` descending, NULLs last, then by ``order`` ascending, NULLs first. Ranges of the order are
    sorted one by one; only their sizes, a row for each range, come together, so that no task holds the table. Rows that the order does not tell apart are
    numbered in any way. The table is read for its size, for the ends of ranges, for their sizes and for the rows, and has to be the same each time."""
    falling, rising = ([F.col(c) if isinstance(c, str) else c for c in cs] for cs in (down, order))
    parts, ranged = _ranged(df, falling, rising)
    by = [*(c.desc_nulls_last() for c in falling), *(c.asc_nulls_first() for c in rising)]
    within = ranged.repartitionById(parts, F.col("_range")).withColumn("_place", F.row_number().over(Window.partitionBy("_range").orderBy(*by)) - 1)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("_range").alias("_r"), before.alias("_start"))
    joined = within.join(F.broadcast(starts), F.col("_range") == F.col("_r"))  # a row for each range
    return joined.select(*(df[c] for c in df.columns), (F.col("_start") + F.col("_place")).alias(name))


def _ranged(df: DataFrame, falling: Sequence[Column], rising: Sequence[Column]) -> tuple[int, DataFrame]:
    """How many ranges an order is cut into, and rows with theirs, from their values alone: Spark's own ranges are drawn anew each time a plan runs, so that
    the sizes of one run do not fit the rows of another. Ends of ranges are taken from a sample; they decide how even the ranges are, not what is right."""
    count = df.count()
    parts = max(-(-count // RANGE_MOST), min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // RANGE_LEAST)), 1)
    key = F.struct(*(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(cs))).alias(k) for k, cs in (("down", falling), ("up", rising)) if cs))
    texts = []
    if parts > 1:
        keys = df.select(key.alias("key")).sample(min(1.0, RANGE_SAMPLE * parts / count), seed=1)
        w = Window.orderBy(*(F.desc("key.down") for _ in falling[:1]), *(F.asc("key.up") for _ in rising[:1]))
        tiles = keys.select("key", F.ntile(parts).over(w).alias("tile"), F.row_number().over(w).alias("n"))
        firsts = tiles.withColumn("first", F.col("tile") != F.lag("tile").over(Window.orderBy("n"))).where("first")
        texts = [r["text"] for r in firsts.orderBy("n").select(F.to_json("key").alias("text")).collect()]
    kind = df.select(F.from_json(F.lit("{}"), df.select(key.alias("key")).schema["key"].dataType).alias("key")).schema["key"].dataType
    ranged = df.withColumn("_range_key", key.cast(kind)).withColumn("_range", F.lit(0))
    for i in reversed(range(len(texts).bit_length())):  # binary search for how many ends a row has reached
        end = F.get(F.from_json(F.lit(f"[{','.join(texts[(1 << i) - 1 :: 2 << i])}]"), ArrayType(kind)), F.col("_range"))
        reached = end["up"] <= F.col("_range_key.up") if rising else F.lit(True)
        if falling:
            reached = (end["down"] > F.col("_range_key.down")) | ((end["down"] == F.col("_range_key.down")) & reached)
        ranged = ranged.withColumn("_range", 2 * F.col("_range") + F.when(reached, 1).otherwise(0))
    return parts, ranged.drop("_range_key")


def atr(df: DataFrame, places: DataFrame, order: Sequence[str], place: str = "i") -> DataFrame:
    """Rows by place, from 0 in the order; a place out of range gives a row of NULLs. ``places`` is kept in front."""
    at = numbered(df, order)
    return places.join(at, F.col(place) == F.col("_at"), "left").drop("_at")


def flip(d: Mapping[str, Sequence], spark: SparkSession) -> DataFrame:
    """Table of a dictionary of equally long columns; single values are repeated."""
    n = max((len(v) for v in d.values() if isinstance(v, (list, tuple))), default=1)
    full = {k: list(v) if isinstance(v, (list, tuple)) else [v] * n for k, v in d.items()}
    if any(len(v) != n for v in full.values()):
        raise ValueError("columns differ in length")
    return spark.createDataFrame(list(zip(*full.values())), list(full))


# ---- sorting --------------------------------------------------------------------------------------------------------------


def xasc(by: str | Sequence[str], df: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Sort; NULLs first. ``order`` breaks ties, so that the sort is stable with respect to it."""
    by = [by] if isinstance(by, str) else list(by)
    return df.orderBy(*(F.col(c).asc_nulls_first() for c in by), *order)


def xdesc(by: str | Sequence[str], df: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    by = [by] if isinstance(by, str) else list(by)
    return df.orderBy(*(F.col(c).desc_nulls_last() for c in by), *order)


def sublist(n: int, df: DataFrame, order: Sequence[str]) -> DataFrame:
    """First n rows in the order, or the last for negative n; a top-n, not a sort of everything."""
    if n >= 0:
        return df.orderBy(*order).limit(n)
    return df.orderBy(*(F.col(c).desc() for c in order)).limit(-n)


def take(n: int, df: DataFrame, order: Sequence[str]) -> DataFrame:
    """n rows from the start, or from the end; starting over if there are fewer. Adds no order of its own."""
    size = df.count()
    if not size or abs(n) <= size:
        return sublist(n, df, order)
    at = numbered(df, order)
    start = 0 if n >= 0 else n % size
    shifted = F.pmod(F.col("_at") - start, F.lit(size))
    times = F.floor((F.lit(abs(n)) - shifted - 1) / size) + 1
    return at.withColumn("_again", F.explode(F.sequence(F.lit(1), times.cast("int")))).drop("_at", "_again")


def drop_rows(n: int, df: DataFrame, order: Sequence[str]) -> DataFrame:
    """All but the first n rows, or the last for negative n."""
    if n >= 0:
        return df.orderBy(*order).offset(n)
    return df.orderBy(*(F.col(c).desc() for c in order)).offset(-n)


def topk(k: int, by: str, df: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.col(by).desc_nulls_last(), *order).limit(k)


def is_sorted(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row: whether the rows in ``order`` are sorted by the columns. Ranges of the order are looked at one by one, then their ends."""
    parts = df.select(F.struct(*by).alias("_v"), F.struct(*order).alias("_o")).repartitionByRange("_o").withColumn("_range", F.spark_partition_id())
    before = F.lag("_v").over(Window.partitionBy("_range").orderBy("_o"))
    inside = parts.withColumn("_ok", F.coalesce(before <= F.col("_v"), F.lit(True))).groupBy("_range").agg(
        F.bool_and("_ok").alias("_ok"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
    )
    # if a range is sorted, its first and last rows have its least and its largest values; a row for each range comes together here
    across = F.coalesce(F.lag("_high").over(Window.orderBy("_range")) <= F.col("_low"), F.lit(True))
    return inside.select((F.col("_ok") & across).alias("ok")).agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("sorted"))


# ---- sets -----------------------------------------------------------------------------------------------------------------


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def union(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.union(y).distinct()


def _same(x: DataFrame, y: DataFrame, on: Sequence[str]) -> tuple[DataFrame, Column]:
    y = y.select(*(F.col(c).alias(f"_{c}") for c in on)).distinct()
    cond = F.lit(True)
    for c in on:
        cond &= x[c].eqNullSafe(y[f"_{c}"])
    return y, cond


def inter(x: DataFrame, y: DataFrame, on: Sequence[str] | None = None) -> DataFrame:
    """Rows of x that are in y; repeats stay."""
    y, cond = _same(x, y, on or x.columns)
    return x.join(y, cond, "left_semi")


def except_(x: DataFrame, y: DataFrame, on: Sequence[str] | None = None) -> DataFrame:
    """Rows of x that are not in y; repeats stay."""
    y, cond = _same(x, y, on or x.columns)
    return x.join(y, cond, "left_anti")


def in_(df: DataFrame, column: str, values: DataFrame, out: str = "found") -> DataFrame:
    """Whether a value is in the first column of another table."""
    y = values.select(F.col(values.columns[0]).alias("_v")).distinct().withColumn("_hit", F.lit(True))
    return df.join(y, df[column].eqNullSafe(y["_v"]), "left").select(*(df[c] for c in df.columns), F.coalesce("_hit", F.lit(False)).alias(out))


def match(x: DataFrame, y: DataFrame) -> bool:
    """Same columns, types and rows, whatever their order."""
    if [(f.name, f.dataType) for f in x.schema] != [(f.name, f.dataType) for f in y.schema]:
        return False
    return not x.exceptAll(y).limit(1).count() and not y.exceptAll(x).limit(1).count()
