"""Functions of array and map values in a cell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def til(n) -> Column:
    """0 to n - 1."""
    n = _c(n).cast("long")
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<bigint>"))


def enlist(x) -> Column:
    return F.array(_c(x))


def count(x) -> Column:
    return F.size(_c(x))


def first(x) -> Column:
    return F.get(_c(x), F.lit(0))


def last(x) -> Column:
    return F.get(_c(x), F.size(_c(x)) - 1)


def reverse(x) -> Column:
    return F.reverse(_c(x))


def at(x, i) -> Column:
    """NULL out of range."""
    return F.get(_c(x), _c(i))


def where(x) -> Column:
    """Places of the trues."""
    return F.filter(F.transform(_c(x), lambda v, i: F.when(v, i)), lambda i: i.isNotNull())


def replicate(x) -> Column:
    """Places, each as often as the number there says."""
    return F.flatten(F.transform(_c(x), lambda n, i: F.array_repeat(i, n.cast("int"))))


def find(x, y) -> Column:
    """Place of the first y in x, NULL if there is none."""
    p = F.array_position(_c(x), _c(y))
    return F.when(p > 0, p - 1)


def bin_(x, y) -> Column:
    """Place of the last element <= y in a sorted array; -1 before all."""
    y = _c(y)
    return F.size(F.filter(_c(x), lambda v: v <= y)) - 1


def take(n: int, x) -> Column:
    """First n, from the end for negative n; cycling if there are fewer."""
    x = _c(x)
    size = F.size(x)
    places = F.sequence(F.lit(0), F.lit(abs(n) - 1)) if n else F.array().cast("array<int>")
    start = F.lit(0) if n >= 0 else F.lit(n)
    return F.transform(places, lambda i: F.get(x, F.when(size > 0, F.pmod(i + start, size))))


def drop(n: int, x) -> Column:
    x = _c(x)
    keep = F.greatest(F.size(x) - abs(n), F.lit(0))
    return F.slice(x, n + 1, keep) if n >= 0 else F.slice(x, 1, keep)


def sublist(n: int, x) -> Column:
    """First or last n, without cycling."""
    x = _c(x)
    got = F.least(F.size(x), F.lit(abs(n)))
    return F.slice(x, 1, got) if n >= 0 else F.slice(x, F.size(x) - got + 1, got)


def rotate(n: int, x) -> Column:
    x = _c(x)
    return F.transform(x, lambda v, i: F.get(x, F.pmod(i + n, F.size(x))))


def cut(places: list[int], x) -> Column:
    """Pieces that start at each place."""
    x = _c(x)
    ends = [*places[1:], None]
    return F.array(*(F.slice(x, a + 1, (F.lit(b) if b is not None else F.size(x)) - a) for a, b in zip(places, ends)))


def reshape(rows: int, cols: int, x) -> Column:
    x = _c(x)
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda c: F.get(x, F.pmod(r * cols + c, F.size(x)))))


def flip(x) -> Column:
    """Transpose an array of equally long arrays."""
    x = _c(x)
    return F.transform(til(F.size(F.get(x, F.lit(0)))), lambda j: F.transform(x, lambda row: F.get(row, j.cast("int"))))


def raze(x) -> Column:
    return F.flatten(_c(x))


def distinct(x) -> Column:
    return F.array_distinct(_c(x))


def union(x, y) -> Column:
    return F.array_union(_c(x), _c(y))


def inter(x, y) -> Column:
    """Elements of x that are in y, repeats and order kept."""
    y = _c(y)
    return F.filter(_c(x), lambda v: F.array_contains(y, v))


def except_(x, y) -> Column:
    y = _c(y)
    return F.filter(_c(x), lambda v: ~F.array_contains(y, v))


def in_(x, y) -> Column:
    y = _c(y)
    return F.transform(_c(x), lambda v: F.array_contains(y, v))


def cross(x, y) -> Column:
    y = _c(y)
    return F.flatten(F.transform(_c(x), lambda a: F.transform(y, lambda b: F.array(a, b))))


def iasc(x) -> Column:
    """Places in ascending order of the values, NULLs first, equals in their order."""
    pairs = F.transform(_c(x), lambda v, i: F.struct(v.isNotNull().alias("n"), v.alias("v"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"])


def idesc(x) -> Column:
    pairs = F.transform(_c(x), lambda v, i: F.struct(v.isNotNull().alias("n"), v.alias("v"), (-i).alias("i")))
    return F.transform(F.reverse(F.array_sort(pairs)), lambda p: -p["i"])


def rank(x) -> Column:
    order = iasc(x)
    return F.transform(_c(x), lambda v, i: (F.array_position(order, i) - 1))


def asc(x) -> Column:
    return F.sort_array(_c(x), asc=True)


def desc(x) -> Column:
    return F.sort_array(_c(x), asc=False)


def amend(x, place, f: Callable[[Column], Column]) -> Column:
    """f of the element at a place, the others as they are."""
    place = _c(place)
    return F.transform(_c(x), lambda v, i: F.when(i == place, f(v)).otherwise(v))


def splice(x, start: int, stop: int, y) -> Column:
    x = _c(x)
    return F.concat(F.slice(x, 1, start), _c(y), F.slice(x, stop + 1, F.greatest(F.size(x) - stop, F.lit(0))))


def keep(f: Callable[[Column], Column], x) -> Column:
    return F.filter(_c(x), f)


def weed(f: Callable[[Column], Column], x) -> Column:
    return F.filter(_c(x), lambda v: ~f(v))


def each(f: Callable[[Column], Column], x) -> Column:
    return F.transform(_c(x), f)


def each2(f: Callable[[Column, Column], Column], x, y) -> Column:
    return F.zip_with(_c(x), _c(y), f)


def fold(f: Callable[[Column, Column], Column], start, x) -> Column:
    return F.aggregate(_c(x), _c(start), f)


def scan(f: Callable[[Column, Column], Column], start, x, kind: str) -> Column:
    """All intermediate values of a fold."""
    first = F.struct(_c(start).cast(kind).alias("v"), F.array().cast(f"array<{kind}>").alias("all"))

    def step(a, v):
        made = f(a["v"], v).cast(kind)
        return F.struct(made.alias("v"), F.concat(a["all"], F.array(made)).alias("all"))

    return F.aggregate(_c(x), first, step, lambda a: a["all"])


def dot(x, y) -> Column:
    return F.aggregate(F.zip_with(_c(x), _c(y), lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, v: a + v)


def mmu(x, y) -> Column:
    """Product of matrices held as arrays of rows."""
    columns = flip(y)
    return F.transform(_c(x), lambda row: F.transform(columns, lambda col: dot(row, col)))


def unit_matrix(n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: (i == j).cast("int")))


def odometer(*sizes: int) -> Column:
    """All index combinations, one array for each axis."""
    total = 1
    for s in sizes:
        total *= s
    out, inner = [], total
    for s in sizes:
        inner //= s
        out.append(_digit(total, inner, s))
    return F.array(*out)


def _digit(total: int, step: int, size: int) -> Column:
    return F.transform(til(total), lambda i: F.pmod(F.floor(i / step), F.lit(size)).cast("long"))


def primes(n: int) -> Column:
    """Primes below n."""
    if n < 3:
        return F.array().cast("array<bigint>")
    return F.filter(F.sequence(F.lit(2).cast("long"), F.lit(n - 1).cast("long")), lambda p: F.forall(F.sequence(F.lit(2).cast("long"), F.greatest(F.floor(F.sqrt(p.cast("double"))), F.lit(2))), lambda d: (p == d) | (F.pmod(p, d) != 0)))


# ---- maps -----------------------------------------------------------------------------------------------------------------


def make(keys, values) -> Column:
    return F.map_from_arrays(_c(keys), _c(values))


def keys(d) -> Column:
    return F.map_keys(_c(d))


def values(d) -> Column:
    return F.map_values(_c(d))


def merge(d, e) -> Column:
    """Entries of both; e wins."""
    e = _c(e)
    mine = F.map_filter(_c(d), lambda k, v: ~F.map_contains_key(e, k))
    return F.map_concat(mine, e)


def take_keys(ks, d) -> Column:
    d = _c(d)
    return F.map_from_arrays(_c(ks), F.transform(_c(ks), lambda k: F.try_element_at(d, k)))


def drop_keys(ks, d) -> Column:
    ks = _c(ks)
    return F.map_filter(_c(d), lambda k, v: ~F.array_contains(ks, k))


def combine(f: Callable[[Column, Column], Column], absent, d, e) -> Column:
    """f on the values of equal keys; a key of one map only meets ``absent`` (0 for sums, 1 for products)."""
    fill = _c(absent)
    return F.map_zip_with(_c(d), _c(e), lambda k, a, b: f(F.coalesce(a, fill), F.coalesce(b, fill)))


# ---- JSON -----------------------------------------------------------------------------------------------------------------


def to_json(x) -> Column:
    return F.to_json(_c(x))


def from_json(x, schema: str) -> Column:
    return F.from_json(_c(x), schema)


def json_value(x, path: str, kind: str = "string") -> Column:
    """A value by path, NULL if it is not there or the text is no JSON."""
    return F.try_variant_get(F.try_parse_json(_c(x)), path, kind)
