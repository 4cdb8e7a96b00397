"""Aggregates, for groupBy().agg(), or for every row of a window with ``over``. NULLs are skipped; what an empty input gives is stated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from tidewater.functions.math import fdiv


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _place(order: str | Column | Sequence[str | Column]) -> Column:
    """One comparable value for the order of rows."""
    if isinstance(order, (str, Column)):
        return _c(order)
    return F.struct(*map(_c, order))


def _o(c: Column, over: WindowSpec | None) -> Column:
    return c if over is None else c.over(over)


def sum_(x, over: WindowSpec | None = None) -> Column:
    """0 on empty."""
    return F.coalesce(_o(F.sum(_c(x)), over), F.lit(0))


def prd(x, over: WindowSpec | None = None) -> Column:
    """1 on empty; a double."""
    return F.coalesce(_o(F.product(_c(x)), over), F.lit(1.0))


def min_(x, over: WindowSpec | None = None) -> Column:
    return _o(F.min(_c(x)), over)


def max_(x, over: WindowSpec | None = None) -> Column:
    return _o(F.max(_c(x)), over)


def avg(x, over: WindowSpec | None = None) -> Column:
    return _o(F.avg(_c(x)), over)


def count(x=None, over: WindowSpec | None = None) -> Column:
    """Rows, NULLs included."""
    return _o(F.count(F.lit(1)), over)


def count_distinct(x) -> Column:
    return F.count_distinct(_c(x))


def wsum(w, x, over: WindowSpec | None = None) -> Column:
    return F.coalesce(_o(F.sum(_c(w) * _c(x)), over), F.lit(0))


def wavg(w, x, over: WindowSpec | None = None) -> Column:
    """Weights first."""
    return fdiv(_o(F.sum(_c(w) * _c(x)), over), _o(F.sum(_c(w)), over))


def var(x, over: WindowSpec | None = None) -> Column:
    return _o(F.var_pop(_c(x)), over)


def dev(x, over: WindowSpec | None = None) -> Column:
    return _o(F.stddev_pop(_c(x)), over)


def svar(x, over: WindowSpec | None = None) -> Column:
    return _o(F.var_samp(_c(x)), over)


def sdev(x, over: WindowSpec | None = None) -> Column:
    return _o(F.stddev_samp(_c(x)), over)


def cov(x, y, over: WindowSpec | None = None) -> Column:
    return _o(F.covar_pop(_c(x), _c(y)), over)


def scov(x, y, over: WindowSpec | None = None) -> Column:
    return _o(F.covar_samp(_c(x), _c(y)), over)


def cor(x, y, over: WindowSpec | None = None) -> Column:
    return _o(F.corr(_c(x), _c(y)), over)


def med(x, over: WindowSpec | None = None) -> Column:
    """Mean of the middle two; exact."""
    return _o(F.median(_c(x)), over)


def all_(x, over: WindowSpec | None = None) -> Column:
    return F.coalesce(_o(F.bool_and(_c(x)), over), F.lit(True))


def any_(x, over: WindowSpec | None = None) -> Column:
    return F.coalesce(_o(F.bool_or(_c(x)), over), F.lit(False))


def first(x, order, over: WindowSpec | None = None) -> Column:
    """Value of the first row by the order, also where it is NULL. With one number or time as the order and a value of fixed width it is
    aggregated by hash, without a sort."""
    return _o(F.min_by(_c(x), _place(order)), over)


def last(x, order, over: WindowSpec | None = None) -> Column:
    return _o(F.max_by(_c(x), _place(order)), over)


def argmin(x, order, over: WindowSpec | None = None) -> Column:
    """Place in the order of the smallest value, the first of equals."""
    return _o(F.min_by(_place(order), F.when(_c(x).isNotNull(), F.struct(_c(x), _place(order)))), over)


def argmax(x, order, over: WindowSpec | None = None) -> Column:
    """Place of the largest value of any type, the first of equals. ``order``: integer columns."""
    by = [order] if isinstance(order, (str, Column)) else list(order)
    early = [F.bitwise_not(_c(o)) for o in by]
    return _o(F.max_by(_place(order), F.when(_c(x).isNotNull(), F.struct(_c(x), *early))), over)


def dot(x, y, over: WindowSpec | None = None) -> Column:
    return F.coalesce(_o(F.sum(_c(x) * _c(y)), over), F.lit(0.0))
