"""Elementwise arithmetic on columns. NULL in, NULL out, unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def fdiv(x, y, strict: bool = False) -> Column:
    """x % y, always a float. By zero: NULL, or with ``strict`` inf, -inf and NaN as IEEE has it."""
    x, y = _c(x).cast("double"), _c(y).cast("double")
    if not strict:
        return F.when(y != 0, x / y)
    inf = F.lit(float("inf"))
    return F.when(y != 0, x / y).when(x.isNull() | y.isNull(), None).when(x > 0, inf).when(x < 0, -inf).otherwise(F.lit(float("nan")))


def mod(x, n) -> Column:
    """Floored remainder for positive n; n = 0 gives x."""
    x, n = _c(x), _c(n)
    return F.when(n == 0, x).otherwise(F.pmod(x, n))


def div(x, y) -> Column:
    """floor(x % y) as a long; NULL by zero."""
    return F.floor(fdiv(x, y)).cast("long")


def xbar(w, x) -> Column:
    """w * floor(x / w): the bucket of width w that x is in."""
    w, x = _c(w), _c(x)
    return w * F.floor(fdiv(x, w))


def xlog(base, x) -> Column:
    x = _c(x)
    return F.when(x > 0, F.ln(x) / F.ln(_c(base).cast("double")))


def reciprocal(x) -> Column:
    return fdiv(1.0, x)


def neg(x) -> Column:
    return -_c(x)


def absolute(x) -> Column:
    return F.abs(_c(x))


def signum(x) -> Column:
    return F.signum(_c(x)).cast("int")


def floor(x) -> Column:
    return F.floor(_c(x))


def ceiling(x) -> Column:
    return F.ceil(_c(x))


def sqrt(x) -> Column:
    """NULL for negative numbers."""
    x = _c(x)
    return F.when(x >= 0, F.sqrt(x))


def log(x) -> Column:
    """Natural logarithm; NULL unless positive."""
    x = _c(x)
    return F.when(x > 0, F.ln(x))


exp, sin, cos = F.exp, F.sin, F.cos


def round_half_up(digits: int, x) -> Column:
    """floor(0.5 + x * 10^d) / 10^d: halves go up, also for negative numbers."""
    scale = float(10**digits)
    return F.floor(F.lit(0.5) + _c(x) * scale) / F.lit(scale)


def not_(x) -> Column:
    """True for zero."""
    return _c(x) == 0


def smaller(x, y) -> Column:
    """x & y: the smaller; unlike LEAST, NULL if either is NULL."""
    x, y = _c(x), _c(y)
    return F.when(x.isNotNull() & y.isNotNull(), F.least(x, y))


def larger(x, y) -> Column:
    x, y = _c(x), _c(y)
    return F.when(x.isNotNull() & y.isNotNull(), F.greatest(x, y))


def match(x, y) -> Column:
    """Equal, NULLs included."""
    return _c(x).eqNullSafe(_c(y))


def null(x) -> Column:
    return _c(x).isNull()


def fill(value, x) -> Column:
    """value ^ x: x, or the value where x is NULL."""
    return F.coalesce(_c(x), _c(value))


def npdf(x) -> Column:
    return F.lit(0.39894228) * F.exp(-_c(x) * _c(x) / 2)


#: Coefficients of the five-term rational approximation of the normal distribution function.
NORMAL_CDF = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def ncdf(x) -> Column:
    x = _c(x).cast("double")
    k = 1 / (1 + 0.2316419 * F.abs(x))
    tail = F.lit(0.0)
    for a in reversed(NORMAL_CDF):
        tail = k * (F.lit(a) + tail)
    upper = 1 - npdf(x) * tail
    return F.when(x >= 0, upper).otherwise(1 - upper)


def black_scholes(spot, strike, years, vol, is_call, rate: float = 0.045) -> dict[str, Column]:
    """price (2 digits, not below 0), delta (4), gamma (6), vega for 1 % (4) and theta for a day (4)."""
    s, k, t, v = (_c(x).cast("double") for x in (spot, strike, years, vol))
    call = _c(is_call)
    spread = v * F.sqrt(t)
    d1 = (F.ln(s / k) + (rate + v * v / 2) * t) / spread
    d2 = d1 - spread
    kept = k * F.exp(-rate * t)
    price = F.when(call, s * ncdf(d1) - kept * ncdf(d2)).otherwise(kept * ncdf(-d2) - s * ncdf(-d1))
    theta = -s * npdf(d1) * v / (2 * F.sqrt(t)) - F.when(call, rate * kept * ncdf(d2)).otherwise(-rate * kept * ncdf(-d2))
    return {
        "price": F.greatest(F.lit(0.0), round_half_up(2, price)),
        "delta": round_half_up(4, F.when(call, ncdf(d1)).otherwise(ncdf(d1) - 1)),
        "gamma": round_half_up(6, npdf(d1) / (s * spread)),
        "vega": round_half_up(4, s * npdf(d1) * F.sqrt(t) / 100),
        "theta": round_half_up(4, theta / 365),
    }


# ---- casts ----------------------------------------------------------------------------------------------------------------

_TYPES = {
    "long": "bigint", "int": "bigint", "float": "double", "char": "string", "sym": "string", "bool": "boolean",
    "string": "string", "date": "date", "timestamp": "timestamp_ntz",
}


def cast(kind: str, x) -> Column:
    """Floats are cut to integers; text that is no number gives NULL; bool is x > 0."""
    x = _c(x)
    if kind == "bool":
        return x > 0
    if kind in ("date", "timestamp"):
        return x.try_cast(_TYPES[kind])
    return x.try_cast(_TYPES[kind])


def typename(x) -> Column:
    return F.typeof(_c(x))
