"""Text functions, for columns or values of type string."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


lower, upper = F.lower, F.upper


def ltrim(x) -> Column:
    """Spaces only."""
    return F.ltrim(_c(x))


def rtrim(x) -> Column:
    return F.rtrim(_c(x))


def trim(x) -> Column:
    return F.trim(_c(x))


def ss(x, pattern: str) -> Column:
    """Places, from 0, where the text is found, overlapping ones included."""
    x, n = _c(x), len(pattern)
    if not n:
        return F.array().cast("array<int>")
    last = F.length(x) - n
    places = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: F.substring(x, i + 1, F.lit(n)) == pattern)


def ssr(x, found: str, new: str) -> Column:
    return F.replace(_c(x), F.lit(found), F.lit(new))


def sv(separator: str, parts) -> Column:
    return F.array_join(_c(parts), separator)


def vs(separator: str, x) -> Column:
    return F.split(_c(x), re.escape(separator), -1)


def decode_base(base: int, digits) -> Column:
    """Number of digits in a base, the highest first."""
    return F.aggregate(_c(digits), F.lit(0).cast("long"), lambda a, d: a * base + d)


def encode_base(base: int, x, width: int) -> Column:
    """Digits of a number, ``width`` of them, the highest first."""
    x = _c(x).cast("long")
    return F.array(*(F.pmod(F.floor(x / F.lit(base**k)), F.lit(base)).cast("long") for k in reversed(range(width))))


def glob(pattern: str) -> str:
    """Regular expression of a pattern with * and ?."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def like(x, pattern: str) -> Column:
    return _c(x).rlike(glob(pattern))


def string(x) -> Column:
    return _c(x).cast("string")


def pad(n: int, x) -> Column:
    """To n characters, cut if longer; negative n aligns to the right."""
    return F.rpad(_c(x), n, " ") if n >= 0 else F.lpad(_c(x), -n, " ")


def hex_(x) -> Column:
    return F.lower(F.hex(_c(x)))


def unhex(x) -> Column:
    return F.unhex(_c(x)).cast("string")


def z2(x) -> Column:
    return F.lpad(_c(x).cast("string"), 2, "0")


def z3(x) -> Column:
    return F.lpad(_c(x).cast("string"), 3, "0")


def comma(x) -> Column:
    """Integer part with commas between thousands."""
    return F.format_number(_c(x), 0)


def fixed(digits: int, x) -> Column:
    """So many digits after the point, without commas."""
    return F.replace(F.format_number(_c(x), digits), F.lit(","), F.lit(""))


def fixed_width(width: int, digits: int, x) -> Column:
    return F.lpad(fixed(digits, x), width, " ")


def identifier(x) -> Column:
    """What is no letter or digit goes; a leading digit gets an a before it."""
    plain = F.regexp_replace(_c(x), "[^A-Za-z0-9_]", "")
    return F.when(plain.rlike("^[0-9]"), F.concat(F.lit("a"), plain)).otherwise(plain)


def dotted(*parts) -> Column:
    return F.concat_ws(".", *map(_c, parts))


DIGITS = "0123456789"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
CAPITALS = LETTERS.upper()
