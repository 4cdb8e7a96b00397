"""Dates as days, times as milliseconds of a day, timestamps in microseconds, all counted from 2000-01-01 where they are numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
_EPOCH = "2000-01-01"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def epoch() -> Column:
    return F.lit(_EPOCH).cast("date")


# ---- dates ----------------------------------------------------------------------------------------------------------------


def days_of(d) -> Column:
    """Days since the epoch of a date or timestamp."""
    return F.datediff(_c(d).cast("date"), epoch())


def date_of(n) -> Column:
    return F.date_add(epoch(), _c(n).cast("int"))


def ymd2d(y, m, d) -> Column:
    return F.datediff(F.make_date(_c(y), _c(m), _c(d)), epoch())


def d2ymd(n) -> Column:
    at = date_of(n)
    return F.struct(F.year(at).alias("year"), F.month(at).alias("month"), F.day(at).alias("day"))


def dstr(n) -> Column:
    return F.date_format(date_of(n), "yyyy.MM.dd")


def pdate(text) -> Column:
    """Days of a text like 2024.01.15; NULL if it is no date."""
    return F.datediff(F.try_to_date(_c(text), "yyyy.MM.dd"), epoch())


def year(d) -> Column:
    return F.year(_c(d))


def month(d) -> Column:
    return F.month(_c(d))


def day(d) -> Column:
    return F.day(_c(d))


def dow(d) -> Column:
    """Mon to Sun."""
    return F.date_format(_c(d), "E")


def dadd(d, n) -> Column:
    return F.date_add(_c(d), _c(n))


def ddiff(x, y) -> Column:
    return F.datediff(_c(x), _c(y))


# ---- timestamps -----------------------------------------------------------------------------------------------------------


def micros_of(ts) -> Column:
    """Microseconds since the epoch."""
    return F.timestamp_diff("MICROSECOND", F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"), _c(ts).cast("timestamp_ntz"))


def tstamp(days, ms) -> Column:
    """Timestamp of days and milliseconds of the day."""
    return F.timestamp_add("MILLISECOND", _c(ms).cast("bigint"), date_of(days).cast("timestamp_ntz"))


def tsdate(ts) -> Column:
    return days_of(ts)


def tsms(ts) -> Column:
    """Milliseconds of the day."""
    ts = _c(ts).cast("timestamp_ntz")
    return F.floor(F.timestamp_diff("MICROSECOND", F.date_trunc("DAY", ts).cast("timestamp_ntz"), ts) / 1000).cast("long")


def pstr(ts) -> Column:
    return F.date_format(_c(ts), "yyyy.MM.dd'D'HH:mm:ss.SSS")


def ptstamp(text) -> Column:
    return F.try_to_timestamp(_c(text), F.lit("yyyy.MM.dd'D'HH:mm:ss[.SSS]")).cast("timestamp_ntz")


# ---- times of day, in milliseconds ----------------------------------------------------------------------------------------


def _whole(x: Column, n: int) -> Column:
    return F.floor(x / n).cast("long")


def hms(h, m, s) -> Column:
    return (_c(h) * 3600 + _c(m) * 60 + _c(s)) * 1000


def hh(t) -> Column:
    return _whole(_c(t), 3_600_000)


def mm(t) -> Column:
    return F.pmod(_whole(_c(t), 60_000), F.lit(60))


def sec(t) -> Column:
    return F.pmod(_whole(_c(t), 1000), F.lit(60))


def milli(t) -> Column:
    return F.pmod(_c(t), F.lit(1000))


def minute(t) -> Column:
    """Minutes since midnight."""
    return _whole(_c(t), 60_000)


def second(t) -> Column:
    return _whole(_c(t), 1000)


def stime(t) -> Column:
    """HH:MM:SS.mmm"""
    part = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.concat(part(hh(t), 2), F.lit(":"), part(mm(t), 2), F.lit(":"), part(sec(t), 2), F.lit("."), part(milli(t), 3))


def ptime(text) -> Column:
    """Milliseconds of HH:MM:SS or HH:MM:SS.mmm"""
    p = F.split(_c(text), "[:.]")
    at = lambda i: F.coalesce(F.get(p, F.lit(i)).try_cast("long"), F.lit(0))
    return hms(at(0), at(1), at(2)) + at(3)


def bar(width, unit_ms: int, t) -> Column:
    """Start of the bar of ``width`` units that a time is in."""
    w = _c(width) * unit_ms
    return (w * F.floor(_c(t) / w)).cast("long")


def minbar(width, t) -> Column:
    return bar(width, 60_000, t)


def minbar_of(width: int, ts) -> Column:
    """The same for timestamps."""
    us = width * 60_000_000
    return F.timestamp_add("MICROSECOND", (F.floor(micros_of(ts) / us) * us).cast("bigint"), F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"))


# ---- clocks ---------------------------------------------------------------------------------------------------------------


def now() -> Column:
    return F.current_timestamp()


def today() -> Column:
    return F.current_date()


def time_of_day() -> Column:
    return tsms(F.localtimestamp())
