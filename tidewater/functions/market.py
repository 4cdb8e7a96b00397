"""Quote and trade analytics: column algebra over bid, ask, bsz, asz, px and sz."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import temporal
from tidewater.functions.aggregates import first, last
from tidewater.functions.math import fdiv, round_half_up


def mid(bid="bid", ask="ask") -> Column:
    return (F.col(bid) + F.col(ask)) / 2


def spread(bid="bid", ask="ask") -> Column:
    return F.col(ask) - F.col(bid)


def spreadbps(bid="bid", ask="ask") -> Column:
    return round_half_up(2, fdiv(10000 * spread(bid, ask), mid(bid, ask)))


def micro(bid="bid", ask="ask", bsz="bsz", asz="asz") -> Column:
    """Mid weighted by the size of the other side."""
    return fdiv(F.col(bid) * F.col(asz) + F.col(ask) * F.col(bsz), F.col(bsz) + F.col(asz))


def imbal(bsz="bsz", asz="asz") -> Column:
    return round_half_up(4, fdiv(F.col(bsz) - F.col(asz), F.col(bsz) + F.col(asz)))


def tsign(px="px", bid="bid", ask="ask") -> Column:
    """1 above the mid, -1 below, 0 at it."""
    return F.signum(F.col(px) - mid(bid, ask)).cast("int")


def signedvol(px="px", sz="sz", bid="bid", ask="ask") -> Column:
    return tsign(px, bid, ask) * F.col(sz)


def effspread(px="px", bid="bid", ask="ask") -> Column:
    return 2 * F.abs(F.col(px) - mid(bid, ask))


def notional(px="px", sz="sz") -> Column:
    return F.col(px) * F.col(sz)


def vwap(px="px", sz="sz") -> Column:
    """Aggregate: volume-weighted mean price."""
    return fdiv(F.sum(F.col(px) * F.col(sz)), F.sum(sz))


def twap(px="px") -> Column:
    """Aggregate: mean price."""
    return F.avg(px)


def bars(df: DataFrame, width: int, order: str | Sequence[str], sym="sym", time="time", px="px", sz="sz", unit: str = "ms") -> DataFrame:
    """Open, high, low, close and volume of bars of so many minutes: (sym, time, o, h, l, c, v).

    ``time``: milliseconds of the day, or with unit="timestamp" a timestamp. One shuffle of partial aggregates.
    """
    start = temporal.minbar_of(width, time) if unit == "timestamp" else temporal.minbar(width, time)
    return df.groupBy(F.col(sym), start.alias(time)).agg(
        first(px, order).alias("o"), F.max(px).alias("h"), F.min(px).alias("l"), last(px, order).alias("c"), F.sum(sz).alias("v")
    )


def symstats(df: DataFrame, sym="sym", px="px", sz="sz") -> DataFrame:
    return df.groupBy(sym).agg(
        F.count(F.lit(1)).alias("n"), round_half_up(4, vwap(px, sz)).alias("vwap"), F.max(px).alias("hi"), F.min(px).alias("lo"), F.sum(sz).alias("vol")
    )
