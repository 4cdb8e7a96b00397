"""Text and HTML views of small results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.temporal import stime
from tidewater.operators.tables import KeyedTable, unkey

#: Columns of these names are times of day and shown as such.
TIMES = ("time",)


def readable(t: DataFrame | KeyedTable) -> DataFrame:
    """Times of day as text."""
    df = unkey(t)
    return df.withColumns({c: stime(c) for c, k in df.dtypes if c in TIMES and k in ("bigint", "int")})


def grid(t: DataFrame | KeyedTable, rows: int = 20) -> str:
    """The first rows with a line under the header, a bar after the key, and how many rows and columns there are."""
    df = readable(t)
    got = df.limit(rows + 1).collect()
    keys = len(t.key) if isinstance(t, KeyedTable) else 0
    cells = [list(df.columns)] + [["" if v is None else f"{v:g}" if isinstance(v, float) else str(v) for v in r] for r in got[:rows]]
    width = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]

    def line(r: list[str]) -> str:
        parts = [x.ljust(w) for x, w in zip(r, width)]
        return (" ".join(parts[:keys]) + " | " + " ".join(parts[keys:]) if keys else " ".join(parts)).rstrip()

    more = "more than " * (len(got) > rows)
    foot = f"{more}{min(len(got), rows)} rows, {len(df.columns)} columns"
    return "\n".join([line(cells[0]), "-" * len(line(["-" * w for w in width])), *map(line, cells[1:]), foot])


def nrows(df: DataFrame) -> int:
    return df.count()


def describe(df: DataFrame) -> DataFrame:
    """Rows, and NULLs of each column."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
