"""Bars and calendars: bucket labels, the time domain, and the maps prev, lag, month_start and day_start over it.

An intraday bucket is labelled by its closing instant, a daily one by its date. The domain of a resolution holds the keys of
every relation at that resolution and the labels of all finer keys; it is a table of bars, small next to the data, and the
maps are windows over it that are joined back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruletide.dsl.ast import RESOLUTIONS, Duration


def bucket(t: Column, res: str) -> Column:
    """The label of the bar of resolution res that holds the instant t (a timestamp without zone)."""
    if res == "1d":
        return F.to_date(t)
    length = RESOLUTIONS[res]
    seconds = F.unix_micros(t.cast("timestamp")) / F.lit(1_000_000 * length)
    return F.timestamp_seconds(F.ceil(seconds) * length).cast("timestamp_ntz")


def bucket_range(label: Column, res: str) -> tuple[Column, Column]:
    """The instants of a bar: (start, end], or [day, next day) for a date."""
    if res == "1d":
        start = label.cast("timestamp_ntz")
        return start, start + F.expr("INTERVAL '1' DAY")
    return label - F.expr(f"INTERVAL '{RESOLUTIONS[res]}' SECOND"), label


def minus(t: Column, d: Duration) -> Column:
    """Calendar subtraction; months clamp the day of the month."""
    return t - F.expr(d.sql())


def domain(keys: list[DataFrame]) -> DataFrame:
    """One column T: the distinct keys of several tables of one column."""
    return reduce(lambda a, b: a.union(b), [k.toDF("T") for k in keys]).distinct()


def _bars() -> Window:
    return Window.orderBy("T")  # over the domain: one row a bar


def prev_map(bars: DataFrame) -> DataFrame:
    """(T, T0): the bar before each bar that has one."""
    return bars.select("T", F.lag("T").over(_bars()).alias("T0")).where("T0 is not null")


def lag_map(bars: DataFrame, n: Duration) -> DataFrame:
    """(T, T0): the latest bar at or before T - n."""
    back = F.expr(f"max(T) OVER (ORDER BY T RANGE BETWEEN UNBOUNDED PRECEDING AND {n.sql()} PRECEDING)") if n.approx else F.col("T")
    return bars.select("T", back.alias("T0")).where("T0 is not null")


def month_starts(bars: DataFrame) -> DataFrame:
    """(T): the first bar, and each bar whose month is not its predecessor's."""
    before = F.lag("T").over(_bars())
    return bars.select("T", (before.isNull() | (F.date_trunc("month", "T") != F.date_trunc("month", before))).alias("s")).where("s").select("T")


def day_starts(bars: DataFrame) -> DataFrame:
    before = F.lag("T").over(_bars())
    return bars.select("T", (before.isNull() | (F.to_date("T") != F.to_date(before))).alias("s")).where("s").select("T")
