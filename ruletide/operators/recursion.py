"""Strictly backward recursion over bars: carries as window aggregates, anything else as one ordered scan for each entity."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry(rows: DataFrame, by: list[str], time: str, how: str, value: str, start: str, before: str | None, bridging: bool = False) -> DataFrame:
    """Rows (by, time, out): a value carried along each entity's chain.

    rows: `start` is true where a chain begins with `value`; elsewhere `value` joins the carried one by product, sum, max or
    min, or (copy) the chain's value is handed on. `before` holds the bar a step reads: the chain ends where the entity's
    previous row is not that bar (or, bridging gaps, where there is no row at or before it). A step without a chain derives
    nothing.
    """
    w = Window.partitionBy(*by).orderBy(time)
    last = F.lag(time).over(w)
    ok = last <= F.col(before) if bridging else last == F.col(before)
    begins = F.col(start) | ~F.coalesce(ok, F.lit(False))
    rows = rows.withColumn("__new", begins).withColumn("__twice", last == F.col(time))
    rows = rows.withColumn("__seg", F.sum(F.col("__new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = Window.partitionBy(*by, "__seg").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    out = {"product": F.product, "sum": F.sum, "max": F.max, "min": F.min, "copy": lambda c: F.last(c, ignorenulls=True)}[how](F.col(value)).over(s)
    alive = F.first(start).over(s)
    guard = F.when(F.col("__twice"), F.raise_error(F.lit("a carried value has two tuples at one bar")).cast("double"))
    return rows.withColumn("__out", F.coalesce(guard, out.cast("double"))).withColumn("__alive", alive).where("__alive").select(*by, time, F.col("__out").alias("out"))


def latch(rows: DataFrame, by: list[str], time: str, enter: Column, stay: Column) -> DataFrame:
    """rows with `on`: 1 from a bar where enter holds for as long as stay does, else 0."""
    w = Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    event = F.when(enter, 1).when(~stay, 0)
    return rows.withColumn("on", F.coalesce(F.last(event, ignorenulls=True).over(w), F.lit(0)))


def scan(rows: DataFrame, by: list[str], step, schema: str) -> DataFrame:
    """One ordered pass over each entity's rows.

    rows: columns by, `T`, `__rule` (-1: a tuple that needs no recursion) and `__at` (the bar a recursive rule reads; with
    `__asof`, the latest at or before it). step(rule, row, tuple | None) yields output tuples; those of the state are found by
    bar. Each entity's rows must fit into a task, as its bars do.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bars: list = []
        state: dict = {}
        out = []
        for row in pdf.sort_values(["T", "__rule"], kind="stable").to_dict("records"):
            t = row["T"]
            if row["__rule"] < 0:
                found = [None]
            else:
                at = row["__at"]
                if row["__asof"]:
                    i = bisect_right(bars, at)
                    i = i if i and bars[i - 1] < t else bisect_left(bars, t)
                    at = bars[min(i, bisect_right(bars, row["__at"])) - 1] if min(i, bisect_right(bars, row["__at"])) else None
                found = state.get(at, []) if at is not None and at < t else []
            for have in found:
                for made in step(row["__rule"], row, have):
                    if t not in state:
                        state[t] = []
                        bars.append(t)
                    if made not in state[t]:
                        state[t].append(made)
                        out.append((*(row[b] for b in by if not b.startswith("__")), t, *made))
        return pd.DataFrame(out, columns=None if out else range(len(schema.split(",")))).set_axis([c.split()[0].strip("`") for c in schema.split(", ")], axis=1)

    return rows.groupBy(*by).applyInPandas(run, schema)
