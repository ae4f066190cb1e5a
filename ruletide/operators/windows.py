"""Aggregates over frames of time or of rows, ending at each base row.

Base rows and value rows are laid into one table (a value row may stand on a bar where there is no base row, and still
counts), shuffled once by the group, and aggregated by frames in which only value rows carry values.

A frame is summed anew at each row, which is the cheapest for short ones. Sums, means, deviations, covariances, correlations and
slopes over long frames are differences of running sums instead: those up to the row less those up to where its frame begins.
Both are frames without a beginning, which one pass over the sorted rows serves whatever the length. The sums are of distances
from the group's mean, so that little is lost in the difference; what remains of a deviation within their rounding is none.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruletide.dsl.ast import Duration


def _cols(names: list[str]) -> str:
    return ", ".join(f"`{n}`" for n in names)


def over(sql: str, frame: str) -> str:
    """SQL of aggregates with a frame behind each of them."""
    m = re.fullmatch(r"try_divide\((\w+\(.*?\)), (stddev_pop\(.*\)) \* (stddev_pop\(.*\))\)", sql)
    return f"try_divide({m[1]} OVER {frame}, {m[2]} OVER {frame} * {m[3]} OVER {frame})" if m else f"{sql} OVER {frame}"


_ONE = re.compile(r"(count|sum|avg|stddev_samp)\((\w+)\)")
_TWO = re.compile(r"(covar_samp|regr_slope)\((\w+), (\w+)\)")
_CORR = re.compile(r"try_divide\(covar_pop\((\w+), (\w+)\), .*\)")


def sums_of(sql: str) -> tuple[str, str, str | None] | None:
    """(function, column, other column) of an aggregate that running sums can give; None for any other."""
    if m := _ONE.fullmatch(sql):
        return m[1], m[2], None
    if m := _TWO.fullmatch(sql):
        return m[1], m[2], m[3]
    if m := _CORR.fullmatch(sql):
        return "corr", m[1], m[2]
    return None


def _moments(plans: dict[str, tuple]) -> tuple[dict[str, str], dict[str, str]]:
    """The sums that the aggregates are made of, as SQL, and the columns that hold them."""
    moments = {"n:__one": "__one"}
    for _, x, y in plans.values():
        for c in (x, y) if y else (x,):
            other = (y if c == x else x) if y else None
            own = f"`{c}`" if other is None else f"CASE WHEN `{other}` IS NOT NULL THEN `{c}` END"
            tag = c if other is None else f"{c}|{other}"
            moments |= {f"n:{tag}": f"CASE WHEN {own} IS NOT NULL THEN 1 END", f"s:{tag}": own, f"q:{tag}": f"({own}) * ({own})"}
        if y:
            moments[f"p:{x}|{y}"] = f"`{x}` * `{y}`"
    return moments, {m: f"__s{i}" for i, m in enumerate(moments)}


def _marked(rows: DataFrame, by: list[str], time: str, order: str, lower: str, plans: dict[str, tuple]) -> DataFrame:
    """(by, time, __n, aggregates) for each base row, by running sums at a marker row where each frame begins.

    For frames whose beginnings do not ascend with their ends: months before instants, where a month's last days are one.
    order: SQL of what frames are over; lower: that of a frame's first value, inclusive.
    """
    part = f"PARTITION BY {_cols(by)}"
    inputs = sorted({c for _, x, y in plans.values() for c in (x, y) if c and c != "__one"})
    flat = rows.select(*by, time, "__kind", "__one", F.expr(order).alias("__o"), F.expr(lower).alias("__lo"), *(F.expr(f"`{c}` - avg(`{c}`) OVER ({part})").alias(c) for c in inputs))
    marks = F.expr("CASE WHEN __kind = 1 THEN array(struct(1 AS k, __o AS o), struct(-1 AS k, __lo AS o)) ELSE array(struct(0 AS k, __o AS o)) END")
    flat = flat.withColumn("__m", F.explode(marks)).where("__kind <> 2")
    moments, names = _moments(plans)
    window = f"({part} ORDER BY __m.o, __m.k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    run = flat.select(*by, time, F.col("__m.k").alias("__k"), *(F.expr(f"coalesce(sum(CASE WHEN __m.k = 0 THEN {e} END) OVER {window}, 0)").alias(names[m]) for m, e in moments.items())).where("__k <> 0")
    at = lambda m, k: f"max(CASE WHEN __k = {k} THEN {names[m]} END)"
    out = run.groupBy(*by, time).agg(*(F.expr(f"{at(m, 1)} - {at(m, -1)}").alias(names[m]) for m in moments), *(F.expr(at(m, 1)).alias(f"{names[m]}_all") for m in moments if m[0] == "q"))
    center = rows.groupBy(*by).agg(*(F.avg(c).alias(f"__c_{c}") for c in inputs)) if any(f in ("sum", "avg") and x != "__one" for f, x, _ in plans.values()) else None
    if center is not None:
        out = out.join(center, by)
    return _from_sums(out, names, plans)


def _running(rows: DataFrame, by: list[str], order: str, back: str, edge: bool, last: str, plans: dict[str, tuple]) -> DataFrame:
    """The base rows of rows (`__kind` 1) with `__n` and the aggregates, by differences of running sums.

    order: the column that frames are over; back: SQL of their length; edge: whether a value just that far back is in the frame;
    last: where a frame ends.
    """
    part = f"PARTITION BY {_cols(by)}"
    inputs = sorted({c for _, x, y in plans.values() for c in (x, y) if c and c != "__one"})
    # one sort serves the means of the groups and all running sums
    flat = rows.where("__kind <> 2").sortWithinPartitions(*(F.col(f"`{c}`") for c in (*by, order)))
    flat = flat.select("*", *(F.expr(f"avg(`{c}`) OVER ({part})").alias(f"__c_{c}") for c in inputs))
    flat = flat.select(*(F.col(f"`{c}`") for c in rows.columns if c not in inputs), *(f"__c_{c}" for c in inputs), *(F.expr(f"`{c}` - `__c_{c}`").alias(c) for c in inputs))
    moments, names = _moments(plans)

    def total(m: str, frame: str) -> str:
        return f"coalesce(sum(CASE WHEN __kind = 0 THEN {moments[m]} END) OVER ({part} ORDER BY `{order}` RANGE BETWEEN {frame}), 0)"

    seen = {m: total(m, f"UNBOUNDED PRECEDING AND {last}") for m in moments}
    gone = {m: total(m, f"UNBOUNDED PRECEDING AND {back} PRECEDING") for m in moments}
    still = {m: f" + {total(m, f'{back} PRECEDING AND {back} PRECEDING')}" if edge else "" for m in moments}
    out = flat.select("*", *(F.expr(f"{seen[m]} - {gone[m]}{still[m]}").alias(names[m]) for m in moments), *(F.expr(seen[m]).alias(f"{names[m]}_all") for m in moments if m[0] == "q")).where("__kind = 1")
    return _from_sums(out, names, plans)


def _from_sums(out: DataFrame, names: dict[str, str], plans: dict[str, tuple]) -> DataFrame:
    """`__n` and the aggregates beside the columns of out, which holds the sums over each frame."""

    def spread(tag: str) -> str:
        """Sum of squared distances from the frame's own mean; none where it is within the rounding of the running sums."""
        n, s, q = (names[f"{m}:{tag}"] for m in "nsq")
        left = f"({q} - {s} * {s} / {n})"
        return f"(CASE WHEN {n} = 0 OR {left} <= 1e-13D * {q}_all THEN 0D ELSE {left} END)"

    cols = []
    for name, (f, x, y) in plans.items():
        tag = x if y is None else f"{x}|{y}"
        n, s = names[f"n:{tag}"], names.get(f"s:{tag}")
        if f == "count":
            e = f"CAST({n} AS BIGINT)"
        elif f == "sum":
            e = f"CASE WHEN {n} > 0 THEN {s} + {n} * `__c_{x}` END"
        elif f == "avg":
            e = f"CASE WHEN {n} > 0 THEN {s} / {n} + `__c_{x}` END"
        elif f == "stddev_samp":
            e = f"CASE WHEN {n} > 1 THEN sqrt({spread(tag)} / ({n} - 1)) END"
        else:
            both = f"({names[f'p:{tag}']} - {s} * {names[f's:{y}|{x}']} / {n})"
            over_x, over_y = spread(tag), spread(f"{y}|{x}")
            e = {"covar_samp": f"CASE WHEN {n} > 1 THEN {both} / ({n} - 1) END", "regr_slope": f"CASE WHEN {n} > 1 THEN try_divide({both}, {over_y}) END", "corr": f"CASE WHEN {n} > 1 THEN try_divide({both}, sqrt({over_x}) * sqrt({over_y})) END"}[f]
        cols.append(F.expr(e).alias(name))
    return out.select("*", F.expr(f"CAST({names['n:__one']} AS BIGINT)").alias("__n"), *cols)


def frame_aggregate(base: DataFrame, values: DataFrame, by: list[str], time: str, kind: str, length: Duration | int, aggregates: dict[str, str], least: int = 0, instant: str = "DAY", bars: DataFrame | None = None, running: bool = False) -> DataFrame:
    """base with one column for each aggregate, over the frame that ends at its time.

    values: columns by, time and whatever the aggregates' SQL reads (also `__one`, 1 on a value row); kind: window,
    prior_window (without the end) or rows (the latest `length` bars with a value row, or a row of `bars`). Aggregates are
    null where the frame has fewer than `least` value rows; `__n` counts them. running: by differences of running sums, if these
    can give all the aggregates.
    """
    plans = {a: sums_of(sql) for a, sql in aggregates.items()}
    running = running and all(plans.values())
    if not by:
        base, values = base.withColumn("__all", F.lit(1)), values.withColumn("__all", F.lit(1))
        bars = bars.withColumn("__all", F.lit(1)) if bars is not None else None
        by, extra = ["__all"], ["__all"]
    else:
        extra = []
    keep = base.columns
    rows = base.withColumn("__kind", F.lit(1)).unionByName(values.withColumn("__kind", F.lit(0)).withColumn("__one", F.lit(1)), allowMissingColumns=True)
    if bars is not None:
        rows = rows.unionByName(bars.select(*by, time).distinct().withColumn("__kind", F.lit(2)), allowMissingColumns=True)
    rows = rows.repartition(*by)
    part = f"PARTITION BY {_cols(by)}"
    if kind == "rows":
        if bars is not None:
            mark = F.expr("CASE WHEN __kind = 2 THEN 1 ELSE 0 END")
        else:
            # value rows come first on a bar, and the first of them counts it
            mark = F.expr(f"CASE WHEN __kind = 0 AND NOT lag(`{time}`) OVER ({part} ORDER BY `{time}`, __kind) <=> `{time}` THEN 1 ELSE 0 END")
        rows = rows.withColumn("__mark", mark)
        rows = rows.withColumn("__ix", F.expr(f"sum(__mark) OVER ({part} ORDER BY `{time}` RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
        order, back = "__ix", f"{int(length)}"
        frame = f"({part} ORDER BY __ix RANGE BETWEEN {int(length) - 1} PRECEDING AND CURRENT ROW)"
    else:
        order = f"`{time}`"
        if kind == "prior_window":  # value rows stand half a step later, so that those of the base's own bar are not yet seen
            half = "INTERVAL '12' HOUR" if instant == "DAY" else "INTERVAL '0.5' SECOND"
            rows = rows.withColumn("__t", F.expr(f"CAST(`{time}` AS TIMESTAMP_NTZ) + CASE WHEN __kind = 1 THEN INTERVAL '0' SECOND ELSE {half} END"))
            order = "__t"
        back = length.sql()
        frame = f"({part} ORDER BY {order} RANGE BETWEEN {length.sql()} PRECEDING AND CURRENT ROW)"
    if running and kind != "rows" and instant != "DAY" and length.months:
        lower = f"{order} - {back}"
        once = rows.where("__kind <> 1").unionByName(rows.where("__kind = 1").dropDuplicates([*by, time])) if set(keep) - {*by, time} else rows
        found = base.join(_marked(once, by, time, order, lower, plans), [*by, time])
    elif running:
        last = ("INTERVAL '1' DAY PRECEDING" if instant == "DAY" else "INTERVAL '0.000001' SECOND PRECEDING") if kind == "prior_window" else "CURRENT ROW"
        found = _running(rows, by, "__ix" if kind == "rows" else time, back, kind != "rows", last, plans)
    else:
        n = f"count(__one) OVER {frame}"
        found = rows.select(*rows.columns, F.expr(n).alias("__n"), *(F.expr(over(sql, frame)).alias(a) for a, sql in aggregates.items())).where("__kind = 1")
    found = found.select(*keep, "__n", *aggregates)
    if least > 0:
        found = found.select(*keep, "__n", *(F.when(F.col("__n") >= least, F.col(a)).alias(a) for a in aggregates))
    return found.drop(*extra)
