"""Statistics of an equity curve, of a book's trading, and of a search over many trials.

A curve is two aligned arrays: epoch seconds and equity. One curve is one number a bar, so these are numpy over small arrays;
where many curves are compared (a study) each is a group of a DataFrame and calls these inside `applyInPandas`.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb, e, floor, inf, sqrt
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NORMAL = NormalDist()
_EULER = 0.5772156649015329
MAX_LAG = 10


def returns_of(equity: np.ndarray) -> np.ndarray:
    before = equity[:-1]
    return np.where(before > 0, np.diff(equity) / np.where(before > 0, before, 1), 0.0)


def _std(x: np.ndarray) -> float:
    return float(x.std(ddof=1)) if len(x) > 1 else 0.0


def _moment(x: np.ndarray, k: int) -> float:
    return float(((x - x.mean()) ** k).mean()) if len(x) else 0.0


def skewness(x: np.ndarray) -> float:
    m2 = _moment(x, 2)
    return _moment(x, 3) / m2**1.5 if m2 > 0 else 0.0


def excess_kurtosis(x: np.ndarray) -> float:
    m2 = _moment(x, 2)
    return _moment(x, 4) / m2**2 - 3 if m2 > 0 else 0.0


def autocorrelation(x: np.ndarray, k: int) -> float:
    if k == 0:
        return 1.0
    d = x - x.mean() if len(x) else x
    total = float(d @ d)
    return float(d[k:] @ d[:-k]) / total if k < len(x) and total > 0 else 0.0


def lo_factor(x: np.ndarray, q: float) -> float:
    """Annualisation of a Sharpe ratio under autocorrelated returns."""
    lags = min(MAX_LAG, max(1, round(q)) - 1, max(0, len(x) - 2))
    d = q + 2 * sum((q - k) * autocorrelation(x, k) for k in range(1, lags + 1))
    return q / sqrt(d) if d > 0 else sqrt(q)


def newey_west_t(x: np.ndarray, lags: int | None = None) -> float:
    """t statistic of the mean with Bartlett weights."""
    n = len(x)
    if n < 2:
        return 0.0
    lag = min(floor(4 * (n / 100) ** (2 / 9)) if lags is None else lags, n - 1)
    d = x - x.mean()
    var = float(d @ d) / n + sum(2 * (1 - k / (lag + 1)) * float(d[k:] @ d[:-k]) / n for k in range(1, lag + 1))
    return float(x.mean()) / sqrt(var / n) if var > 0 else 0.0


def drawdown(equity: np.ndarray) -> tuple[float, int]:
    """Deepest fall from the running peak, and the most bars in a row below it."""
    if not len(equity):
        return 0.0, 0
    peak = np.maximum.accumulate(equity)
    under = equity < peak
    depth = float(np.max(np.where(peak > 0, 1 - equity / np.where(peak > 0, peak, 1), 0.0)))
    at = np.arange(len(equity))
    since = at - np.maximum.accumulate(np.where(under, -1, at))
    return max(0.0, depth), int(since.max())


def months_of(t: np.ndarray) -> np.ndarray:
    return np.asarray(t, "int64").astype("datetime64[s]").astype("datetime64[M]").astype(int)


def return_metrics(t: np.ndarray, equity: np.ndarray, per_year: float) -> dict[str, float]:
    t, equity = np.asarray(t), np.asarray(equity, float)
    r = returns_of(equity) if len(equity) > 1 else np.zeros(0)
    n = len(r)
    out = dict.fromkeys(("total_return", "cagr", "volatility", "sharpe", "sharpe_lo", "sharpe_se", "sharpe_period", "sortino", "max_drawdown", "cvar_5", "skew", "kurtosis", "worst_month", "t_stat", "autocorrelation_1"), 0.0) | {"n": n, "max_drawdown_duration": 0}
    if not n:
        return out
    start, end, mu, sd, year = equity[0], equity[-1], float(r.mean()), _std(r), sqrt(per_year)
    period, factor = (mu / sd if sd > 0 else 0.0), lo_factor(r, per_year)
    down = sqrt(float((np.minimum(r, 0) ** 2).mean()))
    depth, bars = drawdown(equity)
    worst = min(float(np.prod(1 + r[months_of(t[1:]) == m]) - 1) for m in np.unique(months_of(t[1:])))
    return out | {
        "total_return": float(end / start - 1) if start > 0 else 0.0,
        "cagr": float((end / start) ** (per_year / n) - 1) if start > 0 and end > 0 else -1.0,
        "volatility": sd * year,
        "sharpe_period": period,
        "sharpe": period * year,
        "sharpe_lo": period * factor,
        "sharpe_se": sqrt((1 + period**2 / 2) / n) * factor,
        "sortino": mu / down * year if down > 0 else 0.0,
        "max_drawdown": depth,
        "max_drawdown_duration": bars,
        "cvar_5": -float(np.sort(r)[: max(1, int(np.ceil(0.05 * n)))].mean()),
        "skew": skewness(r),
        "kurtosis": excess_kurtosis(r),
        "worst_month": worst,
        "t_stat": newey_west_t(r),
        "autocorrelation_1": autocorrelation(r, 1),
    }


def masked_curve(t: np.ndarray, equity: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The curve over kept bars only: a kept bar's own return joins, what happened in between does not."""
    if keep.all():
        return t, equity
    r = np.concatenate(([0.0], returns_of(equity)))[keep]
    if not len(r):
        return t[keep], equity[keep]
    r[0] = 0.0
    return t[keep], equity[keep][0] * np.cumprod(1 + r)


def metric_curve(equity: np.ndarray, base: float | None) -> np.ndarray:
    """Of a book that does not reinvest, the capital compounded by its fixed-base returns; else the curve itself."""
    return equity if base is None else np.concatenate(([base], base * np.cumprod(1 + np.diff(equity) / base)))


# significance


def probabilistic_sharpe(sr: float, benchmark: float, n: int, skew: float, kurt: float) -> float:
    """Chance that the true ratio (for each period) exceeds the benchmark; kurt is in excess of 3."""
    if n < 2:
        return 0.0
    var = 1 - skew * sr + (kurt + 2) / 4 * sr * sr
    if var <= 0:
        return float(sr > benchmark)
    return _NORMAL.cdf((sr - benchmark) * sqrt((n - 1) / var))


def min_track_record(sr: float, benchmark: float, skew: float, kurt: float, confidence: float = 0.95) -> float:
    if sr <= benchmark:
        return inf
    return 1 + max(0.0, 1 - skew * sr + (kurt + 2) / 4 * sr * sr) * (_NORMAL.inv_cdf(confidence) / (sr - benchmark)) ** 2


def expected_max_sharpe(trials: int, variance: float) -> float:
    if trials <= 1 or variance <= 0:
        return 0.0
    return sqrt(variance) * ((1 - _EULER) * _NORMAL.inv_cdf(1 - 1 / trials) + _EULER * _NORMAL.inv_cdf(1 - 1 / (trials * e)))


def deflated_sharpe(sr: float, n: int, skew: float, kurt: float, trials: int, variance: float) -> dict[str, float]:
    bar = expected_max_sharpe(max(1, trials), variance)
    return {"expected_max_sr": bar, "dsr": probabilistic_sharpe(sr, bar, n, skew, kurt), "trials": max(1, trials)}


@dataclass
class Pbo:
    pbo: float
    combinations: int
    trials: int
    partitions: int
    mean_logit: float


def pbo(returns: np.ndarray, partitions: int = 16) -> Pbo | None:
    """Probability of backtest overfitting by combinatorially symmetric cross-validation.

    returns: (periods, trials). Each half of the blocks picks its best trial; the other half ranks it. Block sums and sums of
    squares are taken once, so a combination costs a few additions.
    """
    partitions -= partitions % 2
    rows, trials = returns.shape if returns.ndim == 2 else (0, 0)
    if trials < 2 or partitions < 2 or rows < 2 * partitions:
        return None
    block = rows // partitions
    cut = returns[: block * partitions].reshape(partitions, block, trials)
    s1, s2 = cut.sum(1), (cut**2).sum(1)
    pick = np.array(list(combinations(range(partitions), partitions // 2)))
    half = np.zeros((len(pick), partitions))
    half[np.arange(len(pick))[:, None], pick] = 1
    n = block * (partitions // 2)

    def sharpe(w: np.ndarray) -> np.ndarray:
        a, b = w @ s1, w @ s2
        var = np.maximum(0.0, (b - a**2 / n) / (n - 1))
        tiny = 1e-18 * np.maximum(1e-300, b)
        return np.where(var > tiny, a / n / np.sqrt(np.where(var > tiny, var, 1)), 0.0)

    inside, outside = sharpe(half), sharpe(1 - half)
    best = inside.argmax(1)
    got = outside[np.arange(len(best)), best]
    omega = (1 + (outside < got[:, None]).sum(1)) / (trials + 1)
    logit = np.log(omega / (1 - omega))
    return Pbo(float((logit <= 0).mean()), comb(partitions, partitions // 2), trials, partitions, float(logit.mean()))


def bootstrap_sharpe(r: np.ndarray, per_year: float, block: int | None = None, reps: int = 1000, level: float = 0.95, seed: int = 1) -> tuple[float, float] | None:
    """Confidence interval of the annual ratio from circular blocks."""
    n = len(r)
    if n < 4 or reps < 1:
        return None
    block = min(n, max(1, round(n ** (1 / 3)) if block is None else block))
    starts = np.random.default_rng(seed).integers(0, n, (reps, -(-n // block)))
    draw = r[(starts[:, :, None] + np.arange(block)).reshape(reps, -1)[:, :n] % n]
    sd = draw.std(1, ddof=1)
    ratio = np.sort(np.where(sd > 0, draw.mean(1) / np.where(sd > 0, sd, 1), 0.0) * sqrt(per_year))
    at = lambda p: float(ratio[min(reps - 1, round(p * (reps - 1)))])
    return at((1 - level) / 2), at((1 + level) / 2)


# trading


def period_returns(t: np.ndarray, equity: np.ndarray, base: float | None, by_day: bool = False, calendar: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(period, return, profit) by bar or by civil day; a calendar fills days without a bar with zeros."""
    t, equity = np.asarray(t, np.int64), np.asarray(equity, float)
    profit = np.diff(equity)
    r = profit / base if base is not None else returns_of(equity)
    if not by_day:
        return t[1:], r, profit
    day = t[1:] // 86_400 * 86_400
    days, first = np.unique(day, return_index=True)
    if len(days):
        total = np.add.reduceat(r, first) if base is not None else np.multiply.reduceat(1 + r, first) - 1
        gain = np.add.reduceat(profit, first)
    else:
        total = gain = np.zeros(0)
    if calendar is None or not len(t):
        return days, total, gain
    cal = np.unique(np.asarray(calendar, np.int64))
    cal = cal[(cal >= t[0] // 86_400 * 86_400) & (cal <= t[-1] // 86_400 * 86_400)]
    at = {d: i for i, d in enumerate(days.tolist())}
    pick = [at.get(d) for d in cal.tolist()]
    return cal, np.array([0.0 if i is None else total[i] for i in pick]), np.array([0.0 if i is None else gain[i] for i in pick])


def profit_factor(x: np.ndarray) -> float:
    lost = -float(x[x <= 0].sum())
    return float(x[x > 0].sum()) / lost if lost > 0 else inf


def round_trips(fills: list[dict], multipliers: dict | None = None) -> np.ndarray:
    """Cash result of each security from flat to flat; fills in order."""
    book: dict[str, list[float]] = {}
    out = []
    for f in fills:
        pos = book.setdefault(f["equity"], [0.0, 0.0])
        pos[0] += f["quantity"]
        pos[1] -= f["quantity"] * f["price"] * (multipliers or {}).get(f["equity"], 1.0) + f["commission"] + f["fee"]
        if abs(pos[0]) < 1e-9:
            out.append(pos[1])
            del book[f["equity"]]
    return np.array(out)


def convention_metrics(r: np.ndarray, profit: np.ndarray, per_year: float, trips: np.ndarray | None = None) -> dict[str, float]:
    n, trips = len(r), np.zeros(0) if trips is None else trips
    if not n:
        return {"periods": 0}
    curve = np.cumprod(1 + r)
    peak = np.maximum(1.0, np.maximum.accumulate(curve))
    added = np.cumsum(r)
    mu, pop, sd, year = float(r.mean()), float(r.std()), _std(r), sqrt(per_year)
    return {
        "periods": n,
        "periods_per_year": per_year,
        "cagr": float(curve[-1] ** (per_year / n) - 1) if curve[-1] > 0 else -1.0,
        "max_drawdown": float(np.max(1 - curve / peak)),
        "sharpe": mu / sd * year if sd > 0 else 0.0,
        "sharpe_population": mu / pop * year if pop > 0 else 0.0,
        "volatility_population": pop * year,
        "annual_return": mu * per_year,
        "max_drawdown_additive": float(np.max(np.maximum(0.0, np.maximum.accumulate(added)) - added)),
        "total_pnl": float(profit.sum()),
        "profit_factor": profit_factor(profit),
        "trades": len(trips),
        "profit_factor_trades": profit_factor(trips),
        "win_rate": float((trips > 0).mean()) if len(trips) else 0.0,
    }


def trading_metrics(equity: np.ndarray, gross: np.ndarray, net: np.ndarray, summary: dict, per_year: float, counts: dict | None = None) -> dict[str, float]:
    """Turnover, exposure and what costs take, from the run's exposure and its summary."""
    mean = float(np.mean(equity)) if len(equity) else 0.0
    years = max((len(equity) - 1) / per_year, 1 / per_year)
    rate = lambda x: x / mean / years if mean > 0 else 0.0
    ok = equity > 0
    costs = sum(summary[k] for k in ("commissions", "fees", "slippage", "impact", "margin_interest", "borrow_fees")) - summary["cash_interest"] - summary["short_rebate"]
    return {
        "turnover": rate(summary["turnover"]),
        "cost_drag": rate(costs),
        "impact_drag": rate(summary["impact"]),
        "avg_gross": float((gross[ok] / equity[ok]).mean()) if ok.any() else 0.0,
        "avg_net": float((net[ok] / equity[ok]).mean()) if ok.any() else 0.0,
        "max_leverage": float((gross[ok] / equity[ok]).max()) if ok.any() else 0.0,
        **{k: summary[k] for k in ("fill_ratio", "avg_participation", "max_participation")},
        **(counts or {}),
    }


def capacity(start: float, impact_drag: float, threshold: float) -> float | None:
    """Capital at which impact would take the threshold a year, its share growing with the root of size."""
    return start * (threshold / impact_drag) ** 2 if impact_drag > 0 and threshold > 0 else None


def subperiod_sharpes(t: np.ndarray, equity: np.ndarray, per_year: float, least: int = 20) -> list[tuple[int, float]]:
    """(calendar year, ratio); a year's first return starts from the last bar of the year before."""
    year = np.asarray(t, "int64").astype("datetime64[s]").astype("datetime64[Y]").astype(int) + 1970
    out = []
    for y in np.unique(year):
        at = np.flatnonzero(year == y)
        at = np.concatenate(([at[0] - 1], at)) if at[0] > 0 else at
        if len(at) > least:
            out.append((int(y), return_metrics(np.asarray(t)[at], np.asarray(equity)[at], per_year)["sharpe"]))
    return out


# on DataFrames


def drawdowns(nav: DataFrame, by: str, time: str, equity: str) -> DataFrame:
    """nav with peak and drawdown columns: a running maximum for each curve."""
    peak = f"max(`{equity}`) OVER (PARTITION BY `{by}` ORDER BY `{time}`)"
    return nav.withColumn("peak", F.expr(peak)).withColumn("drawdown", 1 - F.col(equity) / F.col("peak"))


def curve_metrics(nav: DataFrame, by: str, time: str, equity: str, per_year: float) -> DataFrame:
    """return_metrics of every curve of a table, one group each."""
    names = sorted(return_metrics(np.array([0, 86_400]), np.array([1.0, 1.1]), per_year))
    schema = f"`{by}` string, " + ", ".join(f"{n} double" for n in names)

    def one(pdf):
        import pandas as pd

        pdf = pdf.sort_values("t")
        m = return_metrics(pdf["t"].to_numpy(), pdf["e"].to_numpy(), per_year)
        return pd.DataFrame([[pdf["k"].iloc[0], *(float(m[n]) for n in names)]], columns=[by, *names])

    rows = nav.select(F.col(by).cast("string").alias("k"), F.unix_seconds(F.col(time).cast("timestamp")).alias("t"), F.col(equity).cast("double").alias("e"))
    return rows.groupBy("k").applyInPandas(one, schema)



def each_curve(nav: DataFrame, by: str, time: str, equity: str, measure, schema: str) -> DataFrame:
    """measure(seconds, equity) -> rows, of every curve of a table; rows are tuples of the schema."""
    names = [c.split()[0] for c in schema.split(", ")]

    def one(pdf):
        import pandas as pd

        pdf = pdf.sort_values("t")
        found = [(pdf["k"].iloc[0], *r) for r in measure(pdf["t"].to_numpy(), pdf["e"].to_numpy())]
        return pd.DataFrame(found, columns=[by, *names])

    rows = nav.select(F.col(by).cast("string").alias("k"), F.unix_seconds(F.col(time).cast("timestamp")).alias("t"), F.col(equity).cast("double").alias("e"))
    return rows.groupBy("k").applyInPandas(one, f"`{by}` string, {schema}")


def returns_table(nav: DataFrame, by: str, time: str, equity: str, base: float | None = None, by_day: bool = False) -> DataFrame:
    """(by, t, r, profit): the period returns of every curve."""
    made = each_curve(nav, by, time, equity, lambda t, e: list(zip(*(x.tolist() for x in period_returns(t, e, base, by_day)), strict=True)), "t long, r double, profit double")
    return made.withColumn("t", F.timestamp_seconds("t").cast("timestamp_ntz"))


def write_returns(nav: DataFrame, path: str, by: str = "run_id", time: str = "t", equity: str = "equity_value", base: float | None = None, by_day: bool = False) -> None:
    """The period-returns file of runs."""
    returns_table(nav, by, time, equity, base, by_day).write.mode("overwrite").parquet(path)
