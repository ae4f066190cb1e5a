"""Parameter studies: grids, holdouts, walk-forward, the parameter surface, trial logs and the bias report.

All points of a grid are runs of one grouped operator, so a study is as parallel as its points. Curves come back as rows;
only what a report needs (a few numbers for each point) reaches the driver.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from itertools import product
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruletide.dsl.ast import Duration
from ruletide.engine import value
from ruletide.loop.config import ExecConfig
from ruletide.loop.run import Point, run
from ruletide.plans.program import Program, link
from ruletide.study import metrics as mt

OBJECTIVES = ("sharpe", "sharpe_lo", "sortino", "cagr", "total_return", "volatility", "max_drawdown", "cvar_5", "t_stat", "skew", "kurtosis", "worst_month")
_LOWER_IS_BETTER = {"volatility", "max_drawdown", "cvar_5"}


def parse_axis(text: str) -> tuple[str, list]:
    """`name=a,b,c` or `name=lo..hi/step` of numbers."""
    name, _, spec = text.partition("=")
    if ".." in spec:
        span, _, step = spec.partition("/")
        lo, hi = map(float, span.split(".."))
        step = float(step or 1)
        values = [lo + i * step for i in range(int(round((hi - lo) / step)) + 1)]
        return name.strip(), [int(v) if v == int(v) else v for v in values]

    def one(x: str):
        v = value(x.strip())
        if isinstance(v, Duration):
            return v
        try:
            return int(v)
        except ValueError:
            return float(v)

    return name.strip(), [one(x) for x in spec.split(",")]


def grid(axes: dict[str, list]) -> list[dict]:
    return [dict(zip(axes, p, strict=True)) for p in product(*axes.values())]


# time


def add_months(t: int, n: int) -> int:
    d = datetime.fromtimestamp(t, timezone.utc)
    y, m = divmod(d.year * 12 + d.month - 1 + n, 12)
    return int(datetime(y, m + 1, 1, tzinfo=timezone.utc).timestamp())


@dataclass(frozen=True)
class Embargo:
    """Spans [from, to) that a study may not see; `truncates` if nothing after them may be seen either."""

    spans: tuple[tuple[int, int], ...] = ()
    truncates: bool = False

    def keep(self, t: np.ndarray) -> np.ndarray:
        out = np.ones(len(t), bool)
        for lo, hi in self.spans:
            out &= ~((t >= lo) & (t < hi))
        return out


def holdout(spec: str, first: int, last: int) -> Embargo:
    """`none`, `trailing:2y`, or `blocks:K:Nmo[:seed]`."""
    kind, *rest = spec.split(":")
    if kind == "none":
        return Embargo()
    if kind == "trailing":
        return Embargo(((add_months(last, -months(rest[0])), 1 << 62),), True)
    if kind != "blocks":
        raise ValueError(f"unknown holdout `{spec}`")
    count, length, seed = int(rest[0]), months(rest[1]), int(rest[2]) if len(rest) > 2 else 1
    starts, s = [], add_months(first, 0)
    while add_months(s, length) <= last:
        starts.append(s)
        s = add_months(s, 1)
    chosen: list[tuple[int, int]] = []
    for i in np.random.default_rng(seed).permutation(len(starts)).tolist():
        a, b = starts[i], add_months(starts[i], length)
        if len(chosen) < count and all(b <= x or y <= a for x, y in chosen):
            chosen.append((a, b))
    return Embargo(tuple(sorted(chosen)))


def months(text: str) -> int:
    return 12 * int(text[:-1]) if text.endswith("y") else int(text.removesuffix("mo"))


@dataclass(frozen=True)
class WalkForward:
    anchored: bool
    train: int
    test: int

    @classmethod
    def parse(cls, text: str) -> WalkForward:
        how, train, test = text.split(":")
        if how not in ("anchored", "rolling") or not months(train) or not months(test):
            raise ValueError(f"`{text}` is not a walk-forward scheme (anchored:2y:6mo or rolling:2y:6mo)")
        return cls(how == "anchored", months(train), months(test))

    def folds(self, first: int, last: int) -> list[tuple[int, int, int]]:
        """(train from, test from, test to) of every fold."""
        start, out, k = add_months(first, 0), [], 0
        while (at := add_months(start, self.train + k * self.test)) <= last:
            out.append((start if self.anchored else add_months(at, -self.train), at, add_months(at, self.test)))
            k += 1
        return out


# evaluation


def objective(m: dict, name: str) -> float:
    if name not in OBJECTIVES:
        raise ValueError(f"unknown objective `{name}`; one of {', '.join(OBJECTIVES)}")
    return -m[name] if name in _LOWER_IS_BETTER else m[name]


def surface(shape: list[int], values: np.ndarray, best: int) -> dict | None:
    """How smooth the objective is over the grid, and the share of the best point's neighbours that are near it."""
    if len(values) < 2 or int(np.prod(shape)) != len(values):
        return None
    v = np.asarray(values, float).reshape(shape)
    diffs = np.concatenate([np.abs(np.diff(v, axis=a)).ravel() for a in range(v.ndim)])
    diffs = diffs[np.isfinite(diffs)]
    at, around = np.unravel_index(best, shape), []
    for a in range(v.ndim):
        for d in (-1, 1):
            if 0 <= at[a] + d < shape[a]:
                around.append(v[tuple(x + d * (i == a) for i, x in enumerate(at))])
    around = [x for x in around if np.isfinite(x)]
    if not len(diffs) or not around:
        return None
    top = float(v[at])
    tolerance = 0.1 * max(1.0, abs(top))
    span = float(np.nanmax(v) - np.nanmin(v))
    return {"smoothness": float(diffs.mean()) / span if span > 0 else 0.0, "stability": sum(abs(x - top) <= tolerance for x in around) / len(around), "neighbours": len(around), "tolerance": tolerance}


@dataclass
class Study:
    """A study of one strategy: declare it, run the grid, reveal the holdout once."""

    text: str | Program
    axes: dict[str, list]
    target: str = "sharpe"
    per_year: float = 252.0
    holdout: str = "none"
    walk: WalkForward | None = None
    config: ExecConfig = field(default_factory=ExecConfig)
    log: str | None = None

    def curves(self, spark: SparkSession, facts: dict[str, DataFrame], until: int | None = None) -> DataFrame:
        """(run_id, t, equity) of every grid point."""
        program = link(self.text) if isinstance(self.text, str) else self.text
        cfg = replace(self.config, end=until) if until is not None else self.config
        points = [Point(f"{i:06d}", p, cfg) for i, p in enumerate(grid(self.axes))]
        return run(spark, program, facts, points).table("nav").select("run_id", F.unix_seconds(F.col("t").cast("timestamp")).alias("t"), F.col("equity_value").alias("equity"))

    def run(self, spark: SparkSession, facts: dict[str, DataFrame]) -> dict:
        points = grid(self.axes)
        rows = self.curves(spark, facts).orderBy("run_id", "t").toPandas()  # one number a bar and point
        base = None if self.config.compounding else self.config.initial_cash
        found = {int(k): (g["t"].to_numpy(), mt.metric_curve(g["equity"].to_numpy(), base)) for k, g in rows.groupby("run_id")}
        if not found:
            raise ValueError("no run produced a curve")
        first, last = int(rows["t"].min()), int(rows["t"].max())
        hidden = holdout(self.holdout, first, last)
        seen = {}
        for i, (t, e) in found.items():
            keep = hidden.keep(t)
            seen[i] = mt.masked_curve(t, e, keep)
        ms = {i: mt.return_metrics(t, e, self.per_year) for i, (t, e) in seen.items()}
        score = np.array([objective(ms[i], self.target) if i in ms else np.nan for i in range(len(points))])
        best = int(np.nanargmax(score))
        t, e = seen[best]
        lengths = {len(c[0]) for c in seen.values()}
        table = np.stack([mt.returns_of(c[1]) for c in seen.values()], 1) if len(lengths) == 1 else np.zeros((0, 0))
        overfit = mt.pbo(table, 16) or mt.pbo(table, 8)
        trial_sr = np.array([m["sharpe_period"] for m in ms.values()])
        b = ms[best]
        out = {
            "trials": len(points),
            "best": best,
            "params": {k: str(v) for k, v in points[best].items()},
            "metrics": b,
            "pbo": vars(overfit) if overfit else None,
            "dsr": mt.deflated_sharpe(b["sharpe_period"], b["n"], b["skew"], b["kurtosis"], len(points), float(trial_sr.var(ddof=1)) if len(trial_sr) > 1 else 0.0),
            "min_track_record": mt.min_track_record(b["sharpe_period"], 0.0, b["skew"], b["kurtosis"]),
            "bootstrap": mt.bootstrap_sharpe(mt.returns_of(e), self.per_year),
            "surface": surface([len(v) for v in self.axes.values()], score, best),
            "subperiods": mt.subperiod_sharpes(t, e, self.per_year),
            "walk_forward": self.walk_forward(seen, first, last) if self.walk else None,
            "embargo": list(hidden.spans),
        }
        out["report"] = report(out)
        if self.log:
            append(self.log, {"kind": "study", "program": fingerprint(self.text), **{k: out[k] for k in ("trials", "best", "params", "metrics")}})
        return out

    def walk_forward(self, curves: dict, first: int, last: int) -> dict:
        """Each fold picks by its training span; the test spans are stitched into one out-of-sample curve."""
        folds, t_all, r_all, inside = [], [], [], []
        for lo, at, hi in self.walk.folds(first, last):
            scores = {}
            for i, (t, e) in curves.items():
                k = (t >= lo) & (t < at)
                if k.sum() > 2:
                    scores[i] = objective(mt.return_metrics(t[k], e[k], self.per_year), self.target)
            if not scores:
                continue
            pick = max(scores, key=lambda i: (scores[i], -i))
            t, e = curves[pick]
            r = np.concatenate(([0.0], mt.returns_of(e)))
            k = (t >= at) & (t < hi)
            folds.append({"train_from": lo, "test_from": at, "test_to": hi, "pick": pick, "train": scores[pick]})
            inside.append(scores[pick])
            t_all.append(t[k])
            r_all.append(r[k])
        if not folds:
            return {"folds": [], "metrics": None, "efficiency": None}
        t, r = np.concatenate(t_all), np.concatenate(r_all)
        m = mt.return_metrics(np.concatenate(([t[0] - 1], t)), np.concatenate(([1.0], np.cumprod(1 + r))), self.per_year) if len(t) else None
        mean = float(np.mean(inside))
        return {"folds": folds, "metrics": m, "efficiency": objective(m, self.target) / mean if m and mean > 0 else None}

    def reveal(self, spark: SparkSession, facts: dict[str, DataFrame], point: int, thresholds: dict[str, float] | None = None) -> dict:
        """The held-out spans of one point, with the return of each bar in them, and which thresholds it meets."""
        only = replace(self, axes={k: [v] for k, v in grid(self.axes)[point].items()})
        rows = only.curves(spark, facts).orderBy("t").toPandas()
        t, e = rows["t"].to_numpy(), rows["equity"].to_numpy()
        hidden = holdout(self.holdout, int(t[0]), int(t[-1]))
        m = mt.return_metrics(*mt.masked_curve(t, e, ~hidden.keep(t)), self.per_year)
        return {"metrics": m, "passed": {k: m[k] >= v for k, v in (thresholds or {}).items()}}


# lineage and logs


def fingerprint(text: str | Program) -> str:
    """A hash of the program's rules that does not change with comments, spacing or order."""
    p = link(text) if isinstance(text, str) else text
    return hashlib.sha256("\n".join(sorted(rule_texts(p))).encode()).hexdigest()[:16]


def _plain(x) -> str:
    """A syntax tree as text, without where it stood in the source."""
    if hasattr(x, "__dataclass_fields__"):
        return f"{type(x).__name__}({','.join(_plain(getattr(x, f)) for f in x.__dataclass_fields__ if f != 'at')})"
    return f"[{','.join(map(_plain, x))}]" if isinstance(x, tuple) else repr(x)


def rule_texts(p: Program) -> set[str]:
    return {_plain(r) for rel in p.relations.values() for r in rel.rules}


def similarity(a: Program, b: Program) -> float:
    """Jaccard index of two programs' rules; 0.8 and more is one lineage."""
    x, y = rule_texts(a), rule_texts(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def append(path: str, record: dict, spark: SparkSession | None = None) -> None:
    """Add a record to a log: a file of the driver, or with a session a folder on storage that all runs share."""
    line = json.dumps({"at": datetime.now(timezone.utc).isoformat(), **record}, default=str)
    if spark is not None:
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(path)
        return
    with Path(path).open("a") as f:
        f.write(line + "\n")


def read_log(path: str, spark: SparkSession | None = None) -> list[dict]:
    """The records of a log in the order in which they were added."""
    if spark is not None:
        return sorted((json.loads(r["value"]) for r in spark.read.text(path).toLocalIterator()), key=lambda r: r["at"])
    return [json.loads(x) for x in Path(path).read_text().splitlines() if x] if Path(path).exists() else []


def trial_variance(path: str, program: str) -> tuple[int, float]:
    """Trials logged for a program, and the variance of their ratios."""
    sr = [r["metrics"]["sharpe_period"] for r in read_log(path) if r.get("program") == program]
    return len(sr), float(np.var(sr, ddof=1)) if len(sr) > 1 else 0.0


#: The audited biases by group.
BIASES = {
    "data": ("look-ahead", "point-in-time", "historical revision", "corporate-action", "survivorship", "universe leakage", "feature leakage", "label leakage", "delisting", "selection", "regime"),
    "execution": ("transaction-cost neglect", "slippage", "market-impact", "liquidity", "bid-ask spread", "execution timing", "bar-resolution", "partial-fill", "latency", "rebalancing", "cash-management", "leverage", "funding-cost neglect", "shorting", "borrow-availability", "currency", "portfolio-construction"),
    "statistics": ("data-snooping", "multiple-testing", "p-hacking", "false statistical significance", "overfitting", "parameter over-optimization", "out-of-sample", "walk-forward", "autocorrelation", "non-stationarity", "short-sample", "tail-risk neglect"),
}
_BY_DESIGN = {"look-ahead", "point-in-time", "feature leakage", "label leakage", "universe leakage", "execution timing", "partial-fill", "cash-management", "portfolio-construction"}


def report(study: dict, warnings: list[tuple[str, str]] = ()) -> list[tuple[str, str, str]]:
    """(group, bias, status): forty rows, with the study's own figures where it has some."""
    m, said = study["metrics"], dict(warnings)
    own = {
        "multiple-testing": f"{study['trials']} trials; deflated ratio {study['dsr']['dsr']:.3f}",
        "data-snooping": f"best of {study['trials']} points",
        "overfitting": f"probability {study['pbo']['pbo']:.2f}" if study["pbo"] else "not measured: too few periods or trials",
        "parameter over-optimization": f"stability {study['surface']['stability']:.2f}" if study["surface"] else "not measured: one point",
        "out-of-sample": "holdout kept" if study["embargo"] else "no holdout",
        "walk-forward": "run" if study["walk_forward"] else "not run",
        "autocorrelation": f"first lag {m['autocorrelation_1']:.3f}; adjusted ratio {m['sharpe_lo']:.3f}",
        "false statistical significance": f"t {m['t_stat']:.2f}",
        "short-sample": f"{m['n']} periods; needs {study['min_track_record']:.0f}",
        "tail-risk neglect": f"worst twentieth {m['cvar_5']:.4f}, skew {m['skew']:.2f}",
        "non-stationarity": f"{len(study['subperiods'])} sub-periods",
    }
    return [(g, b, said.get(b) or own.get(b) or ("checked by the language and the run" if b in _BY_DESIGN else "not assessed")) for g, names in BIASES.items() for b in names]
