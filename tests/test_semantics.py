"""Compiled relations against the tuple-at-a-time interpreter, over a small market with gaps."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest

from ruletide.dsl.ast import RESOLUTIONS
from ruletide.engine import Engine, value
from ruletide.loop.kernel import Kernel
from ruletide.plans.compiler import CompileError
from ruletide.plans.library import library
from ruletide.plans.program import link

ENV = """environment e { close(+A: Equity, @T: Timestamp, -P: Price<USD>) @1d  volume(+A: Equity, @T: Timestamp, -V: Quantity<Shares>) @1d
 universe(-A: Equity, @T: Timestamp) @1d complete  split(+A: Equity, @T: Timestamp, -F: Scalar) @1d complete
 dividend(+A: Equity, @T: Timestamp, -Ex: Timestamp, -D: Price<USD>) @1d complete  rating(+A: Equity, @T: Timestamp, -R: Scalar, -L: Label) @1d
 index(@T: Timestamp, -X: Scalar) @1d  tick(+A: Equity, @T: Timestamp, -Q: Price<USD>) @1m }"""


def seconds(d):
    if isinstance(d, dt.datetime):
        return int(d.replace(tzinfo=dt.timezone.utc).timestamp())
    if isinstance(d, dt.date):
        return int(dt.datetime(d.year, d.month, d.day, tzinfo=dt.timezone.utc).timestamp())
    return d


@pytest.fixture(scope="module")
def market():
    rng = random.Random(3)
    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(75) if (dt.date(2024, 1, 1) + dt.timedelta(i)).weekday() < 5]
    rows = {k: [] for k in ("close", "volume", "universe", "split", "dividend", "rating", "index", "tick")}
    for a in "ABCD":
        for d in days:
            if rng.random() < 0.85:
                rows["close"].append((a, d, float(rng.randint(80, 120))))
            if rng.random() < 0.9:
                rows["volume"].append((a, d, float(rng.randint(1, 9) * 100)))
            if rng.random() < 0.8:
                rows["universe"].append((a, d))
            if rng.random() < 0.06:
                rows["split"].append((a, d, rng.choice([0.5, 2.0])))
            if rng.random() < 0.05:
                rows["dividend"].append((a, d, d + dt.timedelta(rng.choice([1, 7, 20])), 1.5))
            if rng.random() < 0.08:
                for _ in range(rng.randint(1, 2)):
                    rows["rating"].append((a, d, float(rng.randint(1, 5)), rng.choice(["x", "y"])))
    for d in days:
        rows["index"].append((d, rng.uniform(90, 110)))
    for d in days[:6]:
        for m in range(0, 300, 7):
            if rng.random() < 0.7:
                rows["tick"].append((rng.choice("AB"), dt.datetime(d.year, d.month, d.day, 9, 31) + dt.timedelta(minutes=m), float(rng.randint(90, 110))))
    rows["rating"] = list(dict.fromkeys(rows["rating"]))
    rows["tick"] = list({r[:2]: r for r in rows["tick"]}.values())
    return rows


TYPES = {"Equity": "string", "Label": "string"}


@pytest.fixture(scope="module")
def facts(spark, market):
    out = {}
    for s in link(ENV + "library l { env e resolution @1d }").env.signatures:
        kinds = [f"{a.name} {TYPES.get(a.type) or (('date' if s.res == '1d' else 'timestamp_ntz') if a.type == 'Timestamp' else 'double')}" for a in s.args]
        out[s.name] = spark.createDataFrame(market[s.name], ", ".join(kinds)).cache()
    return out


def interpreted(text, market, name, inputs):
    p = link(text)
    k = Kernel(p, {})
    k.closed = {n for n, r in p.relations.items() if r.kind != "primitive"}
    domains = {r: set() for r in RESOLUTIONS}
    for s in p.env.signatures:
        for row in market[s.name]:
            tup = tuple(seconds(x) for x in row)
            k.store(s.name).add(tup)
            t = tup[s.key]
            for r, n in RESOLUTIONS.items():
                if r == s.res:
                    domains[r].add(t)
                elif RESOLUTIONS[s.res] < n:
                    domains[r].add(t // 86400 * 86400 if r == "1d" else -(-t // n) * n)
    k.domains = {r: sorted(v) for r, v in domains.items()}
    sig = p.relations[name].sig
    out = set()
    for t in k.domains[sig.res]:
        for a in [*"ABCD"] if any(x.type == "Equity" and x.mode == "+" for x in sig.args) else [None]:
            pattern = [t if x.mode == "@" else value(inputs[x.name]) if x.name in inputs else a if x.type == "Equity" and x.mode == "+" else None for x in sig.args]
            out |= {tuple(v for v, x in zip(tup, sig.args) if x.name not in inputs) for tup in k.tuples(name, pattern)}
    return out


def rounded(rows):
    return sorted(tuple(round(float(v), 7) if isinstance(v, float) or (isinstance(v, int) and abs(v) < 1e6) else v for v in r) for r in rows)


S = "rel r(-A: Equity, @T: Timestamp, -X: Scalar) "
CASES = {
    "window over gaps": S + "r(A, T, X) :- universe(A, T), X = mean(P / 1 USD/share) over (U in window(T, 10d, min 4), close(A, U, P)).",
    "months": S + "r(A, T, X) :- universe(A, T), X = std(P / 1 USD/share) over (U in window(T, 1mo, min 2), close(A, U, P)).",
    "prior window": S + "r(A, T, X) :- universe(A, T), X = max(P / 1 USD/share) over (U in prior_window(T, 2w, min 2), close(A, U, P)).",
    "prior months": S + "r(A, T, X) :- universe(A, T), X = sum(P / 1 USD/share) over (U in prior_window(T, 1mo, min 2), close(A, U, P)).",
    "window after its atom": S + "r(A, T, X) :- universe(A, T), X = min(P / 1 USD/share) over (close(A, U, P), U in window(T, 10d, min 1)).",
    "two atoms": S + "r(A, T, X) :- universe(A, T), X = sum(P * V / 1 USD) over (U in window(T, 10d, min 3), close(A, U, P), volume(A, U, V)).",
    "filter inside": S + "r(A, T, X) :- universe(A, T), X = sum(P / 1 USD/share) over (U in window(T, 20d, min 2), close(A, U, P), P > 100 USD/share).",
    "rows": S + "r(A, T, X) :- universe(A, T), X = mean(P / 1 USD/share) over (U in rows(T, 5, min 3), close(A, U, P)).",
    "rows with a rare second atom": S + "r(A, T, X) :- universe(A, T), X = sum(F) over (U in rows(T, 8, min 1), close(A, U, _), split(A, U, F)).",
    "rows over several ratings": S + "r(A, T, X) :- universe(A, T), X = sum(R) over (U in rows(T, 2, min 1), rating(A, U, R, _)).",
    "rows regression": S + "r(A, T, X) :- universe(A, T), X = ols_beta(P / 1 USD/share, V / 1 shares) over (U in rows(T, 6, min 4), close(A, U, P), volume(A, U, V)).",
    "count with a minimum": "rel r(-A: Equity, @T: Timestamp, -N: Count) r(A, T, N) :- universe(A, T), N = count(U) over (U in window(T, 7d, min 2), close(A, U, _)).",
    "count of none": "rel r(-A: Equity, @T: Timestamp, -N: Count) r(A, T, N) :- universe(A, T), N = count(R) over (rating(A, T, R, _)).",
    "cross-section": "rel r(@T: Timestamp, -X: Scalar, -Y: Scalar, -N: Count) r(T, X, Y, N) :- N = count(A) over (close(A, T, _)), X = median(P / 1 USD/share) over (close(_, T, P)), Y = quantile(P / 1 USD/share, 0.3) over (close(_, T, P)).",
    "bag of matches": "rel r(-A: Equity, @T: Timestamp, -X: Scalar) r(A, T, X) :- universe(A, T), X = sum(R) over (rating(A, T, R, _), volume(A, T, _)).",
    "market window": "rel r(@T: Timestamp, -X: Scalar) r(T, X) :- index(T, _), X = mean(Y) over (U in rows(T, 7, min 7), index(U, Y)).",
    "market window by time": "rel r(@T: Timestamp, -X: Scalar) r(T, X) :- index(T, _), X = max(Y) over (U in window(T, 2w, min 3), index(U, Y)).",
    "reads the base bar": S + "r(A, T, X) :- universe(A, T), X = sum(D / 1 USD/share) over (U in window(T, 1mo, min 1), dividend(A, U, Ex, D), Ex = T).",
    "prev and lag": S + "r(A, T, X) :- close(A, T, P), universe(A, T), prev(T, U), close(A, U, Q), lag(T, 1w, V), close(A, V, R), X = P / Q - R / Q.",
    "month start": "rel r(-A: Equity, @T: Timestamp) r(A, T) :- universe(A, T), month_start(T).",
    "no lag": "rel r(-A: Equity, @T: Timestamp) r(A, T) :- universe(A, T), lag(T, 1mo, _).",
    "asof": "rel r(-A: Equity, @T: Timestamp, -U: Timestamp, -X: Scalar) r(A, T, U, X) :- universe(A, T), rating(A, U, X, _) asof T.",
    "asof with a bound label": S + 'r(A, T, X) :- universe(A, T), rating(A, _, X, "x") asof T.',
    "asof strictly before": S + "r(A, T, X) :- universe(A, T), prev(T, U), rating(A, _, X, _) asof U.",
    "asof market": S + "r(A, T, X) :- universe(A, T), index(_, X) asof T.",
    "asof derived": "rel d(-A: Equity, @T: Timestamp, -X: Scalar) d(A, T, X) :- universe(A, T), rating(A, T, X, _), X > 2. rel r(-A: Equity, @T: Timestamp, -X: Scalar) r(A, T, X) :- universe(A, T), d(A, _, X) asof T.",
    "not asof": "rel r(-A: Equity, @T: Timestamp) r(A, T) :- universe(A, T), not rating(A, _, _, _) asof T.",
    "negation": "rel r(-A: Equity, @T: Timestamp) r(A, T) :- universe(A, T), not split(A, T, _), not close(A, T, 100 USD/share).",
    "union of rules": S + "r(A, T, 1) :- split(A, T, _), universe(A, T). r(A, T, X) :- rating(A, T, X, _), universe(A, T). r(A, T, 1) :- universe(A, T), volume(A, T, V), V > 700 shares.",
    "repeated variable": S + "rel d(-A: Equity, @T: Timestamp, -X: Scalar, -Y: Scalar) d(A, T, X, Y) :- rating(A, T, X, _), universe(A, T), Y = 3. r(A, T, X) :- d(A, T, X, X).",
    "pairs": "rel r(-A: Equity, -B: Equity, @T: Timestamp) r(A, B, T) :- universe(A, T), close(A, T, P), universe(B, T), close(B, T, Q), P > Q.",
    "top": S + "rel c(-A: Equity, @T: Timestamp, -P: Scalar) c(A, T, P) :- universe(A, T), volume(A, T, V), P = V / 100 shares. r(A, T, X) :- top(2, c(A, T, X), by (X desc, A asc)).",
    "rank": S + "rel c(-A: Equity, @T: Timestamp, -P: Scalar) c(A, T, P) :- universe(A, T), volume(A, T, V), P = V / 100 shares. r(A, T, X) :- rank(c(A, T, P), by (P asc), as X).",
    "rank of ties": S + "rel c(-A: Equity, @T: Timestamp, -P: Scalar) c(A, T, P) :- universe(A, T), volume(A, T, V), P = V / 100 shares. r(A, T, X) :- rank(c(A, T, P), by (P desc), ties average, as X).",
    "partial arithmetic": S + "r(A, T, X) :- universe(A, T), close(A, T, P), Y = P / 1 USD/share - 100, X = log(Y) + 1 / (Y - 5) + sqrt(Y - 1).",
    "functions": S + "r(A, T, X) :- universe(A, T), close(A, T, P), Y = P / 10 USD/share, X = greatest(least(exp(-Y), 3), abs(-Y), 2).",
    "product carry": S + "rel b(+A: Equity, @T: Timestamp) b(A, T) :- universe(A, T), prev(T, U), universe(A, U). rel f(+A: Equity, @T: Timestamp, -F: Scalar) f(A, T, F) :- universe(A, T), split(A, T, F). f(A, T, 1) :- universe(A, T), not split(A, T, _). rel c(+A: Equity, @T: Timestamp, -C: Scalar) c(A, T, C) :- universe(A, T), not b(A, T), f(A, T, C). c(A, T, C) :- b(A, T), prev(T, U), c(A, U, D), f(A, T, F), C = D * F. r(A, T, X) :- c(A, T, X).",
    "sum carry bridging gaps": S + "rel b(+A: Equity, @T: Timestamp) b(A, T) :- universe(A, T), prev(T, U), universe(A, _) asof U. rel c(+A: Equity, @T: Timestamp, -C: Scalar) c(A, T, 0) :- universe(A, T), not b(A, T). c(A, T, C) :- b(A, T), prev(T, U), c(A, _, D) asof U, C = D + 1. r(A, T, X) :- c(A, T, X).",
    "carry with broken chains": S + "rel c(+A: Equity, @T: Timestamp, -C: Scalar) c(A, T, 5) :- universe(A, T), split(A, T, _). c(A, T, C) :- universe(A, T), not split(A, T, _), prev(T, U), c(A, U, D), C = D + 1. r(A, T, X) :- c(A, T, X).",
    "scanned recursion": S + "rel c(+A: Equity, @T: Timestamp, -C: Scalar) c(A, T, 1) :- universe(A, T), split(A, T, _). c(A, T, C) :- universe(A, T), not split(A, T, _), prev(T, U), c(A, _, D) asof U, volume(A, T, V), C = D * 0.9 + V / 1000 shares, C < 3. r(A, T, X) :- c(A, T, X).",
    "recursion over the market": "rel r(@T: Timestamp, -X: Scalar) r(T, X) :- index(T, X), month_start(T). r(T, X) :- index(T, Y), prev(T, U), r(U, Z), X = Z * 0.5 + Y * 0.5, Y > 0.",
    "latch": S + "rel c(+A: Equity, @T: Timestamp, -L: Scalar) c(A, T, 1) :- universe(A, T), split(A, T, _). c(A, T, L) :- universe(A, T), not split(A, T, _), prev(T, U), c(A, _, L) asof U. r(A, T, X) :- c(A, T, X).",
    "resample": "rel r(-A: Equity, @T: Timestamp, -O: Price<USD>, -C: Price<USD>, -N: Count) r(A, T, O, C, N) :- resample(tick(A, U, Q) to @1d as T, min 3, O = first(Q), C = last(Q), N = count(Q)).",
}


@pytest.mark.parametrize("name", CASES)
def test_compiled_equals_interpreted(spark, market, facts, name):
    text = ENV + f"library l {{ env e resolution @1d {CASES[name]} }}"
    want = rounded(interpreted(text, market, "r", {}))
    got = rounded(tuple(seconds(v) for v in row) for row in Engine(spark, text, facts).relation("r").collect())
    assert want, "the case derives nothing"
    assert got == want


def test_minute_rules_read_daily_bars_once_their_day_is_over(spark, market, facts):
    text = ENV + "library l { env e resolution @1m rel r(-A: Equity, @T: Timestamp, -D: Timestamp, -P: Price<USD>) r(A, T, D, P) :- tick(A, T, _), close(A, D, P) asof T. }"
    want = rounded(interpreted(text, market, "r", {}))
    got = rounded(tuple(seconds(v) for v in row) for row in Engine(spark, text, facts).relation("r").collect())
    assert want and got == want
    assert all(d + 86400 <= t for _, t, d, _ in want)


def test_libraries_with_inputs(spark, market, facts):
    text = ENV + library("features", "e")
    for name, inputs in (("sma", {"N": "10d", "K": 3}), ("realized_vol", {"N": "20d", "K": 3}), ("momentum", {"Lookback": "1mo", "Skip": "1w"}), ("highest", {"N": "2w", "K": 2})):
        want = rounded(interpreted(text, market, name, inputs))
        got = rounded(tuple(seconds(v) for v in row) for row in Engine(spark, text, facts).relation(name, **inputs).collect())
        assert want and got == want


def test_strict_mode_halts(spark, facts):
    text = ENV + "library l { env e resolution @1d rel r(-A: Equity, @T: Timestamp, -X: Scalar) r(A, T, X) :- close(A, T, P), X = 1 / (P / 1 USD/share - 100). }"
    assert Engine(spark, text, facts).relation("r").count() > 0
    with pytest.raises(Exception, match="division by zero"):
        Engine(spark, text, facts, strict=True).relation("r").collect()


def test_unranged_inputs_are_refused(spark, facts):
    text = ENV + "library l { env e resolution @1d rel r(+A: Equity, @T: Timestamp, +N: Count) r(A, T, N) :- universe(A, T), N > 3. }"
    with pytest.raises(CompileError):
        Engine(spark, text, facts).relation("r")
    assert Engine(spark, text, facts).relation("r", N=5).count() > 0
    assert math.isclose(1.0, 1.0)
