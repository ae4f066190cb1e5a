"""Running sums against frames summed anew."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest

from ruletide.engine import Engine

ENV = "environment e { x(+A: Equity, @T: Timestamp, -X: Scalar) @1d y(+A: Equity, @T: Timestamp, -Y: Scalar) @1d live(-A: Equity, @T: Timestamp) @1d complete }"
RULE = """library l {{ env e resolution @1d rel r(+A: Equity, @T: Timestamp, -M: Scalar, -S: Scalar, -N: Count) rel d(+A: Equity, @T: Timestamp, -D: Scalar) rel c(+A: Equity, @T: Timestamp, -C: Scalar, -B: Scalar, -Z: Scalar)
  r(A, T, M, S, N) :- live(A, T), M = mean(X) over (U in {w}, x(A, U, X)), S = sum(X) over (U in {w}, x(A, U, X)), N = count(X) over (U in {w}, x(A, U, X)).
  d(A, T, D) :- live(A, T), D = std(X) over (U in {w}, x(A, U, X)).
  c(A, T, C, B, Z) :- live(A, T), C = corr(X, Y) over (U in {w}, x(A, U, X), y(A, U, Y)), B = ols_beta(X, Y) over (U in {w}, x(A, U, X), y(A, U, Y)), Z = cov(X, Y) over (U in {w}, x(A, U, X), y(A, U, Y)). }}"""


@pytest.fixture(scope="module")
def facts(spark):
    """Entities of random, constant, and very large values, on bars with gaps."""
    rng, day = random.Random(4), dt.date(2024, 1, 1)
    rows = []
    for a in ("plain", "constant", "large", "jump"):
        for k in range(90):
            if rng.random() < 0.8:
                x = {"plain": rng.gauss(0, 1), "constant": 7.25, "large": 1e6 + rng.gauss(0, 1), "jump": 5.0 if k > 30 else 1e4 * rng.random()}[a]
                rows.append((a, day + dt.timedelta(days=k), x, 3.5 if a == "constant" else x / 2 + rng.gauss(0, 1)))
    every = [(a, day + dt.timedelta(days=k)) for a in ("plain", "constant", "large", "jump", "absent") for k in range(90)]
    table = spark.createDataFrame(rows, "A string, T date, X double, Y double").cache()
    return {"x": table.select("A", "T", "X"), "y": table.select("A", "T", "Y"), "live": spark.createDataFrame(every, "A string, T date").cache()}


@pytest.mark.parametrize("window", ["window(T, 12d, min 2)", "prior_window(T, 9d, min 1)", "rows(T, 7, min 3)", "window(T, 1mo, min 1)"])
def test_running_sums_equal_frames(spark, facts, window):
    made = {how: Engine(spark, ENV + RULE.format(w=window), facts, sums=how) for how in ("exact", "running")}
    for relation in ("r", "d", "c"):
        got = {how: {(r["A"], r["T"]): tuple(r)[2:] for r in e.relation(relation).collect()} for how, e in made.items()}
        assert got["exact"].keys() == got["running"].keys() and len(got["exact"]) > 100
        for at, want in got["exact"].items():
            assert all(math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6) for a, b in zip(want, got["running"][at], strict=True)), (at, want, got["running"][at])


def test_running_sums_over_months_before_a_bar(spark, facts):
    """Frames of the last days of March all begin on the last of February, whose value none of them may lose."""
    e = Engine(spark, ENV + RULE.format(w="prior_window(T, 1mo, min 1)"), facts, sums="running")
    values = {(r["A"], r["T"]): r["X"] for r in facts["x"].collect()}
    got = {(r["A"], r["T"]): (r["M"], r["N"]) for r in e.relation("r").collect()}
    assert len(got) > 300
    for (a, t), (m, n) in got.items():
        y, mo = divmod(t.year * 12 + t.month - 2, 12)
        first = min(dt.date(y, mo + 1, 1) + dt.timedelta(days=t.day - 1), dt.date(y + mo // 11, (mo + 1) % 12 + 1, 1) - dt.timedelta(days=1))
        frame = [x for (b, u), x in values.items() if b == a and first <= u < t]
        assert n == len(frame) and math.isclose(m, sum(frame) / n, rel_tol=1e-6, abs_tol=1e-6), (a, t)


@pytest.mark.parametrize("window", ["window(T, 12d, min 2)", "prior_window(T, 9d, min 1)", "rows(T, 7, min 3)"])
def test_running_sums_neither_copy_rows_nor_join_back(spark, facts, window):
    plan = {how: Engine(spark, ENV + RULE.format(w=window), facts, sums=how).relation("d")._jdf.queryExecution().optimizedPlan().toString() for how in ("exact", "running")}
    assert "Generate" not in plan["running"] and "Window" in plan["running"]
    assert all(plan["running"].count(x) <= plan["exact"].count(x) for x in ("Join", "Repartition", "Aggregate"))
