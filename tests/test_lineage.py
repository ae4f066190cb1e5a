"""Lineages, and the command line around runs, bundles and studies."""

from __future__ import annotations

import json

import pytest

from ruletide.__main__ import main
from ruletide.loop.run import Point, shared
from ruletide.plans.program import link
from ruletide.study.lineage import Lineages

ENV = "environment e { close(+A: Equity, @T: Timestamp, -P: Price<USD>) @1d volume(+A: Equity, @T: Timestamp, -V: Quantity<Shares>) @1d universe(-A: Equity, @T: Timestamp) @1d complete }"
BODY = """rel held(-A: Equity, @T: Timestamp, -Q: Quantity<Shares>) rel up(-A: Equity, @T: Timestamp) rel big(-A: Equity, @T: Timestamp) rel odd(-A: Equity, @T: Timestamp) rel calm(-A: Equity, @T: Timestamp)
  held(A, T, Q) :- position(A, T, Q), Q > 0 shares.
  up(A, T) :- universe(A, T), prev(T, U), close(A, T, P), close(A, U, R), P > R.
  big(A, T) :- universe(A, T), volume(A, T, V), V > 100 shares.
  odd(A, T) :- universe(A, T), close(A, T, P), P > 10 USD/share.
  decide(T, buy(A, qty)) :- up(A, T), big(A, T), odd(A, T), calm(A, T), not held(A, T, _).
  decide(T, sell(A, Q)) :- held(A, T, Q), not up(A, T)."""


def strategy(days="5d", more=""):
    return f"{ENV} strategy s {{ env e resolution @1d mode delta param qty : Quantity<Shares> = 10 shares param k : Duration = {days} {BODY} calm(A, T) :- universe(A, T), M = mean(P) over (U in window(T, k, min 1), close(A, U, P)), close(A, T, Q), Q < M * 2. {more} }}"


def test_lineages(tmp_path):
    store = Lineages(f"{tmp_path}/log")
    assert store.all() == {}
    first, s = store.declare(strategy())
    assert s == 0 and store.declare(strategy()) == (first, 1.0)
    near, s = store.declare(strategy(more="decide(T, sell(A, Q)) :- held(A, T, Q), not calm(A, T)."))
    assert near == first and 0.7 < s < 1
    other, s = store.declare(f"{ENV} strategy s {{ env e resolution @1d mode delta decide(T, buy(A, 1 shares)) :- universe(A, T). }}")
    assert other != first and s == 0
    line = store.all()[first]
    for p, r in zip(line.programs, (0.1, 0.3)):
        store.trial(p, r)
    assert store.all()[first].trials == 2 and store.all()[first].variance == pytest.approx(0.02)
    store.dispute(line.programs[1], "another signal altogether")
    assert store.all()[first].trials == 1 and store.all()[first].disputes == {line.programs[1]: "another signal altogether"}
    for bad in (lambda: store.dispute("nobody", "x"), lambda: store.dispute(first, " "), lambda: store.trial("nobody", 1.0)):
        with pytest.raises(ValueError):
            bad()


def test_points_that_differ_in_the_loop_only_share_their_input():
    program = link(strategy())
    points = [Point(f"{k}-{q}", {"k": k, "qty": float(q)}) for k in ("5d", "10d") for q in (1, 2, 3)]
    assert [[p.run_id for p in g] for g in shared(program, points)] == [["5d-1", "5d-2", "5d-3"], ["10d-1", "10d-2", "10d-3"]]


def test_command_line(spark, tmp_path, capsys):
    rules = tmp_path / "s.rules"
    rules.write_text(strategy())
    at = str(tmp_path)
    data = ["--synthetic", "daily:4:40"]
    assert main(["run", str(rules), *data, "--preset", "frictionless", "--out", f"{at}/run", "--nav", f"{at}/nav", "--returns", f"{at}/returns", "--ledger", "held", "--ledger", "up"]) == 0
    nav, returns = spark.read.parquet(f"{at}/nav"), spark.read.parquet(f"{at}/returns")
    assert nav.count() == returns.count() + 1 == 40
    assert spark.read.parquet(f"{at}/run/ledger/held.parquet").count() > 0 and spark.read.parquet(f"{at}/run/ledger/up.parquet").count() > 0
    assert main(["declare", str(rules), "--store", f"{at}/store"]) == 0
    mark = json.loads(capsys.readouterr().out.splitlines()[-1])["lineage"]
    assert main(["dispute", mark, "--store", f"{at}/store", "--reason", "test"]) == 0 and main(["lineages", "--store", f"{at}/store"]) == 0
    assert mark in capsys.readouterr().out
    assert main(["study", str(rules), *data, "--preset", "frictionless", "--axis", "qty=5,10", "--report"]) == 0
    assert "look-ahead" in capsys.readouterr().out
    spark.createDataFrame([(f"SYN{i}", f"T{i}", "2000-01-01", None) for i in range(4)], "id string, ticker string, from string, to string").selectExpr("id", "ticker", "CAST(`from` AS DATE) AS `from`", "CAST(`to` AS DATE) AS `to`").write.parquet(f"{at}/sec")
    assert main(["bundle", str(rules), f"{at}/bundle", *data, "--as-of", "2030-01-01", "--securities", f"{at}/sec", "--source", "made"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["source"] == "made"
