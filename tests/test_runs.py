"""Runs, the streaming fold, studies and what surrounds them."""

from __future__ import annotations

import datetime as dt
import json
import random
import time

import numpy as np
import pytest

from ruletide.__main__ import main
from ruletide.engine import Engine
from ruletide.loop import run as runs
from ruletide.loop import split
from ruletide.loop.config import frictionless
from ruletide.loop.executor import SimExecutor
from ruletide.loop.market import Market
from ruletide.loop.run import Point, run
from ruletide.observe.explain import coverage, explain, peeks, query
from ruletide.plans.compiler import CompileError
from ruletide.plans.library import library
from ruletide.plans.program import link
from ruletide.sources import bundle, environment
from ruletide.sources.ingest import Synthetic
from ruletide.streaming import fold
from ruletide.study import metrics as mt
from ruletide.study.study import Study, WalkForward, add_months, fingerprint, grid, holdout, parse_axis, read_log, similarity, surface, trial_variance

ENV = "environment e { close(+A: Equity, @T: Timestamp, -P: Price<USD>) @1d volume(+A: Equity, @T: Timestamp, -V: Quantity<Shares>) @1d universe(-A: Equity, @T: Timestamp) @1d complete }"
CROSS = ENV + library("features", "e") + """strategy s { env e uses features resolution @1d mode delta
  param k : Duration = 10d in 5d..30d  param qty : Quantity<Shares> = 100 shares
  rel up(-A: Equity, @T: Timestamp) up(A, T) :- universe(A, T), sma(A, T, k, 3, M), close(A, T, P), P > M.
  decide(T, buy(A, qty)) :- up(A, T), flat(A, T), not bought_within(A, T, 3d).
  decide(T, sell(A, Q)) :- held(A, T, Q), close(A, T, P), prev(T, U), close(A, U, R), P <= R. }"""
TARGETS = ENV + library("features", "e") + """strategy s { env e uses features resolution @1d mode target
  rel c(-A: Equity, @T: Timestamp, -M: Scalar) c(A, T, M) :- universe(A, T), momentum(A, T, 2w, 0d, M).
  rel pick(-A: Equity, @T: Timestamp) pick(A, T) :- bar(T), top(2, c(A, T, M), by (M desc, A asc)).
  rel n(@T: Timestamp, -N: Count) n(T, N) :- bar(T), N = count(A) over (pick(A, T)), N > 0.
  decide(T, target_weight(A, W)) :- pick(A, T), n(T, N), W = 1 / N.
  decide(T, target_weight(A, 0)) :- held(A, T, _), not pick(A, T). }"""
TRAIL = ENV + library("features", "e") + """strategy s { env e uses features resolution @1d mode delta
  rel top(+A: Equity, @T: Timestamp, -H: Price<USD>)
  rel peak(+A: Equity, @T: Timestamp, -H: Price<USD>)
  peak(A, T, H) :- fill(A, T, Q, P), Q > 0 shares, H = P.
  peak(A, T, H) :- position(A, T, Q), Q > 0 shares, not fill(A, T, _, _), prev(T, U), peak(A, U, G), close(A, T, P), H = greatest(G, P).
  decide(T, buy(A, 50 shares)) :- universe(A, T), flat(A, T), month_start(T).
  decide(T, sell(A, Q)) :- held(A, T, Q), peak(A, T, H), close(A, T, P), P < H * 0.97. }""".replace("rel top(+A: Equity, @T: Timestamp, -H: Price<USD>)\n", "")


@pytest.fixture(scope="module")
def facts(spark):
    return {k: v.cache() for k, v in Synthetic(4, 60, "2024-01-01").daily(spark).items()}


def events(result):
    return [(r["kind"], r["t"], json.loads(r["payload"])) for r in result.tagged.orderBy("seq").collect()]


@pytest.mark.parametrize("text", [CROSS, TARGETS, TRAIL])
def test_fold_equals_batch(spark, facts, text):
    cfg = frictionless()
    batch = events(run(spark, text, facts, [Point("run", {}, cfg)]))
    log = [(r["rel"], r["t"], r["avail"], r["payload"]) for r in fold.event_log(link(text), facts).collect()]
    f, snaps = fold.fold(text, log, cfg, snapshot_every=17)
    folded = [(k, x) for k, _, x in f.drain()]
    assert [(k, x) for k, _, x in batch if k != "final"] == folded
    assert {k for k, *_ in batch} >= {"decision", "fill", "nav"} and len(snaps) == 3
    again = fold.Fold.restore(link(text), snaps[1], cfg)
    rest = sorted(log, key=lambda e: (e[2], e[0]))[snaps[1]["events"] :]
    for e in rest:
        again.feed(*e)
    again.finish()
    tail = again.drain()
    assert [(k, t, x) for k, t, x in tail] == [(k, int(t.replace(tzinfo=dt.timezone.utc).timestamp()), x) for k, t, x in batch if k != "final"][-len(tail) :] and len(tail) > 20


def test_pruned_state_is_bounded_and_gives_the_same_run(spark):
    facts = Synthetic(3, 400, "2023-01-02").daily(spark)
    for text, bounded in ((CROSS, True), (TARGETS, True), (TRAIL, False)):
        log = [(r["rel"], r["t"], r["avail"], r["payload"]) for r in fold.event_log(link(text), facts).collect()]
        cfg = frictionless(participation_cap=0.2, impact_coef=0.1, slippage_vol_mult=0.1)
        whole, _ = fold.fold(text, log, cfg)
        cut, snaps = fold.fold(text, log, cfg, snapshot_every=70, prune=True)
        assert (fold.lookback(link(text)) is not None) == bounded
        assert whole.drain() == cut.drain()
        size = [len(s["facts"]) for s in snaps]
        assert (size[-1] < 1.5 * size[1]) == bounded


def test_an_idle_bar_closes_by_the_clock(spark, tmp_path):
    """The last bar's end has passed and no event follows: its decision is made all the same."""
    day = 86_400
    text = ENV + "strategy s { env e resolution @1d mode delta decide(T, buy(A, 1 shares)) :- universe(A, T). }"
    rows = [("run", "universe", d * day, d * day + day - 1, json.dumps({"c0": "X", "c1": d * day})) for d in (19_000, 19_001)]
    rows += [("run", "close", d * day, d * day + day - 1, json.dumps({"c0": "X", "c1": d * day, "c2": 10.0})) for d in (19_000, 19_001)]
    spark.createDataFrame(rows, fold.LOG).coalesce(1).write.parquet(f"{tmp_path}/in")
    made = fold.stream(spark.readStream.schema(fold.LOG).parquet(f"{tmp_path}/in"), text, frictionless(), idle=1)
    q = made.writeStream.format("memory").queryName("idle_bars").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            time.sleep(1)
            if spark.sql("SELECT * FROM idle_bars WHERE kind = 'decision'").count() == 2:
                break
    finally:
        q.stop()
    assert [r["t"].date().isoformat() for r in spark.sql("SELECT t FROM idle_bars WHERE kind = 'decision' ORDER BY t").collect()] == ["2022-01-08", "2022-01-09"]


def test_a_snapshot_belongs_to_its_program(facts):
    f = fold.Fold(link(CROSS))
    with pytest.raises(ValueError):
        fold.Fold.restore(link(TARGETS), f.snapshot())


def test_late_tuples_do_not_change_what_was_decided():
    day = 86_400
    text = ENV + "strategy s { env e resolution @1d mode delta decide(T, buy(A, 1 shares)) :- universe(A, T), prev(T, U), close(A, U, P), P > 10 USD/share. }"
    row = lambda rel, d, late=0, **c: (rel, d * day, d * day + day - 1 + late * day, json.dumps(c))
    log = [row("universe", d, c0="X", c1=d * day) for d in range(1, 6)] + [row("close", d, c0="X", c1=d * day, c2=11.0) for d in (1, 3, 4, 5)] + [row("close", 2, 2, c0="X", c1=2 * day, c2=12.0)]
    f, _ = fold.fold(text, log, frictionless())
    bought = [t // day for k, t, _ in f.executor.events if k == "decision"]
    assert bought == [2, 4, 5] and f.late == 1  # at 3 the close of 2 was not there yet
    g, _ = fold.fold(text, [(r, t, t + day - 1, p) for r, t, _, p in log], frictionless())
    assert [t // day for k, t, _ in g.executor.events if k == "decision"] == [2, 3, 4, 5]


def test_stream_equals_fold(spark, facts, tmp_path):
    log = fold.event_log(link(CROSS), facts).orderBy("avail", "rel", "t", "payload").collect()
    cut = len(log) // 2
    while log[cut]["avail"] == log[cut - 1]["avail"]:
        cut += 1
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    want, _ = fold.fold(CROSS, [(r["rel"], r["t"], r["avail"], r["payload"]) for r in log], frictionless())
    for part in (log[:cut], [*log[cut:], ("run", fold.END, 0, 0, "{}")]):  # the query is stopped in between
        spark.createDataFrame(part, fold.LOG).coalesce(1).write.mode("append").parquet(src)
        q = fold.stream(spark.readStream.schema(fold.LOG).parquet(src), CROSS, frictionless())
        q.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").option("path", f"{out}/rows").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{out}/rows").collect()
    key = lambda k, t, x: (k, t, json.dumps(x, sort_keys=True))
    got = sorted(key(r["kind"], int(r["t"].replace(tzinfo=dt.timezone.utc).timestamp()), json.loads(r["payload"])) for r in rows)
    assert got == sorted(key(*e) for e in want.executor.events)


HOURS = """environment m { tick(+A: Equity, @T: Timestamp, -P: Price<USD>) @1m } strategy s { env m resolution @1h mode delta
  rel up(-A: Equity, @T: Timestamp, -N: Count) up(A, T, N) :- resample(tick(A, U, P) to @1h as T, min 1, N = count(U)).
  decide(T, buy(A, 1 shares)) :- up(A, T, N), N >= 2. }"""


def test_a_log_dealt_by_instrument_gives_the_same_events(spark):
    rng = random.Random(3)
    rows = [("run", "tick", t * 60, t * 60, json.dumps({"c0": a, "c1": t * 60, "c2": 10.0 + t % 7})) for a in "ABCDE" for t in rng.sample(range(1, 3000), 60)]
    program, cfg = link(HOURS), frictionless()
    assert fold.parts_apart(program, cfg) and not fold.parts_apart(program, frictionless(on_leverage="reject")) and not fold.parts_apart(link(CROSS), cfg)
    log = spark.createDataFrame(rows, fold.LOG)
    end = spark.createDataFrame([("run", fold.END, 3000 * 60, 3000 * 60, "{}")], fold.LOG)
    want, _ = fold.fold(program, [r[1:] for r in rows], cfg)
    got, runs_seen = [], {}
    for r in fold.deal(log.union(end), program, 3).collect():
        runs_seen.setdefault(r["run_id"], []).append(tuple(r)[1:])
    assert len(runs_seen) == 3
    for part in runs_seen.values():
        assert sum(r[0] == fold.END for r in part) == 1
        f, _ = fold.fold(program, [r for r in part if r[0] != fold.END], cfg)
        got += f.executor.events
        assert [t for k, t, _ in f.executor.events if k == "nav"] == [t for k, t, _ in want.executor.events if k == "nav"]
    key = lambda events: sorted((k, t, json.dumps(x, sort_keys=True)) for k, t, x in events if k != "nav")
    assert key(got) == key(want.executor.events) and len(got) > 200


def test_a_bar_is_resampled_from_its_own_instants(monkeypatch):
    f = fold.Fold(link(HOURS), frictionless())
    seen = []
    plain = f.kernel.tuples
    monkeypatch.setattr(f.kernel, "tuples", lambda name, pattern: seen.append(pattern) or plain(name, pattern))
    for h in range(200):
        for m in (1, 2):
            t = h * 3600 + m * 60
            f.feed("tick", t, t, json.dumps({"c0": "X", "c1": t, "c2": 5.0}))
    f.finish()
    assert sum(k == "decision" for k, *_ in f.executor.events) == 200 and len(seen) < 1000  # not all earlier ones, which are 40,000


def test_runs_of_a_grid_are_groups(spark, facts):
    points = [Point(f"p{i}", p, frictionless()) for i, p in enumerate(grid(dict([parse_axis("k=5d,10d,20d")])))]
    r = run(spark, CROSS, facts, points)
    assert {x["run_id"] for x in r.table("final").collect()} == {"p0", "p1", "p2"}
    alone = run(spark, CROSS, facts, points[1:2]).table("nav").orderBy("seq").collect()
    assert alone == r.table("nav").where("run_id = 'p1'").orderBy("seq").collect()


def _close(a, b):
    """Equal but for the order in which an account's sums were made."""
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(_close(a[k], b[k]) for k in a)
    return a == pytest.approx(b, rel=1e-12, abs=1e-9) if isinstance(a, float) else a == b


@pytest.mark.parametrize("text", [CROSS, TARGETS, TRAIL])
def test_parts_of_a_run_make_up_the_run(spark, facts, text, monkeypatch):
    cfg = frictionless(participation_cap=0.2, impact_coef=0.1, slippage_vol_mult=0.1, lot="fractional")
    points = [Point("a", {}, cfg), Point("b", {}, frictionless(initial_cash=5e5))]
    whole = run(spark, text, facts, points)
    monkeypatch.setattr(runs, "ROWS_A_PART", 60)
    parts = run(spark, text, facts, points)
    assert isinstance(parts, runs.PartedResult) and not isinstance(whole, runs.PartedResult)
    assert parts.parts.where("kind = 'final'").count() > len(points)
    for kind in ("decision", "fill", "dropped", "action"):
        rows = [sorted(tuple(r.asDict().items()) for r in x.table(kind).drop("seq").collect()) for x in (whole, parts)]
        assert rows[0] == rows[1] and (rows[0] or kind in ("dropped", "action"))
    navs = [[r.asDict() for r in x.table("nav").orderBy("run_id", "seq").drop("seq").collect()] for x in (whole, parts)]
    assert len(navs[0]) == len(navs[1]) == 120 and all(map(_close, *navs))
    for run_id in ("a", "b"):
        a, b = (json.loads(x.table("final").where(f"run_id = '{run_id}'").first()["summary"]) for x in (whole, parts))
        assert _close(a, b)
    order = [(r["kind"], r["t"]) for r in parts.tagged.where("run_id = 'a'").orderBy("seq").collect() if r["kind"] in ("decision", "nav", "final")]
    assert order == [(r["kind"], r["t"]) for r in whole.tagged.where("run_id = 'a'").orderBy("seq").collect() if r["kind"] in ("decision", "nav", "final")]


def test_a_halt_ends_all_parts(spark, facts, monkeypatch):
    text = ENV + "strategy s { env e resolution @1d mode delta decide(T, buy(A, 1 shares)) :- universe(A, T). decide(T, buy(A, 2 shares)) :- universe(A, T), close(A, T, P), P > 90 USD/share. }"
    whole = events(run(spark, text, facts, [Point("run", {}, frictionless())]))
    monkeypatch.setattr(runs, "ROWS_A_PART", 60)
    assert whole == events(run(spark, text, facts, [Point("run", {}, frictionless())])) and whole[-2][0] == "halt"


def test_what_ties_instruments_together():
    one = lambda body, more="": split.rules_apart(link(ENV + library("features", "e") + f"strategy s {{ env e uses features resolution @1d mode delta {more} {body} }}"))
    assert one("decide(T, buy(A, 1 shares)) :- universe(A, T).") and one("decide(T, sell(A, Q)) :- held(A, T, Q), bought_within(A, T, 3d).")
    assert not one("decide(T, buy(A, 1 shares)) :- universe(A, T), cash(T, C), C > 5 USD.")
    assert not one("decide(T, buy(A, 1 shares)) :- universe(A, T), held(B, T, _), close(B, T, P), P > 5 USD/share.")
    assert not one("decide(T, buy(A, 1 shares)) :- universe(A, T), n(T, N), N < 3.", "rel n(@T: Timestamp, -N: Count) n(T, N) :- bar(T), N = count(A) over (held(A, T, _)).")
    assert not one("decide(T, buy(A, 1 shares)) :- N = count(A) over (universe(A, T), flat(A, T)), universe(A, T), N > 2.")
    assert split.account_apart(frictionless()) and not any(split.account_apart(frictionless(**x)) for x in ({"compounding": True}, {"margin_rate": 0.1}, {"cash_rate": 0.1}, {"on_leverage": "reject"}, {"on_margin_call": "liquidate"}, {"on_ruin": "halt"}, {"on_oversize": "halt"}))
    assert split.candidates(link(CROSS)) == {"up"} and split.candidates(link(TARGETS)) == {"pick"}


def test_a_run_reads_the_market_of_what_it_may_trade(spark, facts):
    """One account, one instrument in the signal: the others' prices are no part of the run's input."""
    env = ENV.replace(" }", " signal(-A: Equity, @T: Timestamp) @1d complete }")
    text = env + "strategy s { env e resolution @1d mode delta decide(T, buy(A, 1 shares)) :- signal(A, T), close(A, T, P), P > 0 USD/share. }"
    given = facts | {"signal": facts["universe"].where("A = 'S001'")}
    program = link(text)
    pieces, _ = runs.run_input(spark, program, given, Point("run"), runs.choose(program), ("signal",), True)
    assert {p.rel: p.df.count() for p in pieces if p.rel[:2] in ("m:", "r:")} == {"r:signal:[null, null]": 60, "r:close:[null, null, null]": 60, "m:price": 60, "m:volume": 60}
    assert run(spark, text, given, [Point("run", {}, frictionless(on_leverage="reject"))]).table("fill").count() == 59


def test_history_is_kept_only_of_what_is_read(spark):
    x = SimExecutor(frictionless(), Market(86_400), set())
    x.open_bar(0)
    x.take(0, [])
    x.fill(86_400)
    x.open_bar(86_400)
    assert not (x.position_at or x.cash_at or x.nav_at or x.fill_at) and len(x.events) == 2


def test_halts_conflicts_and_windows_of_bars(spark, facts, tmp_path):
    both = ENV + "strategy s { env e resolution @1d mode delta decide(T, buy(A, 1 shares)) :- universe(A, T). decide(T, buy(A, 2 shares)) :- universe(A, T). }"
    assert "conflicts with" in run(spark, both, facts).table("halt").first()["message"]
    none = ENV + "strategy s { env e resolution @1d mode delta decide(T, buy(A, 0 shares)) :- universe(A, T). }"
    assert "positive quantity" in run(spark, none, facts).table("halt").first()["message"]
    start = int(dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc).timestamp())
    r = run(spark, CROSS, facts, [Point("run", {}, frictionless(start=start))])
    assert r.table("nav").agg({"t": "min"}).first()[0] == dt.datetime(2024, 2, 1)
    r.write(str(tmp_path / "dump"), {"x": 1})
    assert spark.read.parquet(str(tmp_path / "dump/nav")).count() == r.table("nav").count()
    opens = ENV + "strategy s { env e resolution @1d mode delta decide(T, buy(A, 1 shares, moo)) :- universe(A, T). }"
    with pytest.raises(CompileError):
        run(spark, opens, facts)
    with pytest.raises(Exception, match="out of its range"):
        run(spark, CROSS, facts, [Point("run", {"k": "60d"})])


def test_decisions_are_causal(spark, facts):
    days = sorted(r["T"] for r in facts["close"].select("T").distinct().collect())
    for at in random.Random(1).sample(days[20:], 2):
        assert peeks(spark, TARGETS, facts, "pick", at, lambda f, at=at: {k: v.where(v["T"] <= at) for k, v in f.items()}).count() == 0


def test_explain_query_coverage(spark, facts):
    text = ENV + "library l { env e resolution @1d rel a(-A: Equity, @T: Timestamp, -P: Price<USD>) a(A, T, P) :- universe(A, T), close(A, T, P), P > 1000000 USD/share, volume(A, T, _). rel b(-A: Equity, @T: Timestamp) b(A, T) :- a(A, T, _). }"
    e = Engine(spark, text, facts)
    day = facts["close"].first()["T"]
    x = explain(e, "a", day)[0]
    assert x["fails_at"] == "comparison >" and x["steps"][1]["solutions"] == 4
    cov = {c["relation"]: c for c in coverage(e)}
    assert cov["close"]["tuples"] == 240 and cov["a"]["tuples"] == 0 and cov["b"]["cause"] == "a"
    assert query(e, "close", day, A="S001").count() == 1


# statistics


def test_metrics_closed_forms():
    r = np.array([0.1, -0.05, 0.2, 0.0])
    e = np.concatenate(([1.0], np.cumprod(1 + r)))
    t = np.array([0, 10, 20, 40, 70]) * 86_400
    m = mt.return_metrics(t, e, 12)
    assert np.isclose(m["total_return"], e[-1] - 1) and np.isclose(m["sharpe"], r.mean() / r.std(ddof=1) * 12**0.5)
    assert np.isclose(m["sortino"], r.mean() / np.sqrt((0.05**2) / 4) * 12**0.5) and np.isclose(m["max_drawdown"], 0.05)
    assert m["max_drawdown_duration"] == 1 and np.isclose(m["cvar_5"], 0.05) and np.isclose(m["cagr"], e[-1] ** 3 - 1)
    assert np.isclose(m["worst_month"], 0.0) and np.isclose(mt.skewness(r), ((r - r.mean()) ** 3).mean() / r.std() ** 3)
    assert mt.return_metrics(t[:1], e[:1], 12)["n"] == 0
    x = np.random.default_rng(1).normal(size=400)
    assert mt.lo_factor(x, 1) == 1 and np.isclose(mt.lo_factor(x, 2), 2 / np.sqrt(2 + 2 * mt.autocorrelation(x, 1))) and np.isclose(mt.newey_west_t(x, 0), x.mean() / (x.std() / 20))
    assert np.allclose(mt.drawdown(np.array([1, 2, 1, 1.5, 3, 1.0])), (2 / 3, 2))


def test_significance():
    assert np.isclose(mt.probabilistic_sharpe(0.1, 0.1, 100, 0, 0), 0.5)
    assert np.isclose(mt.probabilistic_sharpe(0.2, 0.0, 101, 0, 0), mt._NORMAL.cdf(0.2 * 10 / np.sqrt(1 + 0.5 * 0.04)))
    n = mt.min_track_record(0.1, 0.0, 0, 0, 0.95)
    assert np.isclose(mt.probabilistic_sharpe(0.1, 0.0, int(round(n)), 0, 0), 0.95, atol=2e-3)
    assert mt.deflated_sharpe(0.1, 100, 0, 0, 1, 0.5)["expected_max_sr"] == 0 < mt.deflated_sharpe(0.1, 100, 0, 0, 50, 0.01)["expected_max_sr"]
    rng = np.random.default_rng(2)
    noise = rng.normal(size=(320, 20))
    skilled = noise.copy()
    skilled[:, 3] += 1.0
    assert mt.pbo(skilled).pbo < 0.01 < 0.2 < mt.pbo(noise).pbo and mt.pbo(noise).combinations == 12_870
    assert mt.pbo(noise[:10]) is None
    lo, hi = mt.bootstrap_sharpe(rng.normal(0.1, 1, 500), 1.0)
    assert lo < 0.1 < hi


def test_pbo_matches_the_definition():
    from itertools import combinations

    x = np.random.default_rng(5).normal(size=(40, 5))
    blocks, below, logits = x.reshape(8, 5, 5), 0, []
    sr = lambda y: y.mean(0) / y.std(0, ddof=1)
    for pick in combinations(range(8), 4):
        a = sr(np.concatenate([blocks[i] for i in pick]))
        b = sr(np.concatenate([blocks[i] for i in range(8) if i not in pick]))
        w = (1 + (b < b[a.argmax()]).sum()) / 6
        logits.append(np.log(w / (1 - w)))
        below += logits[-1] <= 0
    p = mt.pbo(x, 8)
    assert np.isclose(p.pbo, below / 70) and np.isclose(p.mean_logit, np.mean(logits))


def test_periods_trips_and_conventions():
    t = np.array([0, 1, 2, 26, 27]) * 3600
    e = np.array([100, 101, 99, 103, 102.0])
    d, r, p = mt.period_returns(t, e, 100.0, True)
    assert d.tolist() == [0, 86_400] and np.allclose(r, [-0.01, 0.03]) and np.allclose(p, [-1, 3])
    _, r, _ = mt.period_returns(t, e, None, True, np.array([0, 86_400, 172_800]))
    assert np.allclose(r, [99 / 100 - 1, 102 / 99 - 1])
    trips = mt.round_trips([{"equity": "X", "quantity": q, "price": x, "commission": 1, "fee": 0} for q, x in ((2, 10), (-2, 12), (1, 5), (-1, 4))])
    assert trips.tolist() == [2, -3]
    c = mt.convention_metrics(np.array([0.1, -0.1]), np.array([10.0, -10.0]), 12, trips)
    assert c["trades"] == 2 and c["win_rate"] == 0.5 and np.isclose(c["max_drawdown_additive"], 0.1) and c["profit_factor"] == 1
    keep = np.array([True, False, True, True, False])
    _, masked = mt.masked_curve(t, e, keep)
    assert np.allclose(masked, [100, 100 * 99 / 101, 100 * 99 / 101 * 103 / 99])
    assert mt.capacity(100, 0.02, 0.01) == 25 and mt.capacity(100, 0, 0.01) is None


def test_study(spark, facts, tmp_path):
    log = str(tmp_path / "trials.jsonl")
    s = Study(CROSS, dict([parse_axis("k=5d,10d,20d"), parse_axis("qty=50..100/50")]), holdout="trailing:1mo", walk=WalkForward.parse("rolling:1mo:1mo"), config=frictionless(), log=log)
    out = s.run(spark, facts)
    assert out["trials"] == 6 and 0 <= out["best"] < 6 and len(out["report"]) == 40
    assert out["surface"]["neighbours"] in (2, 3) and out["walk_forward"]["folds"] and out["pbo"] is None or 0 <= out["pbo"]["pbo"] <= 1
    assert s.reveal(spark, facts, out["best"], {"total_return": -1.0})["passed"] == {"total_return": True}
    assert len(read_log(log)) == 1 and trial_variance(log, fingerprint(CROSS))[0] == 1


def test_study_pieces():
    month = lambda y, m: int(dt.datetime(y, m, 1, tzinfo=dt.timezone.utc).timestamp())
    first, last = month(2020, 1), month(2022, 12) + 86_400 * 20
    assert add_months(month(2020, 11), 3) == month(2021, 2)
    assert WalkForward.parse("anchored:1y:6mo").folds(first, last)[1] == (month(2020, 1), month(2021, 7), month(2022, 1))
    assert WalkForward.parse("rolling:1y:6mo").folds(first, last)[1][0] == month(2020, 7)
    with pytest.raises(ValueError):
        WalkForward.parse("sideways:1y:6mo")
    h = holdout("blocks:3:2mo:4", first, last)
    assert len(h.spans) == 3 and all(a[1] <= b[0] for a, b in zip(h.spans, h.spans[1:])) and h == holdout("blocks:3:2mo:4", first, last)
    assert holdout("trailing:1y", first, last).spans[0][0] == month(2021, 12) and holdout("none", first, last).keep(np.array([1])).all()
    s = surface([2, 2], np.array([1.0, 1.05, 0.0, 2.0]), 1)
    assert s["neighbours"] == 2 and s["stability"] == 0.5
    assert similarity(link(CROSS), link(CROSS)) == 1.0 > similarity(link(CROSS), link(TARGETS))
    assert fingerprint(CROSS) == fingerprint(CROSS.replace("  ", " ")) != fingerprint(TARGETS)


# data


def test_environment_round_trip_and_checks(spark, facts, tmp_path):
    env = link(CROSS).env
    environment.write(facts, str(tmp_path))
    back, notes = environment.read(spark, env, str(tmp_path))
    assert back["close"].exceptAll(facts["close"]).count() == 0 and not notes
    bad = facts["close"].union(facts["close"].limit(1).selectExpr("A", "T", "P + 1"))
    bad.write.mode("overwrite").parquet(f"{tmp_path}/close.parquet")
    with pytest.raises(environment.DataError, match="two values"):
        environment.read(spark, env, str(tmp_path))
    facts["close"].selectExpr("A", "T", "-P AS P").write.mode("overwrite").parquet(f"{tmp_path}/close.parquet")
    with pytest.raises(environment.DataError, match="not positive"):
        environment.read(spark, env, str(tmp_path))
    facts["close"].select("A", "T").write.mode("overwrite").parquet(f"{tmp_path}/close.parquet")
    with pytest.raises(environment.DataError, match="lacks"):
        environment.read(spark, env, str(tmp_path))
    (tmp_path / "close.parquet").rename(tmp_path / "gone")
    assert environment.read(spark, env, str(tmp_path))[1] == ["`close` has no file: it is empty"]


def test_bundle(spark, tmp_path):
    market = Synthetic(4, 60, "2024-01-01").catalog(spark)
    text = """environment cat { close(+A: Equity, @T: Timestamp, -P: Price<USD>) @1d universe(-A: Equity, @T: Timestamp) @1d complete split(+A: Equity, @T: Timestamp, -Factor: Scalar) @1d complete
      delisted(+A: Equity, @T: Timestamp, -Reason: Label) @1d complete member(+A: Equity, @T: Timestamp, +Idx: Label) @1d complete ticker(+A: Equity, @T: Timestamp, -S: Label) @1d complete }"""
    env = link(text + "library l { env cat resolution @1d }").env
    sec = market["universe"].selectExpr("A AS id").distinct().selectExpr("id", "concat('T', id) AS ticker", "TIMESTAMP_NTZ '2000-01-01' AS `from`", "CAST(NULL AS TIMESTAMP_NTZ) AS `to`")
    path = str(tmp_path / "b")
    bundle.write(spark, env, market, sec, path, "2024-04-01")
    with pytest.raises(environment.DataError, match="not passed"):
        bundle.read(spark, env, path)
    assert set(bundle.test(spark, env, path).values()) == {0}
    facts, _ = bundle.read(spark, env, path, start="2024-02", end="2024-02")
    assert {r["T"].month for r in facts["close"].select("T").distinct().collect()} == {2} and facts["ticker"].first()["S"].startswith("TS")
    assert bundle.annotate(spark, path, source="test").source == "test" and bundle.manifest(spark, path).tested
    worse = dict(market, close=market["close"].selectExpr("A", "T", "CASE WHEN T = DATE '2024-02-20' THEN P * 3 ELSE P END AS P"))
    bundle.write(spark, env, worse, sec, path, "2024-04-01")
    assert bundle.test(spark, env, path)["action reconciliation"] == 8
    other = link(text.replace("cat", "dog") + "library l { env dog resolution @1d }").env
    with pytest.raises(environment.DataError, match="not of"):
        bundle.read(spark, other, path)


def test_securities(spark):
    s = spark.createDataFrame([("E1", "AAA", "2020-01-01", None), ("E2", "BBB", "2020-01-01", "2024-01-11"), ("E2", "BBX", "2024-01-11", None), ("E3", "BBB", "2024-02-01", None)], "id string, ticker string, `from` string, `to` string")
    assert environment.identity_problems(s).count() == 0
    assert environment.id_of(s, "BBB", "2024-01-10") == "E2" and environment.id_of(s, "BBB", "2024-03-01") == "E3"
    with pytest.raises(environment.DataError):
        environment.id_of(s, "BBB", "2024-01-15")
    bad = s.union(spark.createDataFrame([("E4", "AAA", "2023-01-01", "2023-06-01"), ("E1", "ZZZ", "2021-01-01", "2021-01-01")], s.schema))
    assert {r["problem"] for r in environment.identity_problems(bad).collect()} == {"empty interval", "two securities at once", "two tickers at once"}


def test_command_line(spark, tmp_path, capsys):
    rules = tmp_path / "s.rules"
    rules.write_text(CROSS)
    assert main(["check", str(rules)]) == 0 and "clean" in capsys.readouterr().out
    assert main(["show", str(rules)]) == 0 and "decide [output @1d] (closed loop)" in capsys.readouterr().out
    assert main(["run", str(rules), "--synthetic", "daily:3:40", "--preset", "frictionless", "--param", "qty=10", "--out", str(tmp_path / "o")]) == 0
    assert json.loads(capsys.readouterr().out)["turnover"] > 0
    assert main(["query", str(rules), "sma", "--synthetic", "daily:3:40", "--input", "N=10d", "--input", "K=3", "--at", "2020-01-20"]) == 0
    assert main(["explain", str(rules), "up", "--synthetic", "daily:3:40", "--at", "2020-01-20"]) == 0
    assert main(["study", str(rules), "--synthetic", "daily:3:40", "--preset", "frictionless", "--axis", "k=5d,10d"]) == 0
    (tmp_path / "bad.rules").write_text(ENV + "strategy s { env e resolution @1d mode delta }")
    assert main(["check", str(tmp_path / "bad.rules")]) == 1
    with pytest.raises(SystemExit):
        main(["run"])
