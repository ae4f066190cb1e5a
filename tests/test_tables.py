"""Sinks: ledgers, typed and text tables, logs, exceptions."""

from __future__ import annotations

import pytest

from ruletide import session
from ruletide.loop.config import frictionless
from ruletide.loop.run import Point, run, write_ledger
from ruletide.plans.compiler import CompileError
from ruletide.plans.program import link
from ruletide.sources import bundle, tables
from ruletide.sources.ingest import DailyExport, Synthetic
from ruletide.study.study import append, read_log

TEXT = """environment e { close(+A: Equity, @T: Timestamp, -P: Price<USD>) @1d volume(+A: Equity, @T: Timestamp, -V: Quantity<Shares>) @1d universe(-A: Equity, @T: Timestamp) @1d complete }
strategy s { env e resolution @1d mode delta
  rel held(-A: Equity, @T: Timestamp, -Q: Quantity<Shares>) rel first(-A: Equity, @T: Timestamp) rel unread(-A: Equity, @T: Timestamp, -Q: Quantity<Shares>)
  held(A, T, Q) :- position(A, T, Q), Q > 0 shares.
  unread(A, T, Q) :- position(A, T, Q), Q > 1 shares.
  first(A, T) :- universe(A, T), month_start(T).
  decide(T, buy(A, 5 shares)) :- first(A, T), not held(A, T, _).
  decide(T, sell(A, Q)) :- held(A, T, Q), Q > 100 shares. }"""


def test_a_ledger_holds_every_bar(spark, tmp_path):
    facts, program = Synthetic(3, 40, "2024-01-01").daily(spark), link(TEXT)
    made = run(spark, program, facts, [Point("a", {}, frictionless()), Point("b", {}, frictionless())], ledger=("held",))
    fills = {(r["run_id"], r["equity"]): r["t"].date() for r in made.table("fill").collect()}
    bars = sorted({r["T"] for r in facts["close"].collect()})
    got = made.ledger(program, "held").collect()
    assert {(r["run_id"], r["A"], r["T"], r["Q"]) for r in got} == {(i, a, t, 5.0) for (i, a), since in fills.items() for t in bars if t >= since}
    assert len(got) == len(set(got)) > 100
    write_ledger(spark, program, facts, ["held", "first"], str(tmp_path), made)
    assert spark.read.parquet(f"{tmp_path}/held.parquet").count() == len(got) and spark.read.parquet(f"{tmp_path}/first.parquet").count() > 0
    for bad in ("first", "unread"):
        with pytest.raises(CompileError):
            run(spark, program, facts, ledger=(bad,))


def test_text_tables_and_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, None), (20, -1.0, "long text")], "a int, b double, `odd name` string").coalesce(1)
    tables.write(df, f"{tmp_path}/t", text=True, files=1)
    back = spark.read.parquet(f"{tmp_path}/t")
    assert [k for _, k in back.dtypes] == ["string"] * 3 and sorted(map(tuple, back.collect())) == [("1", "2.5", None), ("20", "-1.0", "long text")]
    assert list(tables.lines(df)) == ["a   b     odd name", "1   2.5", "20  -1.0  long text"]
    assert list(tables.lines(df.where("false"))) == ["a  b  odd name"]
    assert len(list(tables.lines(spark.range(2500), batch=1000))) == 2501


def test_logs_are_shared_or_local(spark, tmp_path):
    for where, session in ((f"{tmp_path}/file", None), (f"{tmp_path}/folder", spark)):
        for k in range(3):
            append(where, {"k": k}, session)
        assert [r["k"] for r in read_log(where, session)] == [0, 1, 2]


def test_unreadable_exceptions_are_an_error(spark, tmp_path):
    assert bundle.reviewed(spark, str(tmp_path)) is None
    (tmp_path / "exceptions.parquet").mkdir()
    (tmp_path / "exceptions.parquet" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        bundle.reviewed(spark, str(tmp_path))


def test_tasks_follow_the_size_of_the_tables(spark, tmp_path, monkeypatch):
    """More data, more tasks of the same size; small data and other queries leave the session as it was."""
    spark.range(20_000).write.parquet(str(tmp_path / "x"))
    own = [spark.conf.get(k, None) for k in (session._INITIAL, session._ADVISED)]
    session.fit(spark, [str(tmp_path / "x")])
    assert [spark.conf.get(k, None) for k in (session._INITIAL, session._ADVISED)] == own
    monkeypatch.setattr(session, "INPUT_A_PARTITION", 1_000)
    session.fit(spark, [str(tmp_path / "x")])
    once = int(spark.conf.get(session._INITIAL))
    assert once > int(spark.conf.get("spark.sql.shuffle.partitions")) and int(spark.conf.get(session._ADVISED)) == session.SHUFFLED_A_TASK
    session.fit(spark, [str(tmp_path / "x")] * 3)
    assert 3 * once - 3 <= int(spark.conf.get(session._INITIAL)) <= 3 * once
    session.fit(spark, [])
    assert [spark.conf.get(k, None) for k in (session._INITIAL, session._ADVISED)] == own


def test_days_of_a_membership_are_made_in_many_tasks(spark):
    """Ten spans in one small partition: their days must not be made, and told apart, in one task."""
    names = spark.createDataFrame([(f"S{i}", str(i)) for i in range(10)], "symbol string, id string").coalesce(1)
    prices = names.selectExpr("symbol", "explode(sequence(DATE '2024-01-01', DATE '2024-01-20')) AS date", *(f"1D AS {c}" for c in ("open", "high", "low", "close", "volume")))
    spans = names.selectExpr("symbol", "'X' AS index", "DATE '2024-01-05' AS `from`", "DATE '2024-01-08' AS `to`")
    made = DailyExport(prices, names.selectExpr("id", "symbol", "DATE '2000-01-01' AS `from`", "CAST(NULL AS DATE) AS `to`"), membership=spans).relations()["member"]
    assert "RepartitionByExpression" in made._jdf.queryExecution().optimizedPlan().toString()
    assert made.count() == 40 and {r["T"].day for r in made.collect()} == {5, 6, 7, 8}
