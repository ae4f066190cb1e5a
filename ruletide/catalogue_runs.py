"""Closed-loop runs whose outcome SQL can state: each isolates one model of the simulated executor.

Signals are the supplier's days of 60 units or more; an order is decided at such a bar and acts at the next one. The facts and
their SQL are made from the same tables; every run is over all suppliers and bars.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ruletide.catalogue import ORACLE, daily
from ruletide.catalogue_ops import register
from ruletide.loop.config import BorrowBucket, ExecConfig, frictionless
from ruletide.loop.run import Point, RunResult, run
from ruletide.sources import driver_tables as dt

_RELATIONS = {
    "close": "close(+A: Equity, @T: Timestamp, -P: Price<USD>) @1d",
    "open": "open(+A: Equity, @T: Timestamp, -O: Price<USD>) @1d",
    "high": "high(+A: Equity, @T: Timestamp, -H: Price<USD>) @1d",
    "low": "low(+A: Equity, @T: Timestamp, -L: Price<USD>) @1d",
    "volume": "volume(+A: Equity, @T: Timestamp, -V: Quantity<Shares>) @1d",
    "signal": "signal(-A: Equity, @T: Timestamp) @1d complete",
    "split": "split(+A: Equity, @T: Timestamp, -Factor: Scalar) @1d complete",
    "dividend": "dividend(+A: Equity, @T: Timestamp, -Ex: Timestamp, -D: Price<USD>) @1d complete",
    "delisted": "delisted(+A: Equity, @T: Timestamp, -Reason: Label) @1d complete",
}
_SQL = """
ohl AS (SELECT CAST(l_suppkey AS VARCHAR) AS a, CAST(l_shipdate AS DATE) AS t, min(l_extendedprice / l_quantity) AS lo, max(l_extendedprice / l_quantity) AS hi,
               (min(l_extendedprice / l_quantity) + max(l_extendedprice / l_quantity)) / 2 AS o FROM lineitem GROUP BY 1, 2),
rb AS (SELECT t, lag(t) OVER (ORDER BY t) AS t0, row_number() OVER (ORDER BY t) AS i FROM (SELECT DISTINCT t FROM volume)),
sig AS (SELECT a, t FROM volume WHERE v >= 60),
ord AS (SELECT s.a, s.t, rb.t AS t1 FROM sig s JOIN rb ON rb.t0 = s.t),
got AS (SELECT o.a, o.t, t1, p FROM ord o JOIN close c ON c.a = o.a AND c.t = o.t1)
"""


def _sql(text: str) -> str:
    return daily(f"{_SQL.strip()}{'' if text.lstrip().upper().startswith('SELECT') else ','} {text}")


def _facts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    m = dt.market_1d(spark, d)
    x = F.col("l_extendedprice") / F.col("l_quantity")
    items = dt.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("A"), F.to_date("l_shipdate").alias("T")).agg(F.min(x).alias("L"), F.max(x).alias("H"))
    days = m["volume"].select("T").distinct().where("T >= DATE '2000-01-01'")
    gone = dt.table(spark, d, "supplier").where("s_suppkey % 4 = 0").select(F.col("s_suppkey").cast("string").alias("A"), F.when(F.col("s_suppkey") % 8 == 0, "bankruptcy").otherwise("acquisition").alias("Reason"))
    return {
        "close": m["close"], "volume": m["volume"], "low": items.select("A", "T", "L"), "high": items.select("A", "T", "H"), "open": items.select("A", "T", ((F.col("L") + F.col("H")) / 2).alias("O")),
        "signal": m["volume"].where("V >= 60").select("A", "T"), "split": m["volume"].where("V >= 120").select("A", "T", F.lit(2.0).alias("Factor")), "dividend": m["dividend"],
        # a status: on every bar from the delisting on; a few suppliers for each bar
        "delisted": days.join(F.broadcast(gone)).select("A", "T", "Reason"),
    }


def _run(spark: SparkSession, facts: dict[str, DataFrame], decide: str, config: ExecConfig, uses: tuple[str, ...] = (), mode: str = "delta", points: list[Point] | None = None, params: str = "") -> RunResult:
    names = ("close", "volume", "signal", *uses)
    text = "environment market_run { " + " ".join(_RELATIONS[n] for n in names) + f" }} strategy s {{ env market_run resolution @1d mode {mode} {params} {decide} }}"
    return run(spark, text, {n: facts[n] for n in names}, points or [Point("run", {}, config)])


def _day(df: DataFrame) -> DataFrame:
    return df.withColumn("t", F.to_date("t"))


def outcome(name: str, decide: str, sql: str, columns: str, doubles: tuple[str, ...], config: ExecConfig | None = None, uses: tuple[str, ...] = (), kind: str = "fill", mode: str = "delta", where: str = "true", facts: Callable | None = None) -> None:
    """Register a run and the SQL of one of its tables."""

    @register(name, _sql(sql), doubles, columns)
    def _(spark, d):
        given = _facts(spark, d)
        if facts:
            given |= facts(given)
        return _day(_run(spark, given, decide, config or frictionless(), uses, mode).table(kind)).where(where).select(*columns.split())


BUY = "decide(T, buy(A, 10 shares)) :- signal(A, T)."
SHORT = "decide(T, short(A, 10 shares)) :- signal(A, T)."
BASIC = "t equity quantity price"

# orders

outcome("run_next_bar", BUY, "SELECT t1 AS t, a AS equity, 10.0::DOUBLE AS quantity, p AS price FROM got", BASIC, ("quantity", "price"))
outcome("run_dropped", BUY, "SELECT t, a AS equity, 'buy' AS ctor, 10.0::DOUBLE AS amount FROM sig s WHERE NOT EXISTS (SELECT 1 FROM got g WHERE g.a = s.a AND g.t = s.t)", "t equity ctor amount", ("amount",), kind="dropped")
outcome("run_limit", "decide(T, buy(A, 10 shares, limit(L))) :- signal(A, T), close(A, T, P), L = P * 0.9.", "x AS (SELECT o.t1, o.a, h.o, h.lo, c.p * 0.9::DOUBLE AS l FROM ord o JOIN close c ON c.a = o.a AND c.t = o.t JOIN ohl h ON h.a = o.a AND h.t = o.t1) SELECT t1 AS t, a AS equity, 10.0::DOUBLE AS quantity, CASE WHEN o <= l THEN o ELSE l END AS price FROM x WHERE o <= l OR lo <= l", BASIC, ("quantity", "price"), uses=("open", "high", "low"))
outcome("run_stop", "decide(T, short(A, 10 shares, stop(L))) :- signal(A, T), close(A, T, P), L = P * 0.9.", "x AS (SELECT o.t1, o.a, h.o, h.lo, c.p * 0.9::DOUBLE AS l FROM ord o JOIN close c ON c.a = o.a AND c.t = o.t JOIN ohl h ON h.a = o.a AND h.t = o.t1) SELECT t1 AS t, a AS equity, -10.0::DOUBLE AS quantity, CASE WHEN o <= l THEN o ELSE l END AS price FROM x WHERE o <= l OR lo <= l", BASIC, ("quantity", "price"), uses=("open", "high", "low"))
outcome("run_limit_gtc", "decide(T, buy(A, 10 shares, limit(L, bars(3)))) :- signal(A, T), close(A, T, P), L = P * 0.7.", "x AS (SELECT s.a, s.t, s.t1, b.i, c.p * 0.7::DOUBLE AS l, lead(b.i) OVER (PARTITION BY s.a ORDER BY s.t) AS next FROM ord s JOIN rb b ON b.t = s.t JOIN close c ON c.a = s.a AND c.t = s.t), h AS (SELECT h.*, b.i FROM ohl h JOIN rb b ON b.t = h.t), y AS (SELECT x.a, x.t, x.l, h.t AS hit, h.o, row_number() OVER (PARTITION BY x.a, x.t ORDER BY h.t) AS n FROM x JOIN h ON h.a = x.a AND h.i > x.i AND h.i <= x.i + 3 AND (x.next IS NULL OR h.i <= x.next) AND (h.o <= x.l OR h.lo <= x.l)) SELECT hit AS t, a AS equity, 10.0::DOUBLE AS quantity, CASE WHEN o <= l THEN o ELSE l END AS price FROM y WHERE n = 1", BASIC, ("quantity", "price"), uses=("open", "high", "low"))
# an order for the open waits one more bar where there was none
outcome("run_moo", "decide(T, buy(A, 10 shares, moo)) :- signal(A, T).", "x AS (SELECT o.a, o.t1, z.t AS t2 FROM ord o LEFT JOIN rb z ON z.t0 = o.t1), y AS (SELECT x.a, CASE WHEN h.o IS NOT NULL THEN t1 ELSE t2 END AS t, coalesce(h.o, k.o) AS o FROM x LEFT JOIN ohl h ON h.a = x.a AND h.t = x.t1 LEFT JOIN ohl k ON k.a = x.a AND k.t = x.t2) SELECT t, a AS equity, 10.0::DOUBLE AS quantity, o AS price FROM y WHERE o IS NOT NULL", BASIC, ("quantity", "price"), uses=("open",))
# orders of the last bar are dropped, as no bar follows at which they could be looked at
outcome("run_moc", "decide(T, buy(A, 10 shares, moc)) :- signal(A, T).", "SELECT o.t, o.a AS equity, 10.0::DOUBLE AS quantity, p AS price FROM ord o JOIN close c ON c.a = o.a AND c.t = o.t", BASIC, ("quantity", "price"))

# sizing

outcome("run_target_weight", "decide(T, target_weight(A, 0.01)) :- signal(A, T).", "x AS (SELECT t1, a, p, 10000 / p AS q FROM got), y AS (SELECT *, q - coalesce(lag(q) OVER (PARTITION BY a ORDER BY t1), 0) AS n FROM x) SELECT t1 AS t, a AS equity, n AS quantity, p AS price FROM y WHERE n <> 0", BASIC, ("quantity", "price"), frictionless(lot="fractional"), mode="target")
# without a price an order that reduces fills at the last one, any other drops
outcome("run_target_quantity", "decide(T, target_quantity(A, Q)) :- signal(A, T), volume(A, T, Q).", "x AS (SELECT o.a, o.t1, v.v, row_number() OVER (PARTITION BY o.a ORDER BY o.t1) AS k FROM ord o JOIN volume v ON v.a = o.a AND v.t = o.t), o AS (SELECT x.*, c.t = x.t1 AS priced, c.p FROM x ASOF LEFT JOIN close c ON c.a = x.a AND x.t1 >= c.t), r AS (SELECT DISTINCT a, 0::BIGINT AS k, 0.0::DOUBLE AS pos, 0.0::DOUBLE AS n FROM x UNION ALL SELECT o.a, o.k, CASE WHEN priced OR v < pos THEN v ELSE pos END, CASE WHEN priced OR v < pos THEN v - pos ELSE 0 END FROM r JOIN o ON o.a = r.a AND o.k = r.k + 1) SELECT t1 AS t, o.a AS equity, n AS quantity, p AS price FROM r JOIN o ON o.a = r.a AND o.k = r.k WHERE n <> 0", BASIC, ("quantity", "price"), mode="target")

# costs and liquidity

outcome("run_participation", "decide(T, buy(A, 30 shares)) :- signal(A, T).", "x AS (SELECT t1, g.a, trunc(0.3::DOUBLE * v) AS cap, v FROM got g JOIN volume v ON v.a = g.a AND v.t = g.t1) SELECT t1 AS t, a AS equity, least(30.0::DOUBLE, cap) AS quantity, least(30.0::DOUBLE, cap) / v AS participation, cap < 30 AS partial FROM x WHERE cap > 0", "t equity quantity participation partial", ("quantity", "participation"), frictionless(participation_cap=0.3))
outcome("run_costs_buy", "decide(T, buy(A, 100 shares)) :- signal(A, T).", "SELECT t1 AS t, a AS equity, p * 1.0005::DOUBLE AS price, 2.0::DOUBLE AS commission, 0.0::DOUBLE AS fee, 100 * p * 0.0005::DOUBLE AS slippage FROM got", "t equity price commission fee slippage", ("price", "commission", "fee", "slippage"), frictionless(slippage_bps=5.0, commission_per_share=0.02, commission_min_per_order=1.0, fee_bps_on_sells=10.0))
outcome("run_costs_short", SHORT, "SELECT t1 AS t, a AS equity, p * 0.9995::DOUBLE AS price, 10 * p * 0.9995::DOUBLE * 0.0003::DOUBLE AS commission, 10 * p * 0.9995::DOUBLE * 0.001::DOUBLE AS fee, 10 * p * 0.0005::DOUBLE AS slippage FROM got", "t equity price commission fee slippage", ("price", "commission", "fee", "slippage"), frictionless(slippage_bps=5.0, commission_bps=3.0, fee_bps_on_sells=10.0))
outcome("run_impact", BUY, "v AS (SELECT v.a, b.i, v.v FROM volume v JOIN rb b ON b.t = v.t), g AS (SELECT got.*, b.i FROM got JOIN rb b ON b.t = got.t1), x AS (SELECT g.a, g.t1, any_value(g.p) AS p, avg(v.v) AS adv FROM g JOIN v ON v.a = g.a AND v.i BETWEEN g.i - 19 AND g.i GROUP BY 1, 2) SELECT t1 AS t, a AS equity, p * (1 + 0.1::DOUBLE * sqrt(10 / adv)) AS price, 10 * p * 0.1::DOUBLE * sqrt(10 / adv) AS impact FROM x", "t equity price impact", ("price", "impact"), frictionless(impact_coef=0.1))

# corporate actions

outcome("run_dividend", BUY, "x AS (SELECT d.a, d.ex, d.d, (SELECT 10.0::DOUBLE * count(*) FROM got g WHERE g.a = d.a AND g.t1 <= d.ex) AS q FROM dividend d JOIN rb ON rb.t = d.ex) SELECT ex AS t, a AS equity, q * d AS cash FROM x WHERE q > 0", "t equity cash", ("cash",), uses=("dividend",), kind="action", where="action = 'dividend'")
outcome("run_split_actions", BUY, "s AS (SELECT a, t FROM volume WHERE v >= 120) SELECT t, a AS equity, 'split' AS action, '2' AS detail FROM s WHERE EXISTS (SELECT 1 FROM got g WHERE g.a = s.a AND g.t1 <= s.t)", "t equity action detail", (), uses=("split",), kind="action")


@register("run_split_positions", _sql("s AS (SELECT a, t FROM volume WHERE v >= 120) SELECT a AS equity, sum(10.0::DOUBLE * 2 ** (SELECT count(*) FROM s WHERE s.a = g.a AND s.t >= g.t1)) AS shares FROM got g GROUP BY 1"), ("shares",), "equity shares")
def _(spark, d):
    """Shares at the end: each split doubles what was bought up to its bar."""
    final = _run(spark, _facts(spark, d), BUY, frictionless(), ("split",)).table("final")
    held = F.from_json(F.get_json_object("summary", "$.final_positions"), "map<string,double>")
    return final.select(F.explode(held).alias("equity", "shares"))


outcome("run_delisting", BUY, "e AS (SELECT min(t) AS t FROM rb WHERE t >= DATE '2000-01-01'), x AS (SELECT g.a, e.t, 10.0::DOUBLE * count(*) AS q FROM got g, e WHERE g.t1 <= e.t AND CAST(g.a AS INT) % 4 = 0 GROUP BY 1, 2) SELECT x.t, x.a AS equity, -q AS quantity, CASE WHEN CAST(x.a AS INT) % 8 = 0 THEN 0.0::DOUBLE ELSE c.p END AS price FROM x ASOF JOIN close c ON c.a = x.a AND x.t >= c.t", BASIC, ("quantity", "price"), uses=("delisted",), where="forced", facts=lambda m: {"signal": m["signal"].where("CAST(A AS INT) % 4 <> 0 OR T < DATE '2000-01-01'")})

# funding, leverage, margin

_HELD = "n AS (SELECT a, t1 AS t, 10.0::DOUBLE * count(*) AS n FROM got GROUP BY 1, 2), held AS (SELECT a, rb.t, t0, last_value(p IGNORE NULLS) OVER (PARTITION BY a ORDER BY rb.t) AS p, sum(n) OVER (PARTITION BY a ORDER BY rb.t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM (SELECT DISTINCT a FROM volume) CROSS JOIN rb LEFT JOIN close c USING (a, t) LEFT JOIN n USING (a, t))"


@register("run_borrow", _sql(f"{_HELD} SELECT sum(q * p * 0.01::DOUBLE * date_diff('day', t0, t) / 365) AS borrow_fees, sum(q * p * 0.02::DOUBLE * date_diff('day', t0, t) / 365) AS short_rebate FROM held"), ("borrow_fees", "short_rebate"), "borrow_fees short_rebate")
def _(spark, d):
    """What shorts cost and earn over calendar time."""
    config = frictionless(borrow=(BorrowBucket(math.inf, 100.0),), short_rebate=0.02)
    final = _run(spark, _facts(spark, d), SHORT, config).table("final")
    return final.select(*(F.get_json_object("summary", f"$.{k}").cast("double").alias(k) for k in ("borrow_fees", "short_rebate")))


outcome("run_not_shortable", SHORT, "v AS (SELECT v.a, b.i, v.v FROM volume v JOIN rb b ON b.t = v.t), g AS (SELECT got.*, b.i FROM got JOIN rb b ON b.t = got.t1), x AS (SELECT g.a, g.t1, any_value(g.p) AS p, avg(v.v) AS adv FROM g JOIN v ON v.a = g.a AND v.i BETWEEN g.i - 19 AND g.i GROUP BY 1, 2) SELECT t1 AS t, a AS equity, -10.0::DOUBLE AS quantity, p AS price FROM x WHERE adv >= 40", BASIC, ("quantity", "price"), frictionless(borrow=(BorrowBucket(40.0, 0.0, False), BorrowBucket(math.inf, 0.0))))


def _first(m: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The days of the supplier that ships first (the least number of that day) on which it has a price at the next bar."""
    bars = m["volume"].select("T").distinct().withColumn("next", F.lead("T").over(Window.orderBy("T")))
    after = m["close"].select(F.col("A").alias("B"), F.col("T").alias("next"))
    one = m["volume"].orderBy("T", "A").limit(1).select(F.col("A").alias("who"))
    days = m["close"].join(F.broadcast(one), F.col("A") == F.col("who")).join(bars, "T").join(after.withColumnRenamed("next", "n2"), (F.col("A") == F.col("B")) & (F.col("next") == F.col("n2")))
    return {"signal": days.select("A", "T")}


_ONE = "one AS (SELECT a FROM volume ORDER BY t, a LIMIT 1), f AS (SELECT c.a, c.t, rb.t AS t1, n.p, row_number() OVER (ORDER BY rb.t) AS k FROM close c JOIN one ON one.a = c.a JOIN rb ON rb.t0 = c.t JOIN close n ON n.a = c.a AND n.t = rb.t)"


outcome("run_leverage", "decide(T, buy(A, 10 shares)) :- signal(A, T).", f"{_ONE}, r AS (SELECT 0::BIGINT AS k, 0.0::DOUBLE AS q, false AS bought UNION ALL SELECT f.k, CASE WHEN (q + 10) * p <= 50000 + 1e-6 THEN q + 10 ELSE q END, (q + 10) * p <= 50000 + 1e-6 FROM r JOIN f ON f.k = r.k + 1) SELECT t1 AS t, a AS equity, 10.0::DOUBLE AS quantity, p AS price FROM r JOIN f ON f.k = r.k WHERE bought", BASIC, ("quantity", "price"), frictionless(initial_cash=50_000.0, max_gross=1.0, on_leverage="reject"), facts=_first)
outcome("run_margin", "decide(T, buy(A, Q)) :- signal(A, T), close(A, T, P), Q = 170000 USD / P.", f"{_ONE}, b AS (SELECT a, t1, 170000 / c.p AS q, f.p FROM f JOIN close c USING (a, t) WHERE k = 1), s AS (SELECT c.t, c.p, b.q AS q0, b.p AS p0, row_number() OVER (ORDER BY c.t) AS k FROM close c JOIN b ON b.a = c.a AND c.t >= b.t1), r AS (SELECT 0::BIGINT AS k, q AS held, 100000 - q * p AS cash, 0.0::DOUBLE AS sold FROM b UNION ALL SELECT k, held - cut, cash + cut * p, cut FROM (SELECT s.k, held, cash, s.p, CASE WHEN held * s.p > 0 AND cash + held * s.p > 0 AND cash + held * s.p < 0.25::DOUBLE * held * s.p - 1e-9 * held * s.p THEN held * (1 - (cash + held * s.p) / (0.25::DOUBLE * held * s.p)) ELSE 0 END AS cut FROM r JOIN s ON s.k = r.k + 1)) SELECT s.t, (SELECT a FROM b) AS equity, -sold AS quantity, s.p AS price FROM r JOIN s ON s.k = r.k WHERE sold > 0", BASIC, ("quantity", "price"), frictionless(initial_cash=100_000.0, on_margin_call="liquidate", lot="fractional"), where="forced", facts=lambda m: {"signal": (x := _first(m)["signal"]).orderBy("T").limit(1)})

for _name in ("run_leverage", "run_margin", "run_target_quantity"):
    ORACLE[_name] = ORACLE[_name].replace("FROM (WITH", "FROM (WITH RECURSIVE", 1)


# points of a study


@register("run_points", _sql("x AS (SELECT a, count(*) AS n FROM got GROUP BY 1) SELECT 'q' || q AS run_id, a AS equity, n * q::DOUBLE AS shares FROM x CROSS JOIN (VALUES (5), (10), (20)) g(q)"), ("shares",), "run_id equity shares")
def _(spark, d):
    """Three points of one strategy, run side by side."""
    points = [Point(f"q{q}", {"qty": float(q)}, frictionless()) for q in (5, 10, 20)]
    made = _run(spark, _facts(spark, d), "decide(T, buy(A, qty)) :- signal(A, T).", frictionless(), points=points, params="param qty : Quantity<Shares> = 10 shares")
    held = F.from_json(F.get_json_object("summary", "$.final_positions"), "map<string,double>")
    return made.table("final").select("run_id", F.explode(held).alias("equity", "shares"))
