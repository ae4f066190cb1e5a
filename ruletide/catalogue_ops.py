"""Registered queries that call an operator directly, and rule programs of the optional libraries."""

from __future__ import annotations

import math
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruletide.catalogue import NUDGE, ORACLE, QUERIES, daily, minute, rounded, rules
from ruletide.dsl.ast import Arg, Signature
from ruletide.loop.config import frictionless, reg_t
from ruletide.loop.run import Point, run
from ruletide.operators import asof, recursion
from ruletide.plans.library import library
from ruletide.plans.program import link
from ruletide.session import keep, shared_folder
from ruletide.sources import bundle, environment, ingest
from ruletide.sources import driver_tables as dt
from ruletide.streaming import fold
from ruletide.study import metrics

CLOSE = Signature("close", (Arg("+", "A", "Equity"), Arg("@", "T", "Timestamp"), Arg("-", "P", "Price", "USD")), "1d")


def register(name: str, oracle: str | None = None, doubles: tuple[str, ...] = (), columns: str = ""):
    """Register a query; the oracle's doubles are rounded as the query's are."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if oracle:
            names = columns.split()
            ORACLE[name] = f"SELECT {', '.join(f'round({c} + {NUDGE}, 4) AS {c}' if c in doubles else c for c in names)} FROM ({oracle})"
        return f

    return put


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dt.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("A"), F.to_date("l_shipdate").alias("T"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("P"))


def _securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier under one ticker to 1998, and under another from then on."""
    s = dt.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("n"))
    cut = F.lit("1998-01-01").cast("date")
    return s.select("id", F.col("n").alias("ticker"), F.lit("1995-06-01").cast("date").alias("from"), cut.alias("to")).union(s.select("id", F.concat(F.lit("X"), "n"), cut, F.lit(None).cast("date")))


_SEC = "sec AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS ticker, DATE '1995-06-01' AS f, DATE '1998-01-01' AS u FROM supplier UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'X' || s_name, DATE '1998-01-01', NULL FROM supplier)"
_ITEMS = "items AS (SELECT CAST(l_suppkey AS VARCHAR) AS a, CAST(l_shipdate AS DATE) AS t, l_extendedprice / l_quantity AS p FROM lineitem)"

# sources and their checks


@register("src_dup_check", f"WITH {_ITEMS} SELECT a, t, min(p) AS lo, max(p) AS hi FROM items GROUP BY 1, 2 HAVING min(p) <> max(p)", ("lo", "hi"), "a t lo hi")
def _(spark, d):
    c = environment.conflicts(_items(spark, d), CLOSE)
    return c.toDF("A", "T", "x", "y").select("A", "T", F.col("x.P").alias("lo"), F.col("y.P").alias("hi"))


@register("src_dedup", f"WITH {_ITEMS} SELECT DISTINCT a, t, p FROM items", ("p",), "a t p")
def _(spark, d):
    return environment.deduplicate(environment.typed(_items(spark, d), CLOSE))


@register("src_positive_price", f"WITH {_ITEMS} SELECT a, t, p - 300 AS p FROM items WHERE p <= 300 AND a <> '7'", ("p",), "a t p")
def _(spark, d):
    futures = spark.range(1).select(F.lit("7").alias("id"))
    return environment.bad_prices(_items(spark, d).withColumn("P", F.col("P") - 300), CLOSE, futures)


@register("src_unknown_id", "SELECT CAST(o_custkey AS VARCHAR) AS a, CAST(o_orderdate AS DATE) AS t FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier)", (), "a t")
def _(spark, d):
    o = dt.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("A"), F.to_date("o_orderdate").alias("T"))
    return environment.unknown_ids(o, CLOSE, _securities(spark, d))


@register("sec_ticker_range", daily(f"{_SEC} SELECT u.a, u.t, ticker AS s FROM universe u JOIN sec ON u.a = id AND f <= u.t AND (sec.u IS NULL OR u.t < sec.u)"), (), "a t s")
def _(spark, d):
    return environment.tickers(dt.market_1d(spark, d)["universe"], _securities(spark, d))


@register("sec_overlap", "WITH s AS (SELECT o_custkey::VARCHAR AS id, CAST(o_orderdate AS DATE) AS f, CAST(o_orderdate AS DATE) + 40 AS u, o_orderkey::VARCHAR AS ticker FROM orders), w AS (SELECT *, lag(u) OVER (PARTITION BY id ORDER BY f, u) AS l FROM s) SELECT 'two tickers at once' AS problem, id AS key, f AS \"from\" FROM w WHERE l > f", (), "problem key \"from\"")
def _(spark, d):
    s = dt.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("id"), F.col("o_orderkey").cast("string").alias("ticker"), F.to_date("o_orderdate").alias("from"), F.date_add(F.to_date("o_orderdate"), 40).alias("to"))
    return environment.identity_problems(s).select("problem", "key", F.to_date("from").alias("from"))


@register("src_truncate", daily("SELECT a, t, p FROM close WHERE t <= DATE '1998-06-30'"), ("p",), "a t p")
def _(spark, d):
    return environment.truncated(dt.market_1d(spark, d)["close"], CLOSE, "1998-06-30 12:00:00", "1d")


@register("src_available", daily("SELECT a, t, p FROM close WHERE greatest(CAST(t AS TIMESTAMP) + INTERVAL 1 DAY, CAST(t AS TIMESTAMP) + INTERVAL 60 HOUR) <= TIMESTAMP '1998-07-01 00:00:00'"), ("p",), "a t p")
def _(spark, d):
    late = dt.market_1d(spark, d)["close"].withColumn("available_at", F.col("T").cast("timestamp_ntz") + F.expr("INTERVAL '60' HOUR"))
    return environment.truncated(late, CLOSE, "1998-06-30 12:00:00", "1d").drop("available_at")


@register("asof_availability", daily("x AS (SELECT o.a, o.t, max(c.t) AS t0 FROM order_status o JOIN close c ON o.a = c.a AND c.t + 10 <= o.t GROUP BY 1, 2) SELECT x.a, x.t, x.t0, c.p FROM x JOIN close c ON c.a = x.a AND c.t = x.t0"), ("p",), "a t t0 p")
def _(spark, d):
    m = dt.market_1d(spark, d)
    right = m["close"].withColumnRenamed("T", "T0").withColumn("seen", F.date_add("T0", 10))
    return asof.asof_join(m["order_status"].select("A", "T"), right, ["A"], "T", "T0", visible=F.col("seen")).select("A", "T", "T0", "P")


@register("asof_strict", daily("x AS (SELECT o.a, o.t, max(c.t) AS t0 FROM order_status o JOIN close c ON o.a = c.a AND c.t < o.t GROUP BY 1, 2) SELECT x.a, x.t, x.t0, c.p FROM x JOIN close c ON c.a = x.a AND c.t = x.t0"), ("p",), "a t t0 p")
def _(spark, d):
    m = dt.market_1d(spark, d)
    return asof.asof_join(m["order_status"].select("A", "T"), m["close"].withColumnRenamed("T", "T0"), ["A"], "T", "T0", strict=True).select("A", "T", "T0", "P")


# ingestion


def _export(spark: SparkSession, d: str) -> ingest.DailyExport:
    p = dt.market_1d(spark, d)
    prices = p["close"].join(p["volume"], ["A", "T"]).select(F.concat(F.lit("S"), "A").alias("symbol"), F.col("T").alias("date"), *(F.col("P").alias(c) for c in ("open", "high", "low", "close")), F.col("V").alias("volume"))
    sup = dt.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"))
    day = lambda x: F.lit(x).cast("date")
    return ingest.DailyExport(
        prices,
        sup.select("id", "symbol", day("1995-01-01").alias("from"), F.when(F.col("id").cast("int") % 4 == 0, day("2000-01-01")).alias("to")),
        delistings=sup.where("CAST(id AS INT) % 4 = 0").select("symbol", day("2000-01-01").alias("date"), F.lit("acquisition").alias("reason")),
        membership=sup.where("CAST(id AS INT) % 2 = 0").select("symbol", F.lit("IDX").alias("index"), day("1996-01-01").alias("from"), day("1996-12-31").alias("to")),
    )


_EXPORT = "known AS (SELECT * FROM close WHERE CAST(a AS INT) % 4 <> 0 OR t < DATE '2000-01-01'), days AS (SELECT DISTINCT t FROM known)"


@register("ingest_universe", daily(f"{_EXPORT} SELECT a, t, p FROM known"), ("p",), "a t p")
def _(spark, d):
    r = _export(spark, d).relations()
    return r["universe"].join(r["close"], ["A", "T"])


@register("ingest_delisted", daily(f"{_EXPORT} SELECT CAST(s_suppkey AS VARCHAR) AS a, t, 'acquisition' AS reason FROM supplier CROSS JOIN days WHERE s_suppkey % 4 = 0 AND t >= DATE '2000-01-01'"), (), "a t reason")
def _(spark, d):
    return _export(spark, d).relations()["delisted"]


@register("ingest_member", daily(f"{_EXPORT} SELECT CAST(s_suppkey AS VARCHAR) AS a, t, 'IDX' AS idx FROM supplier CROSS JOIN days WHERE s_suppkey % 2 = 0 AND t BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'"), (), "a t idx")
def _(spark, d):
    return _export(spark, d).relations()["member"]


@register("ingest_minute", "SELECT CAST(user_id AS VARCHAR) AS a, ts + INTERVAL 1 MINUTE AS t, value AS p, greatest(ts + INTERVAL 1 MINUTE, ts + INTERVAL 90 SECOND) + INTERVAL 5 SECOND AS available_at FROM events", ("p",), "a t p available_at")
def _(spark, d):
    e = dt.table(spark, d, "events").withColumn("sym", F.col("user_id").cast("string"))
    bars = e.select(F.col("ts").alias("ts_event"), F.col("sym").alias("instrument_id"), *(F.col("value").alias(c) for c in ("open", "high", "low", "close")), F.lit(1.0).alias("volume"), (F.col("ts") + F.expr("INTERVAL '90' SECOND")).alias("ts_recv"))
    book = e.select(F.col("sym").alias("id"), F.col("sym").alias("symbol")).distinct().select("id", "symbol", F.lit("2000-01-01").cast("date").alias("from"), F.lit(None).cast("date").alias("to"))
    return ingest.minute_export(bars, book, 5)["close_m"]


@register("ingest_weekly", daily("SELECT c.a, max(c.t) AS t, arg_max(p, c.t) AS p, avg(p * v) AS d FROM close c JOIN volume v ON c.a = v.a AND c.t = v.t GROUP BY c.a, date_trunc('week', c.t)"), ("p", "d"), "a t p d")
def _(spark, d):
    m = dt.market_1d(spark, d)
    return ingest.weekly(m["close"].join(m["volume"], ["A", "T"]))


@register("ingest_latest", "SELECT o_custkey AS c, max(o_orderkey) AS k FROM orders GROUP BY 1", (), "c k")
def _(spark, d):
    o = dt.table(spark, d, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"))
    return ingest.latest_version(o, ["c"], "k")


@register("ingest_ticker_runs", daily("x AS (SELECT a AS id, t, s AS ticker, CASE WHEN lag(s) OVER w IS NOT DISTINCT FROM s THEN 0 ELSE 1 END AS n FROM order_status WINDOW w AS (PARTITION BY a ORDER BY t)), r AS (SELECT *, sum(n) OVER (PARTITION BY id ORDER BY t) AS run FROM x), g AS (SELECT id, ticker, run, min(t) AS f FROM r GROUP BY 1, 2, 3) SELECT id, ticker, f AS \"from\", lead(f) OVER (PARTITION BY id ORDER BY f) AS \"to\" FROM g"), (), 'id ticker "from" "to"')
def _(spark, d):
    return ingest.ticker_runs(dt.market_1d(spark, d)["order_status"].select(F.col("A").alias("id"), "T", F.col("S").alias("ticker")))


@register("ingest_sessions", minute("s AS (SELECT *, CAST(t AS DATE) AS d, min(t) OVER (PARTITION BY a, CAST(t AS DATE)) AS s FROM tick) SELECT a, d, arg_min(p, t) AS open, arg_max(p, t) AS close, arg_max(p, t) FILTER (t <= s + INTERVAL 120 MINUTE) AS close120, max(p) AS high, min(p) AS low FROM s GROUP BY 1, 2"), ("open", "close", "close120", "high", "low"), "a d open close close120 high low")
def _(spark, d):
    return ingest.sessions(dt.market_1m(spark, d)["tick"], 120)


# bundle tests


@register("bt_bar_labels", daily("SELECT a, t, p FROM close WHERE isodow(t) >= 6 OR t NOT IN (SELECT t FROM split)"), ("p",), "a t p")
def _(spark, d):
    m = dt.market_1d(spark, d)
    return bundle.bar_labels(m["close"], m["split"])


@register("bt_action_reconciliation", daily("x AS (SELECT a, t, p, lag(p) OVER (PARTITION BY a ORDER BY t) AS p0 FROM close), y AS (SELECT x.*, s.factor AS f, g.d FROM x LEFT JOIN split s ON x.a = s.a AND x.t = s.t LEFT JOIN (SELECT a, ex, sum(d) AS d FROM dividend GROUP BY 1, 2) g ON g.a = x.a AND g.ex = x.t WHERE p0 IS NOT NULL), z AS (SELECT *, p / p0 AS ratio, abs(p / p0 * coalesce(f, 0) - 1) <= 0.25::DOUBLE OR (p + coalesce(d, 0)) / p0 BETWEEN 0.6::DOUBLE AND 1.67::DOUBLE AS ok FROM y) SELECT a, t, p0, p, ratio FROM z WHERE NOT ok AND (f IS NOT NULL OR ratio NOT BETWEEN 0.6::DOUBLE AND 1.67::DOUBLE)"), ("p0", "p", "ratio"), "a t p0 p ratio")
def _(spark, d):
    m = dt.market_1d(spark, d)
    return bundle.action_reconciliation(m["close"], m["split"], m["dividend"])


@register("bt_delisting", daily("SELECT a, max(t) AS last_t FROM close WHERE a NOT IN (SELECT a FROM split) GROUP BY 1 HAVING max(t) < (SELECT max(t) FROM close)"), (), "a last_t")
def _(spark, d):
    m = dt.market_1d(spark, d)
    return bundle.delisting_coverage(m["close"], m["split"], m["close"])


@register("bt_membership", daily("SELECT a, t, idx FROM member m WHERE NOT EXISTS (SELECT 1 FROM universe u WHERE u.a = m.a AND u.t = m.t)"), (), "a t idx")
def _(spark, d):
    m = dt.market_1d(spark, d)
    return bundle.membership(m["member"], m["universe"])


# recursion as operators


@register("rec_latch_window", daily("x AS (SELECT a, t, last_value(CASE WHEN p > 1900 THEN 1 WHEN p <= 1200 THEN 0 END IGNORE NULLS) OVER (PARTITION BY a ORDER BY t) AS e FROM close) SELECT a, t, coalesce(e, 0)::INT AS l FROM x"), (), "a t l")
def _(spark, d):
    rows = dt.market_1d(spark, d)["close"]
    return recursion.latch(rows, ["A"], "T", F.col("P") > 1900, F.col("P") > 1200).select("A", "T", F.col("on").alias("L"))


# statistics: one curve for each nation, its monthly turnover


def _curves(spark: SparkSession, d: str) -> DataFrame:
    s = dt.table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("k"))
    items = dt.table(spark, d, "lineitem").select("l_suppkey", F.date_trunc("month", "l_shipdate").alias("t"), "l_extendedprice")
    by = items.groupBy("l_suppkey", "t").agg(F.sum("l_extendedprice").alias("e"))  # combined before the join
    return by.join(s, by["l_suppkey"] == s["s_suppkey"]).groupBy("k", F.to_date("t").alias("t")).agg(F.sum("e").alias("e"))


_CURVES = "c AS (SELECT CAST(s_nationkey AS VARCHAR) AS k, CAST(date_trunc('month', l_shipdate) AS DATE) AS t, sum(l_extendedprice) AS e FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"
_RETURNS = f"WITH {_CURVES}, r AS (SELECT k, t, e, e / lag(e) OVER (PARTITION BY k ORDER BY t) - 1 AS r, max(e) OVER (PARTITION BY k ORDER BY t) AS peak, row_number() OVER (PARTITION BY k ORDER BY t) AS i FROM c)"


@register("mt_drawdown", f"{_RETURNS} SELECT k, t, e, peak, 1 - e / peak AS drawdown FROM r", ("e", "peak", "drawdown"), "k t e peak drawdown")
def _(spark, d):
    return metrics.drawdowns(_curves(spark, d), "k", "t", "e")


@register("mt_returns", f"{_RETURNS} SELECT k, count(r)::DOUBLE AS n, arg_max(e, t) / arg_min(e, t) - 1 AS total_return, stddev_samp(r) * sqrt(12.0::DOUBLE) AS volatility, avg(r) / stddev_samp(r) * sqrt(12.0::DOUBLE) AS sharpe, avg(r) / sqrt(avg(least(r, 0) ** 2) FILTER (r IS NOT NULL)) * sqrt(12.0::DOUBLE) AS sortino, max(1 - e / peak) AS max_drawdown, min(r) AS worst_month FROM r GROUP BY 1 HAVING count(r) > 1", ("n", "total_return", "volatility", "sharpe", "sortino", "max_drawdown", "worst_month"), "k n total_return volatility sharpe sortino max_drawdown worst_month")
def _(spark, d):
    m = metrics.curve_metrics(_curves(spark, d), "k", "t", "e", 12.0).where("n > 1")
    return m.select("k", "n", "total_return", "volatility", "sharpe", "sortino", "max_drawdown", "worst_month")


@register("mt_moments", f"{_RETURNS}, m AS (SELECT k, avg(r) AS mu FROM r GROUP BY 1), z AS (SELECT r.k, i, r - mu AS x FROM r JOIN m USING (k) WHERE r IS NOT NULL), y AS (SELECT *, lag(x) OVER (PARTITION BY k ORDER BY i) AS x1 FROM z) SELECT k, sum(x * x1) / sum(x * x) AS autocorrelation_1, avg(x ** 3) / avg(x ** 2) ** 1.5::DOUBLE AS skew, avg(x ** 4) / avg(x ** 2) ** 2 - 3 AS kurtosis FROM y GROUP BY 1 HAVING count(x) > 1", ("autocorrelation_1", "skew", "kurtosis"), "k autocorrelation_1 skew kurtosis")
def _(spark, d):
    return metrics.curve_metrics(_curves(spark, d), "k", "t", "e", 12.0).where("n > 1").select("k", "autocorrelation_1", "skew", "kurtosis")


_PBO = f"""{_RETURNS},
m AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i FROM (SELECT DISTINCT t FROM r WHERE r IS NOT NULL)), n AS (SELECT count(*) // 16 AS block FROM m),
b AS (SELECT m.i // block AS b, k.k, sum(coalesce(r.r, 0)) AS s1, sum(coalesce(r.r, 0) ** 2) AS s2 FROM m, n, (SELECT DISTINCT k FROM r) k LEFT JOIN r ON r.k = k.k AND r.t = m.t WHERE m.i < 16 * block GROUP BY 1, 2),
h AS (SELECT c, k, sum(s1) FILTER (c >> b & 1 = 1) AS a1, sum(s2) FILTER (c >> b & 1 = 1) AS a2, sum(s1) FILTER (c >> b & 1 = 0) AS b1, sum(s2) FILTER (c >> b & 1 = 0) AS b2 FROM (SELECT range AS c FROM range(65536) WHERE bit_count(range) = 8), b GROUP BY 1, 2),
z AS (SELECT c, k, 8 * block AS n, a1, b1, greatest(0, (a2 - a1 ** 2 / (8 * block)) / (8 * block - 1)) AS va, greatest(0, (b2 - b1 ** 2 / (8 * block)) / (8 * block - 1)) AS vb FROM h, n),
e AS (SELECT c, k, CASE WHEN va > 0 THEN a1 / n / sqrt(va) ELSE 0 END AS inside, CASE WHEN vb > 0 THEN b1 / n / sqrt(vb) ELSE 0 END AS outside FROM z),
p AS (SELECT c, arg_max(outside, inside) AS got FROM e GROUP BY 1),
o AS (SELECT e.c, (1 + count(*) FILTER (outside < got)) / (count(*) + 1.0::DOUBLE) AS w, count(*) AS trials FROM e JOIN p ON e.c = p.c GROUP BY 1)
SELECT avg((w <= 0.5)::INT) AS pbo, count(*) AS combinations, any_value(trials) AS trials, 16::BIGINT AS partitions, avg(ln(w / (1 - w))) AS mean_logit FROM o"""


@register("mt_pbo", _PBO, ("pbo", "mean_logit"), "pbo combinations trials partitions mean_logit")
def _(spark, d):
    """Overfitting of choosing one nation's curve; a month without a return counts as none, so no curve is left out."""
    r = F.expr("e / lag(e) OVER (PARTITION BY k ORDER BY t) - 1")
    rows = _curves(spark, d).select(F.lit(1).alias("g"), "k", "t", r.alias("r")).where("r IS NOT NULL")

    def one(pdf):
        import pandas as pd

        p = metrics.pbo(pdf.pivot(index="t", columns="k", values="r").fillna(0.0).sort_index().to_numpy(), 16)
        return pd.DataFrame([vars(p)] if p else [], columns=["pbo", "combinations", "trials", "partitions", "mean_logit"])

    # one row for each month and nation: a study's returns, not its data
    return rows.groupBy("g").applyInPandas(one, "pbo double, combinations long, trials long, partitions long, mean_logit double")


# closed-loop runs


_RUN = """strategy s { env market_1d uses features resolution @1d mode delta
  param qty : Quantity<Shares> = 10 shares
  rel above(-A: Equity, @T: Timestamp)
  rel below(-A: Equity, @T: Timestamp)
  above(A, T) :- universe(A, T), sma(A, T, 20d, 4, F), sma(A, T, 60d, 8, S), F > S.
  below(A, T) :- universe(A, T), sma(A, T, 20d, 4, F), sma(A, T, 60d, 8, S), F <= S.
  decide(T, buy(A, qty)) :- above(A, T), flat(A, T).
  decide(T, sell(A, Q)) :- below(A, T), held(A, T, Q). }"""
_TARGET = """strategy s { env market_1d uses features resolution @1d mode target
  rel pick(-A: Equity, @T: Timestamp)
  rel c(-A: Equity, @T: Timestamp, -V: Quantity<Shares>)
  c(A, T, V) :- universe(A, T), volume(A, T, V).
  pick(A, T) :- month_start(T), top(5, c(A, T, V), by (V desc, A asc)).
  rel first(@T: Timestamp)
  first(T) :- bar(T), month_start(T).
  decide(T, target_weight(A, 0.1)) :- pick(A, T).
  decide(T, target_weight(A, 0)) :- first(T), held(A, T, _), not pick(A, T). }"""


def _market(spark, d):
    return {k: v for k, v in dt.market_1d(spark, d).items() if k not in ("dividend", "split")}


@register("run_sma_crossover")
def _(spark, d):
    return run(spark, dt.ENV_1D + library("features", "market_1d") + _RUN, _market(spark, d), [Point("run", {}, frictionless())]).table("fill").select("t", "equity", "quantity", "price")


@register("run_grid")
def _(spark, d):
    points = [Point(f"q{q}", {"qty": float(q)}, reg_t()) for q in (5, 10, 20)]
    return run(spark, dt.ENV_1D + library("features", "market_1d") + _RUN, _market(spark, d), points).table("nav").groupBy("run_id").agg(F.count("*").alias("bars"), F.max_by("equity_value", "t").alias("final"))


@register("run_monthly_targets")
def _(spark, d):
    return run(spark, dt.ENV_1D + library("features", "market_1d") + _TARGET, _market(spark, d), [Point("run", {}, frictionless(lot="fractional"))]).table("nav").select("t", "equity_value", "cash", "gross", "leverage")


# streams


def _sink(spark: SparkSession) -> str:
    """A folder that all executors share: under the checkpoint folder of the session."""
    return os.path.join(shared_folder(spark), f"stream-{uuid.uuid4()}")


def _drain(spark: SparkSession, df: DataFrame) -> DataFrame:
    out = _sink(spark)
    df.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").option("path", f"{out}/rows").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/rows")


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    path = f"{d}/{name}.parquet"
    # a pattern, since a stream source takes a folder or a pattern but not one file
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{d}/{name}.parque[t]")


@register("stream_resample", "WITH e AS (SELECT event_type, time_bucket(INTERVAL '1 hour', ts - INTERVAL '1 microsecond') + INTERVAL '1 hour' AS bar, value FROM events) SELECT event_type, bar, count(*) AS n, sum(value) AS v FROM e GROUP BY 1, 2 HAVING bar <= (SELECT max(ts) - INTERVAL '1 microsecond' - INTERVAL '10 minutes' FROM events)", ("v",), "event_type bar n v")
def _(spark, d):
    made = fold.resample_stream(_stream(spark, d, "events"), "ts", ["event_type"], "1 hour", "10 minutes", [F.sum("value").alias("v")])
    return _drain(spark, made).select("event_type", F.col("bar").cast("timestamp_ntz").alias("bar"), "n", "v")


EVENTS_A_FOLD = 25_000
_FOLD = """strategy s { env market_1m resolution @1h mode delta
  rel up(-A: Equity, @T: Timestamp, -N: Count)
  up(A, T, N) :- resample(tick(A, U, P) to @1h as T, min 1, N = count(U)).
  decide(T, buy(A, 1 shares)) :- up(A, T, N), N >= 3. }"""


@register("stream_fold", minute("SELECT time_bucket(INTERVAL '1 hour', t - INTERVAL '1 microsecond') + INTERVAL '1 hour' AS t, a AS equity, 1.0::DOUBLE AS amount FROM tick GROUP BY 1, 2 HAVING count(*) >= 3"), ("amount",), "t equity amount")
def _(spark, d):
    """Hourly decisions over the minute ticks of all users, by the streaming fold."""
    text = dt.ENV_1M + _FOLD
    facts = {"tick": dt.market_1m(spark, d)["tick"]}
    program, config = link(text), frictionless()
    log = keep(fold.event_log(program, facts))
    path = _sink(spark)
    end = log.groupBy("run_id").agg(F.max("t").alias("t"), F.max("avail").alias("avail")).select("run_id", F.lit(fold.END).alias("rel"), "t", "avail", F.lit("{}").alias("payload"))
    # users have nothing to do with one another, so each part of them is folded for itself
    parts = math.ceil(log.count() / EVENTS_A_FOLD) if fold.parts_apart(program, config) else 1
    whole = log.union(end)
    (fold.deal(whole, program, parts) if parts > 1 else whole).write.parquet(f"{path}/log")
    events = spark.readStream.schema(fold.LOG).parquet(f"{path}/log")
    out = _drain(spark, fold.stream(events, text, config))
    return out.where("kind = 'decision'").select("t", F.get_json_object("payload", "$.equity").alias("equity"), F.get_json_object("payload", "$.amount").cast("double").alias("amount"))


# sinks: written to the shared folder and read back with their checks


_STORE = """environment store { close(+A: Equity, @T: Timestamp, -P: Price<USD>) @1d  universe(-A: Equity, @T: Timestamp) @1d complete
  ticker(+A: Equity, @T: Timestamp, -S: Label) @1d complete } library l { env store resolution @1d }"""


@register("snk_dataset", daily("SELECT a, t, p FROM close"), ("p",), "a t p")
def _(spark, d):
    path, m = _sink(spark), dt.market_1d(spark, d)
    environment.write({"close": m["close"], "universe": m["universe"]}, path)
    return environment.read(spark, link(_STORE).env, path)[0]["close"]


@register("snk_bundle", daily("SELECT a, t, p FROM close WHERE t >= DATE '1996-03-01' AND t < DATE '1996-06-01'"), ("p",), "a t p")
def _(spark, d):
    """A bundle by month; the months asked for are the only ones read."""
    path, m, env = _sink(spark), dt.market_1d(spark, d), link(_STORE).env
    bundle.write(spark, env, {"close": m["close"], "universe": m["universe"]}, _securities(spark, d), path, "2002-01-01")
    return bundle.read(spark, env, path, "1996-03", "1996-05", untested=True)[0]["close"]


# the optional libraries: windows and cross-sections by name, lowered to the same operators

_seen = "rel seen(+A: Equity, @T: Timestamp) seen(A, T) :- universe(A, T), prev(T, U), universe(A, _) asof U."

rules("lib_cumsum", f"{_seen} rel r(+A: Equity, @T: Timestamp, -S: Quantity<Shares>) r(A, T, S) :- universe(A, T), volume(A, T, S), not seen(A, T). r(A, T, S) :- seen(A, T), prev(T, U), volume(A, T, V), r(A, _, X) asof U, S = X + V.", "r", daily("SELECT u.a, u.t, sum(v) OVER (PARTITION BY u.a ORDER BY u.t) AS s FROM universe u JOIN volume v ON u.a = v.a AND u.t = v.t"))
rules("lib_zscore_xs", "rel r(-A: Equity, @T: Timestamp, -Z: Scalar) r(A, T, Z) :- close(A, T, P), M = mean(Q) over (close(_, T, Q)), S = std(Q) over (close(_, T, Q)), Z = (P - M) / S.", "r", daily("w AS (SELECT a, t, p, avg(p) OVER x AS m, stddev_samp(p) OVER x AS s, count(*) OVER x AS n FROM close WINDOW x AS (PARTITION BY t)) SELECT a, t, (p - m) / s AS z FROM w WHERE n > 1 AND s > 0"))
rules("lib_decile", "rel n(@T: Timestamp, -N: Count) rel k(-A: Equity, @T: Timestamp, -K: Scalar) rel r(-A: Equity, @T: Timestamp, -D: Scalar) n(T, N) :- N = count(A) over (close(A, T, _)), N > 0. k(A, T, K) :- rank(close(A, T, P), by (P asc), ties average, as K). r(A, T, D) :- k(A, T, K), n(T, N), D = K / N * 10.", "r", daily("SELECT a, t, (rank() OVER (PARTITION BY t ORDER BY p) + (count(*) OVER (PARTITION BY t, p) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY t) * 10 AS d FROM close"))
rules("lib_share_above", "rel r(@T: Timestamp, -S: Scalar) rel bar(@T: Timestamp) bar(T) :- close(_, T, _). r(T, S) :- bar(T), N = count(A) over (close(A, T, _)), K = count(A) over (close(A, T, P), P > 1500 USD/share), S = K / N.", "r", daily("SELECT t, count(*) FILTER (p > 1500) / count(*)::DOUBLE AS s FROM close GROUP BY 1"))
rules("lib_prev_row", "rel r(+A: Equity, @T: Timestamp, -P: Price<USD>) r(A, T, P) :- universe(A, T), prev(T, U), close(A, _, P) asof U.", "r", daily("x AS (SELECT u.a, u.t, max(c.t) AS k FROM universe u JOIN bars b ON u.t = b.t JOIN close c ON c.a = u.a AND c.t <= b.t0 GROUP BY 1, 2) SELECT x.a, x.t, p FROM x JOIN close c ON c.a = x.a AND c.t = x.k"))
rules("lib_max_rows", "rel r(+A: Equity, @T: Timestamp, -H: Price<USD>, -L: Price<USD>) r(A, T, H, L) :- universe(A, T), H = max(P) over (U in rows(T, 5, min 1), close(A, U, P)), L = min(P) over (U in rows(T, 5, min 1), close(A, U, P)).", "r", daily("x AS (SELECT c.a, c.t, p, u.a IS NOT NULL AS base FROM close c LEFT JOIN universe u ON c.a = u.a AND c.t = u.t), w AS (SELECT *, max(p) OVER f AS h, min(p) OVER f AS l FROM x WINDOW f AS (PARTITION BY a ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT a, t, h, l FROM w WHERE base"))
rules("lib_bars_held", "rel on(+A: Equity, @T: Timestamp) on(A, T) :- close(A, T, P), universe(A, T), P > 1300 USD/share. rel was(+A: Equity, @T: Timestamp) was(A, T) :- on(A, T), prev(T, U), on(A, U). rel r(+A: Equity, @T: Timestamp, -K: Scalar) r(A, T, 1) :- on(A, T), not was(A, T). r(A, T, K) :- was(A, T), prev(T, U), r(A, U, J), K = J + 1.", "r", daily("o AS (SELECT u.a, u.t FROM universe u JOIN close c ON u.a = c.a AND u.t = c.t WHERE p > 1300), b AS (SELECT t, row_number() OVER (ORDER BY t) AS i FROM bars), x AS (SELECT a, o.t, i - row_number() OVER (PARTITION BY a ORDER BY o.t) AS g FROM o JOIN b ON o.t = b.t) SELECT a, t, row_number() OVER (PARTITION BY a, g ORDER BY t)::DOUBLE AS k FROM x"))
