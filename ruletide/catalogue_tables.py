"""Registered queries of sinks, sources, statistics and rule forms that the other catalogues do not reach."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ruletide.catalogue import ORACLE, daily, minute, rules
from ruletide.catalogue_ops import _RETURNS, _SEC, _STORE, _curves, _securities, _sink, register
from ruletide.catalogue_runs import _HELD, BUY, _facts, _run, _sql
from ruletide.loop.config import frictionless
from ruletide.loop.run import RunResult, run, write_ledger
from ruletide.plans.program import link
from ruletide.sources import bundle, environment, tables
from ruletide.sources import driver_tables as dt
from ruletide.sources.ingest import Synthetic
from ruletide.study import metrics, study

# rule forms

rules("exp_time_copy", "rel r(-A: Equity, @T: Timestamp, -E: Timestamp) r(A, T, E) :- split(A, T, _), E = T.", "r", daily("SELECT a, t, t AS e FROM split"))
rules("rs_bound_label", "rel r(+A: Equity, @T: Timestamp, -N: Count) r(A, T, N) :- high_d(A, T, H), H >= 400 USD/share, resample(tick(A, U, P) to @1d as T, min 1, N = count(U)).", "r", minute("SELECT a, CAST(t AS DATE) AS t, count(*) AS n FROM tick GROUP BY 1, 2 HAVING count(*) >= 3 AND max(p) >= 400"), env="1m1d", uses=("bars",))
rules("rs_domain", "rel r(+A: Equity, @T: Timestamp, -U: Timestamp) r(A, T, U) :- close_d(A, T, _), prev(T, U).", "r", minute("d AS (SELECT t, lag(t) OVER (ORDER BY t) AS u FROM (SELECT DISTINCT CAST(t AS DATE) AS t FROM tick)), c AS (SELECT a, CAST(t AS DATE) AS t FROM tick GROUP BY 1, 2 HAVING count(*) >= 3) SELECT c.a, c.t, u FROM c JOIN d ON c.t = d.t WHERE u IS NOT NULL"), env="1m1d", uses=("bars",))
rules("win_late_literal", "rel r(+A: Equity, @T: Timestamp, -M: Price<USD>) r(A, T, M) :- universe(A, T), M = mean(P) over (close(A, U, P), U in window(T, 15d, min 2)).", "r", daily("x AS (SELECT coalesce(u.a, c.a) AS a, coalesce(u.t, c.t) AS t, u.a IS NOT NULL AS base, c.p AS x FROM universe u FULL JOIN close c ON u.a = c.a AND u.t = c.t), w AS (SELECT a, t, base, avg(x) OVER f AS m, count(x) OVER f AS n FROM x WINDOW f AS (PARTITION BY a ORDER BY t RANGE BETWEEN INTERVAL 15 DAY PRECEDING AND CURRENT ROW)) SELECT a, t, m FROM w WHERE base AND n >= 2"))
_LONG = "x AS (SELECT coalesce(u.a, c.a) AS a, coalesce(u.t, c.t) AS t, u.a IS NOT NULL AS base, c.p AS x, v.v AS y FROM universe u FULL JOIN (close c JOIN volume v ON c.a = v.a AND c.t = v.t) ON u.a = c.a AND u.t = c.t), w AS (SELECT a, t, base, avg(x) OVER f AS m, sum(y) OVER f AS v, stddev_samp(x) OVER f AS d, corr(x / 1000, y / 10) OVER f AS c, regr_slope(x / 1000, y / 10) OVER f AS b, covar_samp(x / 1000, y / 10) OVER f AS z, count(x) OVER f AS n FROM x WINDOW f AS (PARTITION BY a ORDER BY t"
_LONG_RULE = "rel r(+A: Equity, @T: Timestamp, -M: Price<USD>, -V: Quantity<Shares>, -D: Price<USD>, -C: Scalar, -B: Scalar, -Z: Scalar, -N: Count) r(A, T, M, V, D, C, B, Z, N) :- universe(A, T), M = mean(P) over (U in {0}, close(A, U, P), volume(A, U, Q)), V = sum(Q) over (U in {0}, close(A, U, P), volume(A, U, Q)), D = std(P) over (U in {0}, close(A, U, P), volume(A, U, Q)), C = corr(P / 1000 USD/share, Q / 10 shares) over (U in {0}, close(A, U, P), volume(A, U, Q)), B = ols_beta(P / 1000 USD/share, Q / 10 shares) over (U in {0}, close(A, U, P), volume(A, U, Q)), Z = cov(P / 1000 USD/share, Q / 10 shares) over (U in {0}, close(A, U, P), volume(A, U, Q)), N = count(P) over (U in {0}, close(A, U, P), volume(A, U, Q))."
rules("win_running_time", _LONG_RULE.format("window(T, 2y, min 12)"), "r", daily(f"{_LONG} RANGE BETWEEN INTERVAL 24 MONTH PRECEDING AND CURRENT ROW)) SELECT a, t, m, v, d, c, b, z, n FROM w WHERE base AND n >= 12"))
rules("win_running_rows", _LONG_RULE.format("rows(T, 300, min 12)"), "r", daily(f"{_LONG} ROWS BETWEEN 299 PRECEDING AND CURRENT ROW)) SELECT a, t, m, v, d, c, b, z, n FROM w WHERE base AND n >= 12"))
rules("win_running_prior", "rel r(+A: Equity, @T: Timestamp, -M: Price<USD>, -D: Price<USD>) r(A, T, M, D) :- universe(A, T), M = mean(P) over (U in prior_window(T, 2y, min 3), close(A, U, P)), D = std(P) over (U in prior_window(T, 2y, min 3), close(A, U, P)).", "r", daily("x AS (SELECT coalesce(u.a, c.a) AS a, coalesce(u.t, c.t) AS t, u.a IS NOT NULL AS base, c.p AS x FROM universe u FULL JOIN close c ON u.a = c.a AND u.t = c.t), w AS (SELECT a, t, base, avg(x) OVER f AS m, stddev_samp(x) OVER f AS d, count(x) OVER f AS n FROM x WINDOW f AS (PARTITION BY a ORDER BY t RANGE BETWEEN INTERVAL 24 MONTH PRECEDING AND INTERVAL 1 DAY PRECEDING)) SELECT a, t, m, d FROM w WHERE base AND n >= 3"))


@register("run_bought_within", _sql("s AS (SELECT a, t, row_number() OVER (PARTITION BY a ORDER BY t) AS k FROM sig), r AS (SELECT DISTINCT a, 0::BIGINT AS k, NULL::DATE AS last, false AS took FROM sig UNION ALL SELECT s.a, s.k, CASE WHEN last IS NULL OR last < s.t - INTERVAL 40 DAY THEN s.t ELSE last END, last IS NULL OR last < s.t - INTERVAL 40 DAY FROM r JOIN s ON s.a = r.a AND s.k = r.k + 1) SELECT s.t, s.a AS equity, 'buy' AS ctor, 10.0::DOUBLE AS amount FROM r JOIN s ON s.a = r.a AND s.k = r.k WHERE took"), ("amount",), "t equity ctor amount")
def _(spark, d):
    """Decisions that look at the book's own earlier ones, by the constructor's pattern over a window."""
    decide = "rel lately(+A: Equity, @T: Timestamp) lately(A, T) :- signal(A, T), C = count(U) over (U in prior_window(T, 40d, min 1), decided(U, buy(A, _))), C > 0. decide(T, buy(A, 10 shares)) :- signal(A, T), not lately(A, T)."
    return _run(spark, _facts(spark, d), decide, frictionless()).table("decision").select(F.to_date("t").alias("t"), "equity", "ctor", "amount")


ORACLE["run_bought_within"] = ORACLE["run_bought_within"].replace("FROM (WITH", "FROM (WITH RECURSIVE", 1)

# sinks


@register("snk_text_table", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation", (), "n_nationkey n_name n_regionkey")
def _(spark, d):
    path = f"{_sink(spark)}/nation"
    tables.write(dt.table(spark, d, "nation"), path, text=True, files=1)
    return spark.read.parquet(path).select("n_nationkey", "n_name", "n_regionkey")


@register("snk_returns", f"{_RETURNS} SELECT k, t, r, e - lag(e) OVER (PARTITION BY k ORDER BY t) AS profit FROM r QUALIFY r IS NOT NULL", ("r", "profit"), "k t r profit")
def _(spark, d):
    """The period-returns file of the nations' curves."""
    path = _sink(spark)
    metrics.write_returns(_curves(spark, d), path, "k", "t", "e")
    return spark.read.parquet(path).withColumn("t", F.to_date("t"))


_LEDGER = "rel held(-A: Equity, @T: Timestamp, -Q: Quantity<Shares>) held(A, T, Q) :- position(A, T, Q), Q > 0 shares. decide(T, sell(A, Q)) :- held(A, T, Q), Q > 1000000000 shares."


@register("snk_ledger", _sql(f"{_HELD}, x AS (SELECT h.a, h.t, coalesce(h.q, 0) + coalesce(n.n, 0) AS q FROM held h LEFT JOIN n ON n.a = h.a AND n.t = h.t) SELECT a, t, q FROM x WHERE q > 0"), ("q",), "a t q")
def _(spark, d):
    """What is held at every bar, written as a ledger of the run."""
    path, facts = _sink(spark), _facts(spark, d)
    names = ("close", "volume", "signal")
    from ruletide.catalogue_runs import _RELATIONS

    program = link("environment market_run { " + " ".join(_RELATIONS[n] for n in names) + f" }} strategy s {{ env market_run resolution @1d mode delta {BUY} {_LEDGER} }}")
    given = {n: facts[n] for n in names}
    from ruletide.loop.run import Point

    write_ledger(spark, program, given, ["held"], path, run(spark, program, given, [Point("run", {}, frictionless())], ledger=("held",)))
    return spark.read.parquet(f"{path}/held.parquet").drop("run_id")


@register("snk_run", _sql("SELECT t1 AS t, a AS equity, 10.0::DOUBLE AS quantity, p AS price FROM got"), ("quantity", "price"), "t equity quantity price")
def _(spark, d):
    """A run's tables written to a folder and its fills read back."""
    path = _sink(spark)
    made: RunResult = _run(spark, _facts(spark, d), BUY, frictionless())
    RunResult(made.tagged.checkpoint()).write(path, {"preset": "frictionless"})
    return spark.read.parquet(f"{path}/fill").select(F.to_date("t").alias("t"), "equity", "quantity", "price")


@register("snk_securities", f"WITH {_SEC} SELECT id, ticker, f AS \"from\", u AS \"to\" FROM sec", (), 'id ticker "from" "to"')
def _(spark, d):
    path, env, m = _sink(spark), link(_STORE).env, dt.market_1d(spark, d)
    bundle.write(spark, env, {"universe": m["universe"]}, _securities(spark, d), path, "2002-01-01")
    return bundle.read(spark, env, path, untested=True)[1].select("id", "ticker", "from", "to")


@register("snk_manifest", daily("SELECT 'close' AS relation, count(*) AS n, 'lake' AS source, 5::BIGINT AS delay FROM close"), (), "relation n source delay")
def _(spark, d):
    """The manifest of a bundle, annotated after the fact."""
    path, env, m = _sink(spark), link(_STORE).env, dt.market_1d(spark, d)
    bundle.write(spark, env, {"close": m["close"]}, _securities(spark, d), path, "2002-01-01")
    bundle.annotate(spark, path, source="lake", processing_delay=5)
    x = bundle.manifest(spark, path)
    return spark.createDataFrame([(k, n, x.source, x.processing_delay) for k, n in x.relations.items()], "relation string, n long, source string, delay long")


@register("snk_exceptions", daily("SELECT 'action reconciliation' AS test, a, t FROM split"), (), "test a t")
def _(spark, d):
    """Reviewed exceptions of a bundle, written with it and read back."""
    path, env, m = _sink(spark), link(_STORE).env, dt.market_1d(spark, d)
    found = m["split"].select(F.lit("action reconciliation").alias("test"), "A", "T")
    bundle.write(spark, env, {"universe": m["universe"]}, _securities(spark, d), path, "2002-01-01", found)
    return bundle.reviewed(spark, path)


@register("snk_log", "SELECT r_name AS program, r_regionkey AS trial FROM region", (), "program trial")
def _(spark, d):
    """A trial log on shared storage: a record for each region, appended one by one."""
    path = _sink(spark)
    for r in dt.table(spark, d, "region").toLocalIterator():
        study.append(path, {"program": r["r_name"], "trial": r["r_regionkey"]}, spark)
    return spark.createDataFrame([(x["program"], x["trial"]) for x in study.read_log(path, spark)], "program string, trial long")


# sources


@register("src_ticker_id", "SELECT 'X' || s_name AS ticker, CAST(s_suppkey AS VARCHAR) AS id FROM supplier WHERE s_suppkey = 3", (), "ticker id")
def _(spark, d):
    """Who carries a ticker on a date."""
    s = _securities(spark, d)
    ticker = s.where("id = '3' AND `to` IS NULL").head()["ticker"]
    return spark.createDataFrame([(ticker, environment.id_of(s, ticker, "1999-01-04"))], "ticker string, id string")


@register("src_synthetic", "SELECT CAST(t AS DATE) AS t, 6::BIGINT AS n FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-06-30', INTERVAL 1 DAY)) AS t) WHERE isodow(t) < 6 ORDER BY t LIMIT 90", (), "t n")
def _(spark, d):
    """The calendar of a synthetic market: its symbols trade on every weekday."""
    return Synthetic(6, 90, "2024-01-01").daily(spark)["close"].groupBy(F.to_date("T").alias("t")).agg(F.count("*").alias("n"))


# statistics of the nations' monthly curves

_R = f"{_RETURNS}, x AS (SELECT k, t, e, r, row_number() OVER (PARTITION BY k ORDER BY t) AS j FROM r WHERE r IS NOT NULL), m AS (SELECT k, avg(r) AS mu, count(*) AS n, stddev_samp(r) AS sd, stddev_pop(r) AS pop FROM x GROUP BY 1), z AS (SELECT x.*, r - mu AS d, n FROM x JOIN m USING (k))"


@register("mt_newey_west", f"{_R}, g AS (SELECT a.k, b.j - a.j AS lag, sum(a.d * b.d) AS s FROM z a JOIN z b ON a.k = b.k AND b.j - a.j BETWEEN 0 AND floor(4 * (a.n / 100.0::DOUBLE) ** (2 / 9.0::DOUBLE)) GROUP BY 1, 2), v AS (SELECT g.k, sum(CASE WHEN lag = 0 THEN s / n ELSE 2 * (1 - lag / (floor(4 * (n / 100.0::DOUBLE) ** (2 / 9.0::DOUBLE)) + 1)) * s / n END) AS v FROM g JOIN m USING (k) GROUP BY 1) SELECT k, mu / sqrt(v / n) AS t_stat FROM v JOIN m USING (k)", ("t_stat",), "k t_stat")
def _(spark, d):
    return metrics.curve_metrics(_curves(spark, d), "k", "t", "e", 12.0).where("n > 1").select("k", "t_stat")


@register("mt_track_record", f"{_R}, q AS (SELECT k, avg(d ** 3) / avg(d ** 2) ** 1.5::DOUBLE AS skew, avg(d ** 4) / avg(d ** 2) ** 2 - 3 AS kurt FROM z GROUP BY 1), s AS (SELECT k, mu / sd AS sr, skew, kurt FROM m JOIN q USING (k)) SELECT k, 1 + greatest(0, 1 - skew * sr + (kurt + 2) / 4 * sr * sr) * (1.6448536269514722::DOUBLE / (sr + 1)) ** 2 AS periods FROM s", ("periods",), "k periods")
def _(spark, d):
    """Periods needed to tell a ratio from minus one, at 95 %."""

    def one(t, e):
        m = metrics.return_metrics(t, e, 12.0)
        return [(metrics.min_track_record(m["sharpe_period"], -1.0, m["skew"], m["kurtosis"]),)] if m["n"] > 1 else []

    return metrics.each_curve(_curves(spark, d), "k", "t", "e", one, "periods double")


@register("mt_convention", f"{_R}, pf AS (SELECT k, sum(greatest(p, 0)) / -sum(least(p, 0)) AS profit_factor, sum(p) AS total_pnl FROM (SELECT k, e - lag(e) OVER (PARTITION BY k ORDER BY t) AS p FROM r) GROUP BY 1) SELECT k, n::DOUBLE AS periods, mu / pop * sqrt(12.0::DOUBLE) AS sharpe_population, pop * sqrt(12.0::DOUBLE) AS volatility_population, mu * 12 AS annual_return, total_pnl, profit_factor FROM m JOIN pf USING (k) WHERE n > 1", ("periods", "sharpe_population", "volatility_population", "annual_return", "total_pnl", "profit_factor"), "k periods sharpe_population volatility_population annual_return total_pnl profit_factor")
def _(spark, d):
    names = ("periods", "sharpe_population", "volatility_population", "annual_return", "total_pnl", "profit_factor")

    def one(t, e):
        _, r, p = metrics.period_returns(t, e, None)
        m = metrics.convention_metrics(r, p, 12.0)
        return [tuple(float(m[n]) for n in names)] if m["periods"] > 1 else []

    return metrics.each_curve(_curves(spark, d), "k", "t", "e", one, ", ".join(f"{n} double" for n in names))


@register("mt_masked", f"{_RETURNS}, x AS (SELECT k, t, e, CASE WHEN row_number() OVER (PARTITION BY k ORDER BY t) = 1 THEN 0 ELSE r END AS r FROM r WHERE t < DATE '1997-01-01' OR t >= DATE '1999-01-01') SELECT k, t, arg_min(e, t) OVER (PARTITION BY k) * exp(sum(ln(1 + r)) OVER (PARTITION BY k ORDER BY t)) AS e FROM x", ("e",), "k t e")
def _(spark, d):
    """Curves with two years held out: what happened in between does not count."""
    lo, hi = (int(np.datetime64(x, "s").astype(int)) for x in ("1997-01-01", "1999-01-01"))

    def one(t, e):
        return list(zip(*(x.tolist() for x in metrics.masked_curve(t, e, (t < lo) | (t >= hi))), strict=True))

    made = metrics.each_curve(_curves(spark, d), "k", "t", "e", one, "t long, e double")
    return made.withColumn("t", F.to_date(F.timestamp_seconds("t")))


@register("mt_subperiods", f"{_RETURNS}, y AS (SELECT k, year(t)::BIGINT AS y, r FROM r WHERE r IS NOT NULL) SELECT k, y, avg(r) / stddev_samp(r) * sqrt(12.0::DOUBLE) AS sharpe FROM y GROUP BY 1, 2 HAVING count(r) >= 10 AND stddev_samp(r) > 0", ("sharpe",), "k y sharpe")
def _(spark, d):
    """The ratio of each calendar year of ten returns or more."""
    return metrics.each_curve(_curves(spark, d), "k", "t", "e", lambda t, e: metrics.subperiod_sharpes(t, e, 12.0, 10), "y long, sharpe double")


@register("mt_capacity", f"{_R} SELECT k, 1000000 * (0.02::DOUBLE / (sd * 0.1::DOUBLE)) ** 2 AS capital FROM m WHERE sd > 0", ("capital",), "k capital")
def _(spark, d):
    """Capital at which impact takes 2 % a year, were it a tenth of a curve's deviation now."""

    def one(t, e):
        r = metrics.returns_of(e)
        drag = float(r.std(ddof=1)) * 0.1 if len(r) > 1 else 0.0
        found = metrics.capacity(1_000_000.0, drag, 0.02)
        return [(found,)] if found is not None else []

    return metrics.each_curve(_curves(spark, d), "k", "t", "e", one, "capital double")


@register("mt_lags", f"{_R}, l AS (SELECT unnest(range(1, 11)) AS lag), s AS (SELECT k, sum(d * d) AS total FROM z GROUP BY 1), g AS (SELECT a.k, b.j - a.j AS lag, sum(a.d * b.d) AS s FROM z a JOIN z b ON a.k = b.k AND b.j - a.j BETWEEN 1 AND 10 GROUP BY 1, 2) SELECT s.k, l.lag, coalesce(g.s, 0) / total AS autocorrelation FROM s CROSS JOIN l LEFT JOIN g ON g.k = s.k AND g.lag = l.lag WHERE total > 0", ("autocorrelation",), "k lag autocorrelation")
def _(spark, d):
    def one(t, e):
        r = metrics.returns_of(e)
        return [(k, metrics.autocorrelation(r, k)) for k in range(1, 11)] if len(r) else []

    return metrics.each_curve(_curves(spark, d), "k", "t", "e", one, "lag long, autocorrelation double")
