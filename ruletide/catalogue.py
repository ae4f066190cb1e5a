"""All registered queries of the engine and the SQL that each must agree with.

Most are rule programs, compiled by the engine over the driver's tables; the rest call an operator directly. Outputs of
floating point are rounded to four digits, here and in the SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruletide.dsl.parser import parse
from ruletide.engine import Engine
from ruletide.plans.library import library
from ruletide.sources import driver_tables as dt

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "decide_momentum_top_n"
NUDGE = 3.7e-8

_BASE = """
close AS (SELECT CAST(l_suppkey AS VARCHAR) AS a, CAST(l_shipdate AS DATE) AS t, max(l_extendedprice / l_quantity) AS p FROM lineitem GROUP BY 1, 2),
volume AS (SELECT CAST(l_suppkey AS VARCHAR) AS a, CAST(l_shipdate AS DATE) AS t, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
universe AS (SELECT a, t FROM volume WHERE v >= 15),
split AS (SELECT a, t, 2.0::DOUBLE AS factor FROM volume WHERE v >= 90),
dividend AS (SELECT a, t, CAST(t + INTERVAL 30 DAY AS DATE) AS ex, p / 100 AS d FROM close WHERE p >= 1990),
member AS (SELECT v.a, v.t, r_name AS idx FROM volume v JOIN supplier ON v.a = CAST(s_suppkey AS VARCHAR) JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
order_status AS (SELECT CAST(o_custkey AS VARCHAR) AS a, CAST(o_orderdate AS DATE) AS t, min(o_orderstatus) AS s FROM orders GROUP BY 1, 2),
bars AS (SELECT t, lag(t) OVER (ORDER BY t) AS t0 FROM (SELECT t FROM volume UNION SELECT t FROM order_status))
"""
_TICKS = """
tick AS (SELECT CAST(user_id AS VARCHAR) AS a, time_bucket(INTERVAL '1 minute', ts - INTERVAL '1 microsecond') + INTERVAL '1 minute' AS t, max(value) AS p, count(*)::DOUBLE AS v FROM events GROUP BY 1, 2)
"""


def daily(sql: str) -> str:
    return f"WITH {_BASE}, {sql.strip()}" if sql.strip()[:6] not in ("SELECT", "select") else f"WITH {_BASE} {sql.strip()}"


def minute(sql: str) -> str:
    return f"WITH {_TICKS}, {sql.strip()}" if sql.strip()[:6] not in ("SELECT", "select") else f"WITH {_TICKS} {sql.strip()}"


def rounded(df: DataFrame) -> DataFrame:
    """Lower-case names, doubles to four digits; the nudge keeps means of few decimals off the rounding border."""
    return df.select(*(F.round(F.col(f"`{c}`") + NUDGE, 4).alias(c.lower()) if kind == "double" else F.col(f"`{c}`").alias(c.lower()) for c, kind in df.dtypes))


def rules(name: str, text: str, relation: str, oracle: str | None, env: str = "1d", uses: tuple[str, ...] = (), inputs: dict | None = None, decide: bool = False) -> None:
    """Register a query: one relation of a library made of `text` (signatures and rules)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        day = env == "1d"
        facts = (dt.market_1d if day else dt.market_1m)(spark, sf_dir)
        source = dt.ENV_1D if day else dt.ENV_1M
        where = "market_1d" if day else "market_1m"
        for lib in uses:
            source += library(lib, where, 3, "tick", "tick_volume")
        res = {"1d": "1d", "1m": "1m", "1m1d": "1d"}[env]
        using = f"uses {', '.join(uses)}" if uses else ""
        kind, mode = ("strategy", "mode target") if decide else ("library", "")
        source += f"{kind} q {{ env {where} {using} resolution @{res} {mode} {text} }}"
        engine = Engine(spark, source, facts, goal="q")
        return rounded(engine.decisions() if decide else engine.relation(relation, **(inputs or {})))

    QUERIES[name] = run
    if oracle:
        sig = next(x for u in parse(f"library q {{ {text} }}") for x in u.signatures if x.name == relation) if not decide else None
        doubles = {a.name.lower() for a in sig.args if a.type in ("Scalar", "Price", "Notional", "Quantity")} if sig else {"amount"}
        names = [a.name.lower() for a in sig.args if a.name not in (inputs or {})] if sig else ["t", "ctor", "equity", "amount", "order_kind"]
        ORACLE[name] = f"SELECT {', '.join(f'round({c} + {NUDGE}, 4) AS {c}' if c in doubles else c for c in names)} FROM ({oracle})"


# filters and expressions

rules("src_scan_close", "rel r(+A: Equity, @T: Timestamp, -P: Price<USD>) r(A, T, P) :- close(A, T, P).", "r", daily("SELECT a, t, (p) AS p FROM close"))
rules("flt_cmp", "param floor : Price<USD> = 1500 USD/share rel r(+A: Equity, @T: Timestamp, -P: Price<USD>) r(A, T, P) :- close(A, T, P), P >= floor, P < 1800 USD/share.", "r", daily("SELECT a, t, (p) AS p FROM close WHERE p >= 1500 AND p < 1800"))
rules("flt_const", 'rel r(@T: Timestamp, -P: Price<USD>) r(T, P) :- close("7", T, P).', "r", daily("SELECT t, (p) AS p FROM close WHERE a = '7'"))
rules("flt_repeat", "rel two(+A: Equity, @T: Timestamp, -X: Scalar, -Y: Scalar) rel r(-A: Equity, @T: Timestamp) two(A, T, F, G) :- split(A, T, F), volume(A, T, V), close(A, T, P), G = greatest(2, V / 60 shares - 2). r(A, T) :- two(A, T, X, X).", "r", daily("SELECT s.a, s.t FROM split s JOIN volume v ON s.a = v.a AND s.t = v.t WHERE greatest(2.0, v.v / 60 - 2) = s.factor"))
rules("exp_arith", "rel r(+A: Equity, @T: Timestamp, -X: Scalar, -Y: Scalar, -Z: Scalar) r(A, T, X, Y, Z) :- close(A, T, P), volume(A, T, V), S = P / 100 USD/share, X = log(S) + exp(-S / 10) * 2, Y = sqrt(S) - abs(S - 15), Z = least(greatest(S, 12), 18, V / 1 shares).", "r", daily("SELECT c.a, c.t, (ln(p / 100) + exp(-(p / 100) / 10) * 2) AS x, (sqrt(p / 100) - abs(p / 100 - 15)) AS y, (least(greatest(p / 100, 12), 18, v)) AS z FROM close c JOIN volume v ON c.a = v.a AND c.t = v.t"))
rules("exp_partial", "rel r(+A: Equity, @T: Timestamp, -X: Scalar) r(A, T, X) :- volume(A, T, V), D = V / 1 shares - 30, X = 100 / D + log(D).", "r", daily("SELECT a, t, (100 / (v - 30) + ln(v - 30)) AS x FROM volume WHERE v > 30"))
rules("prj_head", "rel r(@T: Timestamp, -K: Scalar) r(T, 1) :- close(_, T, P), P > 1900 USD/share. r(T, 2) :- split(_, T, _).", "r", daily("SELECT DISTINCT t, 1.0::DOUBLE AS k FROM close WHERE p > 1900 UNION SELECT DISTINCT t, 2.0::DOUBLE FROM split"))

# joins

rules("join_conj", "rel r(+A: Equity, @T: Timestamp, -D: Notional<USD>) r(A, T, D) :- universe(A, T), close(A, T, P), volume(A, T, V), D = P * V.", "r", daily("SELECT u.a, u.t, (p * v) AS d FROM universe u JOIN close c ON u.a = c.a AND u.t = c.t JOIN volume v ON u.a = v.a AND u.t = v.t"))
rules("join_theta", "rel big(-A: Equity, @T: Timestamp, -P: Price<USD>) rel r(-A: Equity, -B: Equity, @T: Timestamp) big(A, T, P) :- split(A, T, _), close(A, T, P). r(A, B, T) :- big(A, T, P), big(B, T, Q), P > Q.", "r", daily("big AS (SELECT s.a, s.t, p FROM split s JOIN close c ON s.a = c.a AND s.t = c.t) SELECT x.a, y.a AS b, x.t FROM big x JOIN big y ON x.t = y.t WHERE x.p > y.p"))
rules("join_cross", "rel r(-A: Equity, -B: Equity, @T: Timestamp) r(A, B, T) :- split(A, T, _), split(B, T, _).", "r", daily("SELECT x.a, y.a AS b, x.t FROM split x JOIN split y ON x.t = y.t"))
rules("join_anti", "rel r(-A: Equity, @T: Timestamp) r(A, T) :- universe(A, T), not split(A, T, _), not member(A, T, \"ASIA\").", "r", daily("SELECT a, t FROM universe u WHERE NOT EXISTS (SELECT 1 FROM split s WHERE s.a = u.a AND s.t = u.t) AND NOT EXISTS (SELECT 1 FROM member m WHERE m.a = u.a AND m.t = u.t AND idx = 'ASIA')"))
rules("join_semi", 'rel r(+A: Equity, @T: Timestamp, -P: Price<USD>) r(A, T, P) :- close(A, T, P), universe(A, T), member(A, T, "EUROPE").', "r", daily("SELECT c.a, c.t, (p) AS p FROM close c SEMI JOIN universe u ON c.a = u.a AND c.t = u.t SEMI JOIN member m ON c.a = m.a AND c.t = m.t AND idx = 'EUROPE'"))
rules("asof_orders_close", "rel r(+A: Equity, @T: Timestamp, -T0: Timestamp, -S: Label, -P: Price<USD>) r(A, T, T0, S, P) :- order_status(A, T, S), close(A, T0, P) asof T.", "r", daily("SELECT o.a, o.t, c.t AS t0, s, (p) AS p FROM order_status o ASOF JOIN close c ON o.a = c.a AND o.t >= c.t"))
rules("asof_many", 'rel act(-A: Equity, @T: Timestamp, -S: Label) rel r(-A: Equity, @T: Timestamp, -B: Equity) act(A, T, "s") :- split(A, T, _). r(A, T, B) :- dividend(A, T, _, _), act(B, _, "s") asof T.', "r", daily("k AS (SELECT d.a, d.t, max(s.t) AS k FROM dividend d JOIN split s ON s.t <= d.t GROUP BY 1, 2) SELECT DISTINCT k.a, k.t, s.a AS b FROM k JOIN split s ON s.t = k.k"))
rules("asof_daily_from_minute", "rel r(+A: Equity, @T: Timestamp, -D: Timestamp, -P: Price<USD>) r(A, T, D, P) :- universe_m(A, T), day_start(T), close_d(A, D, P) asof T.", "r", minute("starts AS (SELECT t FROM (SELECT t, lag(t) OVER (ORDER BY t) AS l FROM (SELECT DISTINCT t FROM tick)) WHERE l IS NULL OR CAST(t AS DATE) <> CAST(l AS DATE)), d AS (SELECT a, CAST(t AS DATE) AS d, arg_max(p, t) AS p, count(*) AS n FROM tick GROUP BY 1, 2 HAVING count(*) >= 3), x AS (SELECT a, t, d, p, row_number() OVER (PARTITION BY a, t ORDER BY d DESC) AS r FROM (SELECT k.a, k.t, d.d, d.p FROM tick k JOIN starts s ON k.t = s.t JOIN d ON d.a = k.a AND d.d < CAST(k.t AS DATE))) SELECT a, t, CAST(d AS TIMESTAMP) AS d, p FROM x WHERE r = 1"), env="1m", uses=("bars",))

# aggregates

rules("agg_xs_basic", "rel r(@T: Timestamp, -N: Count, -S: Notional<USD>, -M: Price<USD>, -D: Price<USD>, -L: Price<USD>, -H: Price<USD>) r(T, N, S, M, D, L, H) :- N = count(A) over (close(A, T, P)), S = sum(P * V) over (close(A, T, P), volume(A, T, V)), M = mean(P) over (close(_, T, P)), D = std(P) over (close(_, T, P)), L = min(P) over (close(_, T, P)), H = max(P) over (close(_, T, P)).", "r", daily("SELECT c.t, count(*) AS n, (sum(p * v)) AS s, (avg(p)) AS m, (stddev_samp(p)) AS d, (min(p)) AS l, (max(p)) AS h FROM close c JOIN volume v ON c.a = v.a AND c.t = v.t GROUP BY 1 HAVING count(*) >= 2"))
rules("agg_xs_quantile", "param q : Scalar = 0.8 rel r(@T: Timestamp, -M: Price<USD>, -Hi: Price<USD>, -Lo: Price<USD>) r(T, M, Hi, Lo) :- M = median(P) over (close(_, T, P)), Hi = quantile(P, q) over (close(_, T, P)), Lo = quantile(P, 1 - q) over (close(_, T, P)).", "r", daily("SELECT t, (median(p)) AS m, (quantile_cont(p, 0.8)) AS hi, (quantile_cont(p, 0.2)) AS lo FROM close GROUP BY 1"))
rules("agg_corr_cov_beta", "rel r(@T: Timestamp, -C: Scalar, -X: Scalar, -B: Scalar) r(T, C, X, B) :- N = count(A) over (close(A, T, _)), N >= 3, C = corr(P / 1 USD/share, V / 1 shares) over (close(A, T, P), volume(A, T, V)), X = cov(P / 1000 USD/share, V / 10 shares) over (close(A, T, P), volume(A, T, V)), B = ols_beta(P / 1000 USD/share, V / 10 shares) over (close(A, T, P), volume(A, T, V)).", "r", daily("SELECT c.t, (corr(p, v)) AS c, (covar_samp(p / 1000, v / 10)) AS x, (regr_slope(p / 1000, v / 10)) AS b FROM close c JOIN volume v ON c.a = v.a AND c.t = v.t GROUP BY 1 HAVING count(*) >= 3 AND stddev_samp(v) > 0 AND stddev_samp(p) > 0"))
rules("agg_count_zero", "rel bar(@T: Timestamp) rel r(@T: Timestamp, -N: Count) bar(T) :- universe(_, T). r(T, N) :- bar(T), N = count(A) over (split(A, T, _)).", "r", daily("SELECT b.t, count(s.a) AS n FROM (SELECT DISTINCT t FROM universe) b LEFT JOIN split s ON b.t = s.t GROUP BY 1"))
rules("agg_group", "rel r(+A: Equity, @T: Timestamp, -D: Scalar) r(A, T, D) :- close(A, T, P), M = mean(Q) over (close(_, T, Q)), D = P / M - 1.", "r", daily("SELECT a, t, (p / avg(p) OVER (PARTITION BY t) - 1) AS d FROM close"))

# windows


def _frame(select: str, frame: str, where: str, value: str = "close", col: str = "p", base: str = "universe") -> str:
    return daily(f"x AS (SELECT coalesce(u.a, c.a) AS a, coalesce(u.t, c.t) AS t, u.a IS NOT NULL AS base, c.{col} AS x FROM {base} u FULL JOIN {value} c ON u.a = c.a AND u.t = c.t), w AS (SELECT a, t, base, {select}, count(x) OVER f AS n FROM x WINDOW f AS (PARTITION BY a ORDER BY t {frame})) SELECT * EXCLUDE (base, n) FROM w WHERE base AND {where}")


_LOGRET = "logret AS (SELECT x.a, x.t, ln(x.p / y.p) AS r FROM close x JOIN bars b ON x.t = b.t JOIN close y ON y.a = x.a AND y.t = b.t0)"

rules("win_sma_min", "rel r(+A: Equity, @T: Timestamp, -M: Price<USD>) r(A, T, M) :- sma(A, T, 20d, 5, M).", "r", _frame("(avg(x) OVER f) AS m", "RANGE BETWEEN INTERVAL 20 DAY PRECEDING AND CURRENT ROW", "n >= 5"), uses=("features",))
rules("win_sma_months", "rel r(+A: Equity, @T: Timestamp, -M: Price<USD>, -H: Price<USD>) r(A, T, M, H) :- universe(A, T), M = median(P) over (T1 in window(T, 3mo, min 4), close(A, T1, P)), H = quantile(P, 0.9) over (T1 in window(T, 3mo, min 4), close(A, T1, P)).", "r", _frame("(quantile_cont(x, 0.5) OVER f) AS m, (quantile_cont(x, 0.9) OVER f) AS h", "RANGE BETWEEN INTERVAL 3 MONTH PRECEDING AND CURRENT ROW", "n >= 4"))
rules("win_realized_vol", "rel r(+A: Equity, @T: Timestamp, -V: Scalar) r(A, T, V) :- realized_vol(A, T, 60d, 3, V).", "r", daily(_LOGRET + ", x AS (SELECT coalesce(u.a, c.a) AS a, coalesce(u.t, c.t) AS t, u.a IS NOT NULL AS base, c.r AS x FROM universe u FULL JOIN logret c ON u.a = c.a AND u.t = c.t), w AS (SELECT a, t, base, (stddev_samp(x) OVER f) AS v, count(x) OVER f AS n FROM x WINDOW f AS (PARTITION BY a ORDER BY t RANGE BETWEEN INTERVAL 60 DAY PRECEDING AND CURRENT ROW)) SELECT a, t, v FROM w WHERE base AND n >= 3"), uses=("features",))
rules("win_zscore", "rel r(+A: Equity, @T: Timestamp, -Z: Scalar) r(A, T, Z) :- zscore(A, T, 2mo, 5, Z).", "r", daily("w AS (SELECT a, t, p, avg(p) OVER f AS m, stddev_samp(p) OVER f AS s, count(*) OVER f AS n FROM close WINDOW f AS (PARTITION BY a ORDER BY t RANGE BETWEEN INTERVAL 2 MONTH PRECEDING AND CURRENT ROW)) SELECT a, t, ((p - m) / s) AS z FROM w WHERE n >= 5 AND s <> 0"), uses=("features",))
rules("win_prior_high", "rel r(+A: Equity, @T: Timestamp, -H: Price<USD>) r(A, T, H) :- highest(A, T, 3mo, 2, H), close(A, T, P), P > H.", "r", daily("x AS (SELECT coalesce(u.a, c.a) AS a, coalesce(u.t, c.t) AS t, u.a IS NOT NULL AS base, c.p AS x FROM universe u FULL JOIN close c ON u.a = c.a AND u.t = c.t), w AS (SELECT a, t, base, x, max(x) OVER f AS h, count(x) OVER f AS n FROM x WINDOW f AS (PARTITION BY a ORDER BY t RANGE BETWEEN INTERVAL 3 MONTH PRECEDING AND INTERVAL 1 DAY PRECEDING)) SELECT a, t, (h) AS h FROM w WHERE base AND n >= 2 AND x > h"), uses=("features",))
rules("win_adv", "rel r(+A: Equity, @T: Timestamp, -D: Notional<USD>) r(A, T, D) :- adv(A, T, 20d, 3, D).", "r", daily("pv AS (SELECT c.a, c.t, p * v AS x FROM close c JOIN volume v ON c.a = v.a AND c.t = v.t), x AS (SELECT coalesce(u.a, c.a) AS a, coalesce(u.t, c.t) AS t, u.a IS NOT NULL AS base, c.x FROM universe u FULL JOIN pv c ON u.a = c.a AND u.t = c.t), w AS (SELECT a, t, base, (avg(x) OVER f) AS d, count(x) OVER f AS n FROM x WINDOW f AS (PARTITION BY a ORDER BY t RANGE BETWEEN INTERVAL 20 DAY PRECEDING AND CURRENT ROW)) SELECT a, t, d FROM w WHERE base AND n >= 3"), uses=("features",))
rules("win_rows_mean", "rel r(+A: Equity, @T: Timestamp, -M: Price<USD>, -S: Price<USD>) r(A, T, M, S) :- universe(A, T), M = mean(P) over (T1 in rows(T, 10, min 10), close(A, T1, P)), S = std(P) over (T1 in rows(T, 10, min 10), close(A, T1, P)).", "r", _frame("(avg(x) OVER f) AS m, (stddev_samp(x) OVER f) AS s", "ROWS BETWEEN 9 PRECEDING AND CURRENT ROW", "n >= 10"))
rules("win_rows_median", "rel r(+A: Equity, @T: Timestamp, -M: Price<USD>) r(A, T, M) :- universe(A, T), M = median(P) over (T1 in rows(T, 8, min 5), close(A, T1, P)).", "r", _frame("(quantile_cont(x, 0.5) OVER f) AS m", "ROWS BETWEEN 7 PRECEDING AND CURRENT ROW", "n >= 5"))
rules("win_rows_anchor", "rel r(+A: Equity, @T: Timestamp, -B: Scalar, -N: Count) r(A, T, B, N) :- universe(A, T), B = sum(F) over (T1 in rows(T, 6, min 1), close(A, T1, _), split(A, T1, F)), N = count(F) over (T1 in rows(T, 6, min 1), close(A, T1, _), split(A, T1, F)).", "r", daily("x AS (SELECT c.a, c.t, u.a IS NOT NULL AS base, s.factor AS x FROM close c LEFT JOIN universe u ON u.a = c.a AND u.t = c.t LEFT JOIN split s ON s.a = c.a AND s.t = c.t), w AS (SELECT a, t, base, sum(x) OVER f AS b, count(x) OVER f AS n FROM x WINDOW f AS (PARTITION BY a ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)) SELECT a, t, b, n FROM w WHERE base AND n >= 1"))
rules("win_rows_beta", "rel r(+A: Equity, @T: Timestamp, -B: Scalar, -C: Scalar) r(A, T, B, C) :- universe(A, T), B = ols_beta(P / 1000 USD/share, V / 10 shares) over (T1 in rows(T, 12, min 12), close(A, T1, P), volume(A, T1, V)), C = corr(P / 1000 USD/share, V / 10 shares) over (T1 in rows(T, 12, min 12), close(A, T1, P), volume(A, T1, V)).", "r", daily("x AS (SELECT c.a, c.t, u.a IS NOT NULL AS base, p / 1000 AS y, v / 10 AS x FROM close c JOIN volume v ON c.a = v.a AND c.t = v.t LEFT JOIN universe u ON u.a = c.a AND u.t = c.t), w AS (SELECT a, t, base, (regr_slope(y, x) OVER f) AS b, (corr(y, x) OVER f) AS c, count(*) OVER f AS n FROM x WINDOW f AS (PARTITION BY a ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) SELECT a, t, b, c FROM w WHERE base AND n >= 12"))
rules("win_whole_solve", "rel r(+A: Equity, @T: Timestamp, -D: Price<USD>) r(A, T, D) :- div_at(A, T, D).", "r", daily("SELECT u.a, u.t, (sum(d)) AS d FROM universe u JOIN dividend v ON u.a = v.a AND v.ex = u.t AND v.t BETWEEN u.t - INTERVAL 1 YEAR AND u.t GROUP BY 1, 2"), uses=("catalog",))
rules("win_total_return", "rel r(+A: Equity, @T: Timestamp, -R: Scalar) r(A, T, R) :- ret(A, T, R).", "r", daily("da AS (SELECT u.a, u.t, sum(d) AS d FROM universe u JOIN dividend v ON u.a = v.a AND v.ex = u.t AND v.t BETWEEN u.t - INTERVAL 1 YEAR AND u.t GROUP BY 1, 2) SELECT x.a, x.t, ((x.p * coalesce(s.factor, 1) + coalesce(da.d, 0)) / y.p - 1) AS r FROM close x JOIN universe u ON x.a = u.a AND x.t = u.t JOIN bars b ON x.t = b.t JOIN close y ON y.a = x.a AND y.t = b.t0 LEFT JOIN split s ON s.a = x.a AND s.t = x.t LEFT JOIN da ON da.a = x.a AND da.t = x.t"), uses=("catalog",))

# calendar

rules("tb_prev_logret", "rel r(+A: Equity, @T: Timestamp, -R: Scalar) r(A, T, R) :- logret(A, T, R).", "r", daily(_LOGRET + " SELECT a, t, (r) AS r FROM logret"), uses=("features",))
rules("tb_lag_momentum", "rel r(+A: Equity, @T: Timestamp, -M: Scalar) r(A, T, M) :- momentum(A, T, 6mo, 1mo, M).", "r", daily("l AS (SELECT b.t, max(x.t) FILTER (x.t <= b.t - INTERVAL 6 MONTH) AS t6, max(x.t) FILTER (x.t <= b.t - INTERVAL 1 MONTH) AS t1 FROM bars b JOIN bars x ON x.t <= b.t GROUP BY 1) SELECT u.a, u.t, (y.p / x.p - 1) AS m FROM universe u JOIN l ON u.t = l.t JOIN close x ON x.a = u.a AND x.t = l.t6 JOIN close y ON y.a = u.a AND y.t = l.t1"), uses=("features",))
rules("tb_month_start", "rel r(-A: Equity, @T: Timestamp) r(A, T) :- universe(A, T), month_start(T).", "r", daily("SELECT a, u.t FROM universe u JOIN bars b ON u.t = b.t WHERE t0 IS NULL OR date_trunc('month', b.t) <> date_trunc('month', t0)"))
rules("tb_day_start", "rel r(@T: Timestamp, -N: Count) r(T, N) :- day_start(T), N = count(A) over (universe_m(A, T)).", "r", minute("m AS (SELECT t, lag(t) OVER (ORDER BY t) AS l FROM (SELECT DISTINCT t FROM tick)) SELECT m.t, count(*) AS n FROM m JOIN tick ON m.t = tick.t WHERE l IS NULL OR CAST(m.t AS DATE) <> CAST(l AS DATE) GROUP BY 1"), env="1m")
rules("tb_exists", "rel r(-A: Equity, @T: Timestamp) r(A, T) :- split(A, T, _), lag(T, 1y, _).", "r", daily("SELECT a, t FROM split WHERE t >= (SELECT min(t) FROM bars) + INTERVAL 1 YEAR"))

# rank, top, resample

rules("top_n_momentum", "param n : Count = 3 rel c(-A: Equity, @T: Timestamp, -M: Scalar) rel r(-A: Equity, @T: Timestamp, -M: Scalar) c(A, T, M) :- universe(A, T), momentum(A, T, 6mo, 1mo, M). r(A, T, M) :- top(n, c(A, T, M), by (M desc, A asc)).", "r", daily("l AS (SELECT b.t, max(x.t) FILTER (x.t <= b.t - INTERVAL 6 MONTH) AS t6, max(x.t) FILTER (x.t <= b.t - INTERVAL 1 MONTH) AS t1 FROM bars b JOIN bars x ON x.t <= b.t GROUP BY 1), m AS (SELECT u.a, u.t, y.p / x.p - 1 AS m FROM universe u JOIN l ON u.t = l.t JOIN close x ON x.a = u.a AND x.t = l.t6 JOIN close y ON y.a = u.a AND y.t = l.t1) SELECT a, t, (m) AS m FROM m QUALIFY row_number() OVER (PARTITION BY t ORDER BY m DESC, a) <= 3"), uses=("features",))
rules("rank_ordinal", "rel r(-A: Equity, @T: Timestamp, -K: Scalar) r(A, T, K) :- rank(volume(A, T, V), by (V desc), as K).", "r", daily("SELECT a, t, row_number() OVER (PARTITION BY t ORDER BY v DESC, a)::DOUBLE AS k FROM volume"))
rules("rank_avg", "rel r(-A: Equity, @T: Timestamp, -K: Scalar) r(A, T, K) :- rank(volume(A, T, V), by (V asc), ties average, as K).", "r", daily("SELECT a, t, rank() OVER (PARTITION BY t ORDER BY v) + (count(*) OVER (PARTITION BY t, v) - 1) / 2.0::DOUBLE AS k FROM volume"))
rules("resample_ohlcv", "rel r(+A: Equity, @T: Timestamp, -O: Price<USD>, -H: Price<USD>, -L: Price<USD>, -C: Price<USD>, -V: Quantity<Shares>) r(A, T, O, H, L, C, V) :- open_d(A, T, O), high_d(A, T, H), low_d(A, T, L), close_d(A, T, C), volume_d(A, T, V).", "r", minute("SELECT a, CAST(t AS DATE) AS t, arg_min(p, t) AS o, max(p) AS h, min(p) AS l, arg_max(p, t) AS c, sum(v) AS v FROM tick GROUP BY 1, 2 HAVING count(*) >= 3"), env="1m1d", uses=("bars",))
rules("resample_hour", "rel h(+A: Equity, @T: Timestamp, -M: Price<USD>, -N: Count) @1h h(A, T, M, N) :- resample(tick(A, U, P) to @1h as T, min 1, M = mean(P), N = count(U)).", "h", minute("SELECT a, time_bucket(INTERVAL '1 hour', t - INTERVAL '1 microsecond') + INTERVAL '1 hour' AS t, (avg(p)) AS m, count(*) AS n FROM tick GROUP BY 1, 2"), env="1m")
rules("win_minute", "rel r(+A: Equity, @T: Timestamp, -M: Price<USD>) r(A, T, M) :- universe_m(A, T), M = mean(P) over (U in window(T, 1d, min 2), tick(A, U, P)).", "r", minute("w AS (SELECT a, t, avg(p) OVER f AS m, count(*) OVER f AS n FROM tick WINDOW f AS (PARTITION BY a ORDER BY t RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)) SELECT a, t, (m) AS m FROM w WHERE n >= 2"), env="1m")

# sets and recursion

rules("union_rules", "rel r(-A: Equity, @T: Timestamp) r(A, T) :- split(A, T, _). r(A, T) :- dividend(A, T, _, _).", "r", daily("SELECT a, t FROM split UNION SELECT a, t FROM dividend"))
rules("inter_rules", "rel r(-A: Equity, @T: Timestamp) r(A, T) :- split(A, T, _), dividend(A, T, _, _).", "r", daily("SELECT a, t FROM split INTERSECT SELECT a, t FROM dividend"))
rules("diff_rules", "rel r(-A: Equity, @T: Timestamp) r(A, T) :- dividend(A, T, _, _), not split(A, T, _).", "r", daily("SELECT a, t FROM dividend EXCEPT SELECT a, t FROM split"))
_CHAIN = "lb AS (SELECT x.a, x.t FROM universe x JOIN bars b ON x.t = b.t JOIN universe y ON y.a = x.a AND y.t = b.t0), f AS (SELECT u.a, u.t, coalesce(s.factor, 1) AS f, lb.a IS NULL AS begins FROM universe u LEFT JOIN split s ON s.a = u.a AND s.t = u.t LEFT JOIN lb ON lb.a = u.a AND lb.t = u.t), g AS (SELECT *, sum(begins::INT) OVER (PARTITION BY a ORDER BY t) AS seg FROM f)"
rules("rec_cumfactor", "rel r(+A: Equity, @T: Timestamp, -C: Scalar) r(A, T, C) :- cumfactor(A, T, C).", "r", daily(_CHAIN + " SELECT a, t, (exp(sum(ln(f)) OVER (PARTITION BY a, seg ORDER BY t))) AS c FROM g"), uses=("catalog",))
rules("rec_row_number", "rel seen(+A: Equity, @T: Timestamp) rel row(+A: Equity, @T: Timestamp, -K: Scalar) seen(A, T) :- universe(A, T), prev(T, U), universe(A, _) asof U. row(A, T, 0) :- universe(A, T), not seen(A, T). row(A, T, K) :- seen(A, T), prev(T, U), row(A, _, J) asof U, K = J + 1.", "row", daily("SELECT a, t, (row_number() OVER (PARTITION BY a ORDER BY t) - 1)::DOUBLE AS k FROM universe"))
rules("rec_highwater", "rel r(+A: Equity, @T: Timestamp, -H: Price<USD>) r(A, T, H) :- close(A, T, H), universe(A, T), month_start(T). r(A, T, H) :- close(A, T, P), universe(A, T), not bar1(T), prev(T, U), r(A, _, J) asof U, H = greatest(J, P). rel bar1(@T: Timestamp) bar1(T) :- universe(_, T), month_start(T).", "r", daily("ms AS (SELECT t FROM bars WHERE t0 IS NULL OR date_trunc('month', t) <> date_trunc('month', t0)), x AS (SELECT c.a, c.t, p, m.t IS NOT NULL AS s FROM close c JOIN universe u ON c.a = u.a AND c.t = u.t LEFT JOIN ms m ON c.t = m.t), g AS (SELECT *, sum(s::INT) OVER (PARTITION BY a ORDER BY t) AS seg FROM x) SELECT a, t, (max(p) OVER (PARTITION BY a, seg ORDER BY t)) AS h FROM g WHERE seg > 0"))
rules("rec_latch", "rel enter(+A: Equity, @T: Timestamp) rel stay(+A: Equity, @T: Timestamp) rel on(+A: Equity, @T: Timestamp, -L: Scalar) enter(A, T) :- close(A, T, P), universe(A, T), P > 1900 USD/share. stay(A, T) :- close(A, T, P), P > 1200 USD/share. on(A, T, 1) :- universe(A, T), enter(A, T). on(A, T, L) :- universe(A, T), not enter(A, T), stay(A, T), prev(T, U), on(A, _, L) asof U. on(A, T, 0) :- universe(A, T), not enter(A, T), not stay(A, T).", "on", daily("x AS (SELECT u.a, u.t, CASE WHEN p > 1900 THEN 1 WHEN p <= 1200 THEN 0 END AS e FROM universe u JOIN close c ON u.a = c.a AND u.t = c.t), w AS (SELECT a, t, last_value(e IGNORE NULLS) OVER (PARTITION BY a ORDER BY t) AS l FROM x) SELECT a, t, l::DOUBLE AS l FROM w WHERE l IS NOT NULL"))
rules("rec_ewm", "rel e(+A: Equity, @T: Timestamp, -X: Scalar) rel seen(+A: Equity, @T: Timestamp) seen(A, T) :- split(A, T, _), prev(T, U), split(A, _, _) asof U. e(A, T, X) :- split(A, T, _), volume(A, T, V), not seen(A, T), X = V / 1 shares. e(A, T, X) :- seen(A, T), volume(A, T, V), prev(T, U), e(A, _, Y) asof U, X = Y * 0.9 + V / 1 shares * 0.1.", "e", daily("x AS (SELECT s.a, s.t, v, row_number() OVER (PARTITION BY s.a ORDER BY s.t) - 1 AS i FROM split s JOIN volume v ON s.a = v.a AND s.t = v.t) SELECT a, t, sum(CASE WHEN i = 0 THEN v ELSE 0.1::DOUBLE * v END / 0.9::DOUBLE ** i) OVER (PARTITION BY a ORDER BY t) * 0.9::DOUBLE ** i AS x FROM x"))

# decisions

rules("decide_momentum_top_n", "param n : Count = 3 param min_adv : Notional<USD> = 10_000 USD rel candidate(-A: Equity, @T: Timestamp, -M: Scalar) rel selected(-A: Equity, @T: Timestamp) rel n_selected(@T: Timestamp, -N: Count) candidate(A, T, M) :- universe(A, T), momentum(A, T, 6mo, 1mo, M), adv(A, T, 20d, 2, D), D >= min_adv. selected(A, T) :- bar(T), top(n, candidate(A, T, M), by (M desc, A asc)). n_selected(T, N) :- bar(T), N = count(A) over (selected(A, T)), N > 0. decide(T, target_weight(A, W)) :- selected(A, T), n_selected(T, N), W = 1 / N.", "decide", daily("l AS (SELECT b.t, max(x.t) FILTER (x.t <= b.t - INTERVAL 6 MONTH) AS t6, max(x.t) FILTER (x.t <= b.t - INTERVAL 1 MONTH) AS t1 FROM bars b JOIN bars x ON x.t <= b.t GROUP BY 1), m AS (SELECT u.a, u.t, y.p / x.p - 1 AS m FROM universe u JOIN l ON u.t = l.t JOIN close x ON x.a = u.a AND x.t = l.t6 JOIN close y ON y.a = u.a AND y.t = l.t1), pv AS (SELECT c.a, c.t, p * v AS x FROM close c JOIN volume v ON c.a = v.a AND c.t = v.t), d AS (SELECT a, t, avg(x) OVER f AS d, count(x) OVER f AS n FROM pv WINDOW f AS (PARTITION BY a ORDER BY t RANGE BETWEEN INTERVAL 20 DAY PRECEDING AND CURRENT ROW)), s AS (SELECT m.a, m.t FROM m JOIN d ON m.a = d.a AND m.t = d.t WHERE d.n >= 2 AND d.d >= 10000 QUALIFY row_number() OVER (PARTITION BY m.t ORDER BY m.m DESC, m.a) <= 3) SELECT t, 'target_weight' AS ctor, a AS equity, (1.0::DOUBLE / count(*) OVER (PARTITION BY t)) AS amount, 'market' AS order_kind FROM s"), uses=("features",), decide=True)

from ruletide import catalogue_ops as _more, catalogue_runs as _runs, catalogue_tables as _tables  # noqa: E402,F401 - register the rest
