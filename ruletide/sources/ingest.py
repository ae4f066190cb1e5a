"""Vendor exports to relations, and synthetic markets."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruletide.session import dealt


def ids_at(rows: DataFrame, history: DataFrame, symbol: str, time: str) -> DataFrame:
    """rows with the id that carried their symbol at their time (history: id, symbol, from, to exclusive); others are left out."""
    h = history.select(F.col("id").alias("__id"), F.col("symbol").alias("__s"), F.col("from").cast("timestamp_ntz").alias("__f"), F.col("to").cast("timestamp_ntz").alias("__t"))
    t = F.col(time).cast("timestamp_ntz")
    joined = rows.join(h, (F.col(symbol) == F.col("__s")) & (F.col("__f") <= t) & (F.col("__t").isNull() | (t < F.col("__t"))))
    return joined.withColumn("A", F.col("__id")).drop("__id", "__s", "__f", "__t")


@dataclass
class DailyExport:
    """prices(symbol, date, open, high, low, close, volume), symbols(id, symbol, from, to) and what else the vendor has."""

    prices: DataFrame
    symbols: DataFrame
    splits: DataFrame | None = None  # symbol, ex_date, factor
    dividends: DataFrame | None = None  # symbol, announce_date, ex_date, pay_date, amount
    delistings: DataFrame | None = None  # symbol, date, reason
    membership: DataFrame | None = None  # symbol, index, from, to (inclusive)
    classification: DataFrame | None = None  # symbol, scheme, code, from, to (inclusive)

    def relations(self) -> dict[str, DataFrame]:
        p = ids_at(self.prices.withColumn("T", F.to_date("date")), self.symbols, "symbol", "T")
        out = {name: p.select("A", "T", F.col(c).cast("double").alias(v)) for name, c, v in (("open", "open", "O"), ("high", "high", "H"), ("low", "low", "L"), ("close", "close", "P"), ("volume", "volume", "V"))}
        days = p.select("T").distinct()
        if self.splits is not None:
            s = ids_at(self.splits.withColumn("T", F.to_date("ex_date")), self.symbols, "symbol", "T")
            out["split"] = s.select("A", "T", F.col("factor").cast("double").alias("Factor"))
        if self.dividends is not None:
            d = ids_at(self.dividends.withColumn("T", F.to_date("announce_date")), self.symbols, "symbol", "T")
            out["dividend"] = d.select("A", "T", F.to_date("ex_date").alias("Ex"), F.to_date("pay_date").alias("Pay"), F.col("amount").cast("double").alias("Amount"))
        gone = None
        if self.delistings is not None:
            # the status holds from the delisting to the end of the data; the symbol is looked up a day before it ends
            d = ids_at(self.delistings.withColumn("T", F.to_date("date")).withColumn("__at", F.date_sub(F.to_date("date"), 1)), self.symbols, "symbol", "__at")
            gone = d.select("A", F.col("T").alias("since"), F.col("reason").alias("Reason"))
            out["delisted"] = gone.join(days, F.col("T") >= F.col("since")).select("A", "T", "Reason")
        for name, table, cols in (("member", self.membership, (("index", "Idx"),)), ("classification", self.classification, (("scheme", "Scheme"), ("code", "Code")))):
            if table is not None:
                spans = table.select("symbol", *(F.col(f"`{c}`").alias(v) for c, v in cols), F.to_date("from").alias("lo"), F.to_date("to").alias("hi"))
                # a few spans become many days: they are dealt over tasks first, however small their table is
                daily = dealt(spans, "symbol").join(days, (F.col("T") >= F.col("lo")) & (F.col("hi").isNull() | (F.col("T") <= F.col("hi"))))
                out[name] = ids_at(daily, self.symbols, "symbol", "T").select("A", "T", *(v for _, v in cols)).distinct()
        universe = p.select("A", "T").distinct()
        out["universe"] = universe.join(out["delisted"].select("A", "T"), ["A", "T"], "left_anti") if gone is not None else universe
        return out

    def securities(self) -> DataFrame:
        return self.symbols.select("id", F.col("symbol").alias("ticker"), F.col("from").cast("timestamp_ntz").alias("from"), F.col("to").cast("timestamp_ntz").alias("to"))


def minute_export(bars: DataFrame, symbology: DataFrame, delay: int = 0) -> dict[str, DataFrame]:
    """bars(ts_event: opening instant, instrument_id, open, high, low, close, volume[, ts_recv]) to minute relations.

    A bar is labelled by its close; it is available once received, never before its close, plus the processing delay (seconds).
    """
    b = bars.withColumn("T", F.col("ts_event").cast("timestamp_ntz") + F.expr("INTERVAL '60' SECOND"))
    seen = F.greatest(F.col("T"), F.col("ts_recv").cast("timestamp_ntz")) if "ts_recv" in bars.columns else F.col("T")
    b = ids_at(b.withColumn("available_at", seen + F.expr(f"INTERVAL '{int(delay)}' SECOND")), symbology.withColumnRenamed("symbol", "__sym").withColumn("symbol", F.col("__sym").cast("string")).drop("__sym"), "instrument_id", "ts_event")
    fields = (("open_m", "open", "O"), ("high_m", "high", "H"), ("low_m", "low", "L"), ("close_m", "close", "P"), ("volume_m", "volume", "V"))
    return {n: b.select("A", "T", F.col(c).cast("double").alias(v), "available_at") for n, c, v in fields} | {"universe_m": b.select("A", "T", "available_at")}


def weekly(daily: DataFrame, price: str = "P", volume: str = "V", split: str | None = None) -> DataFrame:
    """Daily (A, T, price, volume[, split]) to weeks labelled by their last bar: last close, mean dollar volume, split product."""
    week = F.date_trunc("week", "T")
    aggs = [F.max("T").alias("T"), F.max_by(price, "T").alias("P"), F.avg(F.col(price) * F.col(volume)).alias("D")]
    if split:
        aggs.append(F.product(F.coalesce(split, F.lit(1.0))).alias("Factor"))
    return daily.groupBy("A", week.alias("__w")).agg(*aggs).drop("__w")


def latest_version(rows: DataFrame, identity: list[str], version: str) -> DataFrame:
    """Of each identity the row ingested last."""
    w = f"row_number() OVER (PARTITION BY {', '.join(identity)} ORDER BY `{version}` DESC)"
    return rows.withColumn("__n", F.expr(w)).where("__n = 1").drop("__n")


def ticker_runs(rows: DataFrame) -> DataFrame:
    """(id, ticker, from, to): maximal runs of one ticker for each id in (id, T, ticker); `to` is the next run's start."""
    w = "OVER (PARTITION BY id ORDER BY T)"
    marked = rows.withColumn("__new", F.expr(f"CASE WHEN lag(ticker) {w} <=> ticker THEN 0 ELSE 1 END"))
    runs = marked.withColumn("__run", F.expr(f"sum(__new) {w}")).groupBy("id", "__run", "ticker").agg(F.min("T").alias("from"))
    return runs.withColumn("to", F.expr("lead(`from`) OVER (PARTITION BY id ORDER BY `from`)")).drop("__run")


def sessions(panel: DataFrame, minute: int) -> DataFrame:
    """Minute rows (A, T, P) to one row a session: first and last finite price, and the last one up to a minute of the session."""
    ok = panel.where(~F.isnan("P") & F.col("P").isNotNull())
    start = ok.groupBy("A", F.to_date("T").alias("D")).agg(F.min("T").alias("S"))
    rows = ok.withColumn("D", F.to_date("T")).join(start, ["A", "D"])
    early = F.when(F.col("T") <= F.col("S") + F.make_dt_interval(mins=F.lit(minute)), F.col("T"))
    return rows.groupBy("A", "D").agg(F.min_by("P", "T").alias("open"), F.max_by("P", "T").alias("close"), F.max_by("P", early).alias(f"close{minute}"), F.max("P").alias("high"), F.min("P").alias("low"))


# synthetic markets


@dataclass
class Synthetic:
    """A seeded random market, small by nature: made on the driver, for demonstrations and tests."""

    symbols: int = 10
    days: int = 250
    start: str = "2020-01-01"
    seed: int = 7
    bars_per_day: int = 390
    tables: dict[str, pd.DataFrame] = field(default_factory=dict)

    def _walk(self, n: int, vol: float = 0.01) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        steps = np.clip(rng.normal(0.0002, vol, (self.symbols, n)), -0.2, 0.2)
        steps[rng.random(steps.shape) < 0.003] += 0.03
        return np.round(np.exp(np.log(rng.uniform(20, 200, (self.symbols, 1))) + np.cumsum(steps, 1)), 2)

    def _names(self) -> list[str]:
        return [f"S{i:03d}" for i in range(self.symbols)]

    def daily(self, spark: SparkSession) -> dict[str, DataFrame]:
        days = pd.bdate_range(self.start, periods=self.days)
        price = self._walk(self.days)
        volume = np.round(np.random.default_rng(self.seed + 1).lognormal(13, 0.5, price.shape))
        at = pd.MultiIndex.from_product([self._names(), days.date], names=["A", "T"]).to_frame(index=False)
        close = spark.createDataFrame(at.assign(P=price.ravel()), "A string, T date, P double")
        vol = spark.createDataFrame(at.assign(V=volume.ravel()), "A string, T date, V double")
        return {"close": close, "volume": vol, "universe": close.select("A", "T")}

    def catalog(self, spark: SparkSession) -> dict[str, DataFrame]:
        """daily, with a split, quarterly dividends, a bankruptcy, an index and sectors."""
        out, names, days = self.daily(spark), self._names(), [d.date() for d in pd.bdate_range(self.start, periods=self.days)]
        cut, end = days[self.days * 2 // 5], days[self.days * 4 // 5]
        split_name, dead = names[min(1, len(names) - 1)], names[-1]
        out["close"] = out["close"].withColumn("P", F.when((F.col("A") == split_name) & (F.col("T") >= F.lit(cut)), F.round(F.col("P") / 2, 2)).otherwise(F.col("P"))).where(~((F.col("A") == dead) & (F.col("T") > F.lit(end))))
        out["split"] = spark.createDataFrame([(split_name, cut, 2.0)], "A string, T date, Factor double")
        pays = [(names[0], days[i], days[min(i + 10, self.days - 1)], days[min(i + 20, self.days - 1)], 0.25) for i in range(30, self.days - 1, 63)]
        out["dividend"] = spark.createDataFrame(pays, "A string, T date, Ex date, Pay date, Amount double")
        out["universe"] = out["close"].select("A", "T")
        out["delisted"] = spark.createDataFrame([(dead, d, "bankruptcy") for d in days if d > end], "A string, T date, Reason string")
        out["member"] = out["universe"].select("A", "T", F.lit("SPX").alias("Idx"))
        out["classification"] = out["universe"].select("A", "T", F.lit("sector").alias("Scheme"), F.concat(F.lit("sector"), F.pmod(F.xxhash64("A"), F.lit(3))).alias("Code"))
        return out

    def minute(self, spark: SparkSession) -> dict[str, DataFrame]:
        n = self.days * self.bars_per_day
        price = self._walk(n, 0.0008)
        gap = np.random.default_rng(self.seed + 2).random((self.symbols, self.days)) < 0.1
        price = np.round(price * np.repeat(np.where(gap, 0.97, 1.0), self.bars_per_day, axis=1), 2)
        stamps = [d + pd.Timedelta(minutes=571 + k) for d in pd.bdate_range(self.start, periods=self.days) for k in range(self.bars_per_day)]
        at = pd.MultiIndex.from_product([self._names(), stamps], names=["A", "T"]).to_frame(index=False)
        close = spark.createDataFrame(at.assign(P=price.ravel()), "A string, T timestamp_ntz, P double")
        return {"close_m": close, "volume_m": close.select("A", "T", F.lit(1000.0).alias("V")), "universe_m": close.select("A", "T")}
