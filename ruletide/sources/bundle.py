"""Bundles: an environment's relations by month, with a manifest and the tests that release them."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruletide.dsl.ast import Unit
from ruletide.sources.environment import DataError, identity_problems, tickers, typed

FORMAT = 2


@dataclass
class Manifest:
    env: str
    version: str | None
    as_of: str
    relations: dict[str, int] = field(default_factory=dict)
    format: int = FORMAT
    source: str | None = None
    processing_delay: int | None = None
    tested: bool = False
    notes: list[str] = field(default_factory=list)


def _put(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def manifest(spark: SparkSession, path: str) -> Manifest:
    return Manifest(**json.loads("\n".join(r["value"] for r in spark.read.text(f"{path}/manifest.json").collect())))


def annotate(spark: SparkSession, path: str, **changes) -> Manifest:
    """Change the manifest: source, processing_delay, tested, notes."""
    m = manifest(spark, path)
    for k, v in changes.items():
        setattr(m, k, v)
    _put(spark, f"{path}/manifest.json", json.dumps(vars(m)))
    return m


def write(spark: SparkSession, env: Unit, facts: dict[str, DataFrame], securities: DataFrame, path: str, as_of: str, exceptions: DataFrame | None = None) -> Manifest:
    """log/<relation>/month=YYYY-MM/*.parquet, securities, reviewed exceptions and the manifest; untested."""
    counts = {}
    for sig in env.signatures:
        if sig.name == "ticker" or sig.name not in facts:
            continue
        df = typed(facts[sig.name], sig)
        key = sig.args[sig.key].name
        month = df.withColumn("month", F.date_format(key, "yyyy-MM"))
        month.repartition("month").sortWithinPartitions(key).write.mode("overwrite").partitionBy("month").parquet(f"{path}/log/{sig.name}")
        counts[sig.name] = spark.read.parquet(f"{path}/log/{sig.name}").count()
    securities.write.mode("overwrite").parquet(f"{path}/securities.parquet")
    if exceptions is not None:
        exceptions.write.mode("overwrite").parquet(f"{path}/exceptions.parquet")
    m = Manifest(env.name, env.version, as_of, counts)
    _put(spark, f"{path}/manifest.json", json.dumps(vars(m)))
    return m


def read(spark: SparkSession, env: Unit, path: str, start: str | None = None, end: str | None = None, untested: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """(relations, securities); start and end (YYYY-MM) prune the months that are read."""
    m = manifest(spark, path)
    if m.format < FORMAT:
        raise DataError(f"bundle format {m.format} is too old")
    if m.env != env.name or (env.version and m.version != env.version):
        raise DataError(f"the bundle is of `{m.env}` {m.version or ''}, not of `{env.name}` {env.version or ''}")
    if not m.tested and not untested:
        raise DataError("the bundle has not passed its tests")
    securities = spark.read.parquet(f"{path}/securities.parquet")
    facts = {}
    for sig in env.signatures:
        if sig.name in m.relations:
            df = spark.read.parquet(f"{path}/log/{sig.name}")
            if start:
                df = df.where(F.col("month") >= start)
            if end:
                df = df.where(F.col("month") <= end)
            facts[sig.name] = df.drop("month")
    if "universe" in facts and any(s.name == "ticker" for s in env.signatures):
        facts["ticker"] = tickers(facts["universe"], securities)
    return facts, securities


# tests: each returns the rows that fail it


def bar_labels(close: DataFrame, calendar: DataFrame) -> DataFrame:
    """Closes on a day that is no bar of the calendar (column T), or on a weekend."""
    off = close.join(calendar.select("T").distinct(), "T", "left_anti")
    return off.unionByName(close.where(F.weekday("T") >= 5)).distinct()


def positive_prices(close: DataFrame, future_ids: DataFrame | None = None) -> DataFrame:
    bad = close.where("P <= 0")
    return bad.join(future_ids.select(F.col("id").alias("A")), "A", "left_anti") if future_ids is not None else bad


def action_reconciliation(close: DataFrame, split: DataFrame | None = None, dividend: DataFrame | None = None, exceptions: DataFrame | None = None, low: float = 0.6, high: float = 1.67, slack: float = 0.25) -> DataFrame:
    """(A, T, P0, P, ratio): moves outside [low, high] that no action explains.

    A split explains a move whose price times its factor is within the slack of the price before; a dividend whose amount
    restores the ratio explains one as well; reviewed exceptions (A, T) are left out. The price before is the name's own.
    """
    before = "lag(P) OVER (PARTITION BY A ORDER BY T)"
    moves = close.select("A", "T", "P", F.expr(before).alias("P0")).where("P0 IS NOT NULL AND P0 <> 0")
    moves = moves.join(split.select("A", "T", F.col("Factor").alias("f")), ["A", "T"], "left") if split is not None else moves.withColumn("f", F.lit(None).cast("double"))
    if dividend is not None:
        moves = moves.join(dividend.groupBy("A", F.col("Ex").alias("T")).agg(F.sum("D").alias("d")), ["A", "T"], "left")
    else:
        moves = moves.withColumn("d", F.lit(None).cast("double"))
    ratio = F.col("P") / F.col("P0")
    explained = (F.abs(ratio * F.coalesce("f", F.lit(0.0)) - 1) <= slack) | ((F.col("P") + F.coalesce("d", F.lit(0.0))) / F.col("P0")).between(low, high)
    bad = moves.withColumn("ratio", ratio).where(F.when(F.col("f").isNotNull(), ~explained).otherwise(~ratio.between(low, high) & ~explained))
    if exceptions is not None:
        bad = bad.join(exceptions.select("A", "T"), ["A", "T"], "left_anti")
    return bad.select("A", "T", "P0", "P", "ratio")


def delisting_coverage(close: DataFrame, delisted: DataFrame, last: DataFrame) -> DataFrame:
    """(A, last_t): names whose prices end before the data does (column T of last) without a delisting."""
    ends = close.groupBy("A").agg(F.max("T").alias("last_t"))
    final = last.agg(F.max("T").alias("final"))
    return ends.join(F.broadcast(final)).where("last_t < final").join(delisted.select("A").distinct(), "A", "left_anti").select("A", "last_t")


def membership(member: DataFrame, universe: DataFrame) -> DataFrame:
    """Members of an index on a bar where they are not in the universe."""
    return member.join(universe, ["A", "T"], "left_anti")


def reviewed(spark: SparkSession, path: str) -> DataFrame | None:
    """The reviewed exceptions of a bundle; None where it has no such table. A table that cannot be read is an error."""
    try:
        return spark.read.parquet(f"{path}/exceptions.parquet")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def test(spark: SparkSession, env: Unit, path: str) -> dict[str, int]:
    """Run every test that the bundle has the relations for; marks the manifest tested if none finds a row."""
    facts, securities = read(spark, env, path, untested=True)
    exceptions = reviewed(spark, path)
    found = {"identity": identity_problems(securities).count()}
    if "close" in facts and "universe" in facts:
        found["bar labels"] = bar_labels(facts["close"], facts["universe"]).count()
        found["action reconciliation"] = action_reconciliation(facts["close"], facts.get("split"), None, exceptions).count()
    if "close" in facts:
        futures = securities.where("asset_class = 'future'") if "asset_class" in securities.columns else None
        found["positive prices"] = positive_prices(facts["close"], futures).count()
    if {"close", "delisted", "universe"} <= facts.keys():
        found["delisting coverage"] = delisting_coverage(facts["close"], facts["delisted"], facts["universe"]).count()
    if {"member", "universe"} <= facts.keys():
        found["membership"] = membership(facts["member"], facts["universe"]).count()
    annotate(spark, path, tested=not any(found.values()))
    return found
