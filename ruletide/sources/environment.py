"""Reading and writing the relations of an environment as Parquet, with the checks that a relation must pass."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruletide.dsl.ast import Signature, Unit
from ruletide.operators.temporal import bucket, bucket_range
from ruletide.plans.compiler import spark_type


class DataError(Exception):
    pass


def _fail(found: DataFrame, what: str) -> None:
    rows = found.limit(2).collect()
    if rows:
        raise DataError(f"{what}: {'; '.join(str(r.asDict()) for r in rows)}")


def typed(df: DataFrame, sig: Signature) -> DataFrame:
    """The relation's columns by name (any case), cast to its types, its key as the bar's label; `available_at` if there."""
    by = {c.lower(): c for c in df.columns}
    missing = [a.name for a in sig.args if a.name.lower() not in by]
    if missing:
        raise DataError(f"`{sig.name}` lacks the columns {', '.join(missing)}")
    out = []
    for i, a in enumerate(sig.args):
        c = F.col(f"`{by[a.name.lower()]}`")
        if a.type == "Timestamp":
            c = c.cast("timestamp_ntz")
            c = bucket(c, sig.res) if i == sig.key else c.cast(spark_type("Timestamp", sig.res))
        else:
            c = c.cast(spark_type(a.type, sig.res))
        out.append(c.alias(a.name))
    if "available_at" in by:
        out.append(F.col(f"`{by['available_at']}`").cast("timestamp_ntz").alias("available_at"))
    return df.select(*out)


def conflicts(df: DataFrame, sig: Signature) -> DataFrame:
    """Identities with more than one value of the outputs: a relation is a function of its identity."""
    ident = [sig.args[i].name for i in sig.identity]
    outs = [a.name for i, a in enumerate(sig.args) if i not in sig.identity and a.mode == "-"]
    keys = ident + [a.name for i, a in enumerate(sig.args) if i not in sig.identity and a.mode == "+"]
    if not outs:
        return df.select(*keys, F.lit(0).alias("versions")).where("false")
    h = F.struct(*outs)
    return df.groupBy(*keys).agg(F.min(h).alias("one"), F.max(h).alias("other")).where("one <> other").select(*keys, "one", "other")


def deduplicate(df: DataFrame) -> DataFrame:
    return df.distinct()


def bad_prices(df: DataFrame, sig: Signature, futures: DataFrame | None = None) -> DataFrame:
    """Rows with a price that is not positive, of securities that are not futures."""
    prices = [a.name for a in sig.args if a.type == "Price"]
    if not prices:
        return df.where("false")
    bad = df.where(" OR ".join(f"`{p}` <= 0" for p in prices))
    ent = next((a.name for a in sig.args if a.type == "Equity"), None)
    return bad.join(futures.select(F.col("id").alias(ent)), ent, "left_anti") if futures is not None and ent else bad


def unknown_ids(df: DataFrame, sig: Signature, securities: DataFrame) -> DataFrame:
    ent = [a.name for a in sig.args if a.type == "Equity"]
    if not ent:
        return df.where("false")
    return df.join(securities.select(F.col("id").alias(ent[0])).distinct(), ent[0], "left_anti")


def read(spark: SparkSession, env: Unit, path: str, securities: DataFrame | None = None, strict: bool = True) -> tuple[dict[str, DataFrame], list[str]]:
    """(relations, notes): one `<relation>.parquet` for each primitive; a missing file is an empty relation and a note."""
    facts, notes = {}, []
    futures = securities.where("asset_class = 'future'").select("id").distinct() if securities is not None and "asset_class" in securities.columns else None
    for sig in env.signatures:
        if sig.name == "ticker" and securities is not None and "universe" in facts:
            facts["ticker"] = tickers(facts["universe"], securities)
            continue
        try:
            raw = spark.read.parquet(f"{path}/{sig.name}.parquet")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            notes.append(f"`{sig.name}` has no file: it is empty")
            continue
        df = typed(raw, sig)
        if strict:
            nulls = " OR ".join(f"`{a.name}` IS NULL" for a in sig.args)
            _fail(df.where(nulls), f"`{sig.name}` has an empty or unreadable cell")
            _fail(conflicts(df, sig), f"`{sig.name}` has two values for one identity")
            _fail(bad_prices(df, sig, futures), f"`{sig.name}` has a price that is not positive")
            if securities is not None:
                _fail(unknown_ids(df, sig, securities), f"`{sig.name}` names an unknown security")
        facts[sig.name] = deduplicate(df)
    return facts, notes


def write(facts: dict[str, DataFrame], path: str) -> None:
    """One Parquet folder for each relation; `ticker` is derived, `available_at` is kept."""
    for name, df in facts.items():
        if name != "ticker":
            df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")


# securities: id, ticker, from (inclusive), to (exclusive, null while current)


def identity_problems(securities: DataFrame) -> DataFrame:
    """(problem, key, from, to): empty intervals, and overlaps of one id's tickers or of one ticker's ids."""
    s = securities.select("id", "ticker", F.col("from").cast("timestamp_ntz").alias("f"), F.col("to").cast("timestamp_ntz").alias("t"))
    empty = s.where("t <= f").select(F.lit("empty interval").alias("problem"), F.col("id").alias("key"), "f", "t")

    def overlap(by: str, what: str) -> DataFrame:
        before = f"lag(coalesce(t, TIMESTAMP_NTZ '9999-12-31')) OVER (PARTITION BY {by} ORDER BY f, t)"
        return s.withColumn("last", F.expr(before)).where("last > f").select(F.lit(what).alias("problem"), F.col(by).alias("key"), "f", "t")

    found = empty.union(overlap("id", "two tickers at once")).union(overlap("ticker", "two securities at once"))
    return found.withColumnsRenamed({"f": "from", "t": "to"})


def carried(s: DataFrame, t: Column) -> Column:
    """Whether a security row holds its ticker at time t."""
    t = t.cast("timestamp_ntz")
    return (s["from"].cast("timestamp_ntz") <= t) & (s["to"].isNull() | (t < s["to"].cast("timestamp_ntz")))


def tickers(universe: DataFrame, securities: DataFrame) -> DataFrame:
    """ticker(A, T, S) over the bars of the universe: an equi-join on the id, then the interval."""
    return universe.join(securities, (universe["A"] == securities["id"]) & carried(securities, universe["T"])).select("A", "T", F.col("ticker").alias("S"))


def id_of(securities: DataFrame, ticker: str, at: str) -> str:
    """The id that carries a ticker on a date; an error if none does."""
    row = securities.where(F.col("ticker") == ticker).where(carried(securities, F.lit(at).cast("timestamp_ntz"))).select("id").head()
    if row is None:
        raise DataError(f"nobody carries the ticker `{ticker}` at {at}")
    return row["id"]


# points in time


def available(df: DataFrame, sig: Signature) -> DataFrame:
    """df with `__seen`: when a tuple can be used, its bar's close or its `available_at` if that is later."""
    close = bucket_range(F.col(sig.args[sig.key].name), sig.res)[1]
    return df.withColumn("__seen", F.greatest(close, F.col("available_at")) if "available_at" in df.columns else close)


def truncated(df: DataFrame, sig: Signature, at: str, decision_res: str) -> DataFrame:
    """Tuples that a decision at the bar `at` may have seen: by availability where the relation has it, else by bar."""
    t = bucket(F.lit(at).cast("timestamp_ntz"), decision_res)
    if "available_at" in df.columns:
        return available(df, sig).where(F.col("__seen") <= bucket_range(t, decision_res)[1]).drop("__seen")
    key = F.col(sig.args[sig.key].name)
    return df.where((key if sig.res == decision_res else bucket(key.cast("timestamp_ntz"), decision_res)) <= t)
