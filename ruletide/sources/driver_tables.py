"""The benchmark's star schema read as relations: suppliers as instruments, ship dates as bars, events as minute ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruletide.operators.temporal import bucket
from ruletide.session import keep

ENV_1D = """
environment market_1d {
  close(+A: Equity, @T: Timestamp, -P: Price<USD>) @1d
  volume(+A: Equity, @T: Timestamp, -V: Quantity<Shares>) @1d
  universe(-A: Equity, @T: Timestamp) @1d complete
  split(+A: Equity, @T: Timestamp, -Factor: Scalar) @1d complete
  dividend(+A: Equity, @T: Timestamp, -Ex: Timestamp, -D: Price<USD>) @1d complete
  member(+A: Equity, @T: Timestamp, +Idx: Label) @1d complete
  order_status(+A: Equity, @T: Timestamp, -S: Label) @1d
}
"""

ENV_1M = """
environment market_1m {
  tick(+A: Equity, @T: Timestamp, -P: Price<USD>) @1m
  tick_volume(+A: Equity, @T: Timestamp, -V: Quantity<Shares>) @1m
  universe_m(-A: Equity, @T: Timestamp) @1m complete
}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def market_1d(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Facts of market_1d; each aggregate prunes the scan to its columns, and ties of a day are order-free."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("A"), F.to_date("l_shipdate").alias("T"), "l_extendedprice", "l_quantity")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("A"), F.to_date("o_orderdate").alias("T"), F.col("o_orderstatus").alias("S"))
    # every relation of the market is a view of one table of bars, aggregated once and kept while a query reads it often
    bars = keep(items.groupBy("A", "T").agg(F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("P"), F.sum("l_quantity").alias("V")))
    close, volume = bars.select("A", "T", "P"), bars.select("A", "T", "V")
    nations = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    index = nations.select(F.col("s_suppkey").cast("string").alias("A"), F.col("r_name").alias("Idx"))
    return {
        "close": close,
        "volume": volume,
        "universe": volume.where("V >= 15").select("A", "T"),
        "split": volume.where("V >= 90").select("A", "T", F.lit(2.0).alias("Factor")),
        "dividend": close.where("P >= 1990").select("A", "T", F.date_add("T", 30).alias("Ex"), (F.col("P") / 100).alias("D")),
        "member": volume.select("A", "T").join(index, "A"),
        "order_status": orders.groupBy("A", "T").agg(F.min("S").alias("S")),
    }


def market_1m(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("A"), bucket(F.col("ts"), "1m").alias("T"), "value")
    by = events.groupBy("A", "T")
    return {"tick": by.agg(F.max("value").alias("P")), "tick_volume": by.agg(F.count("*").cast("double").alias("V")), "universe_m": by.agg(F.count("*").alias("n")).select("A", "T")}
