"""As-of joins: for each left row, the right rows at the latest key at or before its time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_keys(left: DataFrame, right: DataFrame, by: list[str], time: str, key: str, visible: Column | None = None, strict: bool = False, name: str = "__k") -> DataFrame:
    """Distinct (by, time) of left with the latest right key that is visible by then.

    One union, one shuffle by the group, one window: rows of both sides in order of time, and the last key seen so far.
    visible: when a right row can be seen (its key by default); strict: only keys before the time.
    """
    cols = [F.col(c) for c in by]
    l = left.select(*cols, F.col(time).alias("__t"), F.lit(None).cast(right.schema[key].dataType).alias(name), F.lit(0 if strict else 1).alias("__left")).distinct()
    r = right.select(*cols, (visible if visible is not None else F.col(key)).alias("__t"), F.col(key).alias(name), F.lit(1 if strict else 0).alias("__left")).distinct()
    r = r.withColumn("__t", F.col("__t").cast(l.schema["__t"].dataType))
    w = Window.partitionBy(*by).orderBy("__t", "__left").rowsBetween(Window.unboundedPreceding, 0)
    both = l.withColumn("__is", F.lit(True)).unionByName(r.withColumn("__is", F.lit(False)))
    # the key last in order of visibility need not be the greatest: a late tuple may carry an old key
    found = both.withColumn(name, F.max(name).over(w) if visible is not None else F.last(name, ignorenulls=True).over(w))
    return found.where(F.col("__is") & F.col(name).isNotNull()).select(*by, F.col("__t").alias(time), name)


def asof_join(left: DataFrame, right: DataFrame, by: list[str], time: str, key: str, how: str = "inner", visible: Column | None = None, strict: bool = False) -> DataFrame:
    """left with the columns of right at the latest visible key; all right rows at that key, none if there is no key."""
    keys = latest_keys(left, right, by, time, key, visible, strict)
    bound = left.join(keys, [*by, time], how)
    return bound.join(right.withColumnRenamed(key, "__k"), [*by, "__k"], how).withColumnRenamed("__k", key)
