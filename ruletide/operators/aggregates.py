"""Aggregates of the rule language as SQL text, so that one definition serves a group and a window frame."""

from __future__ import annotations

from pyspark.sql import functions as F


def aggregate_sql(func: str, args: list[str], level: float | None = None) -> str:
    """SQL of an aggregate over columns of doubles; null where the reference has no value (too few or constant inputs)."""
    x = args[0] if args else "1"
    two = f"{args[0]}, {args[1]}" if len(args) > 1 else ""
    pair = f"{args[0]} IS NOT NULL AND {args[1]} IS NOT NULL" if two else ""
    # Spark's corr divides by zero on a constant series; here that is no value
    both = [f"CASE WHEN {pair} THEN {a} END" for a in args] if two else ["", ""]
    return {
        "sum": f"sum({x})",
        "mean": f"avg({x})",
        "std": f"stddev_samp({x})",
        "median": f"percentile({x}, 0.5D)",
        "quantile": f"percentile({x}, {level}D)",
        "max": f"max({x})",
        "min": f"min({x})",
        "corr": f"try_divide(covar_pop({two}), stddev_pop({both[0]}) * stddev_pop({both[1]}))",
        "cov": f"covar_samp({two})",
        "ols_beta": f"regr_slope({two})",
        "pairs": f"count(CASE WHEN {pair} THEN 1 END)",
    }[func]


def needs_two(func: str) -> bool:
    return func in ("std", "corr", "cov", "ols_beta")


def ordered(by: str, func: str):
    """first / last of a bucket, by the fine key."""
    pick = F.min_by if func == "first" else F.max_by
    return lambda value: pick(value, F.col(by))
