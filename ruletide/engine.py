"""The programmatic entry: a program over tables, and its relations as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ruletide.dsl.ast import Duration
from ruletide.dsl.parser import tokens
from ruletide.plans.compiler import Compiler
from ruletide.plans.program import Program, link


def value(x):
    """A constant as the rule language sees it; a text like `20d` becomes a duration."""
    if isinstance(x, str):
        try:
            t = tokens(x)
        except Exception:  # noqa: BLE001 - any other text is a label
            return x
        if len(t) == 2 and isinstance(t[0].value, Duration):
            return t[0].value
    return x


class Engine:
    """Engine(spark, text, facts).relation("sma", N="20d", K=12): a relation with inputs fixed."""

    def __init__(self, spark: SparkSession, text: str, facts: dict[str, DataFrame], goal: str | None = None, params: dict | None = None, strict: bool = False, sums: str = "auto"):
        self.program: Program = link(text, goal)
        self.compiler = Compiler(spark, self.program, facts, {k: value(v) for k, v in (params or {}).items()}, strict, sums)

    def relation(self, name: str, **inputs) -> DataFrame:
        sig = self.program.relations[name].sig
        return self.compiler.relation(name, tuple(value(inputs[a.name]) if a.name in inputs else None for a in sig.args))

    def decisions(self) -> DataFrame:
        """Decisions of rules that need no feedback, flat: T, ctor, equity, amount, order kind."""
        d = self.compiler.relation("decide")
        return d.selectExpr("T", "D.ctor as ctor", "D.equity as equity", "D.amount as amount", "D.`order`.kind as order_kind")
