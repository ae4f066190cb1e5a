"""Scalar functions of the rule language as columns.

Arithmetic is partial: `/` by zero, `log` of a number not above zero and `sqrt` of a negative number have no value. By default
such a value is null, and the rule that needs it derives nothing for that tuple; in strict mode it halts the query.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _partial(ok: Column, value: Column, message: str, strict: bool) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast("double")) if strict else F.when(ok, value)


def divide(a: Column, b: Column, strict: bool = False) -> Column:
    b = b.cast("double")
    return _partial(b != 0, a.cast("double") / b, "division by zero", strict)


def log(x: Column, strict: bool = False) -> Column:
    x = x.cast("double")
    return _partial(x > 0, F.log(x), "log of a number that is not positive", strict)


def sqrt(x: Column, strict: bool = False) -> Column:
    x = x.cast("double")
    return _partial(x >= 0, F.sqrt(x), "sqrt of a negative number", strict)


def least(*xs: Column) -> Column:
    return F.least(*(x.cast("double") for x in xs))


def greatest(*xs: Column) -> Column:
    return F.greatest(*(x.cast("double") for x in xs))
