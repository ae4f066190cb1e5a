"""Expressions over Python values, for what runs bar by bar."""

from __future__ import annotations

import math

from ruletide.dsl.ast import Call, Lit, Name, Var


class Halt(Exception):
    """Partial arithmetic without a value, where the run needs one."""


def evaluate(e, env: dict, strict: bool = False):
    """The value of an expression; None where partial arithmetic has none (or Halt, if strict)."""
    if isinstance(e, Lit):
        return e.value
    if isinstance(e, (Var, Name)):
        return env.get(e.name)
    if isinstance(e, Call):
        x = [evaluate(a, env, strict) for a in e.args]
        if any(v is None for v in x):
            return None
        match e.op:
            case "neg":
                return -x[0]
            case "+":
                return x[0] + x[1]
            case "-":
                return x[0] - x[1]
            case "*":
                return x[0] * x[1]
            case "/" if x[1] != 0:
                return x[0] / x[1]
            case "log" if x[0] > 0:
                return math.log(x[0])
            case "sqrt" if x[0] >= 0:
                return math.sqrt(x[0])
            case "exp":
                return math.exp(x[0])
            case "abs":
                return abs(x[0])
            case "least":
                return float(min(x))
            case "greatest":
                return float(max(x))
        if strict:
            raise Halt(f"`{e.op}` has no value for {x}")
    return None
