"""Rule text from a syntax tree; parsing it again gives the same tree."""

from __future__ import annotations

from ruletide.dsl.ast import Aggregate, Arg, Atom, Call, Compare, Duration, Lit, Name, Rank, Resample, Rule, Signature, Top, Unit, Var, Wild, Window

_POWER = {"+": 1, "-": 1, "*": 2, "/": 2}


def term(e, power: int = 0) -> str:
    if isinstance(e, (Var, Name)):
        return e.name
    if isinstance(e, Wild):
        return "_"
    if isinstance(e, Lit):
        if isinstance(e.value, str):
            return f'"{e.value}"'
        text = str(e.value) if isinstance(e.value, Duration) else repr(e.value)
        return f"{text} {e.unit}" if e.unit else text
    if isinstance(e, Call) and e.op in _POWER and len(e.args) == 2:
        own = _POWER[e.op]
        text = f"{term(e.args[0], own)} {e.op} {term(e.args[1], own + 1)}"
        return f"({text})" if own < power else text
    if e.op == "neg":
        return f"-{term(e.args[0], 3)}"
    return f"{e.op}({', '.join(map(term, e.args))})"


def _order(by) -> str:
    return ", ".join(f"{v} {'desc' if down else 'asc'}" for v, down in by)


def literal(x) -> str:
    if isinstance(x, Atom):
        text = f"{'not ' if x.negated else ''}{x.name}({', '.join(map(term, x.args))})"
        return text if x.asof is None else f"{text} asof {term(x.asof)}"
    if isinstance(x, Compare):
        return f"{term(x.left)} {x.op} {term(x.right)}"
    if isinstance(x, Window):
        least = f", min {term(x.least)}" if x.least is not None else ""
        return f"{x.var} in {x.kind}({term(x.time)}, {term(x.length)}{least})"
    if isinstance(x, Aggregate):
        return f"{x.var} = {x.func}({', '.join(map(term, x.args))}) over ({', '.join(map(literal, x.body))})"
    if isinstance(x, Top):
        return f"top({term(x.n)}, {literal(x.atom)}, by ({_order(x.by)}))"
    if isinstance(x, Rank):
        return f"rank({literal(x.atom)}, by ({_order(x.by)}){', ties average' if x.average else ''}, as {x.var})"
    if isinstance(x, Resample):
        out = ", ".join(f"{v} = {f}({term(e)})" for v, f, e in x.outputs)
        return f"resample({literal(x.atom)} to @{x.to} as {x.time}, min {term(x.least)}, {out})"
    raise TypeError(f"no rule text for {type(x).__name__}")


def _type(a: Arg) -> str:
    unit = "Shares" if a.type == "Quantity" else a.currency
    return f"{a.type}<{unit}>" if unit else a.type


def signature(s: Signature) -> str:
    args = ", ".join(f"{a.mode}{a.name}: {_type(a)}" for a in s.args)
    return f"{s.name}({args}){f' @{s.res}' if s.res else ''}{' complete' if s.complete else ''}"


def rule(r: Rule) -> str:
    return f"{literal(r.head)} :- {', '.join(map(literal, r.body))}."


def library(u: Unit) -> str:
    """The text of a library unit."""
    lines = [f"library {u.name} {{", *([f"  env {u.env}"] if u.env else []), *([f"  uses {', '.join(u.uses)}"] if u.uses else []), f"  resolution @{u.res}"]
    lines += [f"  rel {signature(s)}" for s in u.signatures]
    return "\n".join([*lines, *(f"  {rule(r)}" for r in u.rules), "}", ""])
