"""Linking parsed units into a program: names, parameters, dependencies, strata and what needs the simulated executor."""

from __future__ import annotations

from dataclasses import dataclass, field

from ruletide.dsl.ast import FEEDBACK, Aggregate, Arg, Atom, Lit, Param, Rank, Resample, Rule, Signature, Top, Unit
from ruletide.dsl.parser import parse

_FEEDBACK_TYPES = {"A": "Equity", "T": "Timestamp", "Q": "Quantity", "C": "Notional", "N": "Notional", "P": "Price", "D": "Decision"}


class LinkError(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass
class Relation:
    sig: Signature
    kind: str  # primitive, derived, feedback, output
    unit: Unit
    rules: list[Rule] = field(default_factory=list)
    reads: set[str] = field(default_factory=set)

    @property
    def name(self) -> str:
        return self.sig.name


def atoms(body, inside: bool = False):
    """(atom, how) of every relation read; how: plain, not, aggregate."""
    for lit in body:
        if isinstance(lit, Atom):
            yield lit, "not" if lit.negated else "aggregate" if inside else "plain"
        elif isinstance(lit, (Top, Rank, Resample)):
            yield lit.atom, "aggregate"
        elif isinstance(lit, Aggregate):
            yield from atoms(lit.body, True)


@dataclass
class Program:
    units: dict[str, Unit]
    goal: Unit | None
    env: Unit
    relations: dict[str, Relation]
    params: dict[tuple[str, str], Param]

    def param(self, unit: str, name: str) -> Param | None:
        return self.params.get((unit, name))

    def components(self) -> list[list[str]]:
        """Strongly connected relations, callees first."""
        index, low, stack, out, state = {}, {}, [], [], {"n": 0}

        def visit(v):
            index[v] = low[v] = state["n"]
            state["n"] += 1
            stack.append(v)
            for w in sorted(self.relations[v].reads):
                if w not in self.relations:
                    continue
                if w not in index:
                    visit(w)
                    low[v] = min(low[v], low[w])
                elif w in stack:
                    low[v] = min(low[v], index[w])
            if low[v] == index[v]:
                cut = stack.index(v)
                out.append(stack[cut:])
                del stack[cut:]

        for v in sorted(self.relations):
            if v not in index:
                visit(v)
        return out

    def closed_loop(self) -> set[str]:
        """Relations that read the executor's feedback, directly or not."""
        found = {n for n, r in self.relations.items() if r.kind == "feedback"}
        while True:
            more = {n for n, r in self.relations.items() if n not in found and r.reads & found}
            if not more:
                return found
            found |= more

    def strata(self) -> dict[str, int]:
        level: dict[str, int] = {}
        for group in self.components():
            n = max([level[w] + 1 for v in group for w in self.relations[v].reads if w in level and w not in group] or [0])
            level.update(dict.fromkeys(group, n))
        return level

    def reachable(self, goal: str) -> set[str]:
        seen, todo = set(), [goal]
        while todo:
            v = todo.pop()
            if v in self.relations and v not in seen:
                seen.add(v)
                todo += self.relations[v].reads
        return seen


def feedback_signatures(res: str | None) -> list[Signature]:
    out = []
    for name, code in FEEDBACK.items():
        args = []
        for i, c in enumerate(code.replace("+", "").replace("-", "")):
            mode = "@" if c == "T" else "-"
            args.append(Arg(mode, c, _FEEDBACK_TYPES[c], "USD" if c in "CNP" else None))
        out.append(Signature(name, tuple(args), res, complete=True))
    return out


def link(units: list[Unit] | str, goal: str | None = None) -> Program:
    """Resolve the units that a goal unit needs; without a goal, the last strategy (else library) is it."""
    if isinstance(units, str):
        units = parse(units)
    by_name: dict[str, Unit] = {}
    for u in units:
        if u.name in by_name:
            raise LinkError("U", f"unit `{u.name}` is defined twice")
        by_name[u.name] = u
    rules = [u for u in units if u.kind != "environment"]
    top = by_name.get(goal) if goal else next((u for u in reversed(rules) if u.kind == "strategy"), rules[-1] if rules else None)
    env = by_name.get(top.env) if top is not None and top.env else next((u for u in units if u.kind == "environment"), None)
    if env is None or env.kind != "environment":
        raise LinkError("E", f"environment `{top.env if top else None}` is not defined")
    order: list[Unit] = []

    def use(u: Unit):
        for name in u.uses:
            lib = by_name.get(name)
            if lib is None or lib.kind != "library":
                raise LinkError("U", f"library `{name}` is not defined")
            if lib.env and lib.env != env.name:
                raise LinkError("E", f"library `{name}` is of environment `{lib.env}`, not `{env.name}`")
            use(lib)
        if u not in order:
            order.append(u)

    if top is not None:
        use(top)
    relations = {s.name: Relation(s, "primitive", env) for s in env.signatures}
    params: dict[tuple[str, str], Param] = {}
    for s in feedback_signatures(top.res if top else "1d"):
        relations[s.name] = Relation(s, "feedback", env)
    for u in order:
        for p in u.params:
            params[u.name, p.name] = p
        for s in u.signatures:
            if s.name in relations:
                raise LinkError("U", f"relation `{s.name}` is defined twice")
            res = s.res or u.res
            relations[s.name] = Relation(Signature(s.name, s.args, res, s.complete, s.at), "derived", u)
    if top is not None and top.kind == "strategy":
        relations["decide"] = Relation(Signature("decide", (Arg("@", "T", "Timestamp"), Arg("-", "D", "Decision")), top.res), "output", top)
    for u in order:
        for r in u.rules:
            rel = relations.get(r.head.name)
            if rel is None or rel.kind not in ("derived", "output") or rel.unit is not u:
                raise LinkError("U", f"rule head `{r.head.name}` is not a relation of unit `{u.name}`")
            rel.rules.append(r)
            rel.reads |= {a.name for a, _ in atoms(r.body)}
    return Program(by_name, top, env, relations, params)


def literal_of(param: Param, override=None) -> Lit:
    if override is None:
        return param.default
    value = override.value if isinstance(override, Lit) else override
    lit = Lit(value, param.default.unit)
    if param.low is not None:
        rank = lambda v: v.approx if hasattr(v, "approx") else v
        if not rank(param.low.value) <= rank(value) <= rank(param.high.value):
            raise LinkError("T", f"parameter `{param.name}` = {value} is out of its range")
    return lit
