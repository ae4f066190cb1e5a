"""The bar-by-bar interpreter of rules that read the executor's feedback.

Relations without feedback arrive as finished tuples (computed by Spark); the rest is solved here, tuple at a time, with the
same literals as the compiler: atoms match patterns, windows walk the bars, results are kept for each call.
"""

from __future__ import annotations

import calendar
import math
from bisect import bisect_left, bisect_right
from collections import defaultdict
from datetime import datetime, timedelta, timezone

from ruletide.dsl.ast import CONSTRUCTORS, RESOLUTIONS, TEMPORAL, Aggregate, Atom, Call, Compare, Duration, Lit, Name, Rank, Resample, Top, Var, Wild, Window, variables, windows_first
from ruletide.loop.executor import Decision, RiskHalt, SimExecutor
from ruletide.loop.interpreter import evaluate
from ruletide.loop.market import DAY, moment
from ruletide.plans.program import Program, literal_of

_CONST_TYPES = ("Duration", "Count", "Scalar", "Price", "Notional", "Quantity")


def minus(t: int, d: Duration) -> int:
    x = datetime.fromtimestamp(t, timezone.utc)
    if d.months:
        m = x.year * 12 + x.month - 1 - d.months
        y, m = divmod(m, 12)
        x = x.replace(year=y, month=m + 1, day=min(x.day, calendar.monthrange(y, m + 1)[1]))
    return int((x - timedelta(days=d.days)).timestamp())


def quantile(xs: list[float], q: float) -> float:
    xs = sorted(xs)
    at = q * (len(xs) - 1)
    lo = math.floor(at)
    hi = min(lo + 1, len(xs) - 1)
    return xs[lo] + (xs[hi] - xs[lo]) * (at - lo)


def aggregate(func: str, rows: list[tuple]):
    """An aggregate over rows of arguments; None where it has no value."""
    if func == "count":
        return len(rows)
    if not rows:
        return None
    x = [float(r[0]) for r in rows]
    n, mean = len(x), math.fsum(x) / len(x)
    match func:
        case "sum":
            return math.fsum(x)
        case "mean":
            return mean
        case "min" | "max":
            return min(x) if func == "min" else max(x)
        case "median":
            return quantile(x, 0.5)
        case "quantile":
            return quantile(x, rows[0][1])
        case "first" | "last":
            return x[0] if func == "first" else x[-1]
    if n < 2:
        return None
    if func == "std":
        return math.sqrt(math.fsum((v - mean) ** 2 for v in x) / (n - 1))
    y = [float(r[1]) for r in rows]
    my = math.fsum(y) / n
    cov = math.fsum((a - mean) * (b - my) for a, b in zip(x, y, strict=True)) / (n - 1)
    vx, vy = (math.fsum((a - m) ** 2 for a in v) / (n - 1) for v, m in ((x, mean), (y, my)))
    if func == "cov":
        return cov
    if func == "ols_beta":
        return cov / vy if vy else None
    return cov / math.sqrt(vx * vy) if vx and vy else None


class Store:
    """Tuples of a relation by bar, and by bar and entity."""

    def __init__(self, key: int, entity: int | None = None):
        self.key, self.entity = key, entity
        self.by: dict[int, list[tuple]] = defaultdict(list)
        self.by_entity: dict[tuple, list[tuple]] = defaultdict(list)
        self._bars: list[int] | None = None

    def add(self, tup: tuple) -> None:
        t = tup[self.key]
        self.by[t].append(tup)
        if self.entity is not None:
            self.by_entity[t, tup[self.entity]].append(tup)
        self._bars = None

    def matching(self, pattern: list) -> list[tuple]:
        """Tuples at the pattern's bar that match it; the entity is looked up, other bound positions are compared."""
        t, known = pattern[self.key], 1
        if self.entity is not None and pattern[self.entity] is not None:
            found, known = self.by_entity.get((t, pattern[self.entity]), ()), 2
        else:
            found = self.by.get(t, ())
        if len(pattern) - pattern.count(None) == known:
            return list(found)
        return [x for x in found if _fits(x, pattern)]

    def bars(self) -> list[int]:
        if self._bars is None:
            self._bars = sorted(self.by)
        return self._bars


class Kernel:
    def __init__(self, program: Program, domains: dict[str, list[int]], overrides: dict | None = None):
        self.p, self.domains, self.overrides = program, domains, overrides or {}
        self.closed = program.closed_loop()
        self.stores: dict[tuple, Store] = {}
        self.memo: dict[tuple, list[tuple]] = {}
        self.exec: SimExecutor | None = None
        self.decided: dict[int, list[Decision]] = {}
        self.busy: set[tuple] = set()

    # data

    def store(self, name: str, consts: tuple | None = None) -> Store:
        sig = self.p.relations[name].sig
        at = (name, consts or (None,) * len(sig.args))
        if at not in self.stores:
            self.stores[at] = Store(sig.key, next((i for i, a in enumerate(sig.args) if a.type == "Equity"), None))
        return self.stores[at]

    def consts_of(self, name: str, values: list) -> tuple:
        """Inputs that a derived relation is specialised by: those that are neither entity, time nor label."""
        rel = self.p.relations[name]
        if rel.kind != "derived":
            return (None,) * len(values)
        return tuple(v if a.mode == "+" and a.type in _CONST_TYPES else None for a, v in zip(rel.sig.args, values, strict=True))

    def constant(self, name: str, unit: str):
        p = self.p.param(unit, name)
        return literal_of(p, self.overrides.get(name)).value if p else None

    # calls

    def tuples(self, name: str, pattern: list) -> list[tuple]:
        """Tuples at the bound key that match the pattern (None is free)."""
        rel = self.p.relations[name]
        t = pattern[rel.sig.key]
        if rel.kind == "feedback":
            return [x for x in self.feedback(name, t) if _fits(x, pattern)]
        if name not in self.closed:
            return self.store(name, self.consts_of(name, pattern)).matching(pattern)
        bound = tuple(v if a.mode in "+@" else None for a, v in zip(rel.sig.args, pattern, strict=True))
        at = (name, bound)
        if at not in self.memo:
            if at in self.busy:
                return []
            self.busy.add(at)
            try:
                found: dict[tuple, None] = {}
                for r in rel.rules:
                    for head in self.rule(r, rel, list(bound)):
                        found.setdefault(head)
                self.memo[at] = list(found)
            finally:
                self.busy.discard(at)
        return [x for x in self.memo[at] if _fits(x, pattern)]

    def feedback(self, name: str, t: int) -> list[tuple]:
        e = self.exec
        if name == "position":
            return [(s, t, q) for s, q in sorted(e.position_at.get(t, {}).items())]
        if name == "fill":
            return [(s, t, q, p) for s, q, p in e.fill_at.get(t, [])]
        if name == "decided":
            return [(t, d) for d in self.decided.get(t, [])]
        at = e.cash_at if name == "cash" else e.nav_at
        return [(t, at[t])] if t in at else []

    def rule(self, r, rel, pattern: list):
        env: dict = {}
        for term, v in zip(r.head.args, pattern, strict=True):
            if v is None:
                continue
            if isinstance(term, Var):
                if term.name in env and env[term.name] != v:
                    return
                env[term.name] = v
            else:
                c = self.value(term, {}, rel)
                if c is not None and c != v:
                    return
        for out in self.solve(windows_first(r.body), env, rel):
            head = tuple(self.value(a, out, rel) for a in r.head.args)
            if None not in head:
                yield head

    def value(self, e, env: dict, rel):
        if isinstance(e, Call) and e.op in CONSTRUCTORS["delta"] + CONSTRUCTORS["target"]:
            return self.make(e, env, rel)
        return evaluate(e, _Names(env, self, rel.unit.name))

    def make(self, e: Call, env: dict, rel) -> Decision | None:
        equity, amount = self.value(e.args[0], env, rel), self.value(e.args[1], env, rel)
        if equity is None or amount is None:
            return None
        order = e.args[2] if len(e.args) > 2 else Name("market")
        if isinstance(order, Name):
            return Decision(e.op, equity, float(amount), order.name)
        tif = order.args[1] if len(order.args) > 1 else Name("day")
        n = int(self.value(tif.args[0], env, rel)) if isinstance(tif, Call) else 0
        return Decision(e.op, equity, float(amount), order.op, float(self.value(order.args[0], env, rel)), tif.op if isinstance(tif, Call) else tif.name, n)

    # literals

    def solve(self, body: list, env: dict, rel):
        if not body:
            yield env
            return
        for out in self.step(body[0], env, rel):
            yield from self.solve(body[1:], out, rel)

    def match(self, a: Atom, tup: tuple, env: dict, rel):
        out = env
        for term, v in zip(a.args, tup, strict=True):
            if isinstance(term, Wild):
                continue
            if isinstance(term, Var):
                if term.name in out:
                    if out[term.name] != v:
                        return None
                else:
                    out = {**out, term.name: v}
            elif isinstance(term, Call) and isinstance(v, Decision):
                if term.op != v.ctor:
                    return None
                for t, x in zip(term.args, (v.equity, v.amount)):
                    if isinstance(t, Var) and t.name not in out:
                        out = {**out, t.name: x}
                    elif not isinstance(t, Wild) and self.value(t, out, rel) != x:
                        return None
            elif self.value(term, out, rel) != v:
                return None
        return out

    def pattern(self, a: Atom, env: dict, rel) -> list:
        out = []
        for term in a.args:
            free = isinstance(term, Wild) or (isinstance(term, Var) and term.name not in env) or (isinstance(term, Call) and term.op in CONSTRUCTORS["delta"] + CONSTRUCTORS["target"])
            out.append(None if free else self.value(term, env, rel))
        return out

    def atom(self, a: Atom, env: dict, rel):
        sig, pat = self.p.relations[a.name].sig, self.pattern(a, env, rel)
        if a.asof is not None:
            t = self.value(a.asof, env, rel)
            if sig.res == "1d" and rel.sig.res != "1d":
                t = t - DAY + 1
            pat[sig.key] = None
            for k in self.back(a.name, pat, t):
                found = [o for x in self.tuples(a.name, [*pat[: sig.key], k, *pat[sig.key + 1 :]]) if (o := self.match(Atom(a.name, tuple(Wild() if i == sig.key and isinstance(a.args[i], Wild) else y for i, y in enumerate(a.args))), x, env, rel)) is not None]
                if found:
                    yield from found
                    return
            return
        if pat[sig.key] is None:
            bars = self.store(a.name, self.consts_of(a.name, pat)).bars() if a.name not in self.closed else self.domains[sig.res]
        else:
            bars = [pat[sig.key]]
        for k in bars:
            pat[sig.key] = k
            for x in self.tuples(a.name, pat):
                o = self.match(a, x, env, rel)
                if o is not None:
                    yield o

    def back(self, name: str, pat: list, t: int):
        sig = self.p.relations[name].sig
        bars = self.store(name, self.consts_of(name, pat)).bars() if name not in self.closed else self.domains[sig.res]
        for i in range(bisect_right(bars, t) - 1, -1, -1):
            yield bars[i]

    def bars(self, rel) -> list[int]:
        return self.domains[rel.sig.res]

    def step(self, lit, env: dict, rel):
        match lit:
            case Atom() if lit.name in TEMPORAL:
                yield from self.temporal(lit, env, rel)
            case Atom() if lit.negated:
                if next(self.atom(Atom(lit.name, lit.args, False, lit.asof), env, rel), None) is None:
                    yield env
            case Atom():
                yield from self.atom(lit, env, rel)
            case Compare():
                if lit.op == "=" and isinstance(lit.left, Var) and lit.left.name not in env:
                    v = self.value(lit.right, env, rel)
                    if v is not None:
                        yield {**env, lit.left.name: v}
                    return
                a, b = self.value(lit.left, env, rel), self.value(lit.right, env, rel)
                if a is not None and b is not None:
                    a, b = (x.approx if isinstance(x, Duration) else x for x in (a, b))
                    if {"<": a < b, "<=": a <= b, "=": a == b, ">=": a >= b, ">": a > b}[lit.op]:
                        yield env
            case Window():
                t, n, bars = self.value(lit.time, env, rel), self.value(lit.length, env, rel), self.bars(rel)
                hi = bisect_left(bars, t) if lit.kind == "prior_window" else bisect_right(bars, t)
                lo = 0 if lit.kind == "rows" else bisect_left(bars, minus(t, n))
                for u in bars[lo:hi]:
                    yield {**env, lit.var: u}
            case Aggregate():
                yield from self.fold(lit, env, rel)
            case Top() | Rank():
                found = list(self.atom(lit.atom, env, rel))
                free = [v for v in variables(lit.atom) if v not in env]
                for v in reversed(free):
                    found.sort(key=lambda o, v=v: _ord(o[v]))
                for v, down in reversed(lit.by):
                    found.sort(key=lambda o, v=v: _ord(o[v]), reverse=down)
                if isinstance(lit, Top):
                    yield from found[: int(self.value(lit.n, env, rel))]
                    return
                keys = [tuple(o[v] for v, _ in lit.by) for o in found]
                for i, o in enumerate(found):
                    same = [j + 1 for j, k in enumerate(keys) if k == keys[i]] if lit.average else [i + 1]
                    yield {**o, lit.var: sum(same) / len(same)}
            case Resample():
                yield from self.resample(lit, env, rel)

    def temporal(self, a: Atom, env: dict, rel):
        bars, t = self.bars(rel), self.value(a.args[0], env, rel)
        i = bisect_left(bars, t)
        if a.name in ("month_start", "day_start"):
            form = "%Y-%m" if a.name == "month_start" else "%Y-%m-%d"
            label = lambda x: datetime.fromtimestamp(x, timezone.utc).strftime(form)
            if (i == 0 or label(bars[i - 1]) != label(t)) != a.negated:
                yield env
            return
        if a.name == "lag":
            i = bisect_right(bars, minus(t, self.value(a.args[1], env, rel)))
        if i:
            out = a.args[-1]
            if isinstance(out, Wild):
                yield env
            elif out.name not in env:
                yield {**env, out.name: bars[i - 1]}
            elif env[out.name] == bars[i - 1]:
                yield env

    def fold(self, lit: Aggregate, env: dict, rel):
        body = windows_first(lit.body)
        frames = [b for b in body if isinstance(b, Window)]
        rows = [f for f in frames if f.kind == "rows"]
        got = list(self.solve(body, env, rel))
        if rows:
            f = rows[0]
            anchor = next(b for b in body if isinstance(b, Atom) and not b.negated)
            t, n = self.value(f.time, env, rel), int(self.value(f.length, env, rel))
            have = {o[f.var] for o in got}
            held = []
            bars = self.bars(rel)
            for u in reversed(bars[: bisect_right(bars, t)]):
                if u in have or next(self.atom(anchor, {**env, f.var: u}, rel), None) is not None:
                    held.append(u)
                    if len(held) == n:
                        break
            got = [o for o in got if o[f.var] in set(held)]
        least = max([int(self.value(f.least, env, rel)) for f in frames] or [0])
        if len(got) < least or (not got and lit.func != "count"):
            return
        v = aggregate(lit.func, [tuple(self.value(a, o, rel) for a in lit.args) for o in got])
        if v is not None:
            yield {**env, lit.var: v}

    def resample(self, lit: Resample, env: dict, rel):
        sig = self.p.relations[lit.atom.name].sig
        key = lit.atom.args[sig.key].name
        groups: dict[tuple, list] = defaultdict(list)
        names = [t.name for a, t in zip(sig.args, lit.atom.args, strict=True) if isinstance(t, Var) and a.type == "Equity"]
        length, found = RESOLUTIONS[lit.to], self.atom(lit.atom, env, rel)
        if env.get(lit.time) is not None and key not in env and lit.atom.asof is None and lit.atom.name not in self.closed:
            # of a bar that is known, only its own instants
            at, times = env[lit.time], self.store(lit.atom.name, self.consts_of(lit.atom.name, self.pattern(lit.atom, env, rel))).bars()
            lo, hi = (at, at + DAY - 1) if lit.to == "1d" else (at - length + 1, at)
            found = (o for k in times[bisect_left(times, lo) : bisect_right(times, hi)] for o in self.atom(lit.atom, {**env, key: k}, rel))
        for o in found:
            bar = o[key] // DAY * DAY if lit.to == "1d" else -(-o[key] // length) * length
            if env.get(lit.time, bar) == bar:
                groups[(bar, *(o[n] for n in names))].append(o)
        for (bar, *who), rows in sorted(groups.items(), key=lambda g: tuple(map(_ord, g[0]))):
            rows.sort(key=lambda o: o[key])
            if len(rows) >= int(self.value(lit.least, env, rel)):
                out = {**env, lit.time: bar, **dict(zip(names, who, strict=True))}
                for var, func, e in lit.outputs:
                    out[var] = aggregate(func, [(self.value(e, o, rel),) for o in rows])
                yield out

    # the run

    def decide(self, t: int) -> list[tuple[Decision, str]]:
        rel = self.p.relations["decide"]
        out, seen = [], {}
        for i, r in enumerate(rel.rules):
            label = f"decide#{i + 1}"
            for _, d in self.rule(r, rel, [t, None]):
                if (d, i) in seen:
                    continue
                seen[d, i] = label
                if rel.unit.mode == "delta" and not d.amount > 0:
                    raise RiskHalt(f"{moment(t)} {d.text()} by {label}: delta decisions require a positive quantity")
                out.append((d, label))
        by: dict[str, tuple] = {}
        unique = []
        for d, label in out:
            if d.equity in by:
                if by[d.equity][0] == d:
                    continue
                raise RiskHalt(f"{moment(t)}: {by[d.equity][0].text()} by {by[d.equity][1]} conflicts with {d.text()} by {label}")
            by[d.equity] = (d, label)
            unique.append((d, label))
        if self.exec is None or "decided" in self.exec.reads:
            self.decided[t] = [d for d, _ in unique]
        return unique

    def bar(self, t: int, first: bool) -> list[tuple[Decision, str]]:
        """One decision bar: fill, open, decide, take."""
        if not first:
            self.exec.fill(t)
        self.exec.open_bar(t)
        found = self.decide(t)
        for d, rule in found:
            self.exec.events.append(("decision", t, {"equity": d.equity, "ctor": d.ctor, "amount": d.amount, "order": d.kind, "rule": rule}))
        self.exec.take(t, found)
        return found

    def run(self, executor: SimExecutor, bars: list[int], ledger: tuple[str, ...] = ()) -> SimExecutor:
        """All bars; the tuples of the ledger's relations at each bar become events."""
        self.exec = executor
        for i, t in enumerate(bars):
            self.bar(t, i == 0)
            for name in ledger:
                sig = self.p.relations[name].sig
                for tup in self.tuples(name, [t if k == sig.key else None for k in range(len(sig.args))]):
                    executor.events.append(("ledger", t, {"relation": name, "values": [v for k, v in enumerate(tup) if k != sig.key]}))
        executor.finish()
        return executor

    def coverage(self) -> dict[str, int]:
        """Tuples derived of each relation that was called."""
        out: dict[str, int] = defaultdict(int)
        for (name, _), found in self.memo.items():
            out[name] += len(found)
        for (name, _), s in self.stores.items():
            out[name] += sum(map(len, s.by.values()))
        return dict(out)


class _Names(dict):
    """Variables, and parameters of the rule's unit."""

    def __init__(self, env: dict, kernel: Kernel, unit: str):
        super().__init__(env)
        self.kernel, self.unit = kernel, unit

    def get(self, name, default=None):
        return self[name] if name in self else self.kernel.constant(name, self.unit)


def _fits(tup: tuple, pattern: list) -> bool:
    for p, v in zip(pattern, tup, strict=True):
        if p is not None and p != v:
            return False
    return True


def _ord(v):
    return (0, v) if isinstance(v, (int, float)) else (1, str(v))


def needs(program: Program, overrides: dict | None = None) -> list[tuple[str, tuple]]:
    """The open-loop relations, with their constant inputs, that the closed-loop rules of the goal read."""
    k = Kernel(program, {}, overrides)
    found: dict[tuple, None] = {}
    seen: set[tuple] = set()

    def walk(name: str, consts: tuple) -> None:
        if (name, consts) in seen:
            return
        seen.add((name, consts))
        rel = program.relations[name]
        if name != "decide" and name not in k.closed:
            found[name, consts] = None
            return
        if rel.kind == "feedback":
            return
        for r in rel.rules:
            env = {t.name: c for t, c in zip(r.head.args, consts, strict=True) if isinstance(t, Var) and c is not None}
            visit(r.body, env, rel)

    def visit(body, env: dict, rel) -> None:
        for lit in body:
            if isinstance(lit, Aggregate):
                visit(lit.body, env, rel)
            a = lit if isinstance(lit, Atom) else getattr(lit, "atom", None)
            if a is not None and a.name not in TEMPORAL:
                values = [None if isinstance(x, Wild) or (isinstance(x, Call) and x.op in CONSTRUCTORS["delta"] + CONSTRUCTORS["target"]) else k.value(x, env, rel) if isinstance(x, (Lit, Name, Var, Call)) else None for x in a.args]
                sig = program.relations[a.name].sig
                consts = k.consts_of(a.name, values)
                missing = [s.name for s, c in zip(sig.args, consts, strict=True) if s.mode == "+" and s.type in _CONST_TYPES and c is None and program.relations[a.name].kind == "derived"]
                if missing and a.name not in k.closed:
                    raise ValueError(f"input `{missing[0]}` of `{a.name}` must be a constant where a closed-loop rule reads it")
                walk(a.name, consts)

    walk("decide", (None, None))
    return list(found)
