"""Rules to DataFrames.

A rule keeps one DataFrame whose columns are the variables bound so far, and each literal extends it: an atom joins, `not`
anti-joins, a comparison filters, an assignment adds a column, an aggregate groups or frames, `top` and `rank` number rows.
A relation is the distinct union of its rules. Relations with inputs are specialised at the call: constants are substituted
(one plan for each distinct set), variables stay columns. Only what the goal reads is ever planned.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ruletide import session
from ruletide.dsl.ast import CONSTRUCTORS, RESOLUTIONS, TEMPORAL, Aggregate, Atom, Call, Compare, Duration, Lit, Name, Rank, Resample, Rule, Signature, Top, Var, Wild, variables
from ruletide.dsl.ast import Window as Frame
from ruletide.functions import partial
from ruletide.operators import temporal
from ruletide.operators.aggregates import aggregate_sql, needs_two
from ruletide.operators.asof import latest_keys
from ruletide.operators.recursion import carry, scan
from ruletide.operators.windows import frame_aggregate
from ruletide.plans.program import Program, atoms, literal_of

_SPARK_TYPES = {"Equity": "string", "Label": "string", "Count": "bigint", "Decision": None, "Duration": "string"}
LONG_FRAME = 256  # bars
ORDER_TYPE = "struct<kind:string,price:double,tif:string,n:bigint>"


class CompileError(Exception):
    pass


def spark_type(kind: str, res: str) -> str:
    if kind == "Timestamp":
        return "date" if res == "1d" else "timestamp_ntz"
    return _SPARK_TYPES.get(kind) or "double"


class _Scope:
    """What a rule has bound: the running DataFrame, constants, and the names its caller binds on entry."""

    def __init__(self, unit: str, res: str, consts: dict, entry: set[str], key: str | None):
        self.unit, self.res, self.consts, self.entry, self.key = unit, res, consts, entry, key
        self.df: DataFrame | None = None

    def bound(self) -> set[str]:
        return set(self.df.columns) if self.df is not None else set()

    def child(self, df: DataFrame | None = None) -> _Scope:
        c = _Scope(self.unit, self.res, self.consts, self.entry, self.key)
        c.df = df
        return c


class Compiler:
    """Compiles the relations of a program over DataFrames of its primitives (columns named as the arguments)."""

    def __init__(self, spark: SparkSession, program: Program, facts: dict[str, DataFrame], params: dict | None = None, strict: bool = False, sums: str = "auto"):
        """sums: how sums over frames are made: exact (each frame anew), running (differences), auto (running over long frames)."""
        self.spark, self.program, self.facts, self.strict, self.sums = spark, program, facts, strict, sums
        self.overrides = params or {}
        self._relations: dict = {}
        self._domains: dict[str, DataFrame] = {}
        self._recursive = {v for g in program.components() for v in g if len(g) > 1 or v in program.relations[v].reads}
        self._stack: list[str] = []
        self._reads: Counter | None = None

    def _shared(self, name: str) -> bool:
        """Whether the relation being compiled is read in more than one place, with the same constants, below the goal."""
        return any(n > 1 for (read, _), n in self._reads.items() if read == name)

    def _count_reads(self, goal: str) -> None:
        self._reads = Counter((a.name, tuple(repr(x) for x in a.args if isinstance(x, (Lit, Name)))) for n in self.program.reachable(goal) for r in self.program.relations[n].rules for a, _ in atoms(r.body) if a.name != n)

    # values

    def constant(self, e, scope: _Scope):
        """The Python value of an expression without columns, or None."""
        if isinstance(e, Lit):
            return e.value
        if isinstance(e, Name):
            p = self.program.param(scope.unit, e.name)
            return literal_of(p, self.overrides.get(e.name)).value if p else None
        if isinstance(e, Var):
            return scope.consts.get(e.name)
        if isinstance(e, Call) and e.op in "+-*/neg":
            xs = [self.constant(a, scope) for a in e.args]
            if all(isinstance(x, (int, float)) for x in xs):
                return -xs[0] if e.op == "neg" else {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b}[e.op](*xs)
        return None

    def column(self, e, scope: _Scope) -> Column:
        c = self.constant(e, scope)
        if c is not None:
            return F.lit(c)
        if isinstance(e, Var):
            if e.name not in scope.bound():
                raise CompileError(f"variable `{e.name}` is not bound")
            return F.col(f"`{e.name}`")
        if isinstance(e, Call):
            if e.op in CONSTRUCTORS["delta"] + CONSTRUCTORS["target"]:
                return self.decision(e, scope)
            x = [self.column(a, scope) for a in e.args]
            s = self.strict
            match e.op:
                case "neg":
                    return -x[0]
                case "+":
                    return x[0] + x[1]
                case "-":
                    return x[0] - x[1]
                case "*":
                    return x[0] * x[1]
                case "/":
                    return partial.divide(x[0], x[1], s)
                case "log":
                    return partial.log(x[0], s)
                case "sqrt":
                    return partial.sqrt(x[0], s)
                case "exp":
                    return F.exp(x[0].cast("double"))
                case "abs":
                    return F.abs(x[0])
                case "least":
                    return partial.least(*x)
                case "greatest":
                    return partial.greatest(*x)
        raise CompileError(f"cannot compile {e}")

    def decision(self, e: Call, scope: _Scope) -> Column:
        order = e.args[2] if len(e.args) > 2 else Name("market")
        none = F.lit(None)
        if isinstance(order, Call):
            price = self.column(order.args[0], scope) if order.args else none
            tif = order.args[1] if len(order.args) > 1 else Name("day")
            n = self.column(tif.args[0], scope) if isinstance(tif, Call) else none
            parts = (F.lit(order.op), price, F.lit(tif.op if isinstance(tif, Call) else tif.name), n)
        else:
            parts = (F.lit(order.name), none, none, none)
        o = F.struct(*(p.alias(k) for p, k in zip(parts, ("kind", "price", "tif", "n"), strict=True))).cast(ORDER_TYPE)
        return F.struct(F.lit(e.op).alias("ctor"), self.column(e.args[0], scope).alias("equity"), self.column(e.args[1], scope).cast("double").alias("amount"), o.alias("order"))

    # time

    def domain(self, res: str) -> DataFrame:
        """The bars of a resolution: its own keys and the labels of finer ones, over all primitives with data."""
        if res not in self._domains:
            keys = []
            for name, rel in self.program.relations.items():
                s = rel.sig
                if rel.kind == "primitive" and name in self.facts and RESOLUTIONS[s.res] <= RESOLUTIONS[res]:
                    t = F.col(f"`{s.args[s.key].name}`")
                    keys.append(self.facts[name].select(t if s.res == res else temporal.bucket(t, res)))
            if not keys:
                raise CompileError(f"no relation has keys at @{res}")
            self._domains[res] = session.keep(temporal.domain(keys))
        return self._domains[res]

    # relations

    def relation(self, name: str, consts: tuple | None = None, strictly: bool = True) -> DataFrame:
        """A relation's tuples, columns named as its arguments; inputs given as constants are substituted and dropped.

        consts: one entry for each argument, None where it stays a column.
        """
        rel = self.program.relations.get(name)
        if rel is None:
            raise CompileError(f"unknown relation `{name}`")
        sig = rel.sig
        consts = consts or (None,) * len(sig.args)
        at = (name, consts)
        if at in self._relations:
            return self._relations[at]
        if self._reads is None:
            decides = "decide" in self.program.relations and self.program.relations["decide"].rules
            self._count_reads("decide" if decides else name)
        keep = [a.name for a, c in zip(sig.args, consts, strict=True) if c is None]
        if rel.kind == "feedback":
            raise CompileError(f"`{name}` is executor feedback: run the closed loop")
        if rel.kind == "primitive":
            if name not in self.facts:
                schema = ", ".join(f"`{a.name}` {spark_type(a.type, sig.res)}" for a in sig.args)
                df = self.spark.createDataFrame([], schema)
            else:
                df = self.facts[name].select(*(a.name for a in sig.args))
            for a, c in zip(sig.args, consts, strict=True):
                if c is not None:
                    df = df.where(F.col(f"`{a.name}`") == F.lit(c))
            out = df.select(*keep)
        elif name in self._recursive:
            out = self._fixpoint(name, consts).select(*keep)
        else:
            made = [self.rule(r, sig, consts, rel.unit.name) for r in rel.rules]
            if not made:
                raise CompileError(f"`{name}` has no rules")
            out = reduce(lambda a, b: a.unionByName(b), made).distinct()
        if rel.kind == "derived" and self._shared(name):
            out = session.keep(out)  # solved once; what does not fit into memory goes to the executors' disks
        self._relations[at] = out
        return out

    def _enter(self, r: Rule, sig: Signature, consts: tuple, unit: str) -> tuple[_Scope, list[tuple[str, Column]]]:
        known = {}
        entry = set()
        for arg, term, c in zip(sig.args, r.head.args, consts, strict=True):
            if isinstance(term, Var):
                if c is not None:
                    known[term.name] = c
                elif arg.mode in "+@":
                    entry.add(term.name)
        key = r.head.args[sig.key]
        return _Scope(unit, sig.res, known, entry, key.name if isinstance(key, Var) else None), []

    def rule(self, r: Rule, sig: Signature, consts: tuple, unit: str, body=None) -> DataFrame:
        scope, _ = self._enter(r, sig, consts, unit)
        self.solve(r.body if body is None else body, scope)
        return self.head(r, sig, consts, scope)

    def head(self, r: Rule, sig: Signature, consts: tuple, scope: _Scope) -> DataFrame:
        out = []
        for arg, term, c in zip(sig.args, r.head.args, consts, strict=True):
            if c is not None:
                if not isinstance(term, Var):
                    fixed = self.constant(term, scope)
                    if fixed is not None and fixed != c:
                        scope.df = scope.df.where(F.lit(False))
                continue
            if isinstance(term, Var) and term.name not in scope.bound() and term.name not in scope.consts:
                self.ensure(term.name, scope)
            col = self.column(term, scope)
            out.append((col if arg.type == "Decision" else col.cast(spark_type(arg.type, sig.res))).alias(arg.name))
        return scope.df.select(*out)

    def ensure(self, var: str, scope: _Scope) -> None:
        """Bind the rule's time to the bars of its domain where no literal has."""
        if var in scope.bound() or var in scope.consts:
            return
        if var != scope.key:
            raise CompileError(f"input `{var}` ranges over no relation: bind it in the rule or pass a constant")
        bars = self.domain(scope.res).select(F.col("T").alias(var))
        scope.df = bars if scope.df is None else scope.df.join(bars)

    # literals

    def solve(self, body, scope: _Scope, inside: bool = False) -> None:
        body = list(body)
        i = 0
        while i < len(body):
            lit = body[i]
            if isinstance(lit, Aggregate):
                same = [lit]
                while i + 1 < len(body) and isinstance(body[i + 1], Aggregate) and body[i + 1].body == lit.body and lit.func != "count" and body[i + 1].func != "count":
                    i += 1
                    same.append(body[i])
                self.aggregate(same, scope)
            else:
                self.step(lit, scope, inside)
            i += 1

    def step(self, lit, scope: _Scope, inside: bool) -> None:
        match lit:
            case Atom() if lit.name in TEMPORAL:
                self.temporal(lit, scope)
            case Atom():
                self.atom(lit, scope, inside)
            case Compare():
                self.compare(lit, scope)
            case Top() | Rank():
                self.ranked(lit, scope)
            case Resample():
                self.resample(lit, scope)
            case Frame():
                self.filter_window(lit, scope)
            case _:
                raise CompileError(f"cannot compile {lit}")

    def compare(self, lit: Compare, scope: _Scope) -> None:
        if lit.op == "=" and isinstance(lit.left, Var) and lit.left.name not in scope.bound() and lit.left.name not in scope.consts:
            if scope.df is None:
                self.ensure(scope.key, scope)
            if isinstance(lit.right, Var) and lit.right.name == scope.key:
                self.ensure(lit.right.name, scope)
            scope.df = scope.df.withColumn(lit.left.name, self.column(lit.right, scope)).where(F.col(f"`{lit.left.name}`").isNotNull())
            return
        for v in variables(lit):
            if v not in scope.bound() and v not in scope.consts:
                self.ensure(v, scope)
        a, b = self.column(lit.left, scope), self.column(lit.right, scope)
        scope.df = scope.df.where({"<": a < b, "<=": a <= b, "=": a == b, ">=": a >= b, ">": a > b}[lit.op])

    def _call(self, lit: Atom, scope: _Scope, key_free: bool = False) -> tuple[DataFrame, list[str]]:
        """The called relation with constants substituted: columns are the variables, repeated ones filtered."""
        rel = self.program.relations.get(lit.name)
        if rel is None:
            raise CompileError(f"unknown relation `{lit.name}`")
        sig = rel.sig
        if len(sig.args) != len(lit.args):
            raise CompileError(f"`{lit.name}` has {len(sig.args)} arguments")
        consts, filters, names = [], [], []
        for arg, term in zip(sig.args, lit.args, strict=True):
            c = None if isinstance(term, Wild) else self.constant(term, scope)
            if c is not None and arg.mode == "+" and rel.kind in ("derived", "output"):
                consts.append(c)
                continue
            consts.append(None)
            if c is not None:
                filters.append(F.col(f"`{arg.name}`") == F.lit(c))
            elif isinstance(term, Var):
                names.append((arg.name, term.name))
            elif isinstance(term, Call) and term.op in CONSTRUCTORS["delta"] + CONSTRUCTORS["target"]:
                d = F.col(f"`{arg.name}`")
                filters.append(d["ctor"] == term.op)
                for t, f in zip(term.args, ("equity", "amount")):
                    if isinstance(t, Var):
                        names.append((f"{arg.name}.{f}", t.name))
                    elif not isinstance(t, Wild):
                        filters.append(d[f] == self.column(t, scope))
            elif not isinstance(term, Wild):
                raise CompileError(f"argument {term} of `{lit.name}` must be a variable or a constant")
        df = self.relation(lit.name, tuple(consts))
        for f in filters:
            df = df.where(f)
        first: dict[str, Column] = {}
        for col, var in names:
            c = F.col(".".join(f"`{x}`" for x in col.split(".")))
            if var in first:
                df = df.where(c == first[var])
            else:
                first[var] = c
        return df.select(*(c.alias(v) for v, c in first.items())), list(first)

    def atom(self, lit: Atom, scope: _Scope, inside: bool) -> None:
        if lit.asof is not None:
            return self.asof(lit, scope)
        df, names = self._call(lit, scope)
        have = scope.bound()
        shared = [n for n in names if n in have]
        if lit.negated:
            for n in names:
                self.ensure(n, scope)
            scope.df = scope.df.join(df, names, "left_anti") if names else scope.df.join(df.limit(1), how="left_anti")
        elif scope.df is None:
            scope.df = df if inside else df.distinct() if len(names) < len(self.program.relations[lit.name].sig.args) else df
        elif len(shared) == len(names) and not inside and names:
            scope.df = scope.df.join(df, shared, "left_semi")
        else:
            scope.df = scope.df.join(df, shared) if shared else scope.df.join(df)

    def asof(self, lit: Atom, scope: _Scope) -> None:
        rel = self.program.relations[lit.name].sig
        if not isinstance(lit.asof, Var):
            raise CompileError("asof needs a variable")
        time = lit.asof.name
        self.ensure(time, scope)
        term = lit.args[rel.key]
        key = term.name if isinstance(term, Var) else "__key"
        args = list(lit.args)
        args[rel.key] = Var(key)
        right, names = self._call(Atom(lit.name, tuple(args)), scope)
        by = [n for n in names if n in scope.bound() and n != key]
        visible = None
        if rel.res == "1d" and scope.res != "1d":
            right = right.withColumn("__seen", F.col(f"`{key}`").cast("timestamp_ntz") + F.expr("INTERVAL '1' DAY - INTERVAL '1' SECOND"))
            visible = F.col("__seen")
        elif rel.res != "1d" and scope.res == "1d":
            right = right.withColumn("__seen", F.date_add(F.to_date(F.col(f"`{key}`") - F.expr("INTERVAL '1' MICROSECOND")), 1))
            visible = F.col("__seen")
        keys = latest_keys(scope.df, right, by, time, key, visible)
        right = right.drop("__seen").withColumnRenamed(key, "__k")
        found = scope.df.join(keys, [*by, time])
        if lit.negated:
            scope.df = scope.df.join(keys, [*by, time], "left_anti")
            return
        if key in scope.df.columns:
            found = found.where(F.col("__k") == F.col(f"`{key}`")).drop("__k").withColumn("__k", F.col(f"`{key}`")).drop(key)
        joined = found.join(right, [*by, "__k"])
        scope.df = joined.drop("__k") if key == "__key" else joined.withColumnRenamed("__k", key)

    def temporal(self, lit: Atom, scope: _Scope) -> None:
        t = lit.args[0]
        if not isinstance(t, Var):
            raise CompileError(f"`{lit.name}` needs a time variable")
        self.ensure(t.name, scope)
        bars = self.domain(scope.res)
        if lit.name in ("month_start", "day_start"):
            m = (temporal.month_starts if lit.name == "month_start" else temporal.day_starts)(bars).select(F.col("T").alias(t.name))
            scope.df = scope.df.join(m, [t.name], "left_anti" if lit.negated else "left_semi")
            return
        if lit.name == "prev":
            m = temporal.prev_map(bars)
        else:
            n = self.constant(lit.args[1], scope)
            if not isinstance(n, Duration):
                raise CompileError("lag needs a duration")
            m = temporal.lag_map(bars, n)
        out = lit.args[-1]
        if isinstance(out, Wild):
            scope.df = scope.df.join(m.select(F.col("T").alias(t.name)), [t.name], "left_semi")
        elif out.name in scope.bound():
            scope.df = scope.df.join(m.select(F.col("T").alias(t.name), F.col("T0").alias(out.name)), [t.name, out.name], "left_semi")
        else:
            scope.df = scope.df.join(m.select(F.col("T").alias(t.name), F.col("T0").alias(out.name)), [t.name])

    def ranked(self, lit: Top | Rank, scope: _Scope) -> None:
        df, names = self._call(lit.atom, scope)
        outer = [n for n in names if n in scope.bound() or n in scope.entry]
        fresh = [n for n in names if n not in outer]
        order = [F.col(f"`{v}`").desc() if down else F.col(f"`{v}`").asc() for v, down in lit.by]
        full = [*order, *(F.col(f"`{n}`").asc() for n in fresh if n not in {v for v, _ in lit.by})]
        part = [F.col(f"`{n}`") for n in outer] or [F.lit(1)]
        w = Window.partitionBy(*part)
        if isinstance(lit, Top):
            n = self.constant(lit.n, scope)
            if n is None:
                raise CompileError("top needs a constant count")
            df = df.distinct().withColumn("__r", F.row_number().over(w.orderBy(*full))).where(F.col("__r") <= int(n)).drop("__r")
        else:
            df = df.distinct()
            if lit.average:
                keys = [F.col(f"`{v}`") for v, _ in lit.by]
                ties = F.count("*").over(Window.partitionBy(*part, *keys))
                value = F.rank().over(w.orderBy(*order)) + (ties - 1) / F.lit(2.0)
            else:
                value = F.row_number().over(w.orderBy(*full)).cast("double")
            df = df.withColumn(lit.var, value.cast("double"))
        shared = [n for n in df.columns if n in scope.bound()]
        scope.df = df if scope.df is None else scope.df.join(df, shared) if shared else scope.df.join(df)

    def resample(self, lit: Resample, scope: _Scope) -> None:
        df, names = self._call(lit.atom, scope)
        sig = self.program.relations[lit.atom.name].sig
        key = lit.atom.args[sig.key].name
        entities = [t.name for a, t in zip(sig.args, lit.atom.args, strict=True) if isinstance(t, Var) and (a.type == "Equity" or t.name in scope.bound() or t.name in scope.entry) and t.name != key]
        inner = scope.child(df.withColumn("__bar", temporal.bucket(F.col(f"`{key}`"), lit.to)))
        aggs = []
        for var, func, e in lit.outputs:
            x = self.column(e, inner) if func != "count" else None
            made = {"first": lambda: F.min_by(x, F.col(f"`{key}`")), "last": lambda: F.max_by(x, F.col(f"`{key}`")), "max": lambda: F.max(x), "min": lambda: F.min(x), "sum": lambda: F.sum(x.cast("double")), "mean": lambda: F.avg(x.cast("double")), "count": lambda: F.count("*")}[func]()
            aggs.append((made if func == "count" else made.cast("double")).alias(var))
        least = int(self.constant(lit.least, scope))
        out = inner.df.groupBy(*(F.col(f"`{e}`") for e in dict.fromkeys(entities)), F.col("__bar").alias(lit.time)).agg(F.count("*").alias("__n"), *aggs).where(F.col("__n") >= least).drop("__n")
        shared = [n for n in out.columns if n in scope.bound()]
        scope.df = out if scope.df is None else scope.df.join(out, shared) if shared else scope.df.join(out)

    # aggregates

    def _values(self, lits: list[Aggregate], scope: _Scope) -> tuple[list[Column], dict[str, str], list[str | None]]:
        """Columns of the aggregates' inputs, their SQL by output, and the guard of those that need two rows."""
        cols, sql, guards = [], {}, []
        for k, lit in enumerate(lits):
            level, args = None, list(lit.args)
            if lit.func == "quantile":
                level = self.constant(args.pop(), scope)
                if level is None or not 0 <= level <= 1:
                    raise CompileError("the level of a quantile must be a constant from 0 to 1")
            if lit.func == "count":
                sql[lit.var] = "count(__one)"
                guards.append(None)
                continue
            names = []
            for j, a in enumerate(args):
                names.append(f"__v{k}_{j}")
                cols.append(self.column(a, scope).cast("double").alias(names[-1]))
            sql[lit.var] = aggregate_sql(lit.func, names, level)
            guards.append(f"count({names[0]})" if needs_two(lit.func) else None)
        return cols, sql, guards

    def aggregate(self, lits: list[Aggregate], scope: _Scope) -> None:
        body = lits[0].body
        frames = [b for b in body if isinstance(b, Frame)]
        rest = [b for b in body if not isinstance(b, Frame)]
        inner_vars = {v for b in rest for v in variables(b)} | {v for lit in lits for a in lit.args for v in variables(a)}
        outer = scope.bound() | scope.entry
        group = sorted(v for v in inner_vars if v in outer and v not in scope.consts)
        times = {v for f in frames for v in variables(f.time)}
        simple = len(frames) == 1 and times == {scope.key} and scope.key not in inner_vars and group and self._plain(rest) and self._args_inside(lits, rest)
        if not frames:
            self._grouped(lits, rest, group, scope)
        elif simple:
            self._framed(lits, frames[0], rest, group, scope)
        else:
            self._joined(lits, body, sorted(set(group) | times), scope)

    @staticmethod
    def _plain(rest) -> bool:
        return all(not isinstance(b, Atom) or (b.asof is None and not b.negated) for b in rest)

    @staticmethod
    def _args_inside(lits, rest) -> bool:
        inside = {v for b in rest for v in variables(b)}
        return all(v in inside for lit in lits for a in lit.args for v in variables(a))

    def _attach(self, out: DataFrame, group: list[str], lits: list[Aggregate], scope: _Scope, least: int) -> None:
        counted = [lit.var for lit in lits if lit.func == "count"]
        shared = [g for g in group if g in scope.bound()]
        if counted and least < 1:
            for g in group:
                self.ensure(g, scope)
            if scope.df is None:
                self.ensure(scope.key, scope)
            scope.df = scope.df.join(out, group, "left") if group else scope.df.join(out, how="left")
            scope.df = scope.df.withColumns({v: F.coalesce(F.col(f"`{v}`"), F.lit(0).cast("bigint")) for v in counted})
        elif scope.df is None:
            scope.df = out
        else:
            scope.df = scope.df.join(out, shared) if shared else scope.df.join(out)

    def _finish(self, sub: DataFrame, lits: list[Aggregate], group: list[str], scope: _Scope, inner: _Scope, least: int) -> None:
        cols, sql, guards = self._values(lits, inner)
        keep = [F.col(f"`{g}`") for g in group]
        rows = sub.select(*keep, F.lit(1).alias("__one"), *cols)
        aggs = [F.expr(s if g is None else f"CASE WHEN {g} >= 2 THEN {s} END").alias(v) for (v, s), g in zip(sql.items(), guards, strict=True)]
        out = rows.groupBy(*keep).agg(F.count("__one").alias("__n"), *aggs).where(F.col("__n") >= max(1, least)).drop("__n")
        for lit in lits:
            if lit.func != "count":
                out = out.where(F.col(f"`{lit.var}`").isNotNull() & ~F.isnan(f"`{lit.var}`"))
        self._attach(out, group, lits, scope, least)

    def _grouped(self, lits, rest, group, scope) -> None:
        """No window: aggregate the conjunction by the outer variables it reads."""
        bound = [g for g in group if g in scope.bound()]
        reads = {v for lit in lits for a in lit.args for v in variables(a)} | {v for b in rest if isinstance(b, Compare) for v in variables(b)}
        inside = {v for b in rest if not isinstance(b, Compare) for v in variables(b)}
        inner = scope.child(scope.df.select(*bound).distinct() if bound and (reads - inside) & set(bound) else None)
        self.solve(rest, inner, inside=True)
        for g in group:
            self.ensure(g, inner)
        self._finish(inner.df, lits, group, scope, inner, 0)

    def _framed(self, lits, frame: Frame, rest, group, scope) -> None:
        """One window over rows that do not read the base time: a frame over base and value rows, one shuffle by the group."""
        inner = _Scope(scope.unit, scope.res, scope.consts, set(group) | {frame.var}, frame.var)
        self.solve(rest, inner, inside=True)
        length, least = self.constant(frame.length, scope), int(self.constant(frame.least, scope))
        cols, sql, guards = self._values(lits, inner)
        values = inner.df.select(*group, F.col(f"`{frame.var}`").alias(scope.key), *cols)
        missing = [g for g in group if g not in scope.bound()]
        if scope.df is None:
            scope.df = values.select(*group).distinct()
        elif missing:
            scope.df = scope.df.join(values.select(*group).distinct(), [g for g in group if g in scope.bound()] or None)
        self.ensure(scope.key, scope)
        bars = None
        if frame.kind == "rows" and len(rest) > 1:
            anchor = next(b for b in rest if isinstance(b, Atom))
            a = _Scope(scope.unit, scope.res, scope.consts, set(group) | {frame.var}, frame.var)
            self.solve([anchor], a, inside=True)
            at = [g for g in group if g in a.bound()]
            marks = a.df.select(*at, F.col(f"`{frame.var}`").alias(scope.key))
            if at != group:  # the anchor says nothing of some group columns: every group has its bars
                marks = marks.join(values.select(*group).distinct(), at or None)
            bars = marks.select(*group, scope.key).union(values.select(*group, scope.key))
        extra = {f"__g{i}": g for i, g in enumerate(guards) if g is not None}
        plain = sql | extra
        out = frame_aggregate(scope.df, values, group, scope.key, frame.kind, length, plain, least, "DAY" if scope.res == "1d" else "SECOND", bars, self._by_running_sums(frame.kind, length, scope.res))
        for i, v in enumerate(sql):
            lit = lits[i]
            if lit.func == "count":
                out = out.where(F.col("__n") >= least)
                continue
            if guards[i] is not None:
                out = out.withColumn(v, F.when(F.col(f"__g{i}") >= 2, F.col(f"`{v}`")))
            out = out.where(F.col(f"`{v}`").isNotNull() & ~F.isnan(f"`{v}`"))
        scope.df = out.drop("__n", *extra)

    def _by_running_sums(self, kind: str, length, res: str) -> bool:
        if self.sums != "auto":
            return self.sums == "running"
        bars = length if kind == "rows" else length.approx * RESOLUTIONS["1d"] / RESOLUTIONS[res]
        return bars > LONG_FRAME

    def _joined(self, lits, body, group, scope) -> None:
        """The general case: the conjunction is solved from each distinct base binding, windows being range conditions."""
        for g in group:
            if g not in scope.bound() and g == scope.key:
                self.ensure(g, scope)
        base = [g for g in group if g in scope.bound()]
        inner = scope.child(scope.df.select(*base).distinct())
        frames = [b for b in body if isinstance(b, Frame)]
        least = max(int(self.constant(f.least, scope)) for f in frames)
        late, pending = [], list(frames)
        for b in body:
            if isinstance(b, Frame):
                continue
            late.append(b)
            have = {v for x in late for v in variables(x)}
            for f in list(pending):
                if f.var in have:
                    late.append(f)
                    pending.remove(f)
        self._group = base
        self.solve(late + pending, inner, inside=True)
        self._finish(inner.df, lits, base, scope, inner, least)

    def filter_window(self, f: Frame, scope: _Scope) -> None:
        """A window as a condition on rows that are already joined with their base binding."""
        t, t1, length = self.column(f.time, scope), F.col(f"`{f.var}`"), self.constant(f.length, scope)
        if f.kind == "rows":
            w = Window.partitionBy(*(F.col(f"`{g}`") for g in self._group)).orderBy(F.col(f"`{f.var}`").desc())
            scope.df = scope.df.where(t1 <= t).withColumn("__bar", F.dense_rank().over(w)).where(F.col("__bar") <= int(length)).drop("__bar")
        else:
            scope.df = scope.df.where((t1 >= temporal.minus(t, length)) & ((t1 <= t) if f.kind == "window" else (t1 < t)))

    # recursion

    def _fixpoint(self, name: str, consts: tuple) -> DataFrame:
        rel = self.program.relations[name]
        sig = rel.sig
        own = lambda b: isinstance(b, Atom) and b.name == name and not b.negated
        if name in self._stack or any(name in self.program.relations[w].reads and w != name and w in self._recursive for w in rel.reads if w in self.program.relations):
            raise CompileError(f"`{name}` is recursive through another relation")
        self._stack.append(name)
        try:
            init = [r for r in rel.rules if not any(own(b) for b in r.body)]
            steps = [r for r in rel.rules if any(own(b) for b in r.body)]
            keep = [(i, a) for i, (a, c) in enumerate(zip(sig.args, consts, strict=True)) if c is None]
            key = sig.args[sig.key].name
            # entities: inputs or identity columns handed on unchanged by every recursive call
            ent = [a.name for i, a in keep if i != sig.key and (a.mode == "+" or a.type == "Equity") and all(isinstance(r.head.args[i], Var) and next(b for b in r.body if own(b)).args[i] == r.head.args[i] for r in steps)]
            outs = [a for i, a in keep if i != sig.key and a.name not in ent]
            parts, plans = [], []
            for r in init:
                df = self.rule(r, sig, consts, rel.unit.name)
                parts.append(df.withColumn("__rule", F.lit(-1)).withColumnsRenamed({a.name: f"__o_{a.name}" for a in outs}))
            for k, r in enumerate(steps):
                scope, _ = self._enter(r, sig, consts, rel.unit.name)
                call = next(b for b in r.body if own(b))
                free = {v for v in variables(Atom("", tuple(a for i, a in enumerate(call.args) if i != sig.key)))} - {r.head.args[sig.key].name}
                given = {r.head.args[i].name for i, a in keep if a.name in ent}
                unknown = free - given
                before, after = [], []
                for b in r.body:
                    if own(b):
                        continue
                    needs = set(variables(b)) & unknown
                    if needs or (isinstance(b, Compare) and isinstance(b.left, Var) and set(variables(b.right)) & unknown):
                        if not isinstance(b, Compare):
                            raise CompileError(f"`{name}`: only comparisons may read what the recursion returns")
                        after.append(b)
                        unknown |= set(variables(b.left)) if b.op == "=" and isinstance(b.left, Var) else set()
                    else:
                        before.append(b)
                self.solve(before, scope)
                at = call.asof if call.asof is not None else call.args[sig.key]
                for v in (r.head.args[sig.key].name, at.name):
                    self.ensure(v, scope)
                names = scope.df.columns
                df = scope.df.select(*(F.col(f"`{n}`").alias(f"__s{k}_{n}") for n in names), *(F.col(f"`{r.head.args[i].name}`").cast(spark_type(a.type, sig.res)).alias(a.name) for i, a in keep if a.name in ent), F.col(f"`{r.head.args[sig.key].name}`").alias(key), F.col(f"`{at.name}`").alias("__at"), F.lit(call.asof is not None).alias("__asof"), F.lit(k).alias("__rule"))
                parts.append(df)
                plans.append((r, call, after, names, scope))
            fast = self._carried(sig, ent, outs, key, init, parts, plans, len(init))
            if fast is not None:
                return fast
            return self._scanned(sig, keep, ent, outs, key, parts, plans)
        finally:
            self._stack.pop()

    def _carried(self, sig, ent, outs, key, init, parts, plans, n_init) -> DataFrame | None:
        """One step rule that hands on, multiplies, adds to or compares the carried value: a window aggregate instead of a scan."""
        if len(plans) != 1 or len(outs) != 1 or not ent:
            return None
        r, call, after, names, scope = plans[0]
        i = next(j for j, a in enumerate(sig.args) if a.name == outs[0].name)
        got, put = call.args[i], r.head.args[i]
        if not isinstance(got, Var) or not isinstance(put, Var) or spark_type(outs[0].type, sig.res) != "double":
            return None
        if not after and got == put and got.name not in names:
            how, value = "copy", F.lit(None).cast("double")
        else:
            if len(after) != 1 or after[0].op != "=" or after[0].left != put or not isinstance(after[0].right, Call):
                return None
            how = {"*": "product", "+": "sum", "greatest": "max", "least": "min"}.get(after[0].right.op)
            args = after[0].right.args
            if how is None or len(args) != 2 or (args[0] == got) == (args[1] == got):
                return None
            other = args[1] if args[0] == got else args[0]
            if got.name in variables(other) or any(v not in names and v not in scope.consts for v in variables(other)):
                return None
            value = self.column(other, scope.child(scope.df)).cast("double")
        step = scope.df.select(*(F.col(f"`{r.head.args[j].name}`").alias(a.name) for j, a in enumerate(sig.args) if a.name in ent), F.col(f"`{r.head.args[sig.key].name}`").alias(key), F.col(f"`{(call.asof or call.args[sig.key]).name}`").alias("__at"), value.alias("__value"), F.lit(False).alias("__start"))
        starts = [p.select(*ent, key, F.lit(None).cast(step.schema["__at"].dataType).alias("__at"), F.col(f"__o_{outs[0].name}").cast("double").alias("__value"), F.lit(True).alias("__start")) for p in parts[:n_init]]
        begun = reduce(lambda a, b: a.unionByName(b), starts) if starts else None
        if len(starts) > 1:  # two rules may derive one tuple
            begun = begun.distinct()
        rows = step if begun is None else begun.unionByName(step)
        out = carry(rows, ent, key, how, "__value", "__start", "__at", call.asof is not None)
        return out.withColumnRenamed("out", outs[0].name)

    def _scanned(self, sig, keep, ent, outs, key, parts, plans) -> DataFrame:
        from ruletide.loop.interpreter import evaluate

        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        for c, kind in (("__at", spark_type("Timestamp", sig.res)), ("__asof", "boolean")):
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast(kind))
        by = ent or ["__all"]
        rows = rows if ent else rows.withColumn("__all", F.lit(1))
        rows = rows.withColumnRenamed(key, "T") if key != "T" else rows
        frozen = []
        for r, call, after, names, scope in plans:
            params = {n: self.constant(Name(n), scope) for n in _names(after, r.head)}
            free = [(j, call.args[i]) for j, a in enumerate(outs) for i, b in enumerate(sig.args) if b.name == a.name]
            heads = [next(r.head.args[i] for i, b in enumerate(sig.args) if b.name == a.name) for a in outs]
            frozen.append((after, names, dict(scope.consts) | params, free, heads))
        out_names = [a.name for a in outs]
        counts = [a.type == "Count" for a in outs]

        def step(rule: int, row: dict, have):
            if rule < 0:
                yield tuple(row[f"__o_{n}"] for n in out_names)
                return
            after, names, consts, free, heads = frozen[rule]
            env = dict(consts) | {n: row[f"__s{rule}_{n}"] for n in names}
            for j, term in free:
                if isinstance(term, Wild):
                    continue
                if isinstance(term, Var):
                    if term.name in env and env[term.name] != have[j]:
                        return
                    env[term.name] = have[j]
                elif evaluate(term, env) != have[j]:
                    return
            for c in after:
                if c.op == "=" and isinstance(c.left, Var) and c.left.name not in env:
                    v = evaluate(c.right, env)
                    if v is None:
                        return
                    env[c.left.name] = v
                else:
                    a, b = evaluate(c.left, env), evaluate(c.right, env)
                    if a is None or b is None or not {"<": a < b, "<=": a <= b, "=": a == b, ">=": a >= b, ">": a > b}[c.op]:
                        return
            got = [evaluate(h, env) for h in heads]
            if all(g is not None and not (isinstance(g, float) and math.isnan(g)) for g in got):
                yield tuple(int(g) if is_count else float(g) if isinstance(g, (int, float)) else g for g, is_count in zip(got, counts, strict=True))

        types = {a.name: spark_type(a.type, sig.res) for a in sig.args}
        schema = ", ".join([*(f"{e} {types[e]}" for e in ent), f"T {spark_type('Timestamp', sig.res)}", *(f"{n} {types[n]}" for n in out_names)])
        out = scan(rows, by, step, schema)
        return out.withColumnRenamed("T", key) if key != "T" else out


def _names(after, head) -> set[str]:
    found: set[str] = set()

    def walk(x):
        if isinstance(x, Name):
            found.add(x.name)
        elif isinstance(x, Call):
            for a in x.args:
                walk(a)
        elif isinstance(x, Compare):
            walk(x.left)
            walk(x.right)

    for a in (*after, *head.args):
        walk(a)
    return found
