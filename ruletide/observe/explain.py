"""Looking into a program: its graph, how much each relation holds, why a rule has no solution, and whether it peeks ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruletide.dsl.ast import Aggregate, Atom, Rank, Resample, Top, Window
from ruletide.engine import Engine
from ruletide.plans.compiler import CompileError
from ruletide.plans.program import Program


def graph(p: Program) -> list[dict]:
    """One record for each relation: kind, stratum, depth, what it reads, and whether it depends on the executor."""
    level, closed = p.strata(), p.closed_loop()
    depth: dict[str, int] = {}

    def deep(v: str, seen: frozenset) -> int:
        if v in depth:
            return depth[v]
        below = [deep(w, seen | {v}) for w in p.relations[v].reads if w in p.relations and w not in seen and w != v]
        depth[v] = 1 + max(below, default=-1)
        return depth[v]

    return [{"relation": n, "kind": r.kind, "unit": r.unit.name, "resolution": r.sig.res, "stratum": level[n], "depth": deep(n, frozenset()), "closed_loop": n in closed, "reads": sorted(r.reads), "rules": len(r.rules)} for n, r in p.relations.items()]


def show(p: Program) -> str:
    lines = []
    for g in sorted(graph(p), key=lambda g: (g["stratum"], g["relation"])):
        if g["kind"] != "feedback" or any(g["relation"] in r.reads for r in p.relations.values()):
            mark = " (closed loop)" if g["closed_loop"] else ""
            lines.append(f"{g['stratum']:>2} {g['relation']} [{g['kind']}{' @' + g['resolution'] if g['resolution'] else ''}]{mark}" + (f" <- {', '.join(g['reads'])}" if g["reads"] else ""))
    return "\n".join(lines)


def coverage(engine: Engine, names: list[str] | None = None) -> list[dict]:
    """Tuples and bars of each open-loop relation without open inputs, in dependency order; the root cause of an empty one."""
    p, closed = engine.program, engine.program.closed_loop()
    out, empty = [], set()
    for group in p.components():
        for name in group:
            rel = p.relations[name]
            if name in closed or rel.kind == "feedback" or (names and name not in names):
                continue
            try:
                df = engine.compiler.relation(name)
                key = rel.sig.args[rel.sig.key].name
                n, bars = df.agg(F.count("*"), F.count_distinct(key)).first()
            except CompileError:
                continue  # needs constants
            cause = next((w for w in sorted(rel.reads) if w in empty), None)
            if not n:
                empty.add(name)
            out.append({"relation": name, "tuples": n, "bars": bars, "cause": cause if not n else None})
    return out


def describe(lit) -> str:
    match lit:
        case Atom():
            return f"{'not ' if lit.negated else ''}{lit.name}{' asof' if lit.asof is not None else ''}"
        case Aggregate():
            return f"{lit.var} = {lit.func}"
        case Top() | Rank() | Resample():
            return f"{type(lit).__name__.lower()} {lit.atom.name}"
        case Window():
            return f"{lit.var} in {lit.kind}"
    return f"comparison {lit.op}"


def explain(engine: Engine, relation: str, at, **inputs) -> list[dict]:
    """For each rule of a relation, the solutions left at a bar after each literal, and one of the last bindings."""
    comp = engine.compiler
    rel = engine.program.relations[relation]
    out = []
    for k, r in enumerate(rel.rules):
        steps, last = [], None
        for n in range(1, len(r.body) + 1):
            consts = tuple(inputs.get(a.name) for a in rel.sig.args)
            scope, _ = comp._enter(r, rel.sig, consts, rel.unit.name)
            try:
                comp.solve(r.body[:n], scope)
                comp.ensure(scope.key, scope)
            except CompileError as e:
                steps.append({"literal": describe(r.body[n - 1]), "solutions": None, "note": str(e)})
                break
            here = scope.df.where(F.col(scope.key) == F.lit(at))
            count = here.count()
            steps.append({"literal": describe(r.body[n - 1]), "solutions": count})
            if not count:
                break
            last = here.limit(1).collect()[0].asDict()
        failed = next((s["literal"] for s in steps if s["solutions"] == 0), None)
        out.append({"rule": f"{relation}#{k + 1}", "steps": steps, "fails_at": failed, "binding": last})
    return out


def query(engine: Engine, relation: str, at=None, **inputs) -> DataFrame:
    """A relation's tuples, at one bar if given; inputs fixed by name, an Equity as a filter."""
    rel = engine.program.relations[relation].sig
    fixed = {a.name: inputs[a.name] for a in rel.args if a.name in inputs and a.mode == "+" and a.type not in ("Equity", "Label")}
    df = engine.relation(relation, **fixed)
    for a in rel.args:
        if a.name in inputs and a.name not in fixed:
            df = df.where(F.col(a.name) == F.lit(inputs[a.name]))
    return df if at is None else df.where(F.col(rel.args[rel.key].name) == F.lit(at))


def peeks(spark: SparkSession, text: str, facts: dict[str, DataFrame], relation: str, at, cut, goal: str | None = None, **inputs) -> DataFrame:
    """Tuples at a bar that change when the data ends there (cut: facts -> facts up to the bar); none if causal."""
    whole = query(Engine(spark, text, facts, goal), relation, at, **inputs)
    short = query(Engine(spark, text, cut(facts), goal), relation, at, **inputs)
    return whole.exceptAll(short).union(short.exceptAll(whole))

