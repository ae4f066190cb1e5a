"""Runs of a strategy: Spark computes what needs no feedback, one sequential operator for each run does the rest.

Runs (parameter points, folds, strategies) are groups of one `applyInPandas`, so a study's points run side by side. A run's
input is the market and the relations that its closed-loop rules read, not the raw data. A run whose instruments have nothing
to do with one another is several groups, over parts of the instruments; see `PartedResult`.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, replace
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruletide.dsl.ast import RESOLUTIONS, Duration, Name
from ruletide.engine import value
from ruletide.loop.config import ExecConfig
from ruletide.loop.executor import RiskHalt, SimExecutor
from ruletide.loop.kernel import Kernel, needs
from ruletide.loop.market import Market
from ruletide.loop.split import account_apart, candidates, entities, feedback_read, halts_never, rules_apart
from ruletide.plans.compiler import Compiler, CompileError, spark_type
from ruletide.plans.program import Program, link
from ruletide.session import keep

_TEXT = ("Equity", "Label")
EVENTS = "run_id string, seq long, kind string, t timestamp_ntz, payload string"
SCHEMAS = {
    "decision": "equity string, ctor string, amount double, order string, rule string",
    "fill": "equity string, quantity double, price double, commission double, fee double, slippage double, impact double, participation double, at_last_price boolean, partial boolean, forced boolean",
    "dropped": "equity string, ctor string, amount double, reason string",
    "action": "equity string, action string, detail string, cash double",
    "nav": "equity_value double, cash double, gross double, net double, leverage double",
    "final": "summary string",
    "halt": "message string",
    "ledger": "relation string, values array<string>",
}
#: Companion relations of an order type: prices it needs besides the close.
_OHLC = {"moo": ("open",), "moo_moc": ("open",), "limit": ("open", "high", "low"), "stop": ("open", "high", "low")}
_FIELDS = {"price": ("close", "close_m", "tick", "close_d"), "volume": ("volume", "volume_m", "tick_volume", "volume_d"), "open": ("open", "open_m", "open_d"), "high": ("high", "high_m", "high_d"), "low": ("low", "low_m", "low_d")}


@dataclass
class Point:
    """One run: its id, parameters and executor settings."""

    run_id: str
    params: dict = field(default_factory=dict)
    config: ExecConfig = field(default_factory=ExecConfig)


def _seconds(col: F.Column) -> F.Column:
    return F.unix_seconds(col.cast("timestamp"))


def companions(program: Program) -> set[str]:
    """Price fields that the strategy's order types need."""
    out: set[str] = set()
    text = repr([r.head for r in program.relations["decide"].rules])
    for kind, fields in _OHLC.items():
        if f"'{kind}'" in text:
            out |= set(fields)
    return out


def choose(program: Program, config_names: dict | None = None) -> dict[str, str]:
    """The relation of each price field: the one named, else the first of the environment at the strategy's resolution or finer."""
    names = dict(config_names or {})
    have = {n: r for n, r in program.relations.items() if r.kind == "primitive"}
    for f, known in _FIELDS.items():
        if f not in names:
            found = [n for n in known if n in have and RESOLUTIONS[have[n].sig.res] <= RESOLUTIONS[program.goal.res]]
            if found:
                names[f] = found[0]
    missing = [f for f in ("price", *companions(program)) if f not in names]
    if missing:
        raise CompileError(f"the strategy's orders need a relation for {', '.join(sorted(missing))}")
    return names


#: Prices of a part of a run, about; parts of one are not made.
ROWS_A_PART = 100_000
#: Parts of a run and tasks of its groups, at most.
PARTS, TASKS = 1 << 14, 2_000


@dataclass
class _Piece:
    """One relation of a run's input: its rows' name, times, labels and numbers, and the column of its instrument, if any."""

    df: DataFrame
    rel: str
    t: F.Column
    texts: list[F.Column]
    numbers: list[F.Column]
    who: str | None


def _seconds_of(a, x: F.Column) -> F.Column:
    return _seconds(x) if a.type == "Timestamp" else x


def _rows(df: DataFrame, rel: str, consts: tuple, r) -> _Piece:
    """One tuple a row, times in epoch seconds, constants left out."""
    cells = [(a, F.col(f"`{a.name}`")) for a, c in zip(r.sig.args, consts, strict=True) if c is None]
    who = [r.sig.args[i].name for i in entities(r)]
    return _Piece(df, rel, _seconds(F.col(f"`{r.sig.args[r.sig.key].name}`")), [x for a, x in cells if a.type in _TEXT], [_seconds_of(a, x) for a, x in cells if a.type not in _TEXT], who[0] if len(who) == 1 else None)


def _wide(pieces: list[_Piece], codes: dict[str, int], strings: int, numbers: int, parts: int) -> DataFrame:
    """(part, rel, t, s0.., d0..): one tuple a row, no wider than needed; a tuple of no instrument goes to every part."""
    pad = lambda have, n, kind, name: [x.cast(kind).alias(f"{name}{i}") for i, x in enumerate(have + [F.lit(None)] * (n - len(have)))]
    made = []
    for p in pieces:
        part = F.lit(0) if parts == 1 else F.pmod(F.hash(F.col(f"`{p.who}`")), F.lit(parts)) if p.who else F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
        made.append(p.df.select(part.alias("part"), F.lit(codes[p.rel]).alias("rel"), p.t.alias("t"), *pad(p.texts, strings, "string", "s"), *pad(p.numbers, numbers, "double", "d")))
    return reduce(lambda a, b: a.union(b), made)


def _tuples(rows: pd.DataFrame, sig, consts: tuple):
    """The tuples of one relation's rows."""
    s = d = 0
    cols = []
    for a, c in zip(sig.args, consts, strict=True):
        if c is not None:
            cols.append([c] * len(rows))
        elif a.type in _TEXT:
            cols.append(rows[f"s{s}"].tolist())
            s += 1
        else:
            x = rows[f"d{d}"]
            cols.append(x.astype("int64").tolist() if a.type in ("Timestamp", "Count") else x.tolist())
            d += 1
    return zip(*cols, strict=True)


def _const_key(consts: tuple) -> str:
    return json.dumps([[c.months, c.days] if isinstance(c, Duration) else c for c in consts])


def run_input(spark: SparkSession, program: Program, facts: dict[str, DataFrame], point: Point, names: dict[str, str], fewer: tuple[str, ...] = (), rules: bool = False) -> tuple[list[_Piece], Compiler]:
    """Everything that runs read which share the point's inputs; computed once for all of them.

    fewer: relations that name every instrument a decision can be about; of others no market is read, nor, with `rules`, any tuple.
    """
    comp = Compiler(spark, program, facts, {k: value(v) for k, v in point.params.items()})
    wanted = needs(program, comp.overrides)
    named = [(keep(comp.relation(n, c)), program.relations[n].sig.args[entities(program.relations[n])[0]].name) for n, c in wanted if n in fewer]
    who = keep(reduce(lambda a, b: a.union(b), [df.select(F.col(f"`{x}`").alias("__who")) for df, x in named]).distinct()) if named and {n for n, _ in wanted} >= set(fewer) else None

    def of(df: DataFrame, x: str | None) -> DataFrame:
        return df if who is None or x is None else df.join(who, df[f"`{x}`"] == who["__who"], "left_semi")

    pieces = []
    for name, consts in wanted:
        p = _rows(comp.relation(name, consts), f"r:{name}:{_const_key(consts)}", consts, program.relations[name])
        pieces.append(p if not rules or name in fewer else replace(p, df=of(p.df, p.who)))
    for f, rel in names.items():
        sig = program.relations[rel].sig
        ent = next(a.name for a in sig.args if a.type == "Equity")
        out = [a.name for a in sig.args if a.mode == "-"][-1]
        pieces.append(_Piece(of(comp.relation(rel), ent), f"m:{f}", _seconds(F.col(sig.args[sig.key].name)), [F.col(ent)], [F.col(out)], ent))
    for action in ("split", "dividend", "delisted"):
        if action in facts and action in program.relations and program.relations[action].kind == "primitive":
            p = _rows(comp.relation(action), f"a:{action}", (None,) * len(program.relations[action].sig.args), program.relations[action])
            pieces.append(replace(p, df=of(p.df, p.who)))
    for res in {program.goal.res, *(program.relations[n].sig.res for n in program.reachable("decide") if program.relations[n].sig.res)}:
        pieces.append(_Piece(comp.domain(res), f"d:{res}", _seconds(F.col("T")), [], [], None))
    return pieces, comp


def shared(program: Program, points: list[Point]) -> list[list[Point]]:
    """The points in groups that read the same input: those that differ in what only the feedback loop reads are one group."""
    groups: dict[tuple, list[Point]] = {}
    for p in points:
        overrides = {k: value(v) for k, v in p.params.items()}
        wanted = needs(program, overrides)
        open_loop = {r for n, _ in wanted for r in program.reachable(n)}
        read = {x.name for n in open_loop for rule in program.relations[n].rules for x in _names(rule)}
        groups.setdefault((tuple((n, _const_key(c)) for n, c in wanted), tuple(sorted((k, str(v)) for k, v in overrides.items() if k in read))), []).append(p)
    return list(groups.values())


def _names(x):
    if isinstance(x, Name):
        yield x
    elif isinstance(x, tuple):
        for y in x:
            yield from _names(y)
    elif hasattr(x, "__dataclass_fields__"):
        for f in x.__dataclass_fields__:
            yield from _names(getattr(x, f))


def load(rows: pd.DataFrame, rels: list[str], program: Program, point: Point, names: dict[str, str], contracts: dict | None) -> tuple[Kernel, Market]:
    """The kernel and the market of a run from its input rows."""
    kernel = Kernel(program, {}, {k: value(v) for k, v in point.params.items()})
    finest = program.relations[names["price"]].sig.res
    market = Market(RESOLUTIONS[program.goal.res], RESOLUTIONS[finest], contracts)
    domains: dict[str, list[int]] = {}
    for code, part in rows.groupby("rel", sort=False):
        rel = rels[code]
        kind, name = rel[:1], rel[2:]
        if kind == "d":
            domains[name] = sorted(part["t"].unique().tolist())
        elif kind == "m":
            for sym, own in part.groupby("s0", sort=False):
                series = market.series[name][sym]
                series.at.update(zip(own["t"].tolist(), own["d0"].tolist(), strict=True))
                series._times = None
        elif kind == "r":
            name, _, raw = name.partition(":")
            consts = tuple(Duration(*x) if isinstance(x, list) else x for x in json.loads(raw))
            store = kernel.store(name, consts)
            for tup in _tuples(part, program.relations[name].sig, consts):
                store.add(tup)
        else:
            sig = program.relations[name].sig
            for tup in _tuples(part, sig, (None,) * len(sig.args)):
                if name == "split":
                    market.splits[tup[sig.key]].append((tup[0], float(tup[-1])))
                elif name == "delisted":
                    market.delisted[tup[sig.key]].append((tup[0], str(tup[-1])))
                else:  # dividend(A, T, Ex, [Pay,] amount)
                    market.dividends[tup[2]].append((tup[0], tup[3] if len(tup) > 4 else tup[2], float(tup[-1])))
    kernel.domains = domains
    return kernel, market


def events(executor: SimExecutor, run_id: str) -> list[tuple]:
    out = []
    for i, (kind, t, fields) in enumerate([*executor.events, ("final", executor.bars[-1] if executor.bars else 0, {"summary": json.dumps(executor.summary())})]):
        out.append((run_id, i, kind, pd.Timestamp(t, unit="s"), json.dumps(fields)))
    return out


class RunResult:
    """Typed tables of the tagged events of one or more runs."""

    def __init__(self, tagged: DataFrame):
        self.tagged = tagged

    def table(self, kind: str) -> DataFrame:
        return _typed(self.tagged.where(F.col("kind") == kind), kind)

    def ledger(self, program: Program, name: str) -> DataFrame:
        """The tuples of a relation at every bar of a run, with its columns and types."""
        sig = program.relations[name].sig
        rest = [a for k, a in enumerate(sig.args) if k != sig.key]
        rows = self.table("ledger").where(F.col("relation") == name)
        key = F.to_date("t") if sig.res == "1d" else F.col("t")
        cols = {a.name: F.get("values", F.lit(i)).cast(spark_type(a.type, sig.res)) for i, a in enumerate(rest)} | {sig.args[sig.key].name: key}
        return rows.select("run_id", *(cols[a.name].alias(a.name) for a in sig.args))

    def write(self, path: str, config: dict | None = None) -> None:
        """One Parquet folder for each table, and the settings as JSON."""
        for kind in ("decision", "fill", "dropped", "action", "nav", "final"):
            self.table(kind).write.mode("overwrite").parquet(f"{path}/{kind}")
        if config is not None:
            self.tagged.sparkSession.createDataFrame([(json.dumps(config, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config.json")


class PartedResult(RunResult):
    """The events of runs that were made in parts of their instruments: those of an instrument are its part's, the account's summed.

    `seq` orders a run's events by bar, and within one by what happens there and by part; it has gaps.
    """

    def __init__(self, parts: DataFrame, points: list[Point]):
        self.parts, self.points = parts, points

    @property
    def tagged(self) -> DataFrame:
        self.parts = keep(self.parts)  # read three times
        return reduce(lambda a, b: a.union(b), [self._own("kind NOT IN ('nav', 'final')"), self._nav(), self._final()])

    def table(self, kind: str) -> DataFrame:
        made = self._nav() if kind == "nav" else self._final() if kind == "final" else self._own(f"kind = '{kind}'")
        return _typed(made, kind)

    def _own(self, where: str) -> DataFrame:
        return self.parts.where(where).select("run_id", "seq", "kind", "t", "payload")

    def _setting(self, of) -> F.Column:
        return F.element_at(F.create_map(*[x for p in self.points for x in (F.lit(p.run_id), F.lit(float(of(p.config))))]), F.col("run_id"))

    def _bars(self) -> DataFrame:
        """The account at every bar, and one row of each run with its parts' summaries."""
        x = self.parts.where("kind IN ('nav', 'final')").withColumn("p", F.from_json("payload", SCHEMAS["nav"]))
        start = self._setting(lambda c: c.initial_cash)
        sums = x.groupBy("run_id", "kind", "t", F.expr("IF(kind = 'nav', seq >> 34, 0)").alias("at")).agg(
            F.sum("p.cash").alias("c"), F.sum("p.gross").alias("gross"), F.sum("p.net").alias("net"), F.count("*").alias("n"), F.collect_list(F.when(F.col("kind") == "final", F.col("payload"))).alias("finals"), F.max("seq").alias("last")
        )
        cash = F.col("c") - (F.col("n") - 1) * start
        return sums.select("*", cash.alias("cash"), (cash + F.col("net")).alias("worth"))

    def _nav(self) -> DataFrame:
        worth, gross = F.col("worth"), F.col("gross")
        fields = F.struct(worth.alias("equity_value"), "cash", "gross", "net", F.when(worth > 0, gross / worth).otherwise(0.0).alias("leverage"))
        return self._bars().where("kind = 'nav'").select("run_id", F.shiftleft("at", 34).alias("seq"), "kind", "t", F.to_json(fields).alias("payload"))

    def _final(self) -> DataFrame:
        worth, gross = F.col("worth"), F.col("gross")
        called = (gross > 0) & (worth > 0) & (worth < self._setting(lambda c: c.maintenance_margin) * gross - 1e-9 * gross)
        runs = self._bars().groupBy("run_id").agg(F.count(F.when((F.col("kind") == "nav") & called, 1)).alias("calls"), F.flatten(F.collect_list("finals")).alias("finals"), F.max("last").alias("seq"), F.max(F.when(F.col("kind") == "final", F.col("t"))).alias("t"))
        starts = {p.run_id: (p.config.initial_cash, p.config.participation_warn) for p in self.points}

        @F.pandas_udf("string")
        def whole(run_id: pd.Series, calls: pd.Series, finals: pd.Series) -> pd.Series:
            return pd.Series([json.dumps({"summary": json.dumps(_sum_up([json.loads(f) for f in fs], int(c), starts[r][0]))}) for r, c, fs in zip(run_id, calls, finals, strict=True)])

        return runs.select("run_id", "seq", F.lit("final").alias("kind"), "t", whole("run_id", "calls", "finals").alias("payload"))


def _sum_up(finals: list[dict], calls: int, start: float) -> dict:
    """One summary of a run from those of its parts."""
    parts = [json.loads(f["summary"]) for f in finals]
    made = {k: math.fsum(p[k] for p in parts) for k in parts[0] if k not in ("final_positions", "fill_ratio", "avg_participation", "max_participation", "fills_above_warning")}
    wanted, n = math.fsum(f["requested"] for f in finals), sum(f["participations"] for f in finals)
    return {
        **made,
        "margin_calls": float(calls),
        "final_cash": math.fsum([start, *(p["final_cash"] - start for p in parts)]),
        "final_positions": dict(sorted((k, v) for p in parts for k, v in p["final_positions"].items())),
        "fill_ratio": math.fsum(f["filled"] for f in finals) / wanted if wanted else 1.0,
        "avg_participation": math.fsum(p["avg_participation"] * f["participations"] for p, f in zip(parts, finals, strict=True)) / n if n else 0.0,
        "max_participation": max(p["max_participation"] for p in parts),
        "fills_above_warning": sum(p["fills_above_warning"] for p in parts),
    }


def _typed(events: DataFrame, kind: str) -> DataFrame:
    return events.select("run_id", "seq", "t", F.from_json("payload", SCHEMAS[kind]).alias("p")).select("run_id", "seq", "t", "p.*")


def part_events(executor: SimExecutor, run_id: str, part: int) -> list[tuple]:
    """The events of one part of a run, numbered so that those of all parts are ordered by bar."""
    out, bar, n, before = [], 0, 0, -1
    rank = {"decision": 0, "ledger": 1, "nav": 3, "final": 3}
    summary = {"summary": json.dumps(executor.summary()), "filled": executor.filled, "requested": executor.requested, "participations": len(executor.participations)}
    for kind, t, fields in [*executor.events, ("final", executor.bars[-1] if executor.bars else 0, summary)]:
        at = bar * 4 + rank.get(kind, 2)
        n = n + 1 if at == before else 0
        before, bar = at, bar + (kind == "nav")
        out.append((run_id, (at << 34) + (part << 20) + n, kind, pd.Timestamp(t, unit="s"), json.dumps(fields)))
    return out


def run(spark: SparkSession, text: str | Program, facts: dict[str, DataFrame], points: list[Point] | None = None, goal: str | None = None, names: dict | None = None, contracts: dict | None = None, ledger: tuple[str, ...] = ()) -> RunResult:
    """Run a strategy at one or more points; a risk halt ends its run with a `halt` event.

    ledger: relations that read the executor's feedback and that the decisions read, whose tuples at every bar are kept.
    """
    program = link(text, goal) if isinstance(text, str) else text
    odd = [n for n in ledger if n not in program.closed_loop() or n not in program.reachable("decide") or any(a.mode == "+" and a.type != "Equity" for a in program.relations[n].sig.args)]
    if odd:
        raise CompileError(f"no ledger of {', '.join(odd)}: it needs no run, takes inputs, or no decision reads it")
    points = points or [Point("run")]
    chosen = choose(program, names)
    loose = rules_apart(program)
    whole = not (loose and all(account_apart(p.config) for p in points))
    fewer = tuple(candidates(program) or ()) if whole else ()
    groups = [(group, *run_input(spark, program, facts, group[0], chosen, fewer, loose and not ledger)) for group in shared(program, points)]
    pieces = [p for _, own, _ in groups for p in own]
    rels = list(dict.fromkeys(p.rel for p in pieces))
    codes = {r: i for i, r in enumerate(rels)}
    wide = max(len(p.texts) for p in pieces), max(len(p.numbers) for p in pieces)
    # parts of about as many prices whatever the market's size, so that a task's memory does not grow with it
    parts = 1 if whole else min(PARTS, max(1, math.ceil(groups[0][2].relation(chosen["price"]).count() / ROWS_A_PART)))
    at = {p.run_id: i for i, p in enumerate(points)}
    reads = feedback_read(program)

    def result(parts: int) -> DataFrame:
        data = reduce(lambda a, b: a.union(b), [_wide(own, codes, *wide, parts).select(F.explode(F.array(*[F.lit(at[p.run_id]) for p in group])).alias("run"), "*") for group, own, _ in groups])

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            point, part = points[int(pdf["run"].iloc[0])], int(pdf["part"].iloc[0])
            kernel, market = load(pdf, rels, program, point, chosen, contracts)
            executor = SimExecutor(point.config, market, reads)
            kernel.exec = executor
            lo, hi = point.config.start, point.config.end
            bars = [t for t in kernel.domains.get(program.goal.res, []) if (lo is None or t >= lo) and (hi is None or t <= hi)]
            try:
                kernel.run(executor, bars, ledger)
            except RiskHalt as halt:
                executor.events.append(("halt", executor.bars[-1] if executor.bars else 0, {"message": str(halt)}))
            made = events(executor, point.run_id) if parts == 1 else part_events(executor, point.run_id, part)
            return pd.DataFrame(made, columns=["run_id", "seq", "kind", "t", "payload"])

        tasks = min(TASKS, 2 * parts * len(points))
        return (data if parts == 1 else data.repartition(tasks, "run", "part")).groupBy("run", "part").applyInPandas(one, EVENTS)

    if parts == 1:
        return RunResult(result(1))
    made = result(parts)
    if not all(halts_never(program, {k: value(v) for k, v in p.params.items()}) for p in points):
        # a halt stops the other parts too: then the run is one sequence after all
        made = keep(made)
        if not made.where("kind = 'halt'").isEmpty():
            return RunResult(result(1))
    return PartedResult(made, points)


def write_ledger(spark: SparkSession, program: Program, facts: dict[str, DataFrame], names: list[str], path: str, result: RunResult, params: dict | None = None) -> None:
    """One Parquet folder for each relation: its tuples at every bar. Those that need no run are computed from the facts."""
    comp = Compiler(spark, program, facts, {k: value(v) for k, v in (params or {}).items()})
    for name in names:
        made = result.ledger(program, name) if name in program.closed_loop() else comp.relation(name)
        made.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
