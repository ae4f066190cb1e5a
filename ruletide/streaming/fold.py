"""The fold: a strategy over an event stream ordered by availability.

An event is one tuple with the instant from which it may be used. A bar closes when availability passes its end, never
because a later key was seen; then the strategy decides and the executor acts. A tuple that arrives after its bar closed is
stored at its own key and forgets what was derived from that key on; decisions already emitted stand. The state of a run
(stores, what was derived, executor, position in time) is a snapshot that resumes to the same result; no event is replayed.

How far back a program looks is bounded by its durations where it neither recurs nor reads as of a time nor counts rows; then
what is older is let go, so the state does not grow with the stream.

`Fold` is the plain state machine; `stream` runs one for each run id under Structured Streaming.
"""

from __future__ import annotations

import json
import pickle
import time
from bisect import bisect_left, insort
from copy import deepcopy

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ruletide.dsl.ast import RESOLUTIONS, TEMPORAL, Atom, Duration, Lit, Name, Window, finer
from ruletide.engine import value
from ruletide.loop.config import ExecConfig
from ruletide.loop.executor import RiskHalt, SimExecutor
from ruletide.loop.kernel import Kernel
from ruletide.loop.market import DAY, Market
from ruletide.loop.run import choose
from ruletide.loop.split import account_apart, entities, halts_never, rules_apart
from ruletide.operators.temporal import bucket_range
from ruletide.plans.program import Program, link
from ruletide.study.study import fingerprint

LOG = "run_id string, rel string, t long, avail long, payload string"
END, BAR = "$end", "$bar"
PRUNE_EVERY = 32  # bars


def label(t: int, res: str) -> int:
    return t // DAY * DAY if res == "1d" else -(-t // RESOLUTIONS[res]) * RESOLUTIONS[res]


def close_of(bar: int, res: str) -> int:
    return bar + DAY - 1 if res == "1d" else bar


def lookback(program: Program, overrides: dict | None = None) -> tuple[int, int] | None:
    """(seconds, bars) that the decisions look back at most; None where nothing bounds it."""
    rels = [program.relations[n] for n in program.reachable("decide")]
    groups = {n: g for g in program.components() for n in g}
    if any(len(groups[r.name]) > 1 or r.name in r.reads for r in rels):
        return None
    longest, steps = 0.0, {}
    for r in rels:
        text = [x for rule in r.rules for x in _nodes(rule)]
        if any((isinstance(x, Window) and x.kind == "rows") or (isinstance(x, Atom) and x.asof is not None) for x in text):
            return None
        names = [program.param(r.unit.name, x.name) for x in text if isinstance(x, Name)]
        found = [x.value for x in text if isinstance(x, Lit)] + [value((overrides or {}).get(p.name, p.default.value)) for p in names if p is not None]
        longest = max([longest, *(x.approx for x in found if isinstance(x, Duration))])
        steps[r.name] = sum(isinstance(x, Window) or (isinstance(x, Atom) and x.name in TEMPORAL) for x in text)
    deep: dict[str, int] = {}

    def depth(n: str) -> int:
        if n not in deep:
            deep[n] = steps.get(n, 0) + max([depth(w) for w in program.relations[n].reads if w in program.relations] or [0])
        return deep[n]

    most = depth("decide")
    return int(most * (longest * 1.05 + 4) * DAY), most + 2


def _nodes(x):
    """Every node of a syntax tree."""
    yield x
    if isinstance(x, tuple):
        for y in x:
            yield from _nodes(y)
    elif hasattr(x, "__dataclass_fields__"):
        for f in x.__dataclass_fields__:
            y = getattr(x, f)
            if isinstance(y, tuple) or hasattr(y, "__dataclass_fields__"):
                yield from _nodes(y)


def event_log(program: Program, facts: dict[str, DataFrame], run_id: str = "run") -> DataFrame:
    """(run_id, rel, t, avail, payload): every tuple with when it can be used."""
    parts = []
    for name, df in facts.items():
        sig = program.relations[name].sig
        cols = [(F.unix_seconds(F.col(a.name).cast("timestamp")) if a.type == "Timestamp" else F.col(a.name)).alias(f"c{i}") for i, a in enumerate(sig.args)]
        key = F.col(sig.args[sig.key].name)
        end = F.unix_seconds((bucket_range(key, "1d")[1] - F.expr("INTERVAL '1' SECOND") if sig.res == "1d" else key).cast("timestamp"))
        avail = F.greatest(end, F.unix_seconds(F.col("available_at").cast("timestamp"))) if "available_at" in df.columns else end
        parts.append(df.select(F.lit(run_id).alias("run_id"), F.lit(name).alias("rel"), F.unix_seconds(key.cast("timestamp")).alias("t"), avail.alias("avail"), F.to_json(F.struct(*cols)).alias("payload")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


class Fold:
    """One run over its events; feed() takes them in order of availability, finish() ends the data."""

    def __init__(self, program: Program, config: ExecConfig | None = None, params: dict | None = None, names: dict | None = None, prune: bool = False):
        self.program, self.config = program, config or ExecConfig()
        self.res = program.goal.res
        self.names = choose(program, names)
        self.kernel = Kernel(program, {r: [] for r in RESOLUTIONS}, {k: value(v) for k, v in (params or {}).items()})
        self.kernel.closed = {n for n, r in program.relations.items() if r.kind != "primitive"}
        self.market = Market(RESOLUTIONS[self.res], RESOLUTIONS[program.relations[self.names["price"]].sig.res])
        self.kernel.exec = self.executor = SimExecutor(self.config, self.market)
        self.fields = {rel: f for f, rel in self.names.items()}
        self.now: int | None = None  # availability seen so far
        self.bars_done: list[int] = []
        self.events = 0
        self.halted = False
        self.late = 0
        self.reach = lookback(program, params) if prune else None

    def feed(self, rel: str, t: int, avail: int, payload: str) -> None:
        """Advance to an availability, closing what it passes, then store the tuple."""
        if rel == END:
            self.finish()
            return
        self.advance(avail)
        self.store(rel, t, payload)
        self.events += 1

    def advance(self, avail: int) -> None:
        if self.now is not None and avail > self.now:
            before, after = label(self.now, self.res), label(avail, self.res)
            if after > before:
                self.barrier(before)
        self.now = avail if self.now is None else max(self.now, avail)

    def store(self, rel: str, t: int, payload: str) -> None:
        if rel == BAR:  # a bar of the run, whatever this part of it holds there
            bars = self.kernel.domains[self.res]
            if t not in bars[-3:] and t not in bars:
                insort(bars, t)
            return
        sig = self.program.relations[rel].sig
        row = json.loads(payload)
        tup = tuple(row.get(f"c{i}") for i in range(len(sig.args)))
        if self.bars_done and label(t, self.res) <= self.bars_done[-1]:
            self.late += 1
            self.forget(t)
        self.kernel.store(rel).add(tup)
        for r, bars in self.kernel.domains.items():
            if r == sig.res or finer(sig.res, r):
                bar = t if r == sig.res else label(t, r)
                if not bars or bars[-1] < bar:
                    bars.append(bar)
                elif bar not in set(bars[-3:]) and bar not in bars:
                    insort(bars, bar)
        ent = next((i for i, a in enumerate(sig.args) if a.type == "Equity"), None)
        if rel in self.fields and ent is not None:
            self.market.add(self.fields[rel], tup[ent], t, float(tup[max(i for i, a in enumerate(sig.args) if a.mode == "-")]))
        elif rel == "split":
            self.market.splits[t].append((tup[ent], float(tup[-1])))
        elif rel == "delisted":
            self.market.delisted[t].append((tup[ent], str(tup[-1])))
        elif rel == "dividend":
            self.market.dividends[tup[2]].append((tup[ent], tup[3] if len(tup) > 4 else tup[2], float(tup[-1])))

    def forget(self, t: int) -> None:
        """A late tuple: whatever was derived at its key or later is derived again when asked for."""
        keep = {}
        for (name, bound), found in self.kernel.memo.items():
            at = bound[self.program.relations[name].sig.key]
            if at is not None and at < t:
                keep[name, bound] = found
        self.kernel.memo = keep

    def barrier(self, bar: int) -> None:
        c = self.config
        if self.halted or bar not in self.kernel.domains[self.res] or (self.bars_done and bar <= self.bars_done[-1]):
            return
        if (c.start is not None and bar < c.start) or (c.end is not None and bar > c.end):
            return
        try:
            self.kernel.bar(bar, not self.bars_done)
        except RiskHalt as halt:
            self.executor.events.append(("halt", bar, {"message": str(halt)}))
            self.halted = True
        self.bars_done.append(bar)
        if self.reach is not None and len(self.bars_done) % PRUNE_EVERY == 0:
            self.prune(bar)

    def prune(self, bar: int) -> None:
        """Let go of what no later decision can read."""
        seconds, steps = self.reach
        days = self.kernel.domains[self.res]
        if len(days) <= 2 * steps:
            return
        cut = days[max(0, bisect_left(days, days[-1 - steps] - seconds) - steps)]
        own = days[max(0, len(days) - 5 - max(self.config.adv_window, self.config.vol_window + 1))]
        if RESOLUTIONS[self.res] < DAY:  # intraday volumes are averaged over days
            own = bar - (2 * max(self.config.adv_window, self.config.vol_window) + 10) * DAY
        for store in self.kernel.stores.values():
            for t in [t for t in store.by if t < cut]:
                del store.by[t]
            for at in [at for at in store.by_entity if at[0] < cut]:
                del store.by_entity[at]
            store._bars = None
        keys = {n: r.sig.key for n, r in self.program.relations.items()}
        self.kernel.memo = {(n, b): v for (n, b), v in self.kernel.memo.items() if b[keys[n]] is None or b[keys[n]] >= cut}
        for r, bars in self.kernel.domains.items():
            self.kernel.domains[r] = bars[bisect_left(bars, min(cut, own)) :]
        for field in self.market.series.values():
            for series in field.values():
                series.at = {t: v for t, v in series.at.items() if t >= min(cut, own)}
                series._times = None
        x = self.executor
        for at in (x.position_at, x.cash_at, x.nav_at, x.fill_at, self.kernel.decided):
            for t in [t for t in at if t < cut]:
                del at[t]
        x.bars = x.bars[bisect_left(x.bars, min(cut, own)) :]

    def finish(self) -> None:
        if self.now is not None:
            self.barrier(label(self.now, self.res))
        if not self.halted:
            self.executor.finish()

    def drain(self) -> list[tuple]:
        """Events since the last call."""
        out, self.executor.events = self.executor.events, []
        return out

    # snapshots

    def snapshot(self) -> dict:
        """Everything that resuming needs, with the program's fingerprint."""
        k, m = self.kernel, self.market
        facts = pickle.dumps(([(at, dict(s.by)) for at, s in k.stores.items()], k.domains, k.memo, k.decided, {f: {sym: x.at for sym, x in by.items()} for f, by in m.series.items()}, dict(m.splits), dict(m.dividends), dict(m.delisted)))
        return deepcopy({"program": fingerprint(self.program), "facts": facts, "events": self.events, "now": self.now, "bars": self.bars_done, "executor": self.executor.state(), "halted": self.halted, "late": self.late})

    @classmethod
    def restore(cls, program: Program, snap: dict, config: ExecConfig | None = None, params: dict | None = None, names: dict | None = None, prune: bool = False) -> Fold:
        if snap["program"] != fingerprint(program):
            raise ValueError("the snapshot is of another program")
        f = cls(program, config, params, names, prune)
        stores, f.kernel.domains, f.kernel.memo, f.kernel.decided, series, splits, dividends, delisted = pickle.loads(snap["facts"])
        for (name, consts), by in stores:
            store = f.kernel.store(name, consts)
            for tuples in by.values():
                for tup in tuples:
                    store.add(tup)
        for field, by in series.items():
            for sym, at in by.items():
                f.market.series[field][sym].at = at
        for have, kept in ((f.market.splits, splits), (f.market.dividends, dividends), (f.market.delisted, delisted)):
            have.update(kept)
        f.events, f.now, f.bars_done, f.halted, f.late = snap["events"], snap["now"], list(snap["bars"]), snap["halted"], snap["late"]
        f.executor.restore(snap["executor"])
        return f


def fold(program: Program | str, log: list[tuple], config: ExecConfig | None = None, params: dict | None = None, snapshot_every: int | None = None, prune: bool = False) -> tuple[Fold, list[dict]]:
    """Run a whole log of (rel, t, avail, payload); with snapshots after every so many bars."""
    program = link(program) if isinstance(program, str) else program
    f, snaps = Fold(program, config, params, prune=prune), []
    for rel, t, avail, payload in sorted(log, key=lambda e: (e[2], e[0])):
        n = len(f.bars_done)
        f.advance(avail)
        if snapshot_every and len(f.bars_done) != n and len(f.bars_done) % snapshot_every == 0:
            snaps.append(f.snapshot())
        f.store(rel, t, payload)
        f.events += 1
    f.finish()
    return f, snaps


def parts_apart(program: Program, config: ExecConfig) -> bool:
    """Whether a log can be dealt by instrument: neither rules nor account tie two, and all rules see the bars of decisions only."""
    rels = [program.relations[n] for n in program.reachable("decide")]
    facts = [r for r in program.relations.values() if r.kind == "primitive"]
    return account_apart(config) and halts_never(program, {}) and rules_apart(program, everything=True) and all(r.kind == "primitive" or r.sig.res == program.goal.res for r in rels) and all(len(entities(r)) == 1 for r in facts)


def deal(log: DataFrame, program: Program, parts: int) -> DataFrame:
    """The log with every run cut by instrument into runs `run/part`. All parts get the run's bars and the end of its data, so
    that each closes the same bars as the run would and no later."""
    res, every = program.goal.res, F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    at = F.coalesce(*(F.when(F.col("rel") == n, F.get_json_object("payload", f"$.c{entities(r)[0]}")) for n, r in program.relations.items() if r.kind == "primitive"))
    length = RESOLUTIONS[res]
    bar = (F.floor(F.col("t") / DAY) * DAY if res == "1d" else F.ceil(F.col("t") / length) * length).cast("long")
    own = log.where(F.col("rel") != END)
    bars = own.groupBy("run_id", bar.alias("t")).agg(F.min("avail").alias("avail")).select("run_id", F.lit(BAR).alias("rel"), "t", "avail", F.lit("{}").alias("payload"))
    to_all = log.where(F.col("rel") == END).union(bars).select("*", every.alias("__p"))
    both = own.withColumn("__p", F.pmod(F.hash(at), F.lit(parts))).union(to_all)
    return both.withColumn("run_id", F.concat_ws("/", "run_id", F.col("__p").cast("string"))).drop("__p")


def stream(events: DataFrame, text: str, config: ExecConfig | None = None, params: dict | None = None, goal: str | None = None, idle: int | None = None, prune: bool = True) -> DataFrame:
    """A streaming DataFrame of run events from a streaming event log (LOG); an event named $end closes the data.

    State is one snapshot for each run id, kept by Spark's state store and checkpoint; within a micro-batch events are taken
    in order of availability. idle: after so many seconds without an event of a run, its clock is the wall clock, so a bar whose
    end has passed closes without waiting for the next event (for live logs; a replay has no use for it).
    """
    program = link(text, goal)
    config = config or ExecConfig()

    def take(key, batches, state):
        f = Fold.restore(program, pickle.loads(state.get[0]), config, params, prune=prune) if state.exists else Fold(program, config, params, prune=prune)
        if state.hasTimedOut:
            f.advance(int(time.time()))
        else:
            rows = pd.concat(list(batches), ignore_index=True)
            rows["last"] = rows["rel"] == END
            for r in rows.sort_values(["last", "avail", "rel", "t", "payload"], kind="stable").itertuples():
                f.feed(r.rel, int(r.t), int(r.avail), r.payload)
        out = f.drain()
        state.update((pickle.dumps(f.snapshot()),))
        if idle is not None:
            state.setTimeoutDuration(1000 * idle)
        yield pd.DataFrame([(key[0], kind, pd.Timestamp(t, unit="s"), json.dumps(fields)) for kind, t, fields in out], columns=["run_id", "kind", "t", "payload"])

    grouped = events.groupBy("run_id")
    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    return grouped.applyInPandasWithState(take, "run_id string, kind string, t timestamp_ntz, payload string", "snapshot binary", "append", timeout)


# resampling streams


def resample_stream(ticks: DataFrame, time: str, by: list[str], length: str, delay: str, aggregates: list) -> DataFrame:
    """Tumbling bars labelled by their closing instant, (label - length, label], emitted once availability passes them.

    Spark's windows hold their start and not their end; a microsecond's shift puts an instant on the label into its own bar.
    """
    late = ticks.withColumn("__t", F.col(time).cast("timestamp") - F.expr("INTERVAL '0.000001' SECOND")).withWatermark("__t", delay)
    bars = late.groupBy(*by, F.window("__t", length).alias("__w")).agg(F.count("*").alias("n"), *aggregates)
    return bars.withColumn("bar", F.col("__w.end")).drop("__w")
