"""The command line: check, show, query, explain, run, study, reveal, declare, dispute, lineages, bundle, bundle-test, synth.

Exit codes: 0 success, 1 findings or a halted run, 2 wrong use.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from ruletide.dsl.checker import check
from ruletide.loop.config import ExecConfig, frictionless, reg_t
from ruletide.plans.library import LIBRARIES, library
from ruletide.plans.program import link


def _text(paths: list[str]) -> str:
    files = [f for p in paths for f in (sorted(Path(p).rglob("*.rules")) if Path(p).is_dir() else [Path(p)])]
    return "\n".join(f.read_text() for f in files)


def _pairs(items: list[str]) -> dict:
    return dict(x.split("=", 1) for x in items or [])


def _config(a) -> ExecConfig:
    base = {"default": ExecConfig, "frictionless": frictionless, "reg_t": reg_t}[a.preset]
    kinds = {f.name: f.type for f in ExecConfig.__dataclass_fields__.values()}
    known = {}
    for k, v in _pairs(a.set).items():
        if k not in kinds:
            raise SystemExit(f"unknown setting {k}")
        known[k] = v == "true" if "bool" in kinds[k] else int(v) if "int" in kinds[k] else float(v) if "float" in kinds[k] else v
    return base(**known)


def _facts(spark, program, a):
    from ruletide.sources import bundle, environment
    from ruletide.sources.ingest import Synthetic

    if a.synthetic:
        kind, n, days = a.synthetic.split(":")
        return getattr(Synthetic(int(n), int(days), seed=a.seed), kind)(spark)
    if a.bundle:
        return bundle.read(spark, program.env, a.bundle, untested=a.untested)[0]
    if a.data:
        return environment.read(spark, program.env, a.data)[0]
    raise SystemExit("give --data, --bundle or --synthetic")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="ruletide", description=__doc__.splitlines()[0])
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, data: bool = False, run: bool = False):
        c = sub.add_parser(name)
        c.add_argument("files", nargs="+", help="rule files or folders of them")
        c.add_argument("--goal")
        c.add_argument("--library", action="append", default=[], help="name:environment of a shipped library")
        if data:
            c.add_argument("--data")
            c.add_argument("--bundle")
            c.add_argument("--untested", action="store_true")
            c.add_argument("--synthetic", help="daily|catalog|minute:symbols:days")
            c.add_argument("--seed", type=int, default=7)
            c.add_argument("--cores", default="*")
        if run:
            c.add_argument("--param", action="append", default=[])
            c.add_argument("--set", action="append", default=[])
            c.add_argument("--preset", choices=["default", "frictionless", "reg_t"], default="default")
            c.add_argument("--out")
        return c

    command("check")
    command("show")
    for name in ("query", "explain"):
        c = command(name, True)
        c.add_argument("relation")
        c.add_argument("--at")
        c.add_argument("--input", action="append", default=[])
    c = command("run", True, True)
    c.add_argument("--nav", help="folder for the curve")
    c.add_argument("--returns", help="folder for the period returns")
    c.add_argument("--by-day", action="store_true", help="returns by civil day")
    c.add_argument("--ledger", action="append", default=[], help="relation whose tuples at every bar are written below --out")
    for name in ("study", "reveal"):
        c = command(name, True, True)
        c.add_argument("--axis", action="append", default=[], help="name=a,b,c or name=lo..hi/step")
        c.add_argument("--target", default="sharpe")
        c.add_argument("--holdout", default="none")
        c.add_argument("--walk-forward")
        c.add_argument("--log")
        c.add_argument("--report", action="store_true", help="print the bias report instead of the figures")
        if name == "reveal":
            c.add_argument("--point", type=int, required=True, help="number of the grid point whose holdout is opened")
    c = command("declare")
    c.add_argument("--store", required=True)
    c.add_argument("--note", default="")
    c = sub.add_parser("dispute")
    c.add_argument("program")
    c.add_argument("--store", required=True)
    c.add_argument("--reason", required=True)
    c = sub.add_parser("lineages")
    c.add_argument("--store", required=True)
    c = command("bundle", True)
    c.add_argument("out")
    c.add_argument("--as-of", required=True)
    c.add_argument("--securities", required=True, help="Parquet table of id, ticker, from, to")
    c.add_argument("--source")
    c.add_argument("--delay", type=int)
    c = sub.add_parser("synth")
    c.add_argument("kind", choices=["daily", "catalog", "minute"])
    c.add_argument("out")
    c.add_argument("--symbols", type=int, default=10)
    c.add_argument("--days", type=int, default=250)
    c.add_argument("--seed", type=int, default=7)
    c = sub.add_parser("bundle-test")
    c.add_argument("files", nargs="+")
    c.add_argument("--bundle", required=True)
    a = p.parse_args(argv)

    if a.command == "synth":
        from ruletide.session import local_session
        from ruletide.sources import environment
        from ruletide.sources.ingest import Synthetic

        environment.write(getattr(Synthetic(a.symbols, a.days, seed=a.seed), a.kind)(local_session()), a.out)
        return 0
    if a.command in ("dispute", "lineages"):
        from ruletide.study.lineage import Lineages

        store = Lineages(a.store)
        if a.command == "dispute":
            store.dispute(a.program, a.reason)
        print(json.dumps({k: {**vars(x), "trials": x.trials, "variance": x.variance} for k, x in store.all().items()}, indent=1))
        return 0
    text = _text(a.files)
    for spec in getattr(a, "library", []):
        name, _, env = spec.partition(":")
        if name not in LIBRARIES:
            raise SystemExit(f"unknown library {name}")
        text += library(name, env)
    goal = getattr(a, "goal", None)
    if a.command == "check":
        found = check(text, goal)
        print("\n".join(map(str, found)) or "clean")
        return int(any(not f.warning for f in found))
    program = link(text, goal)
    if a.command == "show":
        from ruletide.observe.explain import show

        print(show(program))
        return 0
    if a.command == "declare":
        from ruletide.study.lineage import Lineages

        print(json.dumps(dict(zip(("lineage", "similarity"), Lineages(a.store).declare(program, a.note), strict=True))))
        return 0
    from ruletide.session import local_session

    spark = local_session(getattr(a, "cores", "*"))
    if a.command == "bundle-test":
        from ruletide.sources import bundle

        found = bundle.test(spark, program.env, a.bundle)
        print(json.dumps(found))
        return int(any(found.values()))
    facts = _facts(spark, program, a)
    if a.command == "bundle":
        from ruletide.sources import bundle

        made = bundle.write(spark, program.env, facts, spark.read.parquet(a.securities), a.out, a.as_of)
        if a.source or a.delay is not None:
            made = bundle.annotate(spark, a.out, source=a.source, processing_delay=a.delay)
        print(json.dumps(vars(made)))
        return 0
    if a.command in ("query", "explain"):
        from ruletide.engine import Engine, value
        from ruletide.observe.explain import explain, query

        engine = Engine(spark, text, facts, goal)
        inputs = {k: int(v) if v.isdigit() else value(v) for k, v in _pairs(a.input).items()}
        if a.command == "query":
            query(engine, a.relation, a.at, **inputs).show(1000, False)
        else:
            print(json.dumps(explain(engine, a.relation, a.at, **inputs), indent=1, default=str))
        return 0
    params = {k: float(v) if v.replace(".", "", 1).isdigit() else v for k, v in _pairs(a.param).items()}
    if a.command == "run":
        from ruletide.loop.run import Point, RunResult, run, write_ledger
        from ruletide.study import metrics

        if a.ledger and not a.out:
            raise SystemExit("--ledger needs --out")
        looped = tuple(n for n in a.ledger if n in program.closed_loop())
        result = RunResult(run(spark, program, facts, [Point("run", params, _config(a))], ledger=looped).tagged.persist())
        if a.out:
            result.write(a.out, {"params": params, **_config(a).to_dict()})
        if a.ledger:
            write_ledger(spark, program, facts, a.ledger, f"{a.out}/ledger", result, params)
        if a.nav:
            result.table("nav").write.mode("overwrite").parquet(a.nav)
        if a.returns:
            base = None if _config(a).compounding else _config(a).initial_cash
            metrics.write_returns(result.table("nav"), a.returns, base=base, by_day=a.by_day)
        print(result.table("final").first()["summary"])
        halt = result.table("halt").head()
        if halt is not None:
            print(halt["message"], file=sys.stderr)
        return int(halt is not None)
    from ruletide.study.study import Study, WalkForward, parse_axis

    study = Study(text, dict(map(parse_axis, a.axis)), a.target, holdout=a.holdout, walk=WalkForward.parse(a.walk_forward) if a.walk_forward else None, config=_config(a), log=a.log)
    if a.command == "reveal":
        print(json.dumps(study.reveal(spark, facts, a.point), indent=1, default=str))
        return 0
    found = study.run(spark, facts)
    if a.report:
        from ruletide.study.study import report

        for group, bias, status in report(found, _config(a).warnings()):
            print(f"{group:<12}{bias:<32}{status}")
    else:
        print(json.dumps(found, indent=1, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
