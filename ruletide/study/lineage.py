"""Lineages of programs: which studies are tries at one idea, and what was said against that.

A store is an append-only log of declarations, disputes and trials, in a file of the driver or (with a session) in a folder on
shared storage. A declared program joins the lineage of the most similar earlier program whose rules it shares to SIMILAR or
more (Jaccard index), else it begins one. A dispute takes a program out of its lineage, with a reason; the trials of a lineage
are those of all programs still in it, so that the best of many near copies is not judged as one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import SparkSession

from ruletide.plans.program import Program, link
from ruletide.study.study import append, fingerprint, read_log, rule_texts

SIMILAR = 0.8


@dataclass
class Lineage:
    name: str
    programs: list[str] = field(default_factory=list)
    disputes: dict[str, str] = field(default_factory=dict)
    ratios: list[float] = field(default_factory=list)

    @property
    def trials(self) -> int:
        return len(self.ratios)

    @property
    def variance(self) -> float:
        return float(np.var(self.ratios, ddof=1)) if len(self.ratios) > 1 else 0.0


class Lineages:
    """The store at a path."""

    def __init__(self, path: str, spark: SparkSession | None = None):
        self.path, self.spark = path, spark

    def records(self) -> list[dict]:
        try:
            return read_log(self.path, self.spark)
        except Exception as e:  # a folder that nothing was written to yet
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise

    def declare(self, program: Program | str, note: str = "") -> tuple[str, float]:
        """Declare a program; its lineage and the similarity that put it there (1 for one known, 0 for a new lineage)."""
        p = link(program) if isinstance(program, str) else program
        mark, rules = fingerprint(p), rule_texts(p)
        known = [r for r in self.records() if r["kind"] == "declare"]
        own = next((r for r in known if r["program"] == mark), None)
        if own is not None:
            return own["lineage"], 1.0
        alike = [(len(rules & set(r["rules"])) / len(rules | set(r["rules"])) if rules | set(r["rules"]) else 1.0, r["lineage"]) for r in known]
        best, lineage = max(alike, default=(0.0, mark))
        if best < SIMILAR:
            best, lineage = 0.0, mark
        append(self.path, {"kind": "declare", "program": mark, "lineage": lineage, "similarity": best, "rules": sorted(rules), "note": note}, self.spark)
        return lineage, best

    def _known(self, program: str) -> dict:
        found = next((r for r in self.records() if r["kind"] == "declare" and r["program"] == program), None)
        if found is None:
            raise ValueError(f"program {program} was never declared")
        return found

    def dispute(self, program: str, reason: str) -> None:
        """Take a declared program out of its lineage; a reason is needed."""
        if not reason.strip():
            raise ValueError("a dispute needs a reason")
        append(self.path, {"kind": "dispute", "program": program, "lineage": self._known(program)["lineage"], "reason": reason}, self.spark)

    def trial(self, program: str, ratio: float) -> None:
        """Log one trial of a declared program: its ratio for a period."""
        self._known(program)
        append(self.path, {"kind": "trial", "program": program, "ratio": ratio}, self.spark)

    def all(self) -> dict[str, Lineage]:
        """Every lineage with its programs, disputes and the trials that count for it."""
        out: dict[str, Lineage] = {}
        records = self.records()
        disputed = {r["program"]: r["reason"] for r in records if r["kind"] == "dispute"}
        home = {}
        for r in records:
            if r["kind"] == "declare":
                line = out.setdefault(r["lineage"], Lineage(r["lineage"]))
                line.programs.append(r["program"])
                home[r["program"]] = r["lineage"]
                if r["program"] in disputed:
                    line.disputes[r["program"]] = disputed[r["program"]]
        for r in records:
            if r["kind"] == "trial" and r["program"] not in disputed:
                out[home[r["program"]]].ratios.append(r["ratio"])
        return out
