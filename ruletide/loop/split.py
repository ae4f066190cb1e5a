"""What a run's instruments have to do with one another.

Where neither the rules nor the account tie them together, a run is the sum of runs over parts of its instruments. Where they
do, it is one sequence, but still needs the market of those instruments only that a decision can name.
"""

from __future__ import annotations

from ruletide.dsl.ast import TEMPORAL, Aggregate, Atom, Call, Lit, Name, Rank, Resample, Top, Var, variables, windows_first
from ruletide.loop.config import ExecConfig
from ruletide.plans.program import Program, Relation, literal_of


def entities(rel: Relation) -> list[int]:
    return [i for i, a in enumerate(rel.sig.args) if a.type == "Equity"]


def _subject(rel: Relation, rule) -> tuple[str, bool] | None:
    """The variable of the instrument that a rule is about, and whether its caller has bound it."""
    if rel.kind == "output":
        made = rule.head.args[1]
        who = made.args[0] if isinstance(made, Call) and made.args else None
        return (who.name, False) if isinstance(who, Var) else None
    at = entities(rel)
    if len(at) != 1 or not isinstance(rule.head.args[at[0]], Var):
        return None
    return rule.head.args[at[0]].name, rel.sig.args[at[0]].mode == "+"


def _about(program: Program, a: Atom, who: str) -> bool | None:
    """Whether an atom is about that instrument; None if it is about none."""
    if a.name == "decided":
        made = a.args[1]
        return isinstance(made, Call) and bool(made.args) and made.args[0] == Var(who)
    rel = program.relations[a.name]
    at = entities(rel)
    if not at:
        return False if rel.kind == "feedback" else None
    return len(at) == 1 and a.args[at[0]] == Var(who)


def rules_apart(program: Program, everything: bool = False) -> bool:
    """Whether every rule of the feedback loop is about one instrument, so that no rule sees two.

    everything: the same of all rules that the decisions need, where none of them is solved beforehand.
    """
    closed = program.closed_loop() | {"decide"}
    if everything:
        closed |= set(program.relations)

    def fits(body, who: str, bound: bool) -> bool:
        for lit in windows_first(body):
            if isinstance(lit, (Top, Rank)):
                return False
            if isinstance(lit, Resample):
                if not everything or not _about(program, lit.atom, who):
                    return False
                bound = True
            elif isinstance(lit, Aggregate):
                # an aggregate over an instrument that is still free is one over all of them
                if not bound or not fits(lit.body, who, bound):
                    return False
            elif isinstance(lit, Atom) and lit.name not in TEMPORAL:
                about = _about(program, lit, who)
                if about is False or (about is None and lit.name in closed):
                    return False
                bound = bound or (about is True and not lit.negated)
        return True

    for name in closed & program.reachable("decide"):
        rel = program.relations[name]
        if rel.kind in ("feedback", "primitive"):
            continue
        for rule in rel.rules:
            found = _subject(rel, rule)
            if found is None or not fits(rule.body, *found):
                return False
    return True


def account_apart(c: ExecConfig) -> bool:
    """Whether no instrument's orders depend on the account's cash or worth, which the others move."""
    return not c.compounding and c.on_leverage == "allow" and c.on_margin_call == "allow" and c.on_ruin == "continue" and c.on_oversize != "halt" and c.cash_rate == 0 and c.margin_rate == 0


def candidates(program: Program) -> set[str] | None:
    """Relations without feedback that name every instrument a decision can be about; None where the rules do not tell."""
    closed = program.closed_loop() | {"decide"}
    # what the feedback names was decided before, so it adds nothing; the rest is a least fixed point over the loop's relations
    found: dict[str, set[str]] = {n: set() for n in closed}

    def of(rel: Relation, rule) -> set[str] | None:
        subject = _subject(rel, rule)
        if subject is None:
            return None
        about = [a.name for a in rule.body if isinstance(a, Atom) and a.name not in TEMPORAL and not a.negated and _about(program, a, subject[0])]
        inner = [found[n] for n in about if n in closed]
        plain = [{n} for n in about if n not in closed]
        return set() if set() in inner else plain[0] if plain else inner[0] if inner else None

    loop = [program.relations[n] for n in closed & program.reachable("decide") if program.relations[n].kind != "feedback"]
    while True:
        new = {rel.name: [of(rel, rule) for rule in rel.rules] for rel in loop}
        if any(None in x for x in new.values()):
            return None
        new = {n: set().union(*x) for n, x in new.items()}
        if all(found[n] == x for n, x in new.items()):
            return found["decide"]
        found |= new


def feedback_read(program: Program) -> set[str]:
    """Feedback relations that the decisions read; the others need no history."""
    return {n for n in program.reachable("decide") if program.relations[n].kind == "feedback"}


def halts_never(program: Program, overrides: dict) -> bool:
    """Whether the text alone shows that no decision can be refused: one for each instrument and bar, of a positive amount."""
    rel = program.relations["decide"]
    if len(rel.rules) != 1:
        return False
    t, made = rel.rules[0].head.args
    if not isinstance(made, Call) or not set(variables(made)) <= {*variables(t), *variables(made.args[0])}:
        return False
    if rel.unit.mode != "delta":
        return True
    amount = made.args[1]
    if isinstance(amount, Name):
        p = program.param(rel.unit.name, amount.name)
        amount = literal_of(p, overrides.get(amount.name)) if p else None
    return isinstance(amount, Lit) and isinstance(amount.value, (int, float)) and amount.value > 0
