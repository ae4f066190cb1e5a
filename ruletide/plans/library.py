"""The libraries that ship with the engine, built as syntax trees from tables of what each relation measures.

A relation is one of a few kinds: a rolling aggregate over a frame, a change between two bars, a resampled field, a default
for a sparse relation, a filter of another relation. The tables below name sources, frames, aggregates and guards; the
builders turn a row into signature and rules over any environment of the shape that a library needs.
"""

from __future__ import annotations

from functools import reduce

from ruletide.dsl.ast import Aggregate, Arg, Atom, Call, Compare, Duration, Lit, Resample, Rule, Signature, Unit, Var, Wild, Window
from ruletide.dsl.printer import library as printed

WHO, NOW, THEN, SPAN, LEAST = Var("A"), Var("T"), Var("Then"), Var("N"), Var("K")
ANY = Wild()
#: Argument types by short name.
KINDS = {"price": ("Price", "USD"), "money": ("Notional", "USD"), "shares": ("Quantity", None), "number": ("Scalar", None), "span": ("Duration", None), "count": ("Count", None)}


def _call(op: str, *args) -> Call:
    return Call(op, tuple(args))


def _is(var: str, value) -> Compare:
    return Compare("=", Var(var), value)


class Builder:
    """Collects the relations of one library."""

    def __init__(self, name: str, env: str, res: str, base: str):
        self.unit, self.base = Unit("library", name, env, res=res), base

    def declare(self, name: str, takes: dict[str, str] | None = None, gives: dict[str, str] | None = None, who: str | None = "+") -> Atom:
        """Add a signature and return its head."""
        extra = [Arg(mode, v, *KINDS[k]) for mode, by in (("+", takes), ("-", gives)) for v, k in (by or {}).items()]
        args = ([Arg(who, "A", "Equity")] if who else []) + [Arg("@", "T", "Timestamp"), *extra]
        self.unit.signatures.append(Signature(name, tuple(args)))
        return Atom(name, tuple(Var(a.name) for a in args))

    def rule(self, head: Atom, *body) -> None:
        self.unit.rules.append(Rule(head, tuple(body)))

    def live(self, t=NOW, who=WHO) -> Atom:
        return Atom(self.base, (who, t))

    def bars(self, name: str, source: str | None = None) -> None:
        """The times at which any entity has a tuple of the source."""
        self.rule(self.declare(name, who=None), Atom(source or self.base, (ANY, NOW)))

    def read(self, source: str, t, var, who: bool = True) -> Atom:
        return Atom(source, (WHO, t, var) if who else (t, var))

    def measured(self, out: str, func: str, factors: tuple[str, ...], frame: str, span=SPAN, least=LEAST, who: bool = True) -> Aggregate:
        """An aggregate of the product of the factors over a frame of bars."""
        found = [Var(f"F{i + 1}") for i in range(len(factors))]
        reads = [self.read(f, THEN, v, who) for f, v in zip(factors, found, strict=True)]
        return Aggregate(out, func, (reduce(lambda a, b: _call("*", a, b), found),), (Window(THEN.name, frame, NOW, span, least), *reads))

    def rolling(self, name: str, out: str, kind: str, func: str, factors: tuple[str, ...], frame: str = "window") -> None:
        """An aggregate over a trailing frame, for every live entity and bar."""
        self.rule(self.declare(name, {"N": "span", "K": "count"}, {out: kind}), self.live(), self.measured(out, func, factors, frame))

    def relative(self, name: str, out: str, source: str, times: tuple[Atom, ...], late, early, value, takes: dict | None = None, guard: bool = False) -> None:
        """A function of the source's values at two bars."""
        new, old = Var("New"), Var("Old")
        head = self.declare(name, takes, {out: "number"})
        self.rule(head, *([self.live()] if guard else []), *times, self.read(source, late, new), self.read(source, early, old), _is(out, value(new, old)))

    def sparse(self, name: str, source: str, out: str, kind: str, otherwise: Lit) -> None:
        """The source where it has a tuple, else a constant; one value for every live entity and bar."""
        head = self.declare(name, None, {out: kind})
        self.rule(head, self.live(), self.read(source, NOW, Var(out)))
        self.rule(Atom(head.name, (*head.args[:-1], otherwise)), self.live(), Atom(source, (WHO, NOW, ANY), negated=True))

    def at_least(self, name: str, source: Atom, var: str, floor: str, takes: dict, gives: dict | None = None, also: tuple = ()) -> None:
        """A relation's tuples whose value reaches an input."""
        self.rule(self.declare(name, {**takes, floor: "money"}, gives), *also, source, Compare(">=", Var(var), Var(floor)))

    def book(self, held: str, flat: str) -> None:
        """Who is held, and how much; who is live and not."""
        self.rule(self.declare(held, None, {"Q": "shares"}, who="-"), self.read("position", NOW, Var("Q")), Compare(">", Var("Q"), Lit(0, "shares")))
        self.rule(self.declare(flat), self.live(), Atom("position", (WHO, NOW, ANY), negated=True))


def _growth(new, old):
    return _call("-", _call("/", new, old), Lit(1))


_TURNOVER = {"out": "D", "kind": "money", "func": "mean", "factors": ("close", "volume")}
_MONTH_ADV = (WHO, NOW, Lit(Duration(days=20)), Lit(10), Var("D"))


def features(env: str) -> Unit:
    """Daily features: needs close, volume, universe and (for the last three) the executor's feedback."""
    b = Builder("features", env, "1d", "universe")
    b.bars("bar")
    for name, out, kind, func, factors, frame in (
        ("sma", "M", "price", "mean", ("close",), "window"),
        ("realized_vol", "V", "number", "std", ("logret",), "window"),
        ("highest", "H", "price", "max", ("close",), "prior_window"),
    ):
        b.rolling(name, out, kind, func, factors, frame)
    b.rolling("adv", **_TURNOVER)
    b.relative("logret", "R", "close", (Atom("prev", (NOW, THEN)),), NOW, THEN, lambda new, old: _call("log", _call("/", new, old)))
    far, near = Var("Far"), Var("Near")
    lags = tuple(Atom("lag", (NOW, Var(v), t)) for v, t in (("Lookback", far), ("Skip", near)))
    b.relative("momentum", "M", "close", lags, near, far, _growth, {"Lookback": "span", "Skip": "span"}, guard=True)
    spans = {"Lookback": "span", "Skip": "span"}
    scored = Atom("momentum", (WHO, NOW, Var("Lookback"), Var("Skip"), Var("M")))
    b.at_least("mom_candidate", Atom("adv", _MONTH_ADV), "D", "MinAdv", spans, {"M": "number"}, also=(b.live(), scored))
    # the distance from the frame's mean in its deviations
    head = b.declare("zscore", {"N": "span", "K": "count"}, {"Z": "number"})
    center, spread = (b.measured(v, f, ("close",), "window") for v, f in (("Mid", "mean"), ("Dev", "std")))
    b.rule(head, b.read("close", NOW, Var("X")), center, spread, _is("Z", _call("/", _call("-", Var("X"), Var("Mid")), Var("Dev"))))
    b.book("held", "flat")
    bought = Aggregate("C", "count", (THEN,), (Window(THEN.name, "prior_window", NOW, SPAN, Lit(1)), Atom("decided", (THEN, _call("buy", WHO, ANY)))))
    b.rule(b.declare("bought_within", {"N": "span"}), b.live(), bought, Compare(">", Var("C"), Lit(0)))
    return b.unit


def features_m(env: str) -> Unit:
    """Minute views of the executor's state."""
    b = Builder("features_m", env, "1m", "universe_m")
    b.book("held_m", "flat_m")
    return b.unit


def bars(env: str, least: int, close: str, volume: str) -> Unit:
    """Daily bars from minute closes; so many minutes make a bar."""
    b = Builder("bars", env, "1d", "universe_d")

    def fold(name: str, source: tuple, out: str, func: str, of: Var, need: int, gives: dict | None, who: str) -> None:
        b.rule(b.declare(name, None, gives, who), Resample(Atom(source[0], source[1:]), "1d", "T", Lit(need), ((out, func, of),)))

    fold("universe_d", ("universe_m", WHO, THEN), "N", "count", THEN, 1, None, "-")
    b.bars("bar_d")
    for name, source, out, kind, func in (
        ("open_d", close, "O", "price", "first"),
        ("high_d", close, "H", "price", "max"),
        ("low_d", close, "L", "price", "min"),
        ("close_d", close, "C", "price", "last"),
        ("volume_d", volume, "V", "shares", "sum"),
    ):
        fold(name, (source, WHO, THEN, Var("X")), out, func, Var("X"), least, {out: kind}, "+")
    return b.unit


def catalog(env: str) -> Unit:
    """Total returns and split-adjusted closes from a catalog of actions."""
    b = Builder("catalog", env, "1d", "universe")
    b.bars("bar")
    before = Atom("prev", (NOW, THEN))
    b.sparse("split_or_one", "split", "F", "number", Lit(1))
    # dividends whose ex-date is the bar, announced within a year
    paid = Aggregate("D", "sum", (Var("X"),), (Window(THEN.name, "window", NOW, _years("1y"), Lit(1)), Atom("dividend", (WHO, THEN, Var("Ex"), Var("X"))), Compare("=", Var("Ex"), NOW)))
    b.rule(b.declare("div_at", None, {"D": "price"}), b.live(), paid)
    b.sparse("div_or_zero", "div_at", "D", "price", Lit(0, "USD/share"))
    both = (before, b.read("split_or_one", NOW, Var("F")), b.read("div_or_zero", NOW, Var("D")))
    b.relative("ret", "R", "close", both, NOW, THEN, lambda new, old: _growth(_call("+", _call("*", new, Var("F")), Var("D")), old))
    b.rule(b.declare("listed_before"), b.live(), before, b.live(THEN))
    # a chain that begins where an entity appears and multiplies on
    head = b.declare("cumfactor", None, {"C": "number"})
    b.rule(head, b.live(), Atom("listed_before", (WHO, NOW), negated=True), b.read("split_or_one", NOW, Var("C")))
    b.rule(head, Atom("listed_before", (WHO, NOW)), before, b.read("cumfactor", THEN, Var("Last")), b.read("split_or_one", NOW, Var("F")), _is("C", _call("*", Var("Last"), Var("F"))))
    b.rule(b.declare("close_adj", None, {"P": "price"}), b.read("cumfactor", NOW, Var("C")), b.read("close", NOW, Var("X")), _is("P", _call("*", Var("X"), Var("C"))))
    b.rule(b.declare("logret", None, {"R": "number"}), b.read("ret", NOW, Var("X")), _is("R", _call("log", _call("+", Lit(1), Var("X")))))
    b.rolling("adv", **_TURNOVER)
    b.at_least("liquid", Atom("adv", _MONTH_ADV), "D", "MinAdv", {})
    return b.unit


def metrics(env: str) -> Unit:
    """The book's own return, peak, drawdown and volatility."""
    b = Builder("metrics", env, "1d", "nav")
    worth = lambda t, v: Atom("nav", (t, Var(v)))
    some = Atom("nav", (NOW, ANY))
    b.rule(b.declare("nav_ret", None, {"R": "number"}, who=None), Atom("prev", (NOW, THEN)), worth(NOW, "New"), worth(THEN, "Old"), _is("R", _growth(Var("New"), Var("Old"))))
    b.rule(b.declare("peak_nav", None, {"P": "money"}, who=None), some, b.measured("P", "max", ("nav",), "window", _years("100y"), Lit(1), who=False))
    b.rule(b.declare("drawdown", None, {"D": "number"}, who=None), worth(NOW, "X"), Atom("peak_nav", (NOW, Var("P"))), _is("D", _call("-", Lit(1), _call("/", Var("X"), Var("P")))))
    b.rule(b.declare("nav_vol", {"N": "span", "K": "count"}, {"V": "number"}, who=None), some, b.measured("V", "std", ("nav_ret",), "window", who=False))
    return b.unit


def _years(text: str) -> Lit:
    """A length of years."""
    return Lit(Duration(months=12 * int(text.removesuffix("y"))))


LIBRARIES = {"features": features, "features_m": features_m, "bars": bars, "catalog": catalog, "metrics": metrics}


def unit(name: str, env: str, least: int = 300, close: str = "close_m", volume: str = "volume_m") -> Unit:
    """A library for an environment of the given name."""
    return LIBRARIES[name](env, least, close, volume) if name == "bars" else LIBRARIES[name](env)


def library(name: str, env: str, least: int = 300, close: str = "close_m", volume: str = "volume_m") -> str:
    """The rule text of a library."""
    return printed(unit(name, env, least, close, volume))
