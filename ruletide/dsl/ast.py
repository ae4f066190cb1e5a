"""The syntax tree of rule programs."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Union

#: Bar lengths, finest first, in seconds.
RESOLUTIONS = {"1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "1d": 86400}
AGGREGATES = {"sum", "mean", "std", "median", "quantile", "max", "min", "count", "corr", "cov", "ols_beta", "first", "last"}
RESAMPLE_AGGREGATES = {"first", "last", "max", "min", "sum", "mean", "count"}
SCALARS = {"log", "exp", "sqrt", "abs", "least", "greatest"}
TEMPORAL = {"prev", "lag", "month_start", "day_start"}
CONSTRUCTORS = {"delta": ("buy", "sell", "short", "cover"), "target": ("target_weight", "target_quantity")}
ORDERS = ("market", "moo", "moc", "moo_moc", "limit", "stop", "day", "gtc", "bars")
FEEDBACK = {"position": "A+T-Q", "cash": "T-C", "nav": "T-N", "fill": "A+T-Q-P", "decided": "T-D"}


def finer(a: str, b: str) -> bool:
    return RESOLUTIONS[a] < RESOLUTIONS[b]


@dataclass(frozen=True)
class Span:
    line: int = 0
    column: int = 0


@dataclass(frozen=True)
class Duration:
    months: int = 0
    days: int = 0

    @property
    def approx(self) -> float:
        """Days, a month counting 30.4375."""
        return self.months * 30.4375 + self.days

    def sql(self) -> str:
        return f"INTERVAL '{self.months}' MONTH" if self.months else f"INTERVAL '{self.days}' DAY"

    def __str__(self) -> str:
        return f"{self.months}mo" if self.months else f"{self.days}d"


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Wild:
    pass


@dataclass(frozen=True)
class Name:
    """A lower-case name in a term: a parameter, or an order word."""

    name: str


@dataclass(frozen=True)
class Lit:
    value: Union[int, float, str, Duration]
    unit: str | None = None  # "shares", "USD", "USD/share"


@dataclass(frozen=True)
class Call:
    """A scalar function, an operator (+ - * / neg) or a constructor."""

    op: str
    args: tuple


Expr = Union[Var, Wild, Name, Lit, Call]


@dataclass(frozen=True)
class Atom:
    name: str
    args: tuple[Expr, ...]
    negated: bool = False
    asof: Expr | None = None
    at: Span = field(default=Span(), compare=False)


@dataclass(frozen=True)
class Compare:
    op: str
    left: Expr
    right: Expr
    at: Span = field(default=Span(), compare=False)


@dataclass(frozen=True)
class Window:
    var: str
    kind: str  # window, prior_window, rows
    time: Expr
    length: Expr
    least: Expr
    at: Span = field(default=Span(), compare=False)


@dataclass(frozen=True)
class Aggregate:
    var: str
    func: str
    args: tuple[Expr, ...]
    body: tuple
    at: Span = field(default=Span(), compare=False)


@dataclass(frozen=True)
class Top:
    n: Expr
    atom: Atom
    by: tuple[tuple[str, bool], ...]  # variable, descending
    at: Span = field(default=Span(), compare=False)


@dataclass(frozen=True)
class Rank:
    atom: Atom
    by: tuple[tuple[str, bool], ...]
    average: bool
    var: str
    at: Span = field(default=Span(), compare=False)


@dataclass(frozen=True)
class Resample:
    atom: Atom
    to: str
    time: str
    least: Expr
    outputs: tuple[tuple[str, str, Expr], ...]
    at: Span = field(default=Span(), compare=False)


Literal = Union[Atom, Compare, Window, Aggregate, Top, Rank, Resample]


@dataclass(frozen=True)
class Arg:
    mode: str  # + - @
    name: str
    type: str
    currency: str | None = None


@dataclass(frozen=True)
class Signature:
    name: str
    args: tuple[Arg, ...]
    res: str | None = None
    complete: bool = False
    at: Span = field(default=Span(), compare=False)

    @property
    def key(self) -> int:
        return next(i for i, a in enumerate(self.args) if a.mode == "@")

    @property
    def inputs(self) -> list[int]:
        return [i for i, a in enumerate(self.args) if a.mode == "+"]

    @property
    def identity(self) -> list[int]:
        """Positions that identify a tuple: entities and the temporal key."""
        return [i for i, a in enumerate(self.args) if a.mode == "@" or a.type == "Equity"]


@dataclass(frozen=True)
class Param:
    name: str
    type: str
    currency: str | None
    default: Lit
    low: Lit | None = None
    high: Lit | None = None
    at: Span = field(default=Span(), compare=False)


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple
    at: Span = field(default=Span(), compare=False)


@dataclass
class Unit:
    kind: str  # environment, library, strategy
    name: str
    env: str | None = None
    version: str | None = None
    uses: list[str] = field(default_factory=list)
    revises: str | None = None
    res: str | None = None
    mode: str | None = None
    signatures: list[Signature] = field(default_factory=list)
    params: list[Param] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)
    at: Span = field(default_factory=Span)


def variables(node) -> list[str]:
    """Variables of a term, expression or literal in order of first appearance."""
    out: dict[str, None] = {}

    def walk(x):
        if isinstance(x, Var):
            out.setdefault(x.name)
        elif isinstance(x, Call):
            for a in x.args:
                walk(a)
        elif isinstance(x, Atom):
            for a in x.args:
                walk(a)
            if x.asof is not None:
                walk(x.asof)
        elif isinstance(x, Compare):
            walk(x.left)
            walk(x.right)
        elif isinstance(x, Window):
            out.setdefault(x.var)
            for a in (x.time, x.length, x.least):
                walk(a)
        elif isinstance(x, Aggregate):
            out.setdefault(x.var)
            for a in (*x.args, *x.body):
                walk(a)
        elif isinstance(x, (Top, Rank)):
            walk(x.atom)
            if isinstance(x, Top):
                walk(x.n)
            else:
                out.setdefault(x.var)
        elif isinstance(x, Resample):
            walk(x.atom)
            out.setdefault(x.time)
            for v, _, e in x.outputs:
                out.setdefault(v)
                walk(e)

    walk(node)
    return list(out)


def windows_first(body) -> list:
    """A body with each window ahead of the first literal that reads its variable."""
    out = list(body)
    for w in [x for x in out if isinstance(x, Window)]:
        first = next((i for i, x in enumerate(out) if x is not w and w.var in variables(x)), None)
        if first is not None and first < out.index(w):
            out.remove(w)
            out.insert(first, w)
    return out
