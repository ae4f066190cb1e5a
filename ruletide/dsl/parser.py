"""Text to syntax tree: one regular expression for tokens, recursive descent with binding powers for expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ruletide.dsl.ast import (
    AGGREGATES,
    RESOLUTIONS,
    Aggregate,
    Arg,
    Atom,
    Call,
    Compare,
    Duration,
    Lit,
    Name,
    Param,
    Rank,
    Resample,
    Rule,
    Signature,
    Span,
    Top,
    Unit,
    Var,
    Wild,
    Window,
)


class ParseError(Exception):
    def __init__(self, message: str, at: Span, code: str = "P"):
        super().__init__(f"{at.line}:{at.column}: {message}")
        self.at, self.code = at, code


_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*|//[^\n]*)
    |(?P<number>\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?)(?P<suffix>[a-zA-Z]+)?
    |(?P<res>@\d+[a-z]+)
    |(?P<name>[A-Za-z][A-Za-z0-9_]*)
    |(?P<text>"[^"\n]*")
    |(?P<op>:-|\.\.|<=|>=|[-+*/<>=(){},.:@_])""",
    re.X,
)
_DURATION = {"d": (0, 1), "w": (0, 7), "mo": (1, 0), "y": (12, 0)}
_SIMPLE_TYPES = {"Equity", "Timestamp", "Duration", "Count", "Scalar", "Decision", "Label"}
_CURRENCY_TYPES = {"Price", "Notional"}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: Span
    value: object = None


def tokens(text: str) -> list[Token]:
    out, pos, line, start = [], 0, 1, 0
    while pos < len(text):
        m = _TOKEN.match(text, pos)
        at = Span(line, pos - start + 1)
        if not m:
            raise ParseError(f"unexpected character {text[pos]!r}", at)
        if m["number"]:
            digits, suffix = m["number"].replace("_", ""), m["suffix"]
            if suffix:
                if suffix not in _DURATION or not digits.isdigit():
                    raise ParseError(f"unknown unit `{suffix}` of a number", at)
                months, days = _DURATION[suffix]
                out.append(Token("duration", m[0], at, Duration(months * int(digits), days * int(digits))))
            else:
                out.append(Token("number", m[0], at, int(digits) if digits.isdigit() else float(digits)))
        elif m["text"]:
            out.append(Token("text", m[0], at, m[0][1:-1]))
        elif not m["skip"]:
            kind = m.lastgroup
            out.append(Token(kind, m[0], at))
        for i, c in enumerate(m[0]):
            if c == "\n":
                line, start = line + 1, pos + i + 1
        pos = m.end()
    out.append(Token("end", "", Span(line, pos - start + 1)))
    return out


class _Parser:
    def __init__(self, text: str):
        self.all, self.i = tokens(text), 0

    @property
    def now(self) -> Token:
        return self.all[self.i]

    def ahead(self, k: int = 1) -> Token:
        return self.all[min(self.i + k, len(self.all) - 1)]

    def fail(self, wanted: str):
        raise ParseError(f"expected {wanted}, found {self.now.text or 'the end'!r}", self.now.at)

    def take(self, text: str | None = None, kind: str | None = None) -> Token:
        t = self.now
        if (text is not None and t.text != text) or (kind is not None and t.kind != kind):
            self.fail(f"`{text}`" if text else kind)
        self.i += 1
        return t

    def maybe(self, text: str) -> bool:
        if self.now.text == text and self.now.kind != "text":
            self.i += 1
            return True
        return False

    def listed(self, one, close: str = ")") -> list:
        out = []
        if self.now.text != close:
            out.append(one())
            while self.maybe(","):
                out.append(one())
        self.take(close)
        return out

    # units

    def units(self) -> list[Unit]:
        out = []
        while self.now.kind != "end":
            out.append(self.unit())
        return out

    def unit(self) -> Unit:
        at = self.now.at
        kind = self.take(kind="name").text
        if kind not in ("environment", "library", "strategy"):
            raise ParseError(f"expected environment, library or strategy, found `{kind}`", at)
        u = Unit(kind, self.take(kind="name").text, at=at)
        self.take("{")
        while not self.maybe("}"):
            if kind == "environment":
                u.signatures.append(self.primitive())
            else:
                self.item(u)
        return u

    def resolution(self) -> str:
        t = self.take(kind="res")
        if t.text[1:] not in RESOLUTIONS:
            raise ParseError(f"unknown resolution `{t.text}`", t.at)
        return t.text[1:]

    def primitive(self) -> Signature:
        s = self.signature()
        if s.res is None:
            self.fail("a resolution")
        return Signature(s.name, s.args, s.res, self.maybe("complete"), s.at)

    def item(self, u: Unit) -> None:
        t = self.now
        if t.text == "env" and self.ahead().kind == "name":
            self.i += 1
            u.env = self.take(kind="name").text
            if self.now.kind == "text":
                u.version = self.take().value
        elif t.text == "uses":
            self.i += 1
            u.uses.append(self.take(kind="name").text)
            while self.maybe(","):
                u.uses.append(self.take(kind="name").text)
        elif t.text == "revises":
            self.i += 1
            u.revises = self.take(kind="text").value
        elif t.text == "resolution":
            self.i += 1
            u.res = self.resolution()
        elif t.text == "mode":
            self.i += 1
            u.mode = self.take(kind="name").text
        elif t.text == "param":
            self.i += 1
            u.params.append(self.param())
        elif t.text == "rel":
            self.i += 1
            u.signatures.append(self.signature())
        else:
            u.rules.append(self.rule())

    def type(self) -> tuple[str, str | None]:
        t = self.take(kind="name")
        if t.text in _SIMPLE_TYPES:
            return t.text, None
        if t.text == "Quantity":
            self.take("<")
            self.take("Shares")
            self.take(">")
            return "Quantity", None
        if t.text in _CURRENCY_TYPES:
            self.take("<")
            cur = self.take(kind="name").text
            self.take(">")
            return t.text, cur
        raise ParseError(f"unknown type `{t.text}`", t.at, "T")

    def signature(self) -> Signature:
        at, name = self.now.at, self.take(kind="name").text
        self.take("(")

        def one() -> Arg:
            mode = self.now.text
            if mode not in ("+", "-", "@"):
                self.fail("`+`, `-` or `@`")
            self.i += 1
            var = self.take(kind="name").text
            self.take(":")
            return Arg(mode, var, *self.type())

        args = tuple(self.listed(one))
        if sum(a.mode == "@" for a in args) != 1:
            raise ParseError(f"`{name}` needs exactly one temporal key", at, "T")
        return Signature(name, args, self.resolution() if self.now.kind == "res" else None, at=at)

    def param(self) -> Param:
        at, name = self.now.at, self.take(kind="name").text
        self.take(":")
        kind, cur = self.type()
        self.take("=")
        default, low, high = self.literal_value(), None, None
        if self.maybe("in"):
            low = self.literal_value()
            self.take("..")
            high = self.literal_value()
        return Param(name, kind, cur, default, low, high, at)

    def literal_value(self) -> Lit:
        neg = self.maybe("-")
        e = self.primary()
        if not isinstance(e, Lit) or (neg and isinstance(e.value, (str, Duration))):
            self.fail("a literal")
        return Lit(-e.value, e.unit) if neg else e

    # rules

    def rule(self) -> Rule:
        at, head, body = self.now.at, self.atom(), ()
        if self.maybe(":-"):
            lits = [self.literal()]
            while self.maybe(","):
                lits.append(self.literal())
            body = tuple(lits)
        self.take(".")
        return Rule(head, body, at)

    def atom(self) -> Atom:
        at = self.now.at
        t = self.take(kind="name")
        if t.text[0].isupper():
            raise ParseError(f"`{t.text}` is a variable, not a relation", t.at)
        self.take("(")
        return Atom(t.text, tuple(self.listed(self.expr)), at=at)

    def literal(self):
        t, at = self.now, self.now.at
        nxt = self.ahead()
        if t.text == "not" and nxt.kind == "name":
            self.i += 1
            a = self.atom()
            return self._asof(Atom(a.name, a.args, True, None, at))
        if t.text in ("top", "rank", "resample") and nxt.text == "(":
            return getattr(self, f"_{t.text}")()
        if t.kind == "name" and t.text[0].isupper() and nxt.text == "in":
            return self._window()
        if t.kind == "name" and t.text[0].isupper() and nxt.text == "=" and self.ahead(2).text in AGGREGATES and self.ahead(3).text == "(":
            return self._aggregate()
        if t.kind == "name" and t.text[0].islower() and nxt.text == "(" and t.text not in ("log", "exp", "sqrt", "abs", "least", "greatest"):
            mark = self.i
            a = self.atom()
            if self.now.text in (",", ".", ")", "asof"):
                return self._asof(a)
            self.i = mark
        left = self.expr()
        op = self.now.text
        if op not in ("<", "<=", "=", ">=", ">"):
            self.fail("a comparison")
        self.i += 1
        return Compare(op, left, self.expr(), at)

    def _asof(self, a: Atom) -> Atom:
        return Atom(a.name, a.args, a.negated, self.expr(), a.at) if self.maybe("asof") else a

    def _window(self) -> Window:
        at, var = self.now.at, self.take(kind="name").text
        self.take("in")
        kind = self.take(kind="name").text
        if kind not in ("window", "prior_window", "rows"):
            raise ParseError(f"unknown window `{kind}`", at)
        self.take("(")
        time = self.expr()
        self.take(",")
        length = self.expr()
        self.take(",")
        self.take("min")
        least = self.expr()
        self.take(")")
        return Window(var, kind, time, length, least, at)

    def _aggregate(self) -> Aggregate:
        at, var = self.now.at, self.take(kind="name").text
        self.take("=")
        func = self.take(kind="name").text
        self.take("(")
        args = tuple(self.listed(self.expr))
        self.take("over")
        self.take("(")
        return Aggregate(var, func, args, tuple(self.listed(self.literal)), at)

    def _by(self) -> tuple:
        self.take("by")
        self.take("(")

        def one():
            var = self.take(kind="name").text
            way = self.take(kind="name").text
            if way not in ("asc", "desc"):
                self.i -= 1
                self.fail("asc or desc")
            return var, way == "desc"

        return tuple(self.listed(one))

    def _top(self) -> Top:
        at = self.take("top").at
        self.take("(")
        n = self.expr()
        self.take(",")
        a = self.atom()
        by = self._by() if self.maybe(",") else ()
        self.take(")")
        return Top(n, a, by, at)

    def _rank(self) -> Rank:
        at = self.take("rank").at
        self.take("(")
        a = self.atom()
        self.take(",")
        by = self._by()
        self.take(",")
        average = False
        if self.maybe("ties"):
            average = self.take(kind="name").text == "average"
            self.take(",")
        self.take("as")
        var = self.take(kind="name").text
        self.take(")")
        return Rank(a, by, average, var, at)

    def _resample(self) -> Resample:
        at = self.take("resample").at
        self.take("(")
        a = self.atom()
        self.take("to")
        to = self.resolution()
        self.take("as")
        time = self.take(kind="name").text
        self.take(",")
        self.take("min")
        least = self.expr()
        outs = []
        while self.maybe(","):
            var = self.take(kind="name").text
            self.take("=")
            func = self.take(kind="name").text
            self.take("(")
            e = self.expr()
            self.take(")")
            outs.append((var, func, e))
        self.take(")")
        return Resample(a, to, time, least, tuple(outs), at)

    # expressions

    def expr(self, power: int = 0):
        left = Call("neg", (self.expr(3),)) if self.maybe("-") else self.primary()
        if isinstance(left, Call) and left.op == "neg" and isinstance(left.args[0], Lit) and isinstance(left.args[0].value, (int, float)):
            left = Lit(-left.args[0].value, left.args[0].unit)
        while True:
            op = self.now.text
            mine = {"+": 1, "-": 1, "*": 2, "/": 2}.get(op if self.now.kind == "op" else "", 0)
            if not mine or mine <= power:
                return left
            self.i += 1
            left = Call(op, (left, self.expr(mine)))

    def primary(self):
        t = self.now
        if t.kind == "number":
            self.i += 1
            unit = None
            if self.now.text == "shares":
                self.i += 1
                unit = "shares"
            elif self.now.kind == "name" and re.fullmatch(r"[A-Z]{3}", self.now.text):
                unit = self.take().text
                if self.now.text == "/" and self.ahead().text == "share":
                    self.i += 2
                    unit += "/share"
            return Lit(t.value, unit)
        if t.kind in ("duration", "text"):
            self.i += 1
            return Lit(t.value)
        if self.maybe("("):
            e = self.expr()
            self.take(")")
            return e
        if self.maybe("_"):
            return Wild()
        if t.kind == "name":
            self.i += 1
            if self.now.text == "(" and not t.text[0].isupper():
                self.i += 1
                return Call(t.text, tuple(self.listed(self.expr)))
            return Var(t.text) if t.text[0].isupper() else Name(t.text)
        self.fail("a term")


def parse(text: str) -> list[Unit]:
    """The units of a source text, literals in written order."""
    return _Parser(text).units()
