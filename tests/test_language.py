"""Parser and checker: one program for each judgment."""

from __future__ import annotations

import pytest

from ruletide.dsl import types as ty
from ruletide.dsl.ast import Aggregate, Atom, Call, Compare, Duration, Lit, Rank, Resample, Top, Var, Window
from ruletide.dsl.checker import check, completeness, degrees_of_freedom
from ruletide.dsl.parser import ParseError, parse
from ruletide.observe.explain import graph, show
from ruletide.plans.library import LIBRARIES, library
from ruletide.plans.program import link

ENV = """
environment daily { close(+A: Equity, @T: Timestamp, -P: Price<USD>) @1d  volume(+A: Equity, @T: Timestamp, -V: Quantity<Shares>) @1d
  universe(-A: Equity, @T: Timestamp) @1d complete  split(+A: Equity, @T: Timestamp, -F: Scalar) @1d complete
  dividend(+A: Equity, @T: Timestamp, -Ex: Timestamp, -D: Price<USD>) @1d complete  ticker(+A: Equity, @T: Timestamp, -S: Label) @1d complete
  minute(+A: Equity, @T: Timestamp, -P: Price<USD>) @1m }
"""


def strategy(body: str, mode: str = "target", extra: str = "") -> str:
    return f"{ENV}{library('features', 'daily')}{extra} strategy s {{ env daily uses features resolution @1d mode {mode} {body} }}"


def codes(body: str, **kw) -> set[str]:
    return {f.code for f in check(strategy(body, **kw))}


CLEAN = "rel sel(-A: Equity, @T: Timestamp) sel(A, T) :- universe(A, T), close(A, T, P), P > 5 USD/share. decide(T, target_weight(A, 0.1)) :- sel(A, T). "


def test_every_literal_form_parses():
    u = parse("""library x { env daily resolution @1d param n : Count = 1_000 in 1..2_000  # comment
      rel r(+A: Equity, @T: Timestamp, -X: Scalar)  // another
      r(A, T, X) :- a(A, T, -1.5e3), not b(A, _, T), c(A, U, Y) asof T, Z = mean(P * (V + 2)) over (U in prior_window(T, 3mo, min n), d(A, U, P)),
        top(3, e(A, T, M), by (M desc, A asc)), rank(f(A, T, M), by (M asc), ties average, as K), resample(g(A, W, Q) to @1d as T, min 2, O = first(Q)),
        X = log(Y) / -2 - 3 * K, X <= 100 shares, Y >= 60 USD/share, L = "abc". }""")[0]
    body = u.rules[0].body
    assert [type(b) for b in body] == [Atom, Atom, Atom, Aggregate, Top, Rank, Resample, Compare, Compare, Compare, Compare]
    assert body[1].negated and body[2].asof == Var("T") and isinstance(body[3].body[0], Window)
    assert body[3].body[0].length == Lit(Duration(3, 0)) and u.params[0].default.value == 1000
    assert body[7].right == Call("-", (Call("/", (Call("log", (Var("Y"),)), Lit(-2))), Call("*", (Lit(3), Var("K")))))
    assert body[8].right == Lit(100, "shares") and body[9].right == Lit(60, "USD/share")


@pytest.mark.parametrize("text", ["library x { r(A) :- }", "strategy { }", "library x { rel r(+A: Thing, @T: Timestamp) }", "library x { rel r(+A: Equity) }", "library x { r(T) :- 5q > 3. }", "environment e { a(@T: Timestamp) }", "library x { resolution @7d }", "library x { r(T) :- a(T) ? b(T). }"])
def test_bad_syntax_is_located(text):
    with pytest.raises(ParseError) as e:
        parse(text)
    assert e.value.at.line == 1


def test_shipped_libraries_and_a_strategy_are_clean():
    env = ENV + "environment bars1m { close_m(+A: Equity, @T: Timestamp, -P: Price<USD>) @1m volume_m(+A: Equity, @T: Timestamp, -V: Quantity<Shares>) @1m universe_m(-A: Equity, @T: Timestamp) @1m complete }"
    for name in LIBRARIES:
        assert check(env + library(name, "bars1m" if name in ("bars", "features_m") else "daily"), name) == []
    assert check(strategy(CLEAN)) == []


NEGATIVE = {
    "undeclared": ("U", CLEAN + "rel b(-A: Equity, @T: Timestamp) b(A, T) :- nowhere(A, T). decide(T, target_weight(A, 0)) :- b(A, T)."),
    "unknown parameter": ("U", CLEAN + "decide(T, target_weight(A, 0)) :- universe(A, T), close(A, T, P), P < missing."),
    "reserved": ("U", CLEAN + "rel top(-A: Equity, @T: Timestamp) top(A, T) :- sel(A, T)."),
    "unbound head": ("B", CLEAN + "rel b(-A: Equity, @T: Timestamp, -X: Scalar) b(A, T, X) :- universe(A, T)."),
    "unbound comparison": ("B", CLEAN + "rel b(-A: Equity, @T: Timestamp) b(A, T) :- universe(A, T), X > 3."),
    "negation in aggregate": ("B", CLEAN + "rel b(@T: Timestamp, -N: Count) b(T, N) :- bar(T), N = count(A) over (universe(A, T), not split(A, T, _))."),
    "unbound input": ("M", CLEAN + "rel b(-A: Equity, @T: Timestamp) b(A, T) :- close(A, T, P), P > 1 USD/share."),
    "wild input": ("M", CLEAN + "rel b(@T: Timestamp) b(T) :- bar(T), close(_, T, P), P > 1 USD/share."),
    "price plus scalar": ("T", CLEAN + "rel b(-A: Equity, @T: Timestamp, -P: Price<USD>) b(A, T, P) :- universe(A, T), close(A, T, Q), X = 0.5, P = Q + X."),
    "wrong arity": ("T", CLEAN + "rel b(-A: Equity, @T: Timestamp) b(A, T) :- universe(A, T, 3)."),
    "unlike comparison": ("T", CLEAN + "rel b(-A: Equity, @T: Timestamp) b(A, T) :- universe(A, T), close(A, T, P), volume(A, T, V), P > V."),
    "ordered names": ("T", CLEAN + 'rel b(-A: Equity, @T: Timestamp) b(A, T) :- universe(A, T), ticker(A, T, S), S < "x".'),
    "range": ("T", "param n : Count = 9 in 1..5 " + CLEAN + "decide(T, target_weight(A, 0)) :- top(n, universe(A, T), by (A asc))."),
    "look-ahead": ("F", CLEAN + "rel b(-A: Equity, @T: Timestamp) b(A, T) :- universe(A, T), dividend(A, T, Ex, _), close(A, Ex, P), P > 1 USD/share."),
    "full sample": ("F", CLEAN + "rel b(@T: Timestamp, -M: Scalar) b(T, M) :- bar(T), M = count(A) over (universe(A, U))."),
    "same-bar history": ("F", CLEAN + "decide(T, target_weight(A, 0)) :- decided(T, target_weight(A, _))."),
    "time value as key": ("F", CLEAN + "rel b(-A: Equity, @T: Timestamp) b(A, T) :- universe(A, T), U = T, universe(A, U)."),
    "no step": ("R", CLEAN + "rel b(+A: Equity, @T: Timestamp) b(A, T) :- universe(A, T), b(A, T)."),
    "incomplete primitive": ("N", CLEAN + "rel b(-A: Equity, @T: Timestamp) b(A, T) :- universe(A, T), not close(A, T, _)."),
    "incomplete derived": ("N", CLEAN + "rel b(-A: Equity, @T: Timestamp) b(A, T) :- universe(A, T), not sel(A, T)."),
    "negated builtin": ("N", CLEAN + "rel b(-A: Equity, @T: Timestamp) b(A, T) :- universe(A, T), not month_start(T)."),
    "negation cycle": ("S", CLEAN + "rel b(-A: Equity, @T: Timestamp) rel c(-A: Equity, @T: Timestamp) b(A, T) :- universe(A, T), not c(A, T). c(A, T) :- universe(A, T), not b(A, T)."),
    "unordered top": ("D", CLEAN + "decide(T, target_weight(A, 0)) :- top(3, universe(A, T))."),
    "top without identity": ("D", CLEAN + "rel c(-A: Equity, @T: Timestamp, -P: Price<USD>) c(A, T, P) :- universe(A, T), close(A, T, P). decide(T, target_weight(A, 0)) :- top(3, c(A, T, P), by (P desc))."),
    "first outside resample": ("D", CLEAN + "rel b(-A: Equity, @T: Timestamp, -P: Price<USD>) b(A, T, P) :- universe(A, T), P = last(Q) over (universe(A, T), close(_, T, Q))."),
    "no decision": ("Z", "rel b(-A: Equity, @T: Timestamp) b(A, T) :- universe(A, T)."),
    "wrong constructor": ("C", CLEAN + "decide(T, buy(A, 5 shares)) :- universe(A, T)."),
    "mixed resolutions": ("X", CLEAN + "rel b(-A: Equity, @T: Timestamp) b(A, T) :- universe(A, T), minute(A, T, P), P > 1 USD/share."),
    "resample down": ("X", CLEAN + "rel b(-A: Equity, @T: Timestamp) b(A, T) :- resample(universe(A, U) to @1d as T, min 1, N = count(U))."),
    "dead relation": ("W1", CLEAN + "rel b(-A: Equity, @T: Timestamp) b(A, T) :- universe(A, T)."),
    "unused parameter": ("W2", "param n : Count = 3 " + CLEAN),
    "no rules": ("W3", CLEAN + "rel b(-A: Equity, @T: Timestamp)"),
    "degenerate top": ("W4", CLEAN + "decide(T, target_weight(A, 0)) :- universe(A, T), top(1, close(A, T, P), by (P desc))."),
    "written numbers": ("W5", CLEAN + "decide(T, target_weight(A, 0.2)) :- universe(A, T), close(A, T, P), P > 7 USD/share, P < 9 USD/share, P * 3 > 22 USD/share."),
    "ticker snapshot": ("W6", CLEAN + 'rel b(-A: Equity, @T: Timestamp) b(A, T) :- universe(A, T), ticker(A, T, "SPY"). decide(T, target_weight(A, 0)) :- b(A, T).'),
}


@pytest.mark.parametrize("name", NEGATIVE)
def test_negative(name):
    code, body = NEGATIVE[name]
    assert code in codes(body), check(strategy(body))


def test_environment_codes():
    assert check("strategy s { env nowhere resolution @1d mode delta }")[0].code == "E"
    assert check(ENV + 'library l { env other resolution @1d } strategy s { env daily uses l resolution @1d mode delta }')[0].code == "E"
    assert check(ENV + "strategy s { env daily uses missing resolution @1d mode delta }")[0].code == "U"
    assert check(ENV + "library x { env daily resolution @1d rel close(-A: Equity, @T: Timestamp) }")[0].code == "U"


def test_recursion_may_step_back_through_prev_lag_or_strict_asof():
    for step in ("prev(T, U), b(A, U, J)", "lag(T, 5d, U), b(A, U, J)", "prev(T, U), b(A, _, J) asof U"):
        assert codes(CLEAN + f"rel b(+A: Equity, @T: Timestamp, -K: Scalar) b(A, T, 0) :- universe(A, T), month_start(T). b(A, T, K) :- universe(A, T), {step}, K = J + 1. decide(T, target_weight(A, 0)) :- universe(A, T), b(A, T, K), K > 3.") == set()
    assert "R" in codes(CLEAN + "rel b(+A: Equity, @T: Timestamp, -K: Scalar) b(A, T, K) :- universe(A, T), lag(T, 0d, U), b(A, U, J), K = J + 1.")


def test_dimensions():
    price, shares = ty.declared("Price", "USD"), ty.declared("Quantity", None)
    assert str(ty.binary("*", price, shares)) == "Notional<USD>" and ty.binary("/", ty.COUNT, ty.COUNT) == ty.SCALAR
    assert ty.binary("*", ty.function("sqrt", [price]), ty.function("sqrt", [price])) == price
    assert ty.aggregate("ols_beta", [price, shares]) == ty.binary("/", price, shares) and ty.aggregate("corr", [price, shares]) == ty.SCALAR
    with pytest.raises(ty.TypeProblem):
        ty.binary("*", price, ty.declared("Price", "EUR"))
    with pytest.raises(ty.TypeProblem):
        ty.function("log", [price])


def test_completeness_strata_and_freedom():
    text = strategy("param n : Count = 3 in 1..9 rel c(-A: Equity, @T: Timestamp, -P: Price<USD>) rel t(-A: Equity, @T: Timestamp) c(A, T, P) :- universe(A, T), close(A, T, P). t(A, T) :- top(n, c(A, T, P), by (P desc, A asc)). decide(T, target_weight(A, 0.25)) :- t(A, T), flat(A, T). decide(T, target_weight(A, 0)) :- held(A, T, _), not t(A, T).")
    p = link(text)
    assert check(text) == [] and "t" in completeness(p) and "c" not in completeness(p)
    assert p.closed_loop() >= {"held", "flat", "decide"} and "t" not in p.closed_loop()
    level = p.strata()
    assert level["c"] < level["t"] < level["decide"]
    assert degrees_of_freedom(p) == 2
    g = {x["relation"]: x for x in graph(p)}
    assert g["decide"]["closed_loop"] and g["decide"]["depth"] > g["t"]["depth"] and "t [derived @1d] <- c" in show(p)


def test_printed_rules_parse_to_the_same_tree():
    from ruletide.dsl import printer
    from ruletide.plans.library import unit

    for name in LIBRARIES:
        made = unit(name, "e")
        back = parse(printer.library(made))[0]
        assert (back.name, back.env, back.res, back.signatures, back.rules) == (made.name, made.env, made.res, made.signatures, made.rules)
    text = """library l { env e resolution @1d
      rel r(+A: Equity, @T: Timestamp, -X: Scalar) @1h rel k(-A: Equity, @T: Timestamp, -K: Scalar)
      r(A, T, X) :- close(A, T, P), not split(A, T, _), X = -(P - 2) / (3 - (P - 1)) * log(P + 1), tag(A, T0, "a b") asof T, X >= 0.5.
      k(A, T, K) :- rank(r(A, T, X), by (X desc, A asc), ties average, as K), M = quantile(Y, 0.5) over (U in rows(T, 5, min 2), r(A, U, Y)).
      k(A, T, 1) :- top(3, r(A, T, X), by (X desc)), resample(r(A, U, Q) to @1d as T, min 2, O = first(Q), N = count(U)). }"""
    tree = parse(text)[0]
    again = parse(printer.library(tree))[0]
    assert again.signatures == tree.signatures and again.rules == tree.rules
