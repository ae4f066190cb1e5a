"""The executor on tiny markets, with outcomes computed by hand."""

from __future__ import annotations

import json
import math

import pytest

from ruletide.loop.config import BorrowBucket, ExecConfig, frictionless, reg_t
from ruletide.loop.executor import Decision, RiskHalt, SimExecutor
from ruletide.loop.market import DAY, Market

D0 = 19_730 * DAY  # a Monday


def market(closes, volumes=1000.0, ohlc=None, days=None):
    m = Market(DAY)
    rows = closes if isinstance(closes, dict) else {"X": closes}
    for sym, ps in rows.items():
        for i, p in enumerate(ps):
            if p is not None:
                m.add("price", sym, D0 + i * DAY, p)
                if volumes is not None:
                    m.add("volume", sym, D0 + i * DAY, volumes)
    for i, (o, h, lo, c) in enumerate(ohlc or []):
        for f, v in zip(("open", "high", "low", "price"), (o, h, lo, c)):
            m.add(f, "X", D0 + i * DAY, v)
        m.add("volume", "X", D0 + i * DAY, 1e6)
    return m


def play(m, plan, cfg, bars):
    """plan: {bar index: [Decision]}"""
    x = SimExecutor(cfg, m)
    for i in range(bars):
        t = D0 + i * DAY
        if i:
            x.fill(t)
        x.open_bar(t)
        x.take(t, [(d, "r") for d in plan.get(i, [])])
    x.finish()
    return x


def of(x, kind):
    return [(int((t - D0) / DAY), f) for k, t, f in x.events if k == kind]


def fills(x):
    return [(i, f["quantity"], round(f["price"], 6)) for i, f in of(x, "fill")]


def test_market_orders_fill_at_the_next_close():
    x = play(market([10, 11, 10, 12, 13]), {0: [Decision("buy", "X", 50)], 2: [Decision("sell", "X", 50)], 4: [Decision("buy", "X", 1)]}, frictionless(), 5)
    assert fills(x) == [(1, 50, 11), (3, -50, 12)]
    assert x.cash == 1_000_050 and of(x, "dropped")[0][1]["reason"] == "the data ended first"
    assert [f["equity_value"] for _, f in of(x, "nav")] == [1e6, 1e6, 1e6 - 50, 1e6 + 50, 1e6 + 50]


def test_costs():
    cfg = frictionless(commission_per_share=0.01, commission_min_per_order=2.0, fee_bps_on_sells=10, slippage_bps=100, commission_bps=5)
    x = play(market([10, 10, 10, 10]), {0: [Decision("buy", "X", 100)], 1: [Decision("sell", "X", 100)]}, cfg, 4)
    (_, b), (_, s) = of(x, "fill")
    assert math.isclose(b["price"], 10.1) and math.isclose(b["commission"], 2 + 1010 * 5e-4) and b["fee"] == 0 and math.isclose(b["slippage"], 10)
    assert math.isclose(s["price"], 9.9) and math.isclose(s["commission"], 2 + 990 * 5e-4) and math.isclose(s["fee"], 0.99)


def test_impact_and_participation():
    x = play(market([10, 10, 10, 10]), {0: [Decision("buy", "X", 400)]}, frictionless(impact_coef=0.1, participation_cap=0.25), 4)
    assert fills(x) == [(1, 250, round(10 * (1 + 0.1 * math.sqrt(0.25)), 6))]
    assert "250 of 400 shares" in of(x, "dropped")[0][1]["reason"]
    x = play(market([10, 10, 10, 10]), {0: [Decision("target_quantity", "X", 400)]}, frictionless(participation_cap=0.25), 4)
    assert fills(x) == [(1, 250, 10), (2, 150, 10)] and not of(x, "dropped")
    assert x.summary()["fill_ratio"] == 1.0 and x.summary()["max_participation"] == 0.25


def test_slippage_follows_realized_volatility():
    closes = [10.0, 11.0] * 8
    x = play(market(closes, 1e6), {12: [Decision("buy", "X", 1)]}, frictionless(slippage_vol_mult=0.1), 16)
    r = [math.log(b / a) for a, b in zip(closes[:14], closes[1:14])]
    mean = sum(r) / len(r)
    vol = math.sqrt(sum((v - mean) ** 2 for v in r) / (len(r) - 1))
    assert fills(x) == [(13, 1, round(11 * (1 + 0.1 * vol), 6))]


def test_target_weights():
    x = play(market({"X": [10, 10, 20, 20], "Y": [5, 5, 5, 5]}, 1e9), {0: [Decision("target_weight", "X", 0.5), Decision("target_weight", "Y", 0.5)], 2: [Decision("target_weight", "X", 0.0), Decision("target_weight", "Y", 1.0)]}, frictionless(on_leverage="halt"), 4)
    assert fills(x)[:2] == [(1, 50_000, 10), (1, 100_000, 5)]
    assert fills(x)[2:] == [(3, -50_000, 20), (3, 100_000, 5)]  # the sale comes first and pays
    lots = play(market([7, 7, 7], 1e9), {0: [Decision("target_weight", "X", 0.5)]}, frictionless(), 3)
    assert fills(lots) == [(1, 71_428, 7)]
    part = play(market([7, 7, 7], 1e9), {0: [Decision("target_weight", "X", 0.5)]}, frictionless(lot="fractional"), 3)
    assert math.isclose(fills(part)[0][1], 500_000 / 7)
    grown = play(market([10, 10, 20, 20], 1e9), {0: [Decision("target_weight", "X", 1.0)], 2: [Decision("target_weight", "X", 1.0)]}, frictionless(compounding=True), 4)
    assert fills(grown) == [(1, 100_000, 10)]


def test_bought_weight_is_sized_at_the_slipped_price():
    x = play(market([10, 10, 10], 1e9), {0: [Decision("target_weight", "X", 1.0)]}, frictionless(slippage_bps=100, on_leverage="halt"), 3)
    assert fills(x) == [(1, math.trunc(1e6 / 10.1), 10.1)]


@pytest.mark.parametrize("policy,reason", [("halt", "flips a position"), ("clamp", "cut to the position"), ("allow", None)])
def test_oversize(policy, reason):
    plan = {0: [Decision("buy", "X", 10)], 1: [Decision("sell", "X", 15)]}
    if policy == "halt":
        with pytest.raises(RiskHalt, match=reason):
            play(market([10, 10, 10, 10]), plan, frictionless(on_oversize=policy), 4)
        return
    x = play(market([10, 10, 10, 10]), plan, frictionless(on_oversize=policy), 4)
    assert fills(x)[1][1] == (-10 if policy == "clamp" else -15)
    assert (reason in of(x, "dropped")[0][1]["reason"]) if reason else not of(x, "dropped")


def test_leverage():
    plan = {0: [Decision("buy", "X", 150_000)]}
    with pytest.raises(RiskHalt, match="gross limit"):
        play(market([10, 10, 10], 1e9), plan, frictionless(on_leverage="halt"), 3)
    x = play(market([10, 10, 10], 1e9), plan, frictionless(on_leverage="reject"), 3)
    assert not fills(x) and "refused" in of(x, "dropped")[0][1]["reason"]
    assert fills(play(market([10, 10, 10], 1e9), plan, reg_t(**{k: v for k, v in vars(frictionless()).items() if k not in ("max_gross", "on_leverage", "on_margin_call")}), 3)) == [(1, 150_000, 10)]
    costs = play(market([10, 10, 10], 1e9), {0: [Decision("target_weight", "X", 1.0)]}, frictionless(commission_per_share=0.01, on_leverage="halt"), 3)
    assert fills(costs) == [(1, 100_000, 10)] and costs.cash == -1000  # costs alone are not leverage


def test_margin_call_and_ruin():
    plan = {0: [Decision("buy", "X", 190_000)]}
    closes = [10, 10, 5.7, 5.7, 5.7]
    with pytest.raises(RiskHalt, match="maintenance missed"):
        play(market(closes, 1e9), plan, frictionless(on_margin_call="halt"), 5)
    x = play(market(closes, 1e9), plan, frictionless(on_margin_call="liquidate"), 5)
    i, qty, p = fills(x)[1]
    equity, gross = 1e6 - 190_000 * 4.3, 190_000 * 5.7
    assert (i, p) == (2, 5.7) and qty == math.floor(-190_000 * (1 - equity / (0.25 * gross))) and of(x, "fill")[1][1]["forced"]
    ruined = {0: [Decision("buy", "X", 190_000)], 2: [Decision("buy", "X", 1)]}
    with pytest.raises(RiskHalt, match="wiped out"):
        play(market([10, 10, 4, 4, 4], 1e9), ruined, frictionless(on_ruin="halt"), 5)


def test_funding_and_borrow():
    day = 1 / 365
    x = play(market([10, 10, 10]), {0: []}, frictionless(cash_rate=0.1), 3)
    assert math.isclose(x.cash, 1e6 * (1 + 0.1 * day) ** 2)
    cfg = frictionless(borrow=(BorrowBucket(500, 0, False), BorrowBucket(math.inf, 365.0)), short_rebate=0.01)
    x = play(market([10, 10, 10, 10]), {0: [Decision("short", "X", 100)]}, cfg, 4)
    assert fills(x) == [(1, -100, 10)]
    assert math.isclose(x.totals["borrow_fees"], 2 * 1000 * 0.0365 * day) and math.isclose(x.totals["short_rebate"], 2 * 1000 * 0.01 * day)
    x = play(market([10, 10, 10], 100.0), {0: [Decision("short", "X", 10)]}, cfg, 3)
    assert not fills(x) and "to borrow" in of(x, "dropped")[0][1]["reason"]


BARS = [(10, 11, 9, 10), (10, 12, 10, 11), (13, 14, 12, 13), (9, 10, 8, 9), (9, 9, 9, 9)]


@pytest.mark.parametrize(
    "d,want",
    [
        (Decision("buy", "X", 1, "limit", 10.5, "gtc"), (1, 10)),
        (Decision("buy", "X", 1, "limit", 9.5, "gtc"), (3, 9)),
        (Decision("buy", "X", 1, "limit", 8.5, "gtc"), (3, 8.5)),
        (Decision("buy", "X", 1, "limit", 8.5, "bars", 2), None),
        (Decision("buy", "X", 1, "stop", 11.5, "gtc"), (1, 11.5)),
        (Decision("buy", "X", 1, "stop", 12.5, "gtc"), (2, 13)),
        (Decision("short", "X", 1, "limit", 12.5, "gtc"), (2, 13)),
        (Decision("short", "X", 1, "stop", 9.5, "gtc"), (3, 9)),
        (Decision("short", "X", 1, "stop", 8.5, "day"), None),
        (Decision("buy", "X", 1, "moo"), (1, 10)),
        (Decision("buy", "X", 1, "moc"), (0, 10)),
    ],
)
def test_order_types(d, want):
    x = play(market([], ohlc=BARS), {0: [d]}, frictionless(), 5)
    got = fills(x)
    assert (got[0][0], got[0][2]) == want if want else not got and "not reached in time" in of(x, "dropped")[0][1]["reason"]


def test_open_to_close_orders_are_flat_at_the_close():
    x = play(market([], ohlc=BARS), {0: [Decision("buy", "X", 5, "moo_moc")]}, frictionless(), 5)
    assert fills(x) == [(1, 5, 10), (1, -5, 11)] and x.pos == {}


def test_a_new_decision_supersedes_a_working_order():
    x = play(market([], ohlc=BARS), {0: [Decision("buy", "X", 5, "limit", 8.5, "gtc")], 1: [Decision("buy", "X", 2)]}, frictionless(), 5)
    assert fills(x) == [(2, 2, 13)]


def test_split_dividend_delisting():
    m = market([10, 10, 5, 5, 5, 5])
    m.splits[D0 + 2 * DAY].append(("X", 2.0))
    m.dividends[D0 + 3 * DAY].append(("X", D0 + 4 * DAY, 0.5))
    m.delisted[D0 + 5 * DAY].append(("X", "bankruptcy"))
    x = play(m, {0: [Decision("buy", "X", 33)]}, frictionless(), 6)
    kinds = [(i, f["action"], round(f["cash"], 2)) for i, f in of(x, "action")]
    assert kinds == [(2, "split", 0.0), (4, "dividend", 33.0), (5, "delisting", 0.0)]
    assert fills(x)[-1] == (5, -66, 0) and x.pos == {} and math.isclose(x.cash, 1e6 - 330 + 33)
    for reason, cfg, price in (("acquisition", frictionless(), 5), ("unheard", frictionless(), 0), ("bankruptcy", frictionless(delist_at_last_price=True), 5)):
        m = market([5, 5, 5])
        m.delisted[D0 + 2 * DAY].append(("X", reason))
        assert fills(play(m, {0: [Decision("buy", "X", 10)]}, cfg, 3))[-1] == (2, -10, price)


def test_fractional_split_pays_cash_and_reinvestment_buys():
    m = market([10, 10, 6, 6])
    m.splits[D0 + 2 * DAY].append(("X", 1.5))
    x = play(m, {0: [Decision("buy", "X", 5)]}, frictionless(), 4)
    assert x.pos == {"X": 7.0} and of(x, "action")[0][1]["cash"] == 3.0
    m = market([10, 10, 10])
    m.dividends[D0 + 2 * DAY].append(("X", D0 + 2 * DAY, 1.0))
    assert play(m, {0: [Decision("buy", "X", 10)]}, frictionless(reinvest_dividends=True), 3).pos == {"X": 11.0}
    m = market([10, 10, 10])
    m.splits[D0 + 2 * DAY].append(("X", 2.0))
    assert play(m, {0: [Decision("buy", "X", 10)]}, frictionless(actions_in_prices=True), 3).pos == {"X": 10.0}


def test_contracts():
    m = market([10, 10, 12, 12])
    m.contracts["X"] = {"multiplier": 50.0, "future": True, "commission_per_contract": 2.5}
    x = play(m, {0: [Decision("short", "X", 2)], 1: [Decision("cover", "X", 2)]}, frictionless(borrow=(BorrowBucket(math.inf, 9999, False),)), 4)
    assert fills(x) == [(1, -2, 10), (2, 2, 12)] and x.cash == 1e6 - 200 - 10 and x.totals["borrow_fees"] == 0


def test_liquidation_without_a_price_uses_the_last_one():
    x = play(market([10, 10, None, 10]), {0: [Decision("buy", "X", 5)], 1: [Decision("sell", "X", 5)]}, frictionless(), 4)
    assert fills(x) == [(1, 5, 10), (2, -5, 10)] and of(x, "fill")[1][1]["at_last_price"]
    x = play(market([10, None, 10]), {0: [Decision("buy", "X", 5)]}, frictionless(), 3)
    assert not fills(x) and "no quote" in of(x, "dropped")[0][1]["reason"]


def test_checkpoint_round_trip():
    m = market([], ohlc=BARS)
    x = SimExecutor(frictionless(), m)
    for i in range(3):
        t = D0 + i * DAY
        if i:
            x.fill(t)
        x.open_bar(t)
        x.take(t, [(Decision("buy", "X", 3, "limit", 8.5, "gtc"), "r")] if i == 0 else [])
    y = SimExecutor(frictionless(), m)
    y.restore(json.loads(json.dumps(x.state())))
    for z in (x, y):
        z.events.clear()
        for i in (3, 4):
            z.fill(D0 + i * DAY)
            z.open_bar(D0 + i * DAY)
            z.take(D0 + i * DAY, [])
        z.finish()
    assert x.events == y.events and fills(x) == [(3, 3, 8.5)]


def test_config():
    c = ExecConfig()
    assert c.bucket(None).shortable is False and c.bucket(5e5).fee_bps == 300 and c.bucket(1e9).fee_bps == 25
    assert {b for b, _ in frictionless().warnings()} >= {"slippage", "liquidity", "leverage"} and not c.warnings()


def test_intraday_adv_means_previous_days():
    m = Market(60)
    for d in range(3):
        for k in range(4):
            m.add("volume", "X", D0 + d * DAY + 34_260 + k * 60, 10.0 * (d + 1))
    bars = sorted(m.series["volume"]["X"].at)
    assert m.adv("X", bars, 20) == (40 + 80) / 2
    assert m.adv("X", bars[:3], 20) == 30
