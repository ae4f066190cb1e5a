"""The simulated executor: orders, sizing, costs, liquidity, margin, funding and corporate actions.

One bar runs fill -> open_bar -> (decide) -> take. Orders of the last bar fill at this one: funding accrues, orders that
reduce a position come first, each is sized, capped by volume, priced with slippage and impact, checked for borrow and
leverage, and booked. Events go to `events` as (kind, time, fields); a breach whose policy is halt raises RiskHalt.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass
from typing import Protocol

from ruletide.loop.config import ExecConfig
from ruletide.loop.market import DAY, Market, moment


class RiskHalt(Exception):
    """A policy of `halt` was breached."""


@dataclass(frozen=True)
class Decision:
    ctor: str
    equity: str
    amount: float
    kind: str = "market"
    price: float | None = None
    tif: str = "day"
    n: int = 0

    @property
    def target(self) -> bool:
        return self.ctor.startswith("target")

    def text(self) -> str:
        return f"{self.ctor}({self.equity}, {self.amount:g}{'' if self.kind == 'market' else ', ' + self.kind})"


@dataclass
class Working:
    d: Decision
    rule: str
    t: int
    first_day: int | None = None
    bars: int = 0


class Executor(Protocol):
    """What a live executor would implement as well."""

    def fill(self, t: int) -> None: ...
    def open_bar(self, t: int) -> None: ...
    def take(self, t: int, decisions: list[tuple[Decision, str]]) -> None: ...
    def finish(self) -> None: ...


class SimExecutor:
    def __init__(self, cfg: ExecConfig, market: Market, reads: set[str] | None = None):
        """reads: the feedback relations whose history is wanted; all by default."""
        self.cfg, self.m = cfg, market
        self.reads = {"position", "cash", "nav", "fill", "decided"} if reads is None else reads
        self.cash, self.pos = cfg.initial_cash, {}
        self.bars: list[int] = []
        self.pending: list[tuple[Decision, str]] | None = None
        self.pending_t = 0
        self.open_targets: dict[str, tuple[Decision, str]] = {}
        self.working: dict[str, Working] = {}
        self.receivables: list[tuple[int, str, float, float, float]] = []
        self.gone: set[str] = set()
        self.events: list[tuple[str, int, dict]] = []
        #: Feedback relations by time: position {t: {sym: q}}, cash {t: c}, nav {t: n}, fill {t: [(sym, q, p)]}.
        self.position_at: dict[int, dict[str, float]] = {}
        self.cash_at: dict[int, float] = {}
        self.nav_at: dict[int, float] = {}
        self.fill_at: dict[int, list[tuple[str, float, float]]] = {}
        self.requested = self.filled = 0.0
        self.participations: list[float] = []
        self.totals = dict.fromkeys(("commissions", "fees", "slippage", "impact", "turnover", "cash_interest", "margin_interest", "borrow_fees", "short_rebate", "margin_calls", "not_shortable"), 0.0)

    # money

    def commission(self, sym: str, qty: float, price: float) -> float:
        c, q = self.cfg, abs(qty)
        bps = c.commission_bps * q * abs(price) * self.m.multiplier(sym) / 10_000
        own = self.m.per_contract(sym)
        if own is not None:
            return own * q + bps
        return bps + (max(c.commission_per_share * q, c.commission_min_per_order) if c.commission_per_share or c.commission_min_per_order else 0.0)

    def sell_fee(self, qty: float, value: float) -> float:
        return abs(value) * self.cfg.fee_bps_on_sells / 10_000 if qty < 0 else 0.0

    def value(self, sym: str, t: int) -> float | None:
        p = self.m.price_at(sym, t)
        return None if p is None else p * self.m.multiplier(sym)

    def mark(self, t: int) -> tuple[float, float]:
        """Gross and net value of the positions that have a price."""
        if self.m.contracts or self.m.price_bar != self.m.bar:
            held = [q * v for s, q in self.pos.items() if (v := self.value(s, t)) is not None]
        else:  # the same, with the look-up of a bar's price in place
            series, last, held = self.m.series["price"], self.m.last, []
            for s, q in self.pos.items():
                p = series[s].at.get(t) if s in series else None
                if p is not None:
                    last[s] = p
                elif (p := last.get(s)) is None:
                    continue
                held.append(q * p)
        return sum(map(abs, held)), sum(held)

    def drop(self, t: int, d: Decision, reason: str) -> None:
        self.events.append(("dropped", t, {"equity": d.equity, "ctor": d.ctor, "amount": d.amount, "reason": reason}))

    def book(self, at: int, bar: int, sym: str, qty: float, price: float, commission: float = 0.0, fee: float = 0.0, slippage: float = 0.0, impact: float = 0.0, participation: float = 0.0, at_last: bool = False, partial: bool = False, forced: bool = False, last: float | None = None) -> None:
        """Take a fill into the book, the feedback and the totals."""
        m = self.m.multiplier(sym)
        self.cash -= qty * price * m + commission + fee
        new = self.pos.get(sym, 0.0) + qty
        if abs(new) < 1e-9:
            self.pos.pop(sym, None)
        else:
            self.pos[sym] = new
        self.m.last[sym] = price if last is None else last
        if "fill" in self.reads:
            self.fill_at.setdefault(bar, []).append((sym, qty, price))
        for k, v in (("commissions", commission), ("fees", fee), ("slippage", slippage), ("impact", impact), ("turnover", abs(qty) * price * m)):
            self.totals[k] += v
        self.events.append(("fill", at, {"equity": sym, "quantity": qty, "price": price, "commission": commission, "fee": fee, "slippage": slippage, "impact": impact, "participation": participation, "at_last_price": at_last, "partial": partial, "forced": forced}))

    def fund(self, t: int, now: int) -> None:
        """Interest and borrow over the calendar time between two bars."""
        dt = (now - t) / (365 * DAY)
        rate, key = (self.cfg.cash_rate, "cash_interest") if self.cash > 0 else (self.cfg.margin_rate, "margin_interest")
        interest = self.cash * rate * dt
        self.cash += interest
        self.totals[key] += abs(interest)
        for sym, q in sorted((s, q) for s, q in self.pos.items() if q < 0):
            v = self.value(sym, now) if not self.m.is_future(sym) else None
            if v is not None:
                notional = -q * v
                fee = notional * self.cfg.bucket(self.m.adv(sym, self.bars, self.cfg.adv_window)).fee_bps / 10_000 * dt
                rebate = notional * self.cfg.short_rebate * dt
                self.cash += rebate - fee
                self.totals["borrow_fees"] += fee
                self.totals["short_rebate"] += rebate

    # orders

    def trigger(self, w: Working, t: int) -> tuple[str, object]:
        """('fill', (price, bar)), ('wait', None) or ('expire', reason) for a working order."""
        d, sym, day = w.d, w.d.equity, t // DAY
        w.first_day = day if w.first_day is None else w.first_day
        if d.kind == "moc":
            last = self.m.session_last(sym, w.t)
            if last is None:
                return "expire", f"{sym} did not trade on the day of {moment(w.t)}, so it has no close"
            if last > t:
                return "wait", None
            p = self.m.bar_price(sym, last)
            return ("fill", (p, last)) if p is not None else ("expire", f"{sym} has no closing print at {moment(last)}")
        if d.kind in ("moo", "moo_moc"):
            o = self.m.open(sym, t)
            if o is not None:
                return "fill", (o, t)
            return ("expire", f"{sym} has no opening print on the day after {moment(w.t)}") if day != w.first_day else ("wait", None)
        if (d.tif == "day" and day != w.first_day) or (d.tif == "bars" and w.bars >= d.n):
            return "expire", f"the {d.kind} level of {sym} was not reached in time"
        w.bars += 1
        o, h, lo = self.m.open(sym, t), self.m.high(sym, t), self.m.low(sym, t)
        if None in (o, h, lo):
            return "wait", None
        pos = self.pos.get(sym, 0.0)
        if d.target:
            base = max(self.cash, 0.0) if self.cfg.compounding else self.cfg.initial_cash
            buying = d.amount > pos if d.ctor == "target_quantity" else d.amount * base > pos * o * self.m.multiplier(sym)
        else:
            buying = d.ctor in ("buy", "cover")
        falls = (d.kind == "limit") == buying  # executes when the price comes down to the level
        if (o <= d.price) if falls else (o >= d.price):
            return "fill", (o, t)
        if (lo <= d.price) if falls else (h >= d.price):
            return "fill", (d.price, t)
        return "wait", None

    def due(self, t: int) -> list[tuple[Decision, str, bool, tuple | None]]:
        """Orders that may fill now: new market orders, open targets re-issued, triggered working orders."""
        new = sorted(self.pending or [], key=lambda x: x[0].equity)
        for d, _ in new:
            self.open_targets.pop(d.equity, None)
            self.working.pop(d.equity, None)
        out = [(d, r, False, None) for d, r in new if d.kind == "market"]
        for d, r in new:
            if d.kind != "market":
                self.working[d.equity] = Working(d, r, self.pending_t)
        out += [(d, r, True, None) for _, (d, r) in sorted(self.open_targets.items())]
        for sym in sorted(self.working):
            w = self.working[sym]
            what, x = self.trigger(w, t)
            if what != "wait":
                del self.working[sym]
            if what == "fill":
                out.append((w.d, w.rule, False, x))
            elif what == "expire":
                self.drop(w.t, w.d, x)
        return out

    def reduces_first(self, d: Decision, base: float, t: int) -> bool:
        pos = self.pos.get(d.equity, 0.0)
        if not pos or d.ctor in ("buy", "short"):
            return False
        if d.ctor == "target_quantity":
            return abs(d.amount) < abs(pos) and d.amount * pos >= 0
        if d.ctor == "target_weight":
            return d.amount == 0 or d.amount * pos < 0 or abs(d.amount) * base < abs(pos) * (self.value(d.equity, t) or 0.0)
        return True

    def size(self, d: Decision, pos: float, base: float, price: float | None, slip: float) -> float | None:
        """Signed quantity; None if a weight cannot be sized."""
        lots, m = self.cfg.lots, self.m.multiplier(d.equity)
        if d.ctor in ("buy", "cover"):
            return lots(d.amount)
        if d.ctor in ("sell", "short"):
            return -lots(d.amount)
        if d.ctor == "target_quantity":
            return lots(d.amount) - pos
        if price is None:
            return -pos if d.amount == 0 else None
        target = lots(d.amount * base / (price * m))
        if target > pos and target > 0:  # a bought long is sized at the price it will pay
            target = lots(d.amount * base / (price * (1 + slip) * m))
        return target - pos

    def fill(self, t: int) -> None:
        if self.pending is None:
            return
        before, history = self.pending_t, self.bars
        self.bars = history if history and history[-1] == t else [*history, t]
        try:
            self.fund(before, t)
            # nobody asks for the worth of an account that neither compounds nor is ever ruined
            equity = self.cash + self.mark(t)[1] if self.cfg.compounding or self.cfg.on_ruin == "halt" else math.inf
            orders = self.due(t)
            base = max(equity, 0.0) if self.cfg.compounding else self.cfg.initial_cash
            orders.sort(key=lambda o: not self.reduces_first(o[0], base, t))
            if orders and equity <= 0 and self.cfg.on_ruin == "halt":
                raise RiskHalt(f"account wiped out by {moment(t)} (worth {equity:.2f}); first order that cannot be carried: {orders[0][0].text()} of {moment(before)}")
            costs, exits = 0.0, []
            for order in orders:
                costs += self.execute(*order, before, t, base, costs, exits)
            for sym, at, rule in exits:
                self.day_exit(sym, at, rule, t)
        finally:
            self.bars, self.pending = history, None
        self.note(t)

    def note(self, t: int) -> None:
        """The book at t, for rules that read it."""
        if "position" in self.reads:
            self.position_at[t] = dict(self.pos)
        if "cash" in self.reads:
            self.cash_at[t] = self.cash

    def execute(self, d: Decision, rule: str, again: bool, away: tuple | None, t: int, now: int, base: float, spent: float, exits: list) -> float:
        """Fill one order as far as it goes; returns its transaction costs."""
        c, sym, m = self.cfg, d.equity, self.m.multiplier(d.equity)
        pos = self.pos.get(sym, 0.0)
        price, at = (away[0], away[1]) if away else (self.m.bar_price(sym, now), now)
        vol = self.m.realized_vol(sym, self.bars, c.vol_window, c.vol_min_obs) if c.slippage_vol_mult else None
        slip = c.slippage_bps / 10_000 + c.slippage_vol_mult * (vol or 0.0)
        resting = d.target and d.kind == "market"
        qty = self.size(d, pos, base, price, slip)
        if qty is None:
            self.open_targets.pop(sym, None)
            self.drop(t, d, f"{sym} has no quote at {moment(now)}")
            return 0.0
        if qty == 0:
            self.open_targets.pop(sym, None)
            return 0.0
        if d.ctor in ("sell", "cover") and pos and (pos + qty) * pos < 0:
            if c.on_oversize == "halt":
                raise RiskHalt(f"{d.text()} of {moment(t)} flips a position of {pos:g} shares")
            if c.on_oversize == "clamp":
                self.drop(t, d, f"cut to the position of {abs(pos):g} shares; {abs(qty) - abs(pos):g} more were asked for")
                qty = -pos
        wanted = abs(qty)
        if not again:
            self.requested += wanted
        volume, partial = self.m.volume(sym, at), False
        if c.participation_cap > 0 and volume is not None:
            cap = c.lots(c.participation_cap * volume)
            if wanted > cap:
                partial, qty = True, math.copysign(cap, qty)
        note = lambda got: f"volume {volume or 0:g} lets {got:g} of {wanted:g} shares through ({c.participation_cap:.4g} of it); the rest lapses"
        if qty == 0:
            if resting:
                self.open_targets[sym] = (d, rule)
            else:
                self.drop(t, d, note(0))
            return 0.0
        reduces = pos != 0 and (pos + qty) * pos >= 0 and abs(pos + qty) < abs(pos)
        at_last = price is None
        if at_last:
            price = self.m.last.get(sym) if reduces else None
            if price is None:
                self.open_targets.pop(sym, None)
                self.drop(t, d, f"{sym} has no quote at {moment(now)}")
                return 0.0
        adv = self.m.adv(sym, self.bars, c.adv_window)
        imp = c.impact_coef * math.sqrt(abs(qty) / adv) if c.impact_coef > 0 and adv else 0.0
        paid = price * (1 + math.copysign(slip + imp, qty))
        commission = self.commission(sym, qty, paid)
        fee = self.sell_fee(qty, qty * paid * m)
        slippage, impact = abs(qty) * price * m * slip, abs(qty) * price * m * imp
        costs = commission + fee + slippage + impact
        if pos + qty < min(0.0, pos) and not self.m.is_future(sym):
            bucket = c.bucket(adv)
            if not bucket.shortable:
                self.totals["not_shortable"] += 1
                self.open_targets.pop(sym, None)
                self.drop(t, d, f"no stock of {sym} to borrow: it trades {'an unknown amount' if adv is None else format(adv, '.0f')} a day, under {bucket.adv_below:g}")
                return 0.0
        if not reduces and self.over_levered(d, t, now, sym, qty, price, qty * paid * m + commission + fee, spent + costs):
            return 0.0
        participation = abs(qty) / volume if volume else 0.0
        self.book(at, now, sym, qty, paid, commission, fee, slippage, impact, participation, at_last, partial)
        self.filled += abs(qty)
        if volume is not None:
            self.participations.append(participation)
        if d.kind == "moo_moc":
            exits.append((sym, at, rule))
        if partial:
            if resting:
                self.open_targets[sym] = (d, rule)
            else:
                self.drop(t, d, note(abs(qty)))
        elif d.target:
            self.open_targets.pop(sym, None)
        return costs

    def over_levered(self, d: Decision, t: int, now: int, sym: str, qty: float, price: float, cost: float, allowance: float) -> bool:
        """Whether the fill is rejected: after it, gross may exceed the limit by the bar's own costs only."""
        c, cash = self.cfg, self.cash - cost
        if c.on_leverage == "allow":
            return False
        after = {**self.pos, sym: self.pos.get(sym, 0.0) + qty}
        values = [q * (price if s == sym else self.m.price_at(s, now) or 0.0) * self.m.multiplier(s) for s, q in after.items()]
        gross, net = sum(map(abs, values)), cash + sum(values)
        limit = max(1.0, c.max_gross)
        slack = 1e-9 * (1 + abs(net)) + allowance
        if c.compounding:
            breach = cash < -(limit - 1) * max(net, 0.0) - slack or gross > limit * net + slack
        else:
            breach = gross > limit * c.initial_cash + slack
        if breach and c.on_leverage == "halt":
            raise RiskHalt(f"{d.text()} of {moment(t)} breaks the gross limit of {limit:g}: exposure {gross:.2f}, cash {cash:.2f}, worth {net:.2f}")
        if breach and c.on_leverage == "reject":
            self.drop(t, d, f"refused at the gross limit of {limit:g}: exposure {gross:.2f}, cash {cash:.2f}, worth {net:.2f}")
            return True
        return False

    def day_exit(self, sym: str, at: int, rule: str, now: int) -> None:
        """A moo_moc entry leaves at its session's close: at once if that is this bar, else as a working order."""
        p = self.m.bar_price(sym, now)
        if self.m.session_last(sym, at) == now and sym in self.pos and p is not None:
            qty = -self.pos[sym]
            self.book(now, now, sym, qty, p, self.commission(sym, qty, p))
        else:
            self.working[sym] = Working(Decision("target_quantity", sym, 0.0, "moc"), rule, at)

    # the bar

    def actions(self, t: int) -> bool:
        """Splits, dividends and delistings at t; whether the book has changed."""
        c, changed = self.cfg, False
        log = lambda sym, action, detail, cash: self.events.append(("action", t, {"equity": sym, "action": action, "detail": detail, "cash": cash}))
        for sym, factor in [] if c.actions_in_prices else self.m.splits.get(t, []):
            if sym not in self.pos or factor <= 0 or factor == 1:
                continue
            exact = self.pos[sym] * factor
            kept = c.lots(exact)
            cash = (exact - kept) * (self.value(sym, t) or 0.0)
            self.cash += cash
            if abs(kept) < 1e-9:
                del self.pos[sym]
            else:
                self.pos[sym] = kept
            if sym in self.m.last:
                self.m.last[sym] /= factor
            log(sym, "split", f"{factor:g}", cash)
            changed = True
        for sym, pay, amount in [] if c.actions_in_prices else self.m.dividends.get(t, []):
            if sym not in self.pos:
                continue
            shares = self.pos[sym]
            if not c.reinvest_dividends:
                self.receivables.append((max(pay, t), sym, shares * amount, amount, shares))
            elif (p := self.m.price_at(sym, t)) and p > 0:
                self.pos[sym] = shares + shares * amount / p
                log(sym, "reinvest", f"{amount:g} on {shares:g}", 0.0)
                changed = True
        for due in [r for r in self.receivables if r[0] <= t]:
            self.receivables.remove(due)
            self.cash += due[2]
            log(due[1], "dividend", f"{due[3]:g} on {due[4]:g}", due[2])
            changed = True
        for sym, reason in self.m.delisted.get(t, []):
            if sym in self.gone:
                continue
            self.gone.add(sym)
            if sym in self.pos:
                cut = c.haircut(reason)
                last = self.m.price_at(sym, t) or 0.0
                qty, price = -self.pos[sym], last * (1 - cut)
                commission = 0.0 if c.delist_at_last_price else self.commission(sym, qty, price)
                before = self.cash
                self.book(t, t, sym, qty, price, commission, at_last=True, forced=True, last=last)
                log(sym, "delisting", f"{reason} {cut:g}", self.cash - before)
                changed = True
        return changed

    def open_bar(self, t: int) -> None:
        if not self.bars and "cash" in self.reads:
            self.cash_at[t] = self.cash
        self.bars.append(t)
        if self.actions(t):
            self.note(t)
        gross, net = self.mark(t)
        equity = self.cash + net
        need = self.cfg.maintenance_margin * gross
        if gross > 0 and 0 < equity < need - 1e-9 * gross:
            if self.cfg.on_margin_call == "halt":
                raise RiskHalt(f"maintenance missed at {moment(t)}: {equity:.2f} of capital carries {gross:.2f}, less than a share of {self.cfg.maintenance_margin:g}")
            self.totals["margin_calls"] += 1
            if self.cfg.on_margin_call == "liquidate":
                self.liquidate(t, 1 - equity / need)
                gross, net = self.mark(t)
                equity = self.cash + net
                self.note(t)
        if "nav" in self.reads:
            self.nav_at[t] = equity
        self.events.append(("nav", t, {"equity_value": equity, "cash": self.cash, "gross": gross, "net": net, "leverage": gross / equity if equity > 0 else 0.0}))

    def liquidate(self, t: int, share: float) -> None:
        """Sell the same share of every position at the bar's price."""
        for sym, pos in sorted(self.pos.items()):
            p = self.m.price_at(sym, t)
            if p is None:
                continue
            qty = -pos * share
            if self.cfg.lot == "whole":
                qty = math.floor(qty) if qty < 0 else math.ceil(qty)
            qty = -pos if qty == 0 or abs(qty) > abs(pos) else float(qty)
            v = self.m.volume(sym, t)
            self.book(t, t, sym, qty, p, self.commission(sym, qty, p), self.sell_fee(qty, qty * p * self.m.multiplier(sym)), participation=abs(qty) / v if v else 0.0, forced=True)

    def take(self, t: int, decisions: list[tuple[Decision, str]]) -> None:
        self.pending, self.pending_t = list(decisions), t

    def finish(self) -> None:
        for d, _ in sorted(self.pending or [], key=lambda x: x[0].equity):
            self.drop(self.pending_t, d, "the data ended first")
        self.pending = None
        last = self.bars[-1] if self.bars else None
        if last is not None and any(w.d.kind == "moc" and (x := self.m.session_last(s, w.t)) is not None and x <= last for s, w in self.working.items()):
            self.take(last, [])
            self.fill(last + 1)  # settle what has closed; nothing else trades there
        for w in self.working.values():
            self.drop(w.t, w.d, f"the {w.d.kind} order was open when the data ended")
        self.working = {}

    def summary(self) -> dict:
        p = self.participations
        return {
            **self.totals,
            "final_cash": self.cash,
            "final_positions": dict(sorted(self.pos.items())),
            "fill_ratio": self.filled / self.requested if self.requested else 1.0,
            "avg_participation": sum(p) / len(p) if p else 0.0,
            "max_participation": max(p, default=0.0),
            "fills_above_warning": sum(x > self.cfg.participation_warn for x in p),
        }

    # checkpoint

    def state(self) -> dict:
        return {"cash": self.cash, "pos": self.pos, "bars": self.bars, "pending": [(asdict(d), r) for d, r in self.pending] if self.pending is not None else None, "pending_t": self.pending_t, "open_targets": {k: (asdict(d), r) for k, (d, r) in self.open_targets.items()}, "working": {k: {**asdict(w), "d": asdict(w.d)} for k, w in self.working.items()}, "receivables": self.receivables, "gone": sorted(self.gone), "last": self.m.last, "position_at": list(self.position_at.items()), "cash_at": list(self.cash_at.items()), "nav_at": list(self.nav_at.items()), "fill_at": list(self.fill_at.items()), "requested": self.requested, "filled": self.filled, "participations": self.participations, "totals": self.totals}

    def restore(self, s: dict) -> None:
        d = lambda x: Decision(**x)
        self.cash, self.pos, self.bars, self.pending_t = s["cash"], dict(s["pos"]), list(s["bars"]), s["pending_t"]
        self.pending = [(d(x), r) for x, r in s["pending"]] if s["pending"] is not None else None
        self.open_targets = {k: (d(x), r) for k, (x, r) in s["open_targets"].items()}
        self.working = {k: Working(**{**w, "d": d(w["d"])}) for k, w in s["working"].items()}
        self.receivables, self.gone = [tuple(r) for r in s["receivables"]], set(s["gone"])
        self.m.last = dict(s["last"])
        for k in ("position_at", "cash_at", "nav_at", "fill_at"):
            setattr(self, k, {int(t): v for t, v in s[k]})
        self.fill_at = {t: [tuple(x) for x in v] for t, v in self.fill_at.items()}
        self.requested, self.filled, self.participations, self.totals = s["requested"], s["filled"], s["participations"], s["totals"]

