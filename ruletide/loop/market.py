"""What the executor sees of the market, bar by bar."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import defaultdict
from datetime import datetime, timezone

DAY = 86_400


def moment(t: int) -> str:
    return datetime.fromtimestamp(t, timezone.utc).strftime("%Y-%m-%d %H:%M:%S" if t % DAY else "%Y-%m-%d")


class Series:
    """One instrument's values by time."""

    def __init__(self):
        self.at: dict[int, float] = {}
        self._times: list[int] | None = None

    def put(self, t: int, v: float) -> None:
        self.at[t] = v
        self._times = None

    def times(self) -> list[int]:
        if self._times is None:
            self._times = sorted(self.at)
        return self._times

    def within(self, lo: int, hi: int) -> list[float]:
        ts = self.times()
        return [self.at[t] for t in ts[bisect_left(ts, lo) : bisect_right(ts, hi)]]


class Market:
    """Prices, opens, highs, lows and volumes at the strategy's bars; finer relations are folded into their bar."""

    def __init__(self, bar_seconds: int, price_seconds: int | None = None, contracts: dict | None = None):
        self.bar, self.price_bar = bar_seconds, price_seconds or bar_seconds
        self.series: dict[str, dict[str, Series]] = {k: defaultdict(Series) for k in ("price", "open", "high", "low", "volume")}
        self.splits: dict[int, list[tuple[str, float]]] = defaultdict(list)
        self.dividends: dict[int, list[tuple[str, int, float]]] = defaultdict(list)  # by ex-date
        self.delisted: dict[int, list[tuple[str, str]]] = defaultdict(list)
        self.contracts = contracts or {}
        self.last: dict[str, float] = {}

    def add(self, field: str, sym: str, t: int, v: float) -> None:
        self.series[field][sym].put(t, v)

    def span(self, t: int) -> tuple[int, int]:
        return (t, t + DAY - 1) if self.bar == DAY else (t - self.bar + 1, t)

    def _field(self, name: str, sym: str, t: int, fold) -> float | None:
        if sym not in self.series[name]:
            return None
        s = self.series[name][sym]
        if self.price_bar == self.bar:
            return s.at.get(t)
        got = s.within(*self.span(t))
        return fold(got) if got else None

    def bar_price(self, sym: str, t: int) -> float | None:
        p = self._field("price", sym, t, lambda v: v[-1])
        if p is not None:
            self.last[sym] = p
        return p

    def price_at(self, sym: str, t: int) -> float | None:
        """The bar's price, else the last one seen."""
        p = self.bar_price(sym, t)
        return self.last.get(sym) if p is None else p

    def open(self, sym, t):
        return self._field("open", sym, t, lambda v: v[0])

    def high(self, sym, t):
        return self._field("high", sym, t, max)

    def low(self, sym, t):
        return self._field("low", sym, t, min)

    def volume(self, sym, t):
        return self._field("volume", sym, t, sum)

    def multiplier(self, sym: str) -> float:
        return self.contracts.get(sym, {}).get("multiplier", 1.0)

    def is_future(self, sym: str) -> bool:
        return bool(self.contracts.get(sym, {}).get("future"))

    def per_contract(self, sym: str) -> float | None:
        return self.contracts.get(sym, {}).get("commission_per_contract")

    def session_last(self, sym: str, t: int) -> int | None:
        """The bar of the last price of the session that t belongs to."""
        if sym not in self.series["price"]:
            return None
        ts = self.series["price"][sym].times()
        i = bisect_right(ts, t // DAY * DAY + DAY - 1)
        if not i or ts[i - 1] < min(self.span(t)[0], t):
            return None
        x = ts[i - 1]
        return x if self.price_bar == self.bar else x // DAY * DAY if self.bar == DAY else -(-x // self.bar) * self.bar

    def adv(self, sym: str, bars: list[int], window: int) -> float | None:
        """Mean bar volume of the last bars; intraday, mean volume of the previous days that have one."""
        n = max(1, window)
        if self.bar == DAY:
            vols = [v for t in bars[-n:] if (v := self.volume(sym, t)) is not None]
            return sum(vols) / len(vols) if vols else None
        today, days = bars[-1] // DAY, {}
        for t in reversed(bars):
            d = t // DAY
            if d == today:
                continue
            if d not in days and len([v for v in days.values() if v is not None]) == n:
                break
            days.setdefault(d, None)
            if (v := self.volume(sym, t)) is not None:
                days[d] = (days[d] or 0.0) + v
        known = [v for v in days.values() if v is not None]
        if known:
            return sum(known) / len(known)
        so_far = sum(v for t in reversed(bars) if t // DAY == today and (v := self.volume(sym, t)) is not None)
        return so_far or None

    def realized_vol(self, sym: str, bars: list[int], window: int, least: int) -> float | None:
        """Sample deviation of the log returns between priced bars of the window."""
        ps = [p for t in bars[-(window + 1) :] if (p := self.bar_price(sym, t)) is not None]
        rets = [math.log(b / a) for a, b in zip(ps, ps[1:]) if a > 0 and b > 0]
        if len(rets) < max(2, least):
            return None
        mean = sum(rets) / len(rets)
        return math.sqrt(sum((r - mean) ** 2 for r in rets) / (len(rets) - 1))
