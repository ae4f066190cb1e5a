"""Settings of the simulated executor."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field, replace


@dataclass(frozen=True)
class BorrowBucket:
    adv_below: float
    fee_bps: float
    shortable: bool = True


@dataclass(frozen=True)
class ExecConfig:
    """Defaults of a cautious account: costs on, no leverage, every breach halts the run."""

    initial_cash: float = 1_000_000.0
    compounding: bool = False
    slippage_bps: float = 0.0
    slippage_vol_mult: float = 0.1
    vol_window: int = 20
    vol_min_obs: int = 10
    commission_per_share: float = 0.005
    commission_bps: float = 0.0
    commission_min_per_order: float = 1.0
    fee_bps_on_sells: float = 0.278
    participation_cap: float = 0.1
    participation_warn: float = 0.05
    impact_coef: float = 0.1
    adv_window: int = 20
    max_gross: float = 1.0
    maintenance_margin: float = 0.25
    cash_rate: float = 0.0
    margin_rate: float = 0.05
    short_rebate: float = 0.0
    borrow: tuple[BorrowBucket, ...] = (BorrowBucket(100_000.0, 0.0, False), BorrowBucket(1_000_000.0, 300.0), BorrowBucket(math.inf, 25.0))
    delisting_haircuts: dict = field(default_factory=lambda: {"bankruptcy": 1.0, "regulatory": 1.0, "acquisition": 0.0, "voluntary": 0.0})
    delisting_haircut_default: float = 1.0
    delist_at_last_price: bool = False
    reinvest_dividends: bool = False
    actions_in_prices: bool = False
    on_leverage: str = "halt"  # halt, reject, allow
    on_margin_call: str = "halt"  # halt, liquidate, allow
    on_oversize: str = "halt"  # halt, clamp, allow
    on_ruin: str = "halt"  # halt, continue
    lot: str = "whole"  # whole, fractional
    start: int | None = None  # epoch seconds; earlier bars only warm up
    end: int | None = None

    def bucket(self, adv: float | None) -> BorrowBucket:
        """The borrow bucket of an average daily volume; unknown volume counts as none."""
        return next((b for b in self.borrow if (adv or 0.0) < b.adv_below), self.borrow[-1])

    def haircut(self, reason: str) -> float:
        cut = 0.0 if self.delist_at_last_price else self.delisting_haircuts.get(reason, self.delisting_haircut_default)
        return min(1.0, max(0.0, cut))

    def lots(self, x: float) -> float:
        return float(math.trunc(x)) if self.lot == "whole" else x

    def warnings(self) -> list[tuple[str, str]]:
        """Models that are switched off, each with the bias it invites."""
        off = [
            (self.commission_per_share == 0 and self.commission_min_per_order == 0 and self.commission_bps == 0, "transaction-cost neglect", "commissions are off"),
            (self.slippage_bps == 0 and self.slippage_vol_mult == 0, "slippage", "slippage is off"),
            (self.impact_coef == 0, "market-impact", "market impact is off"),
            (self.participation_cap == 0, "liquidity", "fills are not capped by volume"),
            (self.on_leverage == "allow", "leverage", "leverage is not checked"),
        ]
        return [(bias, text) for is_off, bias, text in off if is_off]

    def to_dict(self) -> dict:
        return asdict(self)


def frictionless(**changes) -> ExecConfig:
    """No costs, no caps, nothing checked."""
    free = ExecConfig(slippage_vol_mult=0.0, commission_per_share=0.0, commission_min_per_order=0.0, fee_bps_on_sells=0.0, participation_cap=0.0, impact_coef=0.0, margin_rate=0.0, borrow=(BorrowBucket(math.inf, 0.0),), on_leverage="allow", on_margin_call="allow", on_oversize="allow", on_ruin="continue")
    return replace(free, **changes)


def reg_t(**changes) -> ExecConfig:
    """A margin account: twice the equity, calls are liquidated."""
    return replace(ExecConfig(max_gross=2.0, on_leverage="reject", on_margin_call="liquidate"), **changes)
