"""The single-symbol machine: strategies vote on a feature row, a combiner decides, exits go first, a risk gate sizes.

Every part is a plain function of a row and some numbers, so that the ordered batch fold and the stream run the same steps.
"""

from __future__ import annotations

import math
from collections import namedtuple
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .features import FEATURES


class Signal(NamedTuple):
    side: str
    score: float
    reason: str


#: Default limits of strategies, combiner, exits and risk gate.
LIMITS = {
    "reversion_buy_z": -2.2, "reversion_sell_z": 2.0, "reversion_volume": 1.2, "reversion_score": 0.5, "reversion_trend": True, "reversion_percentile": None,
    "momentum_adx": 20.0, "momentum_volume": 0.8, "momentum_score": 0.3, "momentum_directional": True,
    "vwap_buy_z": -2.0, "vwap_sell_z": 1.5, "vwap_volume": 1.0, "vwap_score": 0.3, "vwap_skip": 30,
    "breakout_volume": 1.2, "breakout_stop": 3.0, "breakout_score": 0.3, "breakout_squeeze": True,
    "net": 0.2, "voters": 1, "sell_voters": 2, "cusum_gate": False, "change": 0.3, "blocked_hours": (),
    "stop": 2.5, "stop_share": 0.0, "take": 0.0, "longest": 100, "least": 0,
    "notional": 10_000.0, "daily_loss": 500.0, "reward": 3.0, "cost": 0.001, "kelly": False, "smallest": 0.05, "largest": 0.80, "prior_wins": 12.0, "prior_losses": 8.0,
    "deleverage": True, "deleverage_power": 2.0, "fractional_price": 1000.0, "most_shares": 100.0,
}
#: Default weights of the strategies, their multipliers by regime, and the Kelly share by regime.
WEIGHTS = {"mean_reversion": 0.5, "momentum": 0.5, "vwap_reversion": 0.0, "breakout": 0.0}
REGIMES = ("low_vol", "normal", "high_vol", "crisis")
MULTIPLIERS = {"mean_reversion": (1.5, 1.0, 0.2, 0.0), "momentum": (0.3, 1.0, 1.5, 0.5), "vwap_reversion": (1.3, 1.0, 0.5, 0.0), "breakout": (0.5, 1.0, 1.2, 0.3)}
KELLY = (0.6, 0.5, 0.25, 0.10)


def _unit(x: float) -> float:
    return min(1.0, max(0.0, x))


def mean_reversion(f, holds: bool, c: dict) -> Signal | None:
    """Buys a fall in an uptrend on volume, sells a holding on a rise; with a percentile limit, the lowest z of its past buys."""
    if not f.warmed_up:
        return None
    z, adaptive = f.return_z_score, c["reversion_percentile"] is not None
    low = f.z_score_percentile < c["reversion_percentile"] and z < 0 if adaptive else z < c["reversion_buy_z"]
    if low and f.relative_volume > c["reversion_volume"] and not holds and (f.trend_up or not c["reversion_trend"]):
        score = 0.6 * abs(z if adaptive else c["reversion_buy_z"] - z) + 0.4 * (f.relative_volume - 1)
        if score >= c["reversion_score"]:
            return Signal("buy", score, "mean_reversion_buy")
    rise = z - c["reversion_sell_z"]
    if holds and rise > 0 and rise >= c["reversion_score"]:
        return Signal("sell", rise, "mean_reversion_sell")
    return None


def momentum(f, holds: bool, c: dict) -> Signal | None:
    """Buys a strong rising trend, sells a holding once the fast mean is not above the slow one."""
    if not f.warmed_up:
        return None
    apart = f.ema_fast - f.ema_slow
    if holds:
        return None if f.ema_fast_above_slow else Signal("sell", _unit(-apart / f.atr / 2) if f.atr > 1e-10 else 0.5, "momentum_sell")
    rising = f.ema_fast_above_slow and not math.isnan(f.adx) and f.adx >= c["momentum_adx"] and (f.plus_di > f.minus_di or not c["momentum_directional"])
    if not rising or f.relative_volume < c["momentum_volume"]:
        return None
    score = 0.5 * _unit((f.adx - c["momentum_adx"]) / 40) + 0.3 * (_unit(apart / f.atr / 2) if f.atr > 1e-10 else 0.0) + 0.2 * _unit((f.relative_volume - 1) / 2)
    return Signal("buy", score, "momentum_buy") if score >= c["momentum_score"] else None


def vwap_reversion(f, holds: bool, c: dict) -> Signal | None:
    """Buys far under the session's mean price on volume, sells a holding above it, once the session has some bars."""
    if not f.warmed_up or not f.vwap_ready or f.vwap_session_bars < c["vwap_skip"]:
        return None
    z = f.vwap_z_score
    if holds:
        return Signal("sell", _unit((z - c["vwap_sell_z"]) / 2), "vwap_reversion_sell") if z > c["vwap_sell_z"] else None
    if math.isnan(z) or z > c["vwap_buy_z"] or f.relative_volume < c["vwap_volume"]:
        return None
    quality = 0.5 if f.vwap_session_bars > 200 else 1.0 if f.vwap_session_bars > 60 else 0.3
    score = 0.5 * _unit(abs(z - c["vwap_buy_z"]) / 3) + 0.3 * _unit((f.relative_volume - 1) / 2) + 0.2 * quality
    return Signal("buy", score, "vwap_reversion_buy") if score >= c["vwap_score"] else None


def breakout(f, holds: bool, c: dict) -> Signal | None:
    """Buys a close above the band out of a squeeze on volume, sells a holding under the band or far under the channel's top."""
    if not f.warmed_up:
        return None
    b = f.bollinger_pct_b
    if holds:
        leaves = b < 0 or f.donchian_mid < f.donchian_upper - c["breakout_stop"] * f.atr
        return Signal("sell", min(1.0, max(0.1, 1 - b)), "breakout_sell") if leaves else None
    if (c["breakout_squeeze"] and not f.squeeze) or b <= 1 or f.relative_volume < c["breakout_volume"]:
        return None
    strength = _unit((b - 1) * (f.bollinger_upper - f.bollinger_lower) / f.atr / 2) if f.atr > 1e-10 else 0.5
    score = 0.4 * _unit(1 - f.bandwidth_percentile) + 0.3 * _unit((f.relative_volume - 1) / 2) + 0.3 * strength
    return Signal("buy", score, "breakout_buy") if score >= c["breakout_score"] else None


STRATEGIES = {"mean_reversion": mean_reversion, "momentum": momentum, "vwap_reversion": vwap_reversion, "breakout": breakout}


def combined(f, holds: bool, regime: str, weights: dict[str, float], c: dict, hour: int | None = None) -> tuple[Signal | None, int]:
    """What the weighted votes of the strategies come to, and the number of voters.

    The regime scales a strategy's weight. The net of buys less sells has to reach a least; an entry may need a break of the
    cumulative sums, a low chance of a change and an hour that is not blocked; leaving takes some sell voters. The reason is
    that of the heaviest vote of the side.
    """
    votes = []
    for name, weight in weights.items():
        found = STRATEGIES[name](f, holds, c) if weight > 0 else None
        if found:
            votes.append((found, weight * MULTIPLIERS[name][REGIMES.index(regime)] * found.score))
    net = sum(w if s.side == "buy" else -w for s, w in votes)
    if len(votes) < c["voters"] or abs(net) < c["net"]:
        return None, len(votes)
    if net > 0 and not holds and ((c["cusum_gate"] and not f.cusum_triggered) or (c["change"] > 0 and f.regime_change_prob > c["change"]) or (hour is not None and hour in c["blocked_hours"])):
        return None, len(votes)
    if holds and net < 0 and sum(s.side == "sell" for s, _ in votes) < c["sell_voters"]:
        return None, len(votes)
    side = "buy" if net > 0 else "sell"
    best = max((v for v in votes if v[0].side == side), key=lambda v: v[1], default=None)
    return (Signal(side, abs(net), best[0].reason) if best else None), len(votes)


def exit_rule(price: float, entry: float, held: int, atr: float, vol: float, c: dict) -> str | None:
    """Why a holding is left whatever the votes: a stop by volatility (or by share where none is known), its profit, its time."""
    distance = vol * price if vol > 0 else max(atr, 0.0)
    gain = (price - entry) / entry
    if c["stop"] > 0 and distance > 0:
        if price < entry - distance * c["stop"]:
            return "stop_loss"
    elif c["stop_share"] > 0 and gain < -c["stop_share"]:
        return "stop_loss"
    if c["take"] > 0 and gain > c["take"]:
        return "take_profit"
    return "max_hold_time" if c["longest"] > 0 and held >= c["longest"] else None


def kelly_share(wins: float, losses: float, won: float, lost: float, c: dict) -> float:
    """Kelly's share of the posterior win rate and mean payoffs, less a penalty for the posterior's spread."""
    a, b = c["prior_wins"] + wins, c["prior_losses"] + losses
    p = a / (a + b)
    ratio = (won / wins if wins else 1.0) / max(lost / losses if losses else 1.0, 1e-10)
    share = (p * ratio - (1 - p)) / ratio if ratio > 0 else 0.0
    spread = math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
    return _unit(share * max(0.2, 1 - 4 * spread)) if share > 0 else 0.0


def sized(signal: Signal, price: float, holding: float, day_pnl: float, killed: bool, kelly: float, regime: str, c: dict) -> tuple[float | None, str | None]:
    """(quantity, why not): the kill switch, the cost filter, then a size by notional, the day's loss and Kelly's share."""
    if killed:
        return None, "kill_switch"
    if c["reward"] > 0 and signal.score < 2 * c["cost"] * c["reward"]:
        return None, "cost_filter"
    if signal.side == "sell":
        return (holding, None) if holding > 0 else (None, "no_position")
    lost = _unit(-day_pnl / c["daily_loss"]) if c["deleverage"] and c["daily_loss"] > 0 and day_pnl < 0 else 0.0
    scale = (1 - lost) ** c["deleverage_power"]
    if c["kelly"]:
        if kelly <= 0:
            return None, "no_edge"
        scale = min(c["largest"], max(c["smallest"], kelly * KELLY[REGIMES.index(regime)] * scale))
    shares = c["notional"] / price * scale
    shares = shares if price > c["fractional_price"] else math.floor(min(shares, c["most_shares"]))
    return (float(shares), None) if shares > 0 else (None, "position_size")


def kelly_columns(wins: Column, losses: Column, won: Column, lost: Column, limits: dict | None = None) -> Column:
    """``kelly_share`` as a column expression."""
    c = LIMITS | (limits or {})
    a, b = c["prior_wins"] + wins, c["prior_losses"] + losses
    p = a / (a + b)
    ratio = F.when(wins > 0, won / wins).otherwise(1.0) / F.greatest(F.when(losses > 0, lost / losses).otherwise(1.0), F.lit(1e-10))
    share = (p * ratio - (1 - p)) / ratio
    spread = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return F.when(share > 0, F.least(F.lit(1.0), share * F.greatest(F.lit(0.2), 1 - 4 * spread))).otherwise(0.0)


def sized_columns(side: Column, score: Column, price: Column, holding: Column, day_pnl: Column, killed: Column, kelly: Column, regime: Column, limits: dict | None = None) -> tuple[Column, Column]:
    """``sized`` as column expressions."""
    c = LIMITS | (limits or {})
    lost = F.when(day_pnl < 0, F.least(F.lit(1.0), -day_pnl / c["daily_loss"])).otherwise(0.0) if c["deleverage"] and c["daily_loss"] > 0 else F.lit(0.0)
    scale = F.pow(1 - lost, F.lit(c["deleverage_power"]))
    if c["kelly"]:
        part = F.when(regime == REGIMES[0], KELLY[0]).when(regime == REGIMES[2], KELLY[2]).when(regime == REGIMES[3], KELLY[3]).otherwise(KELLY[1])
        scale = F.least(F.lit(c["largest"]), F.greatest(F.lit(c["smallest"]), kelly * part * scale))
    shares = c["notional"] / price * scale
    shares = F.when(price > c["fractional_price"], shares).otherwise(F.floor(F.least(shares, F.lit(c["most_shares"]))).cast("double"))
    why = F.when(killed, "kill_switch").when(F.lit(c["reward"] > 0) & (score < 2 * c["cost"] * c["reward"]), "cost_filter")
    why = why.when((side == "sell") & (holding <= 0), "no_position").when((side == "buy") & F.lit(bool(c["kelly"])) & (kelly <= 0), "no_edge").when((side == "buy") & (shares <= 0), "position_size")
    return F.when(why.isNull(), F.when(side == "sell", holding).otherwise(shares)), why


DECISION = "regime string, voters int, side string, score double, reason string, passed boolean, rejection string, quantity double, fill_side string, fill_quantity double, fill_price double, fill_pnl double, fill_reason string, held_bars int, holding double, day_pnl double, killed boolean, equity double"


class Engine:
    """One symbol's decisions bar by bar, and their fills at the next bar's open.

    At a bar the order of the bar before is filled first; what a sale gains counts for the day's loss limit, which a new day
    resets, for Kelly's record and for the equity whose drawdown makes a crisis. Then an exit rule may close the holding; else
    the votes decide, a sale waits for the least holding time, and the risk gate sizes or rejects. ``step`` gives the values
    of DECISION; state is numbers and short texts' codes, so that any store can hold it.
    """

    REASONS = ("stop_loss", "take_profit", "max_hold_time", *(f"{s}_{x}" for s in STRATEGIES for x in ("buy", "sell")))

    def __init__(self, weights: dict[str, float] | None = None, **limits) -> None:
        self.c, self.weights = LIMITS | limits, WEIGHTS | (weights or {})

    def regime(self, f, drawdown: float) -> str:
        rank = f.garch_vol_percentile
        if drawdown < -0.05 and rank > 0.90:
            return "crisis"
        if (f.change_run < 20 and rank > 0.30) or rank > 0.70:
            return "high_vol"
        return "low_vol" if rank < 0.30 else "normal"

    def _filled(self, s: dict, open_: float) -> tuple:
        kind, quantity, code = s.pop("order", 0.0), s.pop("order_quantity", 0.0), int(s.pop("order_reason", 0.0))
        if not kind:
            return (None,) * 6
        if kind > 0:
            s["holding"], s["entry"], s["entry_bar"] = quantity, open_, s["engine_bar"]
            return "buy", quantity, open_, None, self.REASONS[code], None
        gained, held = quantity * (open_ - s["entry"]), int(s["engine_bar"] - s["entry_bar"])
        s["holding"] = 0.0
        if gained != 0:
            s["day_pnl"] += gained
            if s["day_pnl"] < -self.c["daily_loss"]:
                s["killed"] = 1.0
            count, total = ("wins", "won") if gained > 0 else ("losses", "lost")
            s[count], s[total] = s.get(count, 0.0) + 1, s.get(total, 0.0) + abs(gained)
            s["equity"] = s.get("equity", 0.0) + gained
            s["peak"] = max(s.get("peak", 0.0), s["equity"])
        return "sell", quantity, open_, gained, self.REASONS[code], held

    def step(self, s: dict, f, open_: float, close: float, day: int, hour: int | None = None) -> tuple:
        c = self.c
        if s.get("engine_day") != day:
            s.update(engine_day=day, day_pnl=0.0, killed=0.0)
        s.setdefault("engine_bar", 0.0)
        fill = self._filled(s, open_)
        s["engine_bar"] += 1
        peak, equity, holding = s.get("peak", 0.0), s.get("equity", 0.0), s.get("holding", 0.0)
        regime = self.regime(f, (equity - peak) / peak if peak > 0 else 0.0)
        held = int(s["engine_bar"] - s.get("entry_bar", 0.0))
        why = exit_rule(close, s["entry"], held, f.atr, f.garch_vol, c) if holding > 0 else None
        voters = 0
        if why:
            signal, quantity, rejection = Signal("sell", 0.0, why), holding, None
        else:
            signal, voters = combined(f, holding > 0, regime, self.weights, c, hour)
            quantity = rejection = None
            if signal:
                if signal.side == "sell" and holding > 0 and held < c["least"]:
                    rejection = "min_hold"
                else:
                    kelly = kelly_share(*(s.get(x, 0.0) for x in ("wins", "losses", "won", "lost")), c) if c["kelly"] else 1.0
                    quantity, rejection = sized(signal, close, holding, s["day_pnl"], bool(s["killed"]), kelly, regime, c)
        if quantity is not None:
            s.update(order=1.0 if signal.side == "buy" else -1.0, order_quantity=quantity, order_reason=float(self.REASONS.index(signal.reason)))
        told = (signal.side, signal.score, signal.reason, rejection is None) if signal else (None,) * 4
        return regime, voters, *told, rejection, quantity, *fill, holding, s["day_pnl"], bool(s["killed"]), equity


FeatureRow = namedtuple("FeatureRow", FEATURES)


class StreamedEngine:
    """Feature state and machine as one step over bars, for a stream; ``step`` gives the values of DECISION."""

    def __init__(self, features, engine: Engine) -> None:
        self.features, self.engine = features, engine

    def step(self, state: dict, bar) -> tuple:
        found = FeatureRow(*self.features.step(state, bar.millis, bar.high, bar.low, bar.close, bar.volume))
        return self.engine.step(state, found, bar.open, bar.close, bar.day)
