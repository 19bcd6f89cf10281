"""The pair machine: two legs, a slow clock of daily spreads and hedge updates, a fast one of risk at every bar."""

from __future__ import annotations

import math

#: Default levels in deviations, windows and holds in days, money, the day's clock in minutes and its offset.
PAIR_LIMITS = {
    "enter": 2.0, "leave": 0.5, "stop": 4.0, "window": 32, "longest": 150, "shortest": 30, "notional": 10_000.0, "last_hour": 14, "close_minute": 930, "cost_bps": 10.0, "offset_hours": -5, "drift": 0.0,
    "trend": 0, "intraday": False, "confirm": 30, "intraday_enter": 0.0,
}
#: Fixed values of the hedge filter: noise of the hedge and of a spread, days until it is used, slope at which it begins anew.
HEDGE_NOISE, SPREAD_NOISE, HEDGE_WARM, HEDGE_MOST = 1e-5, 1e-3, 10, 5.0
PAIR_COLUMNS = "spread double, z double, frozen_z double, side int, event string, quantity_a double, quantity_b double, net_bps double, priority double"


class PairLegs:
    """One pair's positions over bars of both legs.

    With a new day the spread at the last bar of the day before joins the window, and while the pair is flat its hedge takes
    one filter step; z is against the window. A position is left by the mean and deviation that were frozen at its entry, on a
    stop, on z drifting from the frozen one, near the day's close, by age, or on reversion after a least hold. Five losses
    in a row or three stops pause entries for twice the longest hold. A flat pair enters at a new day (or, intraday, when
    z has stayed beyond a level for some bars), at most once a day, outside blackouts and trends, before the last hour, with z
    between the levels of entry and stop. Orders are signed quantities of both legs. ``step`` gives PAIR_COLUMNS; state is
    numbers and lists of numbers.
    """

    def __init__(self, **limits) -> None:
        self.c = PAIR_LIMITS | limits

    def _hedge(self, s: dict, y: float, x: float, alpha: float, beta: float) -> None:
        s["p00"] += HEDGE_NOISE
        s["p11"] += HEDGE_NOISE
        total = s["p00"] + 2 * x * s["p01"] + x * x * s["p11"] + SPREAD_NOISE
        k0, k1, off = (s["p00"] + x * s["p01"]) / total, (s["p01"] + x * s["p11"]) / total, y - s["a"] - s["b"] * x
        a, b = s["a"] + k0 * off, s["b"] + k1 * off
        if not (math.isfinite(a) and abs(b) < HEDGE_MOST):
            s.update(a=alpha, b=beta, p00=1.0, p01=0.0, p11=1.0, hedged=0)
            return
        u, v = s["p00"] + x * s["p01"], s["p01"] + x * s["p11"]
        s.update(a=a, b=b, p00=s["p00"] - k0 * u, p01=s["p01"] - k0 * v, p11=s["p11"] - k1 * v, hedged=s["hedged"] + 1)

    def _left(self, s: dict, z: float, frozen: float, minute: int, longest: int) -> str | None:
        c, side, held = self.c, s["side"], s["days"] - s["entry_days"]
        if side * frozen < -c["stop"]:
            return "stop_loss"
        if c["drift"] > 0 and abs(z - frozen) > c["drift"]:
            return "drift_stop"
        if minute >= c["close_minute"]:
            return "eod_close"
        if longest > 0 and held >= longest:
            return "max_hold"
        return "reversion" if side * frozen > -c["leave"] and held >= c["shortest"] else None

    def _may_enter(self, s: dict, z: float, day: int, millis: int, fresh: bool, hour: int, longest: int, blocked_until: int) -> bool:
        c = self.c
        if c["intraday"] and not fresh:
            level = c["intraday_enter"] or c["enter"]
            beyond = -1 if z < -level else 1 if z > level else 0
            s["stay"] = (s.get("stay", 0) + 1 if beyond == s.get("stay_side", 0) else 1) if beyond else 0
            s["stay_side"] = beyond
            if s["stay"] < c["confirm"]:
                return False
            s["stay"] = 0
        elif not fresh:
            return False
        if s.get("entered_on") == day:
            return False
        sign = 1 if z > 0 else -1
        s["same"], s["sign"] = (s.get("same", 0) + 1 if sign == s.get("sign") else 1), sign
        if millis < blocked_until or 0 < c["trend"] <= s["same"]:
            return False
        if s.get("paused"):
            s["waited"] = s.get("waited", 0) + 1
            if s["waited"] < 2 * max(longest, 5):
                return False
            s.update(paused=0, stops=0, waited=0)
        return hour < c["last_hour"] and c["enter"] < abs(z) <= c["stop"]

    def step(self, s: dict, millis: int, price_a: float, price_b: float, alpha: float, beta: float, kappa: float = 0.0, max_hold: int = 0, blocked_until: int = 0) -> tuple:
        """``alpha``, ``beta`` and ``kappa`` are the pair's fit; 0 days of ``max_hold`` mean the limit's."""
        c, nothing = self.c, (None,) * 4
        if not (price_a > 0 and price_b > 0):
            return None, None, None, int(s.get("side", 0)), *(None,) * 5
        if "a" not in s:
            s.update(a=alpha, b=beta, p00=1.0, p01=0.0, p11=1.0, hedged=0, days=0, side=0)
        y, x = math.log(price_a), math.log(price_b)
        own_a, own_b = (s["a"], s["b"]) if s["hedged"] >= HEDGE_WARM else (alpha, beta)
        spread, day = y - own_a - own_b * x, int(millis // 86_400_000)
        fresh = s.get("day", 0) > 0 and day != s["day"]
        ring = s.setdefault("spreads", [])
        if fresh:
            ring.append(s["pending"])
            del ring[: -c["window"]]
            s.update(days=s["days"] + 1, stay=0, stay_side=0)
            if not s["side"]:
                self._hedge(s, y, x, alpha, beta)
        s.update(day=day, pending=spread)
        mean = sum(ring) / len(ring) if ring else 0.0
        std = math.sqrt(sum((v - mean) ** 2 for v in ring) / len(ring)) if ring else 0.0
        if len(ring) < c["window"] or std < 1e-10:
            return spread, None, None, int(s["side"]), None, *nothing
        z = (spread - mean) / std
        minute = int((millis // 60_000 + c["offset_hours"] * 60) % 1440)
        longest = int(max_hold or c["longest"])
        if s["side"]:
            frozen = (spread - s["mean"]) / s["std"]
            event = self._left(s, z, frozen, minute, longest)
            if event is None:
                return spread, z, frozen, int(s["side"]), None, *nothing
            weight = abs(s["beta"])
            gain = (price_a - s["price_a"]) / s["price_a"] - weight * (price_b - s["price_b"]) / s["price_b"]
            net = s["side"] * gain / (1 + weight) * 10_000 - c["cost_bps"]
            history = s.setdefault("history", [])
            history.append(net)
            del history[:-10]
            s["stops"] = s.get("stops", 0) + 1 if event in ("stop_loss", "drift_stop") else 0
            if (len(history) >= 5 and all(h < 0 for h in history[-5:])) or s["stops"] >= 3:
                s["paused"] = 1
            quantity_a, quantity_b = -s["side"] * s["quantity_a"], s["side"] * s["quantity_b"]
            s["side"] = 0
            return spread, z, frozen, 0, event, quantity_a, quantity_b, net, None
        if not self._may_enter(s, z, day, millis, fresh, minute // 60, longest, blocked_until):
            return spread, z, None, 0, None, *nothing
        side = 1 if z < 0 else -1
        s.update(side=side, entry_days=s["days"], entered_on=day, price_a=price_a, price_b=price_b, beta=own_b, mean=mean, std=std)
        s.update(quantity_a=math.floor(c["notional"] / price_a), quantity_b=math.floor(c["notional"] * abs(own_b) / price_b))
        priority = abs(z) * math.sqrt(kappa) / std if kappa > 0 else 0.0
        return spread, z, None, side, "entry", float(side * s["quantity_a"]), float(-side * s["quantity_b"]), None, priority
