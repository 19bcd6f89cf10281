"""Scores, votes, gates, positions and pair signals as column expressions, windows and ordered folds."""

from __future__ import annotations

import heapq
import math
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scan

unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _vote(buy: Column, buy_score: Column, sell: Column, sell_score: Column, least_buy: float, least_sell: float) -> tuple[Column, Column]:
    """(side, score): a signal counts if its score is at least the least."""
    buy, sell = buy & (buy_score >= least_buy), sell & (sell_score >= least_sell)
    return F.when(buy, "buy").when(sell, "sell"), F.when(buy, buy_score).when(sell, sell_score)


def reversion_score(z: Column, volume: Column, trend_up: Column, holds: Column, entry: float = 2.0, least_volume: float = 1.2, least: float = 0.5, percentile: Column | None = None, tail: float = 0.05) -> tuple[Column, Column]:
    """(side, score): buys a fall of z below -entry on volume in an uptrend, sells a holding on a rise above entry.

    Given the percentile of z among its past, a negative z in the lowest ``tail`` buys instead.
    """
    low, depth = (z < -entry, F.abs(-entry - z)) if percentile is None else ((percentile < tail) & (z < 0), F.abs(z))
    return _vote(low & (volume > least_volume) & ~holds & trend_up, 0.6 * depth + 0.4 * (volume - 1), holds & (z > entry), z - entry, least, least)


def momentum_score(fast: Column, slow: Column, atr: Column, adx: Column, plus_di: Column, minus_di: Column, volume: Column, holds: Column, least_adx: float = 20.0, least_volume: float = 0.8, least: float = 0.3) -> tuple[Column, Column]:
    """(side, score): buys a strong rising trend, sells a holding when the fast mean is no longer above the slow one."""
    apart = lambda x, flat: F.when(atr > 1e-10, unit(x / atr / 2)).otherwise(flat)
    buy = ~holds & (fast > slow) & ~F.isnan(adx) & (adx >= least_adx) & (plus_di > minus_di) & (volume >= least_volume)
    score = 0.5 * unit((adx - least_adx) / 40) + 0.3 * apart(fast - slow, 0.0) + 0.2 * unit((volume - 1) / 2)
    return _vote(buy, score, holds & ~(fast > slow), apart(slow - fast, 0.5), least, 0.0)


def breakout_score(squeeze: Column, rank: Column, percent_b: Column, width: Column, top: Column, mid: Column, atr: Column, volume: Column, holds: Column, least_volume: float = 1.2, stop: float = 3.0, least: float = 0.3) -> tuple[Column, Column]:
    """(side, score): buys a close above the band out of a squeeze on volume; sells a holding under the band, or when the
    channel's middle is more than ``stop`` ranges under its top. ``rank`` is the percentile of the band's width."""
    strength = F.when(atr > 1e-10, unit((percent_b - 1) * width / atr / 2)).otherwise(0.5)
    score = 0.4 * unit(1 - rank) + 0.3 * unit((volume - 1) / 2) + 0.3 * strength
    sell = holds & ((percent_b < 0) | (mid < top - stop * atr))
    return _vote(~holds & squeeze & (percent_b > 1) & (volume >= least_volume), score, sell, F.greatest(F.lit(0.1), F.least(F.lit(1.0), 1 - percent_b)), least, 0.0)


def vwap_score(z: Column, session_bars: Column, volume: Column, holds: Column, entry: float = 2.0, leave: float = 1.5, least_volume: float = 1.0, least_bars: int = 30, least: float = 0.3) -> tuple[Column, Column]:
    """(side, score): buys at a deviation of -entry or less from the session's VWAP on volume, sells above ``leave``."""
    ready = session_bars >= least_bars
    quality = F.when(session_bars > 200, 0.5).when(session_bars > 60, 1.0).otherwise(0.3)
    score = 0.5 * unit(F.abs(z + entry) / 3) + 0.3 * unit((volume - 1) / 2) + 0.2 * quality
    return _vote(ready & ~holds & ~F.isnan(z) & (z <= -entry) & (volume >= least_volume), score, ready & holds & (z > leave), unit((z - leave) / 2), least, 0.0)


def combine(votes: DataFrame, by: list[str], least_net: float = 0.2, least_voters: int = 1) -> DataFrame:
    """(by, side, net, voters, best): weighted votes (name, side, score, weight) of each bar, buys against sells."""
    amount = F.coalesce(F.col("score") * F.col("weight"), F.lit(0.0))
    g = votes.groupBy(*by).agg(
        F.sum(F.when(F.col("side") == "buy", amount).otherwise(0.0)).alias("buy"), F.sum(F.when(F.col("side") == "sell", amount).otherwise(0.0)).alias("sell"),
        F.count("side").alias("voters"), F.max_by("name", F.struct(amount, "name")).alias("best"),
    )
    net = F.col("buy") - F.col("sell")
    enough = F.col("voters") >= least_voters
    side = F.when(enough & (net >= least_net), "buy").when(enough & (net <= -least_net), "sell")
    return g.select(*by, side.alias("side"), net.alias("net"), "voters", F.when(side.isNotNull(), F.col("best")).alias("best"))


def exit_reason(price: Column, entry: Column, held: Column, atr: Column, vol: Column, stop: float = 2.5, stop_pct: float = 0.05, take_pct: float = 0.10, longest: int = 60) -> Column:
    """Why a long position is left: a stop at ``stop`` times the volatility of returns, or else the mean range; a share of the
    entry price where neither is known; the profit is reached; it was held too long. Comparisons are to nine decimals."""
    gain = F.round((price - entry) / entry, 9)
    distance = F.when(vol > 0, vol * price).when(atr > 0, atr).otherwise(0.0)
    stops = (F.lit(stop) > 0) & (distance > 0)
    stopped = F.when(stops, F.round(price - entry + distance * stop, 9) < 0).otherwise((F.lit(stop_pct) > 0) & (gain < -stop_pct))
    return F.when(stopped, F.when(stops, "vol_stop").otherwise("stop")).when((F.lit(take_pct) > 0) & (gain > take_pct), "take_profit").when((F.lit(longest) > 0) & (held >= longest), "max_hold")


def kill_flags(trades: DataFrame, limit: float, by: list[str], order: list[str]) -> DataFrame:
    """Trades with the day's running profit and whether it has fallen below -limit by then."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = trades.withColumn("day_pnl", F.sum("pnl").over(w))
    return out.withColumn("killed", F.min("day_pnl").over(w) < -limit)


def pair_z(spreads: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """z of each spread against the n before it, which it is not among; null until there are n."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(-n, -1)
    out = spreads.withColumns({"past": F.count("*").over(w), "mean": F.avg("spread").over(w), "std": F.stddev_pop("spread").over(w)})
    return out.withColumn("z", F.when((F.col("past") == n) & (F.col("std") > 1e-10), (F.col("spread") - F.col("mean")) / F.col("std"))).drop("past", "mean", "std")


def decayed_exit(z: Column, held: Column, longest: Column, threshold: float = 0.5, floor: float = 0.1) -> Column:
    """Whether |z| is under a threshold that shrinks in a line to a floor, no higher than itself, as days are held; max hold goes first. Nine decimals count."""
    now = threshold - (threshold - min(floor, threshold)) * F.least(F.lit(1.0), held / longest)
    return F.when(held >= longest, "max_hold").when(F.round(F.abs(z), 9) < F.round(now, 9), "reversion")


def trade_bps(ret_a: Column, ret_b: Column, beta: Column, side: Column, cost_bps: float = 10.0) -> Column:
    return side * (ret_a - beta * ret_b) / (1 + F.abs(beta)) * 1e4 - cost_bps


def loss_pause(trades: DataFrame, by: list[str], order: list[str], streak: int = 5, stops: int = 3, stop_reason: str = "F") -> DataFrame:
    """Trades after which the key pauses: the last ``streak`` all lost, or the last ``stops`` were all stopped."""
    w = W.partitionBy(*by).orderBy(*order)
    lost = w.rowsBetween(-(streak - 1), 0)
    hit = w.rowsBetween(-(stops - 1), 0)
    pause = ((F.count("*").over(lost) == streak) & (F.max("pnl").over(lost) < 0)) | ((F.count("*").over(hit) == stops) & F.bool_and(F.col("exit_reason") == stop_reason).over(hit))
    return trades.withColumn("pause", pause)


def entry_cap(entries: DataFrame, day: str, score: str, id: str, most: int) -> DataFrame:
    """The day's entries with the highest scores; ties by id. Caps go by score, not by arrival."""
    rank = F.row_number().over(W.partitionBy(day).orderBy(F.desc(score), id))
    return entries.withColumn("place", rank).withColumn("admitted", F.col("place") <= most)


class EntryCaps:
    """Entries in the order they come: so many a day at most, and so many open at once; those left out never open.

    ``step`` takes the day, the number of an entry's day and that on which it would be left; a position left on a day makes
    room on that day. State is numbers and the days on which open positions end, ``open`` of them at most.
    """

    def __init__(self, daily: int = 4, open: int = 25) -> None:
        self.daily, self.open = daily, open

    def step(self, state: dict, entered: int, left: int) -> tuple[int, int, bool]:
        """(entries of the day before it, open positions before it, admitted)."""
        if state.get("day") != entered:
            state.update(day=entered, today=0)
        ends = state.setdefault("ends", [])
        while ends and ends[0] <= entered:
            heapq.heappop(ends)
        today, now = int(state["today"]), len(ends)
        admitted = not (0 < self.daily <= today or 0 < self.open <= now)
        if admitted:
            state["today"] = today + 1
            heapq.heappush(ends, left)
        return today, now, admitted


def frozen_position(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Position by a latch: 1 once z < -k, -1 once z > k, held till the other; 0 before either. Thresholds k are frozen."""
    side = F.when(F.col("z") < -F.col("k"), 1).when(F.col("z") > F.col("k"), -1)
    return rows.withColumn("position", F.coalesce(scan.latch(side, by, order), F.lit(0)))


def transitions(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows where the position changes, with what happened."""
    before = F.coalesce(F.lag("position").over(W.partitionBy(*by).orderBy(*order)), F.lit(0))
    out = rows.withColumn("before", before).where("position <> before")
    kind = F.when(F.col("before") == 0, F.when(F.col("position") > 0, "open_long").otherwise("open_short")).when(F.col("position") == 0, "close").otherwise("flip")
    return out.withColumn("reason", kind)


def day_summary(rows: DataFrame, changes: DataFrame, near: float = 0.75) -> DataFrame:
    g = rows.groupBy("day").agg(F.count("*").alias("evaluated"), F.count_if(F.abs("z") > near * F.col("k")).alias("near"))
    return g.join(changes.groupBy("day").agg(F.count("*").alias("changed")), "day", "left").withColumn("changed", F.coalesce("changed", F.lit(0)).cast("long"))


class RollingScore:
    """A gate policy: enters when the score of a spread against the last ones passes a level for some bars, leaves inside another.

    With ``raw`` the level of entry is that of the spread itself; leaving goes by the score."""

    def __init__(self, n: int = 60, enter: float = 1.5, leave: float = 0.5, confirm: int = 1, raw: float | None = None) -> None:
        self.n, self.enter, self.leave, self.confirm, self.raw = n, enter, leave, confirm, raw

    def step(self, state: dict, spread: float) -> tuple[float | None, int]:
        past = state.setdefault("past", deque(maxlen=self.n))
        position, score = state.get("position", 0), None
        if len(past) >= 2:
            mean = sum(past) / len(past)
            std = math.sqrt(sum((x - mean) ** 2 for x in past) / len(past))
            score = (spread - mean) / std if std > 1e-10 else 0.0
            level, value = (self.enter, score) if self.raw is None else (self.raw, spread)
            side = -1 if value > level else 1 if value < -level else 0
            run = state.get("run", 0) + 1 if side and side == state.get("side") else int(side != 0)
            state["side"], state["run"] = side, run
            if position and abs(score) < self.leave:
                position = 0
            elif side and side != position and run >= self.confirm:
                position = side
        past.append(spread)
        state["position"] = position
        return score, position


class Leadership:
    """A sector switches on after some days above both levels, stays for some days, and goes off below both."""

    def __init__(self, ret: float = 0.0, breadth: float = 0.5, persist: int = 2, hold: int = 3) -> None:
        self.ret, self.breadth, self.persist, self.hold = ret, breadth, persist, hold

    def step(self, state: dict, ret: float, breadth: float) -> bool:
        above = ret > self.ret and breadth > self.breadth
        state["run"] = state.get("run", 0) + 1 if above else 0
        if not state.get("on") and state["run"] >= self.persist:
            state["on"], state["days"] = True, 0
        elif state.get("on"):
            state["days"] += 1
            if state["days"] >= self.hold and ret <= self.ret and breadth <= self.breadth:
                state["on"] = False
        return bool(state.get("on"))


#: The overlay rule's days and limits.
OVERLAY = {
    "dwell": 5, "off_days": 2, "conflict_on": 0.15, "conflict_off": 0.05, "weak_return": 0.0, "weak_drawdown": 0.05, "recovered_return": 0.03, "recovered_drawdown": 0.03,
    "sleeve_return": 0.03, "sleeve_room": 0.70, "spare_return": 0.10, "spare_room": 0.85, "halve_drawdown": 0.05, "quarter_drawdown": 0.10,
}


class OverlayRule:
    """Chooses a book's overlay day by day: the basket alone, without shorts, or with a capped long sleeve.

    ``step`` takes whether leadership is on, the share of leaders that are held short, the strategy's return and drawdown
    over 20 days and the room that a sleeve would leave to the basket. A mode once entered is kept for some days; it is
    left when its cause has been gone for some days in a row. The sleeve is halved or quartered in a drawdown.
    """

    def __init__(self, **limits: float) -> None:
        self.c = OVERLAY | limits

    def _entry(self, conflict: float, ret: float, drawdown: float, room: float) -> tuple[str, str]:
        """The mode to go to from the basket alone while leadership is on, and why."""
        c = self.c
        weak = ret <= c["weak_return"] or drawdown >= c["weak_drawdown"]
        if conflict >= c["conflict_on"] and ret >= c["recovered_return"] and drawdown <= c["recovered_drawdown"]:
            return "suppress", "conflict"
        if room >= c["sleeve_room"] and (weak or ret <= c["sleeve_return"]):
            return "sleeve", "weak_basket"
        if room >= c["spare_room"] and ret <= c["spare_return"] and conflict < c["conflict_on"]:
            return "sleeve", "spare_room"
        return "basket", "crowded" if weak else "healthy"

    def _scale(self, mode: str, ret: float, drawdown: float) -> float:
        if mode != "sleeve":
            return 0.0
        if drawdown >= self.c["quarter_drawdown"]:
            return 0.25
        return 0.5 if drawdown >= self.c["halve_drawdown"] and ret >= self.c["weak_return"] else 1.0

    def step(self, state: dict, leading: bool, conflict: float, ret: float, drawdown: float, room: float) -> tuple[str, str, float]:
        """(mode, reason, scale of the sleeve)."""
        mode = state.get("mode", "basket")
        if state.get("dwell", 0) > 0:
            state["dwell"] -= 1
            reason = "dwell"
        elif mode == "basket":
            mode, reason = self._entry(conflict, ret, drawdown, room) if leading else ("basket", "no_leadership")
            if mode != "basket":
                state.update(mode=mode, dwell=self.c["dwell"], off=0)
        else:
            gone = not leading or (mode == "suppress" and conflict <= self.c["conflict_off"])
            state["off"] = state.get("off", 0) + 1 if gone else 0
            reason = "active"
            if state["off"] >= self.c["off_days"]:
                mode, reason = "basket", "cleared"
                state.update(mode=mode, off=0)
        return mode, reason, self._scale(mode, ret, drawdown)


def fixed_overlay(days: DataFrame, picker: str, mode: str) -> DataFrame:
    """Every day the same mode; a sleeve at its full scale."""
    return days.withColumns({"picker": F.lit(picker), "mode": F.lit(mode), "scale": F.lit(1.0 if mode == "sleeve" else 0.0)})
