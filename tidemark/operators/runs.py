"""Whole book runs side by side: run_id is a key of every step, and what admission leaves out goes back into the state."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scan
from .book import whole_shares


class BasketRun:
    """One run's positions day by day: each basket holds the side of its last signal until the other one comes, the strongest
    are admitted, and those left out are flat again, so that they need a new signal.

    ``step`` takes a day's baskets with a score, in the order of their names, the threshold in deviations and the cap; a
    basket without a score keeps its side and ranks last. It gives the names, positions and places of the baskets with a side.
    """

    def step(self, state: dict, targets: list[str], scores: list[float], k: float, cap: int) -> tuple[list[str], list[int], list[int]]:
        sides, today = state.setdefault("sides", {}), dict(zip(targets, scores))
        for target, z in today.items():
            if z < -k:
                sides[target] = 1
            elif z > k:
                sides[target] = -1
        ranked = sorted(sides, key=lambda t: (-abs(today[t]) if t in today else 1.0, t))
        places = {t: i + 1 for i, t in enumerate(ranked)}
        found = [(t, sides[t], places[t]) for t in sorted(sides)]
        for t in ranked[cap:]:
            del sides[t]
        return [t for t, _, _ in found], [s for _, s, _ in found], [p for _, _, p in found]


def positions(scores: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, day, target, position, place, admitted) of scores (day, target, z) under runs (run_id, k, cap, removed).

    A run may leave one basket out. Runs are independent keys of one ordered fold, over an array of the baskets for each day.
    """
    rows = scores.join(F.broadcast(runs), F.lit(True)).where(F.col("removed").isNull() | (F.col("target") != F.col("removed")))
    days = rows.groupBy("run_id", "day").agg(F.sort_array(F.collect_list(F.struct("target", "z"))).alias("s"), F.first("k").alias("k"), F.first("cap").alias("cap"))
    days = days.select("run_id", "day", F.transform("s", lambda x: x["target"]).alias("names"), F.transform("s", lambda x: x["z"]).alias("scores"), "k", "cap")
    machine = BasketRun()
    schema = "run_id string, day date, names array<string>, scores array<double>, k double, cap int, targets array<string>, sides array<int>, places array<int>"
    found = scan.fold(days, "run_id", ["day"], lambda s, x: machine.step(s, list(x.names), list(x.scores), x.k, x.cap), schema)
    found = found.select("run_id", "day", "cap", F.explode(F.arrays_zip("targets", "sides", "places")).alias("p"))
    return found.select("run_id", "day", F.col("p.targets").alias("target"), F.col("p.sides").alias("position"), F.col("p.places").alias("place"), (F.col("p.places") <= F.col("cap")).alias("admitted"))


def run_books(held: DataFrame, baskets: DataFrame, runs: DataFrame, closes: DataFrame) -> DataFrame:
    """(run_id, day, symbol, shares): whole shares of the summed legs of admitted positions, half of a basket's notional in its
    target and the rest in its peers; longs and shorts are scaled by the run's overlay."""
    size = baskets.groupBy("target").agg(F.collect_list("peer").alias("peers"))
    rows = held.where("admitted").join(size, "target").join(F.broadcast(runs.select("run_id", "notional", "short_scale")), "run_id")
    own = F.array(F.struct(F.col("target").alias("symbol"), F.lit(0.5).alias("w")))
    others = F.transform("peers", lambda p: F.struct(p.alias("symbol"), (-0.5 / F.size("peers")).alias("w")))
    legs = rows.select("run_id", "day", F.col("position") * F.col("notional") * F.when(F.col("position") < 0, F.col("short_scale")).otherwise(1.0), F.explode(F.concat(own, others)).alias("leg")).toDF("run_id", "day", "amount", "leg")
    book = legs.groupBy("run_id", "day", F.col("leg.symbol").alias("symbol")).agg(F.sum(F.col("amount") * F.col("leg.w")).alias("notional"))
    priced = book.join(closes, ["day", "symbol"])
    return priced.withColumn("shares", whole_shares(F.round("notional", 6), F.col("close"))).where("shares <> 0").select("run_id", "day", "symbol", "shares")


def fills(books: DataFrame, closes: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, day, symbol, before, shares, price): each book is reached at the next day's price, by what differs from the book
    before; a buy pays the run's slippage and a sale bears it."""
    days = closes.select("day").distinct()
    after = days.select("day", F.lead("day").over(W.orderBy("day")).alias("next"), F.lead("day", 2).over(W.orderBy("day")).alias("over"))
    placed = books.join(F.broadcast(after), "day")
    to = placed.select("run_id", F.col("next").alias("day"), "symbol", F.col("shares").alias("new"), F.lit(0.0).alias("old"))
    gone = placed.select("run_id", F.col("over").alias("day"), "symbol", F.lit(0.0).alias("new"), F.col("shares").alias("old"))
    both = to.unionByName(gone).where("day is not null").groupBy("run_id", "day", "symbol").agg(F.sum("old").alias("before"), F.sum("new").alias("shares"))
    rows = both.where("before <> shares").join(closes, ["day", "symbol"]).join(F.broadcast(runs.select("run_id", "slippage")), "run_id")
    side = F.when(F.col("shares") > F.col("before"), 1.0).otherwise(-1.0)
    return rows.select("run_id", "day", "symbol", "before", "shares", (F.col("close") * (1 + side * F.col("slippage"))).alias("price"))


def equity(books: DataFrame, filled: DataFrame, closes: DataFrame, runs: DataFrame, capital: float) -> DataFrame:
    """(run_id, day, pnl, equity): what was reached a day before earns the change of price, less the slippage of the day's fills."""
    order = W.orderBy("day")
    days = closes.select("day").distinct().select("day", F.lead("day").over(order).alias("at"), F.lead("day", 2).over(order).alias("earns"))
    moves = closes.select("symbol", "day", "close")
    held = books.join(F.broadcast(days), "day").where("earns is not null")
    now, then = moves.withColumnsRenamed({"day": "earns", "close": "now"}), moves.withColumnsRenamed({"day": "at", "close": "then"})
    earned = held.join(now, ["symbol", "earns"]).join(then, ["symbol", "at"]).groupBy("run_id", F.col("earns").alias("day")).agg(F.sum(F.col("shares") * (F.col("now") - F.col("then"))).alias("pnl"))
    paid = filled.join(closes, ["day", "symbol"]).groupBy("run_id", "day").agg((-F.sum(F.abs(F.col("shares") - F.col("before")) * F.abs(F.col("price") - F.col("close")))).alias("pnl"))
    daily = earned.unionByName(paid).groupBy("run_id", "day").agg(F.sum("pnl").alias("pnl"))
    run = W.partitionBy("run_id").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    return daily.withColumn("equity", F.lit(capital) + F.sum("pnl").over(run))


def run_stats(curve: DataFrame, capital: float, per_year: int = 252) -> DataFrame:
    """(run_id, days, total, sharpe, drawdown) of equity curves: return on capital, yearly Sharpe of daily returns, deepest fall."""
    run = W.partitionBy("run_id").orderBy("day")
    rows = curve.withColumns({"before": F.coalesce(F.lag("equity").over(run), F.lit(capital)), "peak": F.greatest(F.lit(capital), F.max("equity").over(run.rowsBetween(W.unboundedPreceding, 0)))})
    rows = rows.withColumns({"ret": F.col("pnl") / F.col("before"), "fall": (F.col("peak") - F.col("equity")) / F.col("peak")})
    std = F.stddev_samp("ret")
    return rows.groupBy("run_id").agg(F.count("*").alias("days"), (F.sum("pnl") / capital).alias("total"), F.when(std > 1e-12, F.avg("ret") / std * math.sqrt(per_year)).alias("sharpe"), F.max("fall").alias("drawdown"))


def removal_value(held: DataFrame, stats: DataFrame, base: str) -> DataFrame:
    """(removed, d_return, d_sharpe, d_drawdown, replaced): each leave-one-out run against the whole one, and the days on which
    another basket took the place of the one removed.

    ``stats`` has the runs with the basket that each leaves out."""
    whole = stats.where(F.col("run_id") == base).select(*(F.col(c).alias(f"b_{c}") for c in ("total", "sharpe", "drawdown")))
    others = stats.where(F.col("removed").isNotNull()).join(F.broadcast(whole), F.lit(True))
    admitted = held.where("admitted")
    full = admitted.where(F.col("run_id") == base).select("day", "target")
    mine = full.withColumnRenamed("target", "removed")
    new = admitted.join(stats.where(F.col("removed").isNotNull()).select("run_id", "removed"), "run_id").join(full, ["day", "target"], "left_anti").select("removed", "day").distinct()
    replaced = new.join(mine, ["removed", "day"], "left_semi").groupBy("removed").agg(F.count("*").alias("replaced"))
    out = others.join(replaced, "removed", "left")
    return out.select("removed", (F.col("total") - F.col("b_total")).alias("d_return"), (F.col("sharpe") - F.col("b_sharpe")).alias("d_sharpe"), (F.col("drawdown") - F.col("b_drawdown")).alias("d_drawdown"), F.coalesce("replaced", F.lit(0)).cast("long").alias("replaced"))
