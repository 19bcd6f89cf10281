"""Positions against holdings, fills, refresh of pair sets, overlays, and book projections."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scan


def paired_trades(events: DataFrame, by: str, order: list[str]) -> DataFrame:
    """(by, n, entry_at, exit_at, entry_price, exit_price): the n-th exit of a key with its n-th entry."""
    rank = F.row_number().over(W.partitionBy(by, "kind").orderBy(*order))
    rows = events.withColumn("n", rank)
    side = lambda k: rows.where(F.col("kind") == k).select(by, "n", F.col("at").alias(f"{k}_at"), F.col("price").alias(f"{k}_price"))
    return side("entry").join(side("exit"), [by, "n"])


def refreshed_pairs(active: DataFrame, fresh: DataFrame, open_ids: DataFrame) -> DataFrame:
    """(pair_id, action): update what stays, tighten what left but is open, drop what left and is flat, add what is new."""
    a, b = active.select("pair_id", F.lit(1).alias("a")), fresh.select("pair_id", F.lit(1).alias("b"))
    rows = a.join(b, "pair_id", "full").join(open_ids.select("pair_id", F.lit(1).alias("o")), "pair_id", "left")
    action = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "update").when(F.col("b").isNotNull(), "add").when(F.col("o").isNotNull(), "tighten").otherwise("drop")
    return rows.select("pair_id", action.alias("action"))


def pair_direction(pairs: DataFrame, holdings: DataFrame) -> DataFrame:
    """1 or -1 where both legs are held with opposite signs, by the sign of leg a; else 0."""
    h = lambda n: holdings.select(F.col("symbol").alias(f"leg_{n}"), F.col("shares").alias(f"q_{n}"))
    rows = pairs.join(h("a"), "leg_a", "left").join(h("b"), "leg_b", "left")
    a, b = F.coalesce("q_a", F.lit(0.0)), F.coalesce("q_b", F.lit(0.0))
    return rows.withColumn("direction", F.when(a * b < 0, F.signum(a)).otherwise(0.0).cast("int")).drop("q_a", "q_b")


def held_position(baskets: DataFrame, holdings: DataFrame) -> DataFrame:
    """Sign of the target's holding; under half a share is flat."""
    rows = baskets.join(holdings.select(F.col("symbol").alias("target"), "shares"), "target", "left")
    q = F.coalesce("shares", F.lit(0.0))
    return rows.withColumn("position", F.when(F.abs(q) < 0.5, 0).otherwise(F.signum(q)).cast("int")).drop("shares")


def reallocation_band(current: Column, target: Column, price: Column, support: Column, most_shares: float, most_notional: float) -> Column:
    """Keeps the current shares where a change on the same side is small in shares and notional and some admitted basket holds
    the symbol on that side; a change of sign, an opening and a close are never held back."""
    delta = F.abs(target - current)
    small = (current * target > 0) & (delta <= most_shares) & (delta * price <= most_notional) & (support > 0) & (F.abs(current) >= 0.5)
    return F.when(F.coalesce(small, F.lit(False)), current).otherwise(target)


def symbol_support(legs: DataFrame, by: list[str]) -> DataFrame:
    """How many baskets are long or short a symbol, as target or as peer."""
    n = lambda c: F.count_if(c)
    own = F.col("symbol") == F.col("target")
    return legs.groupBy(*by, "symbol").agg(n(F.col("notional") > 0).alias("long"), n(F.col("notional") < 0).alias("short"), n(own).alias("as_target"), n(~own).alias("as_peer"))


def trade_class(current: Column, target: Column, long: Column, short: Column) -> Column:
    return (
        F.when((current == 0) & (target == 0), "none").when(current == 0, "open").when((target == 0) & (long + short == 0), "unsupported_close").when(target == 0, "netted_close")
        .when(current * target < 0, "flip").when(F.abs(target) > F.abs(current), F.when((long > 0) & (short > 0), "contested_increase").otherwise("increase"))
        .when(F.abs(target) < F.abs(current), F.when((long > 0) & (short > 0), "contested_reduction").otherwise("reduction")).otherwise("hold")
    )


def fill_price(price: Column, side: Column, bps: float) -> Column:
    return price * (1 + F.when(side == "buy", bps).otherwise(-bps) / 1e4)


def affordable(peak: Column, gross: Column, power: Column) -> Column:
    return peak - gross <= power + 1


def effective_capital(config: Column, account: Column) -> Column:
    ok = account.isNotNull() & ~F.isnan(account) & (account > 0)
    return F.when(ok, F.least(config, account)).otherwise(config)


def second_phase_allowed(current: Column, target: Column, now: Column) -> Column:
    """A symbol that changes sign may open only once it is flat or on the new side; others always."""
    return (current * target >= 0) | (now == 0) | (now * target > 0)


def settled(book: DataFrame, by: list[str]) -> DataFrame:
    """Whether no order is needed."""
    return book.groupBy(*by).agg((F.count_if(F.round(F.abs(F.col("target_shares") - F.col("current_shares"))) > 0) == 0).alias("settled"))


def sleeve_scale(book_gross: Column, sleeve_gross: Column, cap: float) -> Column:
    """What the basket book is scaled by to leave the sleeve its room under the cap."""
    room = F.greatest(F.lit(0.0), cap - F.least(sleeve_gross, F.lit(cap)))
    return F.when(book_gross > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), room / book_gross))).otherwise(0.0)


def should_rotate(gained: Column, remaining: Column, best_queued: Column, cost: float) -> Column:
    return (gained > 0) & (remaining < best_queued - 2 * cost)


def distribution(rows: DataFrame, by: list[str], value: str, shares: tuple[str, ...] = ("0.5", "0.95", "0.99")) -> DataFrame:
    """Count, range and exact order statistics of a metric: the least value that so large a share of the values does not exceed.

    Equal values are counted first; their running count is a prefix scan, so that no task holds more than its range of a key.
    Shares are decimals in text, as n times a binary fraction could miss a whole rank by a bit.
    """
    totals = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("__n"))
    key = F.to_json(F.array(*(F.col(c).cast("string") for c in by)))
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__c")).select(key.alias("__of"), value, "__c")
    placed = scan.affine_scans(counted, "__of", [value], {"__at": scan.Affine(F.lit(1.0), F.col("__c"), F.lit(0.0))})
    totals = totals.withColumn("__of", key)
    rank = lambda p: F.ceil(F.col("__n") * F.lit(Decimal(p))).cast("long")
    names = [f"p{Decimal(p) * 100:.0f}" for p in shares]
    picked = placed.join(totals.select("__of", "__n"), "__of").groupBy("__of").agg(*(F.min(F.when(F.col("__at") >= rank(p), F.col(value))).alias(c) for p, c in zip(shares, names)))
    return totals.join(picked, "__of", "left").select(*by, "n", "min", "max", *names)
