"""Bars and order tables: selection, quality, joins that align series, resampling and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def clean(x: Column) -> Column:
    """Finite and above zero."""
    return x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < float("inf"))


def scan_bars(bars: DataFrame, symbols: list[str], first: str, last: str) -> DataFrame:
    """Bars of the symbols between two inclusive dates with a usable close; symbols and bounds of time can be pushed to a scan."""
    begin, end = F.to_date(F.lit(first)).cast("timestamp"), F.date_add(F.to_date(F.lit(last)), 1).cast("timestamp")
    return bars.where(F.col("symbol").isin(*symbols) & (F.col("ts") >= begin) & (F.col("ts") < end) & clean(F.col("close")))


def in_minutes(bars: DataFrame, first: int, last: int) -> DataFrame:
    """Rows whose UTC minute of the day is in [first, last)."""
    minute = F.hour("ts") * 60 + F.minute("ts")
    return bars.where((minute >= first) & (minute < last))


def in_range(bars: DataFrame, start: str, end: str) -> DataFrame:
    """Rows with a time in [start, end)."""
    return bars.where((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))


def pair_series(bars: DataFrame, a: str, b: str) -> DataFrame:
    """Closes and volumes of two symbols at their common times."""
    side = lambda s, n: bars.where(F.col("symbol") == s).select("ts", F.col("close").alias(f"close_{n}"), F.col("volume").alias(f"volume_{n}"))
    return side(a, "a").join(side(b, "b"), "ts")


def merge_bars(old: DataFrame, new: DataFrame, since: str, until: str) -> DataFrame:
    """Old rows outside [since, until) and the new rows that these do not have; on an equal (symbol, ts) the old row stays."""
    keep = old.where((F.col("ts") < F.lit(since).cast("timestamp")) | (F.col("ts") >= F.lit(until).cast("timestamp")))
    return keep.unionByName(new.join(keep.select("symbol", "ts"), ["symbol", "ts"], "left_anti"))


def manifest(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def coverage(bars: DataFrame, today: str | None = None) -> DataFrame:
    """(symbol, day): every weekday between a symbol's first and last bar, today left out."""
    span = bars.groupBy("symbol").agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
    days = span.select("symbol", F.explode(F.sequence("a", "b")).alias("day")).where(F.weekday("day") < 5)
    return days if today is None else days.where(F.col("day") != F.to_date(F.lit(today)))


def needing_refresh(symbols: DataFrame, covered: DataFrame, expected_day: str) -> DataFrame:
    return symbols.join(covered.where(F.col("day") == F.to_date(F.lit(expected_day))), "symbol", "left_anti")


def latest_status(events: DataFrame, key: str, at: str, values: list[str]) -> DataFrame:
    """Each key's last non-null value of every column, in event order: an update that keeps what it does not set."""
    return events.groupBy(key).agg(*(F.max_by(v, F.when(F.col(v).isNotNull(), F.col(at))).alias(v) for v in values))


def validate_bars(bars: DataFrame, order: str) -> DataFrame:
    """Per symbol, in arrival order: counts of what is wrong, and whether any of it is critical."""
    before = F.lag("ts").over(W.partitionBy("symbol").orderBy(order))
    rows = bars.withColumn("before", before)
    bad_price = ~(clean(F.col("open")) & clean(F.col("high")) & clean(F.col("low")) & clean(F.col("close")))
    shape = (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    out = rows.groupBy("symbol").agg(
        F.count("*").alias("n"), n(shape).alias("n_shape"), n(bad_price).alias("n_price"), n(F.col("volume") == 0).alias("n_no_volume"),
        n(F.col("ts") < F.col("before")).alias("n_backwards"), n(F.col("ts") == F.col("before")).alias("n_repeated"),
    )
    out = out.withColumn("no_volume_pct", 100.0 * F.col("n_no_volume") / F.col("n"))
    return out.withColumn("critical", (F.col("n_shape") > 0) | (F.col("n_price") > 0) | (F.col("n_backwards") > 0))


def find_gaps(bars: DataFrame, order: str, seconds: int) -> DataFrame:
    """Rows further than ``seconds`` from the bar before, with that distance."""
    before = F.lag("ts").over(W.partitionBy("symbol").orderBy(order))
    gap = F.unix_timestamp("ts") - F.unix_timestamp(before)
    return bars.withColumn("gap", gap).where(F.col("gap") > seconds)


def close_location(high: Column, low: Column, close: Column) -> Column:
    """Where the close lies in the bar's range; a half where there is none."""
    return F.when(high - low == 0, 0.5).otherwise((close - low) / (high - low))


def resolve(symbols: DataFrame, by_symbol: DataFrame, by_class: DataFrame, value: str, default: float) -> DataFrame:
    """A symbol's own value, else that of its class, else the default; both sides are dimension tables."""
    own = by_symbol.select("symbol", F.col(value).alias("__own"))
    kind = by_class.select("sector", F.col(value).alias("__kind"))
    out = symbols.join(own, "symbol", "left").join(kind, "sector", "left")
    return out.withColumn(value, F.coalesce("__own", "__kind", F.lit(default))).drop("__own", "__kind")


def without_components(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """Pairs in which neither leg is a fund (fund, member) that holds the other."""
    both = components.select(F.col("fund").alias("leg_a"), F.col("member").alias("leg_b")).unionByName(components.select(F.col("member").alias("leg_a"), F.col("fund").alias("leg_b")))
    return pairs.join(both, ["leg_a", "leg_b"], "left_anti")


def usable_keys(prices: DataFrame, key: str) -> DataFrame:
    """Keys without a bad price."""
    return prices.groupBy(key).agg(F.bool_and(clean(F.col("close"))).alias("ok")).where("ok").select(key)


def stale(rows: DataFrame, now: Column, seconds: int) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp("ts") > seconds


def basket_candidates(members: DataFrame, targets: DataFrame, least: int = 2) -> DataFrame:
    """(sector, target, peers): each traded target with the sector's other members, at least ``least`` of them."""
    both = targets.withColumnRenamed("symbol", "target").join(members.withColumnRenamed("symbol", "peer"), "sector").where("target <> peer")
    return both.groupBy("sector", "target").agg(F.array_sort(F.collect_set("peer")).alias("peers")).where(F.size("peers") >= least)


def basket_id(sector: Column, target: Column, day: Column, members: Column) -> Column:
    return F.concat_ws(":", sector, target, day.cast("string"), F.lower(F.hex(F.crc32(F.array_join(F.array_sort(members), ",").cast("binary")))))


def repeated_ids(rows: DataFrame, id: str) -> DataFrame:
    return rows.groupBy(id).agg(F.count("*").alias("n")).where("n > 1")


def id_difference(a: DataFrame, b: DataFrame, id: str) -> DataFrame:
    """(id, side): ids of only one of two tables."""
    a, b = a.select(id), b.select(id)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def pair_id(a: Column, b: Column) -> Column:
    return F.concat_ws("/", F.least(a, b), F.greatest(a, b))


def minute_pairs(bars: DataFrame, pairs: DataFrame, unit: str = "minute") -> DataFrame:
    """Both legs' closes in the same minute."""
    b = bars.select("symbol", F.date_trunc(unit, "ts").alias("at"), "close")
    x = pairs.join(b.withColumnsRenamed({"symbol": "leg_a", "close": "close_a"}), "leg_a")
    return x.join(b.withColumnsRenamed({"symbol": "leg_b", "close": "close_b"}), ["leg_b", "at"])


def aligned(panel: DataFrame, members: DataFrame) -> DataFrame:
    """Rows (group_id, symbol, day, close) of the days that all members of a group have."""
    size = members.groupBy("group_id").agg(F.count("*").alias("size"))
    rows = panel.join(members, "symbol").join(size, "group_id")
    return rows.withColumn("have", F.count("*").over(W.partitionBy("group_id", "day"))).where("have = size").drop("have", "size")


def recent_pairs(closes: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """(leg_a, leg_b, rn, a, b): the last n closes of both legs, each counted from its own end."""
    rank = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("day")))
    last = closes.withColumn("rn", rank).where(F.col("rn") <= n).select("symbol", "rn", "close")
    x = pairs.join(last.withColumnsRenamed({"symbol": "leg_a", "close": "a"}), "leg_a")
    return x.join(last.withColumnsRenamed({"symbol": "leg_b", "close": "b"}), ["leg_b", "rn"])


def next_after(orders: DataFrame, bars: DataFrame, delay_days: int = 0) -> DataFrame:
    """Orders (order_id, symbol, day) with the first bar of a later day: one union and one pass of a window from the end."""
    o = orders.select("symbol", F.col("day").alias("at"), F.lit(1).alias("kind"), "order_id", F.lit(None).cast("date").alias("fill_day"), F.lit(None).cast("double").alias("price"))
    b = bars.select("symbol", F.date_sub("day", 1 + delay_days).alias("at"), F.lit(2).alias("kind"), F.lit(None).cast("long").alias("order_id"), F.col("day").alias("fill_day"), F.col("close").cast("double").alias("price"))
    w = W.partitionBy("symbol").orderBy(F.desc("at"), F.desc("kind"), F.desc("order_id")).rowsBetween(W.unboundedPreceding, 0)
    first = lambda c: F.last(c, ignorenulls=True).over(w).alias(c)
    rows = o.unionByName(b).select("symbol", "kind", "order_id", "at", first("fill_day"), first("price"))
    return rows.where("kind = 1").select("order_id", "symbol", F.col("at").alias("day"), "fill_day", "price")


def session_closes(bars: DataFrame, day: Column) -> DataFrame:
    """(symbol, day, ts, close): the last bar of each symbol and day."""
    return bars.groupBy("symbol", day.alias("day")).agg(F.max("ts").alias("ts"), F.max_by("close", "ts").alias("close"))


def blacked_out(entries: DataFrame, events: DataFrame, days: int) -> DataFrame:
    """Entries (leg_a, leg_b, day) within ``days`` of an event of either leg, which events (symbol, event_day) name.

    The events are exploded to the days that they block, so the join is on equality."""
    block = events.select("symbol", F.explode(F.sequence(F.date_sub("event_day", days), F.date_add("event_day", days))).alias("day")).distinct()
    both = block.withColumnRenamed("symbol", "leg_a"), block.withColumnRenamed("symbol", "leg_b")
    return entries.join(both[0], ["leg_a", "day"], "left_semi").unionByName(entries.join(both[1], ["leg_b", "day"], "left_semi")).distinct()


def daily_bars(bars: DataFrame, day: Column) -> DataFrame:
    return bars.groupBy("symbol", day.alias("day")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))


def stream_counters(arrivals: DataFrame, order: str) -> DataFrame:
    """Per symbol, in arrival order: rows, unusable, older than the newest before, equal to the one before."""
    w = W.partitionBy("symbol").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    rows = arrivals.withColumn("newest", F.max("ts").over(w))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return rows.groupBy("symbol").agg(
        F.count("*").alias("n"), n(~clean(F.col("value"))).alias("n_invalid"), n(F.col("ts") < F.col("newest")).alias("n_late"), n(F.col("ts") == F.col("newest")).alias("n_repeated"), F.max("ts").alias("last")
    )


def rollup_all(trades: DataFrame) -> DataFrame:
    """Profit, trades and win rate by pair and day, by pair, and of all; ALL stands for what is summed over."""
    out = trades.rollup("pair_id", "exit_day").agg(F.sum("pnl").alias("pnl"), F.count("*").alias("n"), F.count_if(F.col("pnl") > 0).alias("wins"), F.grouping_id().alias("level"))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("ALL")).alias(c)
    return out.select(name("pair_id"), name("exit_day"), "pnl", "n", "wins", (F.col("wins") / F.col("n")).alias("win_rate"))
