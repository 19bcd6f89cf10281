"""Indicator columns over bars (symbol, ts, open, high, low, close, volume), one row per bar.

All of one symbol's windows share one partitioning and ordering, so Spark sorts once. Windows give partial results until
they fill; ``warmed_up`` says when they are full.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import detectors, scan

FLAT = 1e-10


def by_symbol():
    return W.partitionBy("symbol").orderBy("ts")


def last(n: int):
    return by_symbol().rowsBetween(-(n - 1), 0)


def simple_return(k: int) -> Column:
    """Return on the close k bars ago; 0 where there is none or it is 0."""
    then = F.lag("close", k).over(by_symbol())
    return F.when(then.isNull() | (then == 0), 0.0).otherwise(F.col("close") / then - 1)


def log_return() -> Column:
    then = F.lag("close", 1).over(by_symbol())
    return F.when(then.isNull() | (then <= 0) | (F.col("close") <= 0), 0.0).otherwise(F.log(F.col("close") / then))


def true_range() -> Column:
    then = F.lag("close", 1).over(by_symbol())
    return F.when(then.isNull(), F.col("high") - F.col("low")).otherwise(F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - then), F.abs(F.col("low") - then)))


def with_returns(bars: DataFrame) -> DataFrame:
    """Returns over 1, 5 and 20 bars counting the current one as the first of the 20, and the log return."""
    return bars.withColumns({"return_1": simple_return(1), "return_5": simple_return(5), "return_20": simple_return(19), "log_return": log_return()})


def with_trend(bars: DataFrame, short: int = 32, long: int = 64) -> DataFrame:
    out = bars.withColumns({"sma_20": F.avg("close").over(last(short)), "sma_50": F.avg("close").over(last(long))})
    return out.withColumn("trend_up", F.col("close") > F.col("sma_50"))


def with_ranges(bars: DataFrame, n: int = 16, volumes: int = 32) -> DataFrame:
    mean = F.avg("volume").over(last(volumes))
    out = bars.withColumns({"true_range": true_range(), "relative_volume": F.when(mean == 0, 1.0).otherwise(F.col("volume") / mean)})
    return out.withColumn("atr", F.avg("true_range").over(last(n)))


def with_zscore(bars: DataFrame, n: int = 32) -> DataFrame:
    """return_1 over the population deviation of its last n values, without a mean taken off; 0 where that is flat."""
    std = F.stddev_pop("return_1").over(last(n))
    return bars.withColumns({"return_std": std, "return_z": F.when(std <= FLAT, 0.0).otherwise(F.col("return_1") / std)})


def with_bands(bars: DataFrame, n: int = 32, width: float = 2.0) -> DataFrame:
    mean, std = F.avg("close").over(last(n)), F.stddev_pop("close").over(last(n))
    out = bars.withColumns({"band_mid": mean, "band_std": std})
    out = out.withColumns({"band_upper": F.col("band_mid") + width * F.col("band_std"), "band_lower": F.col("band_mid") - width * F.col("band_std")})
    span = F.col("band_upper") - F.col("band_lower")
    return out.withColumns({"percent_b": F.when(span <= FLAT, 0.5).otherwise((F.col("close") - F.col("band_lower")) / span), "bandwidth": F.when(F.abs("band_mid") <= FLAT, 0.0).otherwise(span / F.col("band_mid"))})


def with_vwap(bars: DataFrame, day: Column, n: int = 32, ready: int = 10) -> DataFrame:
    """Session VWAP, which begins anew each day, and the deviation from it over its last n values, which does not."""
    w = W.partitionBy("symbol", "session").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    volume = F.sum("volume").over(w)
    out = bars.withColumn("session", day)
    out = out.withColumns({"vwap_s": F.when(volume > 0, F.sum(typical * F.col("volume")).over(w) / volume).otherwise(F.col("close")), "session_bars": F.count("*").over(w)})
    out = out.withColumn("vwap_dev", F.col("close") - F.col("vwap_s"))
    std = F.stddev_pop("vwap_dev").over(last(n))
    return out.withColumns({"vwap_z": F.when(std <= FLAT, 0.0).otherwise(F.col("vwap_dev") / std), "vwap_ready": F.col("session_bars") >= ready})


def with_channel(bars: DataFrame, n: int = 32) -> DataFrame:
    out = bars.withColumns({"channel_high": F.max("high").over(last(n)), "channel_low": F.min("low").over(last(n))})
    return out.withColumn("channel_mid", (F.col("channel_high") + F.col("channel_low")) / 2)


def rank_at_most(column: str, n: int) -> Column:
    """Share of the last n values that are at most the current one; a half for fewer than two."""
    past = F.collect_list(column).over(last(n))
    return F.when(F.size(past) < 2, 0.5).otherwise(F.size(F.filter(past, lambda v: v <= F.col(column))) / F.size(past))


def rank_below(column: str, n: int) -> Column:
    """Share of the other of the last n values that are below the current one; a half for fewer than two."""
    past = F.collect_list(column).over(last(n))
    return F.when(F.size(past) < 2, 0.5).otherwise(F.size(F.filter(past, lambda v: v < F.col(column))) / (F.size(past) - 1))


#: Volatility percentiles that are low and high; drawdown and percentile of a crisis; a run that is fresh.
LOW, HIGH, CRISIS_DRAWDOWN, CRISIS_PERCENTILE, FRESH = 0.30, 0.70, -0.05, 0.90, 20


def regime(percentile: Column, run: Column, drawdown: Column) -> Column:
    """Crisis by loss and volatility, high volatility after a fresh change unless the percentile is low, then the percentile's own."""
    return (
        F.when((drawdown < CRISIS_DRAWDOWN) & (percentile > CRISIS_PERCENTILE), "crisis").when((run < FRESH) & (percentile > LOW), "high_vol")
        .when(percentile < LOW, "low_vol").when(percentile > HIGH, "high_vol").otherwise("normal")
    )


def with_drawdown(rows: DataFrame, pnl: str, by: list[str], order: list[str], start: float = 0.0) -> DataFrame:
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumn("running", F.lit(start) + F.sum(pnl).over(w))
    out = out.withColumn("peak", F.greatest(F.lit(start), F.max("running").over(w)))
    return out.withColumn("drawdown", F.col("peak") - F.col("running"))


def with_warm_up(bars: DataFrame, warm_up: int) -> DataFrame:
    return bars.withColumn("warmed_up", F.row_number().over(by_symbol()) >= max(warm_up, 32))


def dispersion(bars: DataFrame, least: int = 5, days: int = 60, enough: int = 10) -> DataFrame:
    """(day, dispersion, high): spread of log returns among symbols per day, and whether it tops three quarters of the last days.

    One row a day after the grouping, so the window over days is small."""
    out = bars.withColumn("log_return", log_return()).where("log_return <> 0").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.stddev_samp("log_return").alias("dispersion"))
    w = W.orderBy("day").rowsBetween(-(days - 1), 0)
    past = F.sort_array(F.collect_list("dispersion").over(w))
    out = out.where(F.col("n") >= least).withColumn("past", past)
    at = F.get("past", (F.size("past") * 3 / 4).cast("int"))
    return out.select("day", "n", "dispersion", F.when(F.size("past") >= enough, F.col("dispersion") > at).otherwise(False).alias("high"))


def streak(condition: Column, by, order) -> Column:
    """Length of the run of rows, ending here, in which the condition holds."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    n = F.count("*").over(w)
    broke = F.max(F.when(~condition, n)).over(w)
    return F.when(condition, n - F.coalesce(broke, F.lit(0))).otherwise(0)


def session_day(offset_minutes: int = -300) -> Column:
    """Number of the day at a fixed offset from UTC, by which session sums begin anew."""
    return F.floor((F.unix_millis("ts") + offset_minutes * 60_000) / 86_400_000)


#: The columns of a feature row after (symbol, ts), and those of them that only an ordered fold gives.
FEATURES = (
    "return_1", "return_5", "return_20", "sma_20", "sma_50", "atr", "return_std_20", "return_z_score", "relative_volume", "bar_range", "close_location",
    "trend_up", "warmed_up", "ema_fast", "ema_slow", "ema_fast_above_slow", "adx", "plus_di", "minus_di", "bollinger_upper", "bollinger_lower",
    "bollinger_pct_b", "bollinger_bandwidth", "vwap", "vwap_deviation", "vwap_z_score", "vwap_session_bars", "vwap_ready", "donchian_upper", "donchian_lower",
    "donchian_mid", "squeeze", "bandwidth_percentile", "cusum_triggered", "garch_vol", "market_regime", "regime_change_prob", "change_run",
    "garch_vol_percentile", "z_score_percentile",
)
FOLDED = "ema_fast double, ema_slow double, adx double, plus_di double, minus_di double, cusum_triggered boolean, garch_vol double, garch_vol_percentile double, regime_change_prob double, change_run int"


class Recurrences:
    """What of a feature row follows from all bars before, by the bar and the features that windows give."""

    def __init__(self, fast: int = 10, slow: int = 30, garch: tuple[float, float, float, float] = scan.GARCH, ranks: int = 128) -> None:
        self.fast, self.slow, self.garch, self.ranks = 2 / (fast + 1), 2 / (slow + 1), garch, ranks

    def step(self, state: dict, high: float, low: float, close: float, return_1: float, log_return: float, atr: float) -> tuple:
        fast, slow = detectors.seeded_step(state, "fast", close, self.fast), detectors.seeded_step(state, "slow", close, self.slow)
        adx, plus, minus = detectors.adx_step(state, high, low, close)
        threshold = atr / close if close > 0 and atr > 0 else 0.005
        fired = detectors.cusum_step(state, return_1, threshold)
        vol = detectors.garch_step(state, log_return, self.garch)
        change, run = detectors.change_point_step(state, log_return)
        return fast, slow, adx, plus, minus, fired, vol, detectors.rank_below_step(state, "vols", vol, self.ranks), change, run


class FeatureState:
    """A feature row by state alone, as a stream needs it: rings for the windows, and ``Recurrences``.

    ``step`` gives the values of FEATURES in order for a bar; they are those that ``feature_rows`` gives the same bars in order.
    """

    def __init__(self, warm_up: int = 64, offset_minutes: int = -300) -> None:
        self.recurrences, self.warm_up, self.offset = Recurrences(), max(warm_up, 32), offset_minutes

    def step(self, state: dict, millis: int, high: float, low: float, close: float, volume: float, drawdown: float = 0.0) -> tuple:
        mean = lambda x: sum(x) / len(x)
        deviation = lambda x: math.sqrt(sum((v - sum(x) / len(x)) ** 2 for v in x) / len(x))
        closes = detectors.ring_step(state, "closes", close, 64)
        ago = lambda k: 0.0 if len(closes) <= k or closes[-1 - k] == 0 else close / closes[-1 - k] - 1
        before = closes[-2] if len(closes) > 1 else None
        return_1 = ago(1)
        log_return = math.log(close / before) if before is not None and before > 0 and close > 0 else 0.0
        sma, trend = mean(closes[-32:]), mean(closes)
        true_range = high - low if before is None else max(high - low, abs(high - before), abs(low - before))
        atr = mean(detectors.ring_step(state, "ranges", true_range, 16))
        volumes = mean(detectors.ring_step(state, "volumes", volume, 32))
        std = deviation(detectors.ring_step(state, "returns", return_1, 32))
        z = return_1 / std if std > FLAT else 0.0
        band = deviation(closes[-32:])
        upper, lower = sma + 2 * band, sma - 2 * band
        width = (upper - lower) / sma if sma > FLAT else 0.0
        day = (millis + self.offset * 60_000) // 86_400_000
        if state.get("day") != day:
            state.update(day=day, paid=0.0, traded=0.0, bars=0)
        state["paid"] += (high + low + close) / 3 * volume
        state["traded"] += volume
        state["bars"] += 1
        vwap = state["paid"] / state["traded"] if state["traded"] > FLAT else close
        off = deviation(detectors.ring_step(state, "deviations", close - vwap, 32))
        top, bottom = max(detectors.ring_step(state, "highs", high, 32)), min(detectors.ring_step(state, "lows", low, 32))
        wide = round(width, 9)
        widths = detectors.ring_step(state, "widths", wide, 64)
        squeezed = 0.5 if len(widths) < 2 else sum(v <= wide for v in widths) / len(widths)
        fast, slow, adx, plus, minus, fired, vol, rank, change, run = self.recurrences.step(state, high, low, close, return_1, log_return, atr)
        state["count"] = state.get("count", 0) + 1
        if drawdown < CRISIS_DRAWDOWN and rank > CRISIS_PERCENTILE:
            label = "crisis"
        else:
            label = "high_vol" if (run < FRESH and rank > LOW) or rank > HIGH else "low_vol" if rank < LOW else "normal"
        return (
            return_1, ago(5), ago(19), sma, trend, atr, std, z, volume / volumes if volumes > 0 else 1.0, high - low, (close - low) / (high - low) if high > low else 0.5,
            close > trend, state["count"] >= self.warm_up, fast, slow, fast > slow, adx, plus, minus, upper, lower,
            (close - lower) / (upper - lower) if upper - lower > FLAT else 0.5, width, vwap, close - vwap, (close - vwap) / off if off > FLAT else 0.0, int(state["bars"]), state["bars"] >= 10, top, bottom,
            (top + bottom) / 2, squeezed < 0.2, squeezed, fired, vol, label, change, run,
            rank, detectors.rank_below_step(state, "zs", z, 128),
        )


FEATURE_SCHEMA = ", ".join(f"{c} {'boolean' if c in ('trend_up', 'warmed_up', 'ema_fast_above_slow', 'vwap_ready', 'squeeze', 'cusum_triggered') else 'string' if c == 'market_regime' else 'long' if c == 'vwap_session_bars' else 'int' if c == 'change_run' else 'double'}" for c in FEATURES)


def feature_rows(bars: DataFrame, warm_up: int = 64, offset_minutes: int = -300, drawdown: Column | None = None) -> DataFrame:
    """(symbol, ts, FEATURES) of bars: every indicator in one row.

    The bars are dealt by symbol once. All windows share that dealing, and so does the ordered fold after them, which carries
    what no window can: means and filters over all bars before. A symbol's bars are one task's, in Arrow batches; the change
    filter has no parallel form. ``scan`` has the linear ones alone for symbols that hold most bars.
    """
    rows = bars.select("symbol", "ts", *(F.col(c).cast("double").alias(c) for c in ("high", "low", "close", "volume")), (F.lit(0.0) if drawdown is None else drawdown).alias("__loss"))
    rows = rows.repartition("symbol").withColumn("__session", session_day(offset_minutes))
    rows = with_bands(with_zscore(with_channel(with_ranges(with_trend(with_returns(rows))))))
    rows = with_vwap(rows, F.col("__session"))
    rows = rows.withColumn("__wide", F.round("bandwidth", 9))  # sums in another order agree so far
    rows = rows.withColumns({"z_score_percentile": rank_below("return_z", 128), "bandwidth_percentile": rank_at_most("__wide", 64), "warmed_up": F.row_number().over(by_symbol()) >= max(warm_up, 32)})
    span = F.col("high") - F.col("low")
    rows = rows.select(
        "symbol", "ts", "high", "low", "close", "log_return", "__loss", "return_1", "return_5", "return_20", "sma_20", "sma_50", "atr", F.col("return_std").alias("return_std_20"),
        F.col("return_z").alias("return_z_score"), "relative_volume", span.alias("bar_range"), F.when(span > 0, (F.col("close") - F.col("low")) / span).otherwise(0.5).alias("close_location"), "trend_up", "warmed_up",
        F.col("band_upper").alias("bollinger_upper"), F.col("band_lower").alias("bollinger_lower"), F.col("percent_b").alias("bollinger_pct_b"), F.col("bandwidth").alias("bollinger_bandwidth"), F.col("vwap_s").alias("vwap"),
        F.col("vwap_dev").alias("vwap_deviation"), F.col("vwap_z").alias("vwap_z_score"), F.col("session_bars").alias("vwap_session_bars"), "vwap_ready", F.col("channel_high").alias("donchian_upper"), F.col("channel_low").alias("donchian_lower"),
        F.col("channel_mid").alias("donchian_mid"), (F.col("bandwidth_percentile") < 0.2).alias("squeeze"), "bandwidth_percentile", "z_score_percentile",
    )
    recurrences = Recurrences()
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", " + FOLDED
    names = rows.columns
    at = {c: names.index(c) for c in ("high", "low", "close", "return_1", "log_return", "atr")}
    out = scan.fold(rows, "symbol", ["ts"], lambda s, x: recurrences.step(s, *(x[i] for i in at.values())), schema, dealt=True)
    out = out.withColumns({"ema_fast_above_slow": F.col("ema_fast") > F.col("ema_slow"), "market_regime": regime(F.col("garch_vol_percentile"), F.col("change_run"), F.col("__loss"))})
    return out.select("symbol", "ts", *FEATURES)
