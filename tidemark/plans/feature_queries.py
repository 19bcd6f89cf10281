"""Indicator columns over the hourly bars."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import detectors, features as ft, scan
from . import fixtures as fx
from .registry import query
from .table_queries import r, secs

T = "symbol, CAST(epoch(ts) AS BIGINT) AS t"
WS = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"


def win(n):
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def ret(k):
    return f"CASE WHEN coalesce(lag(close, {k}) OVER w, 0) = 0 THEN 0 ELSE close / lag(close, {k}) OVER w - 1 END"


TR = "CASE WHEN lag(close) OVER w IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END"


@query("f01_f02_returns", "bars", f"SELECT {T}, round({ret(1)}, 6) AS return_1, round({ret(5)}, 6) AS return_5, round({ret(19)}, 6) AS return_20, round(CASE WHEN coalesce(lag(close) OVER w, 0) <= 0 THEN 0 ELSE ln(close / lag(close) OVER w) END, 6) AS log_return FROM bars {WS}")
def _(spark, sf):
    return ft.with_returns(fx.bars(spark, sf)).select("symbol", secs(), r("return_1"), r("return_5"), r("return_20"), r("log_return"))


@query("f03_f04_trend", "bars", f"SELECT {T}, round(avg(close) {win(32)}, 9) AS sma_20, round(avg(close) {win(64)}, 9) AS sma_50, close > avg(close) {win(64)} AS trend_up FROM bars")
def _(spark, sf):
    return ft.with_trend(fx.bars(spark, sf)).select("symbol", secs(), r("sma_20", 9), r("sma_50", 9), "trend_up")


@query("f05_f06_ranges", "bars", f"+ x AS (SELECT *, {TR} AS tr FROM bars {WS}) SELECT {T}, round(tr, 6) AS true_range, round(avg(tr) {win(16)}, 6) AS atr, round(volume / avg(volume) {win(32)}, 6) AS relative_volume FROM x")
def _(spark, sf):
    return ft.with_ranges(fx.bars(spark, sf)).select("symbol", secs(), r("true_range"), r("atr"), r("relative_volume"))


@query("f07_f08_return_zscore", "bars", f"+ x AS (SELECT *, {ret(1)} AS r1 FROM bars {WS}), y AS (SELECT *, stddev_pop(r1) {win(32)} AS s FROM x) SELECT {T}, round(s, 6) AS return_std, round(CASE WHEN s <= 1e-10 THEN 0 ELSE r1 / s END, 5) AS return_z FROM y")
def _(spark, sf):
    return ft.with_zscore(ft.with_returns(fx.bars(spark, sf))).select("symbol", secs(), r("return_std"), r("return_z", 5))


@query("g01_reversion_entry_slice", "bars", f"+ x AS (SELECT *, {ret(1)} AS r1, volume / avg(volume) {win(32)} AS rv FROM bars {WS}), y AS (SELECT *, round(r1 / stddev_pop(r1) {win(32)}, 5) AS z FROM x) SELECT {T}, z, round(rv, 6) AS relative_volume FROM y WHERE z < -0.3 AND rv > 1.1")
def _(spark, sf):
    rows = ft.with_zscore(ft.with_returns(ft.with_ranges(fx.bars(spark, sf)))).withColumn("z", F.round("return_z", 5))
    return rows.where("z < -0.3 and relative_volume > 1.1").select("symbol", secs(), "z", r("relative_volume"))


def seeded(value, alpha, source="bars", order="ts"):
    """An EMA by list_reduce, as rows (symbol, ts, y)."""
    return f"(SELECT symbol, unnest(ts) AS ts, unnest(list_transform(range(1, len(v) + 1), lambda k: list_reduce(v[1:k], lambda y, x: {1 - alpha!r} * y + {alpha!r} * x))) AS y FROM (SELECT symbol, list({order} ORDER BY {order}) AS ts, list({value} ORDER BY {order}) AS v FROM {source} GROUP BY 1))"


@query("f09_ema", "bars", f"SELECT a.symbol, CAST(epoch(a.ts) AS BIGINT) AS t, round(a.y, 6) AS fast, round(b.y, 6) AS slow, round(a.y, 6) > round(b.y, 6) AS above FROM {seeded('close', 2 / 11)} a JOIN {seeded('close', 2 / 31)} b USING (symbol, ts)")
def _(spark, sf):
    rows = scan.emas(fx.bars(spark, sf).select("symbol", "ts", "close"), "symbol", "ts", {"fast": ("close", 2 / 11), "slow": ("close", 2 / 31)})
    return rows.select("symbol", secs(), r("fast"), r("slow"), (F.round("fast", 6) > F.round("slow", 6)).alias("above"))


@query("f10_wilder", "bars", f"SELECT symbol, CAST(epoch(ts) AS BIGINT) AS t, round(y, 6) AS wilder FROM {seeded('close', 1 / 14)}")
def _(spark, sf):
    return scan.ema(fx.bars(spark, sf).select("symbol", "ts", "close"), "symbol", "ts", "close", 1 / 14, "wilder").select("symbol", secs(), r("wilder"))


ADX = f"""ad AS (SELECT symbol, ts, high - lag(high) OVER w AS up, lag(low) OVER w - low AS down, {TR} AS tr, lag(close) OVER w AS pc FROM bars {WS}),
ae AS (SELECT symbol, ts, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS p, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS m, tr FROM ad WHERE pc IS NOT NULL),
di AS (SELECT symbol, ts, 100 * p.y / t.y AS pdi, 100 * m.y / t.y AS mdi FROM {seeded('p', 1 / 14, 'ae')} p JOIN {seeded('m', 1 / 14, 'ae')} m USING (symbol, ts) JOIN {seeded('tr', 1 / 14, 'ae')} t USING (symbol, ts) WHERE t.y >= 1e-10),
dx AS (SELECT *, CASE WHEN pdi + mdi <= 1e-10 THEN 0 ELSE 100 * abs(pdi - mdi) / (pdi + mdi) END AS dx FROM di),
adx AS (SELECT b.symbol, b.ts, coalesce(round(pdi, 6), 0) AS plus_di, coalesce(round(mdi, 6), 0) AS minus_di, coalesce(round(a.y, 6), 0) AS adx FROM bars b LEFT JOIN dx USING (symbol, ts) LEFT JOIN {seeded('dx', 1 / 14, 'dx')} a USING (symbol, ts))"""


@query("f11_adx", "bars", f"+ {ADX} SELECT symbol, CAST(epoch(ts) AS BIGINT) AS t, plus_di, minus_di, adx FROM adx")
def _(spark, sf):
    return scan.adx(fx.bars(spark, sf)).select("symbol", secs(), r("plus_di"), r("minus_di"), r("adx"))


@query("f12_bands", "bars", f"+ x AS (SELECT *, avg(close) {win(32)} AS m, stddev_pop(close) {win(32)} AS s FROM bars) SELECT {T}, round(m + 2 * s, 6) AS band_upper, round(m - 2 * s, 6) AS band_lower, round(CASE WHEN 4 * s <= 1e-10 THEN 0.5 ELSE (close - m + 2 * s) / (4 * s) END, 5) AS percent_b, round(4 * s / m, 6) AS bandwidth FROM x")
def _(spark, sf):
    return ft.with_bands(fx.bars(spark, sf)).select("symbol", secs(), r("band_upper"), r("band_lower"), r("percent_b", 5), r("bandwidth"))


SV = "OVER (PARTITION BY symbol, d ORDER BY ts ROWS UNBOUNDED PRECEDING)"


@query("f13_session_vwap", "bars", f"+ b AS (SELECT *, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS d FROM bars), x AS (SELECT *, sum((high + low + close) / 3 * volume) {SV} / sum(volume) {SV} AS v, count(*) {SV} AS n FROM b), y AS (SELECT *, close - v AS dev FROM x), z AS (SELECT *, stddev_pop(dev) {win(32)} AS s FROM y) SELECT {T}, round(v, 6) AS vwap_s, round(dev, 6) + 0.0 AS vwap_dev, round(CASE WHEN s <= 1e-10 THEN 0 ELSE dev / s END, 5) + 0.0 AS vwap_z, n AS session_bars, n >= 10 AS vwap_ready FROM z")
def _(spark, sf):
    return ft.with_vwap(fx.bars(spark, sf), cal.trading_day(F.col("ts"))).select("symbol", secs(), r("vwap_s"), r("vwap_dev"), r("vwap_z", 5), "session_bars", "vwap_ready")


@query("f14_channel", "bars", f"SELECT {T}, round(max(high) {win(32)}, 6) AS channel_high, round(min(low) {win(32)}, 6) AS channel_low, round((max(high) {win(32)} + min(low) {win(32)}) / 2, 6) AS channel_mid FROM bars")
def _(spark, sf):
    return ft.with_channel(fx.bars(spark, sf)).select("symbol", secs(), r("channel_high"), r("channel_low"), r("channel_mid"))


RANK = "CASE WHEN len({l}) < 2 THEN 0.5 ELSE len(list_filter({l}, lambda v: v {c} {x})) / {n} END"


@query("f15_bandwidth_percentile", "bars", f"+ x AS (SELECT *, round(4 * stddev_pop(close) {win(32)} / avg(close) {win(32)}, 6) AS b FROM bars), y AS (SELECT *, list(b) {win(64)} AS l FROM x) SELECT {T}, round({RANK.format(l='l', c='<=', x='b', n='len(l)')}, 6) AS percentile, {RANK.format(l='l', c='<=', x='b', n='len(l)')} < 0.2 AS squeeze FROM y")
def _(spark, sf):
    rows = ft.with_bands(fx.bars(spark, sf)).withColumn("b", F.round("bandwidth", 6)).withColumn("p", ft.rank_at_most("b", 64))
    return rows.select("symbol", secs(), F.round("p", 6).alias("percentile"), (F.col("p") < 0.2).alias("squeeze"))


#: Two one-sided sums of returns r1 against the mean range of a bar as a share of its close.
CUSUM = f"""cx AS (SELECT *, {ret(1)} AS r1, {TR} AS tr, row_number() OVER w AS n FROM bars {WS}),
cy AS (SELECT symbol, ts, n, r1, CASE WHEN close > 0 AND avg(tr) {win(16)} > 0 THEN avg(tr) {win(16)} / close ELSE 0.005 END AS th FROM cx),
fired AS (SELECT DISTINCT symbol, CAST(0 AS BIGINT) AS n, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, false AS fired FROM cy
UNION ALL SELECT symbol, n, CASE WHEN hit THEN 0 ELSE u END, CASE WHEN hit THEN 0 ELSE d END, hit
FROM (SELECT *, u > th OR d < -th AS hit FROM (SELECT cy.symbol, cy.n, cy.th, greatest(0.0, f.up + r1) AS u, least(0.0, f.down + r1) AS d FROM fired f JOIN cy ON cy.symbol = f.symbol AND cy.n = f.n + 1)))"""


@query("f16_cusum", "bars", f"+ {CUSUM.replace('fired AS (SELECT', 'fold AS (SELECT').replace('FROM fired f', 'FROM fold f')} SELECT {T}, round(r1, 6) + 0.0 AS return_1, round(th, 6) AS threshold, fired FROM fold JOIN cy USING (symbol, n)")
def f16(spark, sf):
    """Trigger where a one-sided sum of returns passes the mean range of the bar as a share of its close."""
    threshold = F.when((F.col("close") > 0) & (F.col("atr") > 0), F.col("atr") / F.col("close")).otherwise(0.005)
    rows = ft.with_ranges(ft.with_returns(fx.bars(spark, sf))).select("symbol", "ts", "return_1", threshold.alias("threshold"))
    out = scan.fold(rows, "symbol", ["ts"], lambda s, x: (detectors.cusum_step(s, x.return_1, x.threshold),), "symbol string, ts timestamp, return_1 double, threshold double, fired boolean")
    return out.select("symbol", secs(), r("return_1"), r("threshold"), "fired")


LONG_RUN = 5e-6 / (1 - 0.06 - 0.05 - 0.87)
#: The variance of a bar by the log returns x of the bars before it.
VARIANCE = f"list_reduce(list_prepend({LONG_RUN!r}, v[1:k - 1]), lambda y, x: 5e-6 + (0.06 + CASE WHEN x < 0 THEN 0.10 ELSE 0 END) * x * x + 0.87 * y)"
LOGS = f"lr AS (SELECT symbol, ts, CASE WHEN coalesce(lag(close) OVER w, 0) <= 0 OR close <= 0 THEN 0.0 ELSE ln(close / lag(close) OVER w) END AS x, row_number() OVER w AS n FROM bars {WS})"
GARCH = f"gv AS (SELECT symbol, unnest(ts) AS ts, unnest(list_transform(range(1, len(v) + 1), lambda k: sqrt({VARIANCE}))) AS garch FROM (SELECT symbol, list(ts ORDER BY ts) AS ts, list(x ORDER BY ts) AS v FROM lr GROUP BY 1))"


@query("f17_garch", "bars", f"+ {LOGS}, {GARCH} SELECT {T}, round(garch, 6) AS garch FROM gv")
def _(spark, sf):
    rows = scan.with_previous(fx.bars(spark, sf).select("symbol", "ts", "close"), "symbol", "ts", ["close"])
    usable = (F.col("previous_close") > 0) & (F.col("close") > 0)
    rows = rows.withColumn("log_return", F.when(usable, F.log(F.col("close") / F.col("previous_close"))).otherwise(0.0))
    return scan.garch(rows, "symbol", "ts", "log_return", "garch").select("symbol", secs(), r("garch"))


def change_points(rows):
    """A view ``fold`` (symbol, n, change, run) of the change-point filter over rows (symbol, n, x), by one step a bar."""
    density = """CASE WHEN n[r] > 20 THEN -0.5 * (z2[r] + ln(2 * pi() * v[r])) ELSE lgamma((3 + n[r]) / 2) - lgamma((2 + n[r]) / 2) - 0.5 * ln((2 + n[r]) * pi() * v[r]) - (3 + n[r]) / 2 * ln(1 + z2[r] / (2 + n[r])) END"""
    beta = "0.001 + 0.5 * (q[r] - s[r] * s[r] / greatest(n[r], 1)) + 0.1 * n[r] * pow(s[r] / greatest(n[r], 1), 2) / (2 * (0.1 + n[r]))"
    sums = lambda c, x: f"list_transform(list_prepend(0.0::DOUBLE, {c})[:49], lambda y: y + {x}) || CASE WHEN len(p) >= 49 THEN [0.0::DOUBLE] ELSE [] END"
    lse = lambda c: f"list_max({c}) + ln(list_sum(list_transform({c}, lambda y: exp(y - list_max({c})))))"
    return f"""fold AS (SELECT symbol, n AS i, [0.0::DOUBLE] AS p, [1.0::DOUBLE] AS n, [x] AS s, [x * x] AS q FROM {rows} WHERE n = 1
UNION ALL SELECT symbol, i, list_transform(g, lambda y: y - total), {sums('n', '1')}, {sums('s', 'x')}, {sums('q', 'x * x')}
FROM (SELECT *, {lse('g')} AS total FROM (SELECT *, list_prepend({lse('j')} + ln(1 / 250), list_transform(j, lambda y: y + ln(1 - 1 / 250)))[:50] AS g
FROM (SELECT *, list_transform(range(1, len(p) + 1), lambda r: p[r] + {density}) AS j
FROM (SELECT *, list_transform(range(1, len(p) + 1), lambda r: pow(x - s[r] / (0.1 + n[r]), 2) / v[r]) AS z2
FROM (SELECT f.symbol, a.n AS i, a.x, f.p, f.n, f.s, f.q, list_transform(range(1, len(p) + 1), lambda r: ({beta.replace('n[r]', 'f.n[r]')}) * (1.1 + f.n[r]) / ((1 + f.n[r] / 2) * (0.1 + f.n[r]))) AS v FROM fold f JOIN {rows} a ON a.symbol = f.symbol AND a.n = f.i + 1))))))"""


@query("f19_change_points", "bars", f"+ {LOGS}, {change_points('lr')} SELECT {T}, round(CASE WHEN i = 1 THEN 0 ELSE least(1, exp(p[1])) END, 6) AS change, list_position(p, list_max(p)) - 1 AS run FROM fold JOIN lr ON fold.symbol = lr.symbol AND i = lr.n".replace("SELECT symbol, CAST(epoch(ts) AS BIGINT) AS t, round(CASE", "SELECT lr.symbol, CAST(epoch(ts) AS BIGINT) AS t, round(CASE"))
def f19(spark, sf):
    rows = ft.with_returns(fx.bars(spark, sf)).select("symbol", "ts", "log_return")
    out = scan.fold(rows, "symbol", ["ts"], lambda s, x: detectors.change_point_step(s, x.log_return), "symbol string, ts timestamp, log_return double, change double, run int")
    return out.select("symbol", secs(), r("change"), "run")


@query("f21_drawdown", "trades", "+ x AS (SELECT *, sum(pnl) OVER (PARTITION BY pair_id ORDER BY exit_day, trade_id ROWS UNBOUNDED PRECEDING) AS running FROM trades) SELECT trade_id, pair_id, round(running + 1, 2) AS running, round(greatest(0, max(running) OVER (PARTITION BY pair_id ORDER BY exit_day, trade_id ROWS UNBOUNDED PRECEDING)) - running, 2) AS drawdown FROM x")
def _(spark, sf):
    return ft.with_drawdown(fx.trades(spark, sf), "pnl", ["pair_id"], ["exit_day", "trade_id"]).select("trade_id", "pair_id", F.round(F.col("running") + 1, 2).alias("running"), r("drawdown", 2))


@query("f22_warm_up", "bars", f"SELECT {T}, row_number() OVER w >= 64 AS warmed_up FROM bars {WS}")
def _(spark, sf):
    return ft.with_warm_up(fx.bars(spark, sf), 64).select("symbol", secs(), "warmed_up")


#: Every column of a feature row over a view ``bars``, as views; the last is ``feature``.
FEATURE = f"""{LOGS}, {GARCH}, {CUSUM}, {ADX}, {change_points('lr')},
fa AS (SELECT *, {ret(1)} AS return_1, {ret(5)} AS return_5, {ret(19)} AS return_20, {TR} AS tr, floor((epoch_ms(ts) - 18000000) / 86400000) AS session, row_number() OVER w AS k FROM bars {WS}),
fb AS (SELECT *, avg(close) {win(32)} AS sma_20, avg(close) {win(64)} AS sma_50, avg(tr) {win(16)} AS atr, stddev_pop(return_1) {win(32)} AS rs, avg(volume) {win(32)} AS mv, stddev_pop(close) {win(32)} AS cs,
max(high) {win(32)} AS top, min(low) {win(32)} AS bottom, sum((high + low + close) / 3 * volume) OVER s AS paid, sum(volume) OVER s AS traded, count(*) OVER s AS sb FROM fa WINDOW s AS (PARTITION BY symbol, session ORDER BY ts ROWS UNBOUNDED PRECEDING)),
fc AS (SELECT *, CASE WHEN rs > 1e-10 THEN return_1 / rs ELSE 0 END AS z, CASE WHEN sma_20 > 1e-10 THEN 4 * cs / sma_20 ELSE 0 END AS width, CASE WHEN traded > 1e-10 THEN paid / traded ELSE close END AS vw FROM fb),
fd AS (SELECT *, stddev_pop(close - vw) {win(32)} AS ds, round(width, 9) AS wide, list(round(width, 9)) {win(64)} AS widths, list(z) {win(128)} AS zs FROM fc),
fe AS (SELECT symbol, ts, garch, list(garch) {win(128)} AS vols FROM gv),
ff AS (SELECT symbol, ts, garch, {RANK.format(l='vols', c='<', x='garch', n='(len(vols) - 1)')} AS vp FROM fe),
fg AS (SELECT lr.symbol, lr.ts, CASE WHEN i = 1 THEN 0 ELSE least(1, exp(p[1])) END AS change, list_position(p, list_max(p)) - 1 AS run FROM fold JOIN lr ON fold.symbol = lr.symbol AND i = lr.n),
feature AS (SELECT symbol, ts, return_1, return_5, return_20, sma_20, sma_50, atr, rs AS return_std_20, z AS return_z_score, CASE WHEN mv > 0 THEN volume / mv ELSE 1 END AS relative_volume, high - low AS bar_range,
CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END AS close_location, close > sma_50 AS trend_up, k >= 64 AS warmed_up, ef.y AS ema_fast, es.y AS ema_slow, ef.y > es.y AS ema_fast_above_slow, adx, plus_di, minus_di,
sma_20 + 2 * cs AS bollinger_upper, sma_20 - 2 * cs AS bollinger_lower, CASE WHEN 4 * cs > 1e-10 THEN (close - sma_20 + 2 * cs) / (4 * cs) ELSE 0.5 END AS bollinger_pct_b, width AS bollinger_bandwidth, vw AS vwap, close - vw AS vwap_deviation,
CASE WHEN ds > 1e-10 THEN (close - vw) / ds ELSE 0 END AS vwap_z_score, sb AS vwap_session_bars, sb >= 10 AS vwap_ready, top AS donchian_upper, bottom AS donchian_lower, (top + bottom) / 2 AS donchian_mid,
{RANK.format(l='widths', c='<=', x='wide', n='len(widths)')} AS bandwidth_percentile, {RANK.format(l='widths', c='<=', x='wide', n='len(widths)')} < 0.2 AS squeeze, fired AS cusum_triggered, garch AS garch_vol,
CASE WHEN run < 20 AND vp > 0.3 THEN 'high_vol' WHEN vp < 0.3 THEN 'low_vol' WHEN vp > 0.7 THEN 'high_vol' ELSE 'normal' END AS market_regime, change AS regime_change_prob, run AS change_run, vp AS garch_vol_percentile, {RANK.format(l='zs', c='<', x='z', n='(len(zs) - 1)')} AS z_score_percentile
FROM fd JOIN {seeded('close', 2 / 11)} ef USING (symbol, ts) JOIN {seeded('close', 2 / 31)} es USING (symbol, ts) JOIN adx USING (symbol, ts) JOIN ff USING (symbol, ts) JOIN fg USING (symbol, ts) JOIN cy USING (symbol, ts) JOIN fired ON fired.symbol = cy.symbol AND fired.n = cy.n)"""
OTHER = {"trend_up", "warmed_up", "ema_fast_above_slow", "vwap_session_bars", "vwap_ready", "squeeze", "cusum_triggered", "market_regime", "change_run"}
SHOWN = ", ".join(c if c in OTHER else f"round({c}, 6) + 0.0 AS {c}" for c in ft.FEATURES)


def shown_features(rows):
    return rows.select("symbol", secs(), *(c if c in OTHER else r(c) for c in ft.FEATURES))


@query("f23_feature_pipeline", "bars", f"+ {FEATURE} SELECT {T}, {SHOWN} FROM feature")
def _(spark, sf):
    """Every indicator of every bar, in one row."""
    return shown_features(ft.feature_rows(fx.bars(spark, sf)))


@query("f18_f20_volatility_percentile", "bars", f"+ {FEATURE} SELECT {T}, round(garch_vol_percentile, 6) AS volatility, round(z_score_percentile, 6) AS z, change_run, CASE WHEN k % 50 < 5 AND garch_vol_percentile > 0.9 THEN 'crisis' ELSE market_regime END AS regime FROM feature JOIN (SELECT symbol, ts, row_number() OVER w AS k FROM bars {WS}) USING (symbol, ts)")
def _(spark, sf):
    """Regimes by volatility, change points and, in five of fifty bars, a loss."""
    bars = fx.bars(spark, sf).withColumn("k", F.row_number().over(ft.by_symbol()))
    rows = ft.feature_rows(bars, drawdown=F.when(F.col("k") % 50 < 5, -0.1).otherwise(0.0))
    return rows.select("symbol", secs(), F.round("garch_vol_percentile", 6).alias("volatility"), F.round("z_score_percentile", 6).alias("z"), "change_run", F.col("market_regime").alias("regime"))


@query("f24_dispersion", "bars", f"+ x AS (SELECT CAST(ts AS DATE) AS day, CASE WHEN coalesce(lag(close) OVER w, 0) <= 0 THEN 0 ELSE ln(close / lag(close) OVER w) END AS lr FROM bars {WS}), y AS (SELECT day, count(*) AS n, stddev_samp(lr) AS s FROM x WHERE lr <> 0 GROUP BY 1 HAVING count(*) >= 5), z AS (SELECT *, list_sort(list(s) OVER (ORDER BY day ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) AS l FROM y) SELECT day::VARCHAR AS day, n, round(s, 6) AS dispersion, CASE WHEN len(l) >= 10 THEN s > l[1 + CAST(floor(len(l) * 3 / 4) AS INT)] ELSE false END AS high FROM z")
def _(spark, sf):
    return ft.dispersion(fx.bars(spark, sf)).select(F.col("day").cast("string").alias("day"), "n", r("dispersion"), "high")


@query("f27_streak", "bars", f"+ x AS (SELECT *, {ret(1)} > 0 AS up, row_number() OVER w AS n FROM bars {WS}), y AS (SELECT *, n - row_number() OVER (PARTITION BY symbol, up ORDER BY ts) AS g FROM x) SELECT {T}, CASE WHEN up THEN count(*) OVER (PARTITION BY symbol, up, g ORDER BY ts ROWS UNBOUNDED PRECEDING) ELSE 0 END AS streak FROM y")
def _(spark, sf):
    rows = ft.with_returns(fx.bars(spark, sf))
    return rows.select("symbol", secs(), ft.streak(F.col("return_1") > 0, ["symbol"], ["ts"]).alias("streak"))
