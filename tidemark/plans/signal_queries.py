"""Scores, gates and positions over bars, trades and basket spreads."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import scan, signals as sg, single as sn, stats
from . import fixtures as fx
from .feature_queries import ADX, RANK, T, TR, WS, ret, seeded, win
from .registry import query
from .stat_queries import BV, OU, basket_rows
from .table_queries import day, r, secs

X = f"""+ a AS (SELECT *, {ret(1)} AS r1, {TR} AS tr, round(volume / avg(volume) {win(32)}, 4) AS rv, close > avg(close) {win(64)} AS up, row_number() OVER w % 2 = 0 AS holds, count(*) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sb, max(high) {win(32)} AS ch, min(low) {win(32)} AS cl FROM bars {WS}),
x AS (SELECT *, round(coalesce(r1 / nullif(stddev_pop(r1) {win(32)}, 0), 0), 4) AS z, avg(close) {win(32)} AS m, stddev_pop(close) {win(32)} AS s, avg(tr) {win(16)} AS atr FROM a), y AS (SELECT *, round(CASE WHEN 4 * s <= 1e-10 THEN 0.5 ELSE (close - m + 2 * s) / (4 * s) END, 4) AS pb, list(round(4 * s / m, 6)) {win(64)} AS bl, round(4 * s / m, 6) AS bw FROM x),
v AS (SELECT *, {RANK.format(l='bl', c='<=', x='bw', n='len(bl)')} AS bp FROM y)"""


def scored(spark, sf):
    b = fx.bars(spark, sf).withColumns({"holds": F.row_number().over(W.partitionBy("symbol").orderBy("ts")) % 2 == 0, "sb": F.count("*").over(W.partitionBy("symbol", F.to_date("ts")).orderBy("ts").rowsBetween(W.unboundedPreceding, 0))})
    for add in (ft.with_returns, ft.with_trend, ft.with_ranges, ft.with_zscore, ft.with_bands, ft.with_channel):
        b = add(b)
    b = b.withColumns({"z": F.round("return_z", 4), "pb": F.round("percent_b", 4), "rv": F.round("relative_volume", 4), "bw": F.round("bandwidth", 6)})
    return b.withColumn("bp", ft.rank_at_most("bw", 64))


def unit(x):
    return f"greatest(0.0, least(1.0, {x}))"


def voted(buy, buy_score, sell, sell_score, least_buy, least_sell, source="v"):
    """SQL of side and score, a signal counting if its score is at least the least."""
    b, s = f"({buy}) AND round({buy_score}, 6) >= {least_buy}", f"({sell}) AND round({sell_score}, 6) >= {least_sell}"
    return f" SELECT {T}, CASE WHEN {b} THEN 'buy' WHEN {s} THEN 'sell' END AS side, round(CASE WHEN {b} THEN {buy_score} WHEN {s} THEN {sell_score} END, 6) + 0.0 AS score FROM {source}"


def shown(x, vote):
    side, score = vote
    return x.select("symbol", secs(), side.alias("side"), (F.round(score, 6) + 0.0).alias("score"))


@query("g01_mean_reversion", "bars", X + voted("NOT holds AND z < -0.5 AND rv > 0.8 AND up", "0.6 * abs(-0.5 - z) + 0.4 * (rv - 1)", "holds AND z > 0.5", "z - 0.5", 0.1, 0.1))
def _(spark, sf):
    x = scored(spark, sf)
    return shown(x, sg.reversion_score(F.col("z"), F.col("rv"), F.col("trend_up"), F.col("holds"), 0.5, 0.8, 0.1 - 5e-7))


@query("g01_adaptive_reversion", "bars", X + voted("NOT holds AND bp < 0.2 AND z < 0 AND rv > 0.8 AND up", "0.6 * abs(z) + 0.4 * (rv - 1)", "holds AND z > 0.5", "z - 0.5", 0.1, 0.1))
def _(spark, sf):
    """The percentile mode, on the percentile of the band's width."""
    x = scored(spark, sf)
    return shown(x, sg.reversion_score(F.col("z"), F.col("rv"), F.col("trend_up"), F.col("holds"), 0.5, 0.8, 0.1 - 5e-7, F.col("bp"), 0.2))


@query("g03_breakout", "bars", X + voted("NOT holds AND bp < 0.6 AND pb > 1 AND rv >= 0.9", f"0.4 * {unit('1 - bp')} + 0.3 * {unit('(rv - 1) / 2')} + 0.3 * CASE WHEN atr > 1e-10 THEN {unit('(pb - 1) * 4 * s / atr / 2')} ELSE 0.5 END", "holds AND (pb < 0 OR round((ch + cl) / 2 - ch + 1.5 * atr, 6) < 0)", "greatest(0.1, least(1.0, 1 - pb))", 0.1, 0))
def _(spark, sf):
    x = scored(spark, sf)
    mid = F.round(F.col("channel_mid") - F.col("channel_high") + 1.5 * F.col("atr"), 6)  # against 0, so that sums in another order agree
    return shown(x, sg.breakout_score(F.col("bp") < 0.6, F.col("bp"), F.col("pb"), F.col("band_upper") - F.col("band_lower"), 1.5 * F.col("atr"), mid, F.col("atr"), F.col("rv"), F.col("holds"), 0.9, 1.5, 0.1 - 5e-7))


@query("g04_vwap_reversion", "bars", X + voted("NOT holds AND sb >= 10 AND z <= -0.4 AND rv >= 0.8", f"0.5 * {unit('abs(z + 0.4) / 3')} + 0.3 * {unit('(rv - 1) / 2')} + 0.2 * CASE WHEN sb > 200 THEN 0.5 WHEN sb > 60 THEN 1.0 ELSE 0.3 END", "holds AND sb >= 10 AND z > 0.3", unit("(z - 0.3) / 2"), 0.1, 0))
def _(spark, sf):
    x = scored(spark, sf)
    return shown(x, sg.vwap_score(F.col("z"), F.col("sb"), F.col("rv"), F.col("holds"), 0.4, 0.3, 0.8, 10, 0.1 - 5e-7))


@query("g02_momentum", "bars", X + f", {ADX}, e AS (SELECT v.*, round(f.y, 6) AS fast, round(l.y, 6) AS slow, adx, plus_di, minus_di, row_number() OVER (PARTITION BY v.symbol ORDER BY v.ts) AS k FROM v JOIN {seeded('close', 2 / 11)} f USING (symbol, ts) JOIN {seeded('close', 2 / 31)} l USING (symbol, ts) JOIN adx USING (symbol, ts))" + voted("k % 3 <> 0 AND fast > slow AND adx >= 12 AND plus_di > minus_di AND rv >= 0.8", f"0.5 * {unit('(adx - 12) / 40')} + 0.3 * CASE WHEN atr > 1e-10 THEN {unit('(fast - slow) / atr / 2')} ELSE 0 END + 0.2 * {unit('(rv - 1) / 2')}", "k % 3 = 0 AND NOT fast > slow", f"CASE WHEN atr > 1e-10 THEN {unit('(slow - fast) / atr / 2')} ELSE 0.5 END", 0.1, 0, "e"))
def g02(spark, sf):
    b = scored(spark, sf).withColumn("k", F.row_number().over(W.partitionBy("symbol").orderBy("ts")))
    b = scan.adx(scan.emas(b, "symbol", "ts", {"fast": ("close", 2 / 11), "slow": ("close", 2 / 31)}))
    b = b.withColumns({c: F.round(c, 6) for c in ("fast", "slow", "adx", "plus_di", "minus_di")})
    return shown(b, sg.momentum_score(F.col("fast"), F.col("slow"), F.col("atr"), F.col("adx"), F.col("plus_di"), F.col("minus_di"), F.col("rv"), F.col("k") % 3 == 0, 12.0, 0.8, 0.1 - 5e-7))


@query("g05_vote_combiner", "", """WITH v AS (SELECT user_id, date_trunc('day', ts) AS d, CASE WHEN value > 60 THEN 'buy' WHEN value < 40 THEN 'sell' END AS side, CASE WHEN value > 60 OR value < 40 THEN round(abs(value - 50) / 100, 4) END AS score, CASE event_type WHEN 'click' THEN 2.0 WHEN 'view' THEN 1.0 ELSE 0.5 END AS weight FROM events),
g AS (SELECT user_id, d, sum(CASE side WHEN 'buy' THEN score * weight ELSE 0 END) - sum(CASE side WHEN 'sell' THEN score * weight ELSE 0 END) AS net, count(side) AS voters FROM v GROUP BY 1, 2)
SELECT user_id, CAST(d AS DATE)::VARCHAR AS day, CASE WHEN voters >= 1 AND round(net, 6) >= 0.2 THEN 'buy' WHEN voters >= 1 AND round(net, 6) <= -0.2 THEN 'sell' END AS side, round(net, 6) AS net, voters FROM g""")
def _(spark, sf):
    v = F.col("value")
    votes = fx.ticks(spark, sf).select("user_id", F.to_date("ts").alias("day"), F.col("symbol").alias("name"), F.when(v > 60, "buy").when(v < 40, "sell").alias("side"), F.when((v > 60) | (v < 40), F.round(F.abs(v - 50) / 100, 4)).alias("score"), F.when(F.col("symbol") == "click", 2.0).when(F.col("symbol") == "view", 1.0).otherwise(0.5).alias("weight"))
    return sg.combine(votes, ["user_id", "day"], 0.2 - 5e-7).select("user_id", day(), "side", r("net"), "voters")


EXIT = "WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS price, (l_extendedprice / l_quantity) * (0.9 + 0.2 * l_tax / 0.08) AS entry, CAST(l_quantity AS INT) AS held FROM lineitem)"


@query("g06_exit_rules", "", EXIT + ", y AS (SELECT *, round((price - entry) / entry, 9) AS gain, CASE held % 3 WHEN 0 THEN price * 0.018 WHEN 1 THEN price * 0.012 ELSE 0 END AS dist FROM x) SELECT l_orderkey, l_linenumber, CASE WHEN dist > 0 AND round(price - entry + 2.5 * dist, 9) < 0 THEN 'vol_stop' WHEN dist = 0 AND gain < -0.03 THEN 'stop' WHEN gain > 0.06 THEN 'take_profit' WHEN held >= 40 THEN 'max_hold' END AS reason FROM y")
def _(spark, sf):
    """A third of the positions have a volatility of returns, a third a mean range alone, a third neither."""
    li = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity")).cast("double").alias("price"), "l_tax", F.col("l_quantity").cast("int").alias("held"))
    li = li.withColumn("entry", F.col("price") * (0.9 + 0.2 * F.col("l_tax").cast("double") / 0.08))
    kind = F.col("held") % 3
    return li.select("l_orderkey", "l_linenumber", sg.exit_reason(F.col("price"), F.col("entry"), F.col("held"), F.when(kind == 1, F.col("price") * 0.012).otherwise(0.0), F.when(kind == 0, 0.018).otherwise(0.0), 2.5, 0.03, 0.06, 40).alias("reason"))


DAYW = "(PARTITION BY pair_id, exit_day ORDER BY trade_id ROWS UNBOUNDED PRECEDING)"


@query("g08_kill_switch", "trades", f"+ x AS (SELECT *, sum(pnl) OVER {DAYW} AS d FROM trades) SELECT trade_id, pair_id, round(d, 2) AS day_pnl, min(d) OVER {DAYW} < -100000 AS killed FROM x")
def _(spark, sf):
    return sg.kill_flags(fx.trades(spark, sf), 100000, ["pair_id", "exit_day"], ["trade_id"]).select("trade_id", "pair_id", r("day_pnl", 2), "killed")


AVERAGE = """WITH RECURSIVE o AS (SELECT p_brand AS symbol, l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE -1 END * CAST(l_quantity AS DOUBLE) AS qty, CAST(l_extendedprice / l_quantity AS DOUBLE) AS price, row_number() OVER (PARTITION BY p_brand ORDER BY CAST(l_shipdate AS DATE), l_orderkey, l_linenumber) AS n FROM lineitem JOIN part ON l_partkey = p_partkey),
fold AS (SELECT DISTINCT symbol, CAST(0 AS BIGINT) AS n, 0.0::DOUBLE AS q, 0.0::DOUBLE AS p, 0.0::DOUBLE AS gain FROM o
UNION ALL SELECT o.symbol, o.n, q + qty, CASE WHEN q * qty >= 0 THEN CASE WHEN q + qty = 0 THEN 0 ELSE (q * p + qty * price) / (q + qty) END WHEN abs(qty) > abs(q) THEN price WHEN abs(qty) < abs(q) THEN p ELSE 0 END, CASE WHEN q * qty >= 0 THEN 0 ELSE least(abs(q), abs(qty)) * sign(q) * (price - p) END
FROM fold f JOIN o ON o.symbol = f.symbol AND o.n = f.n + 1)
SELECT symbol, l_orderkey, l_linenumber, q AS held, round(p, 4) + 0.0 AS average, round(gain, 3) + 0.0 AS realised FROM fold JOIN o USING (symbol, n)"""


@query("g11_g12_average_cost", "", AVERAGE)
def g11(spark, sf):
    """Signed quantity, average price and realised profit over fills by symbol; odd lines buy, even ones sell."""

    def step(state, x):
        q, p = state.get("q", 0.0), state.get("p", 0.0)
        gain = 0.0
        if q * x.qty >= 0:
            p = (q * p + x.qty * x.price) / (q + x.qty) if q + x.qty else 0.0
        else:
            closed = min(abs(q), abs(x.qty)) * (1 if q > 0 else -1)
            gain = closed * (x.price - p)
            p = x.price if abs(x.qty) > abs(q) else p if abs(x.qty) < abs(q) else 0.0
        state["q"], state["p"] = q + x.qty, p
        return state["q"], p, gain

    li = fx.lines(spark, sf)
    qty = F.when(F.col("l_linenumber") % 2 == 1, F.col("l_quantity")).otherwise(-F.col("l_quantity")).cast("double")
    rows = li.select(F.col("p_brand").alias("symbol"), "l_shipdate", "l_orderkey", "l_linenumber", qty.alias("qty"), (F.col("l_extendedprice") / F.col("l_quantity")).cast("double").alias("price")).withColumn("l_shipdate", F.to_date("l_shipdate"))
    out = scan.fold(rows, "symbol", ["l_shipdate", "l_orderkey", "l_linenumber"], step, "symbol string, l_shipdate date, l_orderkey long, l_linenumber int, qty double, price double, held double, average double, realised double")
    return out.select("symbol", "l_orderkey", "l_linenumber", "held", r("average", 4), r("realised", 3))


SPW = "(PARTITION BY target ORDER BY day ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)"


@query("g13_pair_z", BV, f"{OU}, z AS (SELECT target, day, CASE WHEN count(*) OVER {SPW} = 40 AND stddev_pop(spread) OVER {SPW} > 1e-10 THEN (spread - avg(spread) OVER {SPW}) / stddev_pop(spread) OVER {SPW} END AS z FROM sp) SELECT target, day::VARCHAR AS day, round(z, 5) AS z FROM z")
def _(spark, sf):
    return sg.pair_z(basket_rows(spark, sf), ["target"], "day", 40).select("target", day(), r("z", 5))


@query("g15_persistence", BV, f"{OU}, z AS (SELECT target, day, CASE WHEN count(*) OVER {SPW} = 40 THEN round((spread - avg(spread) OVER {SPW}) / stddev_pop(spread) OVER {SPW}, 5) END AS z FROM sp), ov AS (SELECT *, coalesce(z > 1, false) AS over_, row_number() OVER (PARTITION BY target ORDER BY day) AS n FROM z), gg AS (SELECT *, n - row_number() OVER (PARTITION BY target, over_ ORDER BY day) AS isle FROM ov), s AS (SELECT *, CASE WHEN over_ THEN count(*) OVER (PARTITION BY target, over_, isle ORDER BY day ROWS UNBOUNDED PRECEDING) ELSE 0 END AS streak FROM gg) SELECT target, day::VARCHAR AS day, streak FROM s WHERE streak >= 2")
def _(spark, sf):
    rows = sg.pair_z(basket_rows(spark, sf), ["target"], "day", 40).withColumn("over", F.coalesce(F.round("z", 5) > 1, F.lit(False)))
    return rows.select("target", day(), ft.streak(F.col("over"), ["target"], ["day"]).alias("streak")).where("streak >= 2")


@query("g16_decayed_exit", "", "WITH x AS (SELECT o_orderkey AS id, (o_orderkey % 100) / 100.0 AS z, o_orderkey % 23 AS held FROM orders) SELECT id, CASE WHEN held >= 20 THEN 'max_hold' WHEN round(abs(z), 9) < round(0.5 - 0.4 * least(1.0, held / 20), 9) THEN 'reversion' END AS reason FROM x")
def _(spark, sf):
    k = F.col("o_orderkey")
    o = fx.table(spark, sf, "orders").select(k.alias("id"), ((k % 100) / 100.0).cast("double").alias("z"), (k % 23).alias("held"))
    return o.select("id", sg.decayed_exit(F.col("z"), F.col("held"), F.lit(20)).alias("reason"))


BEFORE = "(PARTITION BY pair_id ORDER BY exit_day, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
KELLY = "(({p}) * ({b}) - (1 - {p})) / ({b})".format(p="((12 + w) / (20 + w + l))", b="(CASE WHEN w > 0 THEN won / w ELSE 1 END / greatest(CASE WHEN l > 0 THEN lost / l ELSE 1 END, 1e-10))")
SIZED = f"""+ x AS (SELECT *, round(sum(pnl) OVER {DAYW}, 2) AS d, coalesce(count(*) FILTER (pnl > 0) OVER {BEFORE}, 0) AS w, coalesce(count(*) FILTER (pnl <= 0) OVER {BEFORE}, 0) AS l, coalesce(sum(pnl) FILTER (pnl > 0) OVER {BEFORE}, 0) AS won, coalesce(-sum(pnl) FILTER (pnl <= 0) OVER {BEFORE}, 0) AS lost FROM trades),
y AS (SELECT *, min(d) OVER {DAYW} < -200000 AS killed, CASE WHEN pnl > 0 THEN 'buy' ELSE 'sell' END AS side, round(abs(pnl) / capital_per_leg / 20, 6) AS score, round(capital_per_leg / 200, 2) AS price, CASE WHEN hold_days > 2 THEN hold_days ELSE 0 END::DOUBLE AS holding, CASE exit_reason WHEN 'F' THEN 'low_vol' WHEN 'P' THEN 'crisis' ELSE 'high_vol' END AS regime,
CASE WHEN {KELLY} > 0 THEN least(1, ({KELLY}) * greatest(0.2, 1 - 4 * sqrt((12 + w) * (8 + l) / ((20 + w + l) * (20 + w + l) * (21.0 + w + l))))) ELSE 0 END AS kelly FROM x),
z AS (SELECT *, 10000 / price * least(0.8, greatest(0.05, kelly * CASE regime WHEN 'low_vol' THEN 0.6 WHEN 'crisis' THEN 0.1 ELSE 0.25 END * pow(1 - CASE WHEN d < 0 THEN least(1.0, -d / 200000) ELSE 0 END, 2))) AS size FROM y),
v AS (SELECT *, CASE WHEN price > 1000 THEN size ELSE floor(least(size, 100)) END AS shares FROM z),
u AS (SELECT *, CASE WHEN killed THEN 'kill_switch' WHEN score < 0.006 THEN 'cost_filter' WHEN side = 'sell' AND holding <= 0 THEN 'no_position' WHEN side = 'buy' AND kelly <= 0 THEN 'no_edge' WHEN side = 'buy' AND shares <= 0 THEN 'position_size' END AS reason FROM v)
SELECT trade_id, side, round(kelly, 6) AS kelly, round(CASE WHEN reason IS NULL THEN CASE WHEN side = 'sell' THEN holding ELSE shares END END, 5) AS quantity, reason FROM u"""


@query("g07_risk_sizing", "trades", SIZED)
def _(spark, sf):
    """Sizes of trades as if they were signals: by their day's loss so far, Kelly's share of the pair's trades before, and regime."""
    w = W.partitionBy("pair_id").orderBy("exit_day", "trade_id").rowsBetween(W.unboundedPreceding, -1)
    own = W.partitionBy("pair_id", "exit_day").orderBy("trade_id").rowsBetween(W.unboundedPreceding, 0)
    up, pnl = F.col("pnl") > 0, F.col("pnl")
    past = lambda x: F.coalesce(F.sum(x).over(w), F.lit(0.0))
    t = fx.trades(spark, sf).withColumns({"d": F.round(F.sum("pnl").over(own), 2), "wins": past(up.cast("double")), "losses": past((~up).cast("double")), "won": past(F.when(up, pnl).otherwise(0.0)), "lost": past(F.when(up, 0.0).otherwise(-pnl))})
    regime = F.when(F.col("exit_reason") == "F", "low_vol").when(F.col("exit_reason") == "P", "crisis").otherwise("high_vol")
    t = t.withColumns({"killed": F.min("d").over(own) < -200_000, "side": F.when(up, "buy").otherwise("sell"), "score": F.round(F.abs("pnl") / F.col("capital_per_leg") / 20, 6), "price": F.round(F.col("capital_per_leg") / 200, 2), "holding": F.when(F.col("hold_days") > 2, F.col("hold_days")).otherwise(0).cast("double"), "regime": regime, "kelly": sn.kelly_columns(F.col("wins"), F.col("losses"), F.col("won"), F.col("lost"))})
    shares, reason = sn.sized_columns(*(F.col(c) for c in ("side", "score", "price", "holding", "d", "killed", "kelly", "regime")), limits={"kelly": True, "daily_loss": 200_000.0})
    return t.select("trade_id", "side", r("kelly"), F.round(shares, 5).alias("quantity"), reason.alias("reason"))


@query("g18_loss_pause", "trades", "SELECT trade_id, (count(*) OVER l = 5 AND max(pnl) OVER l < 0) OR (count(*) OVER s = 3 AND bool_and(exit_reason = 'F') OVER s) AS pause FROM trades WINDOW l AS (PARTITION BY pair_id ORDER BY exit_day, trade_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), s AS (PARTITION BY pair_id ORDER BY exit_day, trade_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def _(spark, sf):
    return sg.loss_pause(fx.trades(spark, sf), ["pair_id"], ["exit_day", "trade_id"]).select("trade_id", "pause")


@query("g19_entry_cap", "trades", "SELECT trade_id, exit_day::VARCHAR AS day, row_number() OVER (PARTITION BY exit_day ORDER BY pnl DESC, trade_id) AS place, row_number() OVER (PARTITION BY exit_day ORDER BY pnl DESC, trade_id) <= 3 AS admitted FROM trades")
def _(spark, sf):
    return sg.entry_cap(fx.trades(spark, sf), "exit_day", "pnl", "trade_id", 3).select("trade_id", day("exit_day"), "place", "admitted")


CAPPED = """+ e AS (SELECT trade_id, pair_id, CAST(exit_day - DATE '1990-01-01' AS BIGINT) AS leaves, CAST(exit_day - DATE '1990-01-01' AS BIGINT) - hold_days AS enters, pnl FROM trades), o AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY enters, pnl DESC, trade_id) AS n FROM e),
fold AS (SELECT DISTINCT pair_id, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS day, 0 AS today, []::BIGINT[] AS ends, 0 AS before, 0 AS now, false AS admitted FROM o
UNION ALL SELECT pair_id, n, enters, t + ok::INT, CASE WHEN ok THEN live || [leaves] ELSE live END, t, len(live), ok FROM (SELECT *, t < 2 AND len(live) < 6 AS ok FROM (SELECT o.pair_id, o.n, o.enters, o.leaves, CASE WHEN f.day = o.enters THEN f.today ELSE 0 END AS t, list_filter(f.ends, lambda x: x > o.enters) AS live FROM fold f JOIN o ON o.pair_id = f.pair_id AND o.n = f.n + 1)))
SELECT trade_id, before AS today, now AS open, admitted FROM fold JOIN o USING (pair_id, n)"""


@query("g19_concurrency_cap", "trades", CAPPED)
def _(spark, sf):
    """Entries of each run, in order: two a day and six open at most, by the days on which the admitted ones are left."""
    from_ = lambda c: F.datediff(c, F.lit("1990-01-01").cast("date")).cast("long")
    rows = fx.trades(spark, sf).select("trade_id", "pair_id", (from_("exit_day") - F.col("hold_days")).alias("enters"), from_("exit_day").alias("leaves"), (-F.col("pnl")).alias("first"))
    caps = sg.EntryCaps(2, 6)
    schema = "trade_id long, pair_id string, enters long, leaves long, first double, today int, open int, admitted boolean"
    return scan.fold(rows, "pair_id", ["enters", "first", "trade_id"], lambda s, x: caps.step(s, x.enters, x.leaves), schema).select("trade_id", "today", "open", "admitted")


ZS = f"{OU}, z AS (SELECT sp.target, sp.sector, sp.day, round((spread - mu) / sigma_eq, 5) AS z, 0.9 AS k FROM sp JOIN fit USING (target) WHERE mu IS NOT NULL), pos AS (SELECT *, coalesce(last_value(CASE WHEN z < -k THEN 1 WHEN z > k THEN -1 END IGNORE NULLS) OVER (PARTITION BY target ORDER BY day), 0) AS position FROM z)"


def basket_positions(spark, sf, key="p_brand", k=0.9):
    """(sector, target, day, z, k, position) of every basket with a fit; the thresholds are frozen."""
    spread = basket_rows(spark, sf, key)
    fit = stats.ou_fit(spread, ["sector", "target"]).where("mu is not null").select("target", "mu", "sigma_eq")
    z = spread.join(fit, "target").select("sector", "target", "day", F.round((F.col("spread") - F.col("mu")) / F.col("sigma_eq"), 5).alias("z"), F.lit(k).alias("k"))
    return sg.frozen_position(z, ["target"], ["day"])


@query("g20_g21_basket_positions", BV, f"{ZS} SELECT target, day::VARCHAR AS day, z, position FROM pos")
def _(spark, sf):
    return basket_positions(spark, sf).select("target", day(), "z", "position")


POLICY = f"""{OU}, zz AS (SELECT target, day, row_number() OVER v AS n, count(*) OVER c AS past, avg(spread) OVER c AS m, stddev_pop(spread) OVER c AS s, spread FROM sp WINDOW v AS (PARTITION BY target ORDER BY day), c AS (PARTITION BY target ORDER BY day ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
e AS (SELECT target, day, n, CASE WHEN past >= 2 THEN CASE WHEN s > 1e-10 THEN (spread - m) / s ELSE 0 END END AS z FROM zz),
fold AS (SELECT DISTINCT target, CAST(0 AS BIGINT) AS n, 0 AS side, 0 AS run, 0 AS position FROM e
UNION ALL SELECT target, n, side, run, CASE WHEN z IS NULL THEN position WHEN position <> 0 AND abs(z) < 0.5 THEN 0 WHEN side <> 0 AND side <> position AND run >= 2 THEN side ELSE position END
FROM (SELECT target, n, z, position, CASE WHEN z IS NULL THEN was ELSE side END AS side, CASE WHEN z IS NULL THEN run WHEN side = 0 THEN 0 WHEN side = was THEN run + 1 ELSE 1 END AS run
FROM (SELECT e.target, e.n, e.z, f.position, f.run, f.side AS was, CASE WHEN e.z > 1.5 THEN -1 WHEN e.z < -1.5 THEN 1 ELSE 0 END AS side FROM fold f JOIN e ON e.target = f.target AND e.n = f.n + 1)))
SELECT target, day::VARCHAR AS day, round(z, 5) + 0.0 AS score, position FROM fold JOIN e USING (target, n)"""


@query("g22_rolling_policy", BV, POLICY)
def g22(spark, sf):
    policy = sg.RollingScore(confirm=2)
    out = scan.fold(basket_rows(spark, sf).select("target", "day", "spread"), "target", ["day"], lambda s, x: policy.step(s, x.spread), "target string, day date, spread double, score double, position int")
    return out.select("target", day(), r("score", 5), "position")


@query("g22_raw_entry", BV, POLICY.replace("CASE WHEN e.z > 1.5 THEN -1 WHEN e.z < -1.5 THEN 1 ELSE 0 END AS side", "CASE WHEN e.spread > 0.05 THEN -1 WHEN e.spread < -0.05 THEN 1 ELSE 0 END AS side").replace("CASE WHEN past >= 2 THEN CASE WHEN s > 1e-10 THEN (spread - m) / s ELSE 0 END END AS z FROM zz", "CASE WHEN past >= 2 THEN CASE WHEN s > 1e-10 THEN (spread - m) / s ELSE 0 END END AS z, spread FROM zz"))
def _(spark, sf):
    """The rolling policy whose entries go by the spread itself."""
    policy = sg.RollingScore(confirm=2, raw=0.05)
    out = scan.fold(basket_rows(spark, sf).select("target", "day", "spread"), "target", ["day"], lambda s, x: policy.step(s, x.spread), "target string, day date, spread double, score double, position int")
    return out.select("target", day(), r("score", 5), "position")


@query("g23_transitions", BV, f"{ZS}, t AS (SELECT *, coalesce(lag(position) OVER (PARTITION BY target ORDER BY day), 0) AS b FROM pos) SELECT target, day::VARCHAR AS day, position, CASE WHEN b = 0 THEN CASE WHEN position > 0 THEN 'open_long' ELSE 'open_short' END WHEN position = 0 THEN 'close' ELSE 'flip' END AS reason FROM t WHERE position <> b")
def _(spark, sf):
    return sg.transitions(basket_positions(spark, sf), ["target"], ["day"]).select("target", day(), "position", "reason")


@query("g24_day_summary", BV, f"{ZS}, t AS (SELECT *, coalesce(lag(position) OVER (PARTITION BY target ORDER BY day), 0) AS b FROM pos) SELECT day::VARCHAR AS day, count(*) AS evaluated, count(*) FILTER (WHERE abs(z) > 0.75 * k) AS near, count(*) FILTER (WHERE position <> b) AS changed FROM t GROUP BY 1")
def _(spark, sf):
    p = basket_positions(spark, sf)
    return sg.day_summary(p, sg.transitions(p, ["target"], ["day"])).select(day(), "evaluated", "near", "changed")


SECT = "+ rt AS (SELECT c.symbol, sector, day, close / lag(close) OVER (PARTITION BY c.symbol ORDER BY day) - 1 AS ret FROM closes c JOIN sectors USING (symbol)), sd AS (SELECT sector, day, avg(ret) AS ret, avg(CAST(ret > 0 AS INT)) AS breadth FROM rt WHERE ret IS NOT NULL GROUP BY 1, 2)"


def sector_days(spark, sf):
    c = fx.closes(spark, sf).join(fx.sectors(spark, sf), "symbol")
    c = c.withColumn("ret", F.col("close") / F.lag("close").over(W.partitionBy("symbol").orderBy("day")) - 1).where("ret is not null")
    return c.groupBy("sector", "day").agg(F.avg("ret").alias("ret"), F.avg((F.col("ret") > 0).cast("int")).alias("breadth"))


@query("a18_sector_breadth", "closes sectors", f"{SECT} SELECT sector, day::VARCHAR AS day, round(ret, 6) AS ret, round(breadth, 6) AS breadth FROM sd")
def _(spark, sf):
    return sector_days(spark, sf).select("sector", day(), r("ret"), r("breadth"))


@query("f26_sector_leadership", "closes sectors", f"{SECT}, w AS (SELECT sector, day, count(*) OVER q AS n, exp(sum(ln(1 + ret)) OVER q) - 1 AS r5, avg(breadth) OVER q AS b5 FROM sd WINDOW q AS (PARTITION BY sector ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT sector, day::VARCHAR AS day, round(r5, 6) AS ret_5, round(b5, 6) AS breadth_5 FROM w WHERE n = 5")
def _(spark, sf):
    w = W.partitionBy("sector").orderBy("day").rowsBetween(-4, 0)
    s = sector_days(spark, sf).select("sector", "day", F.count("*").over(w).alias("n"), (F.exp(F.sum(F.log(1 + F.col("ret"))).over(w)) - 1).alias("ret_5"), F.avg("breadth").over(w).alias("breadth_5"))
    return s.where("n = 5").select("sector", day(), r("ret_5"), r("breadth_5"))


LEADS = f"""{SECT}, o AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY day) AS n FROM sd),
fold AS (SELECT DISTINCT sector, CAST(0 AS BIGINT) AS n, 0 AS run, 0 AS days, false AS leads FROM o
UNION ALL SELECT sector, n, run, CASE WHEN leads THEN days + 1 WHEN run >= 2 THEN 0 ELSE days END, CASE WHEN leads THEN NOT (days + 1 >= 3 AND ret <= 0 AND breadth <= 0.5) ELSE run >= 2 END
FROM (SELECT o.sector, o.n, o.ret, o.breadth, f.days, f.leads, CASE WHEN o.ret > 0 AND o.breadth > 0.5 THEN f.run + 1 ELSE 0 END AS run FROM fold f JOIN o ON o.sector = f.sector AND o.n = f.n + 1))
SELECT sector, day::VARCHAR AS day, round(ret, 6) + 0.0 AS ret, round(breadth, 6) AS breadth, leads FROM fold JOIN o USING (sector, n)"""


@query("g25_leadership_fold", "closes sectors", LEADS)
def g25(spark, sf):
    rule = sg.Leadership()
    out = scan.fold(sector_days(spark, sf), "sector", ["day"], lambda s, x: (rule.step(s, x.ret, x.breadth),), "sector string, day date, ret double, breadth double, leads boolean")
    return out.select("sector", day(), r("ret"), r("breadth"), "leads")


def overlay_days(spark, sf):
    """What the overlay rule looks at, a row a day of the strategy's equity: return and drawdown over 20 days, and leadership,
    conflict and room from how the day's trades went."""
    from ..operators.book import exposure_gate

    d = fx.trades(spark, sf).groupBy(F.col("exit_day").alias("day")).agg((F.count_if(F.col("pnl") > 0) / F.count("*")).alias("won"), (F.count_if(F.col("exit_reason") == "P") / F.count("*")).alias("conflict"))
    gate = exposure_gate(fx.equity(spark, sf)).select("day", "ret", "drawdown")
    return d.join(gate, "day").select(F.lit("run").alias("run_id"), "day", (F.col("won") > 0.4).alias("leading"), "conflict", "ret", "drawdown", (0.5 + F.col("won")).alias("room"))


OVERLAID = """+ dd AS (SELECT exit_day AS day, count(*) FILTER (pnl > 0) / count(*) AS won, count(*) FILTER (exit_reason = 'P') / count(*) AS conflict FROM trades GROUP BY 1),
gt AS (SELECT day, equity / first_value(equity) OVER q - 1 AS ret, (max(equity) OVER q - equity) / max(equity) OVER q AS fall FROM equity WINDOW q AS (ORDER BY day ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
od AS (SELECT day, row_number() OVER (ORDER BY day) AS n, won > 0.4 AS led, conflict, ret, fall, 0.5 + won AS room FROM dd JOIN gt USING (day)),
fold AS (SELECT CAST(0 AS BIGINT) AS n, 'basket' AS mode, 0 AS dwell, 0 AS off, ''::VARCHAR AS reason
UNION ALL SELECT n, CASE WHEN split_part(move, ':', 2) IN ('dwell', 'active') THEN mode ELSE split_part(move, ':', 1) END, CASE WHEN dwell > 0 THEN dwell - 1 WHEN mode = 'basket' AND split_part(move, ':', 1) <> 'basket' THEN 5 ELSE 0 END,
CASE WHEN dwell > 0 THEN off WHEN mode = 'basket' OR split_part(move, ':', 2) = 'cleared' THEN 0 ELSE off1 END, split_part(move, ':', 2)
FROM (SELECT *, CASE WHEN dwell > 0 THEN mode || ':dwell' WHEN mode <> 'basket' THEN CASE WHEN off1 >= 2 THEN 'basket:cleared' ELSE mode || ':active' END WHEN NOT led THEN 'basket:no_leadership'
WHEN conflict >= 0.15 AND ret >= 0.03 AND fall <= 0.03 THEN 'suppress:conflict' WHEN room >= 0.70 AND (ret <= 0 OR fall >= 0.05 OR ret <= 0.03) THEN 'sleeve:weak_basket' WHEN room >= 0.85 AND ret <= 0.10 AND conflict < 0.15 THEN 'sleeve:spare_room' WHEN ret <= 0 OR fall >= 0.05 THEN 'basket:crowded' ELSE 'basket:healthy' END AS move
FROM (SELECT o.*, f.mode, f.dwell, f.off, CASE WHEN NOT led OR (f.mode = 'suppress' AND conflict <= 0.05) THEN f.off + 1 ELSE 0 END AS off1 FROM fold f JOIN od o ON o.n = f.n + 1)))
SELECT day::VARCHAR AS day, mode, reason, CASE WHEN mode <> 'sleeve' THEN 0.0 WHEN fall >= 0.10 THEN 0.25 WHEN fall >= 0.05 AND ret >= 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS scale FROM fold JOIN od USING (n)"""


@query("g26_overlay_rule", "trades equity", OVERLAID)
def g26(spark, sf):
    rule = sg.OverlayRule()
    out = scan.fold(overlay_days(spark, sf), "run_id", ["day"], lambda s, x: rule.step(s, x.leading, x.conflict, x.ret, x.drawdown, x.room), "run_id string, day date, leading boolean, conflict double, ret double, drawdown double, room double, mode string, reason string, scale double")
    return out.select(day(), "mode", "reason", "scale")


@query("g27_fixed_overlay", "equity", "SELECT day::VARCHAR AS day, 'fixed' AS picker, 'suppress' AS mode, 0.0 AS scale FROM equity UNION ALL SELECT day::VARCHAR, 'none', 'basket', 0.0 FROM equity")
def _(spark, sf):
    """The pickers that always choose the same: one given mode, or the basket alone."""
    days = overlay_days(spark, sf)
    out = [sg.fixed_overlay(days, p, m).select(day(), "picker", "mode", "scale") for p, m in (("fixed", "suppress"), ("none", "basket"))]
    return out[0].unionByName(out[1])


@query("g28_f25_exposure_gate", "equity", "+ w AS (SELECT day, equity / first_value(equity) OVER q - 1 AS ret, (max(equity) OVER q - equity) / max(equity) OVER q AS dd, count(*) OVER q AS n FROM equity WINDOW q AS (ORDER BY day ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)) SELECT day::VARCHAR AS day, round(ret, 8) AS ret, round(dd, 8) AS drawdown, CASE WHEN n < 21 THEN 1.0 WHEN round(ret, 8) < 0 OR round(dd, 8) > 0.05 THEN 0.0 ELSE 1.0 END::DOUBLE AS scale FROM w")
def _(spark, sf):
    from ..operators.book import exposure_gate

    return exposure_gate(fx.equity(spark, sf)).select(day(), r("ret", 8), r("drawdown", 8), "scale")
