"""The single-symbol machine over bars and over a stream: votes, decisions, fills, trades."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import scan
from ..operators import single as sn
from ..streaming import streams as st
from . import fixtures as fx
from .feature_queries import FEATURE, OTHER, T
from .registry import query
from .signal_queries import unit
from .stream_queries import CLOSED, ticks
from .table_queries import r, secs

#: Limits under which the fixture's bars make the machine trade, and its weights; no limit is a value that volumes come to.
TRIAL = {
    "reversion_sell_z": 0.8, "reversion_volume": 1.013, "reversion_score": 0.2, "reversion_trend": False, "momentum_adx": 12.0, "momentum_volume": 0.807, "momentum_score": 0.15,
    "vwap_buy_z": -0.5, "vwap_sell_z": 0.8, "vwap_volume": 0.807, "vwap_score": 0.2, "vwap_skip": 10, "breakout_volume": 1.013, "breakout_stop": 1.5, "breakout_score": 0.2, "net": 0.1,
    "stop": 0.2, "take": 0.5, "longest": 12, "least": 2, "kelly": True, "prior_wins": 480.0, "prior_losses": 20.0, "daily_loss": 2000.0, "reversion_buy_z": -0.3,
}
LIMITS = sn.LIMITS | TRIAL
WEIGHTS = {"mean_reversion": 0.5, "momentum": 0.5, "vwap_reversion": 0.3, "breakout": 0.3}


def _apart(x, flat):
    return f"CASE WHEN atr > 1e-10 THEN {unit(f'({x}) / atr / 2')} ELSE {flat} END"


def _least(score, least):
    return f"CASE WHEN {score} >= {least} THEN {score} END"


def vote_views(c):
    """A view ``ev`` of feature rows with the score of each strategy's buy (b1 to b4, without a holding) and sell (s1 to s4)."""
    volume = unit("(relative_volume - 1) / 2")
    adx, below, rise = f"(adx - {c['momentum_adx']}) / 40", f"abs(vwap_z_score - {c['vwap_buy_z']}) / 3", f"return_z_score - {c['reversion_sell_z']}"
    b1 = f"0.6 * abs({c['reversion_buy_z']} - return_z_score) + 0.4 * (relative_volume - 1)"
    b2 = f"0.5 * {unit(adx)} + 0.3 * {_apart('ema_fast - ema_slow', '0')} + 0.2 * {volume}"
    b3 = f"0.5 * {unit(below)} + 0.3 * {volume} + 0.2 * CASE WHEN vwap_session_bars > 200 THEN 0.5 WHEN vwap_session_bars > 60 THEN 1.0 ELSE 0.3 END"
    b4 = f"0.4 * {unit('1 - bandwidth_percentile')} + 0.3 * {volume} + 0.3 * CASE WHEN atr > 1e-10 THEN {unit('(bollinger_pct_b - 1) * (bollinger_upper - bollinger_lower) / atr / 2')} ELSE 0.5 END"
    above, on = f"(vwap_z_score - {c['vwap_sell_z']}) / 2", f"warmed_up AND vwap_ready AND vwap_session_bars >= {c['vwap_skip']}"
    return f"""ev AS (SELECT feature.*, open, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n, floor((epoch_ms(ts) - 18000000) / 86400000) AS d,
CASE WHEN warmed_up AND return_z_score < {c['reversion_buy_z']} AND relative_volume > {c['reversion_volume']} THEN {_least(b1, c['reversion_score'])} END AS b1,
CASE WHEN warmed_up AND {rise} > 0 AND {rise} >= {c['reversion_score']} THEN {rise} END AS s1,
CASE WHEN warmed_up AND ema_fast_above_slow AND adx >= {c['momentum_adx']} AND plus_di > minus_di AND relative_volume >= {c['momentum_volume']} THEN {_least(b2, c['momentum_score'])} END AS b2,
CASE WHEN warmed_up AND NOT ema_fast_above_slow THEN {_apart('ema_slow - ema_fast', '0.5')} END AS s2,
CASE WHEN {on} AND vwap_z_score <= {c['vwap_buy_z']} AND relative_volume >= {c['vwap_volume']} THEN {_least(b3, c['vwap_score'])} END AS b3,
CASE WHEN {on} AND vwap_z_score > {c['vwap_sell_z']} THEN {unit(above)} END AS s3,
CASE WHEN warmed_up AND squeeze AND bollinger_pct_b > 1 AND relative_volume >= {c['breakout_volume']} THEN {_least(b4, c['breakout_score'])} END AS b4,
CASE WHEN warmed_up AND (bollinger_pct_b < 0 OR donchian_mid < donchian_upper - {c['breakout_stop']} * atr) THEN least(1, greatest(0.1, 1 - bollinger_pct_b)) END AS s4 FROM feature JOIN bars USING (symbol, ts))"""


def _votes(regime, holds):
    """Weighted votes v1 to v4 under the regime's multiplier, positive for buys."""
    out = []
    for i, (name, multipliers) in enumerate(sn.MULTIPLIERS.items(), 1):
        scale = f"{WEIGHTS[name]} * CASE {regime} " + " ".join(f"WHEN '{g}' THEN {m}" for g, m in zip(sn.REGIMES, multipliers)) + " END"
        out.append(f"CASE WHEN {holds} THEN -s{i} ELSE b{i} END * {scale} AS v{i}")
    return ", ".join(out)


V = ("v1", "v2", "v3", "v4")
COUNTED = " + ".join(f"({v} IS NOT NULL)::INT" for v in V)
NET = " + ".join(f"coalesce({v}, 0)" for v in V)
SELLERS = " + ".join(f"coalesce(({v} <= 0)::INT, 0)" for v in V)
_named = lambda end: " ".join(f"WHEN {v} THEN '{n}_{end}'" for v, n in zip(V, sn.STRATEGIES))
BEST = f"CASE WHEN net > 0 THEN CASE greatest(v1, v2, v3, v4) {_named('buy')} END ELSE CASE least(v1, v2, v3, v4) {_named('sell')} END END"


def machine_views(c):
    """A view ``eng`` (symbol, n, ...) of the machine's decisions and fills, by one step a bar."""
    a, b = f"({c['prior_wins']} + w1)", f"({c['prior_losses']} + l1)"
    p, spread = f"({a} / ({a} + {b}))", f"sqrt({a} * {b} / (pow({a} + {b}, 2) * ({a} + {b} + 1)))"
    ratio = "(CASE WHEN w1 > 0 THEN won1 / w1 ELSE 1 END / greatest(CASE WHEN l1 > 0 THEN lost1 / l1 ELSE 1 END, 1e-10))"
    share = f"(({p} * {ratio} - (1 - {p})) / {ratio})"
    part = "CASE regime " + " ".join(f"WHEN '{g}' THEN {k}" for g, k in zip(sn.REGIMES, sn.KELLY)) + " END"
    zero, text = "0.0::DOUBLE", "''::VARCHAR"
    return f"""eng AS (SELECT symbol, CAST(0 AS BIGINT) AS n, {zero} AS pend, {zero} AS pq, {text} AS pr, {zero} AS q, {zero} AS en, CAST(0 AS BIGINT) AS eb, {zero} AS day, {zero} AS dp, false AS killed, {zero} AS w, {zero} AS l, {zero} AS won, {zero} AS lost, {zero} AS eq, {zero} AS pk,
{text} AS regime, 0 AS voters, {text} AS side, {zero} AS score, {text} AS reason, {text} AS rejection, {zero} AS quantity, {text} AS fill_side, {zero} AS fill_quantity, {zero} AS fill_price, {zero} AS fill_pnl, {text} AS fill_reason, CAST(0 AS BIGINT) AS held_bars FROM (SELECT DISTINCT symbol FROM ev)
UNION ALL SELECT symbol, n, CASE WHEN quantity IS NULL THEN 0 WHEN side = 'buy' THEN 1 ELSE -1 END, coalesce(quantity, 0), reason, q1, en1, eb1, d, dp1, k1, w1, l1, won1, lost1, eq1, pk1, regime, voters, side, score, reason, rejection, quantity, fill_side, fill_quantity, fill_price, gained, fill_reason, held_bars
FROM (SELECT *, CASE WHEN why IS NOT NULL THEN q1 WHEN side IS NOT NULL AND rejection IS NULL THEN CASE WHEN side = 'sell' THEN q1 ELSE shares END END AS quantity
FROM (SELECT *, CASE WHEN why IS NOT NULL OR side IS NULL THEN NULL WHEN side = 'sell' AND q1 > 0 AND held < {c['least']} THEN 'min_hold' WHEN k1 THEN 'kill_switch' WHEN score < {2 * c['cost'] * c['reward']} THEN 'cost_filter' WHEN side = 'sell' THEN CASE WHEN q1 > 0 THEN NULL ELSE 'no_position' END WHEN kelly <= 0 THEN 'no_edge' WHEN shares <= 0 THEN 'position_size' END AS rejection
FROM (SELECT *, CASE WHEN close > {c['fractional_price']} THEN size ELSE floor(least(size, {c['most_shares']})) END AS shares
FROM (SELECT *, {c['notional']} / close * least({c['largest']}, greatest({c['smallest']}, kelly * {part} * pow(1 - CASE WHEN dp1 < 0 THEN least(1.0, -dp1 / {c['daily_loss']}) ELSE 0 END, {c['deleverage_power']}))) AS size
FROM (SELECT *, CASE WHEN {share} > 0 THEN least(1.0, {share} * greatest(0.2, 1 - 4 * {spread})) ELSE 0 END AS kelly,
CASE WHEN why IS NOT NULL THEN 'sell' WHEN passes THEN CASE WHEN net > 0 THEN 'buy' ELSE 'sell' END END AS side, CASE WHEN why IS NOT NULL THEN 0.0 WHEN passes THEN abs(net) END AS score, CASE WHEN why IS NOT NULL THEN why WHEN passes THEN {BEST} END AS reason
FROM (SELECT *, why IS NULL AND voters >= {c['voters']} AND abs(net) >= {c['net']} AND NOT (net > 0 AND NOT q1 > 0 AND regime_change_prob > {c['change']}) AND NOT (q1 > 0 AND net < 0 AND sellers < {c['sell_voters']}) AS passes
FROM (SELECT *, CASE WHEN why IS NULL THEN {COUNTED} ELSE 0 END AS voters, {NET} AS net, {SELLERS} AS sellers
FROM (SELECT *, {_votes('regime', 'q1 > 0')}, CASE WHEN q1 > 0 THEN CASE WHEN distance > 0 AND close < en1 - distance * {c['stop']} THEN 'stop_loss' WHEN (close - en1) / en1 > {c['take']} THEN 'take_profit' WHEN held >= {c['longest']} THEN 'max_hold_time' END END AS why
FROM (SELECT *, n - eb1 AS held, CASE WHEN garch_vol > 0 THEN garch_vol * close ELSE greatest(atr, 0) END AS distance, CASE WHEN pk1 > 0 AND (eq1 - pk1) / pk1 < -0.05 AND garch_vol_percentile > 0.9 THEN 'crisis' WHEN (change_run < 20 AND garch_vol_percentile > 0.3) OR garch_vol_percentile > 0.7 THEN 'high_vol' WHEN garch_vol_percentile < 0.3 THEN 'low_vol' ELSE 'normal' END AS regime
FROM (SELECT *, coalesce(k0 OR (gained <> 0 AND dp1 < -{c['daily_loss']}), k0) AS k1, greatest(pk, eq1) AS pk1
FROM (SELECT *, dp0 + coalesce(gained, 0) AS dp1, eq + coalesce(gained, 0) AS eq1, w + coalesce((gained > 0)::INT, 0) AS w1, l + coalesce((gained < 0)::INT, 0) AS l1, won + greatest(coalesce(gained, 0), 0) AS won1, lost + greatest(-coalesce(gained, 0), 0) AS lost1
FROM (SELECT ev.*, f.pk, f.eq, f.w, f.l, f.won, f.lost, CASE WHEN f.day = ev.d THEN f.dp ELSE 0 END AS dp0, CASE WHEN f.day = ev.d THEN f.killed ELSE false END AS k0,
CASE WHEN f.pend < 0 THEN f.pq * (open - f.en) END AS gained, CASE WHEN f.pend > 0 THEN f.pq WHEN f.pend < 0 THEN 0 ELSE f.q END AS q1, CASE WHEN f.pend > 0 THEN open ELSE f.en END AS en1, CASE WHEN f.pend > 0 THEN f.n ELSE f.eb END AS eb1,
CASE WHEN f.pend > 0 THEN 'buy' WHEN f.pend < 0 THEN 'sell' END AS fill_side, CASE WHEN f.pend <> 0 THEN f.pq END AS fill_quantity, CASE WHEN f.pend <> 0 THEN open END AS fill_price, CASE WHEN f.pend <> 0 THEN f.pr END AS fill_reason, CASE WHEN f.pend < 0 THEN f.n - f.eb END AS held_bars
FROM eng f JOIN ev ON ev.symbol = f.symbol AND ev.n = f.n + 1)))))))))))))"""


MACHINE = f"{FEATURE}, {vote_views(LIMITS)}, {machine_views(LIMITS)}"
DECIDED = "SELECT ev.symbol, CAST(epoch(ev.ts) AS BIGINT) AS t, {features}eng.regime, eng.voters, eng.side, round(eng.score, 6) AS score, eng.reason, eng.side IS NOT NULL AND eng.rejection IS NULL AS passed, eng.rejection, round(eng.quantity, 6) AS quantity, eng.fill_side, round(eng.fill_quantity, 6) AS fill_quantity, round(eng.fill_price, 6) AS fill_price, round(eng.fill_pnl, 5) + 0.0 AS fill_pnl, eng.fill_reason, eng.held_bars, round(eng.q, 6) AS holding, round(eng.dp, 5) + 0.0 AS day_pnl, eng.killed, round(eng.eq, 5) + 0.0 AS equity FROM eng JOIN ev ON ev.symbol = eng.symbol AND ev.n = eng.n"
SOME = ("return_z_score", "relative_volume", "adx", "garch_vol_percentile", "cusum_triggered")
BESIDE = "".join(f"ev.{c}, " if c in OTHER else f"round(ev.{c}, 6) + 0.0 AS {c}, " for c in SOME)


def decided(rows, features=()):
    return rows.select(
        "symbol", secs(), *(c if c in OTHER else r(c) for c in features), "regime", "voters", "side", r("score"), "reason", F.coalesce("passed", F.lit(False)).alias("passed"), "rejection", r("quantity"), "fill_side",
        r("fill_quantity"), r("fill_price"), r("fill_pnl", 5), "fill_reason", F.col("held_bars").cast("long").alias("held_bars"), r("holding"), r("day_pnl", 5), "killed", r("equity", 5),
    )


def _schema(rows, more):
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", " + more


def machine_rows(spark, sf):
    """Every bar's features, decision and fill."""
    bars = fx.bars(spark, sf)
    rows = ft.feature_rows(bars).join(bars.select("symbol", "ts", "open", "close", ft.session_day().alias("day")), ["symbol", "ts"])
    engine = sn.Engine(WEIGHTS, **TRIAL)
    return scan.fold(rows, "symbol", ["ts"], lambda s, x: engine.step(s, x, x.open, x.close, x.day), _schema(rows, sn.DECISION))


@query("g09_g10_signal_fold", "bars", f"+ {MACHINE} {DECIDED.format(features=BESIDE)}")
def _(spark, sf):
    """Decisions bar by bar: fills at the open, exits first, votes, the risk gate; features beside them."""
    return decided(machine_rows(spark, sf), SOME)


@query("st08_signal_machine", "ticks", f"{CLOSED} {MACHINE} {DECIDED.format(features='')}, mark WHERE ev.ts + INTERVAL 1 HOUR <= mark")
def _(spark, sf):
    """The machine over a stream's bars: features and the open position are one state by symbol."""
    bars = st.staged(st.bars(st.stamped(ticks(spark, sf))), "st08-bars")
    rows = bars.select("symbol", "ts", F.unix_millis("ts").alias("millis"), "open", "high", "low", "close", "volume", ft.session_day().alias("day"))
    machine = sn.StreamedEngine(ft.FeatureState(), sn.Engine(WEIGHTS, **TRIAL))
    return decided(st.drain(st.keyed_steps(rows, "symbol", ["ts"], machine.step, _schema(rows, sn.DECISION)), "st08"))


@query("g05_gated_votes", "bars", f"+ {FEATURE}, {vote_views(LIMITS)}, va AS (SELECT *, n % 3 = 0 AS holds, {_votes('market_regime', 'n % 3 = 0')} FROM ev), vb AS (SELECT *, {COUNTED} AS voters, {NET} AS net, {SELLERS} AS sellers FROM va), vc AS (SELECT *, voters >= 1 AND abs(net) >= 0.1 AND NOT (net > 0 AND NOT holds AND (NOT cusum_triggered OR regime_change_prob > 0.3)) AND NOT (holds AND net < 0 AND sellers < 2) AS passes FROM vb) SELECT {T}, voters, CASE WHEN passes THEN CASE WHEN net > 0 THEN 'buy' ELSE 'sell' END END AS side, round(CASE WHEN passes THEN abs(net) END, 6) AS score, CASE WHEN passes THEN {BEST} END AS reason FROM vc")
def _(spark, sf):
    """Weighted votes under the regime's multipliers and the gates of entries and exits, as if every third bar were held."""
    rows = ft.feature_rows(fx.bars(spark, sf)).withColumn("holds", F.row_number().over(W.partitionBy("symbol").orderBy("ts")) % 3 == 0)
    limits = LIMITS | {"cusum_gate": True}

    def step(_, x):
        signal, voters = sn.combined(x, x.holds, x.market_regime, WEIGHTS, limits)
        return (voters, *(signal or (None, None, None)))

    out = scan.fold(rows, "symbol", ["ts"], step, _schema(rows, "voters int, side string, score double, reason string"))
    return out.select("symbol", secs(), "voters", "side", r("score"), "reason")


@query("r06_trades", "bars", f"+ {MACHINE}, tr AS (SELECT eng.*, ev.ts, lag(eng.fill_price) OVER x AS bought, lag(ev.ts) OVER x AS since, lag(eng.fill_reason) OVER x AS entered FROM eng JOIN ev ON ev.symbol = eng.symbol AND ev.n = eng.n WHERE eng.fill_side IS NOT NULL WINDOW x AS (PARTITION BY eng.symbol ORDER BY eng.n)) SELECT symbol, CAST(epoch(since) AS BIGINT) AS entered_at, CAST(epoch(ts) AS BIGINT) AS left_at, entered, fill_reason AS left_by, round(fill_quantity, 6) AS quantity, round(bought, 6) AS entry_price, round(fill_price, 6) AS exit_price, round(fill_pnl, 5) + 0.0 AS pnl, round(fill_price / bought - 1, 6) + 0.0 AS gain, held_bars FROM tr WHERE fill_side = 'sell'")
def _(spark, sf):
    """The machine's closed trades, each sale with the purchase before it."""
    w = W.partitionBy("symbol").orderBy("ts")
    rows = machine_rows(spark, sf).where("fill_side is not null").withColumns({"bought": F.lag("fill_price").over(w), "since": F.lag("ts").over(w), "entered": F.lag("fill_reason").over(w)}).where("fill_side = 'sell'")
    gain = (F.round(F.col("fill_price") / F.col("bought") - 1, 6) + F.lit(0.0)).alias("gain")
    at = lambda c, name: F.unix_timestamp(c).alias(name)
    return rows.select("symbol", at("since", "entered_at"), at("ts", "left_at"), "entered", F.col("fill_reason").alias("left_by"), r("fill_quantity", 6, "quantity"), r("bought", 6, "entry_price"), r("fill_price", 6, "exit_price"), r("fill_pnl", 5, "pnl"), gain, F.col("held_bars").cast("long").alias("held_bars"))
