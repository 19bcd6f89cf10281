"""The pair machine over both legs of every pair of the event symbols, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pairs as pr
from ..operators import scan
from ..sources.shared import written
from ..streaming import streams as st
from . import fixtures as fx
from .registry import query
from .stream_queries import CLOSED, ticks
from .table_queries import r

#: A month of hourly bars all day long: a short window, no close, tighter levels.
MONTH = {"enter": 0.8, "leave": 0.2, "stop": 2.5, "window": 6, "longest": 2, "shortest": 1, "close_minute": 1500, "offset_hours": 0, "drift": 1.2, "trend": 4}
LIMITS = pr.PAIR_LIMITS | MONTH
C = LIMITS
BLOCKED = 1_705_017_600_000  # 12 January 2024: until then pairs of clicks are blacked out
INPUT = "pair_id string, millis long, price_a double, price_b double, alpha double, beta double, kappa double, max_hold int, blocked_until long"
COLUMNS = [c.split()[0] for c in INPUT.split(", ")]


def legs(symbols):
    """(symbol, pair_id, leg) of all pairs, leg a before leg b: a few rows a symbol."""
    a, b = symbols.select(F.col("symbol").alias("leg_a")), symbols.select(F.col("symbol").alias("leg_b"))
    both = a.join(b, F.col("leg_a") < F.col("leg_b")).withColumn("pair_id", F.concat_ws("/", "leg_a", "leg_b"))
    return both.select(F.col("leg_a").alias("symbol"), "pair_id", F.lit("a").alias("leg")).unionByName(both.select(F.col("leg_b").alias("symbol"), "pair_id", F.lit("b").alias("leg")))


def configured(rows):
    """Pair bars (pair_id, millis, price_a, price_b) with the pair's fit (alpha, beta), and the pair's limits."""
    slow = F.when(F.col("pair_id").startswith("click"), BLOCKED).otherwise(0).cast("long")
    return rows.select("pair_id", "millis", "price_a", "price_b", "alpha", "beta", F.lit(9.0).alias("kappa"), F.when(F.col("pair_id").endswith("view"), 2).otherwise(0).cast("int").alias("max_hold"), slow.alias("blocked_until"))


def paired(bars, known):
    """Bars of both legs of each pair at the same hour: each symbol's bars fan out to its pairs, and the legs meet again."""
    out = bars.select("symbol", "ts", "close").join(known.hint("merge"), "symbol")
    a, b = (out.where(F.col("leg") == leg).select("pair_id", "ts", F.col("close").alias(f"price_{leg}")) for leg in "ab")
    return a.join(b, ["pair_id", "ts"]).select("pair_id", F.unix_millis("ts").alias("millis"), "price_a", "price_b")


def fitted(rows):
    """(pair_id, alpha, beta): the log price of leg a on that of leg b."""
    return rows.groupBy("pair_id").agg(F.regr_intercept(F.log("price_a"), F.log("price_b")).alias("alpha"), F.regr_slope(F.log("price_a"), F.log("price_b")).alias("beta"))


def machine_sql(rows):
    """A view ``pm`` of the machine over rows (pair_id, n, ms, pa, pb, alpha, beta, max_hold, blocked), by one step a bar."""
    zero, text, long = "0.0::DOUBLE", "NULL::VARCHAR", "0::BIGINT"
    hedge = lambda new, reset, old: f"CASE WHEN upd THEN CASE WHEN abs(nb) < 5 THEN {new} ELSE {reset} END ELSE {old} END"
    entering = "(event = 'entry')"
    keep = lambda new, old: f"CASE WHEN coalesce({entering}, false) THEN {new} ELSE {old} END"
    left = "(event IS NOT NULL AND event <> 'entry')"
    return f"""pm AS (SELECT pair_id, {long} AS n, any_value(alpha) AS a, any_value(beta) AS b, 1.0::DOUBLE AS p00, {zero} AS p01, 1.0::DOUBLE AS p11, 0 AS hedged, []::DOUBLE[] AS ring, {zero} AS pending, {long} AS day, 0 AS days, 0 AS side, 0 AS edays, {zero} AS epa, {zero} AS epb, {zero} AS ebeta, {zero} AS em, 1.0::DOUBLE AS es, []::DOUBLE[] AS history, 0 AS stops, false AS paused, 0 AS waited, 0 AS sign, 0 AS same, (-1)::BIGINT AS entered,
{zero} AS spread, {zero} AS z, {zero} AS frozen, {text} AS event, {zero} AS qa, {zero} AS qb, {zero} AS net, {zero} AS priority FROM {rows} GROUP BY pair_id
UNION ALL SELECT pair_id, n, a1, b1, q00, q01, q11, hedged1, ring1, spread, day1, days1, CASE WHEN event = 'entry' THEN CASE WHEN z < 0 THEN 1 ELSE -1 END WHEN event IS NOT NULL THEN 0 ELSE side END, {keep('days1', 'edays')}, {keep('pa', 'epa')}, {keep('pb', 'epb')}, {keep('be', 'ebeta')}, {keep('m', 'em')}, {keep('sd', 'es')}, history1, stops2, paused2, waited2, sign1, same1, {keep('day1', 'entered')},
spread, z, CASE WHEN side <> 0 AND z IS NOT NULL THEN frozen END, event, CASE WHEN event = 'entry' THEN -sign(z) * floor({C['notional']} / pa) WHEN event IS NOT NULL THEN -side * floor({C['notional']} / epa) END, CASE WHEN event = 'entry' THEN sign(z) * floor({C['notional']} * abs(be) / pb) WHEN event IS NOT NULL THEN side * floor({C['notional']} * abs(ebeta) / epb) END, net, CASE WHEN event = 'entry' THEN abs(z) * 3 / sd END
FROM (SELECT *, paused1 AND NOT lifted OR ({left} AND ((len(history1) >= 5 AND list_max(history1[-5:]) < 0) OR stops1 >= 3)) AS paused2, CASE WHEN lifted THEN 0 ELSE stops1 END AS stops2, CASE WHEN lifted THEN 0 ELSE waited1 END AS waited2
FROM (SELECT *, CASE WHEN {left} THEN (history || [net])[-10:] ELSE history END AS history1, CASE WHEN event IN ('stop_loss', 'drift_stop') THEN stops + 1 WHEN {left} THEN 0 ELSE stops END AS stops1
FROM (SELECT *, CASE WHEN {left} THEN side * ((pa - epa) / epa - abs(ebeta) * (pb - epb) / epb) / (1 + abs(ebeta)) * 10000 - {C['cost_bps']} END AS net
FROM (SELECT *, CASE WHEN z IS NULL THEN NULL WHEN side <> 0 THEN why WHEN open AND (NOT paused OR lifted) AND minute // 60 < {C['last_hour']} AND abs(z) > {C['enter']} AND abs(z) <= {C['stop']} THEN 'entry' END AS event
FROM (SELECT *, paused AS paused1, coalesce(open AND paused AND waited + 1 >= 2 * greatest(longest, 5), false) AS lifted, CASE WHEN open AND paused THEN waited + 1 ELSE waited END AS waited1
FROM (SELECT *, coalesce(chance AND NOT ms < blocked AND NOT same1 >= {C['trend']}, false) AS open
FROM (SELECT *, CASE WHEN chance THEN CASE WHEN CASE WHEN z > 0 THEN 1 ELSE -1 END = sign THEN same + 1 ELSE 1 END ELSE same END AS same1, CASE WHEN chance THEN CASE WHEN z > 0 THEN 1 ELSE -1 END ELSE sign END AS sign1,
CASE WHEN side * frozen < -{C['stop']} THEN 'stop_loss' WHEN abs(z - frozen) > {C['drift']} THEN 'drift_stop' WHEN minute >= {C['close_minute']} THEN 'eod_close' WHEN longest > 0 AND days1 - edays >= longest THEN 'max_hold' WHEN side * frozen > -{C['leave']} AND days1 - edays >= {C['shortest']} THEN 'reversion' END AS why
FROM (SELECT *, coalesce(z IS NOT NULL AND side = 0 AND fresh AND entered <> day1, false) AS chance, (spread - em) / es AS frozen, (ms // 60000) % 1440 AS minute, CASE WHEN max_hold > 0 THEN max_hold ELSE {C['longest']} END AS longest
FROM (SELECT *, CASE WHEN len(ring1) = {C['window']} AND sd >= 1e-10 THEN (spread - m) / sd END AS z
FROM (SELECT *, sqrt(list_sum(list_transform(ring1, lambda v: (v - m) * (v - m))) / len(ring1)) AS sd
FROM (SELECT *, list_sum(ring1) / len(ring1) AS m, {hedge('na', 'alpha', 'a')} AS a1, {hedge('nb', 'beta', 'b')} AS b1, {hedge('u00 - k0 * (u00 + x * p01)', '1', 'p00')} AS q00, {hedge('p01 - k0 * (p01 + x * u11)', '0', 'p01')} AS q01, {hedge('u11 - k1 * (p01 + x * u11)', '1', 'p11')} AS q11, {hedge('hedged + 1', '0', 'hedged')} AS hedged1
FROM (SELECT *, a + k0 * (y - a - b * x) AS na, b + k1 * (y - a - b * x) AS nb
FROM (SELECT *, (u00 + x * p01) / (u00 + 2 * x * p01 + x * x * u11 + 1e-3) AS k0, (p01 + x * u11) / (u00 + 2 * x * p01 + x * x * u11 + 1e-3) AS k1
FROM (SELECT *, y - al - be * x AS spread, CASE WHEN fresh THEN (ring || [pending])[-{C['window']}:] ELSE ring END AS ring1, days + fresh::INT AS days1, fresh AND side = 0 AS upd, p00 + 1e-5 AS u00, p11 + 1e-5 AS u11
FROM (SELECT r.*, f.* EXCLUDE (pair_id, n, spread, z, frozen, event, qa, qb, net, priority), ln(r.pa) AS y, ln(r.pb) AS x, CASE WHEN f.hedged >= 10 THEN f.a ELSE r.alpha END AS al, CASE WHEN f.hedged >= 10 THEN f.b ELSE r.beta END AS be, r.ms // 86400000 AS day1, f.day > 0 AND r.ms // 86400000 <> f.day AS fresh FROM pm f JOIN {rows} r ON r.pair_id = f.pair_id AND r.n = f.n + 1))))))))))))))))"""


PAIRED = """ps AS (SELECT DISTINCT symbol FROM bars), pj AS (SELECT a.symbol || '/' || b.symbol AS pair_id, a.ts, a.close AS pa, b.close AS pb FROM bars a JOIN bars b ON a.ts = b.ts AND a.symbol < b.symbol), pf AS (SELECT pair_id, regr_intercept(ln(pa), ln(pb)) AS alpha, regr_slope(ln(pa), ln(pb)) AS beta FROM pj WHERE pa > 0 AND pb > 0 GROUP BY 1)"""
ROWS = f"pq AS (SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY ts) AS n, epoch_us(ts) // 1000 AS ms, pa, pb, alpha, beta, CASE WHEN pair_id LIKE '%view' THEN 2 ELSE 0 END AS max_hold, CASE WHEN pair_id LIKE 'click%' THEN {BLOCKED} ELSE 0 END AS blocked FROM pj JOIN pf USING (pair_id) WHERE pa > 0 AND pb > 0)"
SHOWN = "SELECT pm.pair_id, pq.ms, round(spread, 6) + 0.0 AS spread, round(z, 5) + 0.0 AS z, round(frozen, 5) + 0.0 AS frozen_z, side, event, qa + 0.0 AS quantity_a, qb + 0.0 AS quantity_b, round(net, 4) + 0.0 AS net_bps, round(priority, 4) AS priority FROM pm JOIN pq ON pq.pair_id = pm.pair_id AND pq.n = pm.n"


def shown(rows):
    zero = lambda c: (F.col(c) + F.lit(0.0)).alias(c)
    return rows.select("pair_id", F.col("millis").alias("ms"), r("spread"), r("z", 5), r("frozen_z", 5), "side", "event", zero("quantity_a"), zero("quantity_b"), r("net_bps", 4), r("priority", 4))


def step(machine):
    return lambda s, x: machine.step(s, x.millis, x.price_a, x.price_b, x.alpha, x.beta, x.kappa, x.max_hold, x.blocked_until)


@query("g14_pair_machine", "bars", f"+ {PAIRED}, {ROWS}, {machine_sql('pq')} {SHOWN}")
def _(spark, sf):
    """Every pair's spread, z, position and orders bar by bar, over real legs."""
    bars = fx.bars(spark, sf).where("close > 0")
    rows = paired(bars, legs(bars.select("symbol").distinct()))
    rows = configured(rows.join(fitted(rows), "pair_id")).select(*COLUMNS)
    return shown(scan.fold(rows, "pair_id", ["millis"], step(pr.PairLegs(**MONTH)), f"{INPUT}, {pr.PAIR_COLUMNS}"))


@query("st09_pair_machine", "ticks", f"{CLOSED} {PAIRED}, {ROWS}, {machine_sql('pq')} {SHOWN}, mark WHERE make_timestamp(pq.ms * 1000) + INTERVAL 1 HOUR <= mark")
def _(spark, sf):
    """The same as a stream: bars fan out to pairs by a static join, both legs of an hour meet in a watermarked join, and each
    pair's machine is a state; the fits are a static table."""
    usable = fx.ticks(spark, sf).where(F.col("value") > 0).withColumn("closed_at", F.timestamp_add("SECOND", F.lit(60), "ts"))
    known = written(legs(usable.select("symbol").distinct()), "st09-legs")
    fits = fitted(paired(st.bars(usable), known))
    bars = st.staged(st.bars(st.stamped(ticks(spark, sf))), "st09-bars")
    out = st.fanned(bars.withWatermark("ts", "1 hour").select("symbol", "ts", "close"), known, "symbol", "st09-known")
    a, b = (out.where(F.col("leg") == leg).select("pair_id", "ts", F.col("close").alias(f"price_{leg}")) for leg in "ab")
    both = a.join(b, ["pair_id", "ts"]).select("pair_id", F.unix_millis("ts").alias("millis"), "price_a", "price_b")
    rows = configured(st.fanned(st.staged(both, "st09-pairs"), fits, "pair_id", "st09-fits")).select(*COLUMNS)
    return shown(st.drain(st.keyed_steps(rows, "pair_id", ["millis"], step(pr.PairLegs(**MONTH)), f"{INPUT}, {pr.PAIR_COLUMNS}"), "st09"))
