"""Sources, data quality, calendar, joins, resampling and rollups over the given tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import tables as op
from . import fixtures as fx
from .registry import query


def secs(c="ts"):
    return F.unix_timestamp(c).alias("t")


def day(c="day"):
    return F.col(c).cast("string").alias("day")


def r(c, n=6, name=None):
    # a zero has no sign, here or in the SQL
    return (F.round(c, n) + F.lit(0.0)).alias(name or c)


SCAN = "SELECT symbol, CAST(epoch(ts) AS BIGINT) AS t, round(close, 6) AS close FROM bars WHERE symbol IN ('click', 'view', 'purchase') AND CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' AND close > 0"


@query("s01_scan_bars", "bars", SCAN)
def _(spark, sf):
    return op.scan_bars(fx.bars(spark, sf), ["click", "view", "purchase"], "2024-01-05", "2024-01-12").select("symbol", secs(), r("close"))


@query("s02_list_symbols", "bars", "SELECT DISTINCT symbol FROM bars")
def _(spark, sf):
    return fx.bars(spark, sf).select("symbol").distinct()


@query("s03_regular_session", "bars", "SELECT symbol, CAST(epoch(ts) AS BIGINT) AS t FROM bars WHERE hour(ts) * 60 + minute(ts) >= 810 AND hour(ts) * 60 + minute(ts) < 1200")
def _(spark, sf):
    return op.in_minutes(fx.bars(spark, sf), 810, 1200).select("symbol", secs())


@query("s04_load_pair", "bars", "SELECT CAST(epoch(a.ts) AS BIGINT) AS t, round(a.close, 6) AS close_a, round(b.close, 6) AS close_b, a.volume AS volume_a, b.volume AS volume_b FROM bars a JOIN bars b ON a.ts = b.ts WHERE a.symbol = 'click' AND b.symbol = 'view'")
def _(spark, sf):
    return op.pair_series(fx.bars(spark, sf), "click", "view").select(secs(), r("close_a"), r("close_b"), "volume_a", "volume_b")


@query("s06_merge_bars", "bars", """+ kept AS (SELECT symbol, ts, close FROM bars WHERE ts < '2024-01-10' OR ts >= '2024-01-12'), fresh AS (SELECT symbol, ts, close * 2 AS close FROM bars WHERE ts >= '2024-01-09')
SELECT symbol, CAST(epoch(ts) AS BIGINT) AS t, round(close, 6) AS close FROM (SELECT * FROM kept UNION ALL SELECT f.* FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.symbol = f.symbol AND k.ts = f.ts))""")
def _(spark, sf):
    b = fx.bars(spark, sf).select("symbol", "ts", "close")
    return op.merge_bars(b, b.where("ts >= '2024-01-09'").withColumn("close", F.col("close") * 2), "2024-01-10", "2024-01-12").select("symbol", secs(), r("close"))


@query("s08_manifest", "bars", "SELECT symbol, count(*) AS n, CAST(epoch(min(ts)) AS BIGINT) AS first, CAST(epoch(max(ts)) AS BIGINT) AS last FROM bars GROUP BY 1")
def _(spark, sf):
    return op.manifest(fx.bars(spark, sf)).select("symbol", "n", F.unix_timestamp("first").alias("first"), F.unix_timestamp("last").alias("last"))


@query("s09_coverage", "bars", "SELECT symbol, CAST(d AS DATE)::VARCHAR AS day FROM (SELECT symbol, unnest(generate_series(CAST(min(ts) AS DATE), CAST(max(ts) AS DATE), INTERVAL 1 DAY)) AS d FROM bars GROUP BY 1) WHERE isodow(d) < 6 AND CAST(d AS DATE) <> DATE '2024-01-10'")
def _(spark, sf):
    return op.coverage(fx.bars(spark, sf), "2024-01-10").select("symbol", day())


@query("s10_needing_refresh", "bars", "SELECT DISTINCT symbol FROM bars UNION ALL SELECT 'missing' EXCEPT SELECT symbol FROM bars WHERE CAST(ts AS DATE) = DATE '2024-01-09'")
def _(spark, sf):
    b = fx.bars(spark, sf)
    names = b.select("symbol").distinct().unionByName(spark.range(1).select(F.lit("missing").alias("symbol")))
    return op.needing_refresh(names, op.coverage(b), "2024-01-09")


@query("s14_schema_migration", "", "SELECT c_custkey AS id, c_mktsegment AS segment, NULL::VARCHAR AS phone FROM customer UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier")
def _(spark, sf):
    old = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    new = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("phone"))
    return old.unionByName(new, allowMissingColumns=True)


LOG = "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE)::VARCHAR || ' [' || o_orderstatus || '] EXIT id=' || o_orderkey || ' pnl=' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ' reason=' || lower(replace(o_orderpriority, ' ', '_')) AS line FROM orders"


def log_lines(spark, sf):
    o = fx.table(spark, sf, "orders")
    reason = F.lower(F.replace("o_orderpriority", F.lit(" "), F.lit("_")))
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.to_date("o_orderdate").cast("string"), F.lit(" ["), "o_orderstatus", F.lit("] EXIT id="), F.col("o_orderkey").cast("string"), F.lit(" pnl="), F.floor("o_totalprice").cast("long").cast("string"), F.lit(" reason="), reason).alias("line"))


@query("s18_log_events", "", f"WITH log AS ({LOG}) SELECT regexp_extract(line, '\\[(\\w)\\]', 1) AS status, regexp_extract(line, '^(\\d{{4}}-\\d{{2}})', 1) AS month, count(*) AS n FROM log WHERE line LIKE '% EXIT %' GROUP BY 1, 2")
def _(spark, sf):
    rows = log_lines(spark, sf).where(F.contains("line", F.lit(" EXIT ")))
    return rows.groupBy(F.regexp_extract("line", r"\[(\w)\]", 1).alias("status"), F.regexp_extract("line", r"^(\d{4}-\d{2})", 1).alias("month")).agg(F.count("*").alias("n"))


@query("s22_order_status_upsert", "", "SELECT user_id, max_by(event_type, ts) AS status, max_by(CASE WHEN value > 50 THEN round(value, 6) END, CASE WHEN value > 50 THEN ts END) AS price FROM events GROUP BY 1")
def _(spark, sf):
    e = fx.ticks(spark, sf).select("user_id", "ts", F.col("symbol").alias("status"), F.when(F.col("value") > 50, F.round("value", 6)).alias("price"))
    return op.latest_status(e, "user_id", "ts", ["status", "price"])


@query("s23_candidate_symbols", "sectors pairs", "SELECT DISTINCT symbol FROM (SELECT leg_a AS symbol FROM pairs UNION ALL SELECT leg_b FROM pairs)")
def _(spark, sf):
    return fx.candidates(spark, sf).select(F.explode(F.array("leg_a", "leg_b")).alias("symbol")).distinct()


@query("q01_validate_bars", "", """WITH x AS (SELECT *, lag(ts) OVER (PARTITION BY event_type ORDER BY event_id) AS before FROM events)
SELECT event_type AS symbol, count(*) AS n, 0 AS n_shape, count(*) FILTER (WHERE value <= 0) AS n_price, count(*) FILTER (WHERE user_id = 0) AS n_no_volume, count(*) FILTER (WHERE ts < before) AS n_backwards, count(*) FILTER (WHERE ts = before) AS n_repeated, round(100.0 * count(*) FILTER (WHERE user_id = 0) / count(*), 6) AS no_volume_pct, count(*) FILTER (WHERE value <= 0) > 0 OR count(*) FILTER (WHERE ts < before) > 0 AS critical FROM x GROUP BY 1""")
def _(spark, sf):
    t = fx.ticks(spark, sf).select("event_id", "symbol", "ts", *(F.col("value").alias(c) for c in ("open", "high", "low", "close")), F.col("user_id").alias("volume"))
    return op.validate_bars(t, "event_id").withColumn("no_volume_pct", F.round("no_volume_pct", 6)).withColumn("n_shape", F.col("n_shape").cast("int"))


@query("q02_find_gaps", "ticks", "SELECT event_id, symbol, gap FROM (SELECT event_id, symbol, CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(lag(ts) OVER (PARTITION BY symbol ORDER BY event_id))) AS BIGINT) AS gap FROM ticks) WHERE gap > 1800")
def _(spark, sf):
    return op.find_gaps(fx.ticks(spark, sf), "event_id", 1800).select("event_id", "symbol", "gap")


@query("q03_close_location", "bars", "SELECT symbol, CAST(epoch(ts) AS BIGINT) AS t, round(high - low, 6) AS range, round(CASE WHEN high - low = 0 THEN 0.5 ELSE (close - low) / (high - low) END, 6) AS location FROM bars")
def _(spark, sf):
    c = F.col
    return fx.bars(spark, sf).select("symbol", secs(), F.round(c("high") - c("low"), 6).alias("range"), F.round(op.close_location(c("high"), c("low"), c("close")), 6).alias("location"))


LOCAL = "local AS (SELECT event_id, ts, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS lt FROM events), m AS (SELECT *, hour(lt) * 60 + minute(lt) AS minute FROM local)"


@query("q04_q07_session_predicates", "", f"WITH {LOCAL} SELECT event_id, minute >= 570 AND minute < 960 AS is_session, CAST(lt AS DATE)::VARCHAR AS day, CASE WHEN minute >= 570 AND minute < 960 THEN minute - 570 END AS from_open, minute >= 962 AS after_close, minute >= 945 AND minute < 960 AS at_decision FROM m")
def _(spark, sf):
    ts = F.col("ts")
    return fx.ticks(spark, sf).select("event_id", cal.is_session(ts).alias("is_session"), cal.trading_day(ts).cast("string").alias("day"), cal.minutes_from_open(ts).cast("long").alias("from_open"), cal.after_close(ts).alias("after_close"), cal.at_close_decision(ts).alias("at_decision"))


HOLIDAY_SQL = ", ".join(f"DATE '{d}'" for d in cal.HOLIDAYS)


@query("q08_trading_days", "", f"WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), t AS (SELECT CAST(x AS DATE) AS day FROM generate_series(DATE '2023-12-01', DATE '2024-12-31', INTERVAL 1 DAY) AS g(x) WHERE isodow(x) < 6 AND CAST(x AS DATE) NOT IN ({HOLIDAY_SQL})) SELECT d.day::VARCHAR AS day, d.day IN (SELECT day FROM t) AS trades, (SELECT max(t.day) FROM t WHERE t.day < d.day)::VARCHAR AS previous FROM d")
def _(spark, sf):
    days = fx.ticks(spark, sf).select(F.to_date("ts").alias("day")).distinct()
    trading = cal.trading_days(spark, "2023-12-01", "2024-12-31")
    out = cal.with_previous_trading_day(days, trading).join(trading.withColumn("trades", F.lit(True)), "day", "left")
    return out.select(day(), F.coalesce("trades", F.lit(False)).alias("trades"), F.col("previous").cast("string").alias("previous"))


@query("q09_session_instants", "", "WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) SELECT day::VARCHAR AS day, CAST(epoch((day + INTERVAL 570 MINUTE) AT TIME ZONE 'America/New_York') AS BIGINT) AS opens, CAST(epoch((day + INTERVAL 960 MINUTE) AT TIME ZONE 'America/New_York') AS BIGINT) AS closes FROM d")
def _(spark, sf):
    d = fx.ticks(spark, sf).select(F.to_date("ts").alias("day")).distinct()
    return d.select(day(), F.unix_timestamp(cal.session_open(F.col("day"))).alias("opens"), F.unix_timestamp(cal.session_close(F.col("day"))).alias("closes"))


@query("q10_stale_filter", "ticks", "SELECT symbol, count(*) FILTER (WHERE CAST(floor(epoch(TIMESTAMP '2024-01-15')) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) > 86400) AS n_stale, count(*) AS n FROM ticks GROUP BY 1")
def _(spark, sf):
    old = op.stale(None, F.lit("2024-01-15").cast("timestamp"), 86400)
    return fx.ticks(spark, sf).groupBy("symbol").agg(F.count_if(old).alias("n_stale"), F.count("*").alias("n"))


@query("q11_overrides", "sectors", "SELECT symbol, sector, coalesce(CASE symbol WHEN 'Brand#11' THEN 1.5 WHEN 'Brand#22' THEN 2.5 END, CASE sector WHEN 'S1' THEN 3.0 END, 9.0)::DOUBLE AS limit_ FROM sectors")
def _(spark, sf):
    own = spark.createDataFrame([("Brand#11", 1.5), ("Brand#22", 2.5)], "symbol string, limit_ double")
    kind = spark.createDataFrame([("S1", 3.0)], "sector string, limit_ double")
    return op.resolve(fx.sectors(spark, sf), own, kind, "limit_", 9.0).select("symbol", "sector", "limit_")


@query("q12_fund_exclusion", "sectors pairs", "SELECT leg_a, leg_b FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM sectors s, sectors f WHERE f.symbol = 'Brand#13' AND s.sector = f.sector AND s.symbol <> f.symbol AND ((p.leg_a = f.symbol AND p.leg_b = s.symbol) OR (p.leg_b = f.symbol AND p.leg_a = s.symbol)))")
def _(spark, sf):
    funds = fx.baskets(spark, sf).where("target = 'Brand#13'").select(F.col("target").alias("fund"), F.col("peer").alias("member"))
    return op.without_components(fx.candidates(spark, sf), funds)


@query("q13_price_gate", "closes", "SELECT symbol FROM closes GROUP BY 1 HAVING bool_and(close > 0)")
def _(spark, sf):
    return op.usable_keys(fx.closes(spark, sf), "symbol")


@query("q14_q15_universe_candidates", "sectors", "SELECT a.sector, a.symbol AS target, string_agg(b.symbol, ',' ORDER BY b.symbol) AS peers, a.sector || ':' || a.symbol || ':2024-01-31' AS id FROM sectors a JOIN sectors b ON a.sector = b.sector AND a.symbol <> b.symbol WHERE right(a.symbol, 1) <> '5' GROUP BY 1, 2")
def _(spark, sf):
    s = fx.sectors(spark, sf)
    c = op.basket_candidates(s, s.where("right(symbol, 1) <> '5'"))
    id = op.basket_id(F.col("sector"), F.col("target"), F.to_date(F.lit("2024-01-31")), F.array_append("peers", F.col("target")))
    return c.select("sector", "target", F.array_join("peers", ",").alias("peers"), F.regexp_replace(id, ":[0-9a-f]+$", "").alias("id"))


@query("q16_repeated_ids", "", "SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def _(spark, sf):
    return op.repeated_ids(fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id")), "id")


@query("o06_id_difference", "", "SELECT id, 'left' AS side FROM (SELECT c_custkey AS id FROM customer EXCEPT ALL SELECT o_custkey FROM orders) UNION ALL SELECT id, 'right' FROM (SELECT o_custkey AS id FROM orders EXCEPT ALL SELECT c_custkey FROM customer)")
def _(spark, sf):
    a, b = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    return op.id_difference(a, b, "id")


@query("q17_pair_id", "sectors", "SELECT DISTINCT least(a.symbol, b.symbol) || '/' || greatest(a.symbol, b.symbol) AS pair_id FROM sectors a JOIN sectors b ON a.symbol <> b.symbol")
def _(spark, sf):
    c = fx.candidates(spark, sf)
    both = c.unionByName(c.select(F.col("leg_b").alias("leg_a"), F.col("leg_a").alias("leg_b")))
    return both.select(op.pair_id(F.col("leg_a"), F.col("leg_b")).alias("pair_id")).distinct()


SMALL_PAIRS = "+ p AS (SELECT a.symbol AS leg_a, b.symbol AS leg_b FROM (SELECT DISTINCT symbol FROM bars) a, (SELECT DISTINCT symbol FROM bars) b WHERE a.symbol < b.symbol)"


@query("j01_minute_pairs", "bars", SMALL_PAIRS + " SELECT leg_a, leg_b, CAST(epoch(x.ts) AS BIGINT) AS t, round(x.close, 6) AS close_a, round(y.close, 6) AS close_b FROM p JOIN bars x ON x.symbol = leg_a JOIN bars y ON y.symbol = leg_b AND y.ts = x.ts")
def _(spark, sf):
    b = fx.bars(spark, sf)
    s = b.select("symbol").distinct()
    p = s.select(F.col("symbol").alias("leg_a")).join(s.select(F.col("symbol").alias("leg_b")), F.col("leg_a") < F.col("leg_b"))
    return op.minute_pairs(b, p).select("leg_a", "leg_b", secs("at"), r("close_a"), r("close_b"))


@query("j02_panel_alignment", "closes sectors", "SELECT sector AS group_id, symbol, day::VARCHAR AS day, round(close, 6) AS close FROM (SELECT s.sector, c.*, count(*) OVER (PARTITION BY s.sector, c.day) AS have FROM closes c JOIN sectors s USING (symbol)) WHERE have = 5")
def _(spark, sf):
    m = fx.sectors(spark, sf).select("symbol", F.col("sector").alias("group_id"))
    return op.aligned(fx.closes(spark, sf), m).select("group_id", "symbol", day(), r("close"))


@query("j03_recent_pairs", "closes sectors pairs", "+ l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS rn FROM closes QUALIFY rn <= 20) SELECT leg_a, leg_b, x.rn, round(x.close, 6) AS a, round(y.close, 6) AS b FROM pairs JOIN l x ON x.symbol = leg_a JOIN l y ON y.symbol = leg_b AND y.rn = x.rn")
def _(spark, sf):
    return op.recent_pairs(fx.closes(spark, sf), fx.candidates(spark, sf), 20).select("leg_a", "leg_b", "rn", r("a"), r("b"))


@query("j04_all_pairs_by_day", "closes", "SELECT a.symbol AS leg_a, b.symbol AS leg_b, count(*) AS n, round(corr(a.close, b.close), 6) AS corr FROM closes a JOIN closes b ON a.day = b.day AND a.symbol < b.symbol GROUP BY 1, 2")
def _(spark, sf):
    c = fx.closes(spark, sf)
    x, y = c.select("day", F.col("symbol").alias("leg_a"), F.col("close").alias("a")), c.select("day", F.col("symbol").alias("leg_b"), F.col("close").alias("b"))
    return x.join(y, "day").where("leg_a < leg_b").groupBy("leg_a", "leg_b").agg(F.count("*").alias("n"), F.round(F.corr("a", "b"), 6).alias("corr"))


@query("j05_next_session_asof", "closes", "+ o AS (SELECT o_orderkey AS order_id, 'Brand#' || (11 + (o_orderkey % 5) * 10 + o_orderkey % 3) AS symbol, CAST(o_orderdate AS DATE) AS day FROM orders) SELECT order_id, o.symbol, o.day::VARCHAR AS day, c.day::VARCHAR AS fill_day, round(c.close, 6) AS price FROM o ASOF LEFT JOIN closes c ON o.symbol = c.symbol AND o.day < c.day")
def _(spark, sf):
    k = F.col("o_orderkey")
    o = fx.table(spark, sf, "orders").select(k.alias("order_id"), F.concat(F.lit("Brand#"), (11 + (k % 5) * 10 + k % 3).cast("string")).alias("symbol"), F.to_date("o_orderdate").alias("day"))
    return op.next_after(o, fx.closes(spark, sf)).select("order_id", "symbol", day(), F.col("fill_day").cast("string").alias("fill_day"), r("price"))


@query("j06_session_close", "bars", "SELECT symbol, CAST(ts AS DATE)::VARCHAR AS day, CAST(epoch(max(ts)) AS BIGINT) AS t, round(max_by(close, ts), 6) AS close FROM bars GROUP BY 1, 2")
def _(spark, sf):
    return op.session_closes(fx.bars(spark, sf), F.to_date("ts")).select("symbol", day(), secs(), r("close"))


@query("j07_blackout", "sectors pairs closes blackouts", "+ e AS (SELECT leg_a, leg_b, day FROM pairs JOIN (SELECT DISTINCT day FROM closes) ON true) SELECT leg_a, leg_b, day::VARCHAR AS day FROM e WHERE EXISTS (SELECT 1 FROM blackouts x WHERE x.symbol IN (leg_a, leg_b) AND abs(date_diff('day', x.event_day, e.day)) <= 3)")
def _(spark, sf):
    days = fx.closes(spark, sf).select("day").distinct()
    return op.blacked_out(fx.candidates(spark, sf).join(days), fx.blackouts(spark, sf), 3).select("leg_a", "leg_b", day())


@query("j11_sector_semi_join", "sectors", "SELECT DISTINCT symbol FROM sectors WHERE sector IN ('S1', 'S3')")
def _(spark, sf):
    active = spark.createDataFrame([("S1",), ("S3",)], "sector string")
    return fx.sectors(spark, sf).join(active, "sector", "left_semi").select("symbol").distinct()


@query("a01_a03_daily_bars", "bars", "SELECT symbol, CAST(ts AS DATE)::VARCHAR AS day, round(min_by(open, ts), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, round(max_by(close, ts), 6) AS close, sum(volume) AS volume FROM bars WHERE hour(ts) >= 13 AND hour(ts) < 20 GROUP BY 1, 2")
def _(spark, sf):
    b = op.in_minutes(fx.bars(spark, sf), 780, 1200)
    return op.daily_bars(b, F.to_date("ts")).select("symbol", day(), *(r(c) for c in ("open", "high", "low", "close")), "volume")


@query("a04_bars_per_date", "bars", "SELECT CAST(ts AS DATE)::VARCHAR AS day, count(*) AS n FROM bars GROUP BY 1")
def _(spark, sf):
    return fx.bars(spark, sf).groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("a12_trade_statistics", "trades", """SELECT pair_id, count(*) AS n, count(*) FILTER (WHERE pnl > 0) AS wins, round(count(*) FILTER (WHERE pnl > 0) / count(*), 6) AS win_rate, round(sum(pnl), 2) + 0.0 AS total, round(avg(pnl) FILTER (pnl > 0), 4) AS avg_win, round(avg(pnl) FILTER (pnl <= 0), 4) AS avg_loss, round(sum(pnl) FILTER (pnl > 0) / -sum(pnl) FILTER (pnl <= 0), 6) AS profit_factor, round(avg(pnl), 4) + 0.0 AS expectancy, round(avg(pnl) / stddev_samp(pnl), 6) + 0.0 AS sharpe FROM trades GROUP BY 1""")
def _(spark, sf):
    from ..operators.reports import trade_statistics

    return trade_statistics(fx.trades(spark, sf), "pair_id").select("pair_id", "n", "wins", r("win_rate"), r("total", 2), r("avg_win", 4), r("avg_loss", 4), r("profit_factor"), r("expectancy", 4), r("sharpe"))


@query("a14_pnl_rollup", "trades", "SELECT coalesce(pair_id, 'ALL') AS pair_id, coalesce(exit_day::VARCHAR, 'ALL') AS exit_day, round(sum(pnl), 2) + 0.0 AS pnl, count(*) AS n, count(*) FILTER (WHERE pnl > 0) AS wins, round(count(*) FILTER (WHERE pnl > 0) / count(*), 6) AS win_rate FROM trades GROUP BY ROLLUP (pair_id, exit_day)")
def _(spark, sf):
    return op.rollup_all(fx.trades(spark, sf)).select("pair_id", "exit_day", r("pnl", 2), "n", "wins", r("win_rate"))


@query("a20_feed_counters", "ticks", "+ x AS (SELECT *, max(ts) OVER (PARTITION BY symbol ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM ticks) SELECT symbol, count(*) AS n, count(*) FILTER (WHERE value <= 0) AS n_invalid, count(*) FILTER (WHERE ts < newest) AS n_late, count(*) FILTER (WHERE ts = newest) AS n_repeated, CAST(floor(epoch(max(ts))) AS BIGINT) AS last FROM x GROUP BY 1")
def _(spark, sf):
    return op.stream_counters(fx.ticks(spark, sf), "event_id").withColumn("last", F.unix_timestamp("last"))


@query("a22_row_counts", "", "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'customer', count(*) FROM customer")
def _(spark, sf):
    for t in ("orders", "lineitem", "customer"):
        fx.table(spark, sf, t).createOrReplaceTempView(f"journal_{t}")
    return spark.sql("SELECT 'orders' AS name, count(*) AS n FROM journal_orders UNION ALL SELECT 'lineitem', count(*) FROM journal_lineitem UNION ALL SELECT 'customer', count(*) FROM journal_customer")


@query("o01_chronological_merge", "bars", "SELECT symbol, CAST(epoch(ts) AS BIGINT) AS t, row_number() OVER (PARTITION BY ts ORDER BY symbol) AS place FROM bars")
def _(spark, sf):
    return fx.bars(spark, sf).select("symbol", secs(), F.row_number().over(W.partitionBy("ts").orderBy("symbol")).alias("place"))


@query("o03_top_k", "trades", "SELECT trade_id, round(pnl, 4) AS pnl FROM trades ORDER BY abs(pnl) DESC, trade_id LIMIT 25")
def _(spark, sf):
    return fx.trades(spark, sf).select("trade_id", "pnl").orderBy(F.desc(F.abs("pnl")), "trade_id").limit(25).select("trade_id", r("pnl", 4))


@query("o05_date_intersection", "closes", "SELECT day::VARCHAR AS day FROM (SELECT day FROM closes WHERE symbol = 'Brand#11' INTERSECT SELECT day FROM closes WHERE symbol = 'Brand#25')")
def _(spark, sf):
    c = fx.closes(spark, sf)
    return c.where("symbol = 'Brand#11'").select("day").intersect(c.where("symbol = 'Brand#25'").select("day")).select(day())
