"""Journals, log and run reports, gated books, and streams with static tables, silence and history."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import book as bk
from ..operators import signals as sg
from ..operators import tables as op
from ..sources import journals as jn
from ..sources.shared import shared_path, written
from ..streaming import streams as st
from . import fixtures as fx
from .book_queries import BOOK, target_book
from .ledger_queries import FILLS, day_orders
from .registry import query
from .stat_queries import BV
from .table_queries import LOG, day, log_lines, r, secs


@query("s12_fills", "closes", FILLS + " SELECT o.symbol, side, count(*) AS n, round(sum(c.close * (1 + CASE side WHEN 'buy' THEN 5 ELSE -5 END / 1e4)), 4) AS total FROM o ASOF JOIN closes c ON o.symbol = c.symbol AND o.day < c.day GROUP BY 1, 2")
def _(spark, sf):
    """Fills are appended in two runs, of buys and of sells, and read as one table."""
    o = day_orders(spark, sf)
    price = F.col("price") * (1 + F.when(F.col("side") == "buy", 5.0).otherwise(-5.0) / 1e4)
    fills = op.next_after(o, fx.closes(spark, sf)).join(o.select("order_id", "side"), "order_id").where("price is not null")
    fills = fills.select("order_id", "symbol", "side", F.lit(1).alias("qty"), price.alias("price"), F.lit(5.0).alias("slippage_bps"), "fill_day")
    path = shared_path(spark, "fills")
    for side in ("buy", "sell"):
        jn.append(fills.where(F.col("side") == side), path)
    return spark.read.schema(fills.schema).parquet(path).groupBy("symbol", "side").agg(F.count("*").alias("n"), (F.round(F.sum("price"), 4) + 0.0).alias("total"))


@query("s13_run_sessions", "closes", "SELECT day::VARCHAR AS day, count(*) AS symbols, round(max(close), 6) AS highest, count(*) FILTER (WHERE close > 1500) AS held FROM closes GROUP BY 1")
def _(spark, sf):
    """A run's sessions are written with their closes as a map and their holdings as an array, and read again."""
    c = fx.closes(spark, sf).withColumn("close", F.col("close").cast("double"))
    held = c.select("symbol", "day", (F.col("close") > 1500).cast("int").alias("position"))
    rows = written(jn.session_rows(c, held, "run-1"), "sessions", ["run_id"])
    values = F.map_values("closes")
    return rows.select(day(), F.size("closes").cast("long").alias("symbols"), (F.round(F.array_max(values), 6) + 0.0).alias("highest"), F.size("active").cast("long").alias("held"))


@query("s19_pair_files", "closes sectors pairs", "+ made AS (SELECT symbol AS leg_a, max(day) AS made_at FROM closes GROUP BY 1), n AS (SELECT max(made_at) AS now FROM made) SELECT p.leg_a, p.leg_b, round(length(p.leg_a || p.leg_b) / 7, 6) AS beta FROM pairs p JOIN made USING (leg_a), n WHERE made_at >= now - INTERVAL 48 HOUR")
def _(spark, sf):
    """A file for each leg_a, made on the day of its last close; those older than two days are rejected."""
    made = fx.closes(spark, sf).groupBy(F.col("symbol").alias("leg_a")).agg(F.max("day").cast("timestamp").alias("generated_at"))
    pairs = fx.candidates(spark, sf).join(made, "leg_a").select("leg_a", "leg_b", (F.length(F.concat("leg_a", "leg_b")) / 7).alias("beta"), F.lit(0.5).alias("score"), "generated_at")
    path = shared_path(spark, "pairs")
    jn.write_pairs(pairs, path)
    now = made.agg(F.max("generated_at")).first()[0]
    return jn.read_pairs(spark, path, F.lit(now)).select("leg_a", "leg_b", r("beta"))


@query("s21_trade_history", "trades", "SELECT pair_id, exit_reason, count(*) AS n, round(sum(pnl), 2) AS pnl FROM trades GROUP BY 1, 2")
def _(spark, sf):
    """Closed trades are appended year by year to a history that is kept by year."""
    t = written(fx.trades(spark, sf).withColumn("year", F.year("exit_day")), "closed")
    first = t.agg(F.min("year"), F.max("year")).first()
    path = shared_path(spark, "history")
    for low, high in ((first[0], first[0]), (first[0] + 1, first[1])):
        jn.append(t.where(F.col("year").between(low, high)), path, "year")
    return spark.read.parquet(path).groupBy("pair_id", "exit_reason").agg(F.count("*").alias("n"), (F.round(F.sum("pnl"), 2) + 0.0).alias("pnl"))


@query("a02_bars_in_range", "bars", "SELECT symbol, CAST(epoch(ts) AS BIGINT) AS t, round(close, 6) AS close FROM bars WHERE ts >= TIMESTAMP '2024-01-08 00:00:00' AND ts < TIMESTAMP '2024-01-10 18:00:00' AND hour(ts) * 60 + minute(ts) >= 810 AND hour(ts) * 60 + minute(ts) < 1200")
def _(spark, sf):
    """Bars of the regular session with a time in [start, end)."""
    return op.in_range(op.in_minutes(fx.bars(spark, sf), 810, 1200), "2024-01-08 00:00:00", "2024-01-10 18:00:00").select("symbol", secs(), r("close"))


@query("a29_log_summary", "", f"WITH log AS ({LOG}), x AS (SELECT substr(line, 1, 10) AS day, regexp_extract(line, '\\[(\\w)\\]', 1) AS status, CAST(regexp_extract(line, 'pnl=(-?[0-9]+)', 1) AS BIGINT) AS pnl FROM log) SELECT substr(day, 1, 7) AS month, count(DISTINCT day) AS order_days, count(DISTINCT CASE WHEN status = 'F' THEN day END) AS filled_days, count(*) FILTER (WHERE status = 'P') AS partial, CAST(sum(CASE WHEN status = 'O' THEN pnl ELSE 0 END) AS BIGINT) AS open_amount FROM x GROUP BY 1")
def _(spark, sf):
    """A month of the run's log: days with orders, days with fills, orders filled in part, the amount still open."""
    x = log_lines(spark, sf).select(F.substring("line", 1, 10).alias("day"), F.regexp_extract("line", r"\[(\w)\]", 1).alias("status"), F.regexp_extract("line", r"pnl=(-?[0-9]+)", 1).cast("long").alias("pnl"))
    return x.groupBy(F.substring("day", 1, 7).alias("month")).agg(
        F.count_distinct("day").alias("order_days"), F.count_distinct(F.when(F.col("status") == "F", F.col("day"))).alias("filled_days"),
        F.count_if(F.col("status") == "P").alias("partial"), F.sum(F.when(F.col("status") == "O", F.col("pnl")).otherwise(F.lit(0).cast("long"))).alias("open_amount"),
    )


GATE = "we AS (SELECT CAST(date_trunc('week', day) AS DATE) AS day, max_by(equity, day) AS equity FROM equity GROUP BY 1), gw AS (SELECT day, equity / first_value(equity) OVER q - 1 AS ret, (max(equity) OVER q - equity) / max(equity) OVER q AS dd, count(*) OVER q AS n FROM we WINDOW q AS (ORDER BY day ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)), ga AS (SELECT day, CASE WHEN n < 21 THEN 1.0 WHEN round(ret, 8) < 0 OR round(dd, 8) > 0.05 THEN 0.0 ELSE 1.0 END AS scale FROM gw)"


@query("p29_gated_long_only", BV + " trades equity", f"{BOOK}, {GATE}, l AS (SELECT *, sum(notional) OVER (PARTITION BY day) AS total FROM book WHERE notional > 0) SELECT l.day::VARCHAR AS day, symbol, round(notional * least(1.0, 10000.0 / total) * coalesce(scale, 1), 4) AS notional FROM l LEFT JOIN ga ON ga.day = l.day WHERE coalesce(scale, 1) > 0")
def _(spark, sf):
    """The book without its shorts, times the exposure that the strategy's equity allows that week."""
    weekly = fx.equity(spark, sf).groupBy(F.to_date(F.date_trunc("week", F.col("day").cast("timestamp"))).alias("day")).agg(F.max_by("equity", "day").alias("equity"))
    return bk.gated(bk.drop_shorts(target_book(spark, sf), ["day"], 10_000.0), bk.exposure_gate(weekly)).select(day(), "symbol", r("notional", 4))


@query("r07_guardrail", "trades", "+ d AS (SELECT pair_id, year(exit_day) AS y, exit_day, sum(pnl) AS pnl FROM trades GROUP BY 1, 2, 3), c AS (SELECT *, sum(pnl) OVER (PARTITION BY pair_id, y ORDER BY exit_day) AS eq FROM d), k AS (SELECT *, greatest(0, max(eq) OVER (PARTITION BY pair_id, y ORDER BY exit_day)) - eq AS dd FROM c), v AS (SELECT pair_id, y, sum(pnl) AS ret, max(dd) AS dd FROM k GROUP BY 1, 2) SELECT y, round(max(ret) FILTER (WHERE pair_id = '1-URGENT') - max(ret) FILTER (WHERE pair_id <> '1-URGENT'), 2) + 0.0 AS return_gap, round(max(dd) FILTER (WHERE pair_id = '1-URGENT') - max_by(dd, ret) FILTER (WHERE pair_id <> '1-URGENT'), 2) + 0.0 AS drawdown_gap FROM v GROUP BY 1")
def _(spark, sf):
    """A variant against the best of the fixed ones, by year: how much more it returns, and how much deeper it falls."""
    from ..operators import reports as rp

    d = fx.trades(spark, sf).groupBy("pair_id", F.year("exit_day").alias("y"), F.col("exit_day").alias("day")).agg(F.sum("pnl").alias("pnl"))
    run = W.partitionBy("pair_id", "y").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    c = d.withColumn("equity", F.sum("pnl").over(run))
    v = c.withColumn("fall", F.greatest(F.lit(0.0), F.max("equity").over(run)) - F.col("equity")).groupBy("pair_id", "y").agg(F.sum("pnl").alias("ret"), F.max("fall").alias("drawdown"))
    return rp.guardrail(v, "y", "pair_id", "1-URGENT").select("y", r("return_gap", 2), r("drawdown_gap", 2))


SILENT = "+ v AS (SELECT DISTINCT symbol || '/' || user_id % 7 AS feed, epoch_us(ts) // 1000 AS ms FROM ticks WHERE value > 0), n AS (SELECT *, lead(ms) OVER (PARTITION BY feed ORDER BY ms) AS next FROM v), m AS (SELECT max(ms) - 120000 AS mark FROM v), a AS (SELECT feed, ms AS since, ms + 10800000 AS told_at FROM n, m WHERE CASE WHEN next IS NULL THEN ms + 10800000 <= mark ELSE next > ms + 10800000 END)"


@query("st06_silence", "ticks", SILENT + " SELECT feed, since, told_at FROM a UNION ALL SELECT 'never/0', NULL, NULL")
def _(spark, sf):
    """Alarms of a stream while a feed is silent for over three hours, by timers; and feeds that were never heard."""
    rows = st.read_ticks(spark, sf).select(F.concat_ws("/", "symbol", (F.col("user_id") % 7).cast("string")).alias("feed"), "ts").withWatermark("ts", "2 minutes")
    out = st.drain(st.silence_alarms(rows, "feed", 3 * 3600), "st06").select(F.col("key").alias("feed"), "since", "told_at")
    heard = fx.ticks(spark, sf).where("value > 0").select(F.concat_ws("/", "symbol", (F.col("user_id") % 7).cast("string")).alias("feed")).distinct()
    expected = heard.unionByName(spark.createDataFrame([("never/0",)], "feed string"))
    never = expected.join(heard, "feed", "left_anti").select("feed", F.lit(None).cast("long").alias("since"), F.lit(None).cast("long").alias("told_at"))
    return out.unionByName(never)


LIVE = "+ c AS (SELECT symbol, ts + INTERVAL 60 SECOND AS closed, ts, value FROM ticks WHERE value > 0), m AS (SELECT max(closed) - INTERVAL 2 MINUTE AS mark FROM c), g AS (SELECT symbol, date_trunc('day', closed) AS start, max_by(value, ts) AS close FROM c GROUP BY 1, 2), d AS (SELECT symbol, CAST(start AS DATE) AS day, round(close, 6) AS close FROM g, m WHERE start + INTERVAL 1 DAY <= mark), n AS (SELECT count(DISTINCT symbol) AS n FROM d), b AS (SELECT t.symbol AS target, t.day, ln(t.close) - (sum(ln(p.close)) / count(*)) AS spread, count(*) AS peers FROM d t JOIN d p ON p.day = t.day AND p.symbol <> t.symbol GROUP BY 1, 2, t.close), z AS (SELECT target, day, round(spread / 0.4, 6) AS z FROM b, n WHERE peers = n - 1), l AS (SELECT *, CASE WHEN z < -0.5 THEN 1 WHEN z > 0.5 THEN -1 END AS signal FROM z), f AS (SELECT *, coalesce(last_value(signal IGNORE NULLS) OVER w, 0) AS position, coalesce(last_value(signal IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l WINDOW w AS (PARTITION BY target ORDER BY day))"


def basket_stream(spark, sf, live_from=None):
    """Daily closes of a stream, each fanned out by a static join to the baskets that it is part of; positions by basket."""
    daily = st.windowed(st.stamped(st.read_ticks(spark, sf)), "1 day").select("symbol", F.to_date("start").alias("day"), F.round("close", 6).alias("close"))
    symbols = written(fx.ticks(spark, sf).select("symbol").distinct(), "st10-symbols")
    legs = symbols.select(F.col("symbol").alias("target")).join(symbols, F.lit(True))  # a few symbols: every one against the others
    size = symbols.count()
    machine = st.SessionBasket(size, 0.0, 0.4, 0.5, live_from)
    rows = st.fanned(daily, legs, "symbol", "st10-legs").select("target", "day", "symbol", "close")
    rows = st.staged(rows, "st10-closes")  # one stateful step a query: the closes are a table that the next stream reads
    out = st.fold_stream(rows, "target", "string", ["day", "symbol"], lambda s, x: machine.step(s, x.day, x.symbol == x.target, x.close), "target string, day date, symbol string, close double, z double, position int, changed boolean")
    return st.drain(out, "st10").where("z is not null").select("target", day(), r("z"), "position", "changed")


@query("st10_session_baskets", "ticks", LIVE + " SELECT target, day::VARCHAR AS day, z, position, position <> before AS changed FROM f")
def _(spark, sf):
    return basket_stream(spark, sf)


@query("st12_warm_up", "ticks", LIVE + " SELECT target, day::VARCHAR AS day, z, position, position <> before AS changed FROM f WHERE day >= DATE '2024-01-15'")
def _(spark, sf):
    """The days before the first live one are replayed into the state and say nothing."""
    import datetime

    return basket_stream(spark, sf, datetime.date(2024, 1, 15))
