"""Holdings, fills, overlays and further reports."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import book as bk
from ..operators import features as ft
from ..operators import ledger as lg
from ..operators import reports as rp
from ..operators import signals as sg
from ..operators import stats
from ..operators import tables as op
from . import fixtures as fx
from .book_queries import BOOK, LEGS, legs, target_book
from .feature_queries import ret
from .registry import query
from .stat_queries import BV, BY, ROWS, SPREAD, TLS, V, pair_rows, spreads
from .table_queries import day, r

EVENTS = "WITH e AS (SELECT o_custkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'entry' ELSE 'exit' END AS kind, o_orderkey AS w, round(o_totalprice, 2) AS price FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY k, kind ORDER BY w) AS n FROM e)"


@query("j10_trade_pairing", "", EVENTS + " SELECT a.k, a.n, a.w AS entry_at, b.w AS exit_at, a.price AS entry_price, b.price AS exit_price FROM n a JOIN n b ON a.k = b.k AND a.n = b.n AND a.kind = 'entry' AND b.kind = 'exit'")
def _(spark, sf):
    e = fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 2 == 0, "entry").otherwise("exit").alias("kind"), F.col("o_orderkey").alias("at"), F.round("o_totalprice", 2).alias("price"))
    return lg.paired_trades(e, "k", ["at"])


@query("j12_refresh_pairs", "", "WITH a AS (SELECT c_custkey AS pair_id FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey AS pair_id FROM customer WHERE c_custkey % 5 <> 0), o AS (SELECT DISTINCT o_custkey AS pair_id FROM orders) SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, CASE WHEN a.pair_id IS NOT NULL AND b.pair_id IS NOT NULL THEN 'update' WHEN b.pair_id IS NOT NULL THEN 'add' WHEN o.pair_id IS NOT NULL THEN 'tighten' ELSE 'drop' END AS action FROM a FULL JOIN b ON a.pair_id = b.pair_id LEFT JOIN o ON o.pair_id = coalesce(a.pair_id, b.pair_id)")
def _(spark, sf):
    c = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("pair_id"))
    opened = fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("pair_id")).distinct()
    return lg.refreshed_pairs(c.where("pair_id % 3 <> 0"), c.where("pair_id % 5 <> 0"), opened)


@query("j13_pair_direction", "sectors pairs books", "SELECT leg_a, leg_b, CAST(CASE WHEN x.target_shares * y.target_shares < 0 THEN sign(x.target_shares) ELSE 0 END AS INT) AS direction FROM pairs JOIN books x ON x.symbol = leg_a JOIN books y ON y.symbol = leg_b")
def _(spark, sf):
    return lg.pair_direction(fx.candidates(spark, sf), fx.books(spark, sf).select("symbol", F.col("target_shares").alias("shares"))).select("leg_a", "leg_b", "direction")


@query("j14_held_position", "books", "SELECT symbol AS target, CAST(CASE WHEN abs(current_shares) < 0.5 THEN 0 ELSE sign(current_shares) END AS INT) AS position FROM books")
def _(spark, sf):
    b = fx.books(spark, sf)
    return lg.held_position(b.select(F.col("symbol").alias("target")), b.select("symbol", F.col("current_shares").alias("shares"))).select("target", "position")


@query("a13_experiment_metrics", "trades", "+ x AS (SELECT *, sum(pnl) OVER (PARTITION BY pair_id ORDER BY exit_day, trade_id ROWS UNBOUNDED PRECEDING) AS run FROM trades), y AS (SELECT *, greatest(0, max(run) OVER (PARTITION BY pair_id ORDER BY exit_day, trade_id ROWS UNBOUNDED PRECEDING)) - run AS dd FROM x) SELECT pair_id, count(*) AS n, round(100.0 * count(*) FILTER (WHERE pnl > 0) / count(*), 6) AS win_pct, round(max(dd), 2) AS max_drawdown, count(*) FILTER (WHERE exit_reason = 'F') AS n_f, count(*) FILTER (WHERE exit_reason = 'O') AS n_o FROM y GROUP BY 1")
def _(spark, sf):
    t = ft.with_drawdown(fx.trades(spark, sf), "pnl", ["pair_id"], ["exit_day", "trade_id"])
    return t.groupBy("pair_id").agg(F.count("*").alias("n"), F.round(100.0 * F.count_if(F.col("pnl") > 0) / F.count("*"), 6).alias("win_pct"), F.round(F.max("drawdown"), 2).alias("max_drawdown"), F.count_if(F.col("exit_reason") == "F").alias("n_f"), F.count_if(F.col("exit_reason") == "O").alias("n_o"))


@query("a19_conflict_ratio", BV, f"{BOOK} SELECT day::VARCHAR AS day, round(sum(CASE WHEN notional < 0 AND symbol IN (SELECT symbol FROM sectors WHERE sector = 'S1') THEN -notional ELSE 0 END) / sum(abs(notional)), 6) AS conflict FROM book GROUP BY 1")
def _(spark, sf):
    lead = fx.sectors(spark, sf).where("sector = 'S1'").select("symbol", F.lit(True).alias("leads"))
    b = target_book(spark, sf).join(lead, "symbol", "left")
    return b.groupBy("day").agg(F.round(F.sum(F.when((F.col("notional") < 0) & F.col("leads"), -F.col("notional")).otherwise(0.0)) / F.sum(F.abs("notional")), 6).alias("conflict")).select(day(), "conflict")


@query("a21_metric_distribution", "ticks", "SELECT symbol, count(*) AS n, min(value) AS min, max(value) AS max, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM ticks GROUP BY 1")
def a21(spark, sf):
    return lg.distribution(fx.ticks(spark, sf), ["symbol"], "value")


ROTATE = "+ t AS (SELECT *, round(pnl / 1e4, 6) AS edge FROM trades), q AS (SELECT exit_day, max(edge) AS best FROM t WHERE exit_reason = 'F' GROUP BY 1), c AS (SELECT t.*, best, pnl > 0 AND edge < round(best - 2 * 0.5, 6) AS wants FROM t JOIN q USING (exit_day) WHERE exit_reason <> 'F'), k AS (SELECT *, row_number() OVER (PARTITION BY exit_day, wants ORDER BY edge, trade_id) AS place FROM c) SELECT trade_id, wants AND place <= 2 AS rotate FROM k"


@query("t22_rotation", "trades", ROTATE)
def _(spark, sf):
    """Which open trades make room for the best finished one of their day: the weakest two that gain less by two costs."""
    t = fx.trades(spark, sf).withColumn("edge", F.round(F.col("pnl") / 1e4, 6))
    queue = t.where("exit_reason = 'F'").groupBy("exit_day").agg(F.max("edge").alias("best"))
    rows = t.where("exit_reason <> 'F'").join(queue, "exit_day").withColumn("wants", lg.should_rotate(F.col("pnl"), F.col("edge"), F.col("best"), 0.5))
    place = F.row_number().over(W.partitionBy("exit_day", "wants").orderBy("edge", "trade_id"))
    return rows.select("trade_id", (F.col("wants") & (place <= 2)).alias("rotate"))


@query("t23_beta_refresh", V, f"{ROWS}, {TLS}, g AS (SELECT leg_a, leg_b, beta, n >= 30 AND vy > 0 AND 1 - (vy - 2 * beta * c + beta * beta * vx) / vy >= 0.3 AND abs(beta) <= 5 AS good FROM f) SELECT leg_a, leg_b, round(CASE WHEN good THEN beta ELSE 1 END, 4) AS beta, coalesce(good, false) AS refreshed FROM pairs LEFT JOIN g USING (leg_a, leg_b)")
def t23(spark, sf):
    """New slopes where the fit is sound, else the old one."""
    fit = stats.tls(pair_rows(spark, sf), BY, "x", "y")
    good = (F.col("n") >= 30) & (F.col("r2") >= 0.30) & (F.abs("beta") <= 5)
    return fx.candidates(spark, sf).join(fit, BY, "left").select(*BY, r(F.coalesce(F.when(good, F.col("beta")), F.lit(1.0)), 4, "beta"), F.coalesce(good, F.lit(False)).alias("refreshed"))


@query("t24_t25_compute_z", V, f"{SPREAD}, g AS (SELECT leg_a, leg_b, avg(spread) AS mean, stddev_samp(spread) AS std, max_by(spread, k) AS last FROM s GROUP BY 1, 2) SELECT leg_a, leg_b, round(mean, 3) AS mean, round(std, 4) AS std, round(CASE WHEN std > 1e-12 THEN (last - mean) / std END, 4) AS z FROM g")
def t24(spark, sf):
    s = spreads(spark, sf)
    g = s.groupBy(*BY).agg(F.avg("spread").alias("mean"), F.stddev_samp("spread").alias("std"), F.max_by("spread", "k").alias("last"))
    z = F.when(F.col("std") > 1e-12, (F.col("last") - F.col("mean")) / F.col("std"))
    return g.select(*BY, r("mean", 3), r("std", 4), r(z, 4, "z"))


@query("g17_net_bps", "", "SELECT l_orderkey, l_linenumber, round((CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END) * (l_tax - 0.8 * l_discount) / 1.8 * 1e4 - 10, 4) AS bps FROM lineitem")
def _(spark, sf):
    side = F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(-1)
    return fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(sg.trade_bps(F.col("l_tax").cast("double"), F.col("l_discount").cast("double"), F.lit(0.8), side), 4).alias("bps"))


@query("p06_sleeve_budget", BV, f"{BOOK}, g AS (SELECT day, sum(abs(notional)) AS gross FROM book GROUP BY 1) SELECT day::VARCHAR AS day, round(greatest(0, least(1, (40000 - least(15000.0, 40000)) / gross)), 6) AS scale FROM g".replace("g AS (SELECT day, sum", "gz AS (SELECT day, sum").replace("FROM g\"", "FROM gz\"").replace("AS scale FROM g", "AS scale FROM gz"))
def _(spark, sf):
    g = target_book(spark, sf).groupBy("day").agg(F.sum(F.abs("notional")).alias("gross"))
    return g.select(day(), F.round(lg.sleeve_scale(F.col("gross"), F.lit(15000.0), 40000.0), 6).alias("scale"))


@query("p15_symbol_support", BV, f"{LEGS} SELECT day::VARCHAR AS day, symbol, count(*) FILTER (WHERE notional > 0) AS long, count(*) FILTER (WHERE notional < 0) AS short, count(*) FILTER (WHERE symbol = target) AS as_target, count(*) FILTER (WHERE symbol <> target) AS as_peer FROM lg GROUP BY 1, 2")
def _(spark, sf):
    return lg.symbol_support(legs(spark, sf), ["day"]).select(day(), "symbol", "long", "short", "as_target", "as_peer")


@query("p15_trade_class", "books", "SELECT symbol, CASE WHEN current_shares * target_shares < 0 THEN 'flip' WHEN abs(target_shares) > abs(current_shares) THEN 'increase' WHEN abs(target_shares) < abs(current_shares) THEN 'reduction' ELSE 'hold' END AS class FROM books WHERE current_shares <> 0 AND target_shares <> 0")
def _(spark, sf):
    b = fx.books(spark, sf).where("current_shares <> 0 and target_shares <> 0")
    return b.select("symbol", lg.trade_class(F.col("current_shares"), F.col("target_shares"), F.lit(1), F.lit(0)).alias("class"))


@query("p16_reallocation_band", f"{BV} books", f"{LEGS}, su AS (SELECT day, symbol, count(*) FILTER (WHERE notional > 0) AS long, count(*) FILTER (WHERE notional < 0) AS short FROM lg GROUP BY 1, 2), ls AS (SELECT symbol, arg_max(long, day) AS long, arg_max(short, day) AS short FROM su GROUP BY 1), lc AS (SELECT symbol, arg_max(close, day) AS price FROM closes GROUP BY 1) SELECT symbol, CASE WHEN current_shares * target_shares > 0 AND abs(target_shares - current_shares) <= 800 AND abs(target_shares - current_shares) * price <= 1000000 AND CASE WHEN current_shares > 0 THEN long ELSE short END > 0 AND abs(current_shares) >= 0.5 THEN current_shares ELSE target_shares END AS shares FROM books LEFT JOIN ls USING (symbol) LEFT JOIN lc USING (symbol)")
def _(spark, sf):
    """Target shares, current ones kept where a change is small and baskets of the symbol's last day support its side."""
    support = lg.symbol_support(legs(spark, sf), ["day"]).groupBy("symbol").agg(F.max_by("long", "day").alias("long"), F.max_by("short", "day").alias("short"))
    last = fx.closes(spark, sf).groupBy("symbol").agg(F.max_by("close", "day").alias("price"))
    rows = fx.books(spark, sf).join(support, "symbol", "left").join(last, "symbol", "left")
    side = F.when(F.col("current_shares") > 0, F.col("long")).otherwise(F.col("short"))
    return rows.select("symbol", lg.reallocation_band(F.col("current_shares"), F.col("target_shares"), F.col("price"), side, 800, 1_000_000).alias("shares"))


FILLS = "+ o AS (SELECT o_orderkey AS order_id, 'Brand#' || (11 + (o_orderkey % 5) * 10 + o_orderkey % 3) AS symbol, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS side FROM orders)"


def day_orders(spark, sf):
    k = F.col("o_orderkey")
    return fx.table(spark, sf, "orders").select(k.alias("order_id"), F.concat(F.lit("Brand#"), (11 + (k % 5) * 10 + k % 3).cast("string")).alias("symbol"), F.to_date("o_orderdate").alias("day"), F.when(k % 2 == 0, "buy").otherwise("sell").alias("side"))


@query("p22_next_open_fills", "closes", FILLS + " SELECT order_id, round(c.close * (1 + CASE side WHEN 'buy' THEN 5 ELSE -5 END / 1e4), 9) AS price FROM o ASOF JOIN closes c ON o.symbol = c.symbol AND o.day < c.day")
def _(spark, sf):
    o = day_orders(spark, sf)
    f = op.next_after(o, fx.closes(spark, sf)).join(o.select("order_id", "side"), "order_id").where("price is not null")
    return f.select("order_id", F.round(lg.fill_price(F.col("price"), F.col("side"), 5.0), 9).alias("price"))


@query("p23_same_close_fills", "closes", FILLS + " SELECT order_id, round(c.close, 6) AS price FROM o JOIN closes c ON c.symbol = o.symbol AND c.day = CAST(date_trunc('week', o.day) AS DATE)")
def _(spark, sf):
    o = day_orders(spark, sf).withColumn("day", F.to_date(F.date_trunc("week", F.col("day").cast("timestamp"))))
    return o.join(fx.closes(spark, sf), ["symbol", "day"]).select("order_id", r("close", 6, "price"))


@query("p20_open_orders", "books", "SELECT symbol, current_shares + 0.25 * abs(target_shares) AS shares FROM books WHERE abs(current_shares + 0.25 * abs(target_shares)) >= 0.5")
def _(spark, sf):
    b = fx.books(spark, sf)
    left = b.select("symbol", F.lit("buy").alias("side"), (0.25 * F.abs("target_shares")).alias("qty"))
    return bk.apply_orders(b, left, ["symbol"])


@query("p26_second_phase", "books", "SELECT symbol, current_shares * target_shares >= 0 OR current_shares % 2 = 0 OR (current_shares % 2) * target_shares > 0 AS allowed FROM books")
def _(spark, sf):
    now = F.col("current_shares") % 2
    return fx.books(spark, sf).select("symbol", lg.second_phase_allowed(F.col("current_shares"), F.col("target_shares"), now).alias("allowed"))


@query("p28_unrealised", "books closes", "+ l AS (SELECT symbol, max_by(close, day) AS close, avg(close) AS average FROM closes GROUP BY 1) SELECT symbol, round(current_shares * (close - average), 4) AS pnl FROM books JOIN l USING (symbol)")
def _(spark, sf):
    last = fx.closes(spark, sf).groupBy("symbol").agg(F.max_by("close", "day").alias("close"), F.avg("close").alias("average"))
    return fx.books(spark, sf).join(last, "symbol").select("symbol", F.round(F.col("current_shares") * (F.col("close") - F.col("average")), 4).alias("pnl"))


@query("p30_settled", "books sectors", "SELECT sector, count(*) FILTER (WHERE round(abs(target_shares - current_shares)) > 0) = 0 AS settled FROM books JOIN sectors USING (symbol) GROUP BY 1")
def _(spark, sf):
    return lg.settled(fx.books(spark, sf).join(fx.sectors(spark, sf), "symbol"), ["sector"])


@query("r03_backtest_curve", "trades", "+ d AS (SELECT exit_day AS day, sum(pnl) AS p FROM trades GROUP BY 1), c AS (SELECT day, sum(p) OVER (ORDER BY day) AS run FROM d), x AS (SELECT *, greatest(0, max(run) OVER (ORDER BY day)) AS peak FROM c) SELECT day::VARCHAR AS day, round(run, 1) + 0.0 AS running, round(peak - run, 1) AS drawdown, round(max(peak - run) OVER (ORDER BY day), 1) AS worst FROM x")
def _(spark, sf):
    d = fx.trades(spark, sf).groupBy(F.col("exit_day").alias("day")).agg(F.sum("pnl").alias("pnl")).withColumn("run_id", F.lit("r"))
    x = ft.with_drawdown(d, "pnl", ["run_id"], ["day"])
    worst = F.max("drawdown").over(W.partitionBy("run_id").orderBy("day"))
    return x.withColumn("worst", worst).select(day(), r("running", 1), r("drawdown", 1), r("worst", 1))


@query("r06_signal_backtest", "bars", f"+ s AS (SELECT symbol, ts, {ret(1)} AS r1, lead(open) OVER w AS fill, lead(close) OVER w AS mark FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)) SELECT symbol, count(*) AS n, round(sum(mark / fill - 1), 6) AS total FROM s WHERE r1 < -0.2 AND fill > 0 AND mark IS NOT NULL GROUP BY 1")
def _(spark, sf):
    w = W.partitionBy("symbol").orderBy("ts")
    b = ft.with_returns(fx.bars(spark, sf)).withColumns({"fill": F.lead("open").over(w), "mark": F.lead("close").over(w)})
    return b.where("return_1 < -0.2 and fill > 0 and mark is not null").groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.sum(F.col("mark") / F.col("fill") - 1), 6).alias("total"))


@query("s16_picks", BV, f"{BOOK}, g AS (SELECT day, sum(greatest(notional, 0)) AS l FROM book GROUP BY 1) SELECT day::VARCHAR AS day, symbol, round(notional / l, 6) AS weight FROM book JOIN g USING (day) WHERE l > 0".replace("g AS (SELECT day, sum(greatest", "gk AS (SELECT day, sum(greatest").replace("JOIN g USING", "JOIN gk USING"))
def _(spark, sf):
    b = target_book(spark, sf)
    gross = F.sum(F.when(F.col("notional") > 0, F.col("notional")).otherwise(0.0)).over(W.partitionBy("day"))
    return b.withColumn("gross", gross).where("gross > 0").select(day(), "symbol", F.round(F.col("notional") / F.col("gross"), 6).alias("weight"))


@query("o02_minute_order", "ticks", "SELECT event_id, row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY date_trunc('minute', ts), symbol, event_id) AS place FROM ticks")
def _(spark, sf):
    w = W.partitionBy(F.date_trunc("day", "ts")).orderBy(F.date_trunc("minute", "ts"), "symbol", "event_id")
    return fx.ticks(spark, sf).select("event_id", F.row_number().over(w).alias("place"))


@query("o07_union_of_keys", "", "SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS orders, coalesce(b.n, 0) AS customers FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT c_custkey AS k, count(*) AS n FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1) b ON a.k = b.k")
def _(spark, sf):
    a = fx.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("orders"))
    b = fx.table(spark, sf, "customer").where("c_custkey % 2 = 0").groupBy(F.col("c_custkey").alias("k")).agg(F.count("*").alias("customers"))
    return a.join(b, "k", "full").select("k", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("customers", F.lit(0)).alias("customers"))

