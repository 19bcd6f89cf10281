"""Books, orders, fills and reports over basket positions, trades and the brand books."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import book as bk
from ..operators import ledger as lg
from ..operators import reports as rp
from ..sources.shared import written
from . import fixtures as fx
from .registry import query
from .signal_queries import ZS, basket_positions
from .stat_queries import BV
from .table_queries import day, r

MOST, CAPITAL, LEVERAGE = 5, 10_000.0, 4.0
NOTIONAL = bk.notional_per_basket(CAPITAL, LEVERAGE, MOST)
ADMIT = f"{ZS}, a AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY abs(z) DESC, target) AS place FROM pos WHERE position <> 0)"
LEGS = f"{ADMIT}, lg AS (SELECT day, target, target AS symbol, position * 0.5 * {NOTIONAL} AS notional FROM a WHERE place <= {MOST} UNION ALL SELECT a.day, a.target, b.peer, -position * 0.5 / size * {NOTIONAL} FROM a JOIN baskets b USING (target) JOIN n USING (target) WHERE place <= {MOST})"
BOOK = f"{LEGS}, book AS (SELECT day, symbol, sum(notional) AS notional FROM lg GROUP BY 1, 2 HAVING abs(sum(notional)) > 1e-9)"


def admitted(spark, sf, key="p_brand"):
    return bk.admit(basket_positions(spark, sf, key), ["day"], MOST)


def legs(spark, sf, key="p_brand"):
    return bk.basket_legs(admitted(spark, sf, key).where("admitted"), fx.baskets(spark, sf, key), NOTIONAL)


def target_book(spark, sf, key="p_brand"):
    return bk.summed(legs(spark, sf, key), ["day"])


def basket_book_equity(spark, sf, key="p_brand"):
    """The flagship: fits, positions, admission, legs, shares, marks."""
    closes = fx.closes(spark, sf, key)
    shares, _ = bk.target_shares(target_book(spark, sf, key), closes, ["day", "symbol"])
    return bk.equity_curve(shares, closes, CAPITAL).select(day(), r("pnl", 3), r("equity", 3))


@query("p02_admission_cap", BV, f"{ADMIT} SELECT day::VARCHAR AS day, target, place, place <= {MOST} AS admitted FROM a")
def _(spark, sf):
    return admitted(spark, sf).select(day(), "target", "place", "admitted")


@query("p01_p03_legs", BV, f"{LEGS} SELECT day::VARCHAR AS day, target, symbol, round(notional, 4) AS notional FROM lg")
def _(spark, sf):
    return legs(spark, sf).select(day(), "target", "symbol", r("notional", 4))


@query("a05_book", BV, f"{BOOK} SELECT day::VARCHAR AS day, symbol, round(notional, 4) AS notional FROM book")
def _(spark, sf):
    return target_book(spark, sf).select(day(), "symbol", r("notional", 4))


@query("a06_a07_book_summary", BV, f"{BOOK} SELECT day::VARCHAR AS day, round(sum(greatest(notional, 0)), 4) AS gross_long, round(sum(greatest(-notional, 0)), 4) AS gross_short, round(max(abs(notional)), 4) AS max_abs, round(quantile_cont(abs(notional), 0.5), 4) AS median_abs FROM book GROUP BY 1")
def _(spark, sf):
    return bk.summary(target_book(spark, sf), ["day"]).select(day(), r("gross_long", 4), r("gross_short", 4), r("max_abs", 4), r("median_abs", 4))


@query("p04_short_suppression", BV, f"{ZS} SELECT day::VARCHAR AS day, target FROM pos WHERE position > 0 OR (position < 0 AND NOT (sector IN ('S1', 'S2') AND month(day) % 2 = 0))")
def _(spark, sf):
    p = basket_positions(spark, sf).where("position <> 0")
    active = p.select("day", "sector").distinct().where("sector in ('S1', 'S2') and month(day) % 2 = 0")
    return bk.without_shorts_of(p, active).select(day(), "target")


@query("p05_long_only_sleeve", "closes sectors", "SELECT day::VARCHAR AS day, symbol, round(5000.0 / count(*) OVER (PARTITION BY day), 6) AS notional FROM closes JOIN sectors USING (symbol) WHERE sector = 'S1'")
def _(spark, sf):
    s = fx.closes(spark, sf).join(fx.sectors(spark, sf).where("sector = 'S1'"), "symbol", "left_semi").select("day", "symbol")
    return bk.long_only_sleeve(s, 5000.0, ["day"]).select(day(), "symbol", r("notional"))


@query("p07_merge_books", BV, f"{BOOK}, u AS (SELECT day, symbol, notional * 0.5 AS notional FROM book UNION ALL SELECT day, 'Brand#11', 100.0 FROM (SELECT DISTINCT day FROM book)) SELECT day::VARCHAR AS day, symbol, round(sum(notional), 4) AS notional FROM u GROUP BY 1, 2")
def _(spark, sf):
    b = target_book(spark, sf)
    sleeve = b.select("day").distinct().select("day", F.lit("Brand#11").alias("symbol"), F.lit(100.0).alias("notional"))
    return bk.merge_books(b.withColumn("notional", F.col("notional") * 0.5), sleeve, by=["day"]).select(day(), "symbol", r("notional", 4))


@query("p08_drop_shorts", BV, f"{BOOK}, l AS (SELECT *, sum(notional) OVER (PARTITION BY day) AS total FROM book WHERE notional > 0) SELECT day::VARCHAR AS day, symbol, round(notional * least(1.0, 10000.0 / total), 4) AS notional FROM l")
def _(spark, sf):
    return bk.drop_shorts(target_book(spark, sf), ["day"], 10_000.0).select(day(), "symbol", r("notional", 4))


@query("p09_peer_mirror", BV, f"{LEGS}, w AS (SELECT *, sum(greatest(notional, 0)) OVER (PARTITION BY day, target) AS l, sum(greatest(-notional, 0)) OVER (PARTITION BY day, target) AS s FROM lg) SELECT day::VARCHAR AS day, target, symbol, round(notional * (1 + s / l), 4) AS notional FROM w WHERE notional > 0")
def _(spark, sf):
    return bk.mirror_peers(legs(spark, sf), ["day"]).select(day(), "target", "symbol", r("notional", 4))


@query("p10_short_penalty", BV, f"{LEGS}, gl AS (SELECT day, symbol, sum(greatest(notional, 0)) AS l, sum(greatest(-notional, 0)) AS s FROM lg GROUP BY 1, 2) SELECT day::VARCHAR AS day, symbol, round(l - 0.5 * s, 4) AS notional FROM gl WHERE l - 0.5 * s > 0 AND l >= 0.6 * (l + 0.5 * s)")
def _(spark, sf):
    return bk.penalise_shorts(legs(spark, sf), ["day"]).select(day(), "symbol", r("notional", 4))


@query("p11_p12_target_shares", BV, f"{BOOK} SELECT b.day::VARCHAR AS day, b.symbol, trunc(round(notional / close, 9)) AS shares FROM book b JOIN closes c ON c.symbol = b.symbol AND c.day = b.day WHERE abs(trunc(round(notional / close, 9))) >= 1")
def _(spark, sf):
    shares, _ = bk.target_shares(target_book(spark, sf).withColumn("notional", F.round("notional", 9)), fx.closes(spark, sf), ["day", "symbol"])
    return shares.select(day(), "symbol", (F.col("shares") + 0.0).alias("shares"))


@query("j09_missing_prices", BV, f"{BOOK} SELECT day::VARCHAR AS day, symbol FROM book b WHERE NOT EXISTS (SELECT 1 FROM closes c WHERE c.symbol = b.symbol AND c.day = b.day AND year(c.day) <> 1997)")
def _(spark, sf):
    _, missing = bk.target_shares(target_book(spark, sf), fx.closes(spark, sf).where("year(day) <> 1997"), ["day", "symbol"])
    return missing.select(day(), "symbol")


@query("p13_j08_orders", "books", "SELECT symbol, CASE WHEN target_shares > current_shares THEN 'buy' ELSE 'sell' END AS side, round(abs(target_shares - current_shares)) AS qty FROM books WHERE round(abs(target_shares - current_shares)) > 0")
def _(spark, sf):
    return bk.orders_between(fx.books(spark, sf)).select("symbol", "side", "qty")


@query("p14_staged_orders", "books", "SELECT symbol, 1 AS phase, CASE WHEN current_shares > 0 THEN 'sell' ELSE 'buy' END AS side, abs(current_shares) AS qty FROM books WHERE current_shares * target_shares < 0 UNION ALL SELECT symbol, 2, CASE WHEN target_shares > 0 THEN 'buy' ELSE 'sell' END, abs(target_shares) FROM books WHERE current_shares * target_shares < 0 UNION ALL SELECT symbol, CASE WHEN abs(target_shares) < abs(current_shares) THEN 1 ELSE 2 END, CASE WHEN target_shares > current_shares THEN 'buy' ELSE 'sell' END, abs(target_shares - current_shares) FROM books WHERE current_shares * target_shares >= 0 AND target_shares <> current_shares")
def _(spark, sf):
    return bk.staged_orders(fx.books(spark, sf)).select("symbol", "phase", "side", "qty")


@query("a08_a09_order_flow", "books", "+ k AS (SELECT CASE WHEN current_shares = 0 AND target_shares <> 0 THEN 'open' WHEN current_shares <> 0 AND target_shares = 0 THEN 'close' WHEN current_shares * target_shares < 0 THEN 'flip' WHEN abs(target_shares) > abs(current_shares) THEN 'increase' WHEN abs(target_shares) < abs(current_shares) THEN 'reduce' ELSE 'keep' END AS kind, abs(target_shares - current_shares) AS q FROM books) SELECT kind, count(*) AS n, round(sum(q), 4) AS shares FROM k GROUP BY 1")
def _(spark, sf):
    c, t = F.col("current_shares"), F.col("target_shares")
    return fx.books(spark, sf).groupBy(bk.flow_kind(c, t).alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum(F.abs(t - c)), 4).alias("shares"))


@query("a10_class_counts", "books", "+ c(kind) AS (VALUES ('open'), ('close'), ('flip'), ('increase'), ('reduce'), ('keep')), k AS (SELECT CASE WHEN current_shares * target_shares < 0 THEN 'flip' WHEN abs(target_shares) > abs(current_shares) THEN 'increase' WHEN abs(target_shares) < abs(current_shares) THEN 'reduce' ELSE 'keep' END AS kind FROM books WHERE current_shares <> 0 AND target_shares <> 0) SELECT c.kind, count(k.kind) AS n FROM c LEFT JOIN k USING (kind) GROUP BY 1")
def _(spark, sf):
    kinds = spark.createDataFrame([(k,) for k in ("open", "close", "flip", "increase", "reduce", "keep")], "kind string")
    c, t = F.col("current_shares"), F.col("target_shares")
    have = fx.books(spark, sf).where((c != 0) & (t != 0)).select(bk.flow_kind(c, t).alias("kind"), F.lit(1).alias("one"))
    return kinds.join(have, "kind", "left").groupBy("kind").agg(F.count("one").alias("n"))


DRIFT = "+ l AS (SELECT symbol, max_by(close, day) AS close FROM closes GROUP BY 1), d AS (SELECT symbol, current_shares - target_shares AS delta, current_shares * close AS a, target_shares * close AS b FROM books JOIN l USING (symbol)), s AS (SELECT sum(abs(a)) AS ga, sum(abs(b)) AS gb, greatest(sum(abs(a)), sum(abs(b)), 1.0) AS scale FROM d), v AS (SELECT list_sort(list(abs(a - b) / scale * 1e4)) AS s FROM d, s), o AS (SELECT s[1 + CAST(floor((len(s) - 1) * 0.5 + 0.5) AS INT)] AS p50, s[1 + CAST(floor((len(s) - 1) * 0.95 + 0.5) AS INT)] AS p95, s[len(s)] AS most FROM v)"


def drifts(spark, sf):
    return bk.drift(fx.books(spark, sf), fx.closes(spark, sf).groupBy("symbol").agg(F.max_by("close", "day").alias("close")))


@query("a11_position_drift", "books closes", DRIFT + " SELECT round(p50, 5) AS p50, round(p95, 5) AS p95, round(most, 5) AS max, round(100 * abs(ga - gb) / greatest(gb, 1), 5) AS apart, 100 * abs(ga - gb) / greatest(gb, 1) > 10 OR p50 > 50 OR p95 > 200 AS breach FROM o, s")
def _(spark, sf):
    """Order statistics of the books' drift, how far their gross is apart in percent, and whether that is too much."""
    last = fx.closes(spark, sf).groupBy("symbol").agg(F.max_by("close", "day").alias("close"))
    gross = fx.books(spark, sf).join(last, "symbol").agg(F.sum(F.abs("current_shares") * F.col("close")).alias("ga"), F.sum(F.abs("target_shares") * F.col("close")).alias("gb"))
    row = bk.nearest_rank(drifts(spark, sf), "bps", "symbol", (0.5, 0.95)).join(F.broadcast(gross))
    apart = 100 * F.abs(F.col("ga") - F.col("gb")) / F.greatest(F.col("gb"), F.lit(1.0))
    return row.select(r("p50", 5), r("p95", 5), r("max", 5), F.round(apart, 5).alias("apart"), bk.drifted(apart, F.col("p50"), F.col("p95")).alias("breach"))


@query("a11_drift_sample", "books closes", DRIFT + " SELECT symbol, delta AS delta_shares, round(abs(a - b), 2) AS delta_notional, round(abs(a - b) / scale * 1e4, 5) AS bps FROM d, s QUALIFY row_number() OVER (ORDER BY round(abs(a - b), 2) DESC, symbol) <= 8")
def _(spark, sf):
    """The eight symbols that have drifted most."""
    return drifts(spark, sf).select("symbol", "delta_shares", r("delta_notional", 2), r("bps", 5)).orderBy(F.desc("delta_notional"), "symbol").limit(8)


@query("p17_apply_orders", "books", "SELECT symbol, current_shares + CASE WHEN target_shares > current_shares THEN 1 ELSE -1 END * round(abs(target_shares - current_shares)) AS shares FROM books WHERE abs(current_shares + CASE WHEN target_shares > current_shares THEN 1 ELSE -1 END * round(abs(target_shares - current_shares))) >= 0.5")
def _(spark, sf):
    b = fx.books(spark, sf)
    return bk.apply_orders(b, bk.orders_between(b), ["symbol"])


@query("p21_top_deltas", "books", "SELECT symbol, abs(target_shares - current_shares) AS delta FROM books ORDER BY 2 DESC, 1 LIMIT 8")
def _(spark, sf):
    return fx.books(spark, sf).select("symbol", F.abs(F.col("target_shares") - F.col("current_shares")).alias("delta")).orderBy(F.desc("delta"), "symbol").limit(8)


PATHS = "lc AS (SELECT symbol, arg_max(close, day) AS price FROM closes GROUP BY 1), f AS (SELECT p_brand AS symbol, year(l_shipdate) AS year, o_custkey AS id, CAST(l_shipdate AS DATE) AS day, l_orderkey, l_linenumber, CAST(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE -l_quantity END AS DOUBLE) AS q FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag <> 'N')"
WALK = "{p} AS (SELECT f.*, price, coalesce(b.shares, 0) + sum(q) OVER (PARTITION BY {k}, f.symbol ORDER BY day, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS held FROM f LEFT JOIN lc USING (symbol) LEFT JOIN ({start}) b USING (symbol)), {p}c AS (SELECT *, (abs(held) - abs(held - q)) * coalesce(price, 0) AS change FROM {p}), {p}r AS (SELECT *, sum(change) OVER (PARTITION BY {k} ORDER BY day, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS run FROM {p}c)"


def order_path(spark, sf):
    """Signed shares of returned and accepted lines, one by one, with each symbol's last price. Both tables are written, as
    they are read several times: for the ranges of a global order, for the paths that there are, and by the walk."""
    q = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(-F.col("l_quantity")).cast("double")
    price = written(fx.closes(spark, sf).groupBy("symbol").agg(F.max_by("close", "day").alias("price")), "prices")
    owner = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("id"))
    rows = fx.lines(spark, sf).where("l_returnflag <> 'N'").join(owner, "l_orderkey")
    rows = rows.select(F.col("p_brand").alias("symbol"), F.year("l_shipdate").alias("year"), "id", F.to_date("l_shipdate").alias("day"), "l_orderkey", "l_linenumber", q.alias("q"))
    return written(rows.join(price, "symbol", "left"), "order-path"), price


@query("p18_peak_gross", "closes books", f"+ {PATHS}, {WALK.format(p='w', k='year', start='SELECT symbol, current_shares AS shares FROM books')}, s AS (SELECT sum(abs(current_shares) * price) AS start FROM books JOIN lc USING (symbol)) SELECT year, round(any_value(start), 2) AS start, round(any_value(start) + greatest(0, max(run)), 2) AS peak, round(any_value(start) + sum(change), 2) AS last FROM wr, s GROUP BY year")
def _(spark, sf):
    """Each year's orders, one after the other from the current book: the most gross notional on the way."""
    rows, price = order_path(spark, sf)
    start = fx.books(spark, sf).select("symbol", F.col("current_shares").alias("shares")).join(price, "symbol").join(rows.select("year").distinct(), F.lit(True))
    return bk.peak_gross(rows, "year", ["day", "l_orderkey", "l_linenumber"], start).select("year", r("start", 2), r("peak", 2), r("last", 2))


@query("p19_p27_affordability", "closes", f"+ {PATHS}, {WALK.format(p='w', k='id', start='SELECT NULL::VARCHAR AS symbol, 0.0 AS shares')}, pk AS (SELECT id, greatest(0, max(run)) AS peak FROM wr GROUP BY 1) SELECT id, round(peak, 2) AS peak, round(peak, 2) <= round(c_acctbal * 10, 2) + 1 AS affordable, CASE WHEN c_acctbal > 0 THEN least(round(peak, 2), round(c_acctbal * 10, 2)) ELSE round(peak, 2) END AS capital FROM pk JOIN customer ON c_custkey = id")
def _(spark, sf):
    """Whether each customer's account covers the most that its own orders hold on their way, and the capital that it leaves."""
    rows, _ = order_path(spark, sf)
    paths = bk.peak_gross(rows, "id", ["day", "l_orderkey", "l_linenumber"])
    c = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.round(F.col("c_acctbal").cast("double") * 10, 2).alias("power"))
    paths = paths.select("id", r("peak", 2), "start").join(c, "id")
    return paths.select("id", "peak", lg.affordable(F.col("peak"), F.col("start"), F.col("power")).alias("affordable"), lg.effective_capital(F.col("peak"), F.col("power")).alias("capital"))


EQ = f"{BOOK}, sh AS (SELECT b.day, b.symbol, trunc(notional / close) AS shares FROM book b JOIN closes c ON c.symbol = b.symbol AND c.day = b.day WHERE abs(trunc(notional / close)) >= 1), mv AS (SELECT symbol, day, lead(day) OVER w AS t, lead(close) OVER w - close AS move FROM closes WINDOW w AS (PARTITION BY symbol ORDER BY day)), pl AS (SELECT t AS day, sum(shares * move) AS pnl FROM sh JOIN mv USING (symbol, day) WHERE move IS NOT NULL GROUP BY 1), eq AS (SELECT day, pnl, 10000.0 + sum(pnl) OVER (ORDER BY day) AS equity FROM pl)"


@query("p24_p25_basket_book_equity", BV, f"{EQ} SELECT day::VARCHAR AS day, round(pnl, 3) AS pnl, round(equity, 3) AS equity FROM eq")
def _(spark, sf):
    return basket_book_equity(spark, sf)


@query("r01_equity_stats", "equity", "+ x AS (SELECT *, equity / lag(equity) OVER (ORDER BY day) - 1 AS ret, max(equity) OVER (ORDER BY day) AS peak FROM equity) SELECT count(*) AS n, round(max_by(equity, day) / min_by(equity, day) - 1, 6) AS total, round(avg(ret), 8) AS mean, round(stddev_samp(ret), 8) AS std, round(avg(ret) / stddev_samp(ret) * sqrt(252), 5) AS sharpe, round(avg(ret) * 252, 6) AS annual, round(max((peak - equity) / peak), 6) AS max_drawdown FROM x")
def _(spark, sf):
    e = fx.equity(spark, sf).withColumn("run", F.lit("r"))
    return rp.equity_stats(e, ["run"]).select("n", r("total"), r("mean", 8), r("std", 8), r("sharpe", 5), r("annual"), r("max_drawdown"))


@query("r02_drawdowns", "equity", "+ x AS (SELECT *, max(equity) OVER (ORDER BY day) AS peak FROM equity) SELECT day::VARCHAR AS day, round(peak, 2) AS peak, round((peak - equity) / peak, 8) AS drawdown FROM x")
def _(spark, sf):
    return rp.drawdowns(fx.equity(spark, sf).withColumn("run", F.lit("r")), ["run"]).select(day(), r("peak", 2), r("drawdown", 8))


PSR = """+ m AS (SELECT pair_id, year(exit_day) AS y, count(*) AS n, avg(pnl) AS a, stddev_samp(pnl) AS s, avg(pnl ** 2) AS m2, avg(pnl ** 3) AS m3, avg(pnl ** 4) AS m4 FROM trades GROUP BY 1, 2), q AS (SELECT *, a / s AS sr, (m3 - 3 * a * m2 + 2 * a ** 3) / s ** 3 AS sk, (m4 - 4 * a * m3 + 6 * a ** 2 * m2 - 3 * a ** 4) / s ** 4 AS ku FROM m), z AS (SELECT *, sr * sqrt(n - 1) / sqrt(1 - sk * sr + (ku - 1) / 4 * sr ** 2) AS z, 1 / (1 + 0.2316419 * abs(sr * sqrt(n - 1) / sqrt(1 - sk * sr + (ku - 1) / 4 * sr ** 2))) AS t FROM q), p AS (SELECT *, exp(-z * z / 2) / sqrt(2 * pi()) * (t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))) AS tail FROM z)"""


@query("r04_probabilistic_sharpe", "trades", PSR + """
SELECT pair_id, y, n, round(sr, 6) AS sharpe, round(sk, 5) AS skew, round(ku, 5) AS kurtosis, round(CASE WHEN z >= 0 THEN 1 - tail ELSE tail END, 6) AS psr FROM p""")
def _(spark, sf):
    t = fx.trades(spark, sf).withColumn("y", F.year("exit_day"))
    return rp.probabilistic_sharpe(t, ["pair_id", "y"]).select("pair_id", "y", "n", r("sharpe"), r("skew", 5), r("kurtosis", 5), r("psr"))


#: The largest Sharpe ratio expected of 20 tries without skill.
BEST = rp.expected_best_sharpe(20)


@query("r05_deflated_sharpe", "trades", PSR.replace("sr * sqrt(n - 1)", f"(sr - {BEST!r}) * sqrt(n - 1)") + " SELECT pair_id, y, n, round(sr, 6) AS sharpe, round(CASE WHEN z >= 0 THEN 1 - tail ELSE tail END, 6) AS dsr FROM p")
def r05(spark, sf):
    t = fx.trades(spark, sf).withColumn("y", F.year("exit_day"))
    return rp.probabilistic_sharpe(t, ["pair_id", "y"], BEST).select("pair_id", "y", "n", r("sharpe"), F.round("psr", 6).alias("dsr"))


@query("a15_capital_metrics", "trades", "+ g AS (SELECT pair_id, sum(pnl) AS pnl, sum(2 * capital_per_leg * hold_days) AS dd, avg(pnl / (2 * capital_per_leg)) AS per_trade, avg(pnl / (2 * capital_per_leg * hold_days)) AS per_dollar_day FROM trades WHERE capital_per_leg > 0 AND hold_days > 0 GROUP BY 1) SELECT pair_id, round(pnl / dd, 10) + 0.0 AS roec, round(least(1, dd / (1e8 * 2500)), 6) AS utilisation, round(pnl / dd * least(1, dd / (1e8 * 2500)), 10) + 0.0 AS rocc, round(per_trade, 6) + 0.0 AS per_trade, round(per_dollar_day, 8) + 0.0 AS per_dollar_day FROM g")
def _(spark, sf):
    m = rp.capital_metrics(fx.trades(spark, sf), ["pair_id"], 1e8, 2500)
    return m.select("pair_id", *((F.round(c, n) + 0.0).alias(c) for c, n in (("roec", 10), ("utilisation", 6), ("rocc", 10), ("per_trade", 6), ("per_dollar_day", 8))))


KW = "(PARTITION BY pair_id ORDER BY exit_day, trade_id ROWS UNBOUNDED PRECEDING)"


@query("a16_kelly", "trades", f"+ x AS (SELECT trade_id, 2 + count(CASE WHEN pnl > 0 THEN 1 END) OVER {KW} AS a, 2 + count(CASE WHEN pnl <= 0 THEN 1 END) OVER {KW} AS b, coalesce(avg(CASE WHEN pnl > 0 THEN pnl END) OVER {KW}, 1) / greatest(coalesce(avg(CASE WHEN pnl <= 0 THEN -pnl END) OVER {KW}, 1), 1e-10) AS payoff FROM trades), p AS (SELECT *, a / (a + b) AS p, sqrt((a / (a + b)) * (1 - a / (a + b)) / (a + b + 1)) AS sd FROM x) SELECT trade_id, round(p, 9) AS win_rate, round(CASE WHEN p - (1 - p) / payoff <= 0 THEN 0 ELSE least(1, (p - (1 - p) / payoff) * greatest(0.2, 1 - 4 * sd)) END, 6) AS fraction FROM p")
def _(spark, sf):
    return rp.kelly(fx.trades(spark, sf), ["pair_id"], ["exit_day", "trade_id"]).select("trade_id", r("win_rate", 9), r("fraction"))
