"""Reports over the book runs: variants, baseline, attribution, cap pressure, churn, worst days, and report files."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import runs as rn
from ..sources import equity_reports as er
from ..sources.shared import written
from . import fixtures as fx
from .registry import query
from .run_queries import CAPITAL, CURVES, HELD, RUNS, STATS, VARIANTS, curves, variants
from .stat_queries import BV
from .table_queries import day, r

NAMES = [x[0] for x in RUNS]
CURVE, STAT = CURVES.format(runs=VARIANTS), STATS.format(runs=VARIANTS)
FALL = f"(greatest({CAPITAL}, max(equity) OVER w) - equity)"


@query("s15_equity_report", BV, f"{CURVE} SELECT run_id, day::VARCHAR AS day, round(equity, 4) AS equity, round(pnl, 4) + 0.0 AS pnl FROM cv")
def _(spark, sf):
    """Every run's report, written as text and read back: its rows."""
    return reports(spark, sf)[0].select("run_id", day(), r("equity", 4), r("pnl", 4))


def reports(spark, sf):
    curve = curves(spark, sf, variants(spark))[2]
    return er.read_equity_report(spark, er.write_equity_report(curve, rn.run_stats(curve, CAPITAL)))


@query("s17_parse_header_pairs", BV, f"{STAT}, k AS (UNPIVOT (SELECT run_id, days::DOUBLE AS days, total, sharpe, drawdown FROM sts) ON days, total, sharpe, drawdown INTO NAME key VALUE value) SELECT run_id, key, round(value, 5) AS value FROM k")
def _(spark, sf):
    """The statistics in the headers of the report files."""
    return reports(spark, sf)[1].select("run_id", "key", r("value", 5))


@query("a23_worst_days", BV, f"{CURVE}, x AS (SELECT *, {FALL} AS fall FROM cv WINDOW w AS (PARTITION BY run_id ORDER BY day)), y AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY round(pnl, 4), day) AS by_pnl, row_number() OVER (PARTITION BY run_id ORDER BY round(fall, 4) DESC, day) AS by_fall FROM x), ex AS (SELECT run_id, day, count(*) FILTER (NOT admitted) AS excluded FROM held GROUP BY 1, 2), fc AS (SELECT run_id, day, count(*) AS fills FROM fl GROUP BY 1, 2) SELECT run_id, day::VARCHAR AS day, round(pnl, 4) AS pnl, round(fall, 4) AS fall, by_pnl <= 5 AS worst_pnl, by_fall <= 5 AS worst_fall, coalesce(excluded, 0) AS excluded, coalesce(fills, 0) AS fills FROM y LEFT JOIN ex USING (run_id, day) LEFT JOIN fc USING (run_id, day) WHERE by_pnl <= 5 OR by_fall <= 5")
def _(spark, sf):
    """Each run's five worst days by profit and five by drawdown, with what was excluded and filled on them."""
    held, filled, curve = curves(spark, sf, variants(spark))
    run = W.partitionBy("run_id").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    rows = curve.withColumns({"pnl": F.round("pnl", 4), "fall": F.round(F.greatest(F.lit(CAPITAL), F.max("equity").over(run)) - F.col("equity"), 4)})
    place = lambda *c: F.row_number().over(W.partitionBy("run_id").orderBy(*c))
    rows = rows.withColumns({"worst_pnl": place("pnl", "day") <= 5, "worst_fall": place(F.desc("fall"), "day") <= 5}).where("worst_pnl or worst_fall")
    excluded = held.groupBy("run_id", "day").agg(F.count_if(~F.col("admitted")).alias("excluded"))
    fills = filled.groupBy("run_id", "day").agg(F.count("*").alias("fills"))
    rows = rows.join(excluded, ["run_id", "day"], "left").join(fills, ["run_id", "day"], "left")
    return rows.select("run_id", day(), "pnl", "fall", "worst_pnl", "worst_fall", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("excluded", "fills")))


@query("a24_variant_matrix", BV, f"{CURVE}, yy AS (SELECT run_id, year(day) AS year, pnl FROM cv), yd AS (SELECT run_id, year(day) AS year, greatest(0, max(s) OVER (PARTITION BY run_id, year(day) ORDER BY day)) - s AS fall FROM (SELECT *, sum(pnl) OVER (PARTITION BY run_id, year(day) ORDER BY day) AS s FROM cv)), ya AS (SELECT run_id, year, round(sum(pnl) / {CAPITAL}, 6) AS ret FROM yy GROUP BY 1, 2), yb AS (SELECT run_id, year, max(fall) / {CAPITAL} AS fall FROM yd GROUP BY 1, 2), ym AS (SELECT year, max(ret) FILTER (run_id <> 'base') AS top FROM ya GROUP BY 1) SELECT a.year, " + ", ".join(f"max(CASE WHEN a.run_id = '{n}' THEN ret END) AS {n}, round(max(CASE WHEN a.run_id = '{n}' THEN fall END), 6) AS {n}_fall" for n in NAMES) + ", min(CASE WHEN a.run_id <> 'base' AND ret = top THEN a.run_id END) AS best, round(max(CASE WHEN a.run_id = 'base' THEN ret END) - any_value(top), 6) + 0.0 AS base_less_best FROM ya a JOIN yb b USING (run_id, year) JOIN ym m ON m.year = a.year GROUP BY a.year")
def _(spark, sf):
    """Return and deepest fall of each year under every run, the best other run, and what the base is over it."""
    rows = curves(spark, sf, variants(spark))[2].withColumn("year", F.year("day"))
    run = W.partitionBy("run_id", "year").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("s", F.sum("pnl").over(run)).withColumn("fall", F.greatest(F.lit(0.0), F.max("s").over(run)) - F.col("s"))
    g = rows.groupBy("year", "run_id").agg(F.round(F.sum("pnl") / CAPITAL, 6).alias("ret"), F.round(F.max("fall") / CAPITAL, 6).alias("fall"))
    pick = lambda n, c: F.max(F.when(F.col("run_id") == n, F.col(c)))
    other = F.when(F.col("run_id") != "base", F.struct(F.col("ret"), (-F.array_position(F.array(*(F.lit(n) for n in sorted(NAMES))), F.col("run_id"))).alias("p"), "run_id"))
    out = g.groupBy("year").agg(*(x for n in NAMES for x in (pick(n, "ret").alias(n), pick(n, "fall").alias(f"{n}_fall"))), F.max(other).alias("o"))
    return out.select("year", *(c for n in NAMES for c in (n, f"{n}_fall")), F.col("o.run_id").alias("best"), (F.round(F.col("base") - F.col("o.ret"), 6) + F.lit(0.0)).alias("base_less_best"))


@query("a25_baseline_comparison", BV, f"{CURVE}, bm AS (SELECT run_id, round(sum(pnl), 2) AS total, round(100.0 * count(*) FILTER (pnl > 0) / count(*), 4) AS wins FROM cv GROUP BY 1), bt AS (SELECT run_id, count(*) AS trades FROM fl GROUP BY 1), j AS (SELECT * FROM bm JOIN bt USING (run_id)) SELECT j.run_id, j.trades, j.wins, j.total, j.trades - b.trades AS d_trades, round(j.wins - b.wins, 4) + 0.0 AS d_wins, round(j.total - b.total, 2) + 0.0 AS d_total, j.trades = b.trades AND abs(j.total - b.total) <= 0.01 AS matched FROM j, j b WHERE b.run_id = 'base'")
def _(spark, sf):
    """Every run's fills, winning days and total against the stored baseline of the base run."""
    _, filled, curve = curves(spark, sf, variants(spark))
    m = curve.groupBy("run_id").agg(F.round(F.sum("pnl"), 2).alias("total"), F.round(100.0 * F.count_if(F.col("pnl") > 0) / F.count("*"), 4).alias("wins"))
    now = written(m.join(filled.groupBy("run_id").agg(F.count("*").alias("trades")), "run_id"), "run-figures")
    stored = written(now.where("run_id = 'base'").select(*(F.col(c).alias(f"b_{c}") for c in ("trades", "wins", "total"))), "baseline")
    rows = now.join(F.broadcast(stored), F.lit(True))
    gap = lambda c, n: (F.round(F.col(c) - F.col(f"b_{c}"), n) + F.lit(0.0)).alias(f"d_{c}")
    return rows.select("run_id", "trades", "wins", "total", (F.col("trades") - F.col("b_trades")).alias("d_trades"), gap("wins", 4), gap("total", 2), ((F.col("trades") == F.col("b_trades")) & (F.abs(F.col("total") - F.col("b_total")) <= 0.01)).alias("matched"))


LEGS = "lg2 AS (SELECT run_id, day, target, target AS symbol, 'target' AS role, position * notional * CASE WHEN position < 0 THEN short_scale ELSE 1 END * 0.5 AS amount FROM held JOIN runs USING (run_id) WHERE admitted UNION ALL SELECT run_id, day, target, peer, 'peer', position * notional * CASE WHEN position < 0 THEN short_scale ELSE 1 END * -0.5 / size FROM held JOIN runs USING (run_id) JOIN baskets USING (target) JOIN sz USING (target) WHERE admitted)"


@query("a26_attribution", BV, f"{CURVE}, {LEGS}, earned AS (SELECT run_id, sector, role, l.symbol, amount / o.close * (b.close - a.close) AS pnl FROM lg2 l JOIN sectors s ON s.symbol = l.target JOIN cal USING (day) JOIN closes o ON o.symbol = l.symbol AND o.day = l.day JOIN closes a ON a.symbol = l.symbol AND a.day = next JOIN closes b ON b.symbol = l.symbol AND b.day = over_) SELECT run_id, sector, role, symbol, round(sum(pnl), 4) + 0.0 AS pnl FROM earned GROUP BY GROUPING SETS ((run_id, sector, role, symbol), (run_id, sector, role), (run_id, symbol), (run_id))")
def _(spark, sf):
    """Profit of the runs' legs by sector and role, by constituent, and in all: totals have nulls for what they sum over."""
    runs, closes = variants(spark), fx.closes(spark, sf)
    held, _, _ = curves(spark, sf, runs)
    rows = held.where("admitted").join(fx.baskets(spark, sf).groupBy("sector", "target").agg(F.collect_list("peer").alias("peers")), "target").join(F.broadcast(runs.select("run_id", "notional", "short_scale")), "run_id")
    leg = lambda symbol, role, w: F.struct(symbol.alias("symbol"), F.lit(role).alias("role"), w.alias("w"))
    parts = F.concat(F.array(leg(F.col("target"), "target", F.lit(0.5))), F.transform("peers", lambda p: leg(p, "peer", -0.5 / F.size("peers"))))
    amount = F.col("position") * F.col("notional") * F.when(F.col("position") < 0, F.col("short_scale")).otherwise(1.0)
    legs = rows.select("run_id", "day", "sector", amount.alias("amount"), F.explode(parts).alias("leg")).select("run_id", "day", "sector", "leg.symbol", "leg.role", (F.col("amount") * F.col("leg.w")).alias("amount"))
    order = W.orderBy("day")
    days = closes.select("day").distinct().select("day", F.lead("day").over(order).alias("at"), F.lead("day", 2).over(order).alias("earns"))
    legs = legs.join(closes, ["day", "symbol"]).join(F.broadcast(days), "day")
    for c, name in (("at", "then"), ("earns", "now")):
        legs = legs.join(closes.withColumnsRenamed({"day": c, "close": name}), ["symbol", c])
    pnl = legs.withColumn("pnl", F.col("amount") / F.col("close") * (F.col("now") - F.col("then")))
    sets = [["run_id", "sector", "role", "symbol"], ["run_id", "sector", "role"], ["run_id", "symbol"], ["run_id"]]
    return pnl.groupingSets([[F.col(c) for c in s] for s in sets], "run_id", "sector", "role", "symbol").agg((F.round(F.sum("pnl"), 4) + F.lit(0.0)).alias("pnl"))


@query("a27_cap_pressure", BV, f"{HELD.format(runs=VARIANTS)}, kc AS (SELECT run_id, day, count(*) AS active, count(*) FILTER (NOT admitted) AS excluded FROM held GROUP BY 1, 2), kp AS (SELECT run_id, round(avg(active), 6) AS mean_active, max(active) AS max_active, round(avg(excluded), 6) AS mean_excluded, max(excluded) AS max_excluded FROM kc GROUP BY 1), kb AS (SELECT run_id, target, count(*) FILTER (admitted) AS selected, count(*) FILTER (NOT admitted) AS excluded FROM held GROUP BY 1, 2), kt AS (SELECT run_id, list(target || ':' || selected ORDER BY selected DESC, target)[1:3] AS s, list(target || ':' || excluded ORDER BY excluded DESC, target)[1:3] AS e FROM kb GROUP BY 1) SELECT p.*, array_to_string(s, ' ') AS most_selected, array_to_string(e, ' ') AS most_excluded FROM kp p JOIN kt USING (run_id)")
def _(spark, sf):
    """How many baskets are active and excluded a day under each run, and which are selected and excluded most."""
    held = curves(spark, sf, variants(spark))[0]
    c = held.groupBy("run_id", "day").agg(F.count("*").alias("active"), F.count_if(~F.col("admitted")).alias("excluded"))
    p = c.groupBy("run_id").agg(F.round(F.avg("active"), 6).alias("mean_active"), F.max("active").alias("max_active"), F.round(F.avg("excluded"), 6).alias("mean_excluded"), F.max("excluded").alias("max_excluded"))
    b = held.groupBy("run_id", "target").agg(F.count_if("admitted").alias("selected"), F.count_if(~F.col("admitted")).alias("excluded"))

    def most(c):
        first = b.withColumn("place", F.row_number().over(W.partitionBy("run_id").orderBy(F.desc(c), "target"))).where("place <= 3")
        listed = F.transform(F.sort_array(F.collect_list(F.struct("place", F.concat_ws(":", "target", F.col(c).cast("string")).alias("name")))), lambda x: x["name"])
        return first.groupBy("run_id").agg(F.array_join(listed, " ").alias(f"most_{c}"))

    return p.join(most("selected"), "run_id").join(most("excluded"), "run_id")


@query("a28_churn", BV, f"{CURVE} SELECT run_id, day::VARCHAR AS day, count(*) AS orders, round(sum(abs(shares - before) * price), 4) AS turnover, round(sum((abs(shares) - abs(before)) * close), 4) + 0.0 AS gross_change FROM fl GROUP BY run_id, day")
def _(spark, sf):
    """Orders, turnover and the change of gross notional of each day and run."""
    filled = curves(spark, sf, variants(spark))[1].join(fx.closes(spark, sf), ["day", "symbol"])
    g = filled.groupBy("run_id", "day").agg(F.count("*").alias("orders"), F.sum(F.abs(F.col("shares") - F.col("before")) * F.col("price")).alias("turnover"), F.sum((F.abs("shares") - F.abs("before")) * F.col("close")).alias("gross_change"))
    return g.select("run_id", day(), "orders", r("turnover", 4), r("gross_change", 4))
