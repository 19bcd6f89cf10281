"""Book runs by run_id over the basket scores, and what each basket is worth to the whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as rn
from . import fixtures as fx
from .registry import query
from .signal_queries import ZS, basket_positions
from .stat_queries import BV
from .table_queries import day, r

CAPITAL = 100_000.0
#: (run_id, threshold, cap, notional of a basket, scale of shorts, slippage).
RUNS = (("base", 0.9, 5, 4e5 / 5, 1.0, 0.0005), ("narrow", 1.2, 3, 4e5 / 3, 1.0, 0.0005), ("long_tilt", 0.9, 5, 4e5 / 5, 0.5, 0.001), ("wide", 0.6, 8, 4e5 / 8, 1.0, 0.0))
TABLE = "run_id string, k double, cap int, notional double, short_scale double, slippage double, removed string"


def variants(spark):
    return spark.createDataFrame([(*x, None) for x in RUNS], TABLE)


def without_each(spark, sf):
    """The base run, and one without each basket."""
    base = variants(spark).where("run_id = 'base'")
    each = fx.baskets(spark, sf).select(F.col("target").alias("removed")).distinct().join(F.broadcast(base.drop("removed")), F.lit(True))
    return base.unionByName(each.withColumn("run_id", F.concat(F.lit("without "), F.col("removed"))).select(*base.columns))


VARIANTS = "runs(run_id, k, cap, notional, short_scale, slippage, removed) AS (VALUES " + ", ".join(f"('{i}', {k}::DOUBLE, {c}, {n!r}::DOUBLE, {s!r}::DOUBLE, {p!r}::DOUBLE, NULL::VARCHAR)" for i, k, c, n, s, p in RUNS) + ")"
WITHOUT = VARIANTS.replace("runs(run_id", "run0(run_id") + ", runs AS (SELECT * FROM run0 WHERE run_id = 'base' UNION ALL SELECT 'without ' || target, k, cap, notional, short_scale, slippage, target FROM run0, (SELECT DISTINCT target FROM baskets) WHERE run_id = 'base')"
#: Positions by one step a day and run: arrays over all baskets in the order of their names.
HELD = f"""{ZS}, {{runs}}, tn AS (SELECT list(DISTINCT target ORDER BY target) AS names FROM z), dn AS (SELECT day, row_number() OVER (ORDER BY day) AS n FROM (SELECT DISTINCT day FROM z)),
za AS (SELECT dn.n, dn.day, list_transform(names, lambda t: map_extract(m, t)[1]) AS zs FROM dn JOIN (SELECT day, map_from_entries(list((target, z))) AS m FROM z GROUP BY 1) USING (day), tn),
ra AS (SELECT runs.*, names, list_transform(names, lambda t: removed IS NULL OR t <> removed) AS takes FROM runs, tn),
fold AS (SELECT run_id, CAST(0 AS BIGINT) AS n, list_transform(names, lambda t: 0) AS after, list_transform(names, lambda t: 0) AS sides, list_transform(names, lambda t: 0) AS places FROM ra
UNION ALL SELECT run_id, n, list_transform(range(1, len(s) + 1), lambda i: CASE WHEN places[i] <= cap THEN s[i] ELSE 0 END), s, places
FROM (SELECT *, list_transform(range(1, len(s) + 1), lambda i: CASE WHEN s[i] <> 0 THEN 1 + len(list_filter(range(1, len(s) + 1), lambda j: s[j] <> 0 AND (w[j] > w[i] OR (w[j] = w[i] AND j < i)))) END) AS places
FROM (SELECT *, list_transform(range(1, len(takes) + 1), lambda i: CASE WHEN takes[i] THEN coalesce(abs(zs[i]), -1) END) AS w
FROM (SELECT ra.run_id, za.n, ra.cap, ra.takes, za.zs, list_transform(range(1, len(takes) + 1), lambda i: CASE WHEN NOT takes[i] THEN 0 WHEN zs[i] < -ra.k THEN 1 WHEN zs[i] > ra.k THEN -1 ELSE f.after[i] END) AS s FROM fold f JOIN ra USING (run_id) JOIN za ON za.n = f.n + 1)))),
held AS (SELECT run_id, day, names[i] AS target, sides[i] AS position, places[i] AS place, places[i] <= cap AS admitted FROM fold JOIN dn USING (n) JOIN ra USING (run_id), unnest(range(1, len(names) + 1)) AS u(i) WHERE sides[i] <> 0)"""
CURVES = f"""{HELD}, sz AS (SELECT target, count(*) AS size FROM baskets GROUP BY 1),
lgs AS (SELECT run_id, day, target AS symbol, position * notional * CASE WHEN position < 0 THEN short_scale ELSE 1 END * 0.5 AS amount FROM held JOIN runs USING (run_id) WHERE admitted UNION ALL SELECT run_id, day, peer, position * notional * CASE WHEN position < 0 THEN short_scale ELSE 1 END * -0.5 / size FROM held JOIN runs USING (run_id) JOIN baskets USING (target) JOIN sz USING (target) WHERE admitted),
bk AS (SELECT run_id, day, symbol, trunc(round(sum(amount), 6) / any_value(close)) AS shares FROM lgs JOIN closes USING (day, symbol) GROUP BY 1, 2, 3 HAVING abs(trunc(round(sum(amount), 6) / any_value(close))) >= 1),
cal AS (SELECT day, lead(day) OVER (ORDER BY day) AS next, lead(day, 2) OVER (ORDER BY day) AS over_ FROM (SELECT DISTINCT day FROM closes)),
mv AS (SELECT run_id, next AS day, symbol, 0.0::DOUBLE AS old, shares AS new FROM bk JOIN cal USING (day) UNION ALL SELECT run_id, over_, symbol, shares, 0.0::DOUBLE FROM bk JOIN cal USING (day)),
fl AS (SELECT run_id, day, symbol, before, shares, close, close * (1 + CASE WHEN shares > before THEN 1 ELSE -1 END * slippage) AS price FROM (SELECT run_id, day, symbol, sum(old) AS before, sum(new) AS shares FROM mv WHERE day IS NOT NULL GROUP BY 1, 2, 3) JOIN closes USING (day, symbol) JOIN runs USING (run_id) WHERE before <> shares),
pl AS (SELECT run_id, over_ AS day, sum(shares * (b.close - a.close)) AS pnl FROM bk JOIN cal USING (day) JOIN closes a ON a.symbol = bk.symbol AND a.day = next JOIN closes b ON b.symbol = bk.symbol AND b.day = over_ GROUP BY 1, 2 UNION ALL SELECT run_id, day, -sum(abs(shares - before) * abs(price - close)) FROM fl GROUP BY 1, 2),
cv AS (SELECT run_id, day, sum(pnl) AS pnl, {CAPITAL} + sum(sum(pnl)) OVER (PARTITION BY run_id ORDER BY day) AS equity FROM pl GROUP BY 1, 2)"""
STATS = f"""{CURVES}, rt AS (SELECT *, pnl / coalesce(lag(equity) OVER w, {CAPITAL}) AS ret, (greatest({CAPITAL}, max(equity) OVER w) - equity) / greatest({CAPITAL}, max(equity) OVER w) AS fall FROM cv WINDOW w AS (PARTITION BY run_id ORDER BY day)),
sts AS (SELECT run_id, removed, count(*) AS days, sum(pnl) / {CAPITAL} AS total, CASE WHEN stddev_samp(ret) > 1e-12 THEN avg(ret) / stddev_samp(ret) * sqrt(252) END AS sharpe, max(fall) AS drawdown FROM rt JOIN runs USING (run_id) GROUP BY 1, 2)"""


def curves(spark, sf, runs):
    """Positions, fills and equity of each run."""
    closes, scores = fx.closes(spark, sf), basket_positions(spark, sf).select("day", "target", "z")
    held = rn.positions(scores, runs)
    books = rn.run_books(held, fx.baskets(spark, sf), runs, closes)
    filled = rn.fills(books, closes, runs)
    return held, filled, rn.equity(books, filled, closes, runs, CAPITAL)


@query("p25_run_positions", BV, f"{HELD.format(runs=VARIANTS)} SELECT run_id, day::VARCHAR AS day, target, position, place, admitted FROM held")
def _(spark, sf):
    """Positions of every run day by day, with those that the cap leaves out, which are flat from then on."""
    return curves(spark, sf, variants(spark))[0].select("run_id", day(), "target", "position", F.col("place").cast("long").alias("place"), "admitted")


@query("p25_run_fills", BV, f"{CURVES.format(runs=VARIANTS)} SELECT run_id, day::VARCHAR AS day, symbol, before, shares, round(price, 6) AS price FROM fl")
def _(spark, sf):
    """Every run's orders as they are filled at the next day's price, with slippage."""
    return curves(spark, sf, variants(spark))[1].select("run_id", day(), "symbol", "before", "shares", r("price"))


@query("p25_run_equity", BV, f"{CURVES.format(runs=VARIANTS)} SELECT run_id, day::VARCHAR AS day, round(pnl, 4) + 0.0 AS pnl, round(equity, 4) AS equity FROM cv")
def _(spark, sf):
    """Every run's equity curve."""
    return curves(spark, sf, variants(spark))[2].select("run_id", day(), r("pnl", 4), r("equity", 4))


@query("r08_removal_value", BV, f"{STATS.format(runs=WITHOUT)}, ad AS (SELECT run_id, day, target FROM held WHERE admitted), nw AS (SELECT DISTINCT removed, day FROM ad JOIN runs USING (run_id) WHERE removed IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ad b WHERE b.run_id = 'base' AND b.day = ad.day AND b.target = ad.target)), rp AS (SELECT nw.removed, count(*) AS replaced FROM nw JOIN ad ON ad.run_id = 'base' AND ad.day = nw.day AND ad.target = nw.removed GROUP BY 1) SELECT s.removed, round(s.total - b.total, 6) + 0.0 AS d_return, round(s.sharpe - b.sharpe, 6) + 0.0 AS d_sharpe, round(s.drawdown - b.drawdown, 6) + 0.0 AS d_drawdown, coalesce(replaced, 0) AS replaced FROM sts s JOIN sts b ON b.run_id = 'base' LEFT JOIN rp ON rp.removed = s.removed WHERE s.removed IS NOT NULL")
def _(spark, sf):
    """Return, Sharpe and drawdown of the run without each basket, less those of the whole, and the days it was replaced."""
    runs = without_each(spark, sf)
    held, _, curve = curves(spark, sf, runs)
    stats = rn.run_stats(curve, CAPITAL).join(F.broadcast(runs.select("run_id", "removed")), "run_id")
    return rn.removal_value(held, stats, "base").select("removed", r("d_return"), r("d_sharpe"), r("d_drawdown"), "replaced")
