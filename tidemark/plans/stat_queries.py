"""Statistics of pairs and baskets over the weekly closes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detectors, scan, stats
from . import fixtures as fx
from .registry import query
from .table_queries import r

V = "closes sectors pairs"
BY = ["leg_a", "leg_b"]
ROWS = """+ l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS rn FROM closes WHERE close > 0 QUALIFY rn <= 150),
x AS (SELECT leg_a, leg_b, x.rn, -x.rn AS k, ln(y.close) AS x, ln(x.close) AS y FROM pairs JOIN l x ON x.symbol = leg_a JOIN l y ON y.symbol = leg_b AND y.rn = x.rn)"""
TLS = "f AS (SELECT *, CASE WHEN abs(c) >= 1e-15 THEN (vy - vx + sqrt((vy - vx) ** 2 + 4 * c * c)) / (2 * c) END AS beta FROM (SELECT leg_a, leg_b, count(*) AS n, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(y, x) AS c, avg(x) AS mx, avg(y) AS my FROM x GROUP BY 1, 2))"
SPREAD = f"{ROWS}, {TLS}, s AS (SELECT leg_a, leg_b, k, y - beta * x AS spread FROM x JOIN f USING (leg_a, leg_b))"
ROLL = f"{ROWS}, w AS (SELECT *, count(*) OVER q AS m, var_pop(x) OVER q AS vx, var_pop(y) OVER q AS vy, covar_pop(y, x) OVER q AS c FROM x WINDOW q AS (PARTITION BY leg_a, leg_b ORDER BY k ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)), b AS (SELECT leg_a, leg_b, k, CASE WHEN abs(c) >= 1e-15 THEN (vy - vx + sqrt((vy - vx) ** 2 + 4 * c * c)) / (2 * c) END AS beta FROM w WHERE m = 30)"


def pair_rows(spark, sf):
    return stats.pair_spreads(fx.closes(spark, sf), fx.candidates(spark, sf))


def spreads(spark, sf):
    rows = pair_rows(spark, sf)
    return rows.join(stats.tls(rows, BY, "x", "y").select(*BY, "beta"), BY).withColumn("spread", F.col("y") - F.col("beta") * F.col("x"))


@query("t01_ols", V, f"{ROWS} SELECT leg_a, leg_b, count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2, round(sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2) / regr_sxx(y, x)), 6) AS se FROM x GROUP BY 1, 2")
def _(spark, sf):
    return stats.ols(pair_rows(spark, sf), BY, "x", "y").select(*BY, "n", r("slope"), r("intercept"), r("r2"), r("se"))


@query("t02_tls", V, f"{ROWS}, {TLS} SELECT leg_a, leg_b, n, round(beta, 4) AS beta, round(my - beta * mx, 3) AS alpha FROM f")
def _(spark, sf):
    return stats.tls(pair_rows(spark, sf), BY, "x", "y").select(*BY, "n", r("beta", 4), r("alpha", 3))


MANY = """WITH x AS (SELECT l_returnflag, CAST(l_quantity AS DOUBLE) AS a, CAST(l_discount AS DOUBLE) AS b, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem),
m AS (SELECT l_returnflag, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, count(*) * var_pop(a) AS aa, count(*) * var_pop(b) AS bb, count(*) * covar_pop(a, b) AS ab, count(*) * covar_pop(y, a) AS ya, count(*) * covar_pop(y, b) AS yb, count(*) * var_pop(y) AS yy FROM x GROUP BY 1),
c AS (SELECT *, aa * bb - ab * ab AS det, (ya * bb - yb * ab) / (aa * bb - ab * ab) AS ca, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS cb FROM m)
SELECT l_returnflag, n, round(my - ca * ma - cb * mb, 2) AS intercept, round(ca, 4) AS per_quantity, round(cb, 2) AS per_discount, round(sqrt((yy - ca * ya - cb * yb) / (n - 3) * bb / det), 4) AS quantity_error, round(sqrt((yy - ca * ya - cb * yb) / (n - 3) * aa / det), 2) AS discount_error FROM c"""


@query("t03_ols_many", "", MANY)
def _(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select("l_returnflag", *(F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_discount", "l_extendedprice")))
    return stats.ols_many(rows, ["l_returnflag"], ["l_quantity", "l_discount"], "l_extendedprice").select("l_returnflag", "n", r(F.col("coefficients")[0], 2, "intercept"), r(F.col("coefficients")[1], 4, "per_quantity"), r(F.col("coefficients")[2], 2, "per_discount"), r(F.col("errors")[1], 4, "quantity_error"), r(F.col("errors")[2], 2, "discount_error"))


def adf_sql(rows, keys, most):
    """Views of the unit-root test over rows (keys, i from 1, v): the last, ``adf``, has (keys, stat, lags). For each number of
    lags the Gram matrix of regressors and difference is swept pivot by pivot, which leaves the inverse, coefficients and rest."""
    z = lambda i: f"CASE WHEN {i} = 1 THEN 1 WHEN {i} = 2 THEN v[t - 1] WHEN {i} = p + 3 THEN v[t] - v[t - 1] ELSE v[t - {i} + 2] - v[t - {i} + 1] END"
    swept = """CASE WHEN i = j AND c = j THEN 1 / g[j][j] WHEN i = j THEN g[j][c] / g[j][j] WHEN c = j THEN -g[i][j] / g[j][j] ELSE g[i][c] - g[i][j] * g[j][c] / g[j][j] END"""
    on = " AND ".join(f"x.{k} = y.{k}" for k in keys.split(", "))
    return f"""series AS (SELECT {keys}, list(v ORDER BY i) AS v, count(*) AS n FROM {rows} GROUP BY {keys} HAVING count(*) >= 20),
lagged AS (SELECT *, unnest(range(0, least(greatest(1, CAST(floor(12 * pow(n / 100, 0.25)) AS BIGINT)), n // 4) + 1)) AS p FROM series),
sweep AS (SELECT {keys}, p, n, 0 AS j0, list_transform(range(1, p + 4), lambda i: list_transform(range(1, p + 4), lambda c: list_sum(list_transform(range(p + 2, n + 1), lambda t: CAST(({z('i')}) * ({z('c')}) AS DOUBLE))))) AS g FROM lagged
UNION ALL SELECT {keys}, p, n, j, list_transform(range(1, p + 4), lambda i: list_transform(range(1, p + 4), lambda c: {swept})) FROM (SELECT *, j0 + 1 AS j FROM sweep WHERE j0 < p + 2)),
adfs AS (SELECT {keys}, p, g[2][p + 3] / sqrt(g[p + 3][p + 3] / (n - p - 1 - (p + 2)) * g[2][2]) AS stat, (n - p - 1) * ln(g[p + 3][p + 3] / (n - p - 1)) + 2 * (p + 2) AS aic FROM sweep WHERE j0 = p + 2 AND g[p + 3][p + 3] > 0),
adf AS (SELECT {keys}, arg_min(stat, aic) AS stat, arg_min(p, aic) AS lags FROM adfs GROUP BY {keys})"""


def p_sql(stat, critical, levels=(0.01, 0.05, 0.10, 0.25)):
    steps = " ".join(f"WHEN {stat} <= {c1} THEN {p0} + ({stat} - ({c0})) / {c1 - c0} * {p1 - p0}" for c0, c1, p0, p1 in zip(critical, critical[1:], levels, levels[1:]))
    return f"CASE WHEN {stat} <= {critical[0]} THEN {levels[0] / 2} {steps} ELSE least(1, {levels[-1]} + ({stat} - ({critical[-1]})) / {-critical[-1]} * {1 - levels[-1]}) END"


ADF = f"ai AS (SELECT leg_a, leg_b, row_number() OVER (PARTITION BY leg_a, leg_b ORDER BY k) AS i, spread AS v FROM s), fold AS (SELECT 1), {adf_sql('ai', 'leg_a, leg_b', 150)}"


@query("t04_t06_adf", V, f"{SPREAD}, {ADF} SELECT leg_a, leg_b, round(stat, 4) AS adf_stat, lags AS adf_lags, round({p_sql('stat', stats.PAIR_CRITICAL)}, 5) AS adf_p FROM adf")
def t04(spark, sf):
    """Unit-root tests of every pair's residual spread, lags by the information criterion."""
    return stats.adf(spreads(spark, sf), BY, "k", "spread").select(*BY, r("adf_stat", 4), F.col("adf_lags").cast("long").alias("adf_lags"), r("adf_p", 5))


@query("t06_p_value", "", "WITH x AS (SELECT c_custkey AS id, -(c_custkey % 500) / 100.0 AS s FROM customer) SELECT id, round(CASE WHEN s <= -3.9 THEN 0.005 WHEN s <= -3.34 THEN 0.01 + (s + 3.9) / 0.56 * 0.04 WHEN s <= -3.04 THEN 0.05 + (s + 3.34) / 0.3 * 0.05 WHEN s <= -2.58 THEN 0.1 + (s + 3.04) / 0.46 * 0.15 ELSE least(1, 0.25 + (s + 2.58) / 2.58 * 0.75) END, 6) AS p FROM x")
def _(spark, sf):
    s = -(F.col("c_custkey") % 500) / 100.0
    return fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.round(stats.p_value(s), 6).alias("p"))


@query("t07_half_life", V, f"{SPREAD}, g AS (SELECT leg_a, leg_b, count(*) AS n, regr_slope(spread, b) AS phi FROM (SELECT *, lag(spread) OVER (PARTITION BY leg_a, leg_b ORDER BY k) AS b FROM s) GROUP BY 1, 2) SELECT leg_a, leg_b, n, round(phi, 5) AS phi, round(CASE WHEN n >= 20 AND phi > 0 AND phi < 1 THEN -ln(2) / ln(phi) END, 3) AS half_life FROM g")
def _(spark, sf):
    out = stats.half_life(spreads(spark, sf), BY, "k", "spread")
    return out.select(*BY, "n", r("phi", 5), r("half_life", 3))


@query("t08_crossings", V, f"{SPREAD}, d AS (SELECT *, spread - avg(spread) OVER (PARTITION BY leg_a, leg_b) AS d FROM s), c AS (SELECT leg_a, leg_b, (d >= 0) <> (lag(d) OVER (PARTITION BY leg_a, leg_b ORDER BY k) >= 0) AS x FROM d) SELECT leg_a, leg_b, round(CASE WHEN count(*) > 20 THEN count(*) FILTER (WHERE x) * 252 / count(*) END, 6) AS crossings FROM c GROUP BY 1, 2")
def _(spark, sf):
    return stats.crossings(spreads(spark, sf), BY, "k", "spread").select(*BY, r("crossings"))


@query("t09_t10_beta_cv", V, f"{ROLL} SELECT leg_a, leg_b, count(beta) AS windows, round(least(1000, stddev_samp(beta) / abs(avg(beta))), 3) AS beta_cv FROM b GROUP BY 1, 2")
def _(spark, sf):
    b = stats.rolling_tls(pair_rows(spark, sf), BY, "k", "x", "y")
    return stats.beta_cv(b, BY).select(*BY, "windows", F.round(F.least("beta_cv", F.lit(1000.0)), 3).alias("beta_cv"))


@query("t11_mean_shift", "closes", "+ b AS (SELECT *, row_number() OVER w AS k, sum(close) OVER w AS s, count(*) OVER p AS n, sum(close) OVER p AS total FROM closes WINDOW w AS (PARTITION BY symbol ORDER BY day), p AS (PARTITION BY symbol)) SELECT symbol, round(max(abs(s / k - (total - s) / (n - k)) / abs(total / n)), 6) AS shift, max(abs(s / k - (total - s) / (n - k)) / abs(total / n)) > 0.45 AS broken FROM b WHERE k > floor(n * 0.2) AND k <= floor(n * 0.8) GROUP BY 1")
def _(spark, sf):
    return stats.max_mean_shift(fx.closes(spark, sf).withColumnRenamed("close", "beta"), ["symbol"], "day").select("symbol", r("shift"), "broken")


#: A brand stands for a fund of the brands of its sector.
COMPONENTS = "cp AS (SELECT 'Brand#11' AS fund, symbol AS component FROM sectors WHERE sector = 'S0' AND symbol <> 'Brand#11')"
PROFILE_ROWS = "pr(profile, history, \"window\", min_r2, max_p, min_life, max_life, break_gate, min_crossings, funds, hold_cap) AS (VALUES " + ", ".join(f"('{k}', " + ", ".join(str(x).lower() if isinstance(x, bool) else repr(x) for x in v) + ")" for k, v in stats.PROFILES.items()) + ")"
_between = lambda x, low, high: f"CASE WHEN {x} <= {low} THEN 0.0 WHEN {x} >= {high} THEN 1.0 ELSE ({x} - {low}) / ({high} - {low}) END"


def validated_sql(where):
    """A view ``verdict`` of pairs under the profiles that ``where`` takes."""
    b = "profile, leg_a, leg_b"
    return f"""+ {COMPONENTS}, {PROFILE_ROWS}, l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS rn, count(*) OVER (PARTITION BY symbol) AS days FROM closes),
pp AS (SELECT pr.*, leg_a, leg_b, EXISTS (SELECT 1 FROM cp WHERE (fund = leg_a AND component = leg_b) OR (fund = leg_b AND component = leg_a)) AS related FROM pairs, pr WHERE {where}),
h AS (SELECT {b}, least(any_value(a.days), any_value(c.days)) AS days FROM pp JOIN l a ON a.symbol = leg_a AND a.rn = 1 JOIN l c ON c.symbol = leg_b AND c.rn = 1 GROUP BY ALL),
raw AS (SELECT {b}, -a.rn AS k, a.close AS pa, c.close AS pb FROM pp JOIN l a ON a.symbol = leg_a AND a.rn <= pp."window" JOIN l c ON c.symbol = leg_b AND c.rn = a.rn),
bar AS (SELECT {b}, days, CASE WHEN related AND NOT funds THEN 'fund_component' WHEN coalesce(days, 0) < history THEN 'short_history' WHEN EXISTS (SELECT 1 FROM raw r WHERE r.profile = pp.profile AND r.leg_a = pp.leg_a AND r.leg_b = pp.leg_b AND (pa <= 0 OR pb <= 0)) THEN 'bad_price' END AS barred FROM pp LEFT JOIN h USING ({b})),
nn AS (SELECT {b}, count(*) AS n FROM raw GROUP BY ALL),
x AS (SELECT {b}, k, ln(pb) AS x, ln(pa) AS y FROM raw JOIN bar USING ({b}) WHERE barred IS NULL),
m AS (SELECT {b}, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(y, x) AS c, avg(x) AS mx, avg(y) AS my FROM x GROUP BY ALL),
f AS (SELECT *, CASE WHEN abs(c) >= 1e-15 THEN (vy - vx + sqrt((vy - vx) ** 2 + 4 * c * c)) / (2 * c) END AS beta FROM m),
s AS (SELECT {b}, k, y - beta * x AS spread, row_number() OVER (PARTITION BY {b} ORDER BY k) AS i FROM x JOIN f USING ({b}) WHERE beta IS NOT NULL),
av AS (SELECT {b}, i, spread AS v FROM s), fold AS (SELECT 1), {adf_sql('av', b, 252)},
hl AS (SELECT {b}, count(*) AS n, regr_slope(spread, x) AS phi, count(*) FILTER ((d >= 0) <> (e >= 0)) AS crossed, avg(spread) AS mean, stddev_samp(spread) AS std, max_by(spread, k) AS final FROM (SELECT *, lag(spread) OVER w AS x, lag(d) OVER w AS e FROM (SELECT *, spread - avg(spread) OVER (PARTITION BY {b}) AS d FROM s) WINDOW w AS (PARTITION BY {b} ORDER BY k)) GROUP BY ALL),
rw AS (SELECT {b}, k, CASE WHEN abs(c) >= 1e-15 THEN (vy - vx + sqrt((vy - vx) ** 2 + 4 * c * c)) / (2 * c) END AS slope FROM (SELECT *, count(*) OVER q AS m, var_pop(x) OVER q AS vx, var_pop(y) OVER q AS vy, covar_pop(y, x) OVER q AS c FROM x WINDOW q AS (PARTITION BY {b} ORDER BY k ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) WHERE m = 30),
rs AS (SELECT *, row_number() OVER w AS j, sum(slope) OVER w AS run, count(*) OVER p AS m, sum(slope) OVER p AS total FROM rw WHERE slope IS NOT NULL WINDOW w AS (PARTITION BY {b} ORDER BY k), p AS (PARTITION BY {b})),
st AS (SELECT {b}, stddev_samp(slope) / abs(avg(slope)) AS beta_cv, coalesce(max(CASE WHEN j > floor(m * 0.2) AND j <= floor(m * 0.8) THEN abs((run / j - (total - run) / (m - j)) / abs(total / m)) END), 0) AS shift FROM rs GROUP BY ALL),
v AS (SELECT pp.*, nn.n, barred, beta, my - beta * mx AS alpha, CASE WHEN vy > 0 THEN 1 - (vy - 2 * beta * c + beta * beta * vx) / vy END AS r2, stat AS adf_stat, {p_sql('stat', stats.PAIR_CRITICAL)} AS adf_p0, CASE WHEN phi > 0 AND phi < 1 THEN -ln(2) / ln(phi) END AS half_life, crossed * 252 / n2 AS crossings, beta_cv, shift, mean, std, CASE WHEN std > 1e-12 THEN (final - mean) / std END AS z
FROM pp JOIN bar USING ({b}) LEFT JOIN nn USING ({b}) LEFT JOIN f USING ({b}) LEFT JOIN (SELECT {b}, stat FROM adf) ad USING ({b}) LEFT JOIN (SELECT {b}, n AS n2, phi, crossed, mean, std, final FROM hl) hl0 USING ({b}) LEFT JOIN st USING ({b})),
w AS (SELECT * EXCLUDE (adf_p0), CASE WHEN adf_stat IS NOT NULL THEN adf_p0 END AS adf_p, barred IS NULL AND beta IS NOT NULL AS found, coalesce(shift > 0.45, false) AS broken FROM v),
verdict AS (SELECT *, CASE WHEN barred IS NOT NULL THEN barred WHEN NOT found THEN 'no_fit' ELSE concat_ws(',', CASE WHEN NOT coalesce(r2 >= min_r2, false) THEN 'low_r2' END, CASE WHEN NOT coalesce(adf_p < max_p, false) THEN 'not_cointegrated' END, CASE WHEN NOT coalesce(half_life BETWEEN min_life AND max_life, false) THEN 'half_life' END, CASE WHEN NOT coalesce(crossings >= min_crossings, false) THEN 'few_crossings' END, CASE WHEN broken THEN 'structural_break' END, CASE WHEN coalesce(beta_cv >= 0.35, false) THEN 'unstable_slope' END) END AS reasons,
found AND coalesce(r2 >= min_r2, false) AND coalesce(adf_p < max_p, false) AND coalesce(half_life BETWEEN min_life AND max_life, false) AND coalesce(crossings >= min_crossings, false) AND NOT (broken AND break_gate) AS passed,
CASE WHEN found THEN 0.35 * (1 - {_between('coalesce(adf_p, 1)', 0.01, 0.10)}) + 0.25 * CASE WHEN half_life >= 1 AND half_life < 2 THEN half_life - 1 WHEN half_life >= 2 AND half_life <= 15 THEN 1 WHEN half_life > 15 AND half_life <= 40 THEN 1 - (half_life - 15) / 25 ELSE 0 END + 0.25 * CASE WHEN broken THEN 0 ELSE 1 - {_between('coalesce(beta_cv, 1)', 0.05, 0.20)} END + 0.15 * least(1, greatest(0, coalesce(r2, 0))) END AS score FROM w)"""


VERDICT = "leg_a, leg_b, n, round(beta, 4) AS beta, round(alpha, 4) + 0.0 AS alpha, round(r2, 4) + 0.0 AS r2, round(adf_stat, 4) AS adf_stat, round(adf_p, 5) AS adf_p, round(half_life, 4) AS half_life, round(crossings, 4) AS crossings, round(least(beta_cv, 1000), 3) AS beta_cv, broken, reasons, passed, round(score, 5) AS score"


def validated(spark, sf, **more):
    s = fx.sectors(spark, sf)
    components = s.where("sector = 'S0' and symbol <> 'Brand#11'").select(F.lit("Brand#11").alias("fund"), F.col("symbol").alias("component"))
    return stats.validate_pairs(fx.closes(spark, sf), fx.candidates(spark, sf), components=components, **more)


def shown_pairs(rows, *more):
    return rows.select(*BY, *more, F.col("n").cast("long").alias("n"), r("beta", 4), r("alpha", 4), r("r2", 4), r("adf_stat", 4), r("adf_p", 5), r("half_life", 4), r("crossings", 4), F.round(F.least("beta_cv", F.lit(1000.0)), 3).alias("beta_cv"), "broken", F.array_join("reasons", ",").alias("reasons"), "passed", r("score", 5))


ONE = "pr.profile = 'stocks'"


@query("t12_t14_validate_pairs", V, f"{validated_sql(ONE)} SELECT {VERDICT} FROM verdict")
def t12(spark, sf):
    """Every pair's statistics, the reasons against it, score and verdict."""
    return shown_pairs(validated(spark, sf))


@query("t13_profiles", V, f"{validated_sql('true')} SELECT profile, passed, reasons, count(*) AS n, round(sum(score), 4) AS score FROM verdict GROUP BY ALL")
def _(spark, sf):
    """Verdicts and reasons under each profile: stocks, metals, and one that lets almost all through."""
    rows = validated(spark, sf, profiles=stats.PROFILES).withColumn("reasons", F.array_join("reasons", ","))
    return rows.groupBy("profile", "passed", "reasons").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("score"))


@query("t15_top_pairs", V, f"{validated_sql(ONE)} SELECT leg_a, leg_b, round(score, 5) AS score, passed FROM verdict WHERE score IS NOT NULL QUALIFY row_number() OVER (ORDER BY passed DESC, round(score, 5) DESC, leg_a, leg_b) <= 10")
def t15(spark, sf):
    """The ten best pairs: those that passed first, then by score."""
    out = validated(spark, sf).where("score is not null").select(*BY, r("score", 5), "passed")
    return out.orderBy(F.desc("passed"), F.desc("score"), *BY).limit(10)


@query("t24_scan_pair", V, f"{validated_sql(ONE)} SELECT leg_a || '/' || leg_b AS pair_id, passed, reasons, round(beta, 4) AS beta, round(half_life, 4) AS half_life, round(mean, 4) + 0.0 AS mean, round(std, 5) AS std, round(z, 4) + 0.0 AS z FROM verdict")
def _(spark, sf):
    """A scan of every pair: verdict, hedge, and where its spread stands against its own mean and sample deviation."""
    rows = validated(spark, sf)
    return rows.select(F.concat_ws("/", *BY).alias("pair_id"), "passed", F.array_join("reasons", ",").alias("reasons"), r("beta", 4), r("half_life", 4), r("mean", 4), r("std", 5), r("z", 4))


LIFE = "WITH x AS (SELECT c_custkey AS id, c_acctbal / 100 AS life, (c_custkey % 7) - 3.0 AS z FROM customer)"


@query("t16_t20_pair_expressions", "", LIFE + " SELECT id, CAST(CASE WHEN life <= 0 THEN 30 ELSE least(ceil(2.5 * life), 30) END AS INT) AS hold, round(CASE WHEN life > 0 THEN ln(2) / life END, 6) AS kappa, CAST(CASE WHEN life > 0 THEN greatest(20, least(60, 2 * ceil(life))) ELSE 0 END AS INT) AS look_back, round(CASE WHEN life > 0 THEN abs(z) * sqrt(ln(2) / life) / 0.02 ELSE 0 END, 6) AS priority, round(CASE WHEN life > 0 THEN abs(z) * 0.02 * (ln(2) / life) / (1 + (ln(2) / life) * 5) ELSE 0 END, 6) AS expected, round((abs(z) * 0.02 - 0.001) / greatest(id % 9 - 4, 1), 6) AS remaining FROM x")
def _(spark, sf):
    x = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal").cast("double") / 100).alias("life"), (F.col("c_custkey") % 7 - 3.0).alias("z"))
    life, z, kappa = F.col("life"), F.col("z"), stats.kappa_of(F.col("life"))
    sigma = F.lit(0.02)
    return x.select("id", stats.max_hold_days(life).alias("hold"), F.round(kappa, 6).alias("kappa"), stats.look_back(life).alias("look_back"), F.round(stats.priority(z, kappa, sigma), 6).alias("priority"), F.round(stats.expected_return(z, sigma, kappa, 5.0), 6).alias("expected"), F.round(stats.remaining_per_day(z, sigma, F.lit(0.001), F.col("id") % 9, F.lit(4)), 6).alias("remaining"))


BV = "closes sectors baskets"
BSPREAD = """+ n AS (SELECT target, count(*) AS size FROM baskets GROUP BY 1), m AS (SELECT b.sector, b.target, c.day, avg(ln(c.close)) AS mean, count(*) AS have FROM baskets b JOIN closes c ON c.symbol = b.peer WHERE c.close > 0 GROUP BY 1, 2, 3),
sp AS (SELECT m.sector, m.target, m.day, ln(c.close) - m.mean AS spread FROM m JOIN n USING (target) JOIN closes c ON c.symbol = m.target AND c.day = m.day WHERE have = size AND c.close > 0)"""


def basket_rows(spark, sf, key="p_brand"):
    return stats.basket_spread(fx.closes(spark, sf, key), fx.baskets(spark, sf, key))


@query("t26_basket_spread", BV, f"{BSPREAD} SELECT sector, target, day::VARCHAR AS day, round(spread, 6) AS spread FROM sp")
def _(spark, sf):
    return basket_rows(spark, sf).select("sector", "target", F.col("day").cast("string").alias("day"), r("spread"))


@query("t05_basket_adf", BV, f"{BSPREAD}, bi AS (SELECT sector, target, i, spread AS v FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY day) AS i, row_number() OVER (PARTITION BY target ORDER BY day DESC) AS back FROM sp) WHERE back <= 60), bj AS (SELECT sector, target, row_number() OVER (PARTITION BY target ORDER BY i) AS i, v FROM bi), fold AS (SELECT 1), {adf_sql('bj', 'sector, target', 60)} SELECT sector, target, round(stat, 4) AS adf_stat, lags AS adf_lags, round({p_sql('stat', stats.PLAIN_CRITICAL)}, 5) AS adf_p FROM adf")
def _(spark, sf):
    """Unit-root tests of the last days of every basket's spread, a fixed formula and no residual."""
    out = stats.adf(basket_rows(spark, sf), ["sector", "target"], "day", "spread", stats.PLAIN_CRITICAL, 60)
    return out.select("sector", "target", r("adf_stat", 4), F.col("adf_lags").cast("long").alias("adf_lags"), r("adf_p", 5))


OU = f"""{BSPREAD}, q AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY day DESC) AS rn FROM sp QUALIFY rn <= 60), p AS (SELECT *, lag(spread) OVER (PARTITION BY target ORDER BY day) AS x FROM q),
g AS (SELECT sector, target, count(*) AS pairs, regr_slope(spread, x) AS b, regr_intercept(spread, x) AS a, regr_syy(spread, x) AS syy, regr_sxy(spread, x) AS sxy FROM p WHERE x IS NOT NULL GROUP BY 1, 2),
o AS (SELECT *, CASE WHEN b > 0 AND b < 1 AND pairs > 2 THEN b END AS bb FROM g),
fit AS (SELECT sector, target, pairs, a, b, -ln(bb) * 252 AS kappa, a / (1 - bb) AS mu, sqrt((syy - bb * sxy) / (pairs - 2) / (1 - bb * bb)) AS sigma_eq, -ln(2) / ln(bb) AS half_life FROM o)"""


@query("t27_ou_fit", BV, f"{OU} SELECT sector, target, pairs, round(a, 6) AS a, round(b, 6) AS b, round(kappa, 4) AS kappa, round(mu, 6) AS mu, round(sigma_eq * sqrt(2 * kappa), 5) AS sigma, round(sigma_eq, 6) AS sigma_eq, round(half_life, 5) AS half_life FROM fit")
def _(spark, sf):
    return stats.ou_fit(basket_rows(spark, sf), ["sector", "target"]).select("sector", "target", "pairs", r("a"), r("b"), r("kappa", 4), r("mu"), r("sigma", 5), r("sigma_eq"), r("half_life", 5))


#: erfi as a sum: 2 / sqrt(pi) * sum of z^(2 n + 1) / (n! (2 n + 1)).
ERFI = "2 / sqrt(pi()) * list_sum(list_transform(range(0, 60), lambda n: pow(({z}), 2 * n + 1) / (gamma(n + 1) * (2 * n + 1))))"


def rate(k):
    return f"(2 * ({k}) * sigma_eq - 0.0005) * kappa / (2 * pi() * {ERFI.format(z=f'({k}) / sqrt(2)')})"


#: Newton steps on a grid's best, for each fit (target, kappa, sigma_eq) of a table ``fit``.
THRESHOLD = f"""gr AS (SELECT target, kappa, sigma_eq, CAST(0.12 + 0.02 * i AS DOUBLE) AS k FROM fit, range(0, 199) t(i) WHERE kappa > 0 AND sigma_eq > 0),
best AS (SELECT target, kappa, sigma_eq, arg_max(k, rate) AS k FROM (SELECT *, {rate('k')} AS rate FROM gr) GROUP BY ALL HAVING max(rate) > 0),
fold AS (SELECT target, kappa, sigma_eq, k, 0 AS i, false AS done FROM best
UNION ALL SELECT target, kappa, sigma_eq, CASE WHEN abs(bend) < 1e-12 OR abs(slope / bend) < 1e-6 THEN k ELSE least(5.0, greatest(0.1, k - least(0.5, greatest(-0.5, slope / bend)))) END, i + 1, abs(bend) < 1e-12 OR abs(slope / bend) < 1e-6
FROM (SELECT *, (hi - lo) / 0.002 AS slope, (hi - 2 * mid + lo) / 1e-6 AS bend FROM (SELECT *, {rate('k - 0.001')} AS lo, {rate('k')} AS mid, {rate('k + 0.001')} AS hi FROM fold WHERE i < 10 AND NOT done))),
threshold AS (SELECT target, k, {rate('k')} AS rate, 252 * 2 * pi() * {ERFI.format(z='k / sqrt(2)')} / kappa AS cycle FROM fold QUALIFY row_number() OVER (PARTITION BY target ORDER BY i DESC) = 1)"""


@query("t28_thresholds", BV, f"{OU}, {THRESHOLD} SELECT sector, target, round(fit.kappa, 4) AS kappa, round(k, 5) AS k, round(rate, 6) AS rate, round(cycle, 5) AS cycle FROM fit LEFT JOIN threshold USING (target) WHERE fit.kappa IS NOT NULL")
def t28(spark, sf):
    fits = stats.with_threshold(stats.ou_fit(basket_rows(spark, sf), ["sector", "target"]).where("kappa is not null"))
    return fits.select("sector", "target", r("kappa", 4), r("k", 5), r("rate"), r("cycle", 5))


SHARE = f"""{BSPREAD}, legs AS (SELECT target, peer AS symbol, -1.0 / size AS weight FROM baskets JOIN n USING (target) UNION ALL SELECT target, target, 1.0 FROM n),
c AS (SELECT sp.sector, legs.target, legs.symbol, CAST(weight AS DOUBLE) AS weight, covar_samp(ln(c.close), spread) * CAST(weight AS DOUBLE) / var_samp(spread) AS contribution FROM sp JOIN legs USING (target) JOIN closes c ON c.symbol = legs.symbol AND c.day = sp.day GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10)"""


@query("t29_contributions", BV, f"{SHARE} SELECT sector, target, symbol, round(weight, 6) AS weight, round(contribution, 6) AS contribution FROM c")
def _(spark, sf):
    return stats.contributions(fx.closes(spark, sf), fx.baskets(spark, sf)).select("sector", "target", "symbol", r("weight"), r("contribution"))


@query("t30_dominance", BV, f"{SHARE} SELECT target, round(max(abs(contribution)), 6) AS dominance, round(max(CASE WHEN symbol = target THEN abs(contribution) END), 6) AS centrality FROM c GROUP BY 1")
def _(spark, sf):
    c = stats.contributions(fx.closes(spark, sf), fx.baskets(spark, sf))
    return c.groupBy("target").agg(F.round(F.max(F.abs("contribution")), 6).alias("dominance"), F.round(F.max(F.when(F.col("symbol") == F.col("target"), F.abs("contribution"))), 6).alias("centrality"))


def fits_sql(dates, days, max_p, max_share, least):
    """Views of the fits as of dates; the last, ``fits``, has a row for each basket and date."""
    return f"""{BSPREAD}, dates AS ({dates}), sn AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY day) AS i FROM sp),
every AS (SELECT DISTINCT sector, target, as_of FROM baskets, dates), cnt AS (SELECT e.sector, e.target, e.as_of, count(i) AS n, coalesce(max(i), 0) AS high FROM every e LEFT JOIN sn ON sn.target = e.target AND sn.day < e.as_of AND sn.day >= e.as_of - {days} GROUP BY ALL),
rw AS (SELECT c.sector, c.target, c.as_of, sn.day, sn.i - high + 60 AS i, spread, spread AS v FROM cnt c JOIN sn ON sn.target = c.target AND sn.i > high - 60 AND sn.i <= high WHERE n >= 60),
rl AS (SELECT *, lag(spread) OVER (PARTITION BY target, as_of ORDER BY i) AS x FROM rw),
g AS (SELECT target, as_of, count(x) AS pairs, regr_slope(spread, x) AS b, regr_intercept(spread, x) AS a, regr_syy(spread, x) AS syy, regr_sxy(spread, x) AS sxy FROM rl GROUP BY ALL),
o AS (SELECT *, CASE WHEN b > 0 AND b < 1 AND pairs > 2 THEN b END AS bb FROM g),
fits0 AS (SELECT target || '@' || as_of AS target, -ln(bb) * 252 AS kappa, a / (1 - bb) AS mu, sqrt(greatest(0, syy - bb * sxy) / (pairs - 2) / (1 - bb * bb)) AS sigma_eq FROM o), fit AS (SELECT * FROM fits0), {THRESHOLD}, {adf_sql('rw', 'target, as_of', 60)},
lg AS (SELECT target, peer AS symbol, -1.0 / size AS w FROM baskets JOIN n USING (target) UNION ALL SELECT target, target, 1.0 FROM n),
sh AS (SELECT rw.target, as_of, lg.symbol, CAST(any_value(w) AS DOUBLE) * covar_samp(ln(c.close), spread) / var_samp(spread) AS share FROM rw JOIN lg USING (target) JOIN closes c ON c.symbol = lg.symbol AND c.day = rw.day GROUP BY ALL),
dm AS (SELECT target, as_of, max(abs(share)) AS dominance, max(CASE WHEN symbol = target THEN abs(share) END) AS centrality FROM sh GROUP BY ALL),
fits1 AS (SELECT cnt.sector, cnt.target, cnt.as_of, cnt.n, kappa, mu, sigma_eq, adf.stat, {p_sql('adf.stat', stats.PLAIN_CRITICAL)} AS adf_p, dominance, centrality, k, rate, cycle FROM cnt LEFT JOIN fit ON fit.target = cnt.target || '@' || cnt.as_of LEFT JOIN threshold ON threshold.target = fit.target LEFT JOIN adf ON adf.target = cnt.target AND adf.as_of = cnt.as_of LEFT JOIN dm ON dm.target = cnt.target AND dm.as_of = cnt.as_of),
fits AS (SELECT *, CASE WHEN n < 60 THEN 'short_history' WHEN NOT coalesce(adf_p <= {max_p}, false) THEN 'not_stationary' WHEN NOT coalesce(dominance <= {max_share}, false) THEN 'dominated' WHEN NOT coalesce(centrality >= {least}, false) THEN 'target_not_central' WHEN kappa IS NULL THEN 'no_reversion' WHEN k IS NULL THEN 'no_threshold' END AS reason FROM fits1)"""


FIT = "n, round(kappa, 3) AS kappa, round(mu, 6) + 0.0 AS mu, round(sigma_eq, 6) AS sigma_eq, round(stat, 4) AS adf_stat, round(CASE WHEN stat IS NOT NULL THEN adf_p END, 5) AS adf_p, round(dominance, 6) AS dominance, round(centrality, 6) AS centrality, round(CASE WHEN k IS NOT NULL THEN least(2.5, greatest(0.15, k)) END, 5) AS k, round(rate, 4) AS rate, round(cycle, 4) AS cycle, k < 0.15 OR k > 2.5 AS clipped, reason, reason IS NULL AS passed FROM fits"


def shown_fits(rows, *more):
    return rows.select("sector", "target", *more, F.col("n").cast("long").alias("n"), r("kappa", 3), r("mu"), r("sigma_eq"), r("adf_stat", 4), r("adf_p", 5), r("dominance"), r("centrality"), r("k", 5), r("rate", 4), r("cycle", 4), "clipped", "reason", "passed")


@query("t31_validate_baskets", BV, f"{fits_sql('SELECT max(day) + 1 AS as_of FROM closes', 100000, 0.10, 0.60, 0.30)} SELECT sector, target, {FIT}")
def t31(spark, sf):
    """Every basket's fit over its last days, with the first gate that it fails."""
    return shown_fits(stats.validate_baskets(fx.closes(spark, sf), fx.baskets(spark, sf), max_p=0.10, least_centrality=0.30))


MONTHS = "SELECT CAST(unnest(generate_series(DATE '1995-06-01', DATE '2001-12-01', INTERVAL 3 MONTH)) AS DATE) AS as_of"


@query("t32_fits_as_of", BV, f"{fits_sql(MONTHS, 180 * 7, 0.10, 0.60, 0.30)} SELECT sector, target, as_of::VARCHAR AS as_of, {FIT}")
def t32(spark, sf):
    """Walk-forward fits: a row for each basket and quarter's first day, the dates being rows of the same plan."""
    dates = spark.range(1).select(F.explode(F.expr("sequence(date'1995-06-01', date'2001-12-01', interval 3 months)")).alias("as_of"))
    fits = stats.fits_as_of(fx.closes(spark, sf), fx.baskets(spark, sf), dates, days=180 * 7, max_p=0.10, least_centrality=0.30)
    return shown_fits(fits, F.col("as_of").cast("string").alias("as_of"))


KALMAN = f"""{ROWS}, o AS (SELECT leg_a || '/' || leg_b AS pair_id, k, x, y, row_number() OVER (PARTITION BY leg_a, leg_b ORDER BY k) AS i FROM x),
fold AS (SELECT DISTINCT pair_id, CAST(0 AS BIGINT) AS i, 0.0::DOUBLE AS a, 1.0::DOUBLE AS b, 1.0::DOUBLE AS p00, 0.0::DOUBLE AS p01, 1.0::DOUBLE AS p11, 0 AS n, false AS ready FROM o
UNION ALL SELECT pair_id, i, CASE WHEN off THEN 0 ELSE a END, CASE WHEN off THEN 1 ELSE b END, CASE WHEN off THEN 1 ELSE p00 - k0 * (p00 + x * p01) END, CASE WHEN off THEN 0 ELSE p01 - k0 * (p01 + x * p11) END, CASE WHEN off THEN 1 ELSE p11 - k1 * (p01 + x * p11) END, CASE WHEN off THEN 0 ELSE n + 1 END, NOT off AND n + 1 >= 10
FROM (SELECT pair_id, i, x, n, p00, p01, p11, k0, k1, a + k0 * e AS a, b + k1 * e AS b, abs(b + k1 * e) >= 5 AS off
FROM (SELECT *, (p00 + x * p01) / (p00 + 2 * x * p01 + x * x * p11 + 1e-3) AS k0, (p01 + x * p11) / (p00 + 2 * x * p01 + x * x * p11 + 1e-3) AS k1, y - a - b * x AS e
FROM (SELECT o.pair_id, o.i, o.x, o.y, f.a, f.b, f.n, f.p00 + 1e-5 AS p00, f.p01, f.p11 + 1e-5 AS p11 FROM fold f JOIN o ON o.pair_id = f.pair_id AND o.i = f.i + 1))))
SELECT pair_id, k, round(a, 5) + 0.0 AS alpha, round(b, 5) + 0.0 AS beta, ready FROM fold JOIN o USING (pair_id, i)"""


@query("t33_kalman_hedge", V, KALMAN)
def t33(spark, sf):
    rows = pair_rows(spark, sf).select(F.concat_ws("/", *BY).alias("pair_id"), "k", "x", "y")
    return scan.fold(rows, "pair_id", ["k"], lambda s, row: detectors.kalman_step(s, row.x, row.y), "pair_id string, k int, x double, y double, alpha double, beta double, ready boolean").select("pair_id", "k", r("alpha", 5), r("beta", 5), "ready")
