"""Keyed statistics of price series: regressions, unit-root tests, mean reversion, variance shares."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Significance levels and critical values of the unit-root tests.
LEVELS = (0.01, 0.05, 0.10, 0.25)
PAIR_CRITICAL = (-3.90, -3.34, -3.04, -2.58)
PLAIN_CRITICAL = (-3.435, -2.864, -2.568, -2.196)


def ols(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """slope, intercept, r2 and the slope's standard error; null under three rows or where x is flat."""
    g = rows.groupBy(*by).agg(F.regr_count(y, x).alias("n"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.avg(x).alias("mx"), F.avg(y).alias("my"))
    ok = (F.col("n") >= 3) & (F.col("sxx") > 1e-15)
    slope = F.when(ok, F.col("sxy") / F.col("sxx"))
    g = g.withColumn("slope", slope)
    rest = F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("sxy"))
    return g.select(*by, "n", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), F.when(F.col("syy") > 0, 1 - rest / F.col("syy")).alias("r2"), F.sqrt(rest / (F.col("n") - 2) / F.col("sxx")).alias("se"))


def _tls_slope(vx: Column, vy: Column, c: Column) -> Column:
    d = vy - vx
    return F.when(F.abs(c) >= 1e-15, (d + F.sqrt(d * d + 4 * c * c)) / (2 * c))


def tls(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Total least squares: slope, intercept from the means, and r2 of the vertical residuals, which may be below 0."""
    g = rows.groupBy(*by).agg(F.count("*").alias("n"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("c"), F.avg(x).alias("mx"), F.avg(y).alias("my"))
    g = g.withColumn("beta", _tls_slope(F.col("vx"), F.col("vy"), F.col("c")))
    rest = F.col("vy") - 2 * F.col("beta") * F.col("c") + F.col("beta") ** 2 * F.col("vx")
    return g.select(*by, "n", "beta", (F.col("my") - F.col("beta") * F.col("mx")).alias("alpha"), F.when(F.col("vy") > 0, 1 - rest / F.col("vy")).alias("r2"))


def rolling_tls(rows: DataFrame, by: list[str], order: str, x: str, y: str, n: int = 30) -> DataFrame:
    """The slope of each full window of n rows."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(-(n - 1), 0)
    out = rows.withColumns({"full": F.count("*").over(w) == n, "beta": _tls_slope(F.var_pop(x).over(w), F.var_pop(y).over(w), F.covar_pop(x, y).over(w))})
    return out.where("full").drop("full")


def beta_cv(rolled: DataFrame, by: list[str]) -> DataFrame:
    return rolled.groupBy(*by).agg(F.count("beta").alias("windows"), (F.stddev_samp("beta") / F.abs(F.avg("beta"))).alias("beta_cv"))


def max_mean_shift(rolled: DataFrame, by: list[str], order: str, low: float = 0.2, high: float = 0.8) -> DataFrame:
    """The largest difference of means before and after a split between 20 % and 80 %, over the absolute mean."""
    w = W.partitionBy(*by).orderBy(order)
    run = w.rowsBetween(W.unboundedPreceding, 0)
    rows = rolled.withColumns({"k": F.row_number().over(w), "s": F.sum("beta").over(run), "n": F.count("*").over(W.partitionBy(*by)), "total": F.sum("beta").over(W.partitionBy(*by))})
    rows = rows.where((F.col("k") > F.floor(F.col("n") * low)) & (F.col("k") <= F.floor(F.col("n") * high)) & (F.col("k") < F.col("n")))
    shift = F.abs(F.col("s") / F.col("k") - (F.col("total") - F.col("s")) / (F.col("n") - F.col("k"))) / F.abs(F.col("total") / F.col("n"))
    return rows.groupBy(*by).agg(F.max(shift).alias("shift")).withColumn("broken", F.col("shift") > break_threshold())


def break_threshold(window: int = 30) -> float:
    return min(0.5, max(0.15, 0.75 - 0.01 * window))


def half_life(rows: DataFrame, by: list[str], order: str, value: str, least: int = 20) -> DataFrame:
    """-ln 2 / ln of the slope on the value before, if that lies in (0, 1) and there are enough rows."""
    rows = rows.withColumn("__before", F.lag(value).over(W.partitionBy(*by).orderBy(order)))
    g = rows.groupBy(*by).agg(F.regr_slope(value, "__before").alias("phi"), F.count("*").alias("n"))
    return g.select(*by, "n", "phi", F.when((F.col("n") >= least) & (F.col("phi") > 0) & (F.col("phi") < 1), -math.log(2) / F.log("phi")).alias("half_life"))


def crossings(rows: DataFrame, by: list[str], order: str, value: str, per_year: int = 252, least: int = 20) -> DataFrame:
    """Changes of side of the value about its mean, per year; the mean itself is on the upper side."""
    rows = rows.withColumn("__d", F.col(value) - F.avg(value).over(W.partitionBy(*by)))
    before = F.lag("__d").over(W.partitionBy(*by).orderBy(order))
    rows = rows.withColumn("__x", ((F.col("__d") >= 0) != (before >= 0)).cast("int"))
    return rows.groupBy(*by).agg(F.when(F.count("*") > least, F.sum("__x") * per_year / F.count("*")).alias("crossings"))


def p_value(stat: Column, critical=PAIR_CRITICAL, levels=LEVELS) -> Column:
    """Linear between critical values; half the first level below all of them, linear to 1 at 0 above."""
    out = F.when(stat <= critical[0], levels[0] / 2)
    for (c0, p0), (c1, p1) in zip(zip(critical, levels), list(zip(critical, levels))[1:]):
        out = out.when(stat <= c1, p0 + (stat - c0) / (c1 - c0) * (p1 - p0))
    return out.otherwise(F.least(F.lit(1.0), levels[-1] + (stat - critical[-1]) / (0 - critical[-1]) * (1 - levels[-1])))


LEAST_ADF = 20  # values of a series that is tested


def adf_statistic(series: np.ndarray, max_lags: int | None = None) -> tuple[float, int]:
    """The t value of the level in a regression of differences on a constant, the level and lagged differences; and the
    number of lags, of all up to the bound the one with the least information criterion."""
    n = len(series)
    if n < LEAST_ADF:
        return math.nan, 0
    top = int(min(max(1, 12 * (n / 100) ** 0.25), n // 4)) if max_lags is None else max_lags
    d = np.diff(series)
    best = (math.inf, math.nan, 0)
    for p in range(top + 1):
        y = d[p:]
        x = np.column_stack([np.ones(len(y)), series[p:-1], *(d[p - j : len(d) - j] for j in range(1, p + 1))])
        if len(y) <= x.shape[1] + 1:
            break
        gram = x.T @ x
        if np.linalg.cond(gram) > 1e14:
            continue
        b = np.linalg.solve(gram, x.T @ y)
        ssr = float(((y - x @ b) ** 2).sum())
        if ssr <= 0:
            continue
        aic = len(y) * math.log(ssr / len(y)) + 2 * x.shape[1]
        se = math.sqrt(ssr / (len(y) - x.shape[1]) * np.linalg.inv(gram)[1, 1])
        if aic < best[0]:
            best = (aic, float(b[1] / se), p)
    return best[1], best[2]


def adf(rows: DataFrame, by: list[str], order: str, value: str, critical=PAIR_CRITICAL, longest: int = 150) -> DataFrame:
    """(by, adf_stat, adf_lags, adf_p) of each key's last ``longest`` values: a bounded array a key, solved in Arrow batches."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(order)))
    series = rows.withColumn("__rn", rank).where(F.col("__rn") <= longest).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("s"))

    def run(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([adf_statistic(np.asarray(x, float)) for x in batch], columns=["stat", "lags"])

    solve = F.pandas_udf(run, "stat double, lags int")
    out = series.select(*by, solve(F.transform("s", lambda x: x[value].cast("double"))).alias("t"))
    return out.select(*by, F.nanvl(F.col("t.stat"), F.lit(None)).alias("adf_stat"), F.col("t.lags").alias("adf_lags"), p_value(F.col("t.stat"), critical).alias("adf_p"))


def ols_many(rows: DataFrame, by: list[str], xs: list[str], y: str) -> DataFrame:
    """Coefficients and standard errors of y on a constant and xs: sums of products by key, one small solve a key."""
    names = ["__one", *xs]
    rows = rows.withColumn("__one", F.lit(1.0))
    p = len(names)
    g = rows.groupBy(*by).agg(F.count("*").alias("n"), F.array(*(F.sum(F.col(a) * F.col(b)) for a in names for b in names)).alias("xx"), F.array(*(F.sum(F.col(a) * F.col(y)) for a in names)).alias("xy"), F.sum(F.col(y) ** 2).alias("yy"))

    def run(n: pd.Series, xx: pd.Series, xy: pd.Series, yy: pd.Series) -> pd.DataFrame:
        out = []
        for k, a, b, s in zip(n, xx, xy, yy):
            a, b = np.array(a).reshape(p, p), np.array(b)
            if k <= p or np.linalg.cond(a) > 1e13:
                out.append((None, None))
                continue
            c = np.linalg.solve(a, b)
            var = max(0.0, s - c @ b) / (k - p)
            out.append((c.tolist(), np.sqrt(np.diag(np.linalg.inv(a)) * var).tolist()))
        return pd.DataFrame(out, columns=["coefficients", "errors"])

    return g.select(*by, "n", F.pandas_udf(run, "coefficients array<double>, errors array<double>")("n", "xx", "xy", "yy").alias("f")).select(*by, "n", "f.*")


def pair_spreads(closes: DataFrame, pairs: DataFrame, n: int = 150) -> DataFrame:
    """(leg_a, leg_b, rn, k, x, y): logs of the last n closes of both legs, k rising with time; x is of leg b."""
    from .tables import recent_pairs

    rows = recent_pairs(closes.where("close > 0"), pairs, n)
    return rows.select("leg_a", "leg_b", "rn", (-F.col("rn")).alias("k"), F.log("b").alias("x"), F.log("a").alias("y"))


def basket_spread(closes: DataFrame, baskets: DataFrame) -> DataFrame:
    """(sector, target, day, spread): log of the target less the mean log of its peers, on days that all have a usable price."""
    size = baskets.groupBy("target").agg(F.count("*").alias("size"))
    price = closes.where("close > 0").select("symbol", "day", F.log("close").alias("p"))
    peers = baskets.join(price.withColumnRenamed("symbol", "peer"), "peer").groupBy("sector", "target", "day").agg(F.avg("p").alias("mean"), F.count("*").alias("have"))
    rows = peers.join(size, "target").where("have = size").join(price.withColumnRenamed("symbol", "target"), ["target", "day"])
    return rows.select("sector", "target", "day", (F.col("p") - F.col("mean")).alias("spread"))


def ou_fit(spreads: DataFrame, by: list[str], order: str = "day", value: str = "spread", n: int = 60, per_year: int = 252) -> DataFrame:
    """Mean reversion of the last n values: a and b of the regression on the value before, and from them the speed, level,
    volatility and spread of an Ornstein-Uhlenbeck process; nulls where b is outside (0, 1)."""
    w = W.partitionBy(*by).orderBy(order)
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(order)))
    rows = spreads.withColumn("__rn", rank).where(F.col("__rn") <= n).withColumn("__x", F.lag(value).over(w)).where(F.col("__x").isNotNull())
    g = rows.groupBy(*by).agg(F.count("*").alias("pairs"), F.regr_slope(value, "__x").alias("b"), F.regr_intercept(value, "__x").alias("a"), F.regr_syy(value, "__x").alias("syy"), F.regr_sxy(value, "__x").alias("sxy"))
    return _ou_columns(g, by, per_year)


def _ou_columns(g: DataFrame, by: list[str], per_year: int) -> DataFrame:
    """Parameters of the process from the moments (pairs, a, b, syy, sxy) of a regression on the value before."""
    ok = (F.col("b") > 0) & (F.col("b") < 1) & (F.col("pairs") > 2)
    b = F.when(ok, F.col("b"))
    kappa = -F.log(b) * per_year
    var = F.greatest(F.lit(0.0), F.col("syy") - b * F.col("sxy")) / (F.col("pairs") - 2)
    equal = F.sqrt(var / (1 - b * b))
    return g.select(*by, "pairs", "a", "b", kappa.alias("kappa"), (F.col("a") / (1 - b)).alias("mu"), (equal * F.sqrt(2 * kappa)).alias("sigma"), equal.alias("sigma_eq"), (-math.log(2) / F.log(b)).alias("half_life"))


def passage_time(k: np.ndarray, terms: int = 60) -> np.ndarray:
    """Mean time of a round trip between the levels -k and k of an OU process of unit speed and deviation: 2 pi erfi(k / sqrt 2)."""
    z = np.asarray(k, float) / math.sqrt(2)
    term, total = z.copy(), z.copy()
    for n in range(1, terms):
        term = term * z * z / n
        total = total + term / (2 * n + 1)
    return 4 * math.sqrt(math.pi) * total


def best_threshold(kappa: float, sigma_eq: float, cost: float) -> tuple[float, float, float] | None:
    """k in deviations, rate a year and cycle length in years that maximise (2 k sigma - cost) over the cycle's time.

    The best of a grid, then Newton steps by differences; none where no k of the grid pays for its cost.
    """
    grid = 0.12 + 0.02 * np.arange(199)
    rate = (2 * grid * sigma_eq - cost) * kappa / passage_time(grid)
    k = float(grid[rate.argmax()])
    if not rate.max() > 0:
        return None
    h = 1e-3
    for _ in range(10):
        at = np.array([k - h, k, k + h])
        low, mid, high = (2 * at * sigma_eq - cost) * kappa / passage_time(at)
        slope, bend = (high - low) / (2 * h), (high - 2 * mid + low) / (h * h)
        if abs(bend) < 1e-12 or abs(slope / bend) < 1e-6:
            break
        k = min(5.0, max(0.1, k - min(0.5, max(-0.5, slope / bend))))
    time = float(passage_time(np.array([k]))[0]) / kappa
    return k, (2 * k * sigma_eq - cost) / time, time


def with_threshold(fits: DataFrame, cost: float = 0.0005, per_year: int = 252) -> DataFrame:
    """Fits with k, rate and cycle (in days), by a grid and a few Newton steps, in Arrow batches; nulls where no k pays."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for kappa, sigma in batches:
            rows = [(best_threshold(x, s, cost) if x > 0 and s > 0 else None) or (None,) * 3 for x, s in zip(kappa, sigma)]
            yield pd.DataFrame([(k, r, None if c is None else c * per_year) for k, r, c in rows], columns=["k", "rate", "cycle"], dtype=float)

    return fits.withColumn("__t", F.pandas_udf(run, "k double, rate double, cycle double")("kappa", "sigma_eq")).select(*fits.columns, "__t.*")


def contributions(closes: DataFrame, baskets: DataFrame, least: int = 10) -> DataFrame:
    """(sector, target, symbol, weight, contribution): each leg's share of the spread's variance, by its covariance with it."""
    spread = basket_spread(closes, baskets)
    size = baskets.groupBy("target").agg(F.count("*").alias("size"))
    legs = baskets.select("target", F.col("peer").alias("symbol")).join(size, "target").select("target", "symbol", (-1.0 / F.col("size")).alias("weight"))
    legs = legs.unionByName(size.select("target", F.col("target").alias("symbol"), F.lit(1.0).alias("weight")))
    rows = spread.join(legs, "target").join(closes.select("symbol", "day", F.log("close").alias("p")), ["symbol", "day"])
    g = rows.groupBy("sector", "target", "symbol", "weight").agg(F.covar_samp("p", "spread").alias("c"), F.var_samp("spread").alias("v"), F.count("*").alias("n"))
    return g.where(F.col("n") >= least).select("sector", "target", "symbol", "weight", (F.col("weight") * F.col("c") / F.col("v")).alias("contribution"))


def max_hold_days(life: Column, cap: int = 30, factor: float = 2.5) -> Column:
    return F.when(life.isNull() | F.isnan(life) | (life <= 0), cap).otherwise(F.least(F.ceil(factor * life), F.lit(cap))).cast("int")


def kappa_of(life: Column) -> Column:
    return F.when(life > 0, math.log(2) / life)


def look_back(life: Column) -> Column:
    return F.when(life > 0, F.greatest(F.lit(20), F.least(F.lit(60), 2 * F.ceil(life)))).otherwise(0).cast("int")


def priority(z: Column, kappa: Column, sigma: Column) -> Column:
    return F.when((kappa > 0) & (sigma > 0) & ~F.isnan(z), F.abs(z) * F.sqrt(kappa) / sigma).otherwise(0.0)


def expected_return(z: Column, sigma: Column, kappa: Column, days: float) -> Column:
    return F.when((kappa > 0) & (sigma > 0), F.abs(z) * sigma * kappa / (1 + kappa * days)).otherwise(0.0)


def remaining_per_day(z_entry: Column, sigma: Column, gained: Column, hold: Column, held: Column) -> Column:
    return (F.abs(z_entry) * sigma - gained) / F.greatest(hold - held, F.lit(1))


#: Weights of cointegration, half-life, stability and fit in a pair's score.
SCORE_WEIGHTS = (0.35, 0.25, 0.25, 0.15)


def score(p: Column, life: Column, cv: Column, r2: Column, broken: Column) -> Column:
    """A weighted sum of four parts in [0, 1]; what is missing scores 0.

    Cointegration falls in a line from 1 at p = 0.01 to 0 at 0.10; a half-life of 2 to 15 days is best, under 1 or over 40
    it counts nothing; the slope's stability falls from 1 at a variation of 0.05 to 0 at 0.20, and is 0 at a break; the
    fit is r2.
    """
    unit = lambda x: F.when(x.isNull() | F.isnan(x.cast("double")), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
    coint = unit(1 - (p - 0.01) / 0.09)
    speed = F.when((life >= 1) & (life < 2), life - 1).when((life >= 2) & (life <= 15), 1.0).when((life > 15) & (life <= 40), 1 - (life - 15) / 25).otherwise(0.0)
    stable = F.when(broken, 0.0).otherwise(unit(1 - (cv - 0.05) / 0.15))
    parts = zip(SCORE_WEIGHTS, (coint, speed, stable, unit(r2)))
    return sum((w * x for w, x in parts), F.lit(0.0))


#: What a pair has to show by profile: days of history, days looked at, fit, p-value, half-life in days, whether
#: a broken slope rejects, crossings a year, whether a fund and its component may be a pair, longest hold in days.
PROFILES = {
    "stocks": (90, 150, 0.30, 0.05, 1.0, 40.0, True, 12.0, False, 10),
    "metals": (90, 150, 0.20, 0.20, 1.0, 60.0, False, 8.0, False, 5),
    "force": (20, 252, 0.0, 1.0, 0.0, 9999.0, False, 0.0, True, 10),
}
PROFILE_COLUMNS = "profile string, history int, window int, min_r2 double, max_p double, min_life double, max_life double, break_gate boolean, min_crossings double, funds boolean, hold_cap int"
UNSTABLE = 0.35  # variation of the rolling slope that is told, but rejects nothing
ROLLING = 30


def _slope(vx, vy, c):
    with np.errstate(all="ignore"):
        return np.where(np.abs(c) >= 1e-15, (vy - vx + np.sqrt((vy - vx) ** 2 + 4 * c * c)) / (2 * c), np.nan)


def pair_statistics(x: np.ndarray, y: np.ndarray) -> tuple:
    """Statistics of y on x, logs of prices in order: beta, alpha, r2; unit-root statistic, p-value and lags; half-life; crossings a
    year; variation and largest mean shift of the rolling slope; mean, sample deviation and z of the spread y - beta x."""
    out = dict.fromkeys(("beta", "alpha", "r2", "adf_stat", "adf_p", "adf_lags", "half_life", "crossings", "beta_cv", "shift", "mean", "std", "z"))
    n = len(x)
    beta = float(_slope(x.var(), y.var(), ((x - x.mean()) * (y - y.mean())).mean())) if n >= 3 else math.nan
    if math.isnan(beta):
        return tuple(out.values())
    alpha, spread = y.mean() - beta * x.mean(), y - beta * x
    rest, total = ((y - alpha - beta * x) ** 2).sum(), ((y - y.mean()) ** 2).sum()
    out.update(beta=beta, alpha=alpha, r2=1 - rest / total if total > 0 else None, mean=spread.mean(), std=spread.std(ddof=1))
    out["z"] = (spread[-1] - out["mean"]) / out["std"] if out["std"] > 1e-12 else None
    stat, lags = adf_statistic(spread)
    if not math.isnan(stat):
        out.update(adf_stat=stat, adf_lags=lags, adf_p=_p(stat, PAIR_CRITICAL))
    if n >= LEAST_ADF:
        before, now = spread[:-1], spread[1:]
        sxx = ((before - before.mean()) ** 2).sum()
        phi = ((before - before.mean()) * (now - now.mean())).sum() / sxx if sxx > 0 else 0.0
        out["half_life"] = -math.log(2) / math.log(phi) if 0 < phi < 1 else None
    if n > LEAST_ADF:
        side = spread >= spread.mean()
        out["crossings"] = float((side[1:] != side[:-1]).sum() * 252 / n)
    if n >= ROLLING + 10:
        wx, wy = (np.lib.stride_tricks.sliding_window_view(v, ROLLING) for v in (x, y))
        slopes = _slope(wx.var(1), wy.var(1), ((wx - wx.mean(1, keepdims=True)) * (wy - wy.mean(1, keepdims=True))).mean(1))
        slopes = slopes[~np.isnan(slopes)]
        if len(slopes) > 1:
            m, mid = len(slopes), slopes.mean()
            out["beta_cv"] = float(slopes.std(ddof=1) / abs(mid)) if abs(mid) > 1e-10 else math.inf
            k = np.arange(int(m * 0.2) + 1, int(m * 0.8) + 1)
            run = np.cumsum(slopes)[k - 1]
            out["shift"] = float(np.abs((run / k - (slopes.sum() - run) / (m - k)) / abs(mid)).max()) if m >= 20 and abs(mid) >= 1e-15 else 0.0
    return tuple(out.values())


def _p(stat: float, critical: tuple) -> float:
    if stat <= critical[0]:
        return LEVELS[0] / 2
    for c0, c1, p0, p1 in zip(critical, critical[1:], LEVELS, LEVELS[1:]):
        if stat <= c1:
            return p0 + (stat - c0) / (c1 - c0) * (p1 - p0)
    return min(1.0, LEVELS[-1] + (stat - critical[-1]) / -critical[-1] * (1 - LEVELS[-1]))


PAIR_STATISTICS = "beta double, alpha double, r2 double, adf_stat double, adf_p double, adf_lags int, half_life double, crossings double, beta_cv double, shift double, mean double, std double, z double"


def validate_pairs(closes: DataFrame, pairs: DataFrame, profiles: dict[str, tuple] | None = None, components: DataFrame | None = None) -> DataFrame:
    """Every candidate pair under every profile: statistics over its last closes, the reasons against it, score and verdict.

    A fund with one of its components (fund, component), too short a history of a leg, or a price that is not above zero
    among those looked at, end it there, without statistics. A slope that varies much is told and rejects nothing. Legs are
    counted from their own ends. All statistics of a pair come from one grouping: a bounded array of both legs' prices.
    """
    spark = closes.sparkSession
    rules = spark.createDataFrame([(k, *v) for k, v in (profiles or {"stocks": PROFILES["stocks"]}).items()], PROFILE_COLUMNS)
    by, longest = ["profile", "leg_a", "leg_b"], max(v[1] for v in (profiles or PROFILES).values())
    rank = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("day")))
    last = closes.withColumns({"rn": rank, "days": F.count("*").over(W.partitionBy("symbol"))}).where(F.col("rn") <= longest)
    arrays = last.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct(-F.col("rn"), "close"))).alias("s"), F.max("days").alias("days"))
    arrays = arrays.select("symbol", F.transform("s", lambda v: v["close"].cast("double")).alias("prices"), "days")
    rows = pairs.select("leg_a", "leg_b").distinct().join(F.broadcast(rules), F.lit(True))
    for leg in "ab":
        rows = rows.join(arrays.select(F.col("symbol").alias(f"leg_{leg}"), F.col("prices").alias(leg), F.col("days").alias(f"days_{leg}")), f"leg_{leg}", "left")
    if components is not None:
        both = components.select(F.col("fund").alias("leg_a"), F.col("component").alias("leg_b")).unionByName(components.select(F.col("component").alias("leg_a"), F.col("fund").alias("leg_b"))).distinct()
        rows = rows.join(both.withColumn("related", F.lit(True)), ["leg_a", "leg_b"], "left")
    else:
        rows = rows.withColumn("related", F.lit(None).cast("boolean"))
    n = F.least(F.size("a"), F.size("b"), F.col("window"))
    rows = rows.withColumn("n", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), n))
    rows = rows.withColumns({leg: F.when(F.col("n") > 0, F.slice(leg, -F.col("n"), F.col("n"))) for leg in "ab"})
    fund = F.coalesce("related", F.lit(False)) & ~F.col("funds")
    short = F.least(F.coalesce("days_a", F.lit(0)), F.coalesce("days_b", F.lit(0))) < F.col("history")
    bad = F.exists(F.concat("a", "b"), lambda v: v.isNull() | F.isnan(v) | (v <= 0) | (v == float("inf")))
    rows = rows.withColumn("barred", F.when(fund, "fund_component").when(short, "short_history").when(F.coalesce(bad, F.lit(True)), "bad_price"))
    logs = lambda leg: F.when(F.col("barred").isNull(), F.transform(leg, lambda v: F.log(v)))

    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        names = [c.split()[0] for c in PAIR_STATISTICS.split(", ")]
        return pd.DataFrame([pair_statistics(np.asarray(p, float), np.asarray(q, float)) if p is not None else (None,) * len(names) for p, q in zip(x, y)], columns=names)

    out = rows.withColumn("s", F.pandas_udf(run, PAIR_STATISTICS)(logs("b"), logs("a"))).select(*by, "n", "barred", "s.*", "min_r2", "max_p", "min_life", "max_life", "break_gate", "min_crossings", "hold_cap")
    found, known = F.col("barred").isNull() & F.col("beta").isNotNull(), lambda c: F.coalesce(c, F.lit(False))
    broken = F.coalesce(F.col("shift") > break_threshold(ROLLING), F.lit(False))
    fails = {
        "low_r2": ~known(F.col("r2") >= F.col("min_r2")), "not_cointegrated": ~known(F.col("adf_p") < F.col("max_p")), "half_life": ~known(F.col("half_life").between(F.col("min_life"), F.col("max_life"))),
        "few_crossings": ~known(F.col("crossings") >= F.col("min_crossings")), "structural_break": broken, "unstable_slope": known(F.col("beta_cv") >= UNSTABLE),
    }
    told = F.array_compact(F.array(*(F.when(c, name) for name, c in fails.items())))
    reasons = F.when(F.col("barred").isNotNull(), F.array("barred")).when(~found, F.array(F.lit("no_fit"))).otherwise(told)
    gates = [c for name, c in fails.items() if name not in ("structural_break", "unstable_slope")] + [broken & F.col("break_gate")]
    failed = gates[0]
    for c in gates[1:]:
        failed = failed | c
    value = score(F.coalesce("adf_p", F.lit(1.0)), F.coalesce("half_life", F.lit(0.0)), F.coalesce("beta_cv", F.lit(1.0)), F.coalesce("r2", F.lit(0.0)), broken)
    out = out.withColumns({"broken": broken, "reasons": reasons, "passed": found & ~failed, "score": F.when(found, value)})
    return out.withColumn("max_hold", F.when(F.col("passed"), max_hold_days_capped(F.col("half_life"), F.col("hold_cap")))).drop("barred", "min_r2", "max_p", "min_life", "max_life", "break_gate", "min_crossings", "hold_cap")


def max_hold_days_capped(life: Column, cap: Column, factor: float = 2.5) -> Column:
    return F.least(F.ceil(factor * life), cap).cast("int")


def fits_as_of(closes: DataFrame, baskets: DataFrame, dates: DataFrame, window: int = 60, days: int = 180, max_p: float | None = 0.05, max_share: float | None = 0.60, least_centrality: float | None = 0.0, cost: float = 0.0005, clip: tuple[float, float] = (0.15, 2.5), per_year: int = 252) -> DataFrame:
    """Every basket's fit as of every date (as_of): from the last ``window`` days strictly before it and no older than ``days``.

    Dates are rows: a basket's days are numbered once, each (basket, date) finds its last day by one pass in order, and its
    numbers join the days, so that the plan is the same for one date and for hundreds. Gates in order: too little history, a
    unit root, one leg's share of the spread's variance, the target's share of it, no reversion, no threshold that pays; a
    gate given as None is off. k outside ``clip`` is cut to it, which is recorded and fails nothing.
    """
    by, each = ["sector", "target"], ["sector", "target", "as_of"]
    own = W.partitionBy(*by).orderBy("day")
    spread = basket_spread(closes, baskets).withColumns({"i": F.row_number().over(own), "before": F.lag("spread").over(own)})
    every = baskets.select(*by).distinct().join(dates.select(F.col("as_of").cast("date").alias("as_of")).distinct(), F.lit(True))
    # the number of a basket's days before each date, and before the oldest that counts: days come after the dates of the same day
    edges = every.select(*by, F.explode(F.array(F.struct("as_of", F.col("as_of").alias("day"), F.lit(True).alias("last")), F.struct("as_of", F.date_sub("as_of", days).alias("day"), F.lit(False).alias("last")))).alias("e")).select(*by, "e.*", F.lit(None).cast("int").alias("i"))
    marks = edges.unionByName(spread.select(*by, F.lit(None).cast("date").alias("as_of"), "day", F.lit(None).cast("boolean").alias("last"), "i"))
    marks = marks.withColumn("known", F.coalesce(F.max("i").over(W.partitionBy(*by).orderBy("day", F.col("as_of").isNull()).rowsBetween(W.unboundedPreceding, 0)), F.lit(0))).where("as_of is not null")
    ends = marks.groupBy(*each).agg(F.max(F.when(F.col("last"), F.col("known"))).alias("high"), F.max(F.when(~F.col("last"), F.col("known"))).alias("low"))
    ends = ends.select(*each, "high", (F.col("high") - F.col("low")).alias("n"))
    used = ends.where(F.col("n") >= window).select(*each, F.explode(F.sequence(F.col("high") - window + 1, F.col("high"))).alias("i"), (F.col("high") - window + 1).alias("first"))
    rows = used.join(spread, [*by, "i"]).withColumn("before", F.when(F.col("i") > F.col("first"), F.col("before")))
    pair = F.col("before").isNotNull()
    g = rows.groupBy(*each).agg(
        F.count_if(pair).alias("pairs"), F.regr_slope("spread", "before").alias("b"), F.regr_intercept("spread", "before").alias("a"), F.regr_syy("spread", "before").alias("syy"), F.regr_sxy("spread", "before").alias("sxy"),
        F.sort_array(F.collect_list(F.struct("i", "spread"))).alias("series"),
    )
    g = with_threshold(_ou_columns(g, each + ["series"], per_year), cost, per_year)
    solve = F.pandas_udf(lambda batch: pd.DataFrame([adf_statistic(np.asarray(x, float)) for x in batch], columns=["stat", "lags"]), "stat double, lags int")
    g = g.withColumn("t", solve(F.transform("series", lambda x: x["spread"]))).withColumn("adf_stat", F.nanvl("t.stat", F.lit(None))).withColumn("adf_p", p_value(F.col("adf_stat"), PLAIN_CRITICAL)).drop("t", "series")
    g = g.withColumn("adf_p", F.when(F.col("adf_stat").isNotNull(), F.col("adf_p")))
    size = baskets.groupBy(*by).agg(F.collect_list("peer").alias("peers"))
    weights = size.select(*by, F.explode(F.concat(F.array(F.struct(F.col("target").alias("symbol"), F.lit(1.0).alias("w"))), F.transform("peers", lambda p: F.struct(p.alias("symbol"), (-1.0 / F.size("peers")).alias("w"))))).alias("leg")).select(*by, "leg.*")
    shares = rows.select(*each, "day", "spread").join(weights, by).join(closes.select("symbol", "day", F.log("close").alias("p")), ["symbol", "day"]).groupBy(*each, "symbol").agg((F.first("w") * F.covar_samp("p", "spread") / F.var_samp("spread")).alias("share"))
    shares = shares.groupBy(*each).agg(F.max(F.abs("share")).alias("dominance"), F.max(F.when(F.col("symbol") == F.col("target"), F.abs("share"))).alias("centrality"))
    out = ends.select(*each, "n").join(g, each, "left").join(shares, each, "left")
    reason = F.when(F.col("n") < window, "short_history")
    if max_p is not None:
        reason = reason.when(~F.coalesce(F.col("adf_p") <= max_p, F.lit(False)), "not_stationary")
    if max_share is not None:
        reason = reason.when(~F.coalesce(F.col("dominance") <= max_share, F.lit(False)), "dominated")
    if least_centrality is not None:
        reason = reason.when(~F.coalesce(F.col("centrality") >= least_centrality, F.lit(False)), "target_not_central")
    reason = reason.when(F.col("kappa").isNull(), "no_reversion").when(F.col("k").isNull(), "no_threshold")
    cut = F.greatest(F.lit(clip[0]), F.least(F.lit(clip[1]), F.col("k")))
    return out.withColumns({"reason": reason, "clipped": F.col("k") != cut, "k": F.when(F.col("k").isNotNull(), cut)}).withColumn("passed", F.col("reason").isNull())


def validate_baskets(closes: DataFrame, baskets: DataFrame, **limits) -> DataFrame:
    """``fits_as_of`` the day after the last close, over all days."""
    dates = closes.agg(F.date_add(F.max("day"), 1).alias("as_of"))
    return fits_as_of(closes, baskets, dates, **({"days": 100_000} | limits)).drop("as_of")
