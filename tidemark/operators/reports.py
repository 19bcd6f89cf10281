"""Trade, equity and drawdown reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def trade_statistics(trades: DataFrame, *by: str) -> DataFrame:
    """Wins, average win and loss, profit factor, expectancy and Sharpe per trade, from pnl."""
    win, loss = F.when(F.col("pnl") > 0, F.col("pnl")), F.when(F.col("pnl") <= 0, F.col("pnl"))
    out = trades.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(F.col("pnl") > 0).alias("wins"), F.sum("pnl").alias("total"), F.avg(win).alias("avg_win"), F.avg(loss).alias("avg_loss"),
        F.sum(win).alias("gain"), F.sum(loss).alias("pain"), F.avg("pnl").alias("expectancy"), F.stddev_samp("pnl").alias("std"),
    )
    factor = F.when(F.coalesce("pain", F.lit(0.0)) == 0, F.lit(float("inf"))).otherwise(F.coalesce("gain", F.lit(0.0)) / -F.col("pain"))
    return out.withColumns({"win_rate": F.col("wins") / F.col("n"), "profit_factor": factor, "sharpe": F.when(F.col("std") > 0, F.col("expectancy") / F.col("std"))}).drop("gain", "pain", "std")


def equity_stats(equity: DataFrame, by: list[str], per_year: int = 252) -> DataFrame:
    """Total return, mean and deviation of returns, Sharpe, a year's return and the largest drawdown; nulls under two points."""
    w = W.partitionBy(*by).orderBy("day")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    rows = equity.withColumns({"ret": F.col("equity") / F.lag("equity").over(w) - 1, "peak": F.max("equity").over(run)}).withColumn("dd", (F.col("peak") - F.col("equity")) / F.col("peak"))
    g = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min_by("equity", "day").alias("first"), F.max_by("equity", "day").alias("last"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("std"), F.max("dd").alias("max_drawdown"))
    return g.select(*by, "n", F.when(F.col("n") > 1, F.col("last") / F.col("first") - 1).alias("total"), "mean", "std", F.when(F.col("std") > 0, F.col("mean") / F.col("std") * math.sqrt(per_year)).alias("sharpe"), (F.col("mean") * per_year).alias("annual"), "max_drawdown")


def drawdowns(equity: DataFrame, by: list[str]) -> DataFrame:
    peak = F.max("equity").over(W.partitionBy(*by).orderBy("day").rowsBetween(W.unboundedPreceding, 0))
    return equity.withColumn("peak", peak).withColumn("drawdown", (F.col("peak") - F.col("equity")) / F.col("peak"))


def phi(x: Column) -> Column:
    """The normal distribution function, by a rational bound of error under 1e-7."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def phi_inverse(p: float) -> float:
    low, high = -10.0, 10.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (low, mid)
    return mid


def probabilistic_sharpe(trades: DataFrame, by: list[str], benchmark: float = 0.0) -> DataFrame:
    """Chance that the true Sharpe is above a benchmark, given skew and kurtosis (moments over n, deviation over n - 1)."""
    m = trades.groupBy(*by).agg(F.count("*").alias("n"), F.avg("pnl").alias("mean"), F.stddev_samp("pnl").alias("std"), F.avg("pnl").alias("m1"), F.avg(F.col("pnl") ** 2).alias("m2"), F.avg(F.col("pnl") ** 3).alias("m3"), F.avg(F.col("pnl") ** 4).alias("m4"))
    a = F.col("m1")
    third = F.col("m3") - 3 * a * F.col("m2") + 2 * a**3
    fourth = F.col("m4") - 4 * a * F.col("m3") + 6 * a**2 * F.col("m2") - 3 * a**4
    m = m.withColumns({"sharpe": F.col("mean") / F.col("std"), "skew": third / F.col("std") ** 3, "kurtosis": fourth / F.col("std") ** 4})
    z = (F.col("sharpe") - benchmark) * F.sqrt(F.col("n") - 1) / F.sqrt(1 - F.col("skew") * F.col("sharpe") + (F.col("kurtosis") - 1) / 4 * F.col("sharpe") ** 2)
    return m.select(*by, "n", "sharpe", "skew", "kurtosis", phi(z).alias("psr"))


def expected_best_sharpe(n: int) -> float:
    """The largest of n independent Sharpe ratios without skill, expected, in their standard deviations; 0 for one."""
    e = 0.5772156649
    return 0.0 if n <= 1 else (1 - e) * phi_inverse(min(1 - 1 / n, 0.9999999)) + e * phi_inverse(min(1 - 1 / (n * math.e), 0.9999999))


def capital_metrics(trades: DataFrame, by: list[str], total: float, days: int) -> DataFrame:
    """Profit a dollar-day employed, use of the capital over so many days, their product, and means of the trades' returns.

    A trade deploys twice its capital_per_leg for its hold_days; trades without a finite profit, or without capital or
    days above 0, don't count."""
    finite = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")) for c in ("pnl", "capital_per_leg", "hold_days")]
    good = trades.where(finite[0] & finite[1] & finite[2] & (F.col("capital_per_leg") > 0) & (F.col("hold_days") > 0))
    deployed = 2 * F.col("capital_per_leg")
    g = good.groupBy(*by).agg(F.sum("pnl").alias("pnl"), F.sum(deployed * F.col("hold_days")).alias("dollar_days"), F.avg(F.col("pnl") / deployed).alias("per_trade"), F.avg(F.col("pnl") / (deployed * F.col("hold_days"))).alias("per_dollar_day"))
    roec, use = F.col("pnl") / F.col("dollar_days"), F.least(F.lit(1.0), F.col("dollar_days") / (total * days))
    return g.select(*by, roec.alias("roec"), use.alias("utilisation"), (roec * use).alias("rocc"), "per_trade", "per_dollar_day")


def kelly(trades: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Running posterior win rate from two wins and two losses, payoff ratio, and the Kelly fraction times a factor for its
    uncertainty: one less four posterior deviations, a fifth at least. A side without trades counts 1; no edge, no stake."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    win, loss = F.when(F.col("pnl") > 0, F.col("pnl")), F.when(F.col("pnl") <= 0, -F.col("pnl"))
    mean = lambda x: F.coalesce(F.avg(x).over(w), F.lit(1.0))
    rows = trades.withColumns({"a": 2 + F.count(win).over(w), "b": 2 + F.count(loss).over(w), "payoff": mean(win) / F.greatest(mean(loss), F.lit(1e-10))})
    p = F.col("a") / (F.col("a") + F.col("b"))
    sd = F.sqrt(p * (1 - p) / (F.col("a") + F.col("b") + 1))
    f = p - (1 - p) / F.col("payoff")
    return rows.withColumns({"win_rate": p, "fraction": F.when(f <= 0, 0.0).otherwise(F.least(F.lit(1.0), f * F.greatest(F.lit(0.2), 1 - 4 * sd)))})


def guardrail(variants: DataFrame, by: str, name: str, current: str) -> DataFrame:
    """(by, return_gap, drawdown_gap): the current variant's return and drawdown less those of the others' best by return."""
    own, other = F.col(name) == current, F.col(name) != current
    pick = lambda c: F.max(F.when(own, F.col(c)))
    g = variants.groupBy(by).agg((pick("ret") - F.max(F.when(other, F.col("ret")))).alias("return_gap"), (pick("drawdown") - F.max_by("drawdown", F.when(other, F.col("ret")))).alias("drawdown_gap"))
    return g
