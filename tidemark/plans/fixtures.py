"""Market-shaped views over the given tables, for Spark and, as SQL text, for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ticks(spark, sf) -> DataFrame:
    """Raw arrivals (event_id, symbol, ts, user_id, value)."""
    return table(spark, sf, "events").select("event_id", F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")


def bars(spark, sf) -> DataFrame:
    """Hourly OHLCV bars per symbol."""
    hourly = ticks(spark, sf).withColumn("hour", F.date_trunc("hour", "ts"))
    return hourly.groupBy("symbol", F.col("hour").alias("ts")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"),
        F.count("*").cast("double").alias("volume"), F.count("*").alias("trade_count"), F.avg("value").alias("vwap"),
    )


def lines(spark, sf) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    return table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))


def closes(spark, sf, key: str = "p_brand") -> DataFrame:
    """Weekly unit prices (symbol, day, close)."""
    week = F.to_date(F.date_trunc("week", F.col("l_shipdate").cast("timestamp")))
    return lines(spark, sf).groupBy(F.col(key).alias("symbol"), week.alias("day")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"))


def sectors(spark, sf, key: str = "p_brand") -> DataFrame:
    """Five sectors of five symbols."""
    part = table(spark, sf, "part").select(F.col(key).alias("symbol")).distinct()
    if key != "p_brand":
        return part.withColumn("sector", F.lit("S0"))
    return part.withColumn("sector", F.concat(F.lit("S"), ((F.substring("symbol", 7, 9).cast("int") - 1) % 5).cast("string")))


def candidates(spark, sf) -> DataFrame:
    """All pairs of symbols, leg_a < leg_b."""
    s = sectors(spark, sf).select("symbol")
    return s.select(F.col("symbol").alias("leg_a")).join(s.select(F.col("symbol").alias("leg_b")), F.col("leg_a") < F.col("leg_b"))


def baskets(spark, sf, key: str = "p_brand") -> DataFrame:
    """(sector, target, peer): every symbol against the others of its sector."""
    s = sectors(spark, sf, key)
    a, b = s.select("sector", F.col("symbol").alias("target")), s.select("sector", F.col("symbol").alias("peer"))
    return a.join(b, "sector").where("target <> peer")


def trades(spark, sf) -> DataFrame:
    """One trade an order, profit against the mean of its class."""
    o = table(spark, sf, "orders")
    mean = o.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("mean"))
    return o.join(mean, "o_orderpriority").select(
        F.col("o_orderkey").alias("trade_id"), F.col("o_orderpriority").alias("pair_id"), F.to_date("o_orderdate").alias("exit_day"),
        (F.col("o_totalprice") - F.col("mean")).alias("pnl"), F.col("o_totalprice").alias("capital_per_leg"),
        (1 + F.col("o_orderkey") % 10).alias("hold_days"), F.col("o_orderstatus").alias("exit_reason"),
    )


def equity(spark, sf) -> DataFrame:
    """(day, equity): trade profits summed up on a fixed start; one row a day."""
    from pyspark.sql import Window as W

    daily = trades(spark, sf).groupBy(F.col("exit_day").alias("day")).agg(F.sum("pnl").alias("pnl"))
    return daily.select("day", (F.lit(1e9) + F.sum("pnl").over(W.orderBy("day"))).alias("equity"))


def books(spark, sf) -> DataFrame:
    """(symbol, current_shares, target_shares)."""
    side = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).when(F.col("l_returnflag") == "A", -F.col("l_quantity")).otherwise(0)
    even = F.when(F.year("l_shipdate") % 2 == 0, F.col("l_quantity")).otherwise(-F.col("l_quantity"))
    return lines(spark, sf).groupBy(F.col("p_brand").alias("symbol")).agg(F.sum(side).cast("double").alias("current_shares"), F.sum(even).cast("double").alias("target_shares"))


def blackouts(spark, sf) -> DataFrame:
    """(symbol, event_day)."""
    return lines(spark, sf).groupBy(F.col("p_brand").alias("symbol")).agg(F.to_date(F.min("l_shipdate")).alias("event_day"))


CTE = {
    "ticks": "ticks AS (SELECT event_id, event_type AS symbol, ts, user_id, value FROM events)",
    "bars": "bars AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, min_by(value, ts) AS open, max(value) AS high, min(value) AS low, max_by(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume, count(*) AS trade_count, avg(value) AS vwap FROM events GROUP BY 1, 2)",
    "closes": "closes AS (SELECT p_brand AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS day, sum(l_extendedprice) / sum(l_quantity) AS close FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)",
    "sectors": "sectors AS (SELECT DISTINCT p_brand AS symbol, 'S' || CAST((CAST(substr(p_brand, 7) AS INT) - 1) % 5 AS VARCHAR) AS sector FROM part)",
    "pairs": "pairs AS (SELECT a.symbol AS leg_a, b.symbol AS leg_b FROM sectors a JOIN sectors b ON a.symbol < b.symbol)",
    "baskets": "baskets AS (SELECT a.sector, a.symbol AS target, b.symbol AS peer FROM sectors a JOIN sectors b ON a.sector = b.sector AND a.symbol <> b.symbol)",
    "trades": "trades AS (SELECT o_orderkey AS trade_id, o_orderpriority AS pair_id, CAST(o_orderdate AS DATE) AS exit_day, o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS pnl, o_totalprice AS capital_per_leg, 1 + o_orderkey % 10 AS hold_days, o_orderstatus AS exit_reason FROM orders)",
    "equity": "equity AS (SELECT exit_day AS day, 1e9 + sum(sum(pnl)) OVER (ORDER BY exit_day) AS equity FROM trades GROUP BY exit_day)",
    "books": "books AS (SELECT p_brand AS symbol, CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity WHEN l_returnflag = 'A' THEN -l_quantity ELSE 0 END) AS DOUBLE) AS current_shares, CAST(sum(CASE WHEN year(l_shipdate) % 2 = 0 THEN l_quantity ELSE -l_quantity END) AS DOUBLE) AS target_shares FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)",
    "blackouts": "blackouts AS (SELECT p_brand AS symbol, CAST(min(l_shipdate) AS DATE) AS event_day FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)",
}
NEEDS = {"pairs": ["sectors"], "baskets": ["sectors"], "equity": ["trades"]}


def with_views(names: str, body: str) -> str:
    """SQL with the named views before it; one named ``fold`` may refer to itself."""
    order: list[str] = []
    for n in names.split():
        for m in [*NEEDS.get(n, []), n]:
            if m not in order:
                order.append(m)
    return ("WITH RECURSIVE " if any(f"{v} AS (SELECT" in body for v in ("fold", "fired", "eng", "pm")) else "WITH ") + ", ".join(CTE[n] for n in order) + (", " if body.lstrip().startswith("+") else " ") + body.lstrip().removeprefix("+")
