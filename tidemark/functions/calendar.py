"""Session calendar as column expressions. Times are UTC timestamps; a session is (zone, open minute, close minute)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION = ("America/New_York", 9 * 60 + 30, 16 * 60)
#: Exchange holidays.
HOLIDAYS = ("2024-01-01", "2024-01-15", "2024-02-19", "2024-03-29", "2024-05-27", "2024-06-19", "2024-07-04", "2024-09-02", "2024-11-28", "2024-12-25")


def local(ts: Column, zone: str = SESSION[0]) -> Column:
    return F.from_utc_timestamp(ts, zone)


def local_minute(ts: Column, zone: str = SESSION[0]) -> Column:
    at = local(ts, zone)
    return F.hour(at) * 60 + F.minute(at)


def trading_day(ts: Column, zone: str = SESSION[0]) -> Column:
    return F.to_date(local(ts, zone))


def is_session(ts: Column, session=SESSION) -> Column:
    zone, opens, closes = session
    return (local_minute(ts, zone) >= opens) & (local_minute(ts, zone) < closes)


def minutes_from_open(ts: Column, session=SESSION) -> Column:
    return F.when(is_session(ts, session), local_minute(ts, session[0]) - session[1])


def after_close(ts: Column, grace: int = 2, session=SESSION) -> Column:
    return local_minute(ts, session[0]) >= session[2] + grace


def at_close_decision(ts: Column, before: int = 15, session=SESSION) -> Column:
    minute = local_minute(ts, session[0])
    return (minute >= session[2] - before) & (minute < session[2])


def session_open(day: Column, session=SESSION) -> Column:
    return F.to_utc_timestamp(F.timestamp_add("MINUTE", F.lit(session[1]), day.cast("timestamp")), session[0])


def session_close(day: Column, session=SESSION) -> Column:
    return F.to_utc_timestamp(F.timestamp_add("MINUTE", F.lit(session[2]), day.cast("timestamp")), session[0])


def trading_days(spark: SparkSession, first: str, last: str, holidays=HOLIDAYS) -> DataFrame:
    """(day): weekdays that are no holiday."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)), F.expr("interval 1 day"))).alias("day"))
    return days.where((F.weekday("day") < 5) & ~F.col("day").cast("string").isin(*holidays))


def with_previous_trading_day(days: DataFrame, trading: DataFrame, look_back: int = 10) -> DataFrame:
    """(day, previous): the last trading day before each day, none further back than ``look_back`` days."""
    back = days.select("day", F.explode(F.sequence(F.lit(1), F.lit(look_back))).alias("k")).withColumn("previous", F.date_sub("day", F.col("k")))
    found = back.join(trading.select(F.col("day").alias("previous")), "previous").groupBy("day").agg(F.max("previous").alias("previous"))
    return days.join(found, "day", "left")
