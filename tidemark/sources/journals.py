"""Append-only journals: fills, runs and closed trades; and files of pairs with the time they were made at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAIRS = "generated_at timestamp, pairs array<struct<leg_a:string, leg_b:string, beta:double, score:double>>"


def append(rows: DataFrame, path: str, *partition_by: str) -> None:
    """Add rows to a table of files; nothing that is there is read or written again."""
    writer = rows.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def session_rows(closes: DataFrame, positions: DataFrame, run_id: str) -> DataFrame:
    """(run_id, day, closes, active): of each session the closes by symbol as a map, and the symbols held as a sorted array.

    Symbols of a session are a bounded set; one session is one row."""
    day = closes.groupBy("day").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("symbol", "close")))).alias("closes"))
    held = positions.where("position <> 0").groupBy("day").agg(F.sort_array(F.collect_set("symbol")).alias("active"))
    out = day.join(held, "day", "left")
    return out.select(F.lit(run_id).alias("run_id"), "day", "closes", F.coalesce("active", F.array().cast("array<string>")).alias("active"))


def write_pairs(pairs: DataFrame, path: str) -> None:
    """One JSON document for each leg_a: {generated_at, pairs: [...]}, from rows (leg_a, leg_b, beta, score, generated_at)."""
    body = F.sort_array(F.collect_list(F.struct("leg_a", "leg_b", "beta", "score")))
    document = pairs.groupBy("leg_a").agg(F.max("generated_at").alias("generated_at"), body.alias("pairs"))
    document.select(F.col("leg_a").alias("file"), F.to_json(F.struct("generated_at", "pairs")).alias("value")).write.partitionBy("file").text(path)


def read_pairs(spark: SparkSession, path: str, now: Column, hours: int = 48) -> DataFrame:
    """The pairs of the documents that are not older than so many hours; a document without a time counts as old."""
    documents = spark.read.schema(PAIRS).json(path, multiLine=True)
    young = documents.where(F.col("generated_at") >= now - F.make_dt_interval(hours=F.lit(hours)))
    return young.select("generated_at", F.explode("pairs").alias("p")).select("generated_at", "p.*")
