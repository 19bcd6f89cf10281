"""Bar files: JSON lines with a count in their header, partitioned tables, audit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_path, written

BAR = "symbol string, t long, close double, volume double"


def write_json_lines(bars: DataFrame, spoil: str | None = None) -> str:
    """One text row a symbol: a header ``#bars:N`` and N JSON lines; a spoilt symbol's header counts one too many."""
    path = shared_path(bars.sparkSession, "bars-json")
    line = F.to_json(F.struct("symbol", "t", "close", "volume"))
    rows = bars.groupBy("symbol").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(line)).alias("lines"))
    n = F.col("n") + F.when(F.col("symbol") == (spoil or ""), 1).otherwise(0)
    rows.select("symbol", F.array_join(F.concat(F.array(F.concat(F.lit("#bars:"), n.cast("string"))), "lines"), "\n").alias("value")).write.partitionBy("symbol").text(path)
    return path


def read_json_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(bars, rejected files): a file counts whole or not at all; its header must agree and every line must parse."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    parsed = raw.withColumn("bar", F.from_json("value", BAR))
    head = F.regexp_extract("value", r"^#bars:(\d+)$", 1)
    lines = parsed.withColumn("want", F.when(head != "", head.cast("long")))
    ok = F.col("bar.symbol").isNotNull() & F.col("bar.t").isNotNull()
    files = lines.groupBy("file").agg(F.max("want").alias("want"), F.count_if(F.col("want").isNull() & ok).alias("good"), F.count_if(F.col("want").isNull() & ~ok).alias("bad"))
    sound = (F.col("want") == F.col("good")) & (F.col("bad") == 0)
    bad = files.where(~F.coalesce(sound, F.lit(False)))
    return lines.where(F.col("want").isNull()).join(bad, "file", "left_anti").select("bar.*"), bad


def audit_tables(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bars and decisions as two tables that share ``bar_id``, a hash of symbol and time."""
    rows = decisions.withColumn("bar_id", F.xxhash64("symbol", "ts"))
    bars = written(rows.select("bar_id", "symbol", "ts", "close"), "audit-bars")
    return bars, written(rows.select("bar_id", *(c for c in decisions.columns if c not in ("symbol", "ts", "close"))), "audit-decisions")
