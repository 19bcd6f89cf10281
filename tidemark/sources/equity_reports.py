"""Equity reports as text: a header of statistics, then a row a day; one folder for each run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_path

ROW = "run_id string, day date, equity double, pnl double"


def write_equity_report(curve: DataFrame, stats: DataFrame, name: str = "equity-report") -> str:
    """The path of reports of curves (run_id, day, pnl, equity) and their statistics (run_id, numbers): ``# key=value`` lines,
    column names, then day, equity and pnl between tabs. A run's lines are one file in order."""
    numbers = [f.name for f in stats.schema.fields if f.name != "run_id"]
    head = F.explode(F.array(*(F.struct(F.lit(i).alias("at"), F.concat(F.lit(f"# {c}="), F.when(F.col(c).isNull(), "").otherwise(F.format_string("%.6f", F.col(c).cast("double")))).alias("value")) for i, c in enumerate(numbers)))).alias("l")
    lines = stats.select("run_id", F.lit("").alias("day"), head).select("run_id", "day", "l.at", "l.value")
    names = stats.select("run_id", F.lit("").alias("day"), F.lit(len(numbers)).alias("at"), F.lit("date\tequity\tdaily_pnl").alias("value"))
    rows = curve.select("run_id", F.col("day").cast("string").alias("day"), F.lit(0).alias("at"), F.format_string("%s\t%.4f\t%.4f", F.col("day").cast("string"), F.col("equity"), F.col("pnl")).alias("value"))
    path = shared_path(curve.sparkSession, name)
    lines.unionByName(names).unionByName(rows).repartition("run_id").sortWithinPartitions("run_id", "day", "at").select("run_id", "value").write.partitionBy("run_id").text(path)
    return path


def read_equity_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows (run_id, day, equity, pnl) and statistics (run_id, key, value) of reports; lines of another form are left out."""
    lines = spark.read.text(path)
    parts = F.split("value", "\t")
    rows = lines.where(F.col("value").rlike(r"^\d{4}-\d{2}-\d{2}\t[^\t]+\t[^\t]+$")).select("run_id", parts[0].cast("date").alias("day"), parts[1].cast("double").alias("equity"), parts[2].cast("double").alias("pnl"))
    key, value = (F.regexp_extract("value", r"^# (\w+)=(.*)$", i) for i in (1, 2))
    return rows, lines.where(F.col("value").rlike(r"^# \w+=")).select("run_id", key.alias("key"), value.try_cast("double").alias("value"))
