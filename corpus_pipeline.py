"""The corpus pipeline: documents in, packed sequences out, each stage over all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import langid, leaks, lines, near, packing
from tidemark.llm.common import cut

#: (name, function of (spark, docs, sf_dir)). All but the last return the columns of documents.
STAGES = [
    ("language_id", langid.stage),  # operator 8: documents without a sure language go
    ("line_dedup", lines.stage),  # operator 2: repeated lines go, and documents that lose every line
    ("near_dedup", near.stage),  # operator 4: one document of each class stays
    ("decontamination", leaks.stage),  # operator 10: documents that hold a benchmark item go
    ("packing", packing.stage),  # operator 3: pieces with their sequences
]

#: No stage but the last could be SQL, and the last needs a tokenizer: tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
