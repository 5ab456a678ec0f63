"""Decision intake (A8): JSON records from any scorer, one per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.score import parse_decisions


def read_decision_files(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines -> (payload text, file) -> typed decisions; malformed records become NULLs."""
    raw = spark.read.text(path).select(F.col("value").alias("payload"), F.col("_metadata.file_path").alias("source_file"))
    return parse_decisions(raw)
