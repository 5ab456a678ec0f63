"""Research-note sink (A4) and source (A5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import rules
from riskloom.functions import cells


def write_notes(notes: DataFrame, path: str, run_id: str) -> None:
    """A4: the notes of one run (vendor_key, file_name, write_seq, noted_at, note_date, text), by note date.

    A run that is written again replaces its own notes. A date's notes spread over files by vendor, as one
    run writes one date."""
    notes.repartition("note_date", "vendor_key").write.mode("overwrite").partitionBy("note_date").parquet(f"{path}/run_id={run_id}")


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """The stored notes, one per (vendor_key, file_name): the last write wins, of runs as late the greater run id."""
    df = spark.read.parquet(path)
    df = df.withColumn("run_id", F.col("run_id").cast("string"))
    order = F.col("write_seq") if "write_seq" in df.columns else F.col("noted_at")
    last = df.groupBy("vendor_key", "file_name").agg(F.max(F.struct(order.alias("_o"), "run_id")).alias("_l")).select("vendor_key", "file_name", "_l.*")
    return df.withColumn("_o", order).join(last, ["vendor_key", "file_name", "_o", "run_id"], "left_semi").drop("_o", "run_id")


def read_note_files(spark: SparkSession, base_dir: str) -> DataFrame:
    """A5: ``<base>/<vendor key>/research_*.md`` files, whole file per row.

    ``wholetext`` is passed as a keyword: as an ``.option`` the default would win.
    """
    df = spark.read.text(base_dir, wholetext=True, recursiveFileLookup=True,
                         pathGlobFilter=f"{rules.NOTE_NAME_PREFIX}*{rules.NOTE_NAME_SUFFIX}")
    parts = F.split(F.col("_metadata.file_path"), "/")
    file_name = F.url_decode(F.element_at(parts, -1))
    return df.select(
        F.url_decode(F.element_at(parts, -2)).alias("vendor_key"),
        file_name.alias("file_name"),
        cells.note_time(file_name).alias("noted_at"),
        F.col("value").alias("text"),
    )
