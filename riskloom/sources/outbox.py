"""Alert outbox (A6): the sink that stands in for mail delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.session import list_children, path_exists


def append_outbox(outbox_rows: DataFrame, path: str, run_id: str) -> bool:
    """Write a run's alert pages under ``run_id=<id>`` (overwrite: a rerun replaces them).

    An empty run appends nothing, as no mail is sent when nothing changed; an empty rerun clears
    the pages that an earlier attempt wrote."""
    target = f"{path}/run_id={run_id}"
    empty = outbox_rows.isEmpty()
    if not empty or path_exists(outbox_rows.sparkSession, target):
        outbox_rows.drop("run_id").write.mode("overwrite").parquet(target)
    return not empty


def read_outbox(spark: SparkSession, path: str) -> DataFrame | None:
    if not any(n.startswith("run_id=") for n in list_children(spark, path)):
        return None
    return spark.read.parquet(path)
