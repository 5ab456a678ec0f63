"""Change-log table (A3) with ids in insertion order.

Rows lie under ``changed_date=<date>/run_id=<run>``, and inside a folder by (vendor, changed_at), so a query
since a time reads only its dates (partition pruning) and a vendor's history only the files whose
min/max hold the vendor. Writing a run again replaces its rows. The small folders of finished dates
are merged by ``compact_log``: the merged rows are written first, then a commit names the runs that
they replace, then those runs' folders go. A reader takes a merged folder only with its commit, and then
not the runs that it replaces, so it sees each row once at any moment.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.ordering import global_position
from riskloom.session import delete_path, list_children, path_exists

CHANGE_LOG_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("changed_at", T.TimestampNTZType(), False),
    T.StructField("vendor", T.StringType(), False),
    T.StructField("field", T.StringType(), False),
    T.StructField("old_value", T.StringType(), True),
    T.StructField("new_value", T.StringType(), True),
])


PARTITIONS = [T.StructField("changed_date", T.DateType(), True), T.StructField("run_id", T.StringType(), True)]
MERGED = "merged-"


def _folders(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The folders of each date, as they are."""
    dates = [n for n in list_children(spark, path) if n.startswith("changed_date=")]
    return {d[13:]: sorted(n[7:] for n in list_children(spark, f"{path}/{d}") if n.startswith("run_id=")) for d in sorted(dates)}


def _replaced(spark: SparkSession, path: str, merged: str) -> dict[str, set[str]] | None:
    """By date, the runs that a merge stands for; None before its commit."""
    commit = f"{path}/_commits/{merged}"
    if not path_exists(spark, f"{commit}/_SUCCESS"):
        return None
    out: dict[str, set[str]] = {}
    for r in spark.read.parquet(commit).collect():  # a row per date and run
        out.setdefault(r.day, set()).add(r.run_id)
    return out


def _merges(spark: SparkSession, path: str, folders: dict[str, list[str]]) -> dict[str, dict[str, set[str]] | None]:
    names = {r for runs in folders.values() for r in runs if r.startswith(MERGED)}
    return {m: _replaced(spark, path, m) for m in sorted(names)}


def live_folders(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The folders of each date that a reader takes."""
    folders = _folders(spark, path)
    merges = _merges(spark, path, folders)
    out = {}
    for date, runs in folders.items():
        gone = {r for r in runs if r in merges and merges[r] is None}
        gone |= {x for r in runs if merges.get(r) for x in merges[r].get(date, ())}
        if live := [r for r in runs if r not in gone]:
            out[date] = live
    return out


def read_change_log(spark: SparkSession, path: str, with_run: bool = False, since: dt.datetime | None = None) -> DataFrame:
    """The stored changes; ``since`` reads only the dates from that time's day on (whole days)."""
    schema = T.StructType(CHANGE_LOG_SCHEMA.fields + PARTITIONS)
    paths = [f"{path}/changed_date={d}/run_id={r}" for d, runs in live_folders(spark, path).items() for r in runs]
    df = spark.read.schema(schema).option("basePath", path).parquet(*paths) if paths else spark.createDataFrame([], schema)
    if since is not None:
        df = df.where(F.col("changed_date") >= F.lit(since.date()))
    return df.drop("changed_date") if with_run else df.drop("changed_date", "run_id")


def assign_ids(delta: DataFrame, start_after: int) -> DataFrame:
    """Ids after ``start_after`` in (changed_at, vendor, field order, row key) order."""
    order = [F.col("changed_at"), F.col("vendor"), F.col("field_ordinal"), F.col("book_row_id")]
    numbered = global_position(delta, order, "_pos")
    return numbered.select((F.col("_pos") + F.lit(start_after)).alias("id"), "changed_at", "vendor", "field",
                           "old_value", "new_value")


def append_changes(spark: SparkSession, delta: DataFrame, path: str, run_id: str) -> DataFrame:
    """Append one run's cell changes (output of ``change_log_diff``) and return them with ids."""
    existing = read_change_log(spark, path, with_run=True).where(F.col("run_id") != run_id)
    start = existing.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    write_changes(assign_ids(delta, int(start)), path, run_id)
    return read_change_log(spark, path, with_run=True).where(F.col("run_id") == run_id).drop("run_id")


def _write(rows: DataFrame, path: str, run_id: str) -> None:
    # by range, so that a hot vendor spans several files
    x = rows.withColumns({"changed_date": F.to_date("changed_at"), "run_id": F.lit(run_id)})
    (x.repartitionByRange("changed_date", "vendor", "changed_at", "id").sortWithinPartitions("changed_date", "vendor", "changed_at", "id")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("changed_date", "run_id").parquet(path))


def write_changes(rows: DataFrame, path: str, run_id: str) -> None:
    """Write one run's numbered changes; a rerun replaces them, on every date. A merged run is closed."""
    spark = rows.sparkSession
    before = _folders(spark, path)
    if any(run_id in runs for m in _merges(spark, path, before).values() if m for runs in m.values()):
        raise ValueError(f"the changes of run {run_id} are merged and closed")
    rows = rows.select(*CHANGE_LOG_SCHEMA.names)
    _write(rows, path, run_id)
    kept = {str(r[0]) for r in rows.select(F.to_date("changed_at")).distinct().collect()}  # a row per date
    for date, runs in before.items():
        if run_id in runs and date not in kept:
            delete_path(spark, f"{path}/changed_date={date}/run_id={run_id}")


def compact_log(spark: SparkSession, path: str, before: dt.date, least: int = 2) -> None:
    """Merge, in one write, the folders of every date before ``before`` that has ``least`` or more.

    Stopped at any point, it can be called again: folders without a commit are not read and go with the next call.
    """
    folders, live = _folders(spark, path), live_folders(spark, path)
    done = [d for d in folders if dt.date.fromisoformat(d) < before]
    for date in done:
        for r in set(folders[date]) - set(live.get(date, ())):  # left over by a call that was stopped
            delete_path(spark, f"{path}/changed_date={date}/run_id={r}")
    small = {d: live[d] for d in done if len(live.get(d, ())) >= least}
    if not small:
        return
    name = f"{MERGED}{uuid.uuid4().hex}"
    paths = [f"{path}/changed_date={d}/run_id={r}" for d, runs in small.items() for r in runs]
    _write(spark.read.schema(CHANGE_LOG_SCHEMA).parquet(*paths), path, name)
    merges = _merges(spark, path, small)
    replaced = {(d, x) for d, runs in small.items() for r in runs for x in {r, *((merges.get(r) or {}).get(d, ()))}}
    spark.createDataFrame(sorted(replaced), "day string, run_id string").coalesce(1).write.parquet(f"{path}/_commits/{name}")
    for p in paths:
        delete_path(spark, p)
