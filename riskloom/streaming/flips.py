"""Incremental flag-flip detection as a Structured Streaming job.

Decisions arrive as files; each micro-batch is processed with ``foreachBatch``:

* flips inside the batch come from the same skew-safe per-vendor sequence as the batch
  flag history (E1), so a batch stream equals E1 when decisions arrive in time order;
* the first decision of a vendor in a batch is compared with the vendor's last flag from
  earlier batches (the state), as the reference compares a late write with the
  current value (X10);
* the state is keyed by vendor and hashed into buckets. A batch reads and rewrites only the
  buckets of its own vendors (``bucket=<b>/batch_id=<n>``); of each bucket the version of the
  batch and the one before stay, older ones are deleted, so the folder does not grow with the
  number of batches;
* flips and state are written per batch id with partition overwrite, and a batch only reads
  versions of earlier batches, so a batch replayed after a failure rewrites the same
  files: exactly-once output.

Checkpoint, state and sink live under the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import cells
from riskloom.operators.ordering import keyed_sequence
from riskloom.session import delete_path, list_children, path_exists, work_path

STATE_BUCKETS = 32  # fixed for the life of a stream; more buckets mean smaller rewrites
STATE_SCHEMA = "vendor string, last_flag boolean, last_at timestamp_ntz, last_id long"
FLIP_SCHEMA = ("id long, changed_at timestamp_ntz, vendor string, field string, "
               "old_value string, new_value string")


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("vendor"), F.lit(buckets)).cast("int")


def state_versions(spark: SparkSession, state_dir: str) -> dict[int, list[int]]:
    """The batch ids of the versions of each state bucket, ascending; at most two of a bucket that is at rest."""
    found = {}
    for name in list_children(spark, state_dir):
        if name.startswith("bucket="):
            versions = list_children(spark, f"{state_dir}/{name}")
            found[int(name[7:])] = sorted(int(v[9:]) for v in versions if v.startswith("batch_id="))
    return found


def _read_buckets(spark: SparkSession, state_dir: str, versions: dict[int, int]) -> DataFrame:
    if not versions:
        return spark.createDataFrame([], STATE_SCHEMA)
    return spark.read.schema(STATE_SCHEMA).parquet(*[f"{state_dir}/bucket={b}/batch_id={v}" for b, v in sorted(versions.items())])


def read_state(spark: SparkSession, run_dir: str) -> DataFrame:
    """The last flag of every vendor seen so far: the newest version of each bucket."""
    state_dir = f"{run_dir}/state"
    return _read_buckets(spark, state_dir, {b: v[-1] for b, v in state_versions(spark, state_dir).items() if v})


def flips_in_batch(batch: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(flip rows, new state) for one micro-batch of decisions; ``state`` holds its vendors' buckets."""
    seq = keyed_sequence(
        batch.select("vendor", "decided_at", "decision_id", "is_risk"),
        key="vendor", order=("decided_at", "decision_id"), value="is_risk",
    )
    j = seq.join(state.select("vendor", "last_flag"), "vendor", "left")
    prev = F.when(F.col("seq") == 1, F.col("last_flag")).otherwise(F.col("prev_value"))
    flips = j.withColumn("_prev", prev).where(~F.col("_prev").eqNullSafe(F.col("is_risk"))).select(
        F.col("decision_id").alias("id"), F.col("decided_at").alias("changed_at"), "vendor",
        F.lit("is_risk").alias("field"), cells.flag_text("_prev").alias("old_value"),
        cells.flag_text("is_risk").alias("new_value"),
    )
    last = batch.groupBy("vendor").agg(
        F.max_by(F.struct(F.col("is_risk").alias("last_flag"), F.col("decided_at").alias("last_at"),
                          F.col("decision_id").alias("last_id")),
                 F.struct("decided_at", "decision_id")).alias("_s")
    ).select("vendor", "_s.*")
    kept = state.join(last.select("vendor"), "vendor", "left_anti")
    return flips, kept.unionByName(last)


def _write_batch(batch: DataFrame, batch_id: int, sink_dir: str, state_dir: str, buckets: int) -> None:
    """Flips and touched state buckets of one micro-batch; versions that no replay can need are deleted."""
    spark = batch.sparkSession
    rows = batch.select("vendor", "decided_at", "decision_id", "is_risk").persist()  # read for buckets, flips and state
    try:
        touched = {r[0] for r in rows.select(_bucket(buckets)).distinct().collect()}  # at most one row per bucket
        # versions of this batch or later come from a failed attempt
        earlier = {b: [v for v in vs if v < batch_id] for b, vs in state_versions(spark, state_dir).items() if b in touched}
        state = _read_buckets(spark, state_dir, {b: vs[-1] for b, vs in earlier.items() if vs})
        flips, new_state = flips_in_batch(rows, state)
        flips.write.mode("overwrite").parquet(f"{sink_dir}/batch_id={batch_id}")
        parts = new_state.withColumns({"bucket": _bucket(buckets), "batch_id": F.lit(batch_id)})
        (parts.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket", "batch_id").parquet(state_dir))
        for b, vs in earlier.items():
            for old in vs[:-1]:
                delete_path(spark, f"{state_dir}/bucket={b}/batch_id={old}")
    finally:
        rows.unpersist()


def run_flip_stream(
    spark: SparkSession,
    source: str,
    to_decisions: Callable[[DataFrame], DataFrame],
    source_schema,
    run_dir: str | None = None,
    max_files_per_trigger: int | None = None,
    buckets: int = STATE_BUCKETS,
) -> str:
    """Run the stream over everything available (``availableNow``) and return the sink path.

    Restarting with the same ``run_dir`` resumes from its checkpoint; ``buckets`` must stay the same.
    """
    run_dir = run_dir or work_path(spark, "flip_stream", uuid.uuid4().hex)
    sink_dir, state_dir, ckpt = (f"{run_dir}/{p}" for p in ("flips", "state", "checkpoint"))
    known = [n for n in list_children(spark, run_dir) if n.startswith("buckets=")]
    if known and known != [f"buckets={buckets}"]:
        raise ValueError(f"{run_dir} was started with {known[0]}, not {buckets}")
    if not known:
        spark.range(1).write.mode("overwrite").parquet(f"{run_dir}/buckets={buckets}")
    reader = spark.readStream.schema(source_schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    decisions = to_decisions(reader.parquet(source))
    q = (decisions.writeStream.foreachBatch(lambda batch, n: _write_batch(batch, n, sink_dir, state_dir, buckets))
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return sink_dir


def read_flips(spark: SparkSession, sink_dir: str) -> DataFrame:
    """All flips written so far (empty when no batch has run)."""
    schema = FLIP_SCHEMA + ", batch_id int"
    if not path_exists(spark, sink_dir):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "false").parquet(sink_dir)
