"""Session helpers: build a local session for tests and find the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "riskloom") -> SparkSession:
    """Local session used by tests and the bench; a cluster passes its own session in."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A cluster names it; we only pick our own (a fresh temp folder) when it is unset
    and the session runs in local mode, as in tests.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running riskloom jobs")
    path = tempfile.mkdtemp(prefix="riskloom-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def materialize(df):
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder.

    Used where derived rows feed several branches or where the optimizer would otherwise
    push filters into (and so repeat) an expensive projection such as whole-text regexes.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def work_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder for tables this library writes."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "riskloom", *parts) if "://" not in base else "/".join([base.rstrip("/"), "riskloom", *parts])


def written(df, name: str, made: list[str]):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back; the path goes to ``made``.

    Columns lie compressed and are read one by one, where ``materialize`` keeps whole rows as they are in memory.
    """
    path = work_path(df.sparkSession, "tables", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def spent_shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go when it ends; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system (local, HDFS or object stores)."""
    p, fs = _fs(spark, path)
    return bool(fs.exists(p))


def list_children(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries directly under ``path`` (empty when it does not exist)."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return []
    return [st.getPath().getName() for st in fs.listStatus(p)]


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of this library's own working tables, if it is there."""
    p, fs = _fs(spark, path)
    fs.delete(p, True)
