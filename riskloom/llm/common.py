"""Helpers shared by the training-data operators: table reads, stored intermediate tables, word splitting."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import riskloom
from riskloom.session import work_path
from riskloom.sources.tables import read_table

# The functions that run on executors travel with the job, so executors need no copy of this package.
register_pickle_by_value(riskloom)

#: Words are maximal runs of anything but space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", *(columns or ("doc_id", "text")))


def stored(df: DataFrame, name: str, rows_a_file: int = 0) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage without keeping anything on one executor's disk, and lets the planner see
    the table's true size. Big rows need small files (``rows_a_file``; 0: no bound): a task that reads a
    file holds many of its rows at once.
    """
    spark = df.sparkSession
    path = work_path(spark, "llm", f"{name}-{uuid.uuid4().hex}")
    df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def power_of_two(least: float) -> int:
    """Smallest b with 2**b >= least."""
    return max(0, int(np.ceil(np.log2(max(1.0, least)))))


def ascii_lower_words(text: str | None) -> list[bytes]:
    """The words of a text with A-Z lower-cased; ``bytes.split`` and ``lower`` are ASCII-only, as wanted."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, equal on every machine."""
    if not words:
        return np.empty(0, np.uint64)
    a = np.empty(len(words), object)
    a[:] = words
    return pd.util.hash_array(a, categorize=False)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def empty_to(col: str):
    """A text column with null as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))
