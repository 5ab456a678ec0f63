"""Vendor book storage (A1, A2, C3 publication): immutable snapshot versions.

``<store>/version=<n>`` holds snapshot n; an update writes version n+1 and never
overwrites the path being read. The first run seeds version 0 only when no version
exists (``mode('ignore')``), as the reference seeds its database once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.book import KEY_COLUMN, ingest_book
from riskloom.session import list_children, path_exists


def read_tabular(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A1 source: CSV (header, every cell as text, no inference) or Parquet (typed cells)."""
    if fmt == "csv":
        return spark.read.option("header", True).option("inferSchema", False).csv(path)
    return spark.read.format(fmt).load(path)


def with_row_key(raw: DataFrame) -> DataFrame:
    """Give each row a ``book_row_id`` (X9); fixed once the seed is written."""
    if KEY_COLUMN in raw.columns:
        return raw
    return raw.select(F.monotonically_increasing_id().alias(KEY_COLUMN), *raw.columns)


def _folders(spark: SparkSession, store: str) -> list[int]:
    return sorted(int(n.split("=", 1)[1]) for n in list_children(spark, store) if n.startswith("version="))


def versions(spark: SparkSession, store: str) -> list[int]:
    """The committed versions: a write that failed leaves a folder without ``_SUCCESS``, which does not count."""
    return [v for v in _folders(spark, store) if path_exists(spark, f"{store}/version={v}/_SUCCESS")]


def seed_book(spark: SparkSession, raw: DataFrame, store: str) -> int:
    """First run only: write version 0 from the raw table; later runs change nothing.

    What an earlier seed left uncommitted is written anew."""
    done = versions(spark, store)
    if done:
        return done[-1]
    ingest_book(with_row_key(raw)).write.mode("overwrite").parquet(f"{store}/version=0")
    return 0


def read_book(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """A2: the current (or a given) snapshot; Catalyst prunes the columns a query uses."""
    vs = versions(spark, store)
    if not vs:
        raise FileNotFoundError(f"no book snapshot under {store}")
    v = vs[-1] if version is None else version
    return spark.read.parquet(f"{store}/version={v}")


def publish_book(spark: SparkSession, snapshot: DataFrame, store: str, version: int | None = None) -> int:
    """Write ``snapshot`` as the next (or the given) version and return its number.

    A given version is written over: that is how a replayed run repeats its own."""
    vs = _folders(spark, store)  # an uncommitted folder keeps its number
    nxt = version if version is not None else (vs[-1] + 1) if vs else 0
    snapshot.write.mode("errorifexists" if version is None else "overwrite").parquet(f"{store}/version={nxt}")
    return nxt
