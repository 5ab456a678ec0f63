"""The query registry used by ``__spark_entry__``: name -> (Spark callable, DuckDB SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.plans import catalog
from riskloom.plans.oracle import oracle_statements


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name[2:]: fn for name, fn in vars(catalog).items() if name.startswith("q_") and callable(fn)}


def oracle_sql() -> dict[str, str]:
    q = queries()
    return {k: v for k, v in oracle_statements().items() if k in q}
