"""Change-log operators: flag history (E1), cell audit (C4), risk-change filter (B3),
latest change per vendor (D1), per-vendor history (B4, G3)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import cells
from riskloom.operators.ordering import keyed_sequence

CHANGE_COLUMNS = ("id", "changed_at", "vendor", "field", "old_value", "new_value")


def flag_history(decisions: DataFrame) -> DataFrame:
    """One change row per decision whose flag differs (null-safe) from the vendor's previous one.

    Order per vendor is (decided_at, decision_id); the first decision of a vendor is a
    NULL -> x change. The per-vendor lag is skew-safe (see ``keyed_sequence``).
    """
    seq = keyed_sequence(
        decisions.select("vendor", "decided_at", "decision_id", "is_risk"),
        key="vendor", order=("decided_at", "decision_id"), value="is_risk",
    )
    changed = seq.where(~F.col("prev_value").eqNullSafe(F.col("is_risk")))
    return changed.select(
        F.col("decision_id").alias("id"),
        F.col("decided_at").alias("changed_at"),
        F.col("vendor"),
        F.lit("is_risk").alias("field"),
        cells.flag_text("prev_value").alias("old_value"),
        cells.flag_text("is_risk").alias("new_value"),
    )


def risk_changes_since(log: DataFrame, since) -> DataFrame:
    """Flag changes at or after ``since`` (second grain, inclusive) touching a '1'.

    Text comparison with '1', as the stored cells are text ('1.0' or 'true' are not 1).
    """
    one = F.lit("1")
    return log.where(
        (F.col("field") == "is_risk")
        & (F.col("changed_at") >= (cells.ts_lit(since) if isinstance(since, dt.datetime) else since))
        & ((F.coalesce(F.col("old_value"), F.lit("")) == one) | (F.coalesce(F.col("new_value"), F.lit("")) == one))
    )


def latest_change_per_vendor(changes: DataFrame) -> DataFrame:
    """The newest change per vendor in the log's own order (time, then id), as a partial aggregate (skew-safe)."""
    payload = F.struct(*[F.col(c) for c in changes.columns if c != "vendor"])
    return changes.groupBy("vendor").agg(F.max_by(payload, F.struct("changed_at", "id")).alias("_c")).select(
        *[F.col(f"_c.{c}") if c != "vendor" else F.col("vendor") for c in changes.columns]
    )


def vendor_change_history(log: DataFrame, vendor: str | None = None) -> DataFrame:
    """B4 + G3: changes newest first, with the position inside each vendor's history.

    A vendor filter reaches the Parquet scan as a pushed filter.
    """
    if vendor is not None:
        log = log.where(F.col("vendor") == vendor)
    return keyed_sequence(
        log, key="vendor", order=("changed_at", "id"), descending=True, seq_col="history_pos",
    )


def change_log_diff(before: DataFrame, after: DataFrame, changed_at: dt.datetime, key: str = "book_row_id") -> DataFrame:
    """C4: cell-level audit of an update, one row per changed cell, in column order.

    Both snapshots are joined once on the row key (one row per book row, not one per
    cell), then the column pairs are exploded and compared null-safely (B6).
    """
    fields = [c for c in after.columns if c != key]
    b = before.select(key, *[F.col(c).cast("string").alias(f"_old_{c}") for c in fields])
    a = after.select(key, *[F.col(c).cast("string").alias(f"_new_{c}") for c in fields])
    pairs = F.explode(F.array(*[
        F.struct(F.lit(i).alias("field_ordinal"), F.lit(c).alias("field"),
                 F.col(f"_old_{c}").alias("old_value"), F.col(f"_new_{c}").alias("new_value"))
        for i, c in enumerate(fields)
    ]))
    cells_df = b.join(a, key, "inner").select(key, F.col("_new_vendor").alias("vendor"), pairs.alias("p"))
    return cells_df.where(~F.col("p.old_value").eqNullSafe(F.col("p.new_value"))).select(
        cells.ts_lit(changed_at).alias("changed_at"),
        key, "vendor", "p.field_ordinal", "p.field", "p.old_value", "p.new_value",
    )
