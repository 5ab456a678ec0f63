"""Research-note operators: same-second overwrite (A4), newest note per vendor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import rules
from riskloom.functions import cells


NOTE_KEY = ("vendor_key", "file_name", "write_seq")


def with_note_texts(ids: DataFrame, notes: DataFrame, key=NOTE_KEY) -> DataFrame:
    """The chosen notes with their texts, fetched last: the ids are what meets the texts, so no aggregate carries
    one, and where few notes are chosen their ids are sent to the texts and not the other way round."""
    return notes.select(*key, "text").join(ids, list(key))


def dedupe_note_writes(writes: DataFrame) -> DataFrame:
    """A4: one note per (vendor_key, file_name); the last write (greatest ``write_seq``, one write each) wins."""
    last = writes.groupBy("vendor_key", "file_name").agg(F.max("write_seq").alias("write_seq"))
    noted_at = cells.note_time("file_name")
    return with_note_texts(last, writes).select(
        "vendor_key", "file_name", "write_seq", noted_at.alias("noted_at"), F.to_date(noted_at).alias("note_date"), "text")


def newest_notes(writes: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Per vendor key, the greatest file name and the text of its last write (no sort, ids first).

    ``writes`` may hold a file several times if it has ``write_seq``. ``keys`` (vendor_key) narrows the search
    to these vendors before any text is read.
    """
    order = [c for c in ("file_name", "write_seq") if c in writes.columns]
    ids = writes.select("vendor_key", *order)
    if keys is not None:
        ids = ids.join(keys.select("vendor_key").distinct(), "vendor_key", "left_semi")
    newest = ids.groupBy("vendor_key").agg(F.max(F.struct(*order)).alias("_n")).select("vendor_key", "_n.*")
    return with_note_texts(newest, writes, ("vendor_key", *order)).select(
        "vendor_key", F.col("file_name").alias("file_label"), F.col("text").alias("summary_text"))


def attach_newest_note(df: DataFrame, newest: DataFrame, vendor_col: str = "vendor") -> DataFrame:
    """Left join on the sanitised vendor key, with the fixed defaults when none exists."""
    keyed = df.withColumn("vendor_key", cells.vendor_key(vendor_col))
    j = keyed.join(newest, "vendor_key", "left")
    return j.withColumn("file_label", F.coalesce(F.col("file_label"), F.lit(rules.NOTE_MISSING_LABEL))).withColumn(
        "summary_text", F.coalesce(F.col("summary_text"), F.lit(rules.NOTE_MISSING_TEXT))
    )
