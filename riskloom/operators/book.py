"""Vendor book operators: ingest, typed view, queue, view, updates (A1, H1-H4, B1, B2, B7,
G1, G2, E3, D2, C3a, C3b, H13)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import rules
from riskloom.functions import cells
from riskloom.operators.ordering import global_position

# Columns the code needs, by snake-case name, and their typed form.
TIMESTAMP_COLUMNS = ("last_checked", "last_risk_eval")
NUMBER_COLUMNS = ("risk_level",)
FLAG_COLUMN = "is_risk"
KEY_COLUMN = "book_row_id"


def ingest_book(raw: DataFrame) -> DataFrame:
    """A1: every cell to its stored text; ``is_risk`` normalised to '1' / '0' / NULL.

    Spreadsheet headers get our names first; columns of other names are kept as they are. Typed
    cells (timestamps, numbers, booleans) become canonical text (H2); the row key ``book_row_id``
    stays a number so duplicate vendor names stay apart (X9).
    """
    raw = raw.withColumnsRenamed({h: c for h, c in rules.BOOK_HEADERS.items() if h in raw.columns and h != c})
    out = []
    for f in raw.schema.fields:
        if f.name == KEY_COLUMN:
            out.append(F.col(f.name))
        elif f.name == FLAG_COLUMN:
            out.append(cells.flag_text(cells.parse_flag(f.name, f.dataType)).alias(f.name))
        else:
            out.append(cells.canonical_cell(f.name, f.dataType).alias(f.name))
    return raw.select(*out)


def typed_book(book: DataFrame) -> DataFrame:
    """H3/H4/H1: the typed view of the stored text (junk -> NULL, parsed per row)."""
    cols = []
    for name in book.columns:
        if name in TIMESTAMP_COLUMNS:
            cols.append(cells.to_timestamp_cell(name).alias(name))
        elif name in NUMBER_COLUMNS:
            cols.append(cells.to_number_cell(name).alias(name))
        elif name == FLAG_COLUMN:
            cols.append(cells.parse_flag_text(name).alias(name))
        else:
            cols.append(F.col(name))
    return book.select(*cols)


_DISPLAY_TYPES = {
    "last_checked": "timestamp_ntz", "last_risk_eval": "timestamp_ntz",
    "risk_level": "double", "is_risk": "boolean",
}


def display_columns(typed: DataFrame) -> list[Column]:
    """B1: the 8 display columns; absent ones become typed NULLs."""
    return [
        F.col(c) if c in typed.columns else F.lit(None).cast(_DISPLAY_TYPES.get(c, "string")).alias(c)
        for c in rules.DISPLAY_COLUMNS
    ]


def view_order() -> list[Column]:
    """Flag desc, level desc, checked asc, NULLs last; ties by vendor, row key."""
    return [
        F.col("is_risk").desc_nulls_last(),
        F.col("risk_level").desc_nulls_last(),
        F.col("last_checked").asc_nulls_last(),
        F.col("vendor").asc(),
        F.col(KEY_COLUMN).asc(),
    ]


def book_view(typed: DataFrame, flagged_only: bool = False) -> DataFrame:
    """Project (B1), optionally keep flagged rows (B2), number rows in view order."""
    view = typed.select(F.col(KEY_COLUMN), *display_columns(typed))
    if flagged_only:
        view = view.where(F.col("is_risk"))  # NULL flags drop out
    return global_position(view, view_order(), "view_pos")


def queue_order() -> list[Column]:
    """G1: raw text order, NULL first, then '' then text; ties by vendor, row key."""
    return [F.col("last_checked").asc_nulls_first(), F.col("vendor").asc(), F.col(KEY_COLUMN).asc()]


def clamp_batch(k: int | None) -> int:
    """A run processes at least one vendor; negative (SQLite -1) means all is not used."""
    return max(1, int(k if k is not None else rules.DEFAULT_BATCH_SIZE))


def vendor_queue(book: DataFrame, k: int, carry=()) -> DataFrame:
    """G1 + E3: the k vendors checked longest ago, with their queue position.

    ``orderBy().limit(k)`` plans as TakeOrderedAndProject (per-partition top-k, then a
    k-row merge); the position window runs over those k rows only. ``carry`` columns of the
    book ride along, so callers need not scan the book again.
    """
    top = book.select(KEY_COLUMN, "vendor", "last_checked", *carry).orderBy(*queue_order()).limit(max(0, int(k)))
    unparsed = (
        F.col("last_checked").isNotNull()
        & (F.trim(F.col("last_checked")) != "")
        & cells.to_timestamp_cell("last_checked").isNull()
    )
    return top.select(
        F.row_number().over(Window.orderBy(*queue_order())).cast("long").alias("queue_pos"),
        KEY_COLUMN, "vendor", "last_checked", unparsed.alias("unparseable_date"), *carry,
    )


def queue_preview(queue: DataFrame) -> DataFrame:
    """The markdown preview of a queue (bounded by k), or the empty-book text."""
    lines = F.sort_array(F.collect_list(F.struct("queue_pos", "vendor")))
    n = F.count(F.lit(1))
    body = F.concat(
        F.format_string(rules.QUEUE_PREVIEW_TITLE.replace("{n}", "%d"), n),
        F.lit("\n\n"),
        F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x["vendor"])), "\n"),
    )
    return queue.agg(
        n.alias("n_vendors"),
        F.when(n == 0, F.lit(rules.EMPTY_QUEUE_MESSAGE)).otherwise(body).alias("preview"),
    )


def vendor_subset(book: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of the book whose vendor is in an explicit list (left-semi join)."""
    return book.join(names.select(F.col("vendor")).distinct(), "vendor", "left_semi")


def book_count(book: DataFrame) -> DataFrame:
    """Number of rows in the book."""
    return book.agg(F.count(F.lit(1)).alias("n_vendors"))


def book_touch(book: DataFrame, checked: DataFrame) -> DataFrame:
    """Set ``last_checked`` for every row whose vendor was checked; others keep theirs.

    ``checked`` holds (vendor, checked_at); names repeat in the book, so all duplicates
    are updated; unknown vendors have no row and change nothing.
    """
    upd = checked.groupBy("vendor").agg(F.max("checked_at").alias("_checked_at"))
    joined = book.join(upd, "vendor", "left")
    cols = [
        F.coalesce(cells.timestamp_text("_checked_at"), F.col("last_checked")).alias("last_checked")
        if c == "last_checked" else F.col(c)
        for c in book.columns
    ]
    return joined.select(*cols)


def latest_per_vendor(decisions: DataFrame, order: Iterable[str] = ("decided_at", "decision_id")) -> DataFrame:
    """The last decision per vendor (applying each in turn ends with it); a partial aggregate."""
    key = F.struct(*[F.col(c) for c in order])
    payload = F.struct(*[F.col(c) for c in decisions.columns if c != "vendor"])
    return decisions.groupBy("vendor").agg(F.max_by(payload, key).alias("_d")).select("vendor", "_d.*")


def book_upsert(book: DataFrame, latest: DataFrame) -> DataFrame:
    """Matched rows take flag, level, reason and eval time, NULLs included.

    ``latest`` has one row per vendor: (vendor, decided_at, risk_level, is_risk, risk_reason).
    A match marker decides, not ``coalesce``, so a NULL reason overwrites.
    """
    upd = latest.select(
        "vendor",
        F.lit(True).alias("_hit"),
        cells.flag_text("is_risk").alias("_is_risk"),
        cells.number_text("risk_level").alias("_risk_level"),
        F.col("risk_reason").alias("_risk_reason"),
        cells.timestamp_text("decided_at").alias("_last_risk_eval"),
    )
    joined = book.join(upd, "vendor", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    fields = {"is_risk", "risk_level", "risk_reason", "last_risk_eval"}
    cols = [
        F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
        for c in book.columns
    ]
    return joined.select(*cols)

