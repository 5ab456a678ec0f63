"""Alert operators: enrichment (C1), status and transition text (H8, H9), payload sections
(H11), alert lines (N1, G4), header counts (D3, B8), paged body (D5) and full text (H12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import rules
from riskloom.functions import cells
from riskloom.operators.events import ABBREVIATION_PATTERN
from riskloom.operators.ordering import global_position, running_total


def enrich_changes(latest: DataFrame, typed_book: DataFrame) -> DataFrame:
    """Latest change per vendor x current level and reason; duplicate names fan out."""
    cur = typed_book.select("vendor", "book_row_id", "risk_level", "risk_reason")
    return latest.join(cur, "vendor", "left")


def status(new_value="new_value") -> Column:
    """H8: new value '1' -> NEW RISK, anything else -> CLEARED."""
    return F.when(cells.strip(new_value) == "1", F.lit(rules.STATUS_NEW)).otherwise(F.lit(rules.STATUS_CLEARED))


def _shown(c: str) -> Column:
    return F.coalesce(F.nullif(cells.strip(c), F.lit("")), F.lit(rules.MISSING_VALUE_TEXT))


def transition(old_value="old_value", new_value="new_value") -> Column:
    """H9: 'old -> new', blanks shown as null."""
    return F.concat(_shown(old_value), F.lit(" -> "), _shown(new_value))


def level_text(c="risk_level") -> Column:
    return F.coalesce(cells.number_text(c), F.lit(rules.MISSING_LEVEL_TEXT))


def reason_text(c="risk_reason") -> Column:
    return F.coalesce(F.col(c), F.lit(rules.MISSING_REASON_TEXT))


def first_sentence(c: Column) -> Column:
    """The first sentence of a reason, ending in a full stop; the stops of abbreviations end none."""
    held = F.regexp_replace(c, ABBREVIATION_PATTERN, "$1$2\x01")
    first = F.regexp_extract(held, r"^\s*(.+?[.!?])(\s|$)", 1)
    s = F.translate(F.coalesce(F.nullif(first, F.lit("")), F.trim(held)), "\x01", ".")
    return F.when(s.rlike(r"[.!?]$"), s).otherwise(F.concat(s, F.lit(".")))


def section_text() -> Column:
    """The text section of one changed vendor (after C2 attached the newest note)."""
    return F.concat(
        F.lit("## "), F.col("vendor"),
        F.lit("\nStatus: "), status(),
        F.lit("\nTransition: "), transition(),
        F.lit("\nRisk level: "), level_text(),
        F.lit("\nReason: "), reason_text(),
        F.lit("\nSource: "), F.col("file_label"),
        F.lit("\n\nResearch summary:\n"), F.col("summary_text"),
    )


def payload_sections(enriched: DataFrame) -> DataFrame:
    """One section per changed vendor."""
    return enriched.select("id", "vendor", "book_row_id", status().alias("status"),
                           transition().alias("transition"), section_text().alias("section"))


def line_order() -> list[Column]:
    """NEW RISK first, newest first inside (in the log's order, as D1), then the book row."""
    return [F.col("status_rank").asc(), F.col("changed_at").desc(), F.col("id").desc(), F.col("book_row_id").asc_nulls_first()]


def alert_lines(enriched: DataFrame, carry=()) -> DataFrame:
    """N1 + G4: one line per changed vendor, numbered in alert order (``carry`` columns kept)."""
    st = status()
    line = F.concat(
        st, F.lit(" - "), F.col("vendor"), F.lit(": Level "), level_text(), F.lit(". "),
        first_sentence(reason_text()),
    )
    lines = enriched.select(
        "id", "vendor", "book_row_id", st.alias("status"),
        F.when(st == rules.STATUS_NEW, 0).otherwise(1).alias("status_rank"), "changed_at", line.alias("line"), *carry,
    )
    return global_position(lines, line_order(), "alert_pos").drop("status_rank", "changed_at")


def alert_header(lines: DataFrame) -> DataFrame:
    """D3 + B8: counts and the header line; one row even when nothing changed."""
    n_new = F.count_if(F.col("status") == rules.STATUS_NEW)
    n_cleared = F.count_if(F.col("status") == rules.STATUS_CLEARED)
    n = F.count(F.lit(1))
    fmt = rules.ALERT_HEADER_FORMAT.replace("{new}", "%d").replace("{cleared}", "%d")
    return lines.agg(
        n.alias("n_changes"), n_new.alias("n_new"), n_cleared.alias("n_cleared"),
        F.when(n == 0, F.lit(rules.NO_CHANGES_MESSAGE)).otherwise(F.format_string(fmt, n_new, n_cleared)).alias("header"),
    )


def alert_pages(lines: DataFrame, page_bytes: int = rules.ALERT_PAGE_BYTES, more: dict[str, str] | None = None) -> DataFrame:
    """The ordered body, cut into pages by bytes: (page_no from 0, page_count, n_lines, body).

    A page holds the lines that begin within the same ``page_bytes`` of the whole text, so a page is at most
    one line longer and no task assembles an unbounded text; one page or many have the same shape. ``more`` names
    further text columns of ``lines`` to join per page, with their separators, and counts their bytes too.
    """
    texts = {"line": "\n"} | (more or {})
    size = sum((F.octet_length(c) + 1 for c in texts), F.lit(0))
    x = running_total(lines.withColumn("_size", size.cast("long")), "alert_pos", "_size", "_end")
    cut = F.floor((F.col("_end") - F.col("_size")) / F.lit(page_bytes)).cast("long")
    ordered = F.sort_array(F.collect_list(F.struct("alert_pos", *texts)))
    pages = x.groupBy(cut.alias("_cut")).agg(F.count(F.lit(1)).alias("n_lines"), *[
        F.array_join(F.transform(ordered, _field(c)), sep).alias("body" if c == "line" else c) for c, sep in texts.items()])
    # a row per page, without texts
    numbers = x.groupBy(cut.alias("_cut")).agg(F.lit(0).alias("_0")).select(
        "_cut", (F.row_number().over(Window.orderBy("_cut")) - 1).cast("long").alias("page_no"))
    count = numbers.agg(F.count(F.lit(1))).select("count(1)").scalar()
    return pages.join(numbers, "_cut").select("page_no", count.alias("page_count"), "n_lines", "body", *(more or {}))


def _field(name: str):
    return lambda row: row[name]


def full_text(header: Column, body: Column) -> Column:
    """Header, blank line, body; the header alone when the body is blank."""
    return F.when(cells.strip(body) != "", F.concat(header, F.lit("\n\n"), body)).otherwise(header)


def alert_outbox(lines: DataFrame, run_id: str, page_bytes: int = rules.ALERT_PAGE_BYTES) -> DataFrame:
    """A6 rows: one per body page with subject = header; an empty run yields no rows."""
    header = alert_header(lines).select("header").scalar()
    pages = alert_pages(lines, page_bytes)
    return pages.select(
        F.lit(run_id).alias("run_id"), "page_no", "page_count", "n_lines",
        header.alias("subject"), "body", full_text(header, F.col("body")).alias("full_text"),
    )
