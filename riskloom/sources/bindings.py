"""Domain views over the given tables (the bindings of FIXTURES.md §4).

Each function returns the same rows as the matching SQL view in FIXTURES.md, written
with the DataFrame API so Catalyst prunes columns and pushes filters to the scan.
``m`` (1.2 x the supplier count) is a scalar subquery, not a join.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import cells
from riskloom.sources.tables import read_table, spread

# Fixed values of the test binding: statement templates keyed 0..15.
TEMPLATES = (
    (0, "announced a new display plant"),
    (1, "filed for Chapter 11 protection"),
    (2, "received a going-concern qualification"),
    (3, "reported sustained losses"),
    (4, "share price fell on analyst downgrade"),
    (5, "was added to the BIS entity list"),
    (6, "reported revenue decline"),
    (7, "opened a facility with 250 employees"),
    (8, "settled litigation for $12 million"),
    (9, "port congestion delayed vessels"),
    (10, "said certification under review"),
    (11, "litigation remains pending"),
    (12, "acquired a rival on 2023-12-15"),
    (13, "disclosed Q3 2023 results"),
    (14, 'in a red flag said "we will keep on shipping all of our current models to every customer this year"'),
    (15, ""),
)
NEWS_EPOCH = dt.date(2023, 8, 1)


def _pad(c: Column, width: int) -> Column:
    return F.lpad(c.cast("string"), width, "0")


def supplier_name(num: Column) -> Column:
    """``Supplier#`` + 9-digit number, the naming of the supplier table."""
    return F.concat(F.lit("Supplier#"), _pad(num, 9))


def vendor_modulus(spark: SparkSession, sf_dir: str) -> Column:
    """Scalar subquery: CAST(count(*) * 1.2 AS BIGINT) over supplier."""
    sup = read_table(spark, sf_dir, "supplier", "s_suppkey")
    return sup.select((F.count(F.lit(1)) * F.lit(1.2)).cast("bigint")).scalar()


def book_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_book_raw: the vendor book as text cells, one row per supplier."""
    s = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey")
    n = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    k = F.col("s_suppkey")
    checked = F.concat(F.lit("2024-01-"), _pad(1 + k % 28, 2), F.lit(" 00:00:00"))
    flag = (
        F.when(k % 8 == 0, F.lit(None).cast("string"))
        .when(k % 8 == 1, "1").when(k % 8 == 2, "0").when(k % 8 == 3, "True")
        .when(k % 8 == 4, " no ").when(k % 8 == 5, "nan").when(k % 8 == 6, "2")
        .otherwise("0.0")
    )
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        k.alias("book_row_id"),
        F.col("s_name").alias("vendor"),
        F.when(k % 3 == 0, "Display").when(k % 3 == 1, "Audio").otherwise("Control").alias("category"),
        F.col("n_name").alias("hq_country"),
        F.when(k % 10 == 0, F.lit(None).cast("string")).when(k % 10 == 1, "n/a")
        .when(k % 10 == 2, "").otherwise(checked).alias("last_checked"),
        flag.alias("is_risk"),
        F.when(k % 9 == 0, F.lit(None).cast("string")).when(k % 9 == 1, "abc")
        .otherwise((k % 6).cast("string")).alias("risk_level"),
        F.when(k % 4 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("seed reason "), (k % 6).cast("string"))).alias("risk_reason"),
        F.when(k % 5 == 0, F.lit(None).cast("string")).otherwise("2024-01-01 00:00:00").alias("last_risk_eval"),
    )


def _level_from_value() -> Column:
    return F.floor("value").cast("int") % 6


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_decisions: an append-only log of risk decisions, one per event."""
    e = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    lvl = _level_from_value()
    return e.select(
        F.col("event_id").alias("decision_id"),
        supplier_name(F.col("user_id")).alias("vendor"),
        cells.floor_second("ts").alias("decided_at"),
        lvl.alias("risk_level"),
        (lvl >= 3).alias("is_risk"),
        F.col("event_type").alias("risk_reason"),
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_evidence: scored indicators, one per event; high levels are rare and conditions fine."""
    e = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    eid = F.col("event_id")
    most = F.when(eid % 211 == 0, 5).when(eid % 97 == 0, 4).when(eid % 41 == 0, 3).when(eid % 7 == 0, 2).otherwise(1)
    lvl = F.least(_level_from_value(), most)
    return e.select(
        eid.alias("evidence_id"),
        supplier_name(F.col("user_id")).alias("vendor"),
        F.concat(F.col("event_type"), F.lit("_"), lvl.cast("string"), F.lit("_"), (eid % 7).cast("string")).alias("condition"),
        lvl.alias("level"),
        F.concat(F.lit("src"), (eid % 20).cast("string")).alias("outlet"),
        F.when(eid % 20 < 5, 1).when(eid % 20 < 12, 2).otherwise(3).alias("tier"),
        (eid % 5 != 0).alias("in_scope"),
        (eid % 7 == 0).alias("new_models_only"),
        (F.col("event_type") == "error").alias("is_breach"),
        ((F.col("event_type") == "error") & (lvl == 5)).alias("is_going_concern"),
        ((F.col("event_type") == "purchase") & (lvl <= 1)).alias("is_resolution"),
        F.col("ts").alias("published_at"),
    )


def templates(spark: SparkSession) -> DataFrame:
    """v_templates: the 16 fixed statements."""
    return spark.createDataFrame(list(TEMPLATES), "k int, stmt string")


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_news: one news item per document, with vendor, outlet, tier, date and text.

    The template is picked by ``n_chars % 16``; every residue has exactly one template,
    so the inner join of the SQL view is an array lookup here (no join, no shuffle).
    """
    d = spread(read_table(spark, sf_dir, "documents", "doc_id", "text", "source", "n_chars"), "doc_id")
    m = vendor_modulus(spark, sf_dir)
    stmts = F.array(*[F.lit(s) for _, s in TEMPLATES])
    num = F.col("n_chars") % m
    stmt = F.element_at(stmts, (F.col("n_chars") % 16).cast("int") + 1)
    prefix = F.when(F.col("n_chars") % 5 != 0, F.concat(F.lit("SUP-"), num.cast("string"), F.lit(" "))).otherwise("")
    return d.where(F.col("n_chars").isNotNull()).select(
        F.col("doc_id").alias("item_id"),
        supplier_name(num).alias("vendor"),
        F.col("source").alias("outlet"),
        F.when(F.col("source").isin("src0", "src1", "src2"), 1)
        .when(F.col("source").isin("src3", "src4", "src5", "src6", "src7", "src8"), 2)
        .otherwise(3).alias("tier"),
        F.when(F.col("doc_id") % 17 == 0, F.lit(None).cast("date"))
        .otherwise(F.date_add(F.lit(NEWS_EPOCH), (F.col("doc_id") % 183).cast("int"))).alias("published_on"),
        F.concat(prefix, stmt, F.lit(". "), F.col("text")).alias("text"),
    )


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_aliases: one alias per supplier."""
    s = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    return s.select(
        F.col("s_name").alias("vendor"),
        F.concat(F.lit("SUP-"), F.col("s_suppkey").cast("string")).alias("alias"),
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_notes: research note writes, in write order ``write_seq``."""
    d = spread(read_table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id")
    m = vendor_modulus(spark, sf_dir)
    i = F.col("doc_id")
    return d.select(
        i.alias("write_seq"),
        supplier_name(i % m).alias("vendor_key"),
        F.concat(
            F.lit("research_2024-01-"), _pad(1 + i % 28, 2), F.lit("_"),
            _pad(i % 24, 2), F.lit("-"), _pad(i % 60, 2), F.lit("-00.md"),
        ).alias("file_name"),
        F.col("text"),
    )


def decision_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scorer output as JSON text, one record per event: some out of range, some without
    a reason, some of the wrong shape (the event's own ``props``)."""
    e = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    eid = F.col("event_id")
    lvl = (F.floor("value").cast("int") % 8 - 1).cast("string")
    good = F.concat(F.lit('{"Risk_Reason": "'), F.col("event_type"), F.lit('", "Risk_level": '), lvl, F.lit("}"))
    no_reason = F.concat(F.lit('{"Risk_level": '), lvl, F.lit("}"))
    payload = F.when(eid % 13 == 0, F.col("props")).when(eid % 11 == 0, no_reason).otherwise(good)
    return e.select(
        eid.alias("decision_id"),
        supplier_name(F.col("user_id")).alias("vendor"),
        cells.floor_second("ts").alias("decided_at"),
        payload.alias("payload"),
    )
