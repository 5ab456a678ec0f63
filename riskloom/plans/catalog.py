"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

They read the given tables through the bindings and run the library operators over
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import rules
from riskloom.functions import cells
from riskloom.operators import alert as A
from riskloom.operators import book as B
from riskloom.operators import events as E
from riskloom.operators import news as R
from riskloom.operators import changes as C
from riskloom.operators import notes as N
from riskloom.operators import score as S
from riskloom.operators import similarity as SIM
from riskloom.plans import monitor as P
from riskloom.session import materialize, work_path
from riskloom.sources import bindings
from riskloom.sources import change_log as L
from riskloom.streaming import flips as S1
from riskloom.sources.tables import read_table

# Names of the explicit vendor list (B7 / P4); they exist at every scale factor.
MANUAL_VENDORS = ("Supplier#000000002", "Supplier#000000005", "Supplier#000000009")


# --- shared building blocks -----------------------------------------------------


def book_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.ingest_book(bindings.book_raw(spark, sf_dir))


def book_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.typed_book(book_text(spark, sf_dir))


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The is_risk change log, derived from the decision log."""
    return C.flag_history(bindings.decisions(spark, sf_dir))


def changes_since(spark: SparkSession, sf_dir: str, since=rules.RUN_START) -> DataFrame:
    return C.risk_changes_since(change_log(spark, sf_dir), since)


def latest_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = bindings.decisions(spark, sf_dir)
    return B.latest_per_vendor(d)


def book_after_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.book_upsert(book_text(spark, sf_dir), latest_decisions(spark, sf_dir))


def note_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes after the same-second overwrite (A4)."""
    return N.dedupe_note_writes(bindings.notes(spark, sf_dir))


def enriched_changes(spark: SparkSession, sf_dir: str, since=rules.RUN_START) -> DataFrame:
    """B3 -> D1 -> C1 against the book after the run's decisions were applied."""
    latest = C.latest_change_per_vendor(changes_since(spark, sf_dir, since))
    return A.enrich_changes(latest, B.typed_book(book_after_decisions(spark, sf_dir)))


# --- A / H: ingest and cells ------------------------------------------------------


def q_book_ingest(spark, sf_dir):
    return book_text(spark, sf_dir)


def q_book_typed(spark, sf_dir):
    return book_typed(spark, sf_dir)


def q_parse_flag(spark, sf_dir):
    raw = bindings.book_raw(spark, sf_dir)
    return raw.select("book_row_id", F.col("is_risk").alias("flag_text"),
                      cells.parse_flag_text("is_risk").alias("flag"))


def q_canonical_cells(spark, sf_dir):
    e = read_table(spark, sf_dir, "events", "event_id", "ts", "event_type", "value", "props")
    return e.select(
        "event_id",
        cells.canonical_cell("ts", e.schema["ts"].dataType).alias("ts_text"),
        cells.canonical_cell("value", e.schema["value"].dataType).alias("value_text"),
        cells.canonical_cell(F.col("event_type") == "error", T.BooleanType()).alias("flag_text"),
        cells.canonical_cell("props", e.schema["props"].dataType).alias("props_text"),
    )


def q_vendor_key(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages", "page_id", "url")
    return p.select("page_id", F.col("url").alias("name"), cells.vendor_key("url").alias("vendor_key"))


# --- book -------------------------------------------------------------------------


def q_book_count(spark, sf_dir):
    return B.book_count(book_text(spark, sf_dir))


def q_vendor_queue(spark, sf_dir):
    return B.vendor_queue(book_text(spark, sf_dir), rules.QUEUE_K)


def q_queue_preview(spark, sf_dir):
    return B.queue_preview(B.vendor_queue(book_text(spark, sf_dir), rules.QUEUE_K))


def q_vendor_book_view(spark, sf_dir):
    return B.book_view(book_typed(spark, sf_dir))


def q_flagged_vendors(spark, sf_dir):
    return B.book_view(book_typed(spark, sf_dir), flagged_only=True)


def q_vendor_subset(spark, sf_dir):
    names = spark.createDataFrame([(v,) for v in MANUAL_VENDORS], "vendor string")
    return B.vendor_subset(book_text(spark, sf_dir), F.broadcast(names)).select("book_row_id", "vendor", "last_checked")


def q_book_touch(spark, sf_dir):
    bt = book_text(spark, sf_dir)
    queue = B.vendor_queue(bt, rules.QUEUE_K)
    checked = queue.select("vendor", cells.ts_lit(rules.RUN_START).alias("checked_at"))
    # the queue holds at most k rows: a bounded broadcast
    return B.book_touch(bt, F.broadcast(checked))


def q_book_upsert(spark, sf_dir):
    return book_after_decisions(spark, sf_dir)


def q_risk_flag(spark, sf_dir):
    d = bindings.decisions(spark, sf_dir)
    return d.select("decision_id", "vendor", "risk_level", (F.col("risk_level") >= rules.FLAG_THRESHOLD).alias("is_risk"))


# --- change log ---------------------------------------------------------------------


def q_change_log_history(spark, sf_dir):
    return change_log(spark, sf_dir)


def q_risk_changes_since(spark, sf_dir):
    return changes_since(spark, sf_dir)


def q_risk_changes_latest(spark, sf_dir):
    return C.latest_change_per_vendor(changes_since(spark, sf_dir))


def q_vendor_change_history(spark, sf_dir):
    return C.vendor_change_history(change_log(spark, sf_dir))


def q_change_log_diff(spark, sf_dir):
    before = book_text(spark, sf_dir)
    after = book_after_decisions(spark, sf_dir)
    return C.change_log_diff(before, after, rules.RUN_START)


def stored_log(spark, sf_dir) -> str:
    """The change log in its store, written by two runs, with the dates before the run start merged; its path."""
    path = work_path(spark, "stored_log", uuid.uuid4().hex)
    log = materialize(change_log(spark, sf_dir))
    for n in (0, 1):
        L.write_changes(log.where(F.pmod("id", F.lit(2)) == n), path, f"r{n}")
    L.compact_log(spark, path, rules.RUN_START.date())
    return path


def q_stored_log_since(spark, sf_dir):
    """A3 + B3: the changes since the run start, from the stored log: only its dates are read."""
    return C.risk_changes_since(L.read_change_log(spark, stored_log(spark, sf_dir), since=rules.RUN_START), rules.RUN_START)


def q_stored_log_history(spark, sf_dir):
    """A3 + B4: every vendor's history from the stored log."""
    return C.vendor_change_history(L.read_change_log(spark, stored_log(spark, sf_dir)))


# --- notes --------------------------------------------------------------------------


def q_note_sink_rows(spark, sf_dir):
    return note_store(spark, sf_dir)


def q_latest_note(spark, sf_dir):
    newest = N.newest_notes(bindings.notes(spark, sf_dir))
    b = book_text(spark, sf_dir).select("book_row_id", "vendor")
    return N.attach_newest_note(b, newest).select("book_row_id", "vendor", "vendor_key", "file_label", "summary_text")


# --- alerts -------------------------------------------------------------------------


def q_change_enriched(spark, sf_dir):
    return enriched_changes(spark, sf_dir)


def q_change_payload(spark, sf_dir):
    enriched = enriched_changes(spark, sf_dir)
    newest = N.newest_notes(bindings.notes(spark, sf_dir), enriched.select(cells.vendor_key("vendor").alias("vendor_key")))
    return A.payload_sections(N.attach_newest_note(enriched, newest))


def q_alert_lines(spark, sf_dir):
    return A.alert_lines(enriched_changes(spark, sf_dir))


def q_alert_header(spark, sf_dir):
    return A.alert_header(enriched_changes(spark, sf_dir).select(A.status().alias("status")))


def q_alert_body(spark, sf_dir):
    return A.alert_pages(A.alert_lines(enriched_changes(spark, sf_dir)))


def q_alert_full_text(spark, sf_dir):
    lines = A.alert_lines(enriched_changes(spark, sf_dir))
    header = A.alert_header(lines).select("header").scalar()
    return A.alert_pages(lines).select("page_no", "page_count", "n_lines", header.alias("header"),
                                       A.full_text(header, F.col("body")).alias("full_text"))


def q_alert_empty(spark, sf_dir):
    log = change_log(spark, sf_dir)
    after_last = log.select(F.max("changed_at") + F.expr("INTERVAL 1 SECOND")).scalar()
    latest = C.latest_change_per_vendor(C.risk_changes_since(log, after_last))
    head = A.alert_header(latest.select(A.status().alias("status")))
    return head.select("n_changes", "n_new", "n_cleared", "header", F.col("header").alias("full_text"))


def q_alert_outbox(spark, sf_dir):
    lines = A.alert_lines(enriched_changes(spark, sf_dir))
    return A.alert_outbox(lines, rules.RUN_START.strftime("%Y-%m-%d %H:%M:%S"))


# --- scoring and decisions ------------------------------------------------------------


def adjusted(spark, sf_dir):
    return S.adjusted_evidence(bindings.evidence(spark, sf_dir))


def scored(spark, sf_dir):
    trace = S.rule_trace(bindings.evidence(spark, sf_dir))
    return S.risk_score(book_text(spark, sf_dir), adjusted(spark, sf_dir), trace)


def q_adjusted_evidence(spark, sf_dir):
    return adjusted(spark, sf_dir)


def q_corroborated_conditions(spark, sf_dir):
    return S.corroborated_conditions(adjusted(spark, sf_dir))


def q_risk_score(spark, sf_dir):
    return scored(spark, sf_dir).select("book_row_id", "vendor", "risk_level", "is_risk", "n_conditions", "n_excluded")


def q_risk_reason(spark, sf_dir):
    return S.risk_reason(scored(spark, sf_dir))


def validated(spark, sf_dir):
    return S.validate_decisions(S.parse_decisions(bindings.decision_payloads(spark, sf_dir)))


def q_decision_intake(spark, sf_dir):
    return S.parse_decisions(bindings.decision_payloads(spark, sf_dir))


def q_decision_validation(spark, sf_dir):
    return validated(spark, sf_dir)


def q_run_results(spark, sf_dir):
    return S.run_results(validated(spark, sf_dir))


def q_run_summary(spark, sf_dir):
    return S.run_summary(S.run_results(validated(spark, sf_dir)))


# --- news selection -----------------------------------------------------------------


def base(spark, sf_dir):
    return R.item_base(bindings.news(spark, sf_dir))


def features(spark, sf_dir):
    return R.item_features(bindings.news(spark, sf_dir))


def q_news_events(spark, sf_dir):
    """The events of every sentence, each with its own date."""
    return E.events(bindings.news(spark, sf_dir))


def confirmed(spark, sf_dir):
    return R.confirm_entities(bindings.news(spark, sf_dir), bindings.aliases(spark, sf_dir))


def q_search_worklist(spark, sf_dir):
    return R.search_worklist(book_text(spark, sf_dir), bindings.aliases(spark, sf_dir), rules.AS_OF)


def q_entity_match(spark, sf_dir):
    return confirmed(spark, sf_dir)


def q_event_dated_items(spark, sf_dir):
    return R.dated_items(base(spark, sf_dir))


def q_recent_items(spark, sf_dir):
    # lineage cut after the regex pass, so the recency filter is not pushed into (and does not
    # repeat) the text projection
    f = materialize(base(spark, sf_dir))
    return f.where(R.recency(f, rules.AS_OF)).select("item_id", "vendor", "outlet", "tier", "published_on", "event_on")


def q_scoped_items(spark, sf_dir):
    return R.scope(features(spark, sf_dir))


def q_source_tier(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages", "page_id", "url")
    host = R.url_host("url")
    return p.select("page_id", "url", host.alias("host"), R.source_tier(host, F.col("url")).alias("tier"))


def q_syndication_exact(spark, sf_dir):
    return R.syndication_exact(base(spark, sf_dir))


def q_scale_figures(spark, sf_dir):
    return R.scale_figures(bindings.news(spark, sf_dir))


def q_note_violations(spark, sf_dir):
    return R.writing_violations(bindings.news(spark, sf_dir))


def q_items_per_vendor(spark, sf_dir):
    counts = R.item_counts(materialize(base(spark, sf_dir)), confirmed(spark, sf_dir), rules.AS_OF)
    return R.items_per_vendor(book_text(spark, sf_dir), counts)


def q_indicator_match(spark, sf_dir):
    return R.indicator_matches(features(spark, sf_dir))


# --- composite plans and the stream ------------------------------------------------------


def q_monitor_run(spark, sf_dir):
    return P.monitor_run(spark, sf_dir, rules.QUEUE_K, rules.AS_OF)


def q_monitor_notes(spark, sf_dir):
    return P.run_notes(P.complete_run(spark, sf_dir))


def q_monitor_results(spark, sf_dir):
    return P.complete_run(spark, sf_dir).results


def q_monitor_book_after(spark, sf_dir):
    return P.complete_run(spark, sf_dir).book_after


def q_monitor_change_log(spark, sf_dir):
    return P.complete_run(spark, sf_dir).changes


def q_monitor_alert(spark, sf_dir):
    return P.complete_run(spark, sf_dir).alert


def q_alert_since(spark, sf_dir):
    return P.alert_since(spark, sf_dir, rules.RUN_START)


def q_manual_override(spark, sf_dir):
    return P.manual_override(spark, sf_dir, MANUAL_VENDORS, rules.RUN_START)


def _events_to_decisions(events):
    lvl = F.floor("value").cast("int") % 6
    return events.select(
        F.col("event_id").alias("decision_id"),
        bindings.supplier_name(F.col("user_id")).alias("vendor"),
        cells.floor_second("ts").alias("decided_at"),
        (lvl >= 3).alias("is_risk"),
    )


def q_flip_stream(spark, sf_dir):
    """S1 over the events file as a stream (one micro-batch here); equals E1."""
    from riskloom.sources.tables import table_path

    path = table_path(sf_dir, "events")
    schema = spark.read.parquet(path).schema
    sink = S1.run_flip_stream(spark, path + "*", _events_to_decisions, schema)
    return S1.read_flips(spark, sink).drop("batch_id")


def near_citations(spark, sf_dir):
    news = bindings.news(spark, sf_dir).select(
        "item_id", "vendor", "outlet", "tier", "published_on", "text", R.text_key("text").alias("text_key"))
    # the winners of the exact dedupe first, without texts; only their texts are shingled
    pick = F.struct("tier", F.col("published_on").isNull().alias("_u"), "published_on", "item_id")
    winners = materialize(news.groupBy("text_key").agg(F.min(pick).alias("_r")).select("_r.item_id"))
    # few losers go to the texts, so that these stay where they are read
    losers = materialize(news.select("item_id").join(winners, "item_id", "left_anti").distinct())
    texts = news.drop("text_key")
    if losers.count() <= SIM.SENT_ITEMS:
        reps = texts.where("item_id is not null").join(F.broadcast(losers), "item_id", "left_anti")
    else:
        reps = texts.join(winners, "item_id", "left_semi")
    return SIM.near_copy_citations(SIM.with_shingles(reps).drop("text"))


def q_syndication_near(spark, sf_dir):
    """R8 over the items left after exact dedupe (R7): which item each one cites."""
    return near_citations(spark, sf_dir).select(
        "item_id", "vendor", "cite_id", (F.col("cite_id") != F.col("item_id")).alias("is_copy"), "similarity")


def q_syndication_clusters(spark, sf_dir):
    """The clusters that the citations lead to, one row per representative."""
    cited = materialize(near_citations(spark, sf_dir))
    x = SIM.representatives(cited).join(cited.select("item_id", "vendor", "outlet"), "item_id")
    return x.groupBy("rep_id").agg(F.count(F.lit(1)).alias("n_items"), F.countDistinct("vendor").alias("n_vendors"), F.countDistinct("outlet").alias("n_outlets"))
