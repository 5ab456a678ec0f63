"""Composite plans: the monitor run (P1), the alert since a run start (P2) and the manual
override scenario (P4). The per-vendor loop of the application becomes joins and aggregates keyed by
vendor; positions, queues and feature rows are written to the shared folder on the way.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import rules
from riskloom.functions import cells
from riskloom.operators import alert as A
from riskloom.operators import book as B
from riskloom.operators import changes as C
from riskloom.operators import news as R
from riskloom.operators import notes as N
from riskloom.operators import score as S
from riskloom.operators import similarity as SIM
from riskloom.session import materialize, path_exists
from riskloom.sources import bindings, book_store
from riskloom.sources.change_log import assign_ids, read_change_log, write_changes
from riskloom.sources.notes import write_notes
from riskloom.sources.outbox import append_outbox

EVIDENCE_IDS = 1_000_000  # evidence ids of one item
EVIDENCE_RULES = 1_000    # of one rule and item, by sentence


def news_evidence(reps: DataFrame) -> DataFrame:
    """Evidence rows from selected news items (one per item after syndication dedupe).

    Each event of a rubric condition gives a row, dated by its own date (R5); the same condition with the same
    date counts once. An in-scope item without any gives a level-1 row for its first category
    (X4). Kinds of goods in transit, and out-of-scope kinds of sentences that state nothing in scope, give
    level-0 rows, kept for the roll-up's "all out of scope" rule and the reason. All cases are one array
    per item and one explode, with no filter before it.
    """
    base = ["item_id", "vendor", "outlet", "tier", "new_models_only", "is_resolution"]

    def kind(*kinds):
        return F.filter("events", lambda e: e["kind"].isin(*kinds))

    # the first event of each name (and date): the events are in table order
    def once(array, dated):
        same = lambda a, b: (a["name"] == b["name"]) & (a["event_on"].eqNullSafe(b["event_on"]) if dated else F.lit(True))
        start = F.slice(array, 1, 0)
        return F.aggregate(array, start, lambda kept, e: F.when(F.exists(kept, lambda k: same(k, e)), kept).otherwise(F.concat(kept, F.array(e))))

    stated = F.transform(kind("in", "rubric"), lambda e: e["sent"])
    out = F.filter(kind("out", "transit"), lambda e: (e["kind"] == "transit") | ~F.array_contains(stated, e["sent"]))
    x = reps.select(*base, once(kind("rubric"), True).alias("_rubric"), F.slice(kind("in"), 1, 1).alias("_first"), once(out, False).alias("_out"))
    routine = F.when(F.size("_rubric") == 0, F.transform("_first", lambda e: e.withField("level", F.lit(1)))).otherwise(F.slice("_first", 1, 0))
    x = R.explode_rows(x, F.concat("_rubric", routine, "_out"), "e", *base)
    in_scope = F.col("e.kind").isin("in", "rubric")
    return x.select(
        (F.col("item_id") * EVIDENCE_IDS + F.col("e.ord") * EVIDENCE_RULES + F.least(F.col("e.sent"), F.lit(EVIDENCE_RULES - 1))).alias("evidence_id"),
        "vendor", F.col("e.name").alias("condition"), F.col("e.level").alias("level"),
        "outlet", "tier", in_scope.alias("in_scope"), "new_models_only",
        F.col("e.name").isin(*rules.BREACH_CONDITIONS).alias("is_breach"),
        F.col("e.name").isin(*rules.GOING_CONCERN_CONDITIONS).alias("is_going_concern"),
        "is_resolution",
        F.col("e.event_on").cast("timestamp_ntz").alias("published_at"),
    )


def select_items(features: DataFrame, confirmed: DataFrame, as_of: dt.date) -> DataFrame:
    """R2 + R3 + R7: confirmed, recent items, one per (vendor, normalised text)."""
    x = features.join(confirmed.where(F.col("confirmed")).select("item_id"), "item_id", "left_semi")
    x = x.where(R.recency(x, as_of)).withColumn("confirmed", F.lit(True))
    keep = [c for c in x.columns if c not in ("text_key", "vendor", "confirmed")]
    pick = F.struct(F.col("tier").alias("_t"), F.col("published_on").isNull().alias("_u"),
                    F.col("published_on").alias("_p"), F.col("item_id").alias("_i"), *[F.col(c) for c in keep])
    g = x.groupBy("vendor", "text_key").agg(F.min(pick).alias("_r"))
    return g.select("vendor", "text_key", *[F.col(f"_r.{c}").alias(c) for c in keep])


def select_news(spark: SparkSession, sf_dir: str, vendors: DataFrame, as_of: dt.date) -> DataFrame:
    """R2-R8 for the given vendors (at most a queue of them): the features of the news items that count.

    The vendor list is broadcast into the news scan (a bounded broadcast); everything after it is keyed by vendor.
    """
    names = F.broadcast(vendors.select("vendor").distinct())
    items = bindings.news(spark, sf_dir).join(names, "vendor", "left_semi").where(R.in_window(as_of))
    aliases = bindings.aliases(spark, sf_dir).join(names, "vendor", "left_semi")
    # one pass over the queued vendors' recent texts, written once and reused
    features = materialize(R.item_features(items))
    # syndicated coverage counts once before it corroborates anything: same texts, then edited copies
    reps = materialize(select_items(features, R.confirm_entities(items, aliases), as_of))
    return SIM.without_copies(reps, items)


def decide(queue: DataFrame, reps: DataFrame) -> DataFrame:
    """R12, R4 -> R15 -> R13 -> R14 -> R16 -> flag change against the book (C3b, C4 on is_risk, H8), one row
    per queue row. A row whose vendor has no name fails: it gets neither level nor reason (J1 tells why)."""
    evidence = materialize(news_evidence(reps))
    scored = S.risk_reason(S.risk_score(queue.select("book_row_id", "vendor"), S.adjusted_evidence(evidence), S.rule_trace(evidence)))
    scored = scored.where(F.coalesce(cells.strip("vendor"), F.lit("")) != "").drop("vendor")
    counts = reps.groupBy("vendor").agg(F.count(F.lit(1)).alias("n_items"))
    changed = ~F.col("old_flag").eqNullSafe(F.col("new_flag")) & (
        (F.coalesce(F.col("old_flag"), F.lit("")) == "1") | (F.col("new_flag") == "1"))
    out = (
        queue.select("queue_pos", "book_row_id", "vendor", F.col("is_risk").alias("old_flag"))
        .join(scored, "book_row_id", "left")
        .join(counts, "vendor", "left")
        .withColumn("new_flag", cells.flag_text("is_risk"))
    )
    return out.select(
        "queue_pos", "book_row_id", "vendor", F.coalesce(F.col("n_items"), F.lit(0)).alias("n_items"),
        "risk_level", "is_risk", "risk_reason", "old_flag", "new_flag",
        F.when(changed & F.col("new_flag").isNotNull(), A.status("new_flag")).alias("status"),
    )


def _queue(book: DataFrame, k: int) -> DataFrame:
    # the queue (at most k rows, with the old flag) is computed once: one top-k over the book
    return materialize(B.vendor_queue(book, B.clamp_batch(k), carry=("is_risk",)))


def monitor_run(spark: SparkSession, sf_dir: str, k: int = rules.QUEUE_K, as_of: dt.date = rules.AS_OF,
                book: DataFrame | None = None) -> DataFrame:
    """Queue (G1) -> news selection (R2-R8) -> evidence (R12, R4) -> R15 -> R13 -> R14
    -> R16 -> decision rows -> flag change against the book (C3b, C4 on is_risk, H8)."""
    book = B.ingest_book(bindings.book_raw(spark, sf_dir)) if book is None else book
    queue = _queue(book, k)
    return decide(queue, select_news(spark, sf_dir, queue, as_of))


TIER_NAMES = {1: "primary source", 2: "trade press", 3: "general press"}
NOTHING_FOUND = "No news in scope found."


def research_notes(vendors: DataFrame, reps: DataFrame) -> DataFrame:
    """(vendor, text): what the selected news states, one line per event name and date, newest first.

    A line names the event, its date, how many items state it and the most authoritative of their sources, so a
    note is bounded by the rules and the days, not by the number of items. Vendors without news say so.
    """
    e = R.explode_rows(reps.withColumn("e", F.filter("events", lambda x: x["kind"].isin("in", "rubric"))), "e", "x", "vendor", "outlet", "tier", "item_id")
    lines = e.groupBy("vendor", F.col("x.event_on").alias("day"), F.col("x.name").alias("name")).agg(
        F.countDistinct("item_id").alias("n"), F.min(F.struct("tier", "outlet")).alias("s"))
    tier = F.coalesce(*[F.when(F.col("s.tier") == t, F.lit(name)) for t, name in TIER_NAMES.items()], F.lit(TIER_NAMES[rules.UNKNOWN_TIER]))
    text = F.concat(F.lit("- "), F.coalesce(F.col("day").cast("string"), F.lit("undated")), F.lit(": "), F.translate("name", "_", " "), F.lit(", "), F.col("n").cast("string"),
                    F.when(F.col("n") == 1, F.lit(" item, ")).otherwise(F.lit(" items, ")), F.coalesce("s.outlet", F.lit("unnamed")), F.lit(" ("), tier, F.lit(")"))
    order = F.struct((-F.coalesce(F.unix_date("day"), F.lit(-1 << 30))).alias("d"), "name", text.alias("line"))
    notes = lines.groupBy("vendor").agg(F.sort_array(F.collect_list(order)).alias("lines"))
    body = F.array_join(F.transform("lines", lambda r: r["line"]), "\n")
    return vendors.select("vendor").distinct().join(notes, "vendor", "left").select("vendor", F.coalesce(body, F.lit(NOTHING_FOUND)).alias("text"))


@dataclass(frozen=True)
class Run:
    """What a monitor run leaves behind, as DataFrames over one written decision table."""

    research: DataFrame   # vendor, text: the notes of the run
    decisions: DataFrame  # decision_id (queue position), vendor, decided_at, risk_level, is_risk, risk_reason
    results: DataFrame    # U1 rows
    book_before: DataFrame
    book_after: DataFrame  # C3a then C3b
    changes: DataFrame     # C4 rows with ids (E2)
    alert: DataFrame       # A6 rows


def complete_run(spark: SparkSession, sf_dir: str, book: DataFrame | None = None, k: int = rules.QUEUE_K,
                 as_of: dt.date = rules.AS_OF, run_start: dt.datetime = rules.RUN_START, last_id: int = 0) -> Run:
    """P1 to its end: research, decide (``monitor_run``), record results, touch and update the book, audit the
    changed cells, number them, and render the alert of the run's flag changes."""
    book = B.ingest_book(bindings.book_raw(spark, sf_dir)) if book is None else book
    queue = _queue(book, k)
    reps = materialize(select_news(spark, sf_dir, queue, as_of))
    decided = materialize(decide(queue, reps))
    decisions = decided.select(
        F.col("queue_pos").alias("decision_id"), "vendor", cells.ts_lit(run_start).alias("decided_at"),
        "risk_level", "is_risk", "risk_reason")
    results = S.run_results(S.validate_decisions(decisions.drop("is_risk")))
    # a vendor that failed keeps its fields; its error row is in the results
    scored = decisions.where("risk_level is not null")
    checked = scored.select("vendor", F.col("decided_at").alias("checked_at"))
    after = B.book_upsert(B.book_touch(book, checked), B.latest_per_vendor(scored))
    changes = materialize(assign_ids(C.change_log_diff(book, after, run_start), last_id))
    latest = C.latest_change_per_vendor(C.risk_changes_since(changes, run_start))
    lines = A.alert_lines(A.enrich_changes(latest, B.typed_book(after)))
    return Run(research_notes(scored, reps), decisions, results, book, after, changes, A.alert_outbox(lines, run_start.strftime("%Y-%m-%d %H:%M:%S")))


def run_notes(run: Run, run_start: dt.datetime = rules.RUN_START) -> DataFrame:
    """A4 rows of a run: one note per processed vendor, its text the research behind the decision. Of vendors
    that share a note folder the last of the queue writes last."""
    at = cells.ts_lit(run_start)
    writes = run.decisions.join(run.research, "vendor").select(
        cells.vendor_key("vendor").alias("vendor_key"), cells.note_file_name(at).alias("file_name"), F.col("decision_id").alias("write_seq"), "text")
    return N.dedupe_note_writes(writes).withColumns({"noted_at": at, "note_date": at.cast("date")})


def run_and_store(spark: SparkSession, sf_dir: str, root: str, k: int = rules.QUEUE_K, as_of: dt.date = rules.AS_OF,
                  run_start: dt.datetime = rules.RUN_START) -> Run:
    """A run through the stores under ``root``: book, change log, notes, results and outbox.

    The run's base version of the book is recorded first, so a replay of the same run starts from the
    same book and writes the same version, log rows and pages again instead of adding any.
    """
    run_id = run_start.strftime("%Y-%m-%dT%H-%M-%S")
    store, log = f"{root}/book", f"{root}/changes"
    book_store.seed_book(spark, bindings.book_raw(spark, sf_dir), store)
    mark = f"{root}/runs/run_id={run_id}"
    if not path_exists(spark, f"{mark}/_SUCCESS"):
        base = book_store.versions(spark, store)[-1]
        spark.createDataFrame([(base,)], "base_version int").write.mode("overwrite").parquet(mark)
    base = spark.read.parquet(mark).first()["base_version"]
    book = book_store.read_book(spark, store, base)
    last_id = read_change_log(spark, log, with_run=True).where(F.col("run_id") != run_id).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    run = complete_run(spark, sf_dir, book, k, as_of, run_start, int(last_id))
    write_notes(run_notes(run, run_start), f"{root}/notes", run_id)
    run.results.write.mode("overwrite").parquet(f"{root}/results/run_id={run_id}")
    write_changes(run.changes, log, run_id)
    append_outbox(run.alert, f"{root}/outbox", run_id)
    book_store.publish_book(spark, run.book_after, store, base + 1)
    return run


def alert_since(spark: SparkSession, sf_dir: str, since: dt.datetime = rules.RUN_START,
                page_bytes: int = rules.ALERT_PAGE_BYTES) -> DataFrame:
    """B3 -> D1 -> C1 -> C2 -> H8-H11 -> D3, D5 -> A6 rows. One row per alert page:
    subject (header), body (alert lines), full text and the payload sections it summarises."""
    log = C.flag_history(bindings.decisions(spark, sf_dir))
    latest = C.latest_change_per_vendor(C.risk_changes_since(log, since))
    book_now = B.book_upsert(B.ingest_book(bindings.book_raw(spark, sf_dir)),
                             B.latest_per_vendor(bindings.decisions(spark, sf_dir)))
    enriched = A.enrich_changes(latest, B.typed_book(book_now))
    # the notes of the changed vendors only, their texts last
    newest = N.newest_notes(bindings.notes(spark, sf_dir), latest.select(cells.vendor_key("vendor").alias("vendor_key")))
    with_notes = N.attach_newest_note(enriched, newest).withColumn("section", A.section_text())
    lines = A.alert_lines(with_notes, carry=("section",))
    header = A.alert_header(lines.select("status")).select("header").scalar()
    pages = A.alert_pages(lines, page_bytes, {"section": rules.SECTION_SEPARATOR})
    return pages.select(
        F.lit(since.strftime("%Y-%m-%d %H:%M:%S")).alias("run_id"), "page_no", "page_count", "n_lines",
        header.alias("subject"), "body", A.full_text(header, F.col("body")).alias("full_text"), F.col("section").alias("payload"),
    )


# Fixed values of the manual scenario: levels set by hand before the run (all flagged).
MANUAL_LEVELS = (4, 4, 5)
MANUAL_REASON = "cleared manual test"
MANUAL_OFFSET = dt.timedelta(minutes=1)


def manual_override(spark: SparkSession, sf_dir: str, vendors, since: dt.datetime = rules.RUN_START) -> DataFrame:
    """An explicit vendor list (B7) is set to flagged by hand just before the run, then
    the run's real decisions arrive; the alert reports the flips since the run start."""
    book = B.ingest_book(bindings.book_raw(spark, sf_dir))
    names = spark.createDataFrame([(v, lvl) for v, lvl in zip(vendors, MANUAL_LEVELS)], "vendor string, manual_level int")
    names = F.broadcast(names)  # the hand-written list: bounded by its length
    subset = B.vendor_subset(book, names)
    override = subset.select("book_row_id", "vendor").join(names, "vendor").select(
        (-F.col("book_row_id")).alias("decision_id"), "vendor",
        cells.ts_lit(since - MANUAL_OFFSET).alias("decided_at"), F.col("manual_level").alias("risk_level"),
        S.risk_flag(F.col("manual_level")).alias("is_risk"), F.lit(MANUAL_REASON).alias("risk_reason"),
    )
    real = bindings.decisions(spark, sf_dir).join(names.select("vendor"), "vendor", "left_semi")
    decisions = override.unionByName(real)
    log = C.flag_history(decisions)
    latest = C.latest_change_per_vendor(C.risk_changes_since(log, since))
    book_now = B.book_upsert(subset, B.latest_per_vendor(decisions))
    lines = A.alert_lines(A.enrich_changes(latest, B.typed_book(book_now)))
    header = A.alert_header(lines.select("status")).select("header").scalar()
    return lines.select("alert_pos", "id", "vendor", "book_row_id", "status", "line", header.alias("header"))

