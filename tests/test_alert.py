"""Alert texts and the manual scenario of FIXTURES §2; empty-run guards."""

import datetime as dt

from pyspark.sql import functions as F

from riskloom import rules
from riskloom.operators import alert as A
from riskloom.operators import book as B
from riskloom.operators import changes as C
from riskloom.sources.outbox import append_outbox, read_outbox

RUN = dt.datetime(2024, 1, 29, 12, 0, 0)
DEC = "decision_id long, vendor string, decided_at timestamp_ntz, risk_level int, is_risk boolean, risk_reason string"


def book(spark, rows):
    raw = spark.createDataFrame(rows, "book_row_id long, vendor string, last_checked string, is_risk string, "
                                      "risk_level string, risk_reason string, last_risk_eval string")
    return B.ingest_book(raw)


def run_alert(spark, bk, decisions):
    """Flags before the run come from the book; decisions after ``RUN`` are the run."""
    seed = bk.select((-F.col("book_row_id")).alias("decision_id"), "vendor",
                     F.lit(RUN - dt.timedelta(days=1)).cast("timestamp_ntz").alias("decided_at"),
                     F.col("risk_level").cast("int").alias("risk_level"),
                     (F.col("is_risk") == "1").alias("is_risk"), "risk_reason")
    all_dec = seed.unionByName(spark.createDataFrame(decisions, DEC))
    latest = C.latest_change_per_vendor(C.risk_changes_since(C.flag_history(all_dec), RUN))
    after = B.book_upsert(bk, B.latest_per_vendor(spark.createDataFrame(decisions, DEC)))
    lines = A.alert_lines(A.enrich_changes(latest, B.typed_book(after)))
    return lines, A.alert_header(lines).first()


def test_manual_scenario(spark):
    bk = book(spark, [(1, "Vendor A", None, "1", "4", "cleared manual test", None),
                      (2, "Vendor B", None, "1", "4", "cleared manual test", None),
                      (3, "Vendor C", None, "1", "5", "cleared manual test", None)])
    t = RUN + dt.timedelta(minutes=5)
    lines, head = run_alert(spark, bk, [(11, "Vendor A", t, 1, False, "Routine results. More."),
                                        (12, "Vendor B", t, 4, True, "Covenant breach"),
                                        (13, "Vendor C", t, 2, False, None)])
    assert head.header == "0 new risks, 2 cleared"
    got = sorted(r.line for r in lines.collect())
    assert got == ["CLEARED - Vendor A: Level 1. Routine results.",
                   "CLEARED - Vendor C: Level 2. No reason recorded."]


def test_fan_out_and_unknown_vendor(spark):
    bk = book(spark, [(1, "Dup", None, "0", "1", "r", None), (2, "Dup", None, "0", "1", "r", None)])
    t = RUN + dt.timedelta(minutes=1)
    lines, head = run_alert(spark, bk, [(5, "Dup", t, 4, True, "x"), (6, "Ghost", t, 3, True, "y")])
    got = sorted((r.vendor, r.book_row_id, r.line) for r in lines.collect())
    assert got == [("Dup", 1, "NEW RISK - Dup: Level 4. x."), ("Dup", 2, "NEW RISK - Dup: Level 4. x."),
                   ("Ghost", None, "NEW RISK - Ghost: Level unknown. No reason recorded.")]
    assert head.header == "3 new risks, 0 cleared"
    assert sorted(r.alert_pos for r in lines.collect()) == [1, 2, 3]


def test_empty_run_guard_and_outbox(spark, tmp_out):
    bk = book(spark, [(1, "A", None, "0", "1", "r", None)])
    lines, head = run_alert(spark, bk, [])
    assert head.header == rules.NO_CHANGES_MESSAGE and head.n_changes == 0
    outbox = A.alert_outbox(lines, "run-1")
    assert outbox.count() == 0
    assert append_outbox(outbox, tmp_out + "/outbox", "run-1") is False
    assert read_outbox(spark, tmp_out + "/outbox") is None


def test_pages_and_full_text(spark, tmp_out):
    rows = [(i, f"V{i:03d}", None, "0", "1", "r", None) for i in range(1, 8)]
    bk = book(spark, rows)
    t = RUN + dt.timedelta(minutes=1)
    lines, head = run_alert(spark, bk, [(100 + i, f"V{i:03d}", t, 4, True, "Reason.") for i in range(1, 8)])
    pages = {r.page_no: r for r in A.alert_pages(lines, page_bytes=100).collect()}
    # lines of 38 bytes: those that begin below byte 100, 200 and 300
    assert sorted(pages) == [0, 1, 2] and [pages[p].n_lines for p in (0, 1, 2)] == [3, 3, 1] and {p.page_count for p in pages.values()} == {3}
    assert "\n".join(pages[p].body for p in (0, 1, 2)) == "\n".join(r.line for r in lines.orderBy("alert_pos").collect())
    outbox = A.alert_outbox(lines, "run-2", page_bytes=100)
    assert append_outbox(outbox, tmp_out + "/outbox", "run-2") is True
    stored = read_outbox(spark, tmp_out + "/outbox")
    first = stored.where("page_no = 0").first()
    assert first.subject == "7 new risks, 0 cleared"
    assert first.full_text == first.subject + "\n\n" + first.body


def test_pages_by_bytes_have_no_gaps(spark):
    """A line longer than a page leaves no page number out; texts of several bytes a letter count in full."""
    texts = ["a" * 10, "é" * 400, "b", "", "c" * 90, "d" * 500, "e"]
    df = spark.createDataFrame([(i + 1, t, "s" * i) for i, t in enumerate(texts)], "alert_pos long, line string, section string")
    pages = A.alert_pages(df, 100).orderBy("page_no").collect()
    assert [p.page_no for p in pages] == list(range(len(pages))) and {p.page_count for p in pages} == {len(pages)}
    assert "\n".join(p.body for p in pages) == "\n".join(texts) and len(pages) == 4
    both = A.alert_pages(df, 100, {"section": "--"}).orderBy("page_no").collect()
    assert "--".join(p.section for p in both) == "--".join("s" * i for i in range(7))
    assert A.alert_pages(df.limit(0), 100).count() == 0


def test_running_total_over_blocks(spark, monkeypatch):
    from riskloom.operators import ordering

    monkeypatch.setattr(ordering, "POSITION_BLOCK", 7)
    df = spark.range(1, 101).select(F.col("id").alias("pos"), (F.col("id") * 3 % 11).alias("v")).repartition(5)
    total, want = 0, {}
    for i in range(1, 101):
        total += i * 3 % 11
        want[i] = total
    assert {r.pos: r.t for r in ordering.running_total(df, "pos", "v", "t").collect()} == want
