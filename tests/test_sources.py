"""Sources and sinks: book snapshots (A1, A2, C3), change-log append (A3, E2), notes (A4, A5),
decision files (A8)."""

import datetime as dt
import os

from pyspark.sql import functions as F

from riskloom.operators import book as B
from riskloom.operators import changes as C
from riskloom.operators import notes as N
from riskloom.sources import book_store, change_log
from riskloom.sources import notes as note_io
from riskloom.sources.decisions import read_decision_files

RUN = dt.datetime(2024, 1, 29, 12, 0, 0)


def test_book_store_seed_once_and_versions(spark, tmp_out):
    csv = os.path.join(tmp_out, "book.csv")
    with open(csv, "w") as f:
        f.write("vendor,category,last_checked,is_risk,risk_level,risk_reason,last_risk_eval\n")
        f.write("A,Audio,2024-01-02 00:00:00,yes,3,r,\n")
        f.write("B,Display,,0.0,1,,\n")
    store = os.path.join(tmp_out, "store")
    raw = book_store.read_tabular(spark, csv)
    assert book_store.seed_book(spark, raw, store) == 0
    assert book_store.seed_book(spark, raw, store) == 0          # second run: no re-seed
    snap = book_store.read_book(spark, store)
    assert sorted((r.vendor, r.is_risk) for r in snap.collect()) == [("A", "1"), ("B", "0")]
    touched = B.book_touch(snap, spark.createDataFrame([("A", RUN)], "vendor string, checked_at timestamp_ntz"))
    assert book_store.publish_book(spark, touched, store) == 1
    now = {r.vendor: r.last_checked for r in book_store.read_book(spark, store).collect()}
    assert now == {"A": "2024-01-29 12:00:00", "B": None}


def test_book_upsert_overwrites_with_null_and_ignores_unknown(spark):
    bk = B.ingest_book(spark.createDataFrame(
        [(1, "A", "1", "3", "old", None), (2, "A", "1", "3", "old", None), (3, "B", "0", "1", "keep", None)],
        "book_row_id long, vendor string, is_risk string, risk_level string, risk_reason string, last_risk_eval string"))
    dec = spark.createDataFrame([("A", RUN, 1, False, None), ("Z", RUN, 5, True, "ghost")],
                                "vendor string, decided_at timestamp_ntz, risk_level int, is_risk boolean, risk_reason string")
    got = sorted(tuple(r) for r in B.book_upsert(bk, dec).collect())
    assert got == [(1, "A", "0", "1", None, "2024-01-29 12:00:00"), (2, "A", "0", "1", None, "2024-01-29 12:00:00"),
                   (3, "B", "0", "1", "keep", None)]


def test_change_log_append_ids_and_rerun(spark, tmp_out):
    schema = "book_row_id long, vendor string, is_risk string, risk_level string"
    before = spark.createDataFrame([(1, "A", "0", "1"), (2, "B", "1", "4")], schema)
    after = spark.createDataFrame([(1, "A", "1", "4"), (2, "B", "1", "4")], schema)
    delta = C.change_log_diff(before, after, RUN)
    path = os.path.join(tmp_out, "log")
    rows = change_log.append_changes(spark, delta, path, "r1")
    assert sorted((r.id, r.field) for r in rows.collect()) == [(1, "is_risk"), (2, "risk_level")]
    change_log.append_changes(spark, delta, path, "r1")            # rerun: replaced, not duplicated
    change_log.append_changes(spark, C.change_log_diff(after, before, RUN), path, "r2")
    log = change_log.read_change_log(spark, path)
    assert sorted(r.id for r in log.collect()) == [1, 2, 3, 4]


def test_note_sink_and_file_source(spark, tmp_out):
    base = os.path.join(tmp_out, "Research")
    for vendor, stamp, text in [("Acme", "2024-01-02_03-04-05", "first\nnote"), ("Acme", "2024-01-03_00-00-00", "second"),
                                ("B-C", "2024-01-01_00-00-00", "# title\n\nbody")]:
        os.makedirs(os.path.join(base, vendor), exist_ok=True)
        with open(os.path.join(base, vendor, f"research_{stamp}.md"), "w", encoding="utf-8") as f:
            f.write(text)
    with open(os.path.join(base, "Acme", "notes.txt"), "w") as f:
        f.write("ignored")
    files = note_io.read_note_files(spark, base)
    assert files.count() == 3
    newest = {r.vendor_key: (r.file_label, r.summary_text) for r in N.newest_notes(files).collect()}
    assert newest == {"Acme": ("research_2024-01-03_00-00-00.md", "second"),
                      "B-C": ("research_2024-01-01_00-00-00.md", "# title\n\nbody")}
    store = os.path.join(tmp_out, "notes")
    note_io.write_notes(files.withColumn("note_date", F.to_date("noted_at")), store, "r1")
    assert note_io.read_notes(spark, store).count() == 3
    looked = N.attach_newest_note(spark.createDataFrame([("B/C",), ("Nobody",)], "vendor string"), N.newest_notes(files))
    got = {r.vendor: r.file_label for r in looked.collect()}
    assert got == {"B/C": "research_2024-01-01_00-00-00.md", "Nobody": "N/A"}


def test_decision_files(spark, tmp_out):
    p = os.path.join(tmp_out, "decisions.jsonl")
    with open(p, "w") as f:
        f.write('{"Risk_Reason": "Plant fire", "Risk_level": 4}\n{"Risk_level": 9}\nnot json\n')
    got = sorted((r.risk_level if r.risk_level is not None else -9, r.risk_reason or "")
                 for r in read_decision_files(spark, p).collect())
    assert got == [(-9, ""), (4, "Plant fire"), (9, "")]


CHANGE = "id long, changed_at timestamp_ntz, vendor string, field string, old_value string, new_value string"


def _changes(spark, rows):
    return spark.createDataFrame([(i, RUN + dt.timedelta(days=d), v, "is_risk", "0", "1") for i, d, v in rows], CHANGE)


def _stored(spark, path):
    return sorted((r.id, r.vendor, r.changed_at) for r in change_log.read_change_log(spark, path).collect())


def test_compaction_keeps_every_row_once_at_any_point(spark, tmp_out, monkeypatch):
    import pytest

    path = os.path.join(tmp_out, "log")
    for n in range(3):
        change_log.write_changes(_changes(spark, [(10 * n + k, k, f"V{k}") for k in range(4)]), path, f"r{n}")
    whole = _stored(spark, path)
    assert len(whole) == 12
    write = change_log._write

    def stops_behind_the_write(*args):
        write(*args)
        raise RuntimeError("stopped")

    def stops_at_the_delete(*args):
        raise RuntimeError("stopped")

    for name, broken in (("_write", stops_behind_the_write), ("delete_path", stops_at_the_delete), ("delete_path", stops_at_the_delete)):
        with monkeypatch.context() as m:
            m.setattr(change_log, name, broken)
            with pytest.raises(RuntimeError):
                change_log.compact_log(spark, path, (RUN + dt.timedelta(days=2)).date())
        assert _stored(spark, path) == whole
    change_log.compact_log(spark, path, (RUN + dt.timedelta(days=2)).date())
    assert _stored(spark, path) == whole
    folders = change_log.live_folders(spark, path)
    assert [len(v) for v in folders.values()] == [1, 1, 3, 3]
    with pytest.raises(ValueError):  # a merged run is closed
        change_log.write_changes(_changes(spark, [(1, 0, "X")]), path, "r1")
    change_log.write_changes(_changes(spark, [(90, 0, "late")]), path, "r9")
    change_log.compact_log(spark, path, (RUN + dt.timedelta(days=2)).date())
    assert len(_stored(spark, path)) == 13 and [len(v) for v in change_log.live_folders(spark, path).values()] == [1, 1, 3, 3]


def test_a_rerun_moves_its_rows_between_dates(spark, tmp_out):
    path = os.path.join(tmp_out, "log")
    change_log.write_changes(_changes(spark, [(1, 0, "A"), (2, 1, "B")]), path, "r1")
    change_log.write_changes(_changes(spark, [(3, 0, "C")]), path, "r2")
    change_log.write_changes(_changes(spark, [(1, 1, "A")]), path, "r1")
    assert [(i, v) for i, v, _ in _stored(spark, path)] == [(1, "A"), (3, "C")]
    since = change_log.read_change_log(spark, path, since=RUN + dt.timedelta(days=1))
    assert [r.id for r in since.collect()] == [1]
    assert change_log.read_change_log(spark, os.path.join(tmp_out, "none")).count() == 0


def test_newest_note_is_the_last_write_of_the_newest_file(spark):
    rows = [("A", "research_1.md", 1, "a1"), ("A", "research_2.md", 2, "old"), ("A", "research_2.md", 5, "new"), ("B", "research_1.md", 3, "b"), ("C", "research_9.md", 4, None)]
    df = spark.createDataFrame(rows, "vendor_key string, file_name string, write_seq long, text string")
    got = {r.vendor_key: (r.file_label, r.summary_text) for r in N.newest_notes(df).collect()}
    assert got == {"A": ("research_2.md", "new"), "B": ("research_1.md", "b"), "C": ("research_9.md", None)}
    keys = spark.createDataFrame([("A",), ("A",), ("Z",)], "vendor_key string")
    assert [r.vendor_key for r in N.newest_notes(df, keys).collect()] == ["A"]
