"""The whole monitor run through its stores: two runs and a replay."""

import datetime as dt

from riskloom import rules
from riskloom.plans import monitor as P
from riskloom.sources import book_store
from riskloom.sources.change_log import read_change_log
from riskloom.sources.notes import read_notes
from riskloom.sources.outbox import read_outbox
from tests.conftest import SF_SMALL


def _state(spark, root):
    book = sorted(map(tuple, book_store.read_book(spark, f"{root}/book").collect()), key=str)
    log = sorted(map(tuple, read_change_log(spark, f"{root}/changes", with_run=True).collect()), key=str)
    notes = sorted((r.vendor_key, r.file_name, r.text) for r in read_notes(spark, f"{root}/notes").collect())
    pages = read_outbox(spark, f"{root}/outbox")
    return book_store.versions(spark, f"{root}/book"), book, log, notes, pages and sorted(map(tuple, pages.collect()), key=str)


def test_two_runs_and_a_replay(spark, tmp_out):
    second = rules.RUN_START + dt.timedelta(days=1)
    P.run_and_store(spark, SF_SMALL, tmp_out, k=3)
    first = _state(spark, tmp_out)
    P.run_and_store(spark, SF_SMALL, tmp_out, k=3, run_start=second)
    after = _state(spark, tmp_out)
    assert first[0] == [0, 1] and after[0] == [0, 1, 2]
    ids = [r[0] for r in after[2]]
    assert len(ids) == len(set(ids)) and len(after[2]) > len(first[2])
    assert {r[0] for r in first[3]} != {r[0] for r in after[3]}  # the second run takes the next vendors
    P.run_and_store(spark, SF_SMALL, tmp_out, k=3, run_start=second)
    assert _state(spark, tmp_out) == after


def test_the_note_of_a_run_is_its_research(spark, tmp_out):
    run = P.run_and_store(spark, SF_SMALL, tmp_out, k=8)
    notes = {r.vendor_key: r.text for r in read_notes(spark, f"{tmp_out}/notes").collect()}
    reasons = {r.vendor: r.risk_reason for r in run.decisions.collect()}
    assert set(notes) == set(reasons) and not set(notes.values()) & set(reasons.values())
    levels = {r.vendor: r.risk_level for r in run.decisions.collect()}
    for vendor, text in notes.items():
        assert (text == P.NOTHING_FOUND) or all(line.startswith("- ") for line in text.split("\n"))
        if levels[vendor] > 1:
            assert text != P.NOTHING_FOUND


def test_a_vendor_that_fails_gives_an_error_row_and_the_run_goes_on(spark):
    from riskloom.operators import book as B
    from riskloom.sources import bindings

    book = B.ingest_book(bindings.book_raw(spark, SF_SMALL))
    odd = book.limit(1).selectExpr("-1L as book_row_id", "'\u3000 ' as vendor", *[f"cast(null as string) as {c}" for c in book.columns[2:]])
    run = P.complete_run(spark, SF_SMALL, book.unionByName(odd), k=5)
    results = {r.vendor: r for r in run.results.collect()}
    assert len(results) == 5
    bad = results["\u3000 "]
    assert bad.reason == "Error: missing level" and bad.flagged is None and bad.research_file == ""
    assert sum(r.flagged is not None for r in results.values()) == 4
    after = {r.book_row_id: r for r in run.book_after.collect()}
    assert after[-1].last_checked is None and after[-1].risk_level is None
    assert run.changes.where("vendor = '\u3000 '").count() == 0
