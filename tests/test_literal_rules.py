"""Literal expected values for rules where both the Spark plans and their SQL twins read the same rule tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskloom import rules
from riskloom.functions import cells
from riskloom.operators import alert as A
from riskloom.operators import changes as C
from riskloom.operators import news as R
from riskloom.operators import score as S
from riskloom.plans.monitor import news_evidence
from riskloom.sources import book_store, notes, outbox

AS_OF = rules.AS_OF


def _items(spark, texts, published=AS_OF):
    return spark.createDataFrame([(i, "V", "o", 3, published, t) for i, t in enumerate(texts)],
                                 "item_id long, vendor string, outlet string, tier int, published_on date, text string")


CONDITIONS = {
    "The vendor filed for bankruptcy.": ("insolvency_proceeding", 5), "It was declared insolvent": ("insolvency_proceeding", 5),
    "The maker entered administration": ("administration", 5), "UK CVA approved": ("administration", 5),
    "an emergency discounted equity raise": ("emergency_equity_raise", 4), "a product recall was issued": ("major_recall", 4),
    "The vendor was acquired by a rival": ("ownership_change", 3), "Filed for Chapter 11 protection; freight rates rose.": ("insolvency_proceeding", 5),
}


def test_rubric_phrases(spark):
    texts = list(CONDITIONS)
    got = {(r.item_id, r.condition, r.level) for r in R.indicator_matches(R.item_features(_items(spark, texts))).collect()}
    assert all((i, *CONDITIONS[t]) in got for i, t in enumerate(texts))
    none = _items(spark, ["customers recall the launch fondly", "The vendor acquired a rival", "破産 の 話"])
    assert R.indicator_matches(R.item_features(none)).where("condition in ('major_recall', 'ownership_change')").count() == 0


def test_transit_excludes_its_own_event_only(spark):
    f = R.item_features(_items(spark, ["Filed for Chapter 11 protection; freight rates rose.", "a factory fire in bad weather", "port congestion"]))
    assert {r.item_id: r.in_scope for r in R.scope(f).collect()} == {0: True, 1: True, 2: False}
    rows = {(r.vendor, r.condition, r.level, r.in_scope) for r in news_evidence(f.where("item_id = 0")).collect()}
    assert rows == {("V", "insolvency_proceeding", 5, True), ("V", "goods_in_transit", 0, False)}


def test_evidence_is_dated_by_the_event(spark):
    f = R.item_features(_items(spark, ["covenant breach on 2023-11-02 reported"]))
    assert {r.published_at for r in news_evidence(f).collect()} == {dt.datetime(2023, 11, 2)}


def test_amounts_with_units_and_currencies(spark):
    texts = ["$5M", "$2.5B", "$12 Million", "€3bn", "USD 4 thousand", "£7", "1,200 Employees"]
    got = {r.item_id: str(r.amount) for r in R.scale_figures(_items(spark, texts)).collect()}
    assert got == {0: "5000000.00", 1: "2500000000.00", 2: "12000000.00", 3: "3000000000.00", 4: "4000.00", 5: "7.00", 6: "1200.00"}


def test_curly_quotes_count(spark):
    long = " ".join(["word"] * 20)
    got = R.writing_violations(_items(spark, [f"“{long}”", f'"{long}"', f"„{long}“"])).where("rule = 'long_quote'")
    assert sorted(r.item_id for r in got.collect()) == [0, 1, 2]


def test_texts_in_other_scripts_stay_apart(spark):
    f = R.item_features(_items(spark, ["工厂 关闭", "公司 破产", "завод закрыт", "Завод  закрыт!"]))
    assert sorted(r.cluster_size for r in R.syndication_exact(f).collect()) == [1, 1, 2]


@pytest.mark.parametrize("url,tier", [
    ("https://find.company-information.service.gov.uk/x", 1), ("https://ec.europa.eu/y", 1), ("https://acme.com/newsroom/item", 1),
    ("https://ir.acme.com/", 1), ("https://steeltrade-weekly.com/a", 2), ("https://kittens.org/a", 3), ("https://blog.acme.com/a", 3)])
def test_source_tiers(spark, url, tier):
    df = spark.createDataFrame([(url,)], "url string")
    assert df.select(R.source_tier(R.url_host("url"), F.col("url")).alias("t")).first().t == tier


def test_cells_lose_all_white_space_at_their_ends(spark):
    df = spark.createDataFrame([("\tyes\n", "\tAcme\n"), ("no ", "\n"), ("　TRUE", "a/b ")], "flag string, name string")
    got = df.select(cells.parse_flag("flag").alias("f"), cells.vendor_key("name").alias("k")).collect()
    assert [tuple(r) for r in got] == [(True, "Acme"), (False, "unknown"), (True, "a-b")]
    day = spark.createDataFrame([(dt.date(2024, 3, 10),)], "d date")
    assert day.select(cells.canonical_cell("d", day.schema["d"].dataType).alias("c")).first().c == "2024-03-10 00:00:00"


def test_times_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([(dt.datetime(2024, 3, 10, 2, 30, 0, 999),)], "t timestamp_ntz")
        r = df.select(cells.timestamp_text("t").alias("text"), cells.note_file_name("t").alias("name"), cells.floor_second("t").alias("s"),
                      cells.note_time(cells.note_file_name("t")).alias("back")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    at = dt.datetime(2024, 3, 10, 2, 30)
    assert (r.text, r.name, r.s, r.back) == ("2024-03-10 02:30:00", "research_2024-03-10_02-30-00.md", at, at)


def test_first_sentence_keeps_abbreviations(spark):
    cases = {"Acme Inc. filed for Chapter 11. More.": "Acme Inc. filed for Chapter 11.", "U.S. sanctions hit the vendor.": "U.S. sanctions hit the vendor.",
             "Plain. Second.": "Plain.", "no stop": "no stop."}
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert {r.c: r.s for r in df.select("c", A.first_sentence(F.col("c")).alias("s")).collect()} == cases


def test_latest_change_follows_the_order_of_the_log(spark):
    t = dt.datetime(2024, 1, 1, 13)
    d = spark.createDataFrame([(10, "A", t, True), (5, "A", t + dt.timedelta(hours=1), False)], "decision_id long, vendor string, decided_at timestamp_ntz, is_risk boolean")
    latest = C.latest_change_per_vendor(C.flag_history(d)).first()
    assert (latest.id, latest.old_value, latest.new_value) == (5, "1", "0")


def test_rows_without_time_or_vendor_keep_their_flips(spark):
    t = dt.datetime(2024, 1, 1, 13)
    d = spark.createDataFrame([(1, "A", None, True), (2, "A", t, False), (3, None, t, True)], "decision_id long, vendor string, decided_at timestamp_ntz, is_risk boolean")
    got = sorted((r.id, r.old_value, r.new_value) for r in C.flag_history(d).collect())
    assert got == [(1, None, "1"), (2, "1", "0"), (3, None, "1")]


def test_only_committed_book_versions_count(spark, tmp_out):
    raw = spark.createDataFrame([("V", "1")], "vendor string, is_risk string")
    store = f"{tmp_out}/book"
    spark.range(1).write.parquet(f"{store}/version=0")
    import os

    os.remove(f"{store}/version=0/_SUCCESS")
    assert book_store.versions(spark, store) == []
    assert book_store.seed_book(spark, raw.selectExpr("1L as book_row_id", "*"), store) == 0
    assert book_store.read_book(spark, store).first().vendor == "V"


def test_a_note_written_twice_is_read_once(spark, tmp_out):
    rows = [("k", "research_2024-01-01_00-00-00.md", n, dt.datetime(2024, 1, 1), dt.date(2024, 1, 1), f"text {n}") for n in (1, 2)]
    df = spark.createDataFrame(rows, "vendor_key string, file_name string, write_seq long, noted_at timestamp_ntz, note_date date, text string")
    for _ in range(2):
        notes.write_notes(df, f"{tmp_out}/notes", "r")
    assert [r.text for r in notes.read_notes(spark, f"{tmp_out}/notes").collect()] == ["text 2"]


def test_an_empty_rerun_clears_its_pages(spark, tmp_out):
    rows = spark.createDataFrame([("r", 0, "b")], "run_id string, page_no long, body string")
    path = f"{tmp_out}/outbox"
    assert outbox.append_outbox(rows, path, "r") and outbox.read_outbox(spark, path).count() == 1
    assert not outbox.append_outbox(rows.limit(0), path, "r") and outbox.read_outbox(spark, path).count() == 0


def test_score_keeps_the_level_of_one_strong_primary_event(spark):
    f = R.item_features(_items(spark, ["Filed for Chapter 11 protection; freight rates rose."]).withColumn("tier", F.lit(1)))
    book = spark.createDataFrame([(1, "V")], "book_row_id long, vendor string")
    r = S.risk_reason(S.risk_score(book, S.adjusted_evidence(news_evidence(f)))).first()
    assert r.risk_level == 5 and "insolvency_proceeding" in r.risk_reason and "goods_in_transit" in r.risk_reason


def test_a_book_with_spreadsheet_headers_is_queued(spark, tmp_out):
    from riskloom.operators import book as B

    path = f"{tmp_out}/book.csv"
    with open(path, "w") as f:
        f.write("Company / Brand,Category,HQ Country,Last Checked Date,Risk_level,is_risk,Risk_Reason,Last Risk Eval,Notes\n")
        f.write("Acme,Audio,DE,2024-01-02 00:00:00,4,TRUE,late filing,,x\nBeta,,,,,no,,,\n")
    book = B.ingest_book(book_store.with_row_key(book_store.read_tabular(spark, path)))
    assert "Notes" in book.columns
    assert [(r.vendor, r.queue_pos) for r in B.vendor_queue(book, 5).orderBy("queue_pos").collect()] == [("Beta", 1), ("Acme", 2)]
    view = {r.vendor: (r.is_risk, r.risk_level) for r in B.typed_book(book).collect()}
    assert view == {"Acme": (True, 4.0), "Beta": (False, None)}


# --- events by sentence -------------------------------------------------------------------

# Every condition of the scale, in two word orders.
TWO_ORDERS = {
    "sector_downturn": ("a sector downturn", "the downturn of the sector"), "revenue_decline": ("a revenue decline without liquidity strain", "declining revenue"),
    "leadership_change": ("CEO departure", "departure of the CEO"), "longer_lead_times": ("longer lead times", "lead times grew longer"),
    "relocation": ("announced relocation of the office", "the office is relocated"),
    "sustained_losses": ("sustained losses", "losses sustained over four quarters"), "negative_cash_flow": ("negative operating cash flow", "operating cash flow turned negative"),
    "covenant_pressure": ("leverage near covenant limits", "covenants near their limits"), "speculative_downgrade": ("rating cut to junk", "junk rating after a downgrade"),
    "drawn_revolver": ("drew its revolver", "the revolver was fully drawn"), "layoffs": ("cost-cutting layoffs", "laid off 40 people"),
    "asset_sales": ("sold off assets", "asset sales for cash"), "regulatory_proceeding": ("regulatory proceeding opened", "proceedings by the regulator"),
    "certification_review": ("certification under review", "review of its certification"), "single_source_shortage": ("single-source shortage", "shortage at a single source"),
    "ownership_change": ("change of control", "control has changed"), "going_concern": ("going-concern qualification", "doubt as a going concern"),
    "covenant_breach": ("covenant breach", "breach of a covenant"), "late_filing": ("late in filing accounts", "statutory filing is late"),
    "auditor_resignation": ("auditor resignation", "resignation of the auditor"), "restructuring_advisors": ("restructuring advisors engaged", "advisers on restructuring"),
    "missed_interest_payment": ("missed interest payment", "interest payment missed"), "negative_equity": ("negative shareholders' equity", "equity turned negative"),
    "delisting_notice": ("delisting notice", "notice of delisting"), "emergency_equity_raise": ("emergency discounted equity raise", "raised equity in an emergency"),
    "restricted_party_listing": ("added to the FCC Covered List", "on the Entity List since May"), "uflpa_detention": ("goods detained by customs", "UFLPA detention"),
    "plant_closure_or_fire": ("fire at a plant", "plant fire"), "lost_certification": ("lost UL certification", "certification was lost"),
    "shipment_delays": ("shipments were delayed", "delayed shipments"), "major_recall": ("major recall", "recall of all displays"),
    "insolvency_proceeding": ("filed for Chapter 11", "Chapter 7 petition"), "administration": ("entered administration", "administrators were appointed"),
    "receivership": ("receiver appointed", "appointed a receiver"), "payment_default": ("payment default", "defaulted on its bonds"),
    "liquidation": ("went into liquidation", "the company was wound up"), "ceased_trading": ("ceased trading", "trading has ceased"),
    "trade_ban": ("import ban with no carve-out", "banned from import"), "ceased_manufacturing": ("ceased manufacturing", "manufacturing has ceased"),
    "revoked_authorization": ("revoked authorization on shipping models", "authorization was revoked"),
}


def _conditions(spark, texts):
    got = {i: set() for i in range(len(texts))}
    for r in R.indicator_matches(R.item_features(_items(spark, texts))).collect():
        got[r.item_id].add((r.condition, r.level))
    return [got[i] for i in range(len(texts))]


def test_every_condition_in_two_word_orders(spark):
    level = {name: lvl for name, kind, lvl, *_ in rules.EVENT_RULES if kind == "rubric"}
    cases = [(c, t) for c, pair in TWO_ORDERS.items() for t in pair]
    got = _conditions(spark, [t for _, t in cases])
    assert [(c, t) for (c, t), found in zip(cases, got) if (c, level[c]) not in found] == []


def test_negated_lifted_and_unrelated_phrases_state_nothing(spark):
    texts = ["No layoffs are planned.", "The going concern doubt was lifted.", "see chapter 11 of the annual report", "acquisition by issuing bonds",
             "It denied bankruptcy.", "The plant closure was averted.", "customers recall the launch fondly"]
    assert [{c for c, lvl in found if lvl > 1} for found in _conditions(spark, texts)] == [set()] * len(texts)
    texts = ["No layoffs are planned. The plant fire goes on.", "The going concern doubt was not lifted.", "import ban with a carve-out for old stock", "import ban with no carve-out",
             "It never recovered. It filed for bankruptcy."]
    assert _conditions(spark, texts) == [{("plant_closure_or_fire", 4)}, {("going_concern", 4)}, {("trade_restriction", 4)}, {("trade_ban", 5)}, {("insolvency_proceeding", 5)}]


def test_words_of_other_sentences_do_not_combine(spark):
    assert _conditions(spark, ["The plant grew. A fire broke out elsewhere.", "The plant of Acme Inc. had a fire."]) == [set(), {("plant_closure_or_fire", 4)}]


def test_each_event_gets_its_nearest_date(spark):
    texts = ["Covenant breach on 2023-11-02. Plant fire on 2023-12-24 and, a few weeks later, a delisting notice of 2024-01-05.", "In Q3 2023 sustained losses, then layoffs in Q4 2023.",
             "On 2023-10-01 it spoke. Later came a receivership.", "A receivership.", "Covenant breach on 2023-99-99."]
    rows = R.item_features(_items(spark, texts)).select("item_id", F.explode("events").alias("e")).where("e.kind = 'rubric'").collect()
    got = {(r.item_id, r.e.name): (str(r.e.event_on), r.e.dated_by) for r in rows}
    assert got == {(0, "covenant_breach"): ("2023-11-02", "iso"), (0, "plant_closure_or_fire"): ("2023-12-24", "iso"), (0, "delisting_notice"): ("2024-01-05", "iso"),
                   (1, "sustained_losses"): ("2023-09-30", "period"), (1, "layoffs"): ("2023-12-31", "period"), (2, "receivership"): ("2023-10-01", "iso"),
                   (3, "receivership"): (str(AS_OF), "published"), (4, "covenant_breach"): (str(AS_OF), "published")}


def test_out_of_scope_sentences_are_excluded_by_name(spark):
    f = R.item_features(_items(spark, ["The plant closed in a fire. Its share price fell.", "The share price fell as the plant closed."]))
    got = sorted((r.evidence_id // 1_000_000, r.condition, r.level, r.in_scope) for r in news_evidence(f).collect())
    assert got == [(0, "plant_closure_or_fire", 4, True), (0, "share_price", 0, False), (1, "plant_closure_or_fire", 4, True)]


def test_items_without_text_or_events(spark):
    f = R.item_features(_items(spark, [None, "", "...", "word"]))
    assert R.scope(f).where("in_scope or has_event or categories <> '' or excluded_kinds <> ''").count() == 0 and f.count() == 4
    assert R.indicator_matches(f).count() == 0 and news_evidence(f).count() == 0


def test_alert_lines_follow_the_order_of_the_log(spark):
    t = dt.datetime(2024, 1, 1, 13)
    rows = [(10, t, "A", "0", "1", 1, 4.0, "r"), (5, t + dt.timedelta(hours=1), "B", "0", "1", 2, 4.0, "r"), (11, t, "C", "0", "1", 3, 4.0, "r")]
    df = spark.createDataFrame(rows, "id long, changed_at timestamp_ntz, vendor string, old_value string, new_value string, book_row_id long, risk_level double, risk_reason string")
    assert [r.vendor for r in A.alert_lines(df).orderBy("alert_pos").collect()] == ["B", "C", "A"]


def test_a_reason_of_white_space_is_missing(spark):
    df = spark.createDataFrame([(1, "A", 3, "\n\t"), (2, "A", 3, "\u3000"), (3, "A", 3, " r ")], "decision_id long, vendor string, risk_level int, risk_reason string")
    assert {r.decision_id: r.quarantine_reason for r in S.validate_decisions(df).collect()} == {1: "missing reason", 2: "missing reason", 3: None}


AMOUNTS = {
    "12 000 employees": "12000.00", "1,5 Mio EUR": "1500000.00", "5 million dollars": "5000000.00", "€1.250.000": "1250000.00", "1.250.000,50 EUR": "1250000.50",
    "$1,250.50": "1250.50", "CHF 1'250'000": "1250000.00", "$1.250 million": "1250000.00", "$1,250 million": "1250000000.00", "EUR 1.250": "1250.00", "3 Mrd. Euro": "3000000000.00",
    "2.5 trillion yen": "2500000000000.00", "US$ 7": "7.00", "40 Tsd. EUR": "40000.00", "10 €": "10.00", "in 2023 500 employees": "500.00", "£1.2.3": None, "USD 12,34,56": None,
}


def test_number_grammar(spark):
    got = {r.item_id: r.amount for r in R.scale_figures(_items(spark, list(AMOUNTS))).collect()}
    assert {t: None if got[i] is None else str(got[i]) for i, t in enumerate(AMOUNTS)} == AMOUNTS
    none = R.scale_figures(_items(spark, ["page 12", "5 millionaires", "v1.2.3 dollarstore", "12 000 people", "A4 paper"]))
    assert [r.figure_text for r in none.collect()] == []
