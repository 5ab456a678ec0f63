"""News rules on literal items (FIXTURES §5: R3 window edges and X13, R5 dating, R4 scope,
R2 confirmation)."""

import datetime as dt

from riskloom import rules
from riskloom.operators import news as R

AS_OF = rules.AS_OF
ITEM = "item_id long, vendor string, outlet string, tier int, published_on date, text string"


def _items(spark, rows):
    return spark.createDataFrame(rows, ITEM)


def test_recency_window_and_concluded_matters(spark):
    d = lambda n: AS_OF - dt.timedelta(days=n)
    rows = [
        (1, "V", "o", 3, d(90), "announced a new plant"),        # 90 days before: out
        (2, "V", "o", 3, d(89), "announced a new plant"),        # 89 days before: in
        (3, "V", "o", 3, AS_OF, "announced a new plant"),        # on as_of: in
        (4, "V", "o", 3, d(-1), "announced a new plant"),        # after: out
        (5, "V", "o", 3, None, "announced a new plant"),         # undated: out
        (6, "V", "o", 3, d(5), "The 2023-06-01 lawsuit remains pending."),   # older, continuing: in
        (7, "V", "o", 3, d(5), "The 2023-06-01 lawsuit was settled."),       # older, concluded: out
        (8, "V", "o", 3, d(5), "disclosed Q3 2023 results"),     # restated figure: in, dated to period
    ]
    f = R.item_features(_items(spark, rows))
    kept = {r.item_id: r.event_on for r in f.where(R.recency(f, AS_OF)).collect()}
    assert sorted(kept) == [2, 3, 6, 8]
    assert kept[6] == dt.date(2023, 6, 1) and kept[8] == dt.date(2023, 9, 30)


def test_scope_and_transit(spark):
    rows = [
        (1, "V", "o", 3, AS_OF, "filed for Chapter 11 protection"),
        (2, "V", "o", 3, AS_OF, "port congestion delayed vessels"),
        (3, "V", "o", 3, AS_OF, "share price fell on analyst downgrade"),
        (4, "V", "o", 3, AS_OF, "xyzzy plugh"),
    ]
    got = {r.item_id: (r.in_scope, r.has_event) for r in R.scope(R.item_features(_items(spark, rows))).collect()}
    assert got == {1: (True, True), 2: (False, True), 3: (False, True), 4: (False, False)}
    rub = {(r.item_id, r.condition, r.level) for r in R.indicator_matches(R.item_features(_items(spark, rows))).collect()}
    assert (1, "insolvency_proceeding", 5) in rub and not any(i == 2 for i, _, _ in rub)


def test_entity_confirmation_whole_words(spark):
    items = _items(spark, [
        (1, "Supplier#000000001", "o", 3, AS_OF, "SUP-1 filed"),
        (2, "Supplier#000000001", "o", 3, AS_OF, "SUP-12 filed"),          # another alias: not a mention
        (3, "Supplier#000000001", "o", 3, AS_OF, "news on supplier#000000001 today"),
        (4, "Supplier#000000001", "o", 3, AS_OF, "nothing"),
        (5, "Acme Öl GmbH", "o", 3, AS_OF, "The ACME-ÖL, GmbH plant"),      # the same words, other marks
        (6, "Beta", "o", 3, AS_OF, "Bet a, Betamax and the Beta-like"),
        (7, "Gamma", "o", 3, AS_OF, "first gamma  ray (holdings) plc"),
        (8, "Delta", "o", 3, AS_OF, "gamma ray holdings"),                   # an alias of another vendor
        (9, "***", "o", 3, AS_OF, "*** ???"),
        (10, "Acme", "o", 3, AS_OF, None),
        (11, "Acme", "o", 3, AS_OF, ""),
        (12, "Gamma", "o", 3, AS_OF, "news of GRH"),
    ])
    aliases = spark.createDataFrame([("Supplier#000000001", "SUP-1"), ("Gamma", "Gamma Ray Holdings"), ("Gamma", "GRH"), ("***", "?"), ("Acme", None)],
                                    "vendor string, alias string")
    got = {r.item_id: (r.confirmed, r.matched_by) for r in R.confirm_entities(items, aliases).collect()}
    none = (False, None)
    assert got == {1: (True, "alias"), 2: none, 3: (True, "name"), 4: none, 5: (True, "name"), 6: (True, "name"), 7: (True, "name"),
                   12: (True, "alias"),
                   8: none, 9: none, 10: none, 11: none}
    assert {r.matched_by for r in R.confirm_entities(items, aliases.limit(0)).collect()} == {"name", None}


def test_a_hot_vendor_and_a_full_filter_change_nothing(spark, monkeypatch):
    rows = [(i, "Hot" if i % 3 == 0 else f"V{i % 40}", "o", 3, AS_OF, f"on {'the hot one' if i % 2 else f'alias {i % 40}'} today") for i in range(600)]
    aliases = spark.createDataFrame([("Hot", "Hot One")] + [(f"V{k}", f"alias {k}") for k in range(40)], "vendor string, alias string")

    def want(vendor, text):
        low = f" {text} "
        return "name" if f" {vendor.lower()} " in low else "alias" if f" {dict(aliases.collect())[vendor].lower()} " in low else None

    expected = {r[0]: want(r[1], r[5]) for r in rows}
    for bits in (R.PHRASE_BITS, 64):
        monkeypatch.setattr(R, "PHRASE_BITS", bits)
        assert {r.item_id: r.matched_by for r in R.confirm_entities(_items(spark, rows), aliases).collect()} == expected


def test_no_text_is_shuffled_to_confirm_entities(spark):
    items = _items(spark, [(1, "V", "o", 3, AS_OF, "V1 text")])
    df = R.confirm_entities(items, spark.createDataFrame([("V", "V1")], "vendor string, alias string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = R.confirm_entities(items, spark.createDataFrame([("V", "V1")], "vendor string, alias string"))
        joins = [c for n in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in n for c in [n]]
        sent = df._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # what an exchange sends is what the nodes below it put out: no text or word column among them
    below = [sent[i + 1] for i, line in enumerate(sent) if "Exchange hashpartitioning" in line]
    assert joins and below and not any("text#" in line.split("Project")[-1] and "_words" not in line for line in below)
    assert "RLike" not in plan and "regexp_like" not in plan


def test_scale_figures(spark):
    items = _items(spark, [(1, "V", "o", 3, AS_OF, "settled for $12 million; opened a site with 1,250 employees; $$$ 5 more $3 more")])
    got = sorted((r.kind, r.ordinal, str(r.amount)) for r in R.scale_figures(items).collect())
    # "$ 5" counts (optional space after the sign); "5 more" has no unit ("m" must end a word)
    assert got == [("headcount", 1, "1250.00"), ("money", 1, "12000000.00"), ("money", 2, "5.00"), ("money", 3, "3.00")]
