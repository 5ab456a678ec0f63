"""R8 near-copy citations: a dense cluster resolves to its leader, dissimilar texts cite
themselves, and the result equals brute force on a small fixture."""

import datetime as dt
import itertools
import random

from riskloom.operators import similarity as SIM

BASE_WORDS = [f"w{i}" for i in range(200)]


def _fixture(spark):
    rnd = random.Random(5)
    rows = []
    for k in range(30):  # near copies of one text: one word changed each
        words = list(BASE_WORDS)
        words[rnd.randrange(len(words))] = f"edit{k}"
        rows.append((k + 1, 2 + (k % 2), dt.date(2024, 1, 1) + dt.timedelta(days=k), " ".join(words)))
    for k in range(5):    # unrelated texts
        rows.append((100 + k, 1, dt.date(2024, 1, 2), " ".join(f"u{k}_{i}" for i in range(120))))
    rows.append((200, 1, None, "too short"))
    return rows


def _brute(rows, t=0.8):
    def sh(text):
        w = text.lower().split()
        return {" ".join(w[i:i + 3]) for i in range(len(w) - 2)}

    def q(r):
        return (r[1], r[2] is None, r[2] or dt.date.max, r[0])

    sets = {r[0]: sh(r[3]) for r in rows}
    out = {}
    for a in rows:
        best = None
        for b in rows:
            sa, sb = sets[a[0]], sets[b[0]]
            if q(b) < q(a) and sa and sb and len(sa & sb) / len(sa | sb) >= t:
                best = b if best is None or q(b) < q(best) else best
        out[a[0]] = best[0] if best else a[0]
    return out


def test_near_copy_citations_match_brute_force(spark):
    rows = _fixture(spark)
    df = spark.createDataFrame(rows, "item_id long, tier int, published_on date, text string")
    items = SIM.with_shingles(df).drop("text")
    got = {r.item_id: r.cite_id for r in SIM.near_copy_citations(items).collect()}
    assert got == _brute(rows)
    leader = min((r for r in rows if r[0] <= 30), key=lambda r: (r[1], r[2], r[0]))[0]
    assert {got[k] for k in range(1, 31)} == {leader}
    assert all(got[k] == k for k in itertools.chain(range(100, 105), [200]))


def _counted(monkeypatch):
    """Counts the rounds: each one writes the best citations once."""
    rounds, write = [], SIM.materialize

    def counted(df):
        if df.columns == ["i", "qb", "sim"]:
            rounds.append(1)
        return write(df)

    monkeypatch.setattr(SIM, "materialize", counted)
    return rounds


def test_dissimilar_items_of_one_template_cost_few_rounds(spark, monkeypatch):
    rounds = _counted(monkeypatch)
    shared = " ".join(f"t{i}" for i in range(24))
    rows = [(k, 1, dt.date(2024, 1, 1), f"{shared} " + " ".join(f"x{k}_{i}" for i in range(5))) for k in range(2000)]
    df = spark.createDataFrame(rows, "item_id long, tier int, published_on date, text string")
    got = SIM.near_copy_citations(SIM.with_shingles(df).drop("text"))
    assert got.where("cite_id <> item_id").count() == 0 and len(rounds) <= 12


def test_rounds_grow_with_the_logarithm_of_a_list(spark, monkeypatch):
    """Items just below the threshold share prefix shingles, so whole lists are walked."""
    rounds = _counted(monkeypatch)
    monkeypatch.setattr(SIM, "COUNT_CELLS", 1)  # no rarity: the shared shingles stand in the prefixes
    shared = " ".join(f"t{i}" for i in range(40))
    rows = [(k, 1, dt.date(2024, 1, 1), f"{shared} " + " ".join(f"x{k}_{i}" for i in range(8))) for k in range(300)]
    df = spark.createDataFrame(rows, "item_id long, tier int, published_on date, text string")
    got = SIM.near_copy_citations(SIM.with_shingles(df).drop("text"))
    assert got.where("cite_id <> item_id").count() == 0 and 1 <= len(rounds) <= 8


def test_citations_match_brute_force_on_random_lengths(spark):
    rnd = random.Random(11)
    rows = []
    for k in range(160):
        base = [f"b{k % 12}x{i}" for i in range(rnd.choice((3, 6, 20, 60)) + k % 12)]
        for _ in range(rnd.randrange(4)):
            at = rnd.randrange(len(base))
            base[at: at + rnd.randrange(3)] = [f"e{rnd.randrange(40)}"] * rnd.randrange(3)
        rows.append((k, rnd.randrange(1, 4), rnd.choice((None, dt.date(2024, 1, 1 + k % 9))), " ".join(base)))
    df = spark.createDataFrame(rows, "item_id long, tier int, published_on date, text string")
    got = {r.item_id: r.cite_id for r in SIM.near_copy_citations(SIM.with_shingles(df).drop("text")).collect()}
    want = _brute(rows)
    assert got == want and sum(a != b for a, b in want.items()) > 20


def test_chains_lead_to_one_representative(spark):
    pairs = [(k, k - 1) for k in range(1, 40)] + [(0, 0), (50, 50), (51, 50), (60, 39)]
    df = spark.createDataFrame(pairs, "item_id long, cite_id long")
    got = {r.item_id: r.rep_id for r in SIM.representatives(df).collect()}
    assert got == {**{k: 0 for k in range(40)}, 50: 50, 51: 50, 60: 0}


def test_edited_copies_do_not_corroborate(spark):
    """Two outlets print one story with an edit: one outlet's claim, capped at 3; a vendor's other story stands."""
    from riskloom.operators import news as R
    from riskloom.operators import score as S
    from riskloom.plans.monitor import news_evidence

    words = " ".join(f"w{i}" for i in range(60))
    day = dt.date(2024, 1, 20)
    rows = [(1, "A", "one", 3, day, f"Plant fire. {words}"), (2, "A", "two", 3, day, f"Plant fire. {words} end"),
            (3, "B", "one", 3, day, f"Plant fire. {words}"), (4, "B", "two", 3, day, "Fire at a plant, says another story about quite other things")]
    items = spark.createDataFrame(rows, "item_id long, vendor string, outlet string, tier int, published_on date, text string")
    kept = SIM.without_copies(R.item_features(items), items)
    assert sorted(r.item_id for r in kept.collect()) == [1, 3, 4]
    got = {r.vendor: (r.eff_level, r.capped) for r in S.corroborated_conditions(S.adjusted_evidence(news_evidence(kept))).where("condition = 'plant_closure_or_fire'").collect()}
    assert got == {"A": (3, True), "B": (4, False)}


def _bytes_under(spark):
    import os

    from riskloom.session import checkpoint_dir

    top = checkpoint_dir(spark).removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names)


def test_spent_tables_leave_the_disk(spark):
    """The sets, prefixes, lists and rounds were kept, many times the texts in all; now the citations stay."""
    rnd = random.Random(3)
    texts = [[f"v{rnd.randrange(4000)}" for _ in range(300)] for _ in range(300)]
    for k in range(1, 300, 3):  # near copies of the text before
        texts[k] = [*texts[k - 1][:-2], f"edit{k}"]
    rows = [(k, 1 + k % 3, dt.date(2024, 1, 1 + k % 9), " ".join(t)) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "item_id long, tier int, published_on date, text string")
    before = _bytes_under(spark)
    got = {r.item_id: r.cite_id for r in SIM.near_copy_citations(SIM.with_shingles(df).drop("text")).collect()}
    assert got == _brute(rows)
    assert _bytes_under(spark) - before < sum(len(r[3]) for r in rows)


def _shuffle_bytes(spark):
    import glob
    import os

    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(os.path.getsize(f) for d in dirs for f in glob.glob(f"{d}/*/shuffle_*.data") if os.path.exists(f))


def test_spent_shuffles_leave_the_disk(spark):
    """Shuffle files of all steps lay there together until the driver's garbage was collected; now a step's go with its end."""
    import time

    rnd = random.Random(7)
    texts = [[f"v{rnd.randrange(4000)}" for _ in range(300)] for _ in range(300)]
    for k in range(1, 300, 3):
        texts[k] = [*texts[k - 1][:-2], f"edit{k}"]
    rows = [(k, 1 + k % 3, dt.date(2024, 1, 1 + k % 9), " ".join(t)) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "item_id long, tier int, published_on date, text string")
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = _shuffle_bytes(spark), spark.conf.get(key)
    got = SIM.near_copy_citations(SIM.with_shingles(df).drop("text"))
    for _ in range(100):  # files are deleted in the background
        grown = _shuffle_bytes(spark) - before
        if grown < 50_000:
            break
        time.sleep(0.1)
    assert grown < 50_000 and spark.conf.get(key) == setting
    assert {r.item_id: r.cite_id for r in got.collect()} == _brute(rows)


def test_entries_that_face_none_go_and_the_others_know_the_best(spark):
    """All entries were shuffled twice to find the best that they face, most of them facing none."""
    rnd = random.Random(9)
    rows = [(k, rnd.randrange(1, 4), rnd.choice((None, dt.date(2024, 1, 1 + k % 9))), rnd.randrange(5, 9), rnd.randrange(3), rnd.randrange(12), 3 + k % 3, rnd.randrange(3, 6))
            for k in range(150)]
    df = spark.createDataFrame(rows, "item_id long, tier int, published_on date, n int, pos int, s long, band int, partner int")
    want = {}
    for r in rows:
        faced = [(e[1], e[2] is None, e[2] or dt.date.min, e[0]) for e in rows if e is not r and (e[5], e[6], e[7]) == (r[5], r[7], r[6])]
        if faced:
            want[r[0]] = min(faced)[3] if min(faced) < (r[1], r[2] is None, r[2] or dt.date.min, r[0]) else None
    out = SIM._faced(df)
    assert {r.item_id: r.m and r.m.qj.item_id for r in out.collect()} == want and 0 < len(want) < len(rows)
    assert SIM._faced(df.repartition(4, "s"))._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("Exchange") == 1


def test_most_sets_of_false_pairs_are_not_moved_whole(spark, monkeypatch):
    moved, met = [], SIM._with_overlaps

    def counted(pairs, sets):
        moved.append(pairs.count())
        return met(pairs, sets)

    monkeypatch.setattr(SIM, "_with_overlaps", counted)
    monkeypatch.setattr(SIM, "COUNT_CELLS", 1)  # no rarity: shared shingles stand in the prefixes
    shared = " ".join(f"t{i}" for i in range(24))
    rows = [(k, 1, dt.date(2024, 1, 1), f"{shared} " + " ".join(f"x{k}_{i}" for i in range(60))) for k in range(40)]
    rows += [(100 + k, 2, dt.date(2024, 1, 1), f"{text} end") for k, (_, _, _, text) in enumerate(rows[:5])]
    df = spark.createDataFrame(rows, "item_id long, tier int, published_on date, text string")
    got = {r.item_id: r.cite_id for r in SIM.near_copy_citations(SIM.with_shingles(df).drop("text")).collect()}
    assert got == _brute(rows) and sum(got[k] != k for k in got) == 5
    assert 5 <= sum(moved[1::2]) < sum(moved[::2]) / 4


def test_bound_moves_half_of_a_shingle_and_drops_no_link(spark, monkeypatch):
    """The sets' parts are moved with each pair; shingles whose upper halves are equal count as one there."""
    kinds, met = [], SIM._with_overlaps

    def seen(pairs, sets):
        kinds.append(sets.schema["shingles"].dataType.simpleString())
        return met(pairs, sets)

    monkeypatch.setattr(SIM, "_with_overlaps", seen)
    monkeypatch.setattr(SIM, "delete_path", lambda *a: None)
    alike = [6 * k for k in range(40)]  # one upper half, all in the part
    sets = spark.createDataFrame([(1, alike), (2, alike[:36] + [(k << 33) * 6 for k in range(1, 5)]), (3, alike[:20])], "item_id long, shingles array<bigint>")
    pairs = spark.createDataFrame([(1, 2, 2, 40, 40), (1, 3, 3, 40, 20)], "i long, j long, qj long, n int, nj int")
    got = [tuple(r) for r in SIM._verified(pairs, sets, 0.8, []).collect()]
    assert kinds == ["array<int>", "array<bigint>"] and got == [(1, 2, 36 / 44)]


def test_few_or_many_losers_of_the_exact_dedupe(spark, monkeypatch):
    from riskloom.plans import catalog
    from tests.conftest import SF_SMALL

    few = sorted(map(tuple, catalog.q_syndication_clusters(spark, SF_SMALL).collect()))
    monkeypatch.setattr(SIM, "SENT_ITEMS", 0)
    assert few and few == sorted(map(tuple, catalog.q_syndication_clusters(spark, SF_SMALL).collect()))


def test_entries_that_walk_lists_are_sent_once_or_not_at_all(spark, monkeypatch):
    """The rows that a walk repeats for ranks never pass through the driver, however small the tables' files are."""
    plans, met = [], SIM._met

    def seen(best, cand, *rest):
        plans.append(cand._jdf.queryExecution().executedPlan().toString())
        return met(best, cand, *rest)

    monkeypatch.setattr(SIM, "_met", seen)
    monkeypatch.setattr(SIM, "COUNT_CELLS", 1)  # the shared shingles stand in the prefixes, so whole lists are walked
    shared = " ".join(f"t{i}" for i in range(40))
    rows = [(k, 1, dt.date(2024, 1, 1), f"{shared} " + " ".join(f"x{k % 80}_{i}" for i in range(8)) + f" y{k}" * (k // 80)) for k in range(90)]
    items = SIM.with_shingles(spark.createDataFrame(rows, "item_id long, tier int, published_on date, text string")).drop("text")
    want = _brute(rows)
    assert {r.item_id: r.cite_id for r in SIM.near_copy_citations(items).collect()} == want
    assert len(plans) > 2 and not any("BroadcastExchange" in p and "explode(" in p for p in plans)
    plans.clear()
    monkeypatch.setattr(SIM, "SENT_ENTRIES", 0)
    assert {r.item_id: r.cite_id for r in SIM.near_copy_citations(items).collect()} == want
    assert len(plans) > 2 and all("SortMergeJoin [s" in p for p in plans[1:])
