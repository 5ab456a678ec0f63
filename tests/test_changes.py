"""Change-log semantics and the
skew-safe ordering helpers against plain windows."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.operators import changes as C
from riskloom.operators.ordering import global_position, keyed_sequence

RUN = dt.datetime(2024, 1, 29, 12, 0, 0)
LOG_SCHEMA = "id long, changed_at timestamp_ntz, vendor string, field string, old_value string, new_value string"


def _t(minutes):
    return RUN + dt.timedelta(minutes=minutes)


def test_risk_changes_since_and_latest(spark):
    log = spark.createDataFrame([
        (1, _t(1), "null_to_0", "is_risk", None, "0"),       # touches no '1': dropped
        (2, _t(1), "null_to_1", "is_risk", None, "1"),
        (3, _t(1), "one_to_null", "is_risk", "1", None),
        (4, _t(1), "one_zero_null", "is_risk", "1", "0"),    # 1 -> 0 then 0 -> NULL: report 1 -> 0
        (5, _t(2), "one_zero_null", "is_risk", "0", None),
        (6, _t(1), "zero_one_zero", "is_risk", "0", "1"),    # 0 -> 1 -> 0: CLEARED
        (7, _t(2), "zero_one_zero", "is_risk", "1", "0"),
        (8, RUN, "at_start", "is_risk", "0", "1"),           # same second as run start: kept
        (9, _t(-1), "before", "is_risk", "0", "1"),          # before the run: dropped
        (10, _t(1), "other_field", "risk_level", "1", "2"),  # not the flag: dropped
        (11, _t(1), "text_true", "is_risk", "1.0", "true"),  # '1.0' / 'true' are not '1'
    ], LOG_SCHEMA)
    since = C.risk_changes_since(log, RUN)
    assert sorted(r.id for r in since.collect()) == [2, 3, 4, 6, 7, 8]
    latest = {r.vendor: (r.id, r.old_value, r.new_value) for r in C.latest_change_per_vendor(since).collect()}
    assert latest == {
        "null_to_1": (2, None, "1"), "one_to_null": (3, "1", None), "one_zero_null": (4, "1", "0"),
        "zero_one_zero": (7, "1", "0"), "at_start": (8, "0", "1"),
    }


def test_change_log_diff_cells(spark):
    schema = "book_row_id long, vendor string, a string, b string"
    before = spark.createDataFrame([(1, "V", None, "x"), (2, "V", "y", "z"), (3, "W", None, "k")], schema)
    after = spark.createDataFrame([(1, "V", None, None), (2, "V", "y2", "z"), (3, "W", "n", "k")], schema)
    got = sorted((r.book_row_id, r.field, r.old_value, r.new_value, r.field_ordinal)
                 for r in C.change_log_diff(before, after, RUN).collect())
    assert got == [(1, "b", "x", None, 2), (2, "a", "y", "y2", 1), (3, "a", None, "n", 1)]
    assert C.change_log_diff(before, before, RUN).count() == 0


def test_flag_history_first_and_flips(spark):
    d = spark.createDataFrame([
        (1, "A", _t(0), True), (2, "A", _t(1), True), (3, "A", _t(2), False),
        (5, "B", _t(0), False), (4, "B", _t(0), True),     # same second: id breaks the tie
    ], "decision_id long, vendor string, decided_at timestamp_ntz, is_risk boolean")
    got = sorted((r.id, r.old_value, r.new_value) for r in C.flag_history(d).collect())
    assert got == [(1, None, "1"), (3, "1", "0"), (4, None, "1"), (5, "1", "0")]


def test_keyed_sequence_matches_plain_window_on_a_hot_key(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 else f"k{i % 17}"
        rows.append((key, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rnd.randrange(0, 60 * 24 * 5)), i, rnd.random() < 0.5))
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, id long, v boolean")
    w = Window.partitionBy("k").orderBy("t", "id")
    ref = {r.id: (r.s, r.p) for r in df.select("id", F.row_number().over(w).alias("s"), F.lag("v").over(w).alias("p")).collect()}
    got = {r.id: (r.seq, r.prev_value) for r in keyed_sequence(df, "k", ("t", "id"), "v").collect()}
    assert got == ref
    wd = Window.partitionBy("k").orderBy(F.col("t").desc(), F.col("id").desc())
    ref_d = {r.id: (r.s, r.p) for r in df.select("id", F.row_number().over(wd).alias("s"), F.lag("v").over(wd).alias("p")).collect()}
    got_d = {r.id: (r.seq, r.prev_value) for r in keyed_sequence(df, "k", ("t", "id"), "v", descending=True).collect()}
    assert got_d == ref_d


def test_global_position_matches_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("x"), F.col("id"))
    got = {r.id: r.pos for r in global_position(df.repartition(7), [F.col("x").desc(), F.col("id")]).collect()}
    ref = {r.id: r.p for r in df.select("id", F.row_number().over(Window.orderBy(F.col("x").desc(), "id")).alias("p")).collect()}
    assert got == ref
