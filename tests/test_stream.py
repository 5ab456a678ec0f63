"""The incremental flip stream equals the batch flag history (E1) over several
micro-batches, and a restart resumes without re-emitting or losing flips."""

import os

from pyspark.sql import functions as F

from riskloom.operators.changes import flag_history
from riskloom.plans.catalog import _events_to_decisions
from riskloom.sources.tables import read_table
from riskloom.streaming import flips as S1
from tests.conftest import SF_SMALL

COLS = ["id", "changed_at", "vendor", "field", "old_value", "new_value"]


def _rows(df):
    return sorted(tuple(r) for r in df.select(*COLS).collect())


def _write_days(spark, events, src, days):
    for d in days:
        part = events.where(F.dayofmonth("ts") == d)
        part.coalesce(1).write.mode("overwrite").parquet(os.path.join(src, f"day={d:02d}"))


def test_stream_equals_batch_and_survives_restart(spark, tmp_out):
    events = read_table(spark, SF_SMALL, "events")
    src = os.path.join(tmp_out, "src")
    run_dir = os.path.join(tmp_out, "run")
    _write_days(spark, events, src, range(1, 16))
    schema = events.schema
    sink = S1.run_flip_stream(spark, src + "/day=*", _events_to_decisions, schema, run_dir=run_dir,
                              max_files_per_trigger=4)
    first = _rows(S1.read_flips(spark, sink))
    assert S1.read_flips(spark, sink).select("batch_id").distinct().count() >= 3

    # restart with no new input: nothing new, nothing lost
    S1.run_flip_stream(spark, src + "/day=*", _events_to_decisions, schema, run_dir=run_dir, max_files_per_trigger=4)
    assert _rows(S1.read_flips(spark, sink)) == first

    # new files arrive: only they are processed; the result equals the batch history
    _write_days(spark, events, src, range(16, 32))
    S1.run_flip_stream(spark, src + "/day=*", _events_to_decisions, schema, run_dir=run_dir, max_files_per_trigger=4)
    expected = _rows(flag_history(_events_to_decisions(events)))
    assert _rows(S1.read_flips(spark, sink)) == expected


def test_late_decision_is_compared_with_current_state(spark, tmp_out):
    """A decision arriving in a later batch with an earlier time is compared with the
    vendor's current flag (arrival order), not re-sorted into the past."""
    import datetime as dt

    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    t = dt.datetime(2024, 1, 10, 12, 0, 0)
    src = os.path.join(tmp_out, "late")
    batches = [
        [(1, t, 7, "x", 4.0, None), (2, t + dt.timedelta(hours=1), 7, "x", 1.0, None)],   # 1 then 0
        [(3, t - dt.timedelta(hours=5), 7, "x", 5.0, None)],                               # late: 1
    ]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(src, f"part={n}"))
    sink = S1.run_flip_stream(spark, src + "/part=*", _events_to_decisions, spark.createDataFrame([], schema).schema,
                              run_dir=os.path.join(tmp_out, "late_run"), max_files_per_trigger=1)
    got = sorted((r.id, r.old_value, r.new_value, r.batch_id) for r in S1.read_flips(spark, sink).collect())
    assert got == [(1, None, "1", 0), (2, "1", "0", 0), (3, "0", "1", 1)]


def _size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files)


EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_state_does_not_grow_with_the_batches_and_only_touched_buckets_change(spark, tmp_out):
    import datetime as dt

    t, src, run_dir = dt.datetime(2024, 1, 10, 12), os.path.join(tmp_out, "src"), os.path.join(tmp_out, "run")
    schema, sizes = spark.createDataFrame([], EVENT).schema, []

    def add(n, users):
        rows = [(n * 1000 + u, t + dt.timedelta(hours=n), u, "x", float((n + u) % 2 * 4), None) for u in users]
        spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(os.path.join(src, f"part={n:02d}"))
        S1.run_flip_stream(spark, src + "/part=*", _events_to_decisions, schema, run_dir=run_dir, buckets=8)

    for n in range(10):
        add(n, range(40))
        sizes.append(_size(os.path.join(run_dir, "state")))
    assert max(sizes[2:]) <= 1.05 * min(sizes[2:])  # two versions of each bucket
    before = S1.state_versions(spark, run_dir + "/state")
    assert all(len(v) == 2 for v in before.values())
    add(10, [3])
    after = S1.state_versions(spark, run_dir + "/state")
    assert sum(after[b] != before[b] for b in after) == 1
    flags = {r.vendor: r.last_flag for r in S1.read_state(spark, run_dir).collect()}
    assert len(flags) == 40 and flags["Supplier#000000003"] is True and flags["Supplier#000000004"] is True
    assert _rows(S1.read_flips(spark, run_dir + "/flips")) == _rows(flag_history(_events_to_decisions(spark.read.schema(schema).parquet(src + "/part=*"))))


def test_a_replayed_batch_writes_the_same_flips_and_state(spark, tmp_out):
    import datetime as dt

    t, sink, state = dt.datetime(2024, 1, 10, 12), os.path.join(tmp_out, "flips"), os.path.join(tmp_out, "state")
    day = [spark.createDataFrame([(10 * n + u, f"V{u}", t + dt.timedelta(days=n), (n + u) % 2 == 0) for u in range(6)],
                                 "decision_id long, vendor string, decided_at timestamp_ntz, is_risk boolean") for n in range(3)]
    for n in (0, 1, 1, 2, 2):  # batches 1 and 2 fail after their writes and run again
        S1._write_batch(day[n], n, sink, state, 4)
    got = sorted((r.id, r.old_value, r.new_value) for r in S1.read_flips(spark, sink).collect())
    text = {True: "1", False: "0"}
    assert got == sorted((10 * n + u, text[(n - 1 + u) % 2 == 0] if n else None, text[(n + u) % 2 == 0]) for n in range(3) for u in range(6))
    assert {r.vendor: r.last_flag for r in S1.read_state(spark, tmp_out).collect()} == {f"V{u}": u % 2 == 0 for u in range(6)}


def test_the_number_of_buckets_is_fixed(spark, tmp_out):
    import pytest

    src, schema = os.path.join(tmp_out, "src"), spark.createDataFrame([], EVENT).schema
    spark.createDataFrame([], EVENT).write.parquet(os.path.join(src, "part=0"))
    run = lambda n: S1.run_flip_stream(spark, src + "/part=*", _events_to_decisions, schema, run_dir=tmp_out + "/run", buckets=n)
    run(4)
    with pytest.raises(ValueError):
        run(8)
