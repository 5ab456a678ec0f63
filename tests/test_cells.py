"""Literal edge rows for the cell functions (FIXTURES.md §5: H1-H6)."""

import datetime as dt
import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions import cells


def _one_col(spark, values, dtype):
    return spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("c", dtype, True)]))


def test_parse_flag_text(spark):
    cases = {None: None, "": None, "none": None, "nan": None, "1": True, "1.0": True, "TRUE": True,
             " y ": True, "0": False, "0.0": False, "No": False, "2": None, "maybe": None}
    df = _one_col(spark, list(cases), T.StringType()).select("c", cells.parse_flag_text("c").alias("f"))
    got = {r.c: r.f for r in df.collect()}
    assert got == cases


def test_parse_flag_number(spark):
    df = _one_col(spark, [0.0, 1.0, 2.0, 0.5, float("nan"), None], T.DoubleType())
    got = [r.f for r in df.select(cells.parse_flag("c", T.DoubleType()).alias("f")).collect()]
    assert got == [False, True, True, False, None, None]


def test_canonical_cells(spark):
    row = spark.createDataFrame(
        [(dt.datetime(2024, 1, 2, 3, 4, 5, 678000), True, 3.0, 2.5, float("nan"), "x")],
        "ts timestamp_ntz, b boolean, f1 double, f2 double, f3 double, s string")
    out = row.select(*[cells.canonical_cell(f.name, f.dataType).alias(f.name) for f in row.schema.fields]).first()
    assert tuple(out) == ("2024-01-02 03:04:05", "1", "3", "2.5", None, "x")


def test_timestamp_and_number_coerce(spark):
    ts = _one_col(spark, ["n/a", "", "2026-01-02", "2026-11-01 10:00:00", "1/5/2026", None], T.StringType())
    got = [r.t for r in ts.select(cells.to_timestamp_cell("c").alias("t")).collect()]
    assert got == [None, None, dt.datetime(2026, 1, 2), dt.datetime(2026, 11, 1, 10), dt.datetime(2026, 1, 5), None]
    num = _one_col(spark, [" 3 ", "3d", "abc", "2.5", None], T.StringType())
    got = [r.n for r in num.select(cells.to_number_cell("c").alias("n")).collect()]
    assert got == [3.0, None, None, 2.5, None]


def test_vendor_key(spark):
    df = _one_col(spark, ["A/B", "A\\B", "A-B", " ", "x ", None], T.StringType())
    got = [r.k for r in df.select(cells.vendor_key("c").alias("k")).collect()]
    assert got == ["A-B", "A-B", "A-B", "unknown", "x", "unknown"]


def test_note_name_round_trip(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5),)], "ts timestamp_ntz")
    name = df.select(cells.note_file_name("ts").alias("n")).first().n
    assert name == "research_2024-01-02_03-04-05.md"
    back = df.select(cells.note_time(F.lit(name)).alias("t"), cells.note_time(F.lit("notes.md")).alias("bad")).first()
    assert back.t == dt.datetime(2024, 1, 2, 3, 4, 5) and back.bad is None


def test_number_text_is_integral_text(spark):
    df = _one_col(spark, [4.0, 4.5, None], T.DoubleType())
    assert [r.t for r in df.select(cells.number_text("c").alias("t")).collect()] == ["4", "4.5", None]
    assert not math.isnan(4.0)
