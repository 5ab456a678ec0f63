"""Cell-level column functions (JVM-side expressions, no Python UDFs).

H1 parse_flag, H2 canonical cell text, H3 timestamp coerce, H4 number coerce,
H5 vendor key, H6 note file name.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import rules

_NUMERIC_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(_col(c), rules.STRIP_PATTERN, "")


def floor_second(c) -> Column:
    """A timestamp_ntz floored to the second, without a detour over the session's time zone."""
    return timestamp_text(c).cast("timestamp_ntz")


def parse_flag_text(c) -> Column:
    """H1 on text: strip + lower, then the fixed spellings; anything else is NULL ('2' too)."""
    t = F.lower(strip(c))
    return (
        F.when(t.isin(*rules.FLAG_TRUE_SPELLINGS), F.lit(True))
        .when(t.isin(*rules.FLAG_FALSE_SPELLINGS), F.lit(False))
        .otherwise(F.lit(None).cast("boolean"))
    )


def parse_flag_number(c) -> Column:
    """H1 on numbers: NULL/NaN -> NULL, else int(x) != 0 (2 -> true, 0.5 -> false)."""
    x = _col(c)
    return F.when(x.isNull() | F.isnan(x.cast("double")), F.lit(None).cast("boolean")).otherwise(
        x.cast("double").cast("long") != 0
    )


def parse_flag(c, data_type: T.DataType | None = None) -> Column:
    """H1 for a column of the given type (text by default)."""
    if data_type is None or isinstance(data_type, T.StringType):
        return parse_flag_text(c)
    if isinstance(data_type, T.BooleanType):
        return _col(c)
    return parse_flag_number(c)


def flag_text(flag) -> Column:
    """A tri-state flag stored as cell text: '1', '0' or NULL."""
    b = _col(flag)
    return F.when(b, F.lit("1")).when(~b, F.lit("0")).otherwise(F.lit(None).cast("string"))


def ts_lit(value) -> Column:
    """A timestamp_ntz literal from a Python datetime (no local-time conversion)."""
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def timestamp_text(c) -> Column:
    """Timestamp floored to the second, as 'yyyy-MM-dd HH:mm:ss'."""
    return F.substring(_col(c).cast("string"), 1, 19)


def number_text(c) -> Column:
    """Number as cell text: NaN -> NULL, integral value -> integer text, else its decimal text."""
    x = _col(c).cast("double")
    return (
        F.when(x.isNull() | F.isnan(x), F.lit(None).cast("string"))
        .when(x == F.floor(x), F.floor(x).cast("long").cast("string"))
        .otherwise(x.cast("string"))
    )


def canonical_cell(c, data_type: T.DataType) -> Column:
    """H2: the text a typed cell is stored as."""
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return timestamp_text(c)
    if isinstance(data_type, T.BooleanType):
        return flag_text(c)
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return number_text(c)
    if isinstance(data_type, T.DateType):
        return F.concat(_col(c).cast("string"), F.lit(" 00:00:00"))
    return _col(c).cast("string")


def to_timestamp_cell(c) -> Column:
    """H3: text -> timestamp, parsed per row; junk -> NULL (try_cast, never raises)."""
    t = strip(c)
    return F.coalesce(
        t.try_cast("timestamp_ntz"),
        F.try_to_date(t, "M/d/yyyy").cast("timestamp_ntz"),
    )


def to_number_cell(c) -> Column:
    """H4: text -> double; only plain decimal text parses (Spark alone would take '3d')."""
    x = _col(c)
    return F.when(x.rlike(_NUMERIC_TEXT), strip(x).try_cast("double")).otherwise(F.lit(None).cast("double"))


def vendor_key(c) -> Column:
    """H5: '/' and '\\' -> '-', trim, blank -> 'unknown'."""
    k = strip(F.translate(_col(c), "/\\", "--"))
    return F.coalesce(F.nullif(k, F.lit("")), F.lit(rules.NOTE_DIR_DEFAULT))


def note_file_name(ts) -> Column:
    """H6: research_<yyyy-MM-dd_HH-mm-ss>.md for a note written at ``ts``."""
    return F.concat(
        F.lit(rules.NOTE_NAME_PREFIX),
        F.translate(timestamp_text(ts), " :", "_-"),
        F.lit(rules.NOTE_NAME_SUFFIX),
    )


def note_time(file_name) -> Column:
    """Inverse of H6: the time encoded in a note file name, NULL when it does not parse."""
    stamp = r"^research_([0-9]{4}-[0-9]{2}-[0-9]{2})_([0-9]{2})-([0-9]{2})-([0-9]{2})\.md$"
    name = _col(file_name)
    return F.when(name.rlike(stamp), F.regexp_replace(name, stamp, "$1 $2:$3:$4")).try_cast("timestamp_ntz")
