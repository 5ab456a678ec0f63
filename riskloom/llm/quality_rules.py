"""Operator 10: quality rules with adaptive thresholds from mergeable quantile sketches.

Fixed rules fail a document first (too few words, too much repetition). For the others, measures
of the whole text are compared with fences that adapt to the language and source. The fences come
from quantile sketches: per (language, source, measure) a histogram over logarithmic buckets, which
answers any quantile within 1 % of its value. Two sketches merge by adding counts, so sources with
few documents use their language's merged sketch, and small languages the sketch of everything.
The sketches are exact counts, so reruns and retries agree. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import GAP, documents, stored

MIN_WORDS = 50          # fewer words fail
MAX_REPEAT_PCT = 50     # more repeated words than this share fail
MIN_DOCS = 50           # a sketch over fewer documents gives way to the next wider one
GAMMA = 1.02            # ratio of neighbouring bucket edges: quantiles within 1 %
FENCE = 3.0             # a fence lies this many interquartile ranges beyond a quartile
#: Measure -> least distance of a fence from its quartile, so that a uniform source fails nobody
#: for a trifle. Only the mean word length has a lower fence as well.
MEASURES = {"word_len": 1.5, "symbol_rate": 0.15, "dup_line_rate": 0.3, "repeat_rate": 0.15, "mark_rate": 0.4, "upper_rate": 0.3}
LOWER = ("word_len",)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and bind it in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(w: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more (w: word array).

    Windows are hashed and sorted with their positions; equal neighbours are repeats. Each repeated
    window covers its three words, less what the next repeated window covers again.
    """
    def windows(w):
        hashed = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        return F.sort_array(hashed)

    def twice(s):
        same = F.filter(s, lambda x, p: (F.get(s, p - 1)["h"] == x["h"]) | F.coalesce(F.get(s, p + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def covered(at):
        step = F.transform(at, lambda x, p: F.least(F.coalesce(F.get(at, p + 1) - x, F.lit(3)), F.lit(3)))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    def found(w):
        return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(_let(_let(windows(w), twice), covered))

    # bound, so that no rewrite of the plan can split the text anew for every window
    return _let(w, found)


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the word array replaced by whole-text counts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    x = docs.select("*", text.alias("_text"), words(text).alias("_w"), lines.alias("_lines"))
    return x.select(
        *docs.columns,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_w")).alias("n_repeat_words"),
        F.regexp_count("_text", F.lit(r"[^\p{L}\p{N}\s]")).cast("long").alias("n_marks"),
        F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
    )


def _measures(x: DataFrame) -> DataFrame:
    """Add the measures that the fences judge; all are 0 or more, and 0 where there are no words."""
    def rate(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return x.withColumns({
        "word_len": rate("word_chars", "n_words"), "symbol_rate": rate("n_symbols", "n_words"),
        "dup_line_rate": rate("n_dup_lines", "n_lines"), "repeat_rate": rate("n_repeat_words", "n_words"),
        "mark_rate": rate("n_marks", "n_words"), "upper_rate": rate("n_upper", "word_chars"),
    })


def sketches(x: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, bucket, n): bucket null holds the zeros, b the values in (GAMMA**(b-1), GAMMA**b]."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in MEASURES])).alias("p")
    bucket = F.when(F.col("p.v") > 0, F.ceil(F.ln("p.v") / F.ln(F.lit(GAMMA))))
    return x.select(*keys, pairs).groupBy(*keys, F.col("p.measure").alias("measure"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: docs, and lo_<measure>/hi_<measure> from the merged sketch's quartiles.

    The windows run over sketch buckets (a few hundred per key and measure), never over documents.
    """
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "measure").orderBy(F.col("bucket").asc_nulls_first())
    run = merged.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    value = F.coalesce(F.lit(2.0) * F.pow(F.lit(GAMMA), F.col("bucket")) / F.lit(1.0 + GAMMA), F.lit(0.0))
    total = run.groupBy(*keys, "measure").agg(
        F.max("upto").alias("docs"), F.collect_list(F.struct(F.col("upto"), value.alias("v"))).alias("run"))

    def quantile(q: float) -> Column:
        return F.array_min(F.transform(F.filter("run", lambda r: r["upto"] >= q * F.col("docs")), lambda r: r["v"]))

    quartiles = total.select(*keys, "measure", "docs", quantile(0.25).alias("q1"), quantile(0.75).alias("q3"))
    aggs = [F.max("docs").alias("docs")]
    for m, least in MEASURES.items():
        span = F.greatest(F.lit(FENCE) * (F.col("q3") - F.col("q1")), F.lit(least))
        if m in LOWER:
            aggs.append(F.max(F.when(F.col("measure") == m, F.col("q1") - span)).alias(f"lo_{m}"))
        aggs.append(F.max(F.when(F.col("measure") == m, F.col("q3") + span)).alias(f"hi_{m}"))
    return quartiles.groupBy(*keys).agg(*aggs)


def _prepared(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """The counts, measures and base verdict of every row, with the row itself in ``_doc``."""
    x = docs.select(F.struct("*").alias("_doc"), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"), F.col(text_col).alias("_body"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    return _measures(counts(x, "_body").drop("_body")).withColumn("base_failed", failed)


def _fence_table(measured: DataFrame) -> DataFrame:
    """The fences that hold for each language and source."""
    fine = stored(sketches(measured.where("not base_failed"), ["_lang", "_source"]), "sketches")
    by_source = fences(fine, ["_lang", "_source"]).alias("s")
    by_lang = fences(fine, ["_lang"]).alias("g")
    overall = fences(fine, []).first()  # one row of fences
    table = by_source.join(by_lang, F.col("s._lang").eqNullSafe(F.col("g._lang")))

    def pick(c: str) -> Column:
        rest = overall[c] if (overall["docs"] or 0) >= MIN_DOCS else None
        return (F.when(F.col("s.docs") >= MIN_DOCS, F.col(f"s.{c}")).when(F.col("g.docs") >= MIN_DOCS, F.col(f"g.{c}"))
                .otherwise(F.lit(rest).cast("double")).alias(c))

    limits = [c for c in overall.asDict() if c != "docs"]
    return stored(table.select(F.col("s._lang").alias("_l"), F.col("s._source").alias("_s"), *[pick(c) for c in limits]), "fences")


def _verdict(measured: DataFrame, table: DataFrame) -> DataFrame:
    out = F.lit(False)
    for m in MEASURES:
        out = out | F.coalesce(F.col(m) > F.col(f"hi_{m}"), F.lit(False))
        if m in LOWER:
            out = out | F.coalesce(F.col(m) < F.col(f"lo_{m}"), F.lit(False))
    y = measured.join(table, F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s")), "left")
    # one expression over both sides of the join: a filter on it is not pushed into the text counts
    return y.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(~out)).drop("_lang", "_source", *table.columns)


def judged(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts, measures, ``base_failed`` and ``kept`` for every row of ``docs``; the other columns of the row are in the struct ``doc``.

    A null text counts as empty; empty texts have no words and so fail the base rules. Null languages
    and sources form strata of their own. Documents that fail the base rules do not enter the
    sketches. With fewer than MIN_DOCS documents in all, no fence applies. Repeated rows count each,
    columns of any name pass in ``doc``, and an empty table gives no rows.
    """
    rest = [F.col("_doc")[c].alias(c) for c in docs.columns if c != text_col]
    x = _prepared(docs, text_col, lang_col, source_col)
    x = stored(x.withColumn("_doc", F.struct(*rest)), "quality")
    return _verdict(x, _fence_table(x)).withColumnRenamed("_doc", "doc")


def filtered(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns; see ``judged``.

    The texts are read twice, once for the sketches and once for the verdict, rather than written.
    """
    x = _prepared(docs, text_col, lang_col, source_col)
    measured = stored(x.drop("_doc"), "quality")
    return _verdict(x, _fence_table(measured)).where("kept").select("_doc.*")


def q_op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    x = judged(documents(spark, sf_dir, "doc_id", "text", "lang", "source"))
    return x.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
