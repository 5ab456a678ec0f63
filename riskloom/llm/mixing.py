"""Operator 8: mix sources to target weights.

Every document gets a hash-random key. Sources are range-sorted by that key and prefix sums of word
counts run along the order, so the cut falls exactly on each source's budget; whole epochs come
first when a budget exceeds its source. The prefix sums are distributed: keys fall into buckets of a
bounded number of documents, sums run inside buckets, and bucket totals carry the offsets, so a
source with a third of all rows is spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import GAP, documents, power_of_two, stored
from riskloom.operators.ordering import global_position

WEIGHTS = (3, 1, 2)      # by source in code point order, null last, repeating
SHARE = 1.5              # of all words
MOST = 2.0               # times a source's words
BUCKET_DOCS = 20_000     # documents that one bucket of keys aims to hold
SEED = 20_240_501


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")).cast("long")


def random_key(id_col: str, text_col: str) -> Column:
    """A hash-random key of 63 bits, the same in every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col(id_col), F.col(text_col)), 1)


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    The budget is shared by weight; a source's target stops at ``most`` times its size and the excess
    is reshared among the others, until none is above. Each round is one sum over the sources.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_position(sources, [F.col("source").asc_nulls_last()], "place")
    at = F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int")
    table = stored(ranked.select(
        "source", "source_size", F.get(F.array(*[F.lit(float(w)) for w in weights]), at).alias("weight"),
        (F.col("source_size") * most).alias("cap")), "sources")
    budget = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    rate = 0.0
    while True:
        # a source that reaches its cap at some rate stays there, as the rate only rises
        full = F.lit(rate) * F.col("weight") >= F.col("cap")
        r = table.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not r[1]:
            break
        now = (budget - r[0]) / r[1]
        if now <= rate:
            break
        rate = now
    return table.select("source", "source_size", F.least("cap", F.lit(rate) * F.col("weight")).alias("target"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights=WEIGHTS, share: float = SHARE, most: float = MOST, whole: bool = False) -> DataFrame:
    """(doc_id, key, source, size, source_size, target, taken) for every row of ``docs``.

    ``taken`` counts the words the mix takes of the document, repeats included: whole epochs of its
    source, then its part of the last epoch, cut at the budget to the word. With ``whole`` the
    document at the cut is taken wholly if at least half of it falls inside, so taken is a multiple
    of size. Reruns agree: the order is a hash of id and text, and ties are the same document.
    Null texts have size 0 and take 0; a null source is a source of its own, placed last; sources
    without words get target 0. Null ids are allowed, repeated rows count each, other columns are
    ignored, and an empty table gives no rows.
    """
    sized = stored(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        random_key(id_col, text_col).alias("key")), "sized")
    goal = stored(targets(sized, weights, share, most), "targets").withColumnRenamed("source", "goal_source")
    bits = power_of_two(sized.count() / BUCKET_DOCS)
    x = sized.join(goal, F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")
    x = x.withColumn("bucket", F.shiftright("key", 63 - bits) if bits else F.lit(0).cast("long"))
    sums = sized.withColumn("bucket", F.shiftright("key", 63 - bits) if bits else F.lit(0).cast("long")).groupBy(
        F.col("source").alias("s"), F.col("bucket").alias("b")).agg(F.sum("size").alias("n"))
    along = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(sums.select("s", "b", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("offset")), "offsets")
    inside = Window.partitionBy("source", "bucket").orderBy("key", F.col("doc_id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    x = x.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    before = F.col("offset") + F.col("local")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - epochs * F.col("source_size")
    part = F.least(F.greatest(F.floor(rest).cast("long") - before, F.lit(0).cast("long")), F.col("size"))
    if whole:
        part = F.when((part > 0) & (2 * part >= F.col("size")), F.col("size")).otherwise(F.lit(0).cast("long"))
    return x.select("doc_id", "key", "source", "size", "source_size", "target", (epochs * F.col("size") + part).alias("taken"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **goals) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the mix takes it, with the columns of ``docs``.

    Documents are taken whole. A source's order is cut at one key, so the texts need no shuffle:
    they meet a table of one row per source. Documents without words are not taken.
    """
    m = mixed(docs, id_col, text_col, source_col, whole=True, **goals)
    epochs = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("source_size"))).cast("long")
    cuts = stored(m.where("size > 0").groupBy("source").agg(
        F.max(epochs).alias("epochs"), F.max(F.when(F.col("taken") > epochs * F.col("size"), F.col("key"))).alias("cut")), "cuts")
    x = docs.select(F.struct("*").alias("_doc"), F.col(source_col).alias("_source"), random_key(id_col, text_col).alias("_key"), word_count(F.col(text_col)).alias("_size"))
    x = x.join(cuts, F.col("_source").eqNullSafe(F.col("source")))
    times = F.col("epochs") + F.when(F.col("_key") <= F.col("cut"), 1).otherwise(0)
    copies = F.when(F.col("_size") > 0, times).otherwise(0).cast("int")
    return x.select("_doc", F.explode(F.array_repeat(F.lit(0), copies)).alias("_copy")).select("_doc.*")


def q_op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir, "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")
