"""Near-copy syndication (Jaccard >= 0.8 on word 3-gram sets), exact, without all-pairs.

Definition (ours, deterministic): an item *cites* the most authoritative item (lowest
(tier, undated, published_on, item_id)) whose shingle set has Jaccard >= threshold with its
own, itself included. Items that cite themselves are kept; the others are syndicated copies.

Search, as Spark jobs:

1. Shingles are xxhash64 of word 3-grams of the normalised text (items under 3 words have
   none and cite themselves). How common a shingle is, is estimated by counting hashes into a table of
   fixed size, so that every item orders its own shingles in place, rare ones first, without a shuffle.
2. Prefix filter: in any order that all items share, a pair with J >= t shares one of the first
   ``n - ceil(t*n) + 1`` shingles of each side. Only prefixes are shuffled, and only shingles that
   stand in two prefixes or more go on.
3. Positional filter by length band: behind its place in both orders, the first shared shingle must leave
   room for the overlap that the two lengths need. An entry is listed for, and looks into, only those bands of
   partner lengths for which its place leaves that room and in which its shingle stands. Posting lists are keyed by
   (shingle, band, partner band).
4. In the first round every item meets the best item of each of its lists, found where the rows of a shingle are filtered. Lists in
   which that item was better than a member and than all that the member may cite are ranked by
   authority (skew-safe ``keyed_sequence``). Further rounds walk the ranks in
   blocks that double: an item meets the items of the next block that are better than it and than its
   best verified citation so far. Pairs pass the length and position filters and are verified exactly. An
   entry stops as soon as the next rank is no better, so a dense cluster resolves in one round (every
   member meets the cluster's leader first), and the number of rounds is logarithmic in the longest
   list.

The sets are written once; a round moves only those of its pairs (all, from ``SENT_ITEMS`` items on). Citations are
checkpointed in each round; the other tables are Parquet files that are deleted when they are spent, and the shuffle
files of each step go with its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import rules
from riskloom.operators.ordering import keyed_sequence
from riskloom.session import delete_path, materialize, spent_shuffles_deleted, written

THRESHOLD = 0.8
SHINGLE_WORDS = 3
RANK_BLOCK = 4          # ranks met in the first round (only the best of a list), doubled in each further one
COUNT_CELLS = 1 << 16   # cells that shingles are counted into, for their order
BAND_RATIO = 1.1        # lengths of a band differ by this factor at most
SENT_ITEMS = 200_000    # so many ids or fewer are sent to the texts or sets that they pick
SENT_ENTRIES = 20_000   # so many entries or fewer are sent to the lists that they walk
PART = 6                # a pair's overlap is first counted on one of so many parts of its shingles


def words_of(text: Column) -> Column:
    """Normalised words of a text (computed once per row, then indexed)."""
    return F.split(F.trim(F.lower(F.regexp_replace(text, rules.NON_WORD_PATTERN, " "))), " ")


def with_shingles(df: DataFrame, text: str = "text", out: str = "shingles") -> DataFrame:
    """Add sorted distinct xxhash64 of the word 3-grams. The words are a column of their own:
    referencing the split expression inside the lambda would redo it for every element."""
    x = df.withColumn("_words", words_of(F.col(text)))
    return x.withColumn(out, shingle_hashes(F.col("_words"))).drop("_words")


def shingle_hashes(words: Column) -> Column:
    """Sorted distinct xxhash64 of the 3-grams of a word-array column (an attribute)."""
    n = F.size(words)
    grams = F.transform(
        F.sequence(F.lit(1), n - (SHINGLE_WORDS - 1)),
        lambda i: F.xxhash64(F.concat_ws(" ", *[F.element_at(words, i + k) for k in range(SHINGLE_WORDS)])),
    )
    return F.when(n >= SHINGLE_WORDS, F.array_sort(F.array_distinct(grams))).otherwise(F.array().cast("array<bigint>"))


def quality(prefix: str = "") -> Column:
    """Authority order: lower tier, dated before undated, earlier, lower id."""
    p = prefix
    return F.struct(F.col(f"{p}tier").alias("tier"), F.col(f"{p}published_on").isNull().alias("undated"),
                    F.col(f"{p}published_on").alias("published_on"), F.col(f"{p}item_id").alias("item_id"))


def _cell(shingle: Column) -> Column:
    return F.pmod(shingle, F.lit(COUNT_CELLS)).cast("int")


def _cell_counts(base: DataFrame) -> Column:
    """How many shingles fall into each cell, as an array of COUNT_CELLS longs (a scalar of fixed size)."""
    hits = base.select(F.explode_outer("shingles").alias("s")).where(F.col("s").isNotNull()).groupBy(_cell(F.col("s")).alias("id")).agg(F.count(F.lit(1)).alias("f"))
    cells = base.sparkSession.range(COUNT_CELLS).join(hits, "id", "left")
    dense = F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("f", F.lit(0)).alias("f")))), lambda x: x["f"])
    return cells.agg(dense.alias("f")).scalar()


def _band(n: Column) -> Column:
    return F.floor(F.log(n) / F.log(F.lit(BAND_RATIO))).cast("int")


def _needed(n: Column, m: Column, threshold: float) -> Column:
    """The overlap that sets of n and m shingles need (a hair less, for rounding)."""
    return (n + m) * F.lit(threshold / (1 + threshold)) - F.lit(1e-9)


def _entries(prefix: DataFrame, threshold: float) -> DataFrame:
    """Prefix rows with each band of partner lengths for which their place leaves room.

    ``lo`` and ``hi`` are the lowest and the highest band in which the row's shingle stands in a prefix.
    """
    n, room = F.col("n"), F.col("n") - F.col("pos")
    least, most = F.ceil(n * threshold - 1e-9), F.floor(n / threshold + 1e-9)
    # the shortest partner of a band needs the least overlap
    shortest = F.greatest(least, F.ceil(F.pow(F.lit(BAND_RATIO), F.col("partner")) - 1e-9))
    bands = F.filter(F.sequence(_band(F.greatest(least, F.lit(1))) - 1, _band(most) + 1), lambda b: b.between(F.col("lo"), F.col("hi")))
    x = prefix.withColumns({"band": _band(n), "partner": F.explode(bands)}).drop("lo", "hi")
    return x.where(room >= _needed(n, F.greatest(shortest, F.lit(1)), threshold))


def _faced(entries: DataFrame) -> DataFrame:
    """The ``entries`` that face others, with ``m``, the best one that an entry faces (null if that is no better than the entry).

    An entry of one band for partners of another faces the entries of that band for partners of its own. All rows of
    a shingle are together already, so this moves nothing.
    """
    facing = Window.partitionBy("s", F.least("band", "partner"), F.greatest("band", "partner"))
    up, down = F.col("band") <= F.col("partner"), F.col("band") >= F.col("partner")
    one = F.struct(quality().alias("qj"), F.col("n").alias("nj"), F.col("pos").alias("pj"))
    x = entries.withColumns({
        "_m": F.when(up, F.min(F.when(down, one)).over(facing)).otherwise(F.min(F.when(up, one)).over(facing)),
        "_f": F.count(F.lit(1)).over(facing)})
    x = x.where(F.col("_m").isNotNull() & ((F.col("band") != F.col("partner")) | (F.col("_f") > 1)))
    return x.withColumn("m", F.when(F.col("_m.qj") < quality(), F.col("_m"))).drop("_m", "_f")


def _with_overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (i, j, ...) with ``inter``, how many shingles of the sets (item_id, shingles) they share, and the sets' sizes.

    The sets of few items are chosen before they are moved; of many, all are moved.
    """
    ids = pairs.select(F.col("i").alias("item_id")).union(pairs.select("j")).distinct()
    if ids.count() <= SENT_ITEMS:
        sets = sets.join(F.broadcast(ids), "item_id", "left_semi")
    x = (pairs.join(sets.select(F.col("item_id").alias("i"), F.col("shingles").alias("si")), "i")
         .join(sets.select(F.col("item_id").alias("j"), F.col("shingles").alias("sj")), "j"))
    return x.withColumns({"inter": F.size(F.array_intersect("si", "sj")), "mi": F.size("si"), "mj": F.size("sj")}).drop("si", "sj")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float, made: list[str]) -> DataFrame:
    """(i, qj, sim) of those pairs (i, j, qj, n, nj) that reach the threshold.

    A part of the shingles bounds the overlap: of the others, no more than the smaller set has can be shared. Half of
    their bits do for it: one shingle fewer for two that look alike is one more among the others.
    """
    halves = F.transform(F.filter("shingles", lambda s: F.pmod(s, F.lit(PART)) == 0), lambda s: F.shiftright(s, 32).cast("int"))
    part = sets.withColumn("shingles", F.array_distinct(halves))
    most = F.col("inter") + F.least(F.col("n") - F.col("mi"), F.col("nj") - F.col("mj"))
    left = written(_with_overlaps(pairs, part).where(most >= _needed(F.col("n"), F.col("nj"), threshold)).select("i", "j", "qj", "n", "nj").distinct(), "near-left", made)
    inter = F.col("inter")
    jac = inter / (F.col("n") + F.col("nj") - inter)
    return _with_overlaps(left, sets).select("i", "qj", jac.alias("sim")).where(F.col("sim") >= threshold)


def _met(best: DataFrame | None, cand: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``best`` (i, qb, sim), the best citation so far of those that have one, after the pairs of ``cand`` have met."""
    o = _needed(F.col("n"), F.col("nj"), threshold)
    cand = cand.where((F.col("n") - F.col("pos") >= o) & (F.col("nj") - F.col("pj") >= o)
                      & (F.col("nj") >= F.col("n") * threshold - 1e-9) & (F.col("n") >= F.col("nj") * threshold - 1e-9))
    made: list[str] = []
    pairs = written(cand.select("i", "j", "qj", "n", "nj").distinct(), "near-pairs", made)
    found = _verified(pairs, sets, threshold, made).groupBy("i").agg(F.min(F.struct("qj", "sim")).alias("_h")).select(
        "i", F.col("_h.qj").alias("qn"), F.col("_h.sim").alias("simn"))
    if best is None:
        best = materialize(found.select("i", F.col("qn").alias("qb"), F.col("simn").alias("sim")))
    else:
        newer = F.col("qn").isNotNull() & (F.col("qb").isNull() | (F.col("qn") < F.col("qb")))
        best = materialize(best.join(found, "i", "full").select(
            "i", F.when(newer, F.col("qn")).otherwise(F.col("qb")).alias("qb"), F.when(newer, F.col("simn")).otherwise(F.col("sim")).alias("sim")))
    for path in made:
        delete_path(pairs.sparkSession, path)
    return best


def _open(x: DataFrame, best: DataFrame) -> DataFrame:
    """Rows whose ``qj`` is better than the item itself and than its best citation so far."""
    return x.join(best.select("i", "qb"), "i", "left").where((F.col("qj") < F.col("qi")) & (F.col("qb").isNull() | (F.col("qj") < F.col("qb")))).drop("qb")


def _walking(active: DataFrame, many: int, posting: DataFrame, lists: list[str], start: int, block: int, width: int) -> DataFrame:
    """The ``many`` rows of ``active`` with each row of ``posting`` from rank ``start`` on, ``block`` of them, in their list.

    How many there are is counted: a table's size on disk says little of what it takes in the driver, where sent rows pass.
    Many are not sent, and are repeated for each ``width`` ranks only.
    """
    ahead = posting.where(F.col("rank").between(start, start + block - 1))
    if many <= SENT_ENTRIES:
        return ahead.join(F.broadcast(active), lists)
    part = F.floor((F.col("rank") - start) / width).cast("int")
    parts = F.explode(F.sequence(F.lit(0), F.lit((block - 1) // width))).alias("part")
    return active.select("*", parts).hint("merge").join(ahead.withColumn("part", part), [*lists, "part"]).drop("part")


def near_copy_citations(items: DataFrame, threshold: float = THRESHOLD, block: int = RANK_BLOCK) -> DataFrame:
    """items: (item_id, tier, published_on, shingles, ...) -> (item_id, cite_id, similarity, ...)."""
    with spent_shuffles_deleted(items.sparkSession):
        return _citations(items, threshold, block)


def _citations(items: DataFrame, threshold: float, block: int) -> DataFrame:
    carried = [c for c in items.columns if c not in ("item_id", "tier", "published_on", "shingles")]
    made: list[str] = []  # tables that are deleted at the end
    base = written(items.select("item_id", "tier", "published_on", "shingles", F.size("shingles").alias("n"), *carried), "near-items", made)
    p_len = (F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1).cast("int")
    x = base.select("item_id", "tier", "published_on", "n", "shingles", p_len.alias("_p"), _cell_counts(base).alias("_f")).where("item_id is not null")
    by_rarity = F.array_sort(F.transform("shingles", lambda s: F.struct(F.get("_f", _cell(s)).alias("f"), s.alias("s"))))
    first = F.transform(F.slice(by_rarity, 1, F.col("_p")), lambda e: e["s"])
    prefix = x.select("item_id", "tier", "published_on", "n", F.posexplode_outer(first).alias("pos", "s")).where(F.col("s").isNotNull())
    # counted where the shingle's rows come together for the filter, so they are moved once and not written
    band, same = _band(F.col("n")), Window.partitionBy("s")
    shared = prefix.withColumns({"f": F.count(F.lit(1)).over(same), "lo": F.min(band).over(same), "hi": F.max(band).over(same)}).where("f > 1").drop("f")
    entries = written(_faced(_entries(shared, threshold)), "near-entries", made)
    sets, lists = base.select("item_id", "shingles"), ["s", "of", "to"]
    listed = entries.select("s", F.col("band").alias("of"), F.col("partner").alias("to"), quality().alias("qj"),
                            F.col("n").alias("nj"), F.col("pos").alias("pj"), F.col("item_id").alias("j"))
    # the first round needs no ranks: an entry meets the best one that it faces, listed for its own band in the list of its partner band
    active = entries.where("m is not null").select(
        F.col("item_id").alias("i"), "s", F.col("partner").alias("of"), F.col("band").alias("to"), "n", "pos", quality().alias("qi"),
        "m.*", F.col("m.qj.item_id").alias("j"))
    best = _met(None, active, sets, threshold)
    # what is open now goes on from the second rank
    active = written(_open(active, best).select("i", *lists, "n", "pos", "qi"), "near-active", made)
    start, width = 2, 2 * block  # all entries stand at the same rank
    if many := active.count():
        walked = written(listed.join(active.select(*lists).distinct(), lists, "left_semi"), "near-walked", made).select(
            F.struct(*lists).alias("key"), "qj", "qj.*", "nj", "pj", "j")
        posting = written(keyed_sequence(
            walked, key="key", order=("tier", "undated", "published_on", "item_id", "nj", "pj"),
            bucket=F.struct("tier", "undated", "published_on"), seq_col="rank").select("key.*", "rank", "j", "qj", "nj", "pj"), "near-posting", made)

        def left(active: DataFrame, many: int) -> DataFrame:
            """The entries for which the rank at ``start`` still holds an item better than them and than their best."""
            at_next = posting.select(*lists, "rank", "qj")
            return written(_open(_walking(active, many, at_next, lists, start, 1, 1), best).select("i", *lists, "n", "pos", "qi"), "near-active", made)

        active = left(active, many)
        while many := active.count():  # every round moves all rows on by a block, so the walk ends
            block *= 2
            best = _met(best, _open(_walking(active, many, posting, lists, start, block, width), best), sets, threshold)
            start += block
            active = left(active, many)
    kept: list[str] = []  # what the result reads
    own = written(base.select("item_id", *carried), "near-carried", kept)
    for path in made:
        delete_path(items.sparkSession, path)
    cited = own.select("item_id").join(best.withColumnRenamed("i", "item_id"), "item_id", "left").select(
        "item_id", F.coalesce(F.col("qb.item_id"), F.col("item_id")).alias("cite_id"), F.coalesce(F.col("sim"), F.lit(1.0)).alias("similarity"))
    return cited.join(own, "item_id") if carried else cited


def representatives(citations: DataFrame) -> DataFrame:
    """(item_id, rep_id): the item at the end of each chain of citations, by pointer jumping.

    A cited item is always more authoritative, so chains end; each round doubles the steps gone.
    """
    at = citations.select("item_id", F.col("cite_id").alias("rep_id"))
    while True:
        ahead = at.select(F.col("item_id").alias("rep_id"), F.col("rep_id").alias("next"))
        at = materialize(at.join(ahead, "rep_id", "left").select(
            "item_id", F.coalesce("next", "rep_id").alias("rep_id"), (F.coalesce("next", "rep_id") != F.col("rep_id")).alias("moved")))
        if at.where("moved").isEmpty():
            return at.select("item_id", "rep_id")
        at = at.select("item_id", "rep_id")


def without_copies(items: DataFrame, texts: DataFrame) -> DataFrame:
    """``items`` less near copies: of each cluster of one vendor's items the representative stays.

    ``texts`` has the item's item_id, vendor, tier, published_on and text; only texts of ``items`` are shingled.
    """
    own = with_shingles(texts.join(items.select("item_id"), "item_id", "left_semi"))
    # shingles of different vendors never meet
    own = own.select("item_id", "tier", "published_on", F.transform("shingles", lambda s: F.xxhash64("vendor", s)).alias("shingles"))
    kept = representatives(near_copy_citations(own)).where("item_id = rep_id").select("item_id")
    return items.join(kept, "item_id", "left_semi")
