"""Events of news items, sentence by sentence (R4, R12) and each with its own date.

A text is cut into sentences and words with positions. Only words that some event rule names, and dates,
go on (a broadcast join with the lexicon, a rule table): texts are neither shuffled nor scanned once
per rule. Windows over the positions of a sentence tell which rule words stand within each frame
around a word, as one bit per word set, so that a rule is a comparison of bits whatever the word
order. A negator before an anchor, or a lifting word after it, denies it; a
lifting or carve-out word that is itself negated counts for nothing.

An event is dated by the nearest date of its sentence (in words), else of the nearest sentence with
one (of two as near, the earlier place in the text), else by the item's publication.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom import rules

# Text marks: a full stop of an abbreviation ends no sentence; dates become one word each.
ABBREVIATION_PATTERN = r"(^|[^A-Za-z])(" + "|".join(rules.ABBREVIATIONS) + r"|[A-Z](?:\.[A-Z])*)\."
ISO_PATTERN = r"([0-9]{4})-([0-9]{2})-([0-9]{2})"
PERIOD_PATTERN = r"(Q[1-4]|FY) ?(20[0-9]{2})"
SENTENCE_END = r"[.!?;]+(?:[ \t\r\n]|\z)|[\r\n]+"
ISO_WORD = "dateiso"
PERIOD_WORD = "dateper"
PERIOD_MONTHS = {"q1": 3, "q2": 6, "q3": 9, "q4": 12, "fy": 12}
BITS = (*rules.FRAMES, "sentence", "negator", "lifter")


def _sets(frame: str, part: int) -> dict[tuple[str, ...], int]:
    """The word sets that rules look for in a frame, numbered."""
    found: dict[tuple[str, ...], int] = {}
    for rule in rules.EVENT_RULES:
        for condition in rule[4] + rule[5]:
            name, words = condition.split(":")
            if name == frame:
                found.setdefault(tuple(words.split()), len(found))
    if len(found) > 62:
        raise ValueError(f"too many word sets for the bits of frame {frame}")
    return found


def lexicon_rows() -> list[tuple]:
    """(word, a long of bits per name in BITS) for every word of every rule."""
    words: dict[str, dict[str, int]] = {}
    for frame in (*rules.FRAMES, "sentence"):
        for members, bit in _sets(frame, 4).items():
            for w in members:
                bits = words.setdefault(w, {})
                bits[frame] = bits.get(frame, 0) | 1 << bit
    for name, members in (("negator", rules.NEGATORS), ("lifter", rules.LIFTERS)):
        for w in members.split():
            words.setdefault(w, {})[name] = 1
    for rule in rules.EVENT_RULES:
        for w in rule[3].split():
            words.setdefault(w, {})
    return [(w, *[bits.get(b, 0) for b in BITS]) for w, bits in sorted(words.items())]


def rule_rows() -> list[tuple]:
    """(word, ord, kind, name, level, need and block bits per frame) for every anchor word of every rule."""
    frames = (*rules.FRAMES, "sentence")
    sets = {f: _sets(f, 4) for f in frames}

    def bits(conditions):
        out = dict.fromkeys(frames, 0)
        for c in conditions:
            frame, words = c.split(":")
            out[frame] |= 1 << sets[frame][tuple(words.split())]
        return [out[f] for f in frames]

    return [(w, i, kind, name, level, *bits(needs), *bits(blocks))
            for i, (name, kind, level, anchors, needs, blocks) in enumerate(rules.EVENT_RULES) for w in anchors.split()]


def _lexicon(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(lexicon_rows(), "word string, " + ", ".join(f"{b} long" for b in BITS)))


def _rules(spark: SparkSession) -> DataFrame:
    frames = (*rules.FRAMES, "sentence")
    schema = "word string, ord int, kind string, name string, level int, " + ", ".join(f"{p}_{f} long" for p in ("need", "block") for f in frames)
    return F.broadcast(spark.createDataFrame(rule_rows(), schema))


def marked_text(text: Column) -> Column:
    """The text with abbreviations unstopped and each date as one word."""
    t = F.regexp_replace(text, ABBREVIATION_PATTERN, "$1$2\x01")
    t = F.regexp_replace(t, ISO_PATTERN, f" {ISO_WORD}$1$2$3 ")
    return F.regexp_replace(t, PERIOD_PATTERN, f" {PERIOD_WORD}$1x$2 ")


def word_date(word: Column) -> Column:
    """The date that a date word stands for: an ISO date, or the last day of a named period; else null."""
    iso = F.when(word.startswith(ISO_WORD), F.concat_ws("-", F.substring(word, 8, 4), F.substring(word, 12, 2), F.substring(word, 14, 2))).try_cast("date")
    month = F.lit(None).cast("int")
    for name, m in PERIOD_MONTHS.items():
        month = F.when(F.substring(word, 8, 2) == name, F.lit(m)).otherwise(month)
    period = F.when(word.startswith(PERIOD_WORD), F.last_day(F.make_date(F.substring(word, 11, 4).try_cast("int"), month, F.lit(1))))
    return F.coalesce(iso, period)


def rule_words(items: DataFrame) -> DataFrame:
    """(item_id, published_on, sent, pos, word, event_on, bits): the rule words and dates of every item, with their places."""
    s = items.select("item_id", "published_on", F.posexplode_outer(F.split(marked_text(F.col("text")), SENTENCE_END)).alias("sent", "_s"))
    words = F.split(F.trim(F.lower(F.regexp_replace("_s", rules.NON_WORD_PATTERN, " "))), " ")
    w = s.select("item_id", "published_on", "sent", F.posexplode_outer(words).alias("pos", "word"))
    j = w.join(_lexicon(items.sparkSession), "word", "left").withColumn("event_on", word_date(F.col("word")))
    return j.where(F.col("near").isNotNull() | F.col("event_on").isNotNull()).na.fill(0, list(BITS))


def events(items: DataFrame) -> DataFrame:
    """(item_id, sent, ord, kind, name, level, event_on, dated_by): one row per sentence and rule name that fires.

    ``items`` has item_id, text and published_on. ord is the rule's place in the table; of several
    anchors of a sentence the first gives the date. Items without events give no rows, and so do null texts.
    """
    spark = items.sparkSession
    # both windows below are satisfied by one shuffle of the few words that rules name
    hits = rule_words(items).repartition("item_id")
    sentence = Window.partitionBy("item_id", "sent").orderBy("pos")

    def around(name: str, frame: tuple[int, int]) -> Column:
        return F.coalesce(F.bit_or(name).over(sentence.rangeBetween(*frame)), F.lit(0).cast("long"))

    negated = around("negator", rules.NEGATION_BEFORE) != 0
    x = hits.withColumn("negated", negated)
    x = x.withColumns({name: F.when(F.col("negated"), F.lit(0).cast("long")).otherwise(F.col(name)) for name in ("lifter", "sentence")})
    whole = Window.partitionBy("item_id", "sent").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = {f"in_{f}": around(f, frame) for f, frame in rules.FRAMES.items()} | {
        "in_sentence": F.bit_or("sentence").over(whole), "denied": F.col("negated") | (around("lifter", rules.NEGATION_AFTER) != 0)}
    x = x.withColumns(seen)
    # the nearest dates before and behind, in the order of the text
    place = F.when(F.col("event_on").isNotNull(), F.struct("sent", "pos", "event_on", F.when(F.col("word").startswith(ISO_WORD), "iso").otherwise("period").alias("dated_by")))
    text = Window.partitionBy("item_id").orderBy("sent", "pos")
    x = x.withColumn("_date", place).withColumns({
        "before": F.last("_date", ignorenulls=True).over(text.rowsBetween(Window.unboundedPreceding, -1)),
        "behind": F.first("_date", ignorenulls=True).over(text.rowsBetween(1, Window.unboundedFollowing))})
    fired = x.join(_rules(spark), "word")
    for f in (*rules.FRAMES, "sentence"):
        seen_bits = F.col(f"in_{f}")
        fired = fired.where((seen_bits.bitwiseAND(F.col(f"need_{f}")) == F.col(f"need_{f}")) & (seen_bits.bitwiseAND(F.col(f"block_{f}")) == 0))
    fired = fired.where((F.col("kind") != "rubric") | ~F.col("denied"))

    def away(side: str) -> Column:
        same = F.col(f"{side}.sent") == F.col("sent")
        # dates of the sentence itself come before all others
        return F.when(same, F.struct(F.lit(0).alias("s"), F.abs(F.col(f"{side}.pos") - F.col("pos")).alias("p"))).otherwise(
            F.struct(F.abs(F.col(f"{side}.sent") - F.col("sent")).alias("s"), F.lit(0).alias("p")))

    first = F.col("before").isNotNull() & (F.col("behind").isNull() | (away("before") <= away("behind")))
    fired = fired.withColumn("_d", F.when(first, F.col("before")).otherwise(F.col("behind")))
    dated = fired.select("item_id", "sent", "kind", "name", "level", "ord", "pos", F.coalesce(F.col("_d.event_on"), "published_on").alias("event_on"),
                         F.when(F.col("_d.event_on").isNotNull(), F.col("_d.dated_by")).when(F.col("published_on").isNotNull(), "published").alias("dated_by"))
    out = dated.groupBy("item_id", "sent", "kind", "name", "level").agg(
        F.min("ord").alias("ord"), F.min_by(F.struct("event_on", "dated_by"), "pos").alias("_e"))
    return out.select("item_id", "sent", "ord", "kind", "name", "level", "_e.event_on", "_e.dated_by")
