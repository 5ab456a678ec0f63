"""News-selection operators (re-aimed rules): search worklist (R1), entity confirmation (R2),
recency (R3), scope (R4), event dating (R5), source tier (R6), exact syndication (R7),
scale figures (R9), writing rules (R10), items per vendor (R11), rubric matches (R12).

Text work is a narrow projection (JVM regex over whole texts, no UDF); only compact
derived columns travel through shuffles.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import rules
from riskloom.operators.events import events
from riskloom.session import materialize


def norm_text(c) -> Column:
    """Padded lower-case word text (letters and digits of any script), the input of every lexicon pattern."""
    col = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit(" "), F.lower(F.regexp_replace(col, rules.NON_WORD_PATTERN, " ")), F.lit(" "))


def text_key(c) -> Column:
    """R7 key: md5 of the normalised text (syndicated copies share it)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.md5(F.trim(F.lower(F.regexp_replace(col, rules.NON_WORD_PATTERN, " "))))


# --- R1 ------------------------------------------------------------------------------


def normalise_query(c: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(c, rules.NON_WORD_PATTERN, " ")))


def search_worklist(book: DataFrame, aliases: DataFrame, as_of: dt.date) -> DataFrame:
    """Per vendor the distinct queries {name, alias, name + announcement, name + filing,
    name + year}; near-identical repeats (same normalised text) keep the first form."""
    vendors = book.select("vendor").where(F.col("vendor").isNotNull()).distinct()
    va = vendors.join(aliases.select("vendor", "alias"), "vendor", "left")
    v = F.col("vendor")
    forms = F.array(
        F.struct(F.lit(0).alias("ord"), F.lit("name").alias("kind"), v.alias("text")),
        F.struct(F.lit(1).alias("ord"), F.lit("alias").alias("kind"), F.col("alias").alias("text")),
        F.struct(F.lit(2).alias("ord"), F.lit("announcement").alias("kind"),
                 F.concat(v, F.lit(" " + rules.QUERY_SUFFIX_ANNOUNCEMENT)).alias("text")),
        F.struct(F.lit(3).alias("ord"), F.lit("filing").alias("kind"),
                 F.concat(v, F.lit(" " + rules.QUERY_SUFFIX_FILING)).alias("text")),
        F.struct(F.lit(4).alias("ord"), F.lit("year").alias("kind"),
                 F.concat(v, F.lit(f" {as_of.year}")).alias("text")),
    )
    q = va.select("vendor", F.explode(forms).alias("q")).where(F.col("q.text").isNotNull())
    q = q.withColumn("query_norm", normalise_query(F.col("q.text"))).where(F.col("query_norm") != "")
    g = q.groupBy("vendor", "query_norm").agg(F.min("q").alias("q"))
    return g.select("vendor", "query_norm", F.col("q.kind").alias("query_kind"), F.col("q.text").alias("query_text"))


# --- R2 ------------------------------------------------------------------------------

PHRASE_BITS = 1 << 22  # size of the filter of alias phrases; a full one only lets more phrases through
_WORD_BITS = 64


def phrase(c) -> Column:
    """A name or text as its lower-case words, with single spaces between them."""
    col = F.col(c) if isinstance(c, str) else c
    return F.trim(F.lower(F.regexp_replace(col, rules.NON_WORD_PATTERN, " ")))


def alias_index(aliases: DataFrame) -> DataFrame:
    """The phrase index: distinct (vendor, phrase) of all aliases that have words."""
    return aliases.select("vendor", phrase("alias").alias("phrase")).where("phrase <> ''").distinct()


def _bit(hashed: Column) -> Column:
    return F.pmod(hashed, F.lit(PHRASE_BITS))


def phrase_filter(index: DataFrame) -> Column:
    """A bit per hash of an indexed phrase, as an array of PHRASE_BITS / 64 longs (a scalar of fixed size)."""
    bit = _bit(F.xxhash64(F.split("phrase", " ")))
    ones = index.select(bit.alias("b")).distinct().groupBy((F.floor(F.col("b") / _WORD_BITS)).cast("long").alias("id")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(b % {_WORD_BITS} as int))")).alias("bits"))
    words = index.sparkSession.range(PHRASE_BITS // _WORD_BITS).join(ones, "id", "left")
    dense = F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")))), lambda x: x["bits"])
    return words.agg(dense.alias("filter")).scalar()


def _item_phrases(words: Column, lengths: list[int], bits: Column) -> Column:
    """The distinct runs of words of a text that may be an alias of someone: only these leave the scan."""
    none = F.array().cast("array<string>")

    def runs_of(n: int) -> Column:
        def listed(i):
            b = _bit(F.xxhash64(F.slice(words, i, n)))
            return F.getbit(F.get(bits, F.floor(b / _WORD_BITS).cast("int")), (b % _WORD_BITS).cast("int")) == 1

        at = F.filter(F.sequence(F.lit(1), F.size(words) - (n - 1)), listed)
        return F.when(F.size(words) >= n, F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(none)

    return F.array_distinct(F.concat(none, *[runs_of(n) for n in lengths]))


def confirm_entities(items: DataFrame, aliases: DataFrame) -> DataFrame:
    """R2: an item is confirmed when its text names its vendor or one of its aliases, word for word.

    The vendor's own name is looked for where the text is read. For the aliases, the text's word runs
    that pass the filter of all alias phrases meet the phrase index by (vendor, phrase). Ids and phrases are
    shuffled, never texts. A name without words is never mentioned; a null text mentions nothing.
    """
    index = materialize(alias_index(aliases))
    lengths = sorted(r[0] for r in index.select(F.size(F.split("phrase", " "))).distinct().collect())  # the word counts of aliases
    x = items.select("item_id", "vendor", phrase("text").alias("_text"), phrase("vendor").alias("_name"))
    padded = F.concat(F.lit(" "), F.col("_text"), F.lit(" "))
    named = (F.col("_name") != "") & F.contains(padded, F.concat(F.lit(" "), F.col("_name"), F.lit(" ")))
    x = x.select("item_id", "vendor", F.coalesce(named, F.lit(False)).alias("_named"), F.split("_text", " ").alias("_words"), phrase_filter(index).alias("_bits"))
    runs = _item_phrases(F.col("_words"), lengths, F.col("_bits"))
    x = x.select("item_id", "vendor", "_named", F.explode_outer(runs).alias("phrase"))
    x = x.join(index.select("vendor", "phrase", F.lit(True).alias("_known")), ["vendor", "phrase"], "left")
    g = x.groupBy("vendor", "item_id").agg(F.bool_or("_named").alias("_name"), F.coalesce(F.bool_or("_known"), F.lit(False)).alias("_alias"))
    by = F.when(F.col("_name"), F.lit("name")).when(F.col("_alias"), F.lit("alias"))
    return g.select("item_id", "vendor", (F.col("_name") | F.col("_alias")).alias("confirmed"), by.alias("matched_by"))


# --- R5, R3 ----------------------------------------------------------------------------

_ISO_DATE = r"([0-9]{4}-[0-9]{2}-[0-9]{2})"
_PERIOD = r"(Q[1-4]|FY) ?(20[0-9]{2})"


def event_date(text: Column, published_on: Column) -> tuple[Column, Column]:
    """Event date = first ISO date in the text, else the end of a named period
    (Q1..Q4, FY), else the publication date. Returns (event_on, dated_by)."""
    iso = F.nullif(F.regexp_extract(text, _ISO_DATE, 1), F.lit("")).try_cast("date")
    per = F.regexp_extract(text, _PERIOD, 1)
    year = F.nullif(F.regexp_extract(text, _PERIOD, 2), F.lit("")).cast("int")
    month = F.when(per == "Q1", 3).when(per == "Q2", 6).when(per == "Q3", 9).when(per.isin("Q4", "FY"), 12)
    period_end = F.last_day(F.make_date(year, month, F.lit(1)))
    event_on = F.coalesce(iso, period_end, published_on)
    dated_by = F.when(iso.isNotNull(), "iso").when(period_end.isNotNull(), "period").when(
        published_on.isNotNull(), "published")
    return event_on, dated_by


def _words_pattern(words) -> str:
    return " (" + "|".join(words) + ") "


def in_window(as_of: dt.date, days: int = rules.RECENCY_DAYS) -> Column:
    """R3, first half: published in (as_of - days, as_of]; undated items drop out. Only the
    publication date is used, so it reaches the scan before any text work."""
    start = F.date_sub(F.lit(as_of), days)
    return (F.col("published_on") > start) & (F.col("published_on") <= F.lit(as_of))


def not_stale(as_of: dt.date, days: int = rules.RECENCY_DAYS) -> Column:
    """R3, second half on item features (X13): an item about an event older than the window
    goes when its text states a conclusion and no continuing phrase."""
    start = F.date_sub(F.lit(as_of), days)
    stale = (F.col("event_on") < start) & F.col("concluded") & ~F.col("continuing")
    return ~F.coalesce(stale, F.lit(False))


def recency(items: DataFrame, as_of: dt.date, days: int = rules.RECENCY_DAYS) -> Column:
    """R3 predicate on item features: in the window and not a concluded older matter."""
    return in_window(as_of, days) & not_stale(as_of, days)


# --- R4, R12 -----------------------------------------------------------------------------


def item_base(items: DataFrame) -> DataFrame:
    """One narrow pass over whole texts: normalised text key, item date, and whether a matter is called
    concluded or continuing. The text itself is dropped."""
    norm = norm_text("text")
    event_on, dated_by = event_date(F.col("text"), F.col("published_on"))
    x = items.select(
        "item_id", "vendor", "outlet", "tier", "published_on",
        norm.alias("norm"), text_key("text").alias("text_key"),
        event_on.alias("event_on"), dated_by.alias("dated_by"),
    )
    return x.select(
        *[c for c in x.columns if c != "norm"],
        F.col("norm").rlike(_words_pattern(rules.CONCLUDING_WORDS)).alias("concluded"),
        F.col("norm").rlike(_words_pattern(rules.CONTINUING_PHRASES)).alias("continuing"),
    )


def item_features(items: DataFrame) -> DataFrame:
    """``item_base`` with the item's events: ``events`` in table order, and what rules ask of them."""
    found = events(items).groupBy("item_id").agg(F.array_sort(F.collect_list(
        F.struct("ord", "sent", "kind", "name", "level", "event_on", "dated_by"))).alias("events"))
    none = F.array().cast(found.schema["events"].dataType)
    x = item_base(items).join(found, "item_id", "left").withColumn("events", F.coalesce("events", none))

    def names(*kinds):
        return F.array_distinct(F.transform(F.filter("events", lambda e: e["kind"].isin(*kinds)), lambda e: e["name"]))

    def marked(name):
        return F.exists("events", lambda e: (e["kind"] == "mark") & (e["name"] == name))

    rubric = F.filter("events", lambda e: e["kind"] == "rubric")
    return x.select(
        "*", names("in").alias("in_categories"), names("out", "transit").alias("out_categories"),
        names("transit").alias("transit_categories"),
        F.array_distinct(F.transform(rubric, lambda e: F.struct(e["name"].alias("condition"), e["level"].alias("level")))).alias("rubric"),
        marked("new_models_only").alias("new_models_only"), marked("resolution").alias("is_resolution"),
    )


def scope(features: DataFrame) -> DataFrame:
    """In scope when an in-scope category (or a rubric indicator) fits. Goods in transit and the
    other out-of-scope kinds exclude their own events only; they are kept for the reason (R16)."""
    has_in = (F.size("in_categories") > 0) | (F.size("rubric") > 0)
    has_out = F.size("out_categories") > 0
    return features.select(
        "item_id", "vendor",
        has_in.alias("in_scope"),
        (has_in | has_out).alias("has_event"),
        F.array_join("in_categories", ", ").alias("categories"),
        F.array_join("out_categories", ", ").alias("excluded_kinds"),
    )


def explode_rows(df: DataFrame, array_col, name: str, *keep) -> DataFrame:
    """Explode an array computed from whole-text regexes.

    ``explode_outer`` + a null filter on the output, because for ``explode`` the optimizer
    infers ``size(array) > 0`` and pushes it below the projection, where it would run every
    regex (and the text normalisation) a second time per row.
    """
    return df.select(*keep, F.explode_outer(array_col).alias(name)).where(F.col(name).isNotNull())


def indicator_matches(features: DataFrame) -> DataFrame:
    """One row per (item, rubric condition) that some sentence of the item states."""
    return explode_rows(features, "rubric", "r", "item_id", "vendor", "outlet", "tier", "published_on").select(
        "item_id", "vendor", F.col("r.condition").alias("condition"), F.col("r.level").alias("level"),
        "outlet", "tier", "published_on")


# --- R6 ------------------------------------------------------------------------------

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]+)"


def url_host(url) -> Column:
    col = F.col(url) if isinstance(url, str) else url
    return F.lower(F.regexp_extract(col, _HOST, 1))


def source_tier(host: Column, url: Column | None = None) -> Column:
    """1 primary (newsroom, investor relations, government, courts; by host or path), 2 trade press, 3 general."""
    path = F.lit(False) if url is None else url.rlike(rules.PRIMARY_PATH_PATTERN)
    return (
        F.when(host.rlike(rules.PRIMARY_HOST_PATTERN) | path, F.lit(1))
        .when(host.rlike(rules.TRADE_HOST_PATTERN) & ~host.rlike(rules.BLOG_HOST_PATTERN), F.lit(2))
        .otherwise(F.lit(rules.UNKNOWN_TIER))
    )


# --- R7 ------------------------------------------------------------------------------


def syndication_exact(items: DataFrame) -> DataFrame:
    """One item per normalised text; cite the most authoritative (lowest tier), then the
    earliest (undated last), then the lowest id. A partial aggregate: a text copied a
    million times is combined map-side, never gathered in one task."""
    pick = F.struct(
        F.col("tier"), F.col("published_on").isNull().alias("_undated"), F.col("published_on"), F.col("item_id"),
        F.col("vendor"), F.col("outlet"),
    )
    g = items.groupBy("text_key").agg(F.min(pick).alias("_p"), F.count(F.lit(1)).alias("cluster_size"))
    return g.select(
        "text_key", F.col("_p.item_id").alias("item_id"), F.col("_p.vendor").alias("vendor"),
        F.col("_p.outlet").alias("outlet"), F.col("_p.tier").alias("tier"),
        F.col("_p.published_on").alias("published_on"), "cluster_size",
    )


# --- R9 ------------------------------------------------------------------------------

# Numbers with grouped thousands (by a space, comma, point or apostrophe) or without, and decimals behind comma or point.
NUMBER = r"[0-9]{1,3}(?:[ \x{a0}][0-9]{3})+(?:[.,][0-9]{1,2})?|[0-9]+(?:[.,'][0-9]+)*"
SCALES = {"trillion": 1e12, "billion": 1e9, "bn": 1e9, "mrd": 1e9, "b": 1e9, "million": 1e6, "mio": 1e6, "mn": 1e6, "m": 1e6,
          "thousand": 1e3, "tsd": 1e3, "k": 1e3}
SIGNS = r"US\$|\$|€|£|¥|USD|EUR|GBP|CHF|JPY"
NAMES = r"(?:dollars?|euros?|pounds?|francs?|yen|USD|EUR|GBP|CHF|JPY)(?:[^A-Za-z0-9]|\z)|€|£|¥|\$"
_SCALE = "(?:" + "|".join(SCALES) + r")\.?"
# A currency stands on either side; a scale word ends where letters end. The character before is no part.
MONEY_PATTERN = (rf"(?i)(?:^|[^0-9A-Za-z.,'])((?:{SIGNS}) ?(?:{NUMBER})(?: ?{_SCALE}(?:[^A-Za-z0-9]|\z))?"
                 rf"|(?:{NUMBER})(?: ?{_SCALE})? ?(?:{NAMES}))")
HEADCOUNT_PATTERN = rf"(?i)(?:^|[^0-9A-Za-z.,'])((?:{NUMBER}) (?:employees|staff|workers))"
SCALE_PATTERN = r"(?i)[0-9] ?(" + "|".join(SCALES) + r")(?:[^A-Za-z0-9]|\z)"
# How a number's separators are read, in this order; the first shape that fits decides.
COMMA_GROUPS = r"^[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$"
POINT_GROUPS = r"^[0-9]{1,3}(\.[0-9]{3})+(,[0-9]+)?$"
ONE_POINT_GROUP = r"^[0-9]{1,3}\.[0-9]{3}$"
PLAIN = r"^[0-9]+([.,][0-9]+)?$"


def number_value(number: Column, scaled: Column) -> Column:
    """The value of a number's text, null for a shape that no locale writes.

    Spaces and apostrophes group. Three digits behind a single point are thousands, unless a scale word
    follows (1.250 million is 1,250,000); behind a comma they always are.
    """
    t = F.regexp_replace(number, "[ \u00a0']", "")
    points = t.rlike(POINT_GROUPS) & ~(scaled & t.rlike(ONE_POINT_GROUP))
    text = (F.when(t.rlike(COMMA_GROUPS), F.regexp_replace(t, ",", ""))
            .when(points, F.regexp_replace(F.regexp_replace(t, r"\.", ""), ",", "."))
            .when(t.rlike(PLAIN), F.regexp_replace(t, ",", ".")))
    return text.try_cast("double")


def _amount(figure: Column) -> Column:
    number = F.regexp_extract(figure, f"({NUMBER})", 1)
    word = F.lower(F.regexp_extract(figure, SCALE_PATTERN, 1))
    factor = F.lit(1.0)
    for name, value in SCALES.items():
        factor = F.when(word == name, F.lit(value)).otherwise(factor)
    return (number_value(number, word != "") * factor).try_cast("decimal(20,2)")


def scale_figures(items: DataFrame) -> DataFrame:
    """Money amounts and headcounts stated in the text, one row per figure, in text order."""
    def figures(kind: str, pattern: str) -> DataFrame:
        x = items.select("item_id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), 1)).alias("pos", "figure"))
        return x.select("item_id", F.lit(kind).alias("kind"), (F.col("pos") + 1).cast("long").alias("ordinal"),
                        F.trim("figure").alias("figure_text"), _amount(F.col("figure")).alias("amount"))

    return figures("money", MONEY_PATTERN).unionByName(figures("headcount", HEADCOUNT_PATTERN))


# --- R10 -----------------------------------------------------------------------------

QUOTE_PATTERN = r'["“”„]([^"“”„]*)["“”„]'


def writing_violations(items: DataFrame) -> DataFrame:
    """Banned characterisations (one row per word used), quotes of 15 words or more,
    and more than one quote per (vendor, outlet)."""
    norm = norm_text("text")
    banned = F.filter(
        F.array(*[F.when(norm.rlike(" " + w + "s? "), F.lit(w)) for w in rules.BANNED_TONE_WORDS]),
        lambda x: x.isNotNull(),
    )
    tone = items.select("vendor", "outlet", "item_id", F.explode(banned).alias("detail")).select(
        "vendor", "outlet", "item_id", F.lit("banned_tone").alias("rule"), "detail")
    quotes = items.select("vendor", "outlet", "item_id",
                          F.posexplode(F.regexp_extract_all("text", F.lit(QUOTE_PATTERN), 1)).alias("pos", "quote"))
    n_words = F.size(F.split(F.trim(F.col("quote")), "[ \t\n\r]+"))
    long_q = quotes.where(n_words >= rules.QUOTE_MAX_WORDS).select(
        "vendor", "outlet", "item_id", F.lit("long_quote").alias("rule"),
        F.concat(F.lit("quote "), (F.col("pos") + 1).cast("string"), F.lit(": "), n_words.cast("string"), F.lit(" words")).alias("detail"))
    per_source = quotes.groupBy("vendor", "outlet").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") > rules.QUOTES_PER_SOURCE).select(
        "vendor", "outlet", F.lit(None).cast("long").alias("item_id"), F.lit("quotes_per_source").alias("rule"),
        F.concat(F.col("n").cast("string"), F.lit(" quotes")).alias("detail"))
    return tone.unionByName(long_q).unionByName(per_source)


# --- R11 -----------------------------------------------------------------------------


def items_per_vendor(book: DataFrame, item_counts: DataFrame) -> DataFrame:
    """Every book row with its item counts, zero when nothing was found.

    ``item_counts`` is pre-aggregated per vendor, so the join adds one row per vendor."""
    j = book.select("book_row_id", "vendor").join(item_counts, "vendor", "left")
    return j.select("book_row_id", "vendor", *[F.coalesce(F.col(c), F.lit(0)).alias(c)
                                                for c in item_counts.columns if c != "vendor"])


def item_counts(features: DataFrame, confirmed: DataFrame, as_of: dt.date) -> DataFrame:
    x = features.join(confirmed.select("item_id", "confirmed"), "item_id", "left")
    recent = recency(x, as_of)
    return x.groupBy("vendor").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(F.col("confirmed")).alias("n_confirmed"),
        F.count_if(F.col("confirmed") & recent).alias("n_selected"),
    )


def dated_items(features: DataFrame) -> DataFrame:
    return features.select("item_id", "published_on", "event_on", "dated_by")

