"""Operator 5: secret scan with fixed patterns and a battery of randomness tests.

Fixed patterns (key assignments, access ids, long hex runs) always count; their spans are cut out of
the text, and the battery looks at the long tokens of what remains. Each candidate gets the smallest
encoding whose alphabet covers it, and four tests of the hypothesis "drawn uniformly from that
alphabet": chi-squared over the alphabet, the runs test around the alphabet's middle, the lag-1
serial correlation, and the likeness of neighbouring letters to words. The last one has power on short
tokens, where 62 letters leave chi-squared none: vowels and consonants alternate in words and names more
often than by chance, digits and cases change less often, and separators stand between the parts of
identifiers and paths. The least p-value, times four, goes into a Benjamini-Hochberg step-up in strata
of encoding and length octave, so short and long tokens are not judged by one cutoff. Tokens whose
randomness is *not* rejected are secrets.

The step-up runs over a grid of rounded p-values, a histogram of bounded size that Spark counts over
all candidates of all documents. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import documents

# The base patterns, the kinds in their order, and the least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16

LEAST = 16        # shortest token that the battery can tell from a name: below, words of either kind pass as random
#: Whole runs of one base-64 alphabet; of runs that mix both alphabets' signs, the parts.
CANDIDATE = (rf"(?<![A-Za-z0-9])(?=[A-Za-z0-9+/_-]{{{LEAST}}})(?:(?<![+/])[A-Za-z0-9+/]{{{LEAST},}}+(?![_-])={{0,2}}"
             rf"|(?<![_-])[A-Za-z0-9_-]{{{LEAST},}}+(?![+/])={{0,2}}|[A-Za-z0-9]{{{LEAST},}}+)")
DIGITS, LOW, UP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encoding -> alphabet, from the smallest on; a candidate takes the first that covers it.
ENCODINGS = {
    "hex": DIGITS + LOW[:6], "HEX": DIGITS + UP[:6], "base32": UP + "234567", "base36": DIGITS + LOW, "BASE36": DIGITS + UP,
    "base62": DIGITS + LOW + UP, "base64": UP + LOW + DIGITS + "+/", "base64url": UP + LOW + DIGITS + "-_",
}
VOWELS = "aeiouAEIOU"
TESTS = 4
Q = 0.02          # share of random tokens that the step-up may give up
GRID = 10.0       # grid steps for each power of ten of a p-value
GRID_END = 300

SPAN = "array<struct<kind:int,s:int,e:int>>"
FOUND = "array<struct<s:int,e:int,m:string>>"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _located(pattern: str, group: int = 0, least: int = 0, col: str = "_text") -> str:
    """SQL: the matches of ``pattern`` in ``col`` as FOUND, by code point; ``least``: of group ``group``.

    The gaps between matches come from split, the matches from regexp_extract_all; start and end are
    running sums of their lengths. Texts without a match are scanned once only.
    """
    p = _quoted(pattern)
    return f"""
    transform(array(split({col}, {p})), g -> if(size(g) < 2, cast(array() as {FOUND}), aggregate(
      zip_with(slice(g, 1, size(g) - 1), zip_with(regexp_extract_all({col}, {p}, 0), regexp_extract_all({col}, {p}, {group}),
        (m, v) -> named_struct('m', m, 'v', v)), (g, w) -> named_struct('g', g, 'm', w.m, 'v', w.v)),
      cast(named_struct('p', 0, 'out', array()) as struct<p:int,out:{FOUND}>),
      (a, x) -> named_struct('p', a.p + length(x.g) + length(x.m), 'out', if(length(x.v) < {least}, a.out,
        concat(a.out, array(named_struct('s', a.p + length(x.g), 'e', a.p + length(x.g) + length(x.m), 'm', x.m))))),
      a -> a.out)))[0]"""


def _blotted(pattern: str, group: int = 0, least: int = 0) -> str:
    """SQL: ``_rest`` with the matches that ``_located`` finds turned into as many spaces."""
    p = _quoted(pattern)
    return f"""array_join(zip_with(split(_rest, {p}), zip_with(regexp_extract_all(_rest, {p}, 0), regexp_extract_all(_rest, {p}, {group}),
      (m, v) -> if(length(v) < {least}, m, repeat(' ', length(m)))), (g, m) -> concat(g, coalesce(m, ''))), '')"""


def _base(x: DataFrame) -> DataFrame:
    """Add ``_assign``, ``_access``, ``_hex`` (FOUND) to rows with ``_text``."""
    return x.withColumns({
        "_assign": F.expr(_located(ASSIGN, 2, ASSIGN_LEAST)), "_access": F.expr(_located(ACCESS, 0, ACCESS_LEAST)),
        "_hex": F.expr(_located(HEX))})


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal; absolute error below 1e-7, floor 1e-30."""
    a = F.least(F.abs(z), F.lit(11.0))
    t = 1.0 / (1.0 + 0.2316419 * a)
    # fixed values: the coefficients of the usual five-term approximation
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2.0) * 0.3989422804014327 * poly
    return F.greatest(F.when(z >= 0, tail).otherwise(1.0 - tail), F.lit(1e-30))


def word_likeness(a: str, b: str) -> int:
    """How much two neighbouring characters look like a word or a name: 1, 0 or -1."""
    if not (a.isalnum() and b.isalnum()):
        return 1
    kind = [c.isdigit() + 2 * c.isupper() for c in (a, b)]
    sound = [c.isalpha() + (c in VOWELS) for c in (a, b)]
    return int(0 < sound[0] != sound[1] > 0) - int(kind[0] != kind[1])


def likeness_moments(letters: str) -> tuple[float, float, float]:
    """Mean, variance and covariance of neighbours of ``word_likeness`` in uniform draws from ``letters``."""
    k = len(letters)
    rows = [[word_likeness(a, b) for b in letters] for a in letters]
    mean = sum(map(sum, rows)) / k ** 2
    variance = sum(v * v for r in rows for v in r) / k ** 2 - mean ** 2
    return mean, variance, sum((sum(r) / k - mean) ** 2 for r in rows) / k


def _likeness(body: Column) -> Column:
    """Sum of ``word_likeness`` over the neighbouring characters of ``body``."""
    every = DIGITS + LOW + UP

    def changes(marks: str) -> tuple[Column, Column, Column]:
        """Of ``body`` written as ``marks`` ('.' for a character that does not take part): changes between neighbours, characters, stretches."""
        s = F.translate(body, every + "+/_-", marks + "....")
        runs = F.length(F.translate(F.regexp_replace(s, r"([^.])\1+", "$1"), ".", ""))
        stretches = F.length(F.translate(F.regexp_replace(s, "[^.]+", "s"), ".", ""))
        return runs - stretches, F.length(F.translate(s, ".", "")), stretches

    kinds, alnum, stretches = changes("0" * len(DIGITS) + "a" * len(LOW) + "A" * len(UP))
    sounds, _, _ = changes("." * len(DIGITS) + "".join("v" if c in VOWELS else "c" for c in LOW + UP))
    return sounds - kinds + (F.length(body) - 1) - (alnum - stretches)


def _tested(x: Column) -> Column:
    """FOUND element -> struct(s, e, stratum, step): the battery's verdict on one candidate.

    Each value that is used more than once is bound to a name, so that it is worked out once.
    """
    def of(body: Column) -> Column:
        encoding = F.lit(len(ENCODINGS) - 1)
        for i, (_, letters) in reversed(list(enumerate(ENCODINGS.items()))):
            encoding = F.when(F.length(F.translate(body, letters, "")) == 0, F.lit(i)).otherwise(encoding)
        return _bind(encoding, lambda k: in_encoding(body, k))

    def in_encoding(body: Column, k: Column) -> Column:
        letters = F.get(F.array(*[F.lit(v) for v in ENCODINGS.values()]), k)
        moments = F.get(F.array(*[F.array(*[F.lit(float(m)) for m in likeness_moments(v)]) for v in ENCODINGS.values()]), k)
        codes = F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c: F.instr(letters, c).cast("double"))
        return _bind(F.struct(codes.alias("c"), F.length(letters).cast("double").alias("k"), F.length(body).cast("double").alias("n"),
                              letters.alias("letters"), moments.alias("moments")), lambda t: counted(body, k, t))

    def counted(body: Column, k: Column, t: Column) -> Column:
        c, zero = t["c"], F.lit(0.0)
        squares = F.aggregate(
            F.filter(F.split(t["letters"], ""), lambda ch: ch != ""), zero,
            lambda a, ch: a + F.pow(t["n"] - F.length(F.replace(body, ch, F.lit(""))).cast("double"), F.lit(2.0)))
        high = F.aggregate(c, zero, lambda a, v: a + F.when(v > t["k"] / 2.0, F.lit(1.0)).otherwise(zero))
        follows = F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1),
                             lambda p, q: F.struct(p.alias("p"), q.alias("q")))
        return _bind(F.struct(squares.alias("squares"), high.alias("high"), follows.alias("follows"), _likeness(body).alias("likeness")),
                     lambda u: battery(k, t, u))

    def battery(k: Column, t: Column, u: Column) -> Column:
        size, n, zero = t["k"], t["n"], F.lit(0.0)
        f = size - 1.0
        wh = F.lit(2.0) / (9.0 * f)
        z_chi = (F.cbrt(F.greatest(size / n * u["squares"] - n, zero) / f) - (1.0 - wh)) / F.sqrt(wh)
        runs = 1.0 + F.aggregate(u["follows"], zero, lambda a, v: a + F.when((v["p"] > size / 2.0) != (v["q"] > size / 2.0), F.lit(1.0)).otherwise(zero))
        expected = 1.0 + 2.0 * u["high"] * (n - u["high"]) / n
        spread = F.sqrt((expected - 1.0) * (expected - 2.0) / (n - 1.0))
        z_runs = F.when(spread > 0, F.abs(runs - expected) / spread).otherwise(F.lit(11.0))
        mean = (size + 1.0) / 2.0
        variance = (size * size - 1.0) / 12.0
        serial = F.aggregate(u["follows"], zero, lambda a, v: a + (v["p"] - mean) * (v["q"] - mean)) / (variance * F.sqrt(n - 1.0))
        m = [F.get(t["moments"], F.lit(i)) for i in range(3)]
        z_words = (u["likeness"] - m[0] * (n - 1.0)) / F.sqrt(m[1] * (n - 1.0) + 2.0 * m[2] * (n - 2.0))
        sides = F.array(*[F.lit(v) for v in (1.0, 2.0, 2.0, 1.0)])
        p = F.array_min(F.zip_with(F.array(z_chi, z_runs, F.abs(serial), z_words), sides, lambda z, s: s * _upper_tail(z)))
        step = F.least(F.floor(-F.log10(F.least(F.lit(1.0), TESTS * p)) * GRID), F.lit(GRID_END)).cast("int")
        stratum = (k * 64 + F.floor(F.log2(n)).cast("int")).cast("int")
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), stratum.alias("stratum"), step.alias("step"))

    return _bind(F.regexp_replace(x["m"], "=+$", ""), of)


def _bind(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _candidates(x: DataFrame) -> DataFrame:
    """Add ``_tests``: tested tokens of the text without its base spans, that mix letters with digits or both cases."""
    x = x.withColumn("_rest", F.col("_text"))
    for found, pattern in (("_assign", (ASSIGN, 2, ASSIGN_LEAST)), ("_access", (ACCESS, 0, ACCESS_LEAST)), ("_hex", (HEX,))):
        x = x.withColumn("_rest", F.expr(f"if(size({found}) = 0, _rest, {_blotted(*pattern)})"))
    x = x.withColumn("_cand", F.expr(_located(CANDIDATE, col="_rest")))
    taken = F.concat("_assign", "_access", "_hex")

    def eligible(c: Column) -> Column:
        # kinds of different patterns may overlap: what is left of one of them is no candidate
        apart = ~F.exists(taken, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))
        low, up, digit = (F.rlike(c["m"], F.lit(k)) for k in ("[a-z]", "[A-Z]", "[0-9]"))
        return ((low & up) | (low & digit) | (up & digit)) & apart

    x = x.withColumn("_cand", F.filter("_cand", eligible))
    return x.withColumn("_tests", F.transform("_cand", _tested)).drop("_cand", "_rest")


def step_limits(tests: DataFrame) -> dict[int, int]:
    """Stratum -> the grid step from which randomness is rejected (GRID_END + 1: never).

    ``tests`` holds one row per candidate; only the histogram (strata x grid steps, both bounded by
    the constants above) reaches the driver.
    """
    rows = tests.groupBy("stratum", "step").agg(F.count(F.lit(1)).alias("n")).collect()
    hist: dict[int, dict[int, int]] = {}
    for r in rows:
        hist.setdefault(r["stratum"], {})[r["step"]] = r["n"]
    limits = {}
    for stratum, h in hist.items():
        m, seen, limit = sum(h.values()), 0, GRID_END + 1
        for step in sorted(h, reverse=True):
            seen += h[step]
            if 10 ** (-step / GRID) <= seen * Q / m:
                limit = step
        limits[stratum] = limit
    return limits


def _spans(docs: DataFrame, text: Column) -> DataFrame:
    """(row, spans): each row of ``docs`` as a struct, so that its own names meet none of ours, with its spans."""
    seen = _candidates(_base(docs.select(text.alias("_text"))))
    limits = step_limits(seen.select(F.explode("_tests").alias("t")).select("t.stratum", "t.step"))
    x = _candidates(_base(docs.select(F.struct("*").alias("row"), text.alias("_text"))))
    secret = F.col("_tests")
    if limits:
        table = F.create_map(*[F.lit(v) for kv in sorted(limits.items()) for v in kv])
        secret = F.filter("_tests", lambda t: t["step"] < F.coalesce(F.try_element_at(table, t["stratum"]), F.lit(GRID_END + 1)))

    def of(kind: int, found: Column) -> Column:
        return F.transform(found, lambda f: F.struct(f["s"].alias("s"), F.lit(kind).alias("kind"), f["e"].alias("e")))

    spans = F.sort_array(F.concat(of(0, F.col("_assign")), of(1, F.col("_access")), of(2, F.col("_hex")), of(3, secret)))
    return x.select("row", F.transform(spans, lambda v: F.struct(v["kind"], v["s"], v["e"])).alias("spans"))


def scanned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``spans``: array of (kind, s, e) by start then kind; kind indexes KINDS, e is exclusive.

    Offsets are code points of the whole text, however long. A null or empty text has no spans. Base spans
    of one kind never overlap; spans of different kinds may, but random spans touch none of the others. A
    document's own ``spans`` column, if any, is replaced; all other columns, whatever their names, pass
    through. Nulls elsewhere and repeated rows stay; equal texts get equal spans; an empty table stays empty.
    """
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() != "spans"]
    return _spans(docs, F.coalesce(F.col(text_col), F.lit(""))).select(*kept, "spans")


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "<SECRET>") -> DataFrame:
    """``docs`` with every span of the text replaced by ``mark`` (overlapping spans by one); all other columns stay."""
    x = _spans(docs, F.coalesce(F.col(text_col), F.lit(""))).withColumn("body", F.col("row").getField(text_col))
    pieces = F.expr(f"""aggregate(spans, cast(named_struct('at', 0, 'out', '') as struct<at:int,out:string>),
      (a, v) -> if(v.e <= a.at, a, named_struct('at', v.e, 'out', if(v.s < a.at, a.out,
        concat(a.out, substring(body, a.at + 1, v.s - a.at), '{mark}')))),
      a -> concat(a.out, substring(body, a.at + 1)))""")
    clean = F.when(F.size("spans") == 0, F.col("body")).otherwise(pieces)
    return x.select(*[clean.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


def joined_spans(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda v: F.concat_ws(":", F.get(names, v["kind"]), v["s"], v["e"])), ",")


def q_op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    x = scanned(documents(spark, sf_dir))

    def many(kind: int) -> Column:
        return F.size(F.filter("spans", lambda v: v["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda v: v["kind"] < 3)
    return x.select(
        "doc_id", many(0).alias("n_assign"), many(1).alias("n_access"), many(2).alias("n_hex"),
        F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))
