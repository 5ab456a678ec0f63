"""Operator 5 against a plain Python version, and the power of its battery."""

import hashlib
import math
import random
import re

import pytest

from riskloom.llm import secret_scan as S

BASE = ((S.ASSIGN, 2, S.ASSIGN_LEAST), (S.ACCESS, 0, S.ACCESS_LEAST), (S.HEX, 0, 0))


def base_spans(text):
    return [(m.start(), kind, m.end()) for kind, (p, g, least) in enumerate(BASE) for m in re.finditer(p, text) if len(m.group(g)) >= least]


def tail(z):
    return max(1e-30, 0.5 * math.erfc(min(z, 11.0) / math.sqrt(2.0)))


def step_and_stratum(token):
    body = token.rstrip("=")
    k, letters = next((i, v) for i, v in enumerate(S.ENCODINGS.values()) if set(body) <= set(v))
    codes, size, n = [letters.index(c) + 1 for c in body], len(letters), len(body)
    chi = size / n * sum(body.count(c) ** 2 for c in letters) - n
    w = 2.0 / (9.0 * (size - 1))
    z_chi = (max(chi, 0.0) / (size - 1)) ** (1 / 3) - (1 - w)
    high = sum(c > size / 2 for c in codes)
    runs = 1 + sum((a > size / 2) != (b > size / 2) for a, b in zip(codes, codes[1:]))
    expected = 1 + 2 * high * (n - high) / n
    spread = (expected - 1) * (expected - 2) / (n - 1)
    z_runs = abs(runs - expected) / math.sqrt(spread) if spread > 0 else 11.0
    mean = (size + 1) / 2
    serial = sum((a - mean) * (b - mean) for a, b in zip(codes, codes[1:])) / ((size * size - 1) / 12 * math.sqrt(n - 1))
    m, v, beside = S.likeness_moments(letters)
    z_words = (sum(map(S.word_likeness, body, body[1:])) - m * (n - 1)) / math.sqrt(v * (n - 1) + 2 * beside * (n - 2))
    p = min(1.0, 4 * min(tail(z_chi / math.sqrt(w)), 2 * tail(z_runs), 2 * tail(abs(serial)), tail(z_words)))
    return min(math.floor(-math.log10(p) * S.GRID), S.GRID_END), k * 64 + int(math.log2(n))


def brute(texts):
    """Spans of each text: base spans, then tokens of what they leave whose randomness stands."""
    found, tokens = [], []
    for t in texts:
        base = base_spans(t)
        rest = list(t)
        for s, _, e in base:
            rest[s:e] = " " * (e - s)
        got = []
        for m in re.finditer(S.CANDIDATE, "".join(rest)):
            if sum(bool(re.search(c, m.group())) for c in ("[a-z]", "[A-Z]", "[0-9]")) > 1:
                got.append((m.start(), m.end(), *step_and_stratum(m.group())))
        found.append(base)
        tokens.append(got)
    limits = {}
    for stratum in {t[3] for got in tokens for t in got}:
        steps = [t[2] for got in tokens for t in got if t[3] == stratum]
        ok = [s for s in steps if 10 ** (-s / S.GRID) <= sum(x >= s for x in steps) * S.Q / len(steps)]
        limits[stratum] = min(ok, default=S.GRID_END + 1)
    return [sorted(b + [(s, 3, e) for s, e, step, stratum in got if step < limits[stratum]]) for b, got in zip(found, tokens)]


def joined(spans):
    return ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return [[(v.s, v.kind, v.e) for v in r.spans] for r in S.scanned(docs).orderBy("doc_id").collect()]


def tokens(kind, n, many, seed=3):
    r = random.Random(seed + n)
    return ["".join(r.choices(S.ENCODINGS[kind], k=n)) for _ in range(many)]


PARTS = ("report network quality customer invoice handler session manager default output partition schedule internal payment "
         "adapter window transform context archive resource version service element builder storage number module product").split()


def names(shape, many, seed=5):
    r = random.Random(seed)
    out = []
    while len(out) < many:
        words = r.choices(PARTS, k=r.randint(2, 4))
        n = str(r.randint(1, 99))
        t = {"camel": "".join(w.title() for w in words) + n, "snake": "_".join(words) + "_" + n, "kebab": "-".join(words) + "-" + n,
             "path": "/".join(words) + "/v" + n, "upper": "_".join(words).upper() + n, "lower": "".join(words) + n}[shape]
        if len(t) >= S.LEAST:
            out.append(t)
    return out


def test_scan_matches_brute_force(spark):
    texts = ["plain words", " ".join(f"w{i % 997} x{i}" for i in range(6000)), "plain words",
        "sha/" + "0123456789abcdef" * 2 + "/" + tokens("base62", 40, 1)[0], "AKIA" + "Q7" * 8 + "TOKEN=abcdefgh12", "token = short1 and password:'longenough1'",
        "é \U0001F600 " + " ".join(tokens("base64", 24, 3)), "", " ".join(names("camel", 40) + tokens("base62", 20, 40)), "Zz9" * 20_000]
    want = brute(texts)
    assert scan(spark, texts) == want
    assert sum(k == 3 for w in want for _, k, _ in w) > 30 and any(k < 3 for w in want for _, k, _ in w)


def test_registered_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: w for r, w in zip(rows, brute([r.text or "" for r in rows]))}
    got = S.q_op5_secret_scan(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        base = [w for w in want[r.doc_id] if w[1] < 3]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w[1] == k for w in base) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert r.spans == joined(want[r.doc_id])


def test_battery_has_power(spark):
    kinds = [(k, n) for k in ("hex", "base32", "base36", "base62", "base64", "base64url") for n in (16, 18, 20, 31, 44)]
    shapes = ("camel", "snake", "kebab", "path", "upper", "lower")
    texts = ["a " + t + " b" for k, n in kinds for t in tokens(k, n, 100)] + ["a " + t + " b" for s in shapes for t in names(s, 150)]
    hit = [(2, len(t) - 2) in [(s, e) for s, _, e in spans] for t, spans in zip(texts, scan(spark, texts))]
    found = {kn: sum(hit[100 * i: 100 * i + 100]) for i, kn in enumerate(kinds)}
    rest = hit[100 * len(kinds):]
    wrong = {s: sum(rest[150 * i: 150 * i + 150]) for i, s in enumerate(shapes)}
    assert min(found.values()) >= 85 and sum(found.values()) >= 95 * len(kinds), found
    assert max(wrong.values()) <= 7, wrong


def test_second_half_of_a_run_is_tested(spark):
    token = tokens("base62", 40, 1)[0]
    text = "0123456789abcdef" * 2 + "/" + token
    assert scan(spark, [text])[0] == [(0, 2, 32), (32, 3, len(text))]


@pytest.mark.parametrize("f", [S.scanned, S.redacted])
def test_own_columns_survive(spark, f):
    docs = spark.createDataFrame([(1, "token=abcdefgh1", "own", "mine", 5), (1, None, None, None, None)],
                                 "doc_id long, text string, _text string, row string, _rest int")
    got = sorted(f(docs).collect(), key=lambda r: r.text is None)
    assert [(r._text, r["row"], r["_rest"]) for r in got] == [("own", "mine", 5), (None, None, None)]


def test_redacted_keeps_own_spans(spark):
    docs = spark.createDataFrame([("token=abcdefgh1 x", "own")], "text string, spans string")
    assert [tuple(r) for r in S.redacted(docs).collect()] == [("<SECRET> x", "own")]
