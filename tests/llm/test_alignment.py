"""Cross-tokenizer alignment against the libraries on whole texts and brute-force groups, links and counts."""

import functools
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from riskloom.llm import alignment
from riskloom.llm.alignment import Aligner, aligned, default_paths, digests, link_counts, shared_cuts

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def al():
    return Aligner(*default_paths())


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    marks = ["The", "straße", "naïve", "漢字テスト", "🙂", "  ", "\n\n", "\t", " ", "x" * 40, "1234567", "<|endoftext|>", "</s>", "▁", "don't", "\x00", "　", "\x85", "\x1c"]
    odd = [" ".join(r.choices(marks, k=r.randint(1, 12))) + r.choice(["", " ", "  ", "\n"]) for _ in range(60)]
    glued = ["".join(r.choices(marks, k=r.randint(1, 12))) for _ in range(60)]
    long = " ".join(r.choices(["unhappiness", "Tokenizers", "of", "the", "zebra,"], k=1200))
    return (None, "", " ", "  ", "a", " a", "a ", "same text", "same text", long, "aé" * 900, *odd, *glued)


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i if i != 4 else None, t, "x", 1, [1]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_a string, codes long, groups array<int>").repartition(4)


def tokens(al, text):
    """Ids of whole texts by the libraries, or None if the bytes are others."""
    if not text:
        return None
    a, b = al.a.encode(" " + text, add_special_tokens=False).ids, al.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(al.bytes_a[i] for i in a) != raw or b"".join(al.bytes_b[i] for i in b) != raw:
        return None
    return a, b


@functools.cache
def brute(al, texts):
    """Per text (groups, links), with groups as (a, b) and links as id pairs, token by token."""
    out = []
    for t in texts:
        ids = tokens(al, t)
        groups, links = [], []
        if ids:
            spans = []
            for side, table in zip(ids, (al.bytes_a, al.bytes_b)):
                at, s = 0, []
                for i in side:
                    s.append((at, at + len(table[i]), i))
                    at += len(table[i])
                spans.append(s)
            cuts = sorted({s[1] for s in spans[0]} & {s[1] for s in spans[1]})
            last = 0
            for c in cuts:
                groups.append(tuple([i for x, y, i in s if x >= last and y <= c] for s in spans))
                last = c
            j = 0
            for x, y, i in spans[0]:
                while spans[1][j][1] <= x:
                    j += 1
                k = j
                while k < len(spans[1]) and spans[1][k][0] < y:
                    links.append((i, spans[1][k][2]))
                    k += 1
        out.append((groups, links))
    return out


def expected(al, texts):
    found = brute(al, texts)
    count = Counter(p for _, links in found for p in links)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    rows = []
    for i, (groups, links) in enumerate(found):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        rows.append((i if i != 4 else None, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
                     sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return rows, count


def test_digests_match_brute_force(docs, al, texts):
    want, _ = expected(al, texts)
    got = digests(docs, *default_paths())
    assert set(COLUMNS) == set(got.columns)
    assert sorted(map(tuple, got.select(*COLUMNS).collect()), key=str) == sorted(want, key=str)
    assert sum(r[1] > 0 for r in want) > 80 and any(r[1] == 0 for r in want[5:])


def test_digests_do_not_depend_on_the_pairs_sent_to_tasks(docs, al, texts, monkeypatch):
    want, _ = expected(al, texts)
    for head, cache in ((40, 50), (0, 200_000)):
        monkeypatch.setattr(alignment, "HEAD_PAIRS", head)
        monkeypatch.setattr(alignment, "CACHE", cache)
        monkeypatch.setattr(alignment, "PACKED_PIECES", cache // 10)
        got = digests(docs, *default_paths()).select(*COLUMNS).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_link_counts_and_groups(docs, al, texts, monkeypatch):
    _, count = expected(al, texts)
    monkeypatch.setattr(alignment, "FLUSH_PAIRS", 10)
    monkeypatch.setattr(alignment, "CACHE", 30)
    got = {(r.a_id, r.b_id): r.n for r in link_counts(docs, *default_paths()).collect()}
    assert got == dict(count)
    rows = aligned(docs, *default_paths())
    assert rows.columns == ["doc_id", "text", "n_a", "codes", "groups"]
    by_text = {t: g for t, (g, _) in zip(texts, brute(al, texts))}
    for r in rows.collect():
        assert [(list(g.a), list(g.b)) for g in r.groups] == by_text[r.text]


def test_pieces_give_the_ids_of_whole_texts(al, texts):
    assert al.splits
    for t in texts:
        if t:
            pieces = al.pieces(t)
            assert "".join(pieces) == " " + t
            a, _, b, _, same = al._encode(pieces)
            assert not same.all() or a.tolist() == al.a.encode(" " + t, add_special_tokens=False).ids
            whole = al.b.encode(t)
            if b"".join(al.bytes_b[i] for i in whole) == (" " + t).encode():
                assert b.tolist() == whole


def test_pieces_that_change_bytes_are_left_out_alone(al):
    """A marker of the second vocabulary in a text comes back as a space: only that piece loses its tokens."""
    pieces = [" one", " t▁wo", " three", " ", " fo\n", " é漢"]
    a, a_at, b, b_at, same = al._encode(pieces)
    assert same.tolist() == [True, False, True, True, True, True]
    for i, p in enumerate(pieces):
        ids = a[a_at[i]: a_at[i + 1]].tolist()
        assert ids == (al.a.encode(p, add_special_tokens=False).ids if same[i] else [])


def test_shared_cuts_of_random_intervals():
    r = np.random.default_rng(1)
    for _ in range(200):
        ends_a, ends_b, at_a, at_b, want, base = [], [], [0], [0], [], 0
        for _ in range(r.integers(1, 5)):
            size = int(r.integers(0, 60))
            sides = [sorted({size, *r.choice(size, r.integers(0, size), replace=False).tolist()} - {0}) if size else [] for _ in range(2)]
            ends_a += [base + e for e in sides[0]]
            ends_b += [base + e for e in sides[1]]
            at_a.append(len(ends_a))
            at_b.append(len(ends_b))
            base += size
        want = [i for i, e in enumerate(ends_a) if e in set(ends_b)]
        got = shared_cuts(np.array(ends_a, np.int64), np.array(ends_b, np.int64), np.array(at_a), np.array(at_b))
        assert got.tolist() == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert digests(empty, *default_paths()).count() == 0
    assert aligned(empty, *default_paths()).count() == 0


def test_packed_rows_and_their_files_stay_small(spark, monkeypatch):
    """A task of the second pass held the rows of a whole file at once, several MB each."""
    from riskloom.llm import common

    written = []

    def kept(df, name, *args):
        out = common.stored(df, name, *args)
        if name == "aligned":
            written.append((out, df))
        return out

    monkeypatch.setattr(alignment, "stored", kept)
    rows = [(k, " ".join(f"w{(k * 7919 + i * i) % 5000}" for i in range(1500))) for k in range(1300)]
    assert digests(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), *default_paths()).count() == 1300
    sizes = [r[0] for r in written[0][0].selectExpr("length(piece) + length(code) + length(code_at) + length(shas)").collect()]
    assert max(sizes) < 1 << 20 and len(sizes) > 8
    assert len(written[0][0].inputFiles()) >= len(sizes) / 8
