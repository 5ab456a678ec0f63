"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from riskloom.llm import spelling
from riskloom.llm.spelling import Tree, letters_of, variants, word_counts


def brute_counts(rows):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(vocab):
    form, out = {}, []
    meets = {w: [x for x in vocab if near(w, x)] for w in vocab}
    for w, n in vocab.items():
        best = min(meets[w], key=lambda x: (-vocab[x], x), default=None)
        form[w] = best if best and vocab[best] >= 2 * n else None
    for w, n in vocab.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(meets[w]), vocab[form[w]] if form[w] else None))
    return sorted(out)


@pytest.fixture(scope="module")
def vocab():
    r = random.Random(8)
    stems = ["".join(r.choices("abcdeé", k=r.randint(5, 9))) for _ in range(60)] + ["straße", "aaaaa", "aaaaaa", "abcde", "÷×øþÿ", "x" * 300]
    words = Counter()
    for s in stems:
        words[s] += r.randint(3, 4000)
        for _ in range(8):
            at = r.randrange(len(s))
            t = r.choice([s[:at] + s[at + 1:], s[:at] + r.choice("abzß") + s[at:], s[:at] + r.choice("abzß") + s[at + 1:], s[::-1], s[1:] + s[:1]])
            if len(t) >= 5:
                words[t] += r.randint(3, 60)
    return dict(words)


@pytest.mark.parametrize("sample,leaf,small,queries", [(50_000, 4096, 10, 65_536), (60, 4, 2, 3), (5, 8, 1, 2)])
def test_variants_match_brute_force(spark, vocab, monkeypatch, sample, leaf, small, queries):
    for name, value in (("SAMPLE", sample), ("LEAF", leaf), ("LEAST_LEAF", leaf), ("SMALL_LEAF", small), ("QUERIES", queries)):
        monkeypatch.setattr(spelling, name, value)
    df = spark.createDataFrame([(w, n, "clash") for w, n in vocab.items()], "word string, n long, root string").repartition(3)
    got = variants(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == brute_variants(vocab)


def test_word_counts_match_brute_force(spark, vocab, monkeypatch):
    monkeypatch.setattr(spelling, "FLUSH_WORDS", 50)
    r = random.Random(3)
    words = [w.title() if r.random() < 0.2 else w for w in vocab for _ in range(6)]
    rows = [(i % 300 or None, r.choice([" ", ", ", "1", "\n", "ā"]).join(r.choices(words, k=12))) for i in range(400)]
    rows += [(1, None), (2, ""), (3, " ".join(words * 4)), (3, "short Ünïcode ÀÉÎÕÜ"), (4, "aaaaa" * 30)]
    df = spark.createDataFrame([(i, t, "w") for i, t in rows], "doc_id long, text string, word string")
    got = {x.word: x.n for x in word_counts(df).collect()}
    want = brute_counts(rows)
    assert got == want and any(zlib.crc32(f"{i}:{w}".encode()) % 97 == 0 for i in range(1, 300) for w in vocab)


def test_tree_finds_all_within_reach():
    r = np.random.default_rng(1)
    words = ["".join(r.choice(list("abcd"), 7)) for _ in range(400)]
    _, counts = letters_of(words)
    tree = Tree(counts, 5)
    home = tree.home(counts)
    assert (home == tree.member).all()
    for down in (True, False):
        got = set(zip(*(v.tolist() for v in tree.within(counts, down))))
        diff = counts[None, :].astype(int) - counts[:, None]
        near_ = (diff.clip(0).sum(2) <= 1) & ((-diff).clip(0).sum(2) <= (1 if down else 0))
        assert {(a, int(home[b])) for a, b in zip(*np.nonzero(near_))} <= got
        assert len(got) < 0.8 * len(words) * len(tree.sizes)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert word_counts(docs).count() == 0
    assert variants(word_counts(docs)).columns == ["word", "form", "root", "n", "n_near", "form_n"]
