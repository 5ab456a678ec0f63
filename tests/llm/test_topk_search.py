"""Exact top-k search against brute force."""

import math

import numpy as np
import pytest

from riskloom.llm import topk_search
from riskloom.llm.topk_search import search_block, segments, top_k


def usable(v):
    return v is not None and all(c is not None and math.isfinite(1024 * c) for c in v)


def brute(rows, k=10, every=100):
    vectors = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows if usable(v)]
    out = set()
    for at, (i, q) in enumerate(vectors):
        if i is None or i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(q, v)), j is None, j or 0) for p, (j, v) in enumerate(vectors) if p != at]
        out |= {(i, r, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(scored)[:k], 1)}
    return out


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(2)
    x = r.normal(size=(700, 12)) / 3
    x[300:520] = x[7]  # one vector holds a third
    x[520:560] = -x[7]
    x[560:600] = np.round(x[560:600])
    out = [(i, v.tolist()) for i, v in enumerate(x)]
    out += [(900, None), (1000, [None] * 12), (1100, [float("nan")] * 12), (1200, [float("inf")] + [0.0] * 11), (1300, [0.0] * 12), (1400, []),
            (1500, [1.5, -2.0]), (None, x[7].tolist()), (200, x[200].tolist()), (200, x[200].tolist()), (-100, x[3].tolist()), (1600, [1e306] * 12)]
    return out


def collected(df):
    return [(r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()]


@pytest.mark.parametrize("block,group", [(16_384, 32), (97, 3), (1, 2)])
def test_top_k_matches_brute_force(spark, rows, monkeypatch, block, group):
    data = rows if block > 1 else rows[::9]
    monkeypatch.setattr(topk_search, "BLOCK", block)
    monkeypatch.setattr(topk_search, "LEAST_GROUP", group)
    df = spark.createDataFrame([(i, v, "clash", 5) for i, v in data], "vec_id long, embedding array<double>, id string, rank int").repartition(5)
    got = collected(top_k(df, df.where("vec_id % 100 = 0")))
    assert set(got) == brute(data)
    assert len({g[:2] for g in got}) == len(got) or block > 1


def test_huge_components_are_exact(spark):
    data = [(0, [1e12, 3.0, -7.0]), (1, [1e12, 1.0, 0.0]), (2, [1e12, 1.0, 1.0]), (3, [5.0, 5.0, 5.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = collected(top_k(df, df.where("vec_id % 100 = 0"), k=2))
    # both products pass the long range: held at its end, the smaller id first
    assert [(g[1], g[2]) for g in sorted(got)] == [(1, 1), (2, 2)] and all(g[3] == topk_search.LONG for g in got)


def test_the_search_stops_early_and_only_on_proof():
    r = np.random.default_rng(4)
    x = np.floor(1024 * r.normal(size=(4000, 16)) * np.exp(r.normal(size=(4000, 1))))
    parts = segments(x)
    spent = []
    for q in x[:40]:
        best, done = search_block(x, parts, q, 10, None)
        want = sorted(((int(v), i) for i, v in enumerate((x @ q).astype(int))), key=lambda t: (-t[0], t[1]))[:10]
        assert best == want
        spent.append(done)
        again, less = search_block(x, parts, q, 10, want[9][0])
        assert again == want and less <= done
    assert np.mean(spent) < 0.7 * x.size


def test_empty_tables(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(df, df).count() == 0
    one = spark.createDataFrame([(100, [1.0])], "vec_id long, embedding array<float>")
    assert top_k(one, one).count() == 0 and top_k(one, df).count() == 0


def test_blocks_are_copied_for_few_groups_and_lie_compact(spark, monkeypatch):
    """The blocks are the larger side: with more of them than tasks are wanted, each goes to one group once."""
    r = np.random.default_rng(8)
    data = [(i, v) for i, v in enumerate(r.normal(size=(1200, 4)).tolist())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    met, searched = [], topk_search._searched

    def counted(index, queries, *rest):
        met.append([(len(x["raw"]), x["n"]) for x in index.select("raw", "n").collect()])
        return searched(index, queries, *rest)

    monkeypatch.setattr(topk_search, "_searched", counted)
    monkeypatch.setattr(topk_search, "BLOCK", 50)
    monkeypatch.setattr(topk_search, "LEAST_GROUP", 1)
    got = collected(top_k(df, df.where("vec_id % 100 = 0")))
    assert set(got) == brute(data)
    pilot, every = met
    assert len(pilot) <= 8 and sum(n for _, n in every) == 1200  # 8 shuffle partitions
    assert all(raw == 2 * 4 * n for raw, n in every)


def test_wide_vectors_make_small_blocks(spark, monkeypatch):
    met, searched = [], topk_search._searched
    monkeypatch.setattr(topk_search, "_searched", lambda index, *rest: met.append([x["n"] for x in index.select("n").collect()]) or searched(index, *rest))
    monkeypatch.setattr(topk_search, "POSTINGS", 512)
    r = np.random.default_rng(9)
    data = [(i, v) for i, v in enumerate(r.normal(size=(90, 64)).tolist())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    assert set(collected(top_k(df, df.where("vec_id % 100 = 0")))) == brute(data)
    assert all(n <= 8 for blocks in met for n in blocks)


def test_compact_keeps_integers():
    for x in ([[-32768.0, 32767.0]], [[32768.0, 0.0]], [[-2.0 ** 31, 5.0]], [[2.0 ** 31, 1.0]], [[1e300, -3.0]]):
        assert (topk_search.compact(np.array(x)).astype(np.float64) == np.array(x)).all()
