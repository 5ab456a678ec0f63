"""Operator 3: quality classifier, histogram gradient-boosted trees over document statistics.

Executors turn each whole text into a fixed vector of statistics. A bounded sample of labelled rows
trains the trees on the driver (MAX_TRAIN rows, by a hash of the id, so it does not depend on
partitions). The trees are complete and flattened into arrays, and scoring walks all rows of a batch
down one level of a tree at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import documents, stored
from riskloom.sources.tables import read_table

MAX_TRAIN = 20_000   # labelled rows that training reads at most
TREES, DEPTH, BINS = 80, 4, 64
RATE, L2, LEAST_HESS = 0.15, 1.0, 5.0
CUT = 0.3

_UPPER, _LOWER, _DIGIT = range(65, 91), range(97, 123), range(48, 58)
_SPACE, _SYMBOL, _MARK = (9, 10, 11, 12, 13, 32), b"#*$%&|<>", b"!?.,;:"
STATISTICS = (
    "log_words", "log_bytes", "word_len", "long_words", "short_words", "upper", "lower", "digit", "symbol", "mark",
    "shout", "high", "space", "lines_per_word", "dup_lines", "distinct", "top_word", "same_next", "repeat3",
    "entropy", "pipe", "symbol_end", "shout_end", "caps_words", "worst_upper", "worst_symbol", "worst_distinct",
)
BLOCK_WORDS = 100  # the worst_* statistics look at blocks of so many words


def repeated_triples(seq: np.ndarray, kinds: int) -> float:
    """Share of three-word windows seen before in ``seq``, word numbers below ``kinds``."""
    if len(seq) < 3:
        return 0.0
    pair = seq[:-1] * kinds + seq[1:]
    if kinds >= 2_000_000:  # three numbers would not fit into 64 bits
        pair = np.unique(pair, return_inverse=True)[1]
    return 1.0 - len(np.unique(pair[:-1] * kinds + seq[2:])) / (len(seq) - 2)


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text; all are defined (mostly 0) for an empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * len(STATISTICS)
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float64)
    lens = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ids = {w: i for i, w in enumerate(counts)}
    seq = np.fromiter((ids[w] for w in words), np.int64, n)
    same = float((seq[1:] == seq[:-1]).mean()) if n > 1 else 0.0
    repeat3 = repeated_triples(seq, len(ids))
    p = h[h > 0] / size
    last = Counter(w[-1] for w in words)
    worst_upper = worst_symbol = 0.0
    worst_distinct = 1.0
    starts = list(range(0, n, BLOCK_WORDS))
    if len(starts) > 1 and n - starts[-1] < BLOCK_WORDS // 2:  # a short rest joins the block before it
        starts.pop()
    for a, end in zip(starts, [*starts[1:], n]):
        block = words[a:end]
        b = b"".join(block)
        worst_upper = max(worst_upper, sum(map(bytes.isupper, block)) / len(block))
        worst_symbol = max(worst_symbol, (len(b) - len(b.translate(None, _SYMBOL + b"!"))) / len(b))
        worst_distinct = min(worst_distinct, len(set(block)) / len(block))
    return [
        float(np.log1p(n)), float(np.log1p(size)), float(lens.mean()), float((lens > 12).mean()), float((lens < 3).mean()),
        h[_UPPER].sum() / size, h[_LOWER].sum() / size, h[_DIGIT].sum() / size, h[list(_SYMBOL)].sum() / size, h[list(_MARK)].sum() / size,
        h[33] / n, h[128:].sum() / size, h[list(_SPACE)].sum() / size, len(lines) / n, 1.0 - len(set(lines)) / max(1, len(lines)),
        len(counts) / n, max(counts.values()) / n, same, repeat3, float(-(p * np.log2(p)).sum()), h[124] / n,
        sum(last[c] for c in _SYMBOL) / n, last[33] / n, sum(map(bytes.isupper, words)) / n,
        worst_upper, worst_symbol, worst_distinct,
    ]


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of every row's whole text."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "x": pd.Series([np.array(statistics(t), np.float32) for t in pdf["text"]], dtype=object)})

    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return x.mapInPandas(work, "doc_id long, x array<float>")


class Forest:
    """Complete trees as arrays: inner node i of a tree has the children 2i+1 and 2i+2."""

    def __init__(self, prior: float, feature: np.ndarray, cut: np.ndarray, value: np.ndarray):
        self.prior, self.feature, self.cut, self.value = prior, feature, cut, value

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += value[node - (2 ** DEPTH - 1)]
        return 1.0 / (1.0 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boost TREES trees of logistic loss on binned features; without both labels, the forest is its prior."""
    inner, leaves = 2 ** DEPTH - 1, 2 ** DEPTH
    mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    prior = float(np.log(mean / (1 - mean)))
    feature, cut, value = (np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves)))
    if len(np.unique(y)) < 2:
        return Forest(prior, feature[:0], cut[:0], value[:0])
    k = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    column = np.arange(k) * BINS
    total = np.full(len(x), prior)
    for t in range(TREES):
        p = 1.0 / (1.0 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(x), np.int64)
        for depth in range(DEPTH):
            wide = 2 ** depth
            slot = ((node * k * BINS)[:, None] + column + binned).ravel()
            hist_g = np.bincount(slot, np.repeat(g, k), wide * k * BINS).reshape(wide, k, BINS)
            hist_h = np.bincount(slot, np.repeat(h, k), wide * k * BINS).reshape(wide, k, BINS)
            gl, hl = np.cumsum(hist_g, 2), np.cumsum(hist_h, 2)
            ga, ha = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + L2) + (ga - gl) ** 2 / (ha - hl + L2) - ga**2 / (ha + L2)
            gain[(hl < LEAST_HESS) | (ha - hl < LEAST_HESS)] = -1.0
            best = gain.reshape(wide, -1).argmax(1)
            use = gain.reshape(wide, -1)[np.arange(wide), best] > 1e-6
            f, b = best // BINS, best % BINS
            at = wide - 1 + np.arange(wide)
            feature[t, at] = np.where(use, f, 0)
            # a row goes right when its bin lies above b, that is when its value is above edge b
            cut[t, at] = [edges[i][j] if u and j < len(edges[i]) else np.inf for u, i, j in zip(use, f, b)]
            right = use[node] & (binned[np.arange(len(x)), f[node]] > b[node])
            node = 2 * node + right
        gs, hs = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        value[t] = -RATE * gs / (hs + L2)
        total += value[t][node]
    return Forest(prior, feature, cut, value)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Learns from rows whose crc32(id as text) mod 5 is not 0 and whose label is 0 or 1, at most
    ``max_train`` of them; labels never enter a score. score is the probability of label 1, predicted
    is 1 from CUT on. Null and empty texts get the score of their (constant) statistics. A null id has no label and
    is not held out. Repeated rows come out once each, other columns are ignored, without labels of
    both kinds the score is their mean (0.5 without any), and an empty table gives no rows.
    """
    x = stored(described(docs, id_col, text_col), "statistics")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    marked = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).alias("y"))
    train = x.where(~held).join(marked, "doc_id").orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(max_train).toPandas()
    k = len(STATISTICS)
    forest = fit(np.array(train["x"].tolist(), np.float32).reshape(-1, k), train["y"].to_numpy(np.float64))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            score = forest.score(np.array(pdf["x"].tolist(), np.float32).reshape(-1, k))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"], "score": score,
                                "predicted": (score >= CUT).astype(np.int32)})

    return x.withColumn("held_out", held).mapInPandas(work, "doc_id long, held_out boolean, score double, predicted int")


def q_op3_quality_model(spark, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), read_table(spark, sf_dir, "labels", "doc_id", "quality"))
