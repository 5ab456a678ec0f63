"""Operator 1: n-gram Jaccard join by vertical partitioning.

Two linked documents share many of the first shingles of both in the order of the hashes, whatever else they
hold. So only these heads of all documents are shuffled at first, four bytes a shingle, cut into fragments that
count for each document the head shingles it shares with any other. Documents with fewer than a link needs are
done; the classes of the others are read again, one text each, and go on with whole sets.

The global order of shingle hashes is cut into fragments. Each document class (documents with one
and the same shingle set) is cut into one segment per fragment, and every fragment is worked on
alone: a shingle that only one class holds can take part in no overlap, so a fragment counts, for each class, the
shingles it shares with any other class. The partial counts are summed per class; a class whose
sum is below the threshold's share of its set cannot link. For the few that remain, the rarest
shared shingles give candidate pairs (prefix and position filters, both exact). The sizes of fine
fragments bound a pair's overlap first; of what is left, the partial overlaps are counted per fragment and summed per pair.

Pairs are not expanded inside a group that is already connected: a candidate pair is looked at only
while its two classes carry different labels. Posting lists are walked in blocks that grow: in the order of
their keys, the next block of a list's members meets all later members with other labels, then the links
found are contracted into labels. Lists whose members all carry one label, and lists that are walked through,
drop out. Each pair of a list has its turn exactly once, so the components are exact and no cap is involved.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import (
    ascii_lower_words, documents, mix, power_of_two, shuffle_partitions, stored, word_hashes,
)
from riskloom.llm.components import connected_components

FRAGMENT_SHINGLES = 1_000_000  # shingles that one fragment aims to hold
FLUSH_SHINGLES = 1_000_000     # shingles a map task gathers before it hands out segments
HEAD_SHARE = 25                # percent of a set by which its head is longer than what a linked set may lack
SENT_TEXTS = 4_000_000         # so many hashes of texts or fewer are sent to the texts that they pick
CHUNK_WORDS = 200_000          # words hashed in one numpy call
VERTICAL = 4                   # fragments of the final overlap counts
SENT_PAIRS = 200_000           # with so many pairs or fewer their classes are sent to the segments, and not all segments to them; of classes, labels are sent
CELLS = 32                     # finer fragments whose sizes alone bound a pair's overlap
GROWTH = 8                     # a walk ends its rounds at 1, 8, 64, ... members of a posting list
PAIRS_PER_CLASS = 2            # with so many possible pairs a class or fewer, all are verified at once
PAIRS_AT_ONCE = 1_000          # so many pairs or fewer are verified at once, too few to be worth a round of their own
PAIRS_PER_POSTING = 1          # with so many pairs a posting left or fewer, the rest is met at once
BODY = np.uint64((1 << 48) - 1)


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than ``size`` words: the sequence as one shingle."""
    out: list[np.ndarray] = []
    start = 0
    lists = []
    held = 0
    for i, t in enumerate(texts):
        w = ascii_lower_words(t)
        lists.append(w)
        held += len(w)
        if held >= CHUNK_WORDS or i == len(texts) - 1:
            out += _chunk_sets(lists, size)
            lists, held, start = [], 0, i + 1
    return out


def _chunk_sets(lists: list[list[bytes]], size: int) -> list[np.ndarray]:
    h = mix(word_hashes([w for ws in lists for w in ws]))
    s = h.copy()
    n = len(h)
    with np.errstate(over="ignore"):
        for j in range(1, size):
            nxt = np.zeros(n, np.uint64)
            nxt[: n - j] = h[j:] if n > j else 0
            s = mix(s) * np.uint64(0x9E3779B97F4A7C15) + nxt
        s = mix(s)
        out, at = [], 0
        for ws in lists:
            k = len(ws)
            if k >= size:
                out.append(np.unique(s[at: at + k - size + 1]))
            elif k:
                v = np.array([k], np.uint64)
                for x in h[at: at + k]:
                    v = mix(v) * np.uint64(0x9E3779B97F4A7C15) + x
                out.append(mix(v))
            else:
                out.append(np.empty(0, np.uint64))
            at += k
    return out


def class_key(u: np.ndarray) -> int:
    """One 64-bit key for a shingle set."""
    with np.errstate(over="ignore"):
        total = np.add.reduce(mix(u ^ np.uint64(0xA0761D6478BD642F))) + np.uint64(len(u)) * np.uint64(0xE7037ED1A0B428DB)
        return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def _sets(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = shingle_sets(list(pdf["text"]), size)
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].astype("Int64"), "text_hash": pdf["text_hash"],
                "n": np.array([len(u) for u in sets], np.int64),
                "key": pd.array([class_key(u) if len(u) else None for u in sets], "Int64"),
            })

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return picked.mapInPandas(work, "doc_id long, text_hash long, n long, key long")


def _pack(h: np.ndarray) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(b: bytes) -> np.ndarray:
    six = np.frombuffer(b, np.uint8).reshape(-1, 6)
    full = np.zeros((len(six), 8), np.uint8)
    full[:, :6] = six
    return full.view("<u8").ravel()


def head_lengths(ns: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sets of ``ns`` shingles: how many of the smallest hashes are their heads, and how many of those any linked set's head holds.

    A linked set has at least ``least`` of n shingles in common, so among the first k + n - least of either
    set are the k first common ones. The other set's head reaches less far if it is smaller, down to ``least``.
    """
    def extra(n: np.ndarray) -> np.ndarray:
        return -(-HEAD_SHARE * n // 100)

    least = -(-threshold * ns // 100)
    return np.minimum(ns, ns - least + extra(ns)), np.minimum(least, extra(least))


def _heads(docs: DataFrame, text_col: str, size: int, threshold: int, bits: int) -> DataFrame:
    """Rows (fragment, batch, at, counts, bodies): the heads of many documents, packed per map batch.

    ``at`` numbers a batch's documents. The keys and sizes of a batch are a row of a fragment below 0.
    """
    def flush(batch: int, sets: list[np.ndarray]) -> pd.DataFrame:
        ns = np.array([len(u) for u in sets], np.int64)
        many = head_lengths(ns, threshold)[0]
        h = np.concatenate([u[:k] for u, k in zip(sets, many)])
        doc = np.repeat(np.arange(len(sets), dtype=np.int32), many)
        frag = (h & np.uint64((1 << bits) - 1)).astype(np.int32)
        order = np.argsort(frag.astype(np.uint16) if bits <= 16 else frag, kind="stable")
        h, doc, frag = (h[order] >> np.uint64(bits)).astype(np.uint32), doc[order], frag[order]
        cuts = np.flatnonzero(np.diff(frag)) + 1
        keys = np.array([class_key(u) for u in sets], np.int64)
        rows = [(-1 - int(keys[0] & ((1 << bits) - 1)), batch, keys.tobytes(), ns.tobytes(), b"")]
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(frag)]):
            d = doc[a:b]
            at = np.r_[0, np.flatnonzero(np.diff(d)) + 1]
            rows.append((int(frag[a]), batch, d[at].tobytes(), np.diff(np.r_[at, b - a]).astype(np.int32).tobytes(), h[a:b].tobytes()))
        return pd.DataFrame(rows, columns=["fragment", "batch", "at", "counts", "bodies"])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count, batch, seen = [], 0, TaskContext.get().partitionId() << 32, set()
        for pdf in batches:
            texts = list(pdf["text"])
            for at in range(0, len(texts), 256):
                for u in shingle_sets(texts[at: at + 256], size):
                    if len(u) and (key := class_key(u)) not in seen:
                        seen.add(key)
                        held.append(u)
                        count += len(u)
                if count >= FLUSH_SHINGLES:
                    yield flush(batch, held)
                    held, count, batch = [], 0, batch + 1
        if held:
            yield flush(batch, held)

    return docs.select(F.col(text_col).alias("text")).mapInPandas(
        work, "fragment int, batch long, at binary, counts binary, bodies binary")


def _shared_heads(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per fragment: how many of its shingles each document shares with another one."""
    if pdf["fragment"].iloc[0] < 0:
        return pdf[["batch", "fragment", "at", "counts"]]
    at = [np.frombuffer(x, np.int32) for x in pdf["at"]]
    counts = np.concatenate([np.frombuffer(x, np.int32) for x in pdf["counts"]])
    bodies = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["bodies"]])
    order = np.argsort(bodies)
    bodies, run = bodies[order], np.repeat(np.arange(len(counts), dtype=np.int32), counts)[order]
    same = np.r_[False, bodies[1:] == bodies[:-1], False]
    shared = np.bincount(run[same[1:] | same[:-1]], minlength=len(counts)).astype(np.int32)
    rows, first = [], 0
    for batch, fragment, a in zip(pdf["batch"], pdf["fragment"], at):
        c = shared[first: first + len(a)]
        first += len(a)
        if c.any():
            rows.append((batch, fragment, a[c > 0].tobytes(), c[c > 0].tobytes()))
    return pd.DataFrame(rows, columns=["batch", "fragment", "at", "counts"])


def _enough_in_batch(threshold: int):
    """The keys of a batch's documents whose heads share enough."""
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        names = pdf["fragment"] < 0
        keys = np.frombuffer(pdf.loc[names, "at"].iloc[0], np.int64)
        need = head_lengths(np.frombuffer(pdf.loc[names, "counts"].iloc[0], np.int64), threshold)[1]
        at = np.frombuffer(b"".join(pdf.loc[~names, "at"]), np.int32)
        shared = np.bincount(at, np.frombuffer(b"".join(pdf.loc[~names, "counts"]), np.int32), len(keys))
        return pd.DataFrame({"key": keys[shared >= need]})

    return work


def candidates(docs: DataFrame, text_col: str, size: int, threshold: int, n_shingles: int) -> DataFrame:
    """Keys, some more than once, of all classes that link and of others whose heads share as much.

    Copies of a class in different map tasks count as others, so a class with copies may stay for no link.
    """
    bits = min(31, power_of_two(max(n_shingles / FRAGMENT_SHINGLES, shuffle_partitions(docs.sparkSession))))
    shared = _heads(docs, text_col, size, threshold, bits).groupBy("fragment").applyInPandas(
        _shared_heads, "batch long, fragment int, at binary, counts binary")
    return shared.groupBy("batch").applyInPandas(_enough_in_batch(threshold), "key long")


def _segments(docs: DataFrame, text_col: str, size: int, bits: int) -> DataFrame:
    """Rows (fragment, keys, ns, counts, bodies): the segments of many classes, packed per map batch."""
    def flush(sets: list[np.ndarray]) -> pd.DataFrame:
        keys = np.array([class_key(u) for u in sets], np.int64)
        ns = np.array([len(u) for u in sets], np.int32)
        h = np.concatenate(sets)
        doc = np.repeat(np.arange(len(sets), dtype=np.int32), ns)
        frag = (h >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(h), np.int32)
        order = np.argsort(frag.astype(np.uint16) if bits <= 16 else frag, kind="stable")
        h, doc, frag = h[order], doc[order], frag[order]
        cuts = np.flatnonzero(np.diff(frag)) + 1
        rows = []
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(frag)]):
            d = doc[a:b]
            at = np.r_[0, np.flatnonzero(np.diff(d)) + 1]
            rows.append((int(frag[a]), keys[d[at]].tobytes(), ns[d[at]].tobytes(),
                         np.diff(np.r_[at, b - a]).astype(np.int32).tobytes(), _pack(h[a:b])))
        return pd.DataFrame(rows, columns=["fragment", "keys", "ns", "counts", "bodies"])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count = [], 0
        for pdf in batches:
            texts = list(pdf["text"])
            for at in range(0, len(texts), 256):
                for u in shingle_sets(texts[at: at + 256], size):
                    if len(u):
                        held.append(u)
                        count += len(u)
                if count >= FLUSH_SHINGLES:
                    yield flush(held)
                    held, count = [], 0
        if held:
            yield flush(held)

    return docs.select(F.col(text_col).alias("text")).mapInPandas(
        work, "fragment int, keys binary, ns binary, counts binary, bodies binary")


def _shared_in_fragment(bucket_bits: int):
    """Per fragment: drop shingles of one class only; hand the rest on by class, with their counts."""
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        fragment = int(pdf["fragment"].iloc[0])
        keys = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["keys"]])
        ns = np.concatenate([np.frombuffer(x, np.int32) for x in pdf["ns"]])
        counts = np.concatenate([np.frombuffer(x, np.int32) for x in pdf["counts"]])
        bodies = np.concatenate([_unpack(x) for x in pdf["bodies"]])
        _, first, cls = np.unique(keys.view(np.uint64), return_index=True, return_inverse=True)
        keep_run = np.zeros(len(keys), bool)
        keep_run[first] = True
        keep = np.repeat(keep_run, counts)
        cls = np.repeat(cls.astype(np.int32), counts)[keep]
        bodies = bodies[keep]
        keys, ns = keys[first], ns[first]
        order = np.argsort(bodies)
        bodies, cls = bodies[order], cls[order]
        at = np.r_[0, np.flatnonzero(np.diff(bodies)) + 1] if len(bodies) else np.empty(0, int)
        df = np.diff(np.r_[at, len(bodies)])
        df = np.repeat(df, df)
        keep = df > 1
        bodies, cls, df = bodies[keep], cls[keep], np.minimum(df[keep], 65535).astype(np.uint16)
        order = np.argsort(cls, kind="stable")
        bodies, cls, df = bodies[order], cls[order], df[order]
        rows = []
        if len(cls):
            at = np.r_[0, np.flatnonzero(np.diff(cls)) + 1]
            runs, sizes = cls[at], np.diff(np.r_[at, len(cls)]).astype(np.int32)
            bucket = (keys.view(np.uint64)[runs] >> np.uint64(64 - bucket_bits)).astype(np.int64) if bucket_bits else np.zeros(len(runs), np.int64)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(runs)]):
                x, y = at[a], at[b] if b < len(at) else len(cls)
                rows.append((int(bucket[a]), fragment, keys[runs[a:b]].tobytes(), ns[runs[a:b]].tobytes(),
                             sizes[a:b].tobytes(), _pack(bodies[x:y]), df[x:y].tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "fragment", "keys", "ns", "counts", "bodies", "dfs"])

    return work


def _survivors_in_bucket(threshold: int):
    """Sum the partial counts of each class; keep those that can still reach the threshold."""
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["keys"]])
        ns = np.concatenate([np.frombuffer(x, np.int32) for x in pdf["ns"]])
        counts = np.concatenate([np.frombuffer(x, np.int32) for x in pdf["counts"]])
        u, first, cls = np.unique(keys, return_index=True, return_inverse=True)
        n = ns[first].astype(np.int64)
        c = np.bincount(cls, weights=counts, minlength=len(u)).astype(np.int64)
        good = 100 * c >= threshold * n
        entry = np.repeat(cls, counts)
        keep = good[entry]
        entry = entry[keep]
        high = [np.full(len(b) // 6, f, np.uint64) << np.uint64(48) for f, b in zip(pdf["fragment"], pdf["bodies"])]
        h = (np.concatenate([_unpack(b) for b in pdf["bodies"]]) | np.concatenate(high))[keep].view(np.int64)
        df = np.concatenate([np.frombuffer(x, np.uint16) for x in pdf["dfs"]])[keep]
        order = np.lexsort((h, df, entry))
        h, entry = h[order], entry[order]
        at = np.r_[0, np.flatnonzero(np.diff(entry)) + 1] if len(entry) else np.empty(0, int)
        ids = entry[at]
        cells = np.bincount(entry * CELLS + (h & (CELLS - 1)), minlength=len(u) * CELLS).reshape(-1, CELLS)
        return pd.DataFrame({"key": u[ids], "n": n[ids], "c": c[ids], "cells": pd.Series(list(cells[ids].astype(np.int32)), dtype=object),
                             "shared": pd.Series([h[a:b] for a, b in zip(at, np.r_[at[1:], len(entry)])], dtype=object)})

    return work


def survivors(docs: DataFrame, text_col: str, size: int, threshold: int, n_shingles: int) -> DataFrame:
    """Classes that may link: (key, n, c, cells, shared), shared ordered from the rarest shingle on, cells its counts per cell."""
    parts = shuffle_partitions(docs.sparkSession)
    bits = power_of_two(max(n_shingles / FRAGMENT_SHINGLES, parts))
    bucket_bits = bits  # a bucket of classes holds about what a fragment holds
    seg = _segments(docs, text_col, size, bits)
    shared = seg.groupBy("fragment").applyInPandas(
        _shared_in_fragment(bucket_bits),
        "bucket long, fragment int, keys binary, ns binary, counts binary, bodies binary, dfs binary")
    return shared.groupBy("bucket").applyInPandas(
        _survivors_in_bucket(threshold), "key long, n long, c long, cells array<int>, shared array<long>")


def _possible(pairs: DataFrame, s: DataFrame, threshold: int) -> DataFrame:
    """Pairs whose overlap can reach the threshold: in each cell it is at most the smaller count of the two."""
    x = pairs.join(s.select(F.col("key").alias("a"), F.col("cells").alias("ca")), "a").join(s.select(F.col("key").alias("b"), F.col("cells").alias("cb")), "b")
    most = F.aggregate(F.zip_with("ca", "cb", lambda x, y: F.least(x, y)), F.lit(0), lambda total, v: total + v)
    return x.withColumn("most", most).where(F.col("most") >= F.ceil((F.col("na") + F.col("nb")) * threshold / F.lit(100.0 + threshold))).select(
        "a", "b", "na", "nb", F.round(0.5 - F.col("most") / (F.col("na") + F.col("nb")), 2).alias("doubt"))


def _verified(pairs: DataFrame, segments: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b, na, nb) whose overlaps, counted per fragment and summed, reach the threshold."""
    left = segments.select(F.col("key").alias("a"), "frag", F.col("hashes").alias("ha"))
    right = segments.select(F.col("key").alias("b"), "frag", F.col("hashes").alias("hb"))
    partial = left.join(pairs, "a").join(right, ["b", "frag"]).select(
        "a", "b", "na", "nb", F.size(F.array_intersect("ha", "hb")).alias("o"))
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("overlap"))
    return total.where(F.lit(100) * F.col("overlap") >= F.lit(threshold) * (F.col("na") + F.col("nb") - F.col("overlap")))


def _links(pairs: DataFrame, segments: DataFrame, threshold: int) -> DataFrame:
    """(src, dst) of those pairs that link; of few pairs only their classes' segments are moved."""
    keys = pairs.select(F.col("a").alias("key")).union(pairs.select("b"))
    few = pairs.count() <= SENT_PAIRS
    own = segments.join(F.broadcast(keys) if few else keys.distinct(), "key", "left_semi")
    return _verified(_sent(pairs, few), own, threshold).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def _sent(table: DataFrame, few: bool) -> DataFrame:
    """``table`` to be sent to what it is joined with if it has few rows: a small table is not worth a shuffle of both."""
    return F.broadcast(table) if few else table


def _with_labels(links: DataFrame, labels: DataFrame, few: bool) -> DataFrame:
    """``links`` (src, dst) with the labels x and y of their ends, where these differ."""
    return links.join(_sent(labels.select(F.col("key").alias("src"), F.col("label").alias("x")), few), "src").join(
        _sent(labels.select(F.col("key").alias("dst"), F.col("label").alias("y")), few), "dst").where("x <> y")


def _contracted(labels: DataFrame, links: DataFrame, few: bool) -> DataFrame:
    """``labels`` (key, label) after links (src, dst): linked labels move to the smallest label next to them, up to four steps far.

    Some labels of one component may stay apart; that costs pairs later, never a link. ``few``: there are few labels.
    """
    ends = _with_labels(links, labels, few)
    hook = stored(ends.groupBy(F.greatest("x", "y").alias("label")).agg(F.min(F.least("x", "y")).alias("to")), "hooks")
    for _ in range(2):
        ahead = hook.select(F.col("label").alias("to"), F.col("to").alias("next"))
        hook = hook.join(_sent(ahead, few), "to", "left").select("label", F.coalesce("next", "to").alias("to"))
    return stored(labels.join(_sent(hook, few), "label", "left").select("key", F.coalesce("to", "label").alias("label")), "labels")


def _thinned(pairs: DataFrame, labels: DataFrame, segments: DataFrame, threshold: int, few: bool) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(pairs, labels, links) after the likeliest pair of each class (of the same doubt, that with the smallest key, so that labels meet) was
    verified and contracted, while there are many pairs a class and that settles a quarter of them. The pairs left are still to be verified."""
    found: list[DataFrame] = []
    many = pairs.count()
    while many > PAIRS_AT_ONCE:
        both = pairs.select(F.col("a").alias("x"), F.struct("doubt", "a", "b", "na", "nb").alias("m")).union(
            pairs.select("b", F.struct("doubt", "a", "b", "na", "nb")))
        best = both.groupBy("x").agg(F.min("m").alias("m"))
        best = stored(best.select("m.*"), "best")
        if many <= PAIRS_PER_CLASS * best.count():
            break
        best = stored(best.select(*pairs.columns).distinct(), "best")
        found.append(stored(_links(best, segments, threshold), "links"))
        labels = _contracted(labels, found[-1], few)
        left = pairs.join(_sent(best.select("a", "b"), few), ["a", "b"], "left_anti")
        for end in ("a", "b"):
            left = left.join(_sent(labels.select(F.col("key").alias(end), F.col("label").alias(f"l{end}")), few), end)
        pairs = stored(left.where("la <> lb").select(*pairs.columns), "pairs")
        before, many = many, pairs.count()
        if 4 * many > 3 * before:  # the best pairs connect little, so the others have their turn at once
            break
    return pairs, labels, found


def links_between(s: DataFrame, threshold: int, growth: int | None) -> DataFrame:
    """Table (src, dst) of class keys that connects exactly what all links connect: of stars of classes that links
    connect, and of links between the stars.

    ``growth=None`` walks all lists in one round and gives every link.
    """
    need = F.ceil(F.col("n") * threshold / F.lit(100.0)).cast("long")
    prefix = F.greatest(F.lit(0), F.col("c") - need + 1).cast("int")

    def in_fragment(f: int):
        return F.filter("shared", lambda x: F.pmod(F.shiftright(x, 17), F.lit(VERTICAL)) == f)

    piece = F.explode(F.array(*[
        F.struct(F.lit(f).alias("frag"), in_fragment(f).alias("hashes")) for f in range(VERTICAL)]))
    segments = stored(s.select("key", piece.alias("s")).select("key", "s.frag", "s.hashes").where(F.size("hashes") > 0), "segments")
    heads_of = s.select("key", "n", "c", F.slice("shared", 1, prefix).alias("prefix"))
    # keys are hashes: the share of all keys below a key tells about how many members of a list stand before it
    place = F.shiftrightunsigned(F.col("key"), 11) / F.lit(float(1 << 53))
    few = s.count() <= SENT_PAIRS
    labels, entries, found, low = s.select("key", F.col("key").alias("label")), None, [], 0
    while True:
        if entries is None:
            live = heads_of.select("key", "n", "c", F.col("key").alias("label"), F.posexplode("prefix").alias("i", "h")).select(
                "h", "key", "n", "label", (F.col("n") - F.col("c") + F.col("i")).alias("pos"))
        else:  # lists of one label never get a second one, so only what was mixed before goes on
            live = entries.join(_sent(labels, few), "key")
        pairs_in = F.count(F.lit(1)) * (F.count(F.lit(1)) - 1) / 2
        mixed = stored(live.groupBy("h").agg(F.min("label").alias("x"), F.max("label").alias("y"), pairs_in.alias("m"), F.count(F.lit(1)).alias("p"))
                       .where((F.col("x") != F.col("y")) & (F.col("p") > low)).select("h", "m", "p"), "mixed")
        work, total = mixed.agg(F.sum("m"), F.sum("p")).first()
        if not work:
            break
        high = None if growth is None or work <= PAIRS_PER_POSTING * total else growth * low or 1  # few pairs are left: meet them all now
        live = live.join(mixed.select("h", "p"), "h").withColumn("place", place)
        turn = F.floor(F.col("place") * F.col("p"))
        heads = live.where(turn >= low if high is None else (turn >= low) & (turn < high)).select("h", F.struct("key", "n", "pos", "label", "place").alias("m"))
        o = F.ceil((F.col("n") + F.col("m.n")) * threshold / F.lit(100.0 + threshold))
        room = F.least(F.col("n") - F.col("pos"), F.col("m.n") - F.col("m.pos"))
        later = (F.col("place") > F.col("m.place")) | ((F.col("place") == F.col("m.place")) & (F.col("key") > F.col("m.key")))
        length = (F.col("n") * 100 >= F.col("m.n") * threshold) & (F.col("m.n") * 100 >= F.col("n") * threshold)
        met = live.join(heads, "h").where((F.col("label") != F.col("m.label")) & later & length & (room >= o))
        a_first = F.col("key") < F.col("m.key")
        pairs = met.select(
            F.least("key", "m.key").alias("a"), F.greatest("key", "m.key").alias("b"),
            F.when(a_first, F.col("n")).otherwise(F.col("m.n")).alias("na"),
            F.when(a_first, F.col("m.n")).otherwise(F.col("n")).alias("nb")).distinct()
        pairs = stored(_possible(pairs, s, threshold), "pairs")
        if high is not None:
            entries = stored(live.where(F.col("p") > high).select("h", "key", "n", "pos"), "entries")
        if growth is not None:
            pairs, labels, first = _thinned(pairs, labels, segments, threshold, few)
            found += first
        new = stored(_links(pairs, segments, threshold), "links")
        found.append(new)
        if high is None:
            break
        low = high
        labels = _contracted(labels, new, few)
    if not found:
        return s.select(F.col("key").alias("src"), F.col("key").alias("dst")).limit(0)
    links = reduce(DataFrame.union, found)
    if growth is None:
        return links
    # the labels' stars say what the links inside them say, so only the others go on, between the stars
    stars = labels.where("key <> label").select(F.col("key").alias("src"), F.col("label").alias("dst"))
    return stars.union(_with_labels(links, labels, few).select(F.col("x").alias("src"), F.col("y").alias("dst")))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     size: int = 4, threshold: int = 85) -> DataFrame:
    """(doc_id, text_hash, n_shingles, class_id, component_id, component_key) for every row of ``docs``.

    Words are split at ASCII space and control white space, A-Z lower-cased. Two documents link when
    100 * overlap >= threshold * union of their distinct ``size``-word shingles; component_id is the
    smallest id reachable by links, class_id the smallest id with the same shingle set.
    component_key is the component's own key, also where two components have the same smallest id.
    A null, empty or blank text has n_shingles 0, its own id as class and component and no key. Repeated rows
    come out once each, and rows with a null id take part like others (they give no id to a
    component). Columns other than the two named are ignored; an empty table gives no rows.
    """
    sets = stored(_sets(docs, id_col, text_col, size), "sets")
    total = sets.agg(F.sum("n")).first()[0] or 0
    classes = sets.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("class_id"))
    texts = sets.where("n > 0").groupBy("key").agg(F.min("text_hash").alias("text_hash"), F.first("n").alias("n"))
    near = stored(texts.join(candidates(docs, text_col, size, threshold, total).distinct(), "key", "left_semi").select("text_hash", "n"), "near")
    rows, total = near.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    picked = near.select(F.col("text_hash").alias("_picked")).distinct()
    near_docs = docs.select(text_col).join(F.broadcast(picked) if rows <= SENT_TEXTS else picked, F.xxhash64(text_col) == F.col("_picked"), "left_semi")
    s = stored(survivors(near_docs, text_col, size, threshold, total), "survivors")
    comp = stored(connected_components(links_between(s, threshold, GROWTH)), "components")
    near = comp.join(classes, comp.node == classes.key).select("key", "class_id", "component")
    least = near.groupBy("component").agg(F.min("class_id").alias("component_id"))
    near = near.join(least, "component").select("key", "component_id", F.col("component").alias("component_key"))
    # written, so that the adaptive skew join can split a key that many copies share
    known = stored(classes.join(near, "key", "left").withColumns({
        "component_id": F.coalesce("component_id", "class_id"), "component_key": F.coalesce("component_key", "key")}), "known")
    return sets.join(known, "key", "left").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "component_key")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of ``docs`` less near copies: of each component the row with the smallest id stays.

    Rows with a null id go by a hash of their text, below all ids. Texts without words are groups
    of their own. Of rows with the same id and text one stays.
    """
    name = F.coalesce(F.col(id_col).cast("long"), -F.shiftrightunsigned(F.xxhash64(F.lit(9), text_col), 1) - 1)
    x = docs.select(F.struct("*").alias("_doc"), name.alias("_id"), F.xxhash64(text_col).alias("_hash"))
    comp = ngram_components(docs.select(name.alias("_id"), F.col(text_col).alias("_text")), "_id", "_text", size, threshold)
    stay = stored(comp.where("doc_id = component_id").groupBy("doc_id", "text_hash", "component_id", "component_key", "n_shingles").agg(F.count(F.lit(1)).alias("rows")), "stay")
    # two texts under one id can be in one group, or in two
    one = stay.where("n_shingles > 0").groupBy("component_id", "component_key").agg(F.min("text_hash").alias("text_hash"), F.sum("rows").alias("rows")).drop("component_key")
    bare = stay.where("n_shingles = 0").select("component_id", "text_hash", "rows")
    one = stored(one.union(bare), "one")
    repeated = not one.where("rows > 1").isEmpty()
    kept = x.join(one, (F.col("_id") == F.col("component_id")) & (F.col("_hash") == F.col("text_hash")), "left_semi")
    if repeated:
        kept = kept.dropDuplicates(["_id", "_hash"])
    return kept.select("_doc.*")


def q_op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_components(documents(spark, sf_dir), size=4, threshold=85).drop("text_hash", "component_key")
