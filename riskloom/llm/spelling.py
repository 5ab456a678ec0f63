"""Operator 11: spelling variants by k-d trees over letter-count vectors.

One inserted, deleted or replaced letter changes a word's letter counts by at most two in L1
distance: one count at most goes up by one, and one at most goes down by one. So the near words of a word
of length m lie in a small box of letter counts, among the words of length m (one up, one down) and m + 1 (one up).

Per length, the words are cut by the top of a k-d tree over their counts, fitted on a hash sample of
bounded size. Every word goes to its own leaf, and as a query to all leaves whose box lies within reach. A leaf
builds its own small k-d tree, its queries descend with the same pruning, and the words met are verified
by their letter order. Leaves that the sample shows to be too full (equal counts cannot be cut) are split by a hash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import documents, shuffle_partitions, stored

# The letters of a run, and how one run in 97 loses a letter.
RUN = "[A-Za-zÀ-ÿ]+"
ONE_IN = 97
SAMPLE = 50_000         # words that the tops of the trees are fitted on, about
LEAF = 4_096            # words of a leaf, about
LEAST_LEAF = 256        # words of a leaf if there are few
QUERIES = 65_536        # queries that a leaf gets at once, about
SMALL_LEAF = 10         # words of a leaf of the tree inside a task
PAIRS = 1 << 20         # pairs verified together
FLUSH_WORDS = 300_000   # words that a task counts before it hands them on


def letter_numbers() -> np.ndarray:
    """The number of each letter by its code point: a-z, then U+00C0 to U+00FF."""
    to = np.zeros(256, np.int64)
    to[97:123] = np.arange(26)
    to[0xC0:0x100] = np.arange(26, 90)
    return to


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 5) -> DataFrame:
    """(word, n): the words of whole texts after the letter losses, with their occurrences.

    Runs of letters A-Z, a-z and U+00C0 to U+00FF are lower-cased where A-Z. With h the crc32 of
    ``<id>:<run>``, a run loses the letter h mod length if 97 divides h. Words of ``least_letters`` or more
    count. A null text has no words; a null id counts as an empty one.
    """
    # shorter runs cannot give a word
    runs = re.compile(RUN.replace("A-Z", "").replace("+", f"{{{least_letters},}}"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, int] = {}
        crc = zlib.crc32

        def out() -> pd.DataFrame:
            return pd.DataFrame({"word": list(total), "n": list(total.values())})

        for pdf in batches:
            for name, text in zip(pdf["id"], pdf["text"]):
                if not text:
                    continue
                start = crc(f"{name or ''}:".encode())
                for run, c in Counter(runs.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))).items():
                    h = crc(run.encode(), start)
                    if h % ONE_IN == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1:]
                        if len(run) < least_letters:
                            continue
                    total[run] = total.get(run, 0) + c
                if len(total) > FLUSH_WORDS:
                    yield out()
                    total.clear()
        if total:
            yield out()

    part = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(work, "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n"))


class Tree:
    """A k-d tree over letter counts: inner nodes cut one letter's count, leaves are numbered."""

    def __init__(self, counts: np.ndarray, cap: int):
        self.letter, self.cut, self.left, self.right, self.leaf = [], [], [], [], []
        self.sizes: list[int] = []
        self.member = np.zeros(len(counts), np.int64)
        todo = [(np.arange(len(counts)), self._node())]
        while todo:
            rows, node = todo.pop()
            x = counts[rows]
            letter = cut = -1
            if len(rows) > cap:
                # the cut that halves best: for each letter, words with at most c of it
                best = 0
                for c in range(int(x.max(initial=0))):
                    low = (x <= c).sum(0)
                    even = np.minimum(low, len(rows) - low)
                    if even.max() > best:
                        letter, cut, best = int(even.argmax()), c, int(even.max())
                    if best >= 0.45 * len(rows) or c >= 8:
                        break
                if not best:  # rare letters, often repeated
                    spread = x.max(0) - x.min(0)
                    if spread.any():
                        letter = int(spread.argmax())
                        cut = int((int(x[:, letter].max()) + int(x[:, letter].min())) // 2)
            if letter < 0:
                self.leaf[node] = len(self.sizes)
                self.member[rows] = len(self.sizes)
                self.sizes.append(len(rows))
                continue
            low = x[:, letter] <= cut
            self.letter[node], self.cut[node] = letter, cut
            self.left[node], self.right[node] = self._node(), self._node()
            todo += [(rows[low], self.left[node]), (rows[~low], self.right[node])]
        for name in ("letter", "cut", "left", "right", "leaf"):
            setattr(self, name, np.array(getattr(self, name), np.int64))

    def _node(self) -> int:
        for part in (self.letter, self.cut, self.left, self.right, self.leaf):
            part.append(-1)
        return len(self.leaf) - 1

    def home(self, counts: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        node = np.zeros(len(counts), np.int64)
        while True:
            inner = np.flatnonzero(self.leaf[node] < 0)
            if not len(inner):
                return self.leaf[node]
            at = node[inner]
            node[inner] = np.where(counts[inner, self.letter[at]] <= self.cut[at], self.left[at], self.right[at])

    def within(self, counts: np.ndarray, down: bool) -> tuple[np.ndarray, np.ndarray]:
        """(vector, leaf) for each leaf whose box can hold the vector with one count up and, if ``down``, one count down."""
        n = len(counts)
        who, node = np.arange(n), np.zeros(n, np.int64)
        up_used, down_used = np.full(n, -1, np.int16), np.full(n, -1 if down else -2, np.int16)
        got_who, got_leaf = [], []
        while len(who):
            leaf = self.leaf[node]
            end = leaf >= 0
            got_who.append(who[end])
            got_leaf.append(leaf[end])
            who, node, up_used, down_used = who[~end], node[~end], up_used[~end], down_used[~end]
            letter = self.letter[node].astype(np.int16)
            away = counts[who, letter].astype(np.int64) - self.cut[node]  # to the left box if positive, to the right box if not
            # a letter's count that has moved once has no second step, and needs no second payment
            left = (away <= 0) | ((away == 1) & ((down_used == -1) | (down_used == letter)))
            right = (away >= 1) | ((away == 0) & ((up_used == -1) | (up_used == letter)))
            pay_down, pay_up = np.where(away == 1, letter, down_used), np.where(away == 0, letter, up_used)
            who, node, up_used, down_used = (
                np.r_[who[left], who[right]], np.r_[self.left[node[left]], self.right[node[right]]],
                np.r_[up_used[left], pay_up[right]], np.r_[pay_down[left], down_used[right]])
        return np.concatenate(got_who), np.concatenate(got_leaf)


def letters_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters, counts) of words of one length: letter numbers by place, letter counts."""
    size = len(words[0])
    letters = letter_numbers()[np.frombuffer("".join(words).encode("latin-1"), np.uint8)].reshape(-1, size)
    counts = np.bincount((np.arange(len(words))[:, None] * 90 + letters).ravel(), minlength=90 * len(words)).reshape(-1, 90)
    return letters.astype(np.int8), counts.astype(np.int16 if size < 1 << 15 else np.int64)


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ by one replaced letter (equal lengths) or by one inserted into the shorter."""
    if short.shape[1] == long.shape[1]:
        return (short != long).sum(1) == 1
    head = np.cumprod(short == long[:, :-1], 1, dtype=np.int8).sum(1, dtype=np.int64)
    tail = np.cumprod((short == long[:, 1:])[:, ::-1], 1, dtype=np.int8).sum(1, dtype=np.int64)
    return head + tail >= short.shape[1]


def search(members: list[str], queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) numbers of all near pairs; the members are as long as the queries or one letter longer."""
    m_letters, m_counts = letters_of(members)
    q_letters, q_counts = letters_of(queries)
    equal = m_letters.shape[1] == q_letters.shape[1]
    tree = Tree(m_counts, SMALL_LEAF)
    order = np.argsort(tree.member, kind="stable")
    at = np.r_[0, np.cumsum(tree.sizes)]
    # letters present, one bit each (90 letters share 64 bits): a cheap test before the letters themselves
    bit = np.uint64(1) << (np.arange(90) % 64).astype(np.uint64)
    m_has, q_has = (np.bitwise_or.reduce(np.where(c > 0, bit, np.uint64(0)), axis=1) for c in (m_counts, q_counts))
    block = max(1, PAIRS // max(1, m_letters.shape[1]))
    got_q, got_m = [], []
    for start in range(0, len(queries), 4096):
        who, leaf = tree.within(q_counts[start: start + 4096], down=equal)
        who = who + start
        size = np.asarray(tree.sizes)[leaf]
        ends = np.cumsum(size)
        first = 0
        while first < len(who):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, "right")))
            c = size[first:last]
            m = order[np.repeat(at[leaf[first:last]] - np.r_[0, np.cumsum(c)[:-1]], c) + np.arange(int(c.sum()))]
            q = np.repeat(who[first:last], c)
            near = np.bitwise_count(m_has[m] ^ q_has[q]) <= (2 if equal else 1)
            m, q = m[near], q[near]
            for x in range(0, len(m), block):
                hit = one_edit(q_letters[q[x: x + block]], m_letters[m[x: x + block]])
                got_q.append(q[x: x + block][hit])
                got_m.append(m[x: x + block][hit])
            first = last
    return (np.concatenate(v) if v else np.empty(0, np.int64) for v in (got_q, got_m))


class Forest:
    """The tops of the trees, by word length, and how leaves and their queries are split."""

    def __init__(self, words: list[str], share: float, cap: int):
        by: dict[int, list[str]] = {}
        for w in words:
            by.setdefault(len(w), []).append(w)
        self.trees: dict[int, Tree] = {}
        self.parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        counts = {m: letters_of(ws)[1] for m, ws in by.items()}
        for m, x in counts.items():
            tree = Tree(x, max(1, int(cap * share)))
            asked = np.bincount(tree.within(x, True)[1], minlength=len(tree.sizes))
            if m - 1 in counts:
                asked += np.bincount(tree.within(counts[m - 1], False)[1], minlength=len(tree.sizes))
            self.trees[m] = tree
            self.parts[m] = tuple(np.maximum(1, np.ceil(np.asarray(v) / share / most)).astype(np.int64) for v, most in ((tree.sizes, 2 * cap), (asked, QUERIES)))
            tree.member = None

    def send(self, words: list[str], n: np.ndarray) -> Iterator[tuple]:
        """Rows (length, leaf, part, query part, role, words, counts): role 0 members, 1 queries."""
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        salt = np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words))
        for m, rows in by.items():
            rows = np.array(rows)
            counts = letters_of([words[i] for i in rows])[1]
            for length, role in ((m, 0), (m, 1), (m + 1, 1)):
                tree = self.trees.get(length)
                who, leaf = np.arange(len(rows)), np.zeros(len(rows), np.int64)
                parts = q_parts = np.ones(1, np.int64)
                if tree is not None:
                    parts, q_parts = self.parts[length]
                    if role == 0:
                        leaf = tree.home(counts)
                    else:
                        who, leaf = tree.within(counts, down=length == m)
                # a member goes to one part and all query parts, a query to one query part and all parts
                own, other = (parts, q_parts) if role == 0 else (q_parts, parts)
                place, times = salt[rows[who]] % own[leaf], other[leaf]
                again = np.arange(int(times.sum())) - np.repeat(np.r_[0, np.cumsum(times)[:-1]], times)
                who, leaf, place = np.repeat(who, times), np.repeat(leaf, times), np.repeat(place, times)
                part, q_part = (place, again) if role == 0 else (again, place)
                order = np.lexsort((q_part, part, leaf))
                key = np.stack([leaf, part, q_part], 1)[order]
                cuts = np.flatnonzero(np.r_[True, (np.diff(key, axis=0) != 0).any(1)]) if len(key) else []
                for a, b in zip(cuts, np.r_[cuts[1:], len(order)] if len(key) else []):
                    own_rows = rows[who[order[a:b]]]
                    yield (length, *key[a].tolist(), m, role, "\n".join([words[i] for i in own_rows]), n[own_rows].tobytes())


def near_words(vocab: DataFrame, total: int) -> DataFrame:
    """(word, n_near, best): for every word with near words, their number and the one of largest n as (-n, word)."""
    spark = vocab.sparkSession
    share = min(1.0, SAMPLE / total)
    picked = vocab.where(F.pmod(F.xxhash64(F.lit(11), "word"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("word").toPandas()["word"]
    cap = int(min(LEAF, max(LEAST_LEAF, total / (4 * shuffle_partitions(spark)))))
    forest = spark.sparkContext.broadcast(Forest(sorted(picked), share, cap))
    rows = "length int, leaf long, part long, q_part long, size int, role int, words string, n binary"

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in rows.split(", ")]
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame(list(forest.value.send(list(pdf["word"]), pdf["n"].to_numpy(np.int64))), columns=names)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        def side(part: pd.DataFrame):
            words = [w for t in part["words"] for w in t.split("\n")]
            return words, np.concatenate([np.frombuffer(b, np.int64) for b in part["n"]]) if len(part) else np.empty(0, np.int64)

        members, m_n = side(pdf[pdf["role"] == 0])
        out = []
        for size in sorted(set(pdf.loc[pdf["role"] == 1, "size"])) if members else []:
            queries, q_n = side(pdf[(pdf["role"] == 1) & (pdf["size"] == size)])
            q, m = search(members, queries)
            out.append((queries, q, members, m_n, m))
            if size != pdf["length"].iloc[0]:  # the longer words do not ask back
                out.append((members, m, queries, q_n, q))
        cols: dict[str, list] = {"word": [], "n_near": [], "best_n": [], "best": []}
        for words, x, others, n, y in out:
            if not len(x):
                continue
            rank = np.argsort(np.argsort(np.array(others)))  # code-point order
            order = np.lexsort((rank[y], -n[y], x))
            x, y = x[order], y[order]
            at = np.flatnonzero(np.r_[True, np.diff(x) != 0])
            cols["word"] += [words[i] for i in x[at]]
            cols["n_near"] += np.diff(np.r_[at, len(x)]).tolist()
            cols["best_n"] += n[y[at]].tolist()
            cols["best"] += [others[i] for i in y[at]]
        return pd.DataFrame(cols).astype({"word": object, "best": object})  # empty lists are no strings yet

    sent = vocab.mapInPandas(send, rows)
    found = sent.groupBy("length", "leaf", "part", "q_part").applyInPandas(meet, "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) by pointer jumping along (word, form): each round doubles the steps that a word has gone."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = stored(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(vocab: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``vocab`` (distinct words with counts n).

    Words are near if one inserted, deleted or replaced letter makes one from the other. A word's form is its
    near word of largest n (ties: the smallest in code-point order) if that n is twice its own or more, else
    null; root is where the forms lead. An empty table gives no rows; other columns are ignored.
    """
    vocab = stored(vocab.select("word", "n"), "words")
    total = vocab.count()
    if not total:
        return vocab.selectExpr("word", "word as form", "word as root", "n", "n as n_near", "n as form_n")
    near = near_words(vocab, total)
    known = vocab.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("best.less")).alias("best_n"), F.col("best.word").alias("best"))
    takes = F.col("best_n") >= 2 * F.col("n")
    known = stored(known.select("word", "n", "n_near", F.when(takes, F.col("best")).alias("form"), F.when(takes, F.col("best_n")).alias("form_n")), "near-words")
    last = roots(known.where("form is not null"))
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def q_op11_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(word_counts(documents(spark, sf_dir)).where("n >= 3"))
