"""Operator 6: byte-level BPE encoding and decoding by speculate and verify.

Token ids below the special ones are in merge order, so BPE always applies the merge that makes the
smallest id. A greedy longest match proposes tokens for a whole batch of distinct words at once (a
byte trie walked in numpy lanes). The proposal is the BPE result exactly when every adjacent pair is
compatible, that is, when BPE of the pair's joined bytes gives the pair back. That check undoes
merges step by step and runs over all adjacent pairs of all words at once. Only words with a failing
pair (or a token that BPE would not build) are merged exactly, one merge after another.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import chain, filterfalse, islice, repeat

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm import common  # noqa: F401  (ships this package's functions with the job)
from riskloom.llm.common import documents

# White space as the tokenizer's pattern knows it; Python's \s holds four control characters more.
SPACE = r"\t-\r \x85\xa0  -     　"
# Fixed value: the split pattern of this kind of vocabulary.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
CACHE = 300_000        # chunks that a worker remembers at most
KEPT = 75_000          # of them those that stay then: the first to come, among them the frequent ones
BATCH_CHARS = 1 << 20  # characters encoded together
LONG_WORD = 200        # bytes from which a word is merged alone, with a heap
NO_LIMIT = 1 << 30


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A vocabulary file, its trie and its merge tables.

    With ``ids_only`` nothing but the ids of a chunk is remembered.
    """

    def __init__(self, path: str, ids_only: bool = False):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for k, v in vocab.items():
            self.bytes_of[v] = bytes(letters[c] for c in k)
        for k, v in self.special.items():
            self.bytes_of[v] = k.encode()
        self.byte_id = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        trio = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64)
        if len(trio) and (np.diff(trio[:, 2]) <= 0).any():
            raise ValueError("token ids are not in merge order")
        self.left[trio[:, 2]], self.right[trio[:, 2]] = trio[:, 0], trio[:, 1]
        self.size = size
        self.ids_only = ids_only
        self.own_id, self.decimal = list(range(size)), [str(i) for i in range(size)]
        pair = trio[:, 0] * size + trio[:, 1]
        order = np.argsort(pair)
        self.pair_key, self.pair_made = pair[order], trio[order, 2]
        self.merged = {(a, b): c for a, b, c in trio.tolist()}
        self._trie(vocab, letters)
        self.buildable = self._buildable()
        self.pattern = regex.compile(PATTERN)
        self.split_special = regex.compile("|".join(regex.escape(s) for s in self.special)) if self.special else None
        self.cache: dict[str, tuple[tuple[int, ...], str, bytes]] = {}  # ids, decimal ids, decoded bytes
        self.words: dict[str, tuple[int, ...]] = {}

    def _trie(self, vocab, letters) -> None:
        nodes: dict[bytes, int] = {b"": 0}
        edges, ends = [], {}
        for k, v in vocab.items():
            b = bytes(letters[c] for c in k)
            for i in range(1, len(b) + 1):
                if b[:i] not in nodes:
                    nodes[b[:i]] = len(nodes)
                    edges.append((nodes[b[: i - 1]] * 256 + b[i - 1], nodes[b[:i]]))
            ends[nodes[b]] = v
        e = np.array(sorted(edges), np.int64)
        self.edge_key, self.edge_to = e[:, 0], e[:, 1]
        self.token_at = np.full(len(nodes), -1, np.int64)
        self.token_at[list(ends)] = list(ends.values())

    def _made(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that merging (a, b) makes, or NO_LIMIT."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_made[at], NO_LIMIT)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE keeps the border between the tokens a[i] and b[i].

        A merge across the border would win if it came before the last merge on either side. So both
        sides are taken apart from the border outwards, the youngest token first, and each pair that meets there
        must not merge into a token older than the one just taken apart.
        """
        fine = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.copy(), b.copy()
        limit = np.full(len(a), NO_LIMIT - 1, np.int64)
        while len(live):
            lost = self._made(x, y) < limit
            fine[live[lost]] = False
            splits_x, splits_y = self.right[x] >= 0, self.left[y] >= 0
            from_x = splits_x & (~splits_y | (x > y))
            go = ~lost & (splits_x | splits_y)
            # on the left side, a token as old as the limit itself loses to it; on the right side it wins
            limit = np.where(from_x, x, y + 1)
            x, y = np.where(from_x, self.right[x], x), np.where(from_x, y, self.left[y])
            live, x, y, limit = live[go], x[go], y[go], limit[go]
        return fine

    def _buildable(self) -> np.ndarray:
        """Which tokens BPE gives for their own bytes."""
        plain = [t for t, b in enumerate(self.bytes_of) if b and t not in self.special.values()]
        ok = np.zeros(self.size, bool)
        ok[plain] = [ids == [t] for t, ids in zip(plain, self.exact_many([self.bytes_of[t] for t in plain]))]
        return ok

    def exact(self, word: bytes) -> list[int]:
        """BPE of one word: the merge that makes the smallest id first, the leftmost of equals first."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        merged = self.merged
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(merged[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in merged]
        heapq.heapify(heap)
        while heap:
            made, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or merged.get((ids[i], ids[j])) != made:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (ids[p], ids[q]) in merged:
                    heapq.heappush(heap, (merged[ids[p], ids[q]], p))
        return [t for t in ids if t >= 0]

    def exact_many(self, words: list[bytes]) -> list[list[int]]:
        """``exact`` for many words: each pass applies the smallest merge of every word, leftmost first."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), size)
        got_owner, got_ids = [], []
        while len(ids):
            made = np.full(len(ids), NO_LIMIT, np.int64)
            near = np.flatnonzero(owner[1:] == owner[:-1])
            made[near] = self._made(ids[near], ids[near + 1])
            start = np.r_[0, np.flatnonzero(np.diff(owner)) + 1]
            best = np.minimum.reduceat(made, start)
            run = np.diff(np.r_[start, len(ids)])
            ended = np.repeat(best == NO_LIMIT, run)
            hit = (made == np.repeat(best, run)) & ~ended
            # in a run of overlapping equal pairs every second one merges, from the left
            first = hit & ~np.r_[False, hit[:-1]]
            place = np.arange(len(ids))
            hit &= (place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0
            ids = np.where(hit, made, ids)
            keep = ~np.r_[False, hit[:-1]]
            got_owner.append(owner[ended])
            got_ids.append(ids[ended])
            keep &= ~ended
            ids, owner = ids[keep], owner[keep]
        owner, ids = np.concatenate(got_owner), np.concatenate(got_ids)
        order = np.argsort(owner, kind="stable")
        at = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(words)))].tolist()
        ids = ids[order].tolist()
        return [ids[x:y] for x, y in zip(at, at[1:])]

    def speculate(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words at once: (tokens in word order, tokens per word)."""
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size)
        # one lane per word: at a start, walk the trie; when it ends, emit the last token seen and start behind it
        lane = np.flatnonzero(size)
        at, stop = (end - size)[lane], end[lane]
        node = np.zeros(len(lane), np.int64)
        token, token_end = np.full(len(lane), -1, np.int64), at.copy()
        got_word, got_token = [], []
        while len(lane):
            inside = at < stop
            key = node * 256 + flat[np.minimum(at, stop - 1)]
            e = np.minimum(np.searchsorted(self.edge_key, key), len(self.edge_key) - 1)
            step = inside & (self.edge_key[e] == key)
            node = np.where(step, self.edge_to[e], 0)
            at = at + step
            seen = np.where(step, self.token_at[node], -1)
            token = np.where(seen >= 0, seen, token)
            token_end = np.where(seen >= 0, at, token_end)
            done = ~step
            if done.any():
                got_word.append(lane[done])
                got_token.append(token[done])
                at = np.where(done, token_end, at)
                token = np.where(done, -1, token)
                keep = at < stop
                keep |= ~done
                lane, at, stop, node, token, token_end = (v[keep] for v in (lane, at, stop, node, token, token_end))
        if not got_word:
            return np.empty(0, np.int64), np.zeros(len(words), np.int64)
        word, token = np.concatenate(got_word), np.concatenate(got_token)
        order = np.argsort(word, kind="stable")
        return token[order], np.bincount(word, minlength=len(words))

    def words_to_ids(self, words: list[bytes]) -> list[list[int]]:
        """BPE of distinct words: speculation, verification, and exact merges for what fails."""
        tokens, count = self.speculate(words)
        owner = np.repeat(np.arange(len(words)), count)
        bad = np.zeros(len(words), bool)
        bad[owner[~self.buildable[tokens]]] = True
        same = owner[1:] == owner[:-1]
        a, b = tokens[:-1][same], tokens[1:][same]
        pairs, back = np.unique(a * self.size + b, return_inverse=True)
        fine = self.compatible(pairs // self.size, pairs % self.size)
        bad[owner[1:][same][~fine[back]]] = True
        at = np.r_[0, np.cumsum(count)].tolist()
        tokens = tokens.tolist()
        out = [tokens[x:y] for x, y in zip(at, at[1:])]
        failed = np.flatnonzero(bad).tolist()
        short = [i for i in failed if len(words[i]) < LONG_WORD]
        for i, ids in zip(short, self.exact_many([words[i] for i in short]) if short else []):
            out[i] = ids
        for i in failed:
            if len(words[i]) >= LONG_WORD:
                out[i] = self.exact(words[i])
        return out

    def _learn(self, chunks: list[str]) -> None:
        """Encode chunks that the cache does not hold."""
        parts = [[c] if c[1:].isalpha() and (c[0] == " " or c[0].isalpha()) else self.pattern.findall(c) for c in chunks]
        known = self.words
        if len(known) > CACHE:
            known.clear()
        new = [w for w in dict.fromkeys(w for p in parts for w in p) if w not in known]
        if new:
            # the ids are objects that all words share
            one = self.own_id.__getitem__
            known.update(zip(new, [tuple(map(one, x)) for x in self.words_to_ids([w.encode("utf-8", "surrogatepass") for w in new])]))
        ids = [known[p[0]] if len(p) == 1 else tuple(chain.from_iterable([known[w] for w in p])) for p in parts]
        if self.ids_only:
            self.cache.update(zip(chunks, zip(ids, repeat(""), repeat(b""))))
            return
        decimal, raw = self.decimal.__getitem__, self.bytes_of.__getitem__
        self.cache.update(zip(chunks, [(x, ",".join(map(decimal, x)), b"".join(map(raw, x))) for x in ids]))

    def chunks(self, text: str) -> list[str]:
        """Cut a text before single spaces that follow other text; no token crosses such a cut."""
        pieces = text.split(" ")
        if "" not in pieces and not any(map(str.isspace, pieces)):
            return [pieces[0], *[" " + p for p in pieces[1:]]]
        out, held = [], ""
        for i, p in enumerate(pieces):
            held += " " + p if i else p
            if p and not p.isspace():
                out.append(held)
                held = ""
        if held:
            out.append(held)
        return out

    def encode_batch(self, texts: list[str]) -> list[list[tuple[tuple[int, ...], str, bytes]]]:
        """For each text its chunks' (ids, decimal ids, decoded bytes); special strings in a text are their own ids."""
        plan: list[list[str | int]] = []
        for t in texts:
            if not t:
                plan.append([])
            elif self.split_special is None or not self.split_special.search(t):
                plan.append(self.chunks(t))
            else:
                row: list[str | int] = []
                at = 0
                for m in self.split_special.finditer(t):
                    if m.start() > at:
                        row += self.chunks(t[at: m.start()])
                    row.append(self.special[m[0]])
                    at = m.end()
                plan.append(row + (self.chunks(t[at:]) if at < len(t) else []))
        if len(self.cache) > CACHE:
            self.cache = dict(islice(self.cache.items(), KEPT))
        cache = self.cache
        new = dict.fromkeys(filterfalse(cache.__contains__, chain.from_iterable(plan)))
        alone = {c: ((c,), self.decimal[c], self.bytes_of[c]) for c in new if isinstance(c, int)}
        new = [c for c in new if c not in alone]
        if new:
            self._learn(new)
        if alone:
            return [[alone[c] if c in alone else cache[c] for c in row] for row in plan]
        return [list(map(cache.__getitem__, row)) for row in plan]

    def decode(self, ids) -> str:
        """The text of token ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def batches_of(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Cuts of a list of texts into runs of about BATCH_CHARS characters."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= BATCH_CHARS:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoded(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int), the token ids of the whole text.

    ``path`` is a vocabulary file that executors can read. A null or empty text gives no ids. Other
    columns pass through (an ``ids`` column is replaced), nulls included; an empty table stays empty.
    """
    import pyarrow as pa

    keep = [c for c in docs.columns if c != "ids"]
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def work(batches):
        bpe = Bpe(path, ids_only=True)
        for b in batches:
            texts = b.column(text_col).to_pylist()
            for a, z in batches_of(texts):
                rows = [[x[0] for x in r] for r in bpe.encode_batch(texts[a:z])]
                size = [sum(map(len, r)) for r in rows]
                flat = np.fromiter(chain.from_iterable(chain.from_iterable(rows)), np.int32, sum(size))
                ids = pa.ListArray.from_arrays(np.r_[0, np.cumsum(size)].astype(np.int32), flat)
                yield pa.RecordBatch.from_arrays([b.column(c).slice(a, z - a) for c in keep] + [ids], [*keep, "ids"])

    return docs.select(*keep).mapInArrow(work, schema)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, then decode the ids, digest both."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = Bpe(path)
        for pdf in batches:
            texts, n, one, two = list(pdf["text"]), [], [], []
            for a, z in batches_of(texts):
                for r in bpe.encode_batch(texts[a:z]):
                    ids, decimal, raw = zip(*r) if r else ((), (), ())
                    n.append(sum(map(len, ids)))
                    one.append(hashlib.sha256(",".join(decimal).encode()).hexdigest())
                    # bytes that are no UTF-8 become U+FFFD, as in ``decode``
                    two.append(hashlib.sha256(b"".join(raw).decode("utf-8", "replace").encode()).hexdigest())
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_tokens": n, "ids_sha256": one, "decoded_sha256": two})

    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return x.mapInPandas(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def q_op6_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), default_path())
