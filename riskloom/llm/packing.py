"""Operator 9: token-id output, packed by best-fit decreasing into fixed-length rows.

Documents become token ids (a public rank file, encoded by the tiktoken library) with an end token. Overlong ones are cut into whole rows and a rest, without
loss. Each map task packs its own pieces, a bounded buffer at a time, so nothing is shuffled: longest
piece first, into the row whose free space fits it best, found with a segment tree over capacities.
Each row comes out as a binary id matrix line, the cumulative segment lengths and the positions,
which start anew with every piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import documents

ROW_TOKENS = 2_048
BUFFER_TOKENS = 2_000_000  # tokens that a task packs together
SCHEMA = ("shard long, row int, n_tokens int, ids binary, cu_seqlens array<int>, positions binary, "
          "doc_ids array<long>, starts array<int>")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def open_encoding(path: str):
    """(text -> ids array, end id) of a rank file; strings of special tokens in a text are ordinary text."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: encoding.encode_to_numpy(text, disallowed_special=()), max(ranks.values()) + 1


class Capacities:
    """A segment tree over free space 0..size: the least free space that fits, in log time."""

    def __init__(self, size: int):
        self.leaves = 1 << int(size).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        at = free + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(free, row) with the least free >= need, removed from the tree; None if no row fits."""
        at = need + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        free = at - self.leaves
        row = self.rows[free].pop()
        while at:
            self.count[at] -= 1
            at >>= 1
        return free, row


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Rows of piece numbers; equal lengths keep their order."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    free, rows = Capacities(size), []
    for i in order:
        got = free.take(lengths[i])
        if got is None:
            rows.append([i])
            left, row = size - lengths[i], len(rows) - 1
        else:
            rows[got[1]].append(i)
            left, row = got[0] - lengths[i], got[1]
        if left:
            free.add(left, row)
    return rows


def pieces_of(ids: np.ndarray, size: int) -> list[tuple[int, np.ndarray]]:
    """(start, ids) of a document's pieces: whole rows and a rest."""
    return [(a, ids[a: a + size]) for a in range(0, len(ids), size)]


def packed(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", row_tokens: int = ROW_TOKENS) -> DataFrame:
    """Packed rows (SCHEMA): little-endian ids (uint16, or uint32 for large vocabularies) padded with the end id,
    cumulative segment lengths, uint32 positions that restart with each piece, and for each piece its
    document and start within it.

    Every document ends with the end token, so null and empty texts are one token long. Null ids stay
    null, repeated rows are packed each, other columns are ignored, an empty table gives no rows.
    """
    def flush(shard: int, held: list) -> pd.DataFrame:
        rows = best_fit_decreasing([len(p[2]) for p in held], row_tokens)
        out = []
        for r, members in enumerate(rows):
            parts = [held[i] for i in members]
            size = [len(p[2]) for p in parts]
            used = sum(size)
            line = np.full(row_tokens, parts[0][3], parts[0][2].dtype)
            line[:used] = np.concatenate([p[2] for p in parts])
            positions = np.zeros(row_tokens, "<u4")
            positions[:used] = np.concatenate([np.arange(n, dtype="<u4") for n in size])
            out.append((shard, r, used, line.tobytes(), np.cumsum([0, *size]).tolist(), positions.tobytes(), [p[0] for p in parts], [p[1] for p in parts]))
        return pd.DataFrame(out, columns=["shard", "row", "n_tokens", "ids", "cu_seqlens", "positions", "doc_ids", "starts"])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of, end = open_encoding(path)
        kind = "<u2" if end < 1 << 16 else "<u4"
        shard, held, count = TaskContext.get().partitionId() << 20, [], 0
        for pdf in batches:
            names = [None if pd.isna(v) else int(v) for v in pdf["doc_id"]]
            for name, text in zip(names, pdf["text"]):
                ids = np.append(ids_of(text or ""), end).astype(kind)
                held += [(name, start, p, end) for start, p in pieces_of(ids, row_tokens)]
                count += len(ids)
                if count >= BUFFER_TOKENS:
                    yield flush(shard, held)
                    shard, held, count = shard + 1, [], 0
        if held:
            yield flush(shard, held)

    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return x.mapInPandas(work, SCHEMA)


def q_op9_packing(spark, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir), default_path())
