"""Operator 12: cross-tokenizer alignment by divide and conquer at shared cuts.

Two tokenizers cut the same bytes. Where both end a token lies a shared cut. An interval of tokens is
halved at the shared cut nearest to its middle: a token end near the middle of one side is looked
for among the other side's ends by bisection, in windows that double. Both halves go on alone, an
interval without an inner cut is a leaf, and the leaves are the groups. All intervals of a batch are
worked on together, level by level.

No token of either vocabulary runs across a space that follows a non-space character (checked when
a vocabulary is loaded), so such places are shared cuts from the start. A text is split there, and a piece that comes
again is aligned once per task.

Links are the token pairs whose bytes overlap. The texts are read and tokenised once: what a run of documents needs
later (its pieces, their link pairs) is written as one packed row. Spark sums the pair counts from these
rows; a second pass over them reads the counts of the most frequent pairs (a bounded number) in the tasks
and meets the others by a join.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.bpe import batches_of, byte_letters
from riskloom.llm.common import documents, stored

CACHE = 200_000       # pieces that a task remembers before it starts anew
CACHE_LINKS = 4_000_000  # links of those pieces
JOINED_CHARS = 8_192  # characters of new pieces that go to a tokenizer as one text
PACKED_PIECES = 100_000  # pieces of the documents of a packed row, about: well under a MB
PACKED_ROWS = 8       # packed rows of a file, so that a task of the second pass holds few at once
LONG_PIECE = 400      # characters from which a piece is aligned each time anew
HEAD_PAIRS = 500_000  # id pairs whose counts go to the tasks, at most
FLUSH_PAIRS = 500_000  # id pairs that a task counts before it hands them on
MARK = "▁"
AFTER_SPACE = re.compile(r"\s |\s\Z")
# Fixed value: the split pattern of byte-level vocabularies of this kind.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def shared_cuts(a_end: np.ndarray, b_end: np.ndarray, a_at: np.ndarray, b_at: np.ndarray) -> np.ndarray:
    """Positions in ``a_end`` of all shared cuts, in order.

    ``a_end`` and ``b_end`` are ascending token ends of many texts, one behind the other; text i has the
    tokens a_at[i]..a_at[i+1] and b_at[i]..b_at[i+1], and both sides end at the same place.
    """
    a0, a1, b0, b1 = a_at[:-1], a_at[1:], b_at[:-1], b_at[1:]
    full = (a1 > a0) & (b1 > b0)
    a0, a1, b0, b1 = a0[full], a1[full], b0[full], b1[full]
    found = [a1 - 1]
    while len(a0):
        # an inner cut needs two tokens on both sides
        more = (a1 - a0 > 1) & (b1 - b0 > 1)
        a0, a1, b0, b1 = a0[more], a1[more], b0[more], b1[more]
        middle = (a0 + a1 - 2) // 2
        cut_a = np.full(len(a0), -1, np.int64)
        cut_b = np.full(len(a0), -1, np.int64)
        live, near, far = np.arange(len(a0)), 0, 1
        while len(live):
            m, low, high = middle[live], a0[live], a1[live] - 1  # inner ends: low..high-1
            left, right = np.maximum(low, m - far + 1), np.minimum(high, m + far)
            skip_left, skip_right = np.maximum(left, m - near + 1), np.minimum(right, m + near)
            sizes = np.r_[np.maximum(0, skip_left - left), np.maximum(0, right - skip_right)] if near else np.maximum(0, right - left)
            starts = np.r_[left, skip_right] if near else left
            who = np.r_[np.arange(len(live)), np.arange(len(live))] if near else np.arange(len(live))
            where = np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(int(sizes.sum()))
            who = np.repeat(who, sizes)
            at = np.searchsorted(b_end, a_end[where])
            hit = (at < b1[live][who] - 1) & (b_end[np.minimum(at, len(b_end) - 1)] == a_end[where])
            where, who, at = where[hit], who[hit], at[hit]
            order = np.lexsort((np.abs(where - m[who]), who))
            first = order[np.flatnonzero(np.r_[True, np.diff(who[order]) != 0])] if len(order) else order
            cut_a[live[who[first]]] = where[first]
            cut_b[live[who[first]]] = at[first]
            spent = (left <= low) & (right >= high)
            live = live[(cut_a[live] < 0) & ~spent]
            near, far = far, 2 * far
        got = cut_a >= 0
        a0, a1, b0, b1, ca, cb = (v[got] for v in (a0, a1, b0, b1, cut_a, cut_b))
        found.append(ca)
        a0, a1, b0, b1 = np.r_[a0, ca + 1], np.r_[ca + 1, a1], np.r_[b0, cb + 1], np.r_[cb + 1, b1]
    return np.sort(np.concatenate(found))


def quick_encoder(path: str):
    """A single-threaded encoder of a byte-level BPE file for ordinary words, or None if its ids are not in merge order.

    Its time grows with the square of a word's length, so long words go to the library of the file.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, letters = spec["model"]["vocab"], byte_letters()
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    if any(x >= y for x, y in zip(made, made[1:])):
        return None
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in piece): i for piece, i in vocab.items() if piece not in special}
    return tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Aligner:
    """Two vocabularies, and the pieces aligned so far."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.quick = quick_encoder(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for piece, i in self.a.get_vocab().items():
            self.bytes_a[i] = piece.encode() if piece in special else bytes(letters[c] for c in piece)
        self.size_b = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        # one vocabulary cuts before every space behind a non-space, the other splits words by its pattern
        self.splits = not any(MARK in p.lstrip(MARK) for p in pieces) and MARK in pieces
        self.space_b = self.b.piece_to_id(MARK)
        self.code_type = np.int32 if len(self.bytes_a) * self.size_b < 1 << 31 else np.int64
        self.len_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.len_b = np.array([len(x) for x in self.bytes_b], np.int64)
        wide = max(len(str(len(self.bytes_a))), len(str(self.size_b))) + 1
        most = max(len(self.bytes_a), self.size_b)
        self.text_of = {s: np.array([f"{i}{s}".encode() for i in range(most)], f"S{wide}") for s in ",|;"}
        self.digits = np.array([len(str(i)) + 1 for i in range(most)], np.int64)
        self.leaving = lambda: None  # called before the pieces are forgotten
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.stats = np.empty((0, 4), np.int64)  # tokens of a, of b, groups, whether the bytes are those of the piece
        self.codes = np.empty(0, self.code_type)
        self.code_at = np.zeros(1, np.int64)

    def pieces(self, text: str) -> list[str]:
        """Space and text, cut before each space that follows a non-space."""
        text = " " + text
        if not self.splits:
            return [text]
        parts = text.split(" ")[1:]
        if not AFTER_SPACE.search(text):  # the common case: a cut before every space
            return [" " + p for p in parts]
        out, held = [], ""
        for p in parts:
            held += " " + p
            if p and not p[-1].isspace():
                out.append(held)
                held = ""
        return [*out, held] if held else out

    def _alone(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids of both sides for pieces encoded one by one, empty where they do not give the bytes back."""
        a = [e.ids for e in self.a.encode_batch(pieces, add_special_tokens=False)]
        # the second tokenizer puts the leading space itself, but not before an empty text
        b = [[self.space_b] if p == " " and self.splits else self.b.encode(p[1:]) for p in pieces]
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        same = [b"".join([self.bytes_a[i] for i in x]) == r and b"".join([self.bytes_b[i] for i in y]) == r for x, y, r in zip(a, b, raw)]
        return [x if ok else [] for x, ok in zip(a, same)], [y if ok else [] for y, ok in zip(b, same)], same

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of a, their starts by piece, ids of b, their starts, whether the bytes are those of the piece).

        Pieces are joined and encoded as one text, as no token runs from one into the next; the token ends
        tell them apart. Long ones, such with white space at the end, and joined texts that do not give their
        bytes back are encoded piece by piece.
        """
        parts: list[tuple] = []

        def alone(ps: list[str]) -> None:
            a, b, same = self._alone(ps)
            parts.append(([i for x in a for i in x], list(map(len, a)), [i for x in b for i in x], list(map(len, b)), same))

        def together(ps: list[str]) -> None:
            text = "".join(ps)
            raw = text.encode("utf-8", "surrogatepass")
            a = self.quick(text) if self.quick else self.a.encode(text, add_special_tokens=False).ids
            b = self.b.encode(text[1:])
            if b"".join([self.bytes_a[i] for i in a]) != raw or b"".join([self.bytes_b[i] for i in b]) != raw:
                return alone(ps)
            sizes = list(map(len, ps)) if len(raw) == len(text) else [len(p.encode("utf-8", "surrogatepass")) for p in ps]
            ends = np.cumsum(sizes)
            n_a = np.searchsorted(np.cumsum(self.len_a[a]), ends, "right")
            n_b = np.searchsorted(np.cumsum(self.len_b[b]), ends, "right")
            parts.append((a, np.diff(n_a, prepend=0), b, np.diff(n_b, prepend=0), [True] * len(ps)))

        held, chars = [], 0
        for p in pieces:
            if len(p) >= LONG_PIECE or not self.splits or p[-1].isspace():
                if held:
                    together(held)
                    held, chars = [], 0
                alone([p])
                continue
            held.append(p)
            chars += len(p)
            if chars >= JOINED_CHARS:
                together(held)
                held, chars = [], 0
        if held:
            together(held)
        ids_a, n_a, ids_b, n_b, same = (np.concatenate([np.asarray(x[i], np.int64) for x in parts]) for i in range(5))
        return ids_a, np.r_[0, np.cumsum(n_a)], ids_b, np.r_[0, np.cumsum(n_b)], same.astype(bool)

    def align(self, pieces: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """For each piece (beginning with its space): stats, groups as text; all link codes and where each piece's start."""
        a, a_at, b, b_at, same = self._encode(pieces)
        a_end, b_end = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        cut_a = shared_cuts(a_end, b_end, a_at, b_at)
        cut_b = np.searchsorted(b_end, a_end[cut_a])
        n = len(pieces)
        owner_cut = np.searchsorted(a_at, cut_a, "right") - 1
        stats = np.stack([np.diff(a_at), np.diff(b_at), np.bincount(owner_cut, minlength=n), same], 1)
        # links: each stretch between two neighbouring ends lies in one token of each side
        ends = np.union1d(a_end, b_end)
        la, lb = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
        codes = a[la] * self.size_b + b[lb]
        code_at = np.r_[0, np.cumsum(stats[:, 0] + stats[:, 1] - stats[:, 2])]
        # groups as text: the tokens of a group, side by side, each with what follows it
        group_a = np.searchsorted(cut_a, np.arange(len(a)))
        group_b = np.searchsorted(cut_b, np.arange(len(b)))
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[cut_a], last_b[cut_b] = True, True
        order = np.lexsort((np.r_[np.zeros(len(a), np.int8), np.ones(len(b), np.int8)], np.r_[group_a, group_b]))
        shown = np.r_[np.where(last_a, self.text_of["|"][a], self.text_of[","][a]), np.where(last_b, self.text_of[";"][b], self.text_of[","][b])][order]
        flat = shown.tobytes().replace(b"\0", b"")
        stop = np.r_[0, np.cumsum(self.digits[np.r_[a, b][order]])][a_at + b_at].tolist()
        text = [flat[x: y - 1] if y > x else b"" for x, y in zip(stop, stop[1:])]
        return stats, text, codes.astype(self.code_type), code_at

    def learn(self, pieces: list[str]) -> None:
        if not pieces:
            return
        stats, text, codes, code_at = self.align(pieces)
        n = len(self.groups)
        self.known.update(zip(pieces, range(n, n + len(pieces))))
        self.groups += text
        self.stats = np.concatenate([self.stats, stats])
        self.code_at = np.concatenate([self.code_at, code_at[1:] + len(self.codes)])
        self.codes = np.concatenate([self.codes, codes])

    def numbers(self, texts: list[str]) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        """Runs (start, end, per text the numbers of its pieces in ``stats``, ``groups`` and ``code_at``).

        What a run names holds until the next run is asked for.
        """
        for start, end in batches_of(texts):
            if len(self.groups) > CACHE or len(self.codes) > CACHE_LINKS:
                self.leaving()
                self.clear()
            plan = [self.pieces(t) if t else [] for t in texts[start:end]]
            known = self.known
            self.learn(list(dict.fromkeys(p for row in plan for p in row if p not in known)))
            yield start, end, [np.fromiter(map(known.__getitem__, row), np.int64, len(row)) for row in plan]
            for p in [p for row in plan for p in row if len(p) >= LONG_PIECE]:
                known.pop(p, None)


def flat_links(al: Aligner, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The link codes of pieces, one behind the other, and how many each piece has."""
    size = al.code_at[numbers + 1] - al.code_at[numbers]
    where = np.repeat(al.code_at[numbers] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum()))
    return al.codes[where], size


PACKED = "ids binary, nulls binary, stats binary, shas string, piece binary, piece_at binary, code binary, code_at binary"


def packed(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """The documents, many to a row: ids, token and group counts, digests, pieces, and the link codes of the pieces."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        al = Aligner(path_a, path_b)
        held: list[tuple] = []  # (id, whether it is null, counts, digest, piece numbers)
        ready: list[pd.DataFrame] = []

        def pack() -> None:
            if not held:
                return
            ids, nulls, stats, shas, numbers = zip(*held)
            held.clear()
            used, piece = np.unique(np.concatenate(numbers), return_inverse=True)
            code, size = flat_links(al, used)
            ready.append(pd.DataFrame({
                "ids": [np.array(ids, np.int64).tobytes()], "nulls": [np.array(nulls, bool).tobytes()], "stats": [np.array(stats, np.int64).tobytes()], "shas": [",".join(shas)],
                "piece": [piece.astype(np.int32).tobytes()], "piece_at": [np.r_[0, np.cumsum([len(r) for r in numbers])].astype(np.int64).tobytes()],
                "code": [code.tobytes()], "code_at": [np.r_[0, np.cumsum(size)].astype(np.int32).tobytes()]}))

        al.leaving = pack
        none = np.empty(0, np.int64)
        count = 0
        for pdf in batches:
            names, texts = pdf["doc_id"], list(pdf["text"])
            nulls = names.isna().to_numpy()
            names = names.fillna(0).to_numpy(np.int64)
            for start, end, rows in al.numbers(texts):
                for at, r in zip(range(start, end), rows):
                    if len(r) and al.stats[r, 3].all():
                        sha = hashlib.sha256(b";".join([al.groups[j] for j in r.tolist()])).hexdigest()
                        held.append((names[at], nulls[at], al.stats[r, :3].sum(0), sha, r))
                        count += len(r)
                    else:
                        held.append((names[at], nulls[at], (0, 0, 0), "", none))
                if count > PACKED_PIECES:
                    pack()
                    count = 0
                while ready:
                    yield ready.pop()
        pack()
        while ready:
            yield ready.pop()

    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return x.mapInPandas(work, PACKED)


def _arrays(row, code_type) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return (np.frombuffer(row.piece, np.int32), np.frombuffer(row.piece_at, np.int64), np.frombuffer(row.code, code_type), np.frombuffer(row.code_at, np.int32))


def _pair_counts(rows: DataFrame, size_b: int, code_type) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pd.DataFrame:
            codes, counts = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            held.clear()
            codes, back = np.unique(codes, return_inverse=True)
            counts = np.bincount(back, counts, len(codes)).astype(np.int64)  # integers below 2**53 stay exact
            return pd.DataFrame({"a_id": codes // size_b, "b_id": codes % size_b, "n": counts})

        for pdf in batches:
            for row in pdf.itertuples():
                piece, _, code, code_at = _arrays(row, code_type)
                times = np.bincount(piece, minlength=len(code_at) - 1)
                held.append((code.astype(np.int64), np.repeat(times, np.diff(code_at))))
                if sum(len(c) for c, _ in held) > FLUSH_PAIRS:
                    yield out()
        if held:
            yield out()

    part = rows.select("piece", "piece_at", "code", "code_at").mapInPandas(work, "a_id long, b_id long, n long")
    return part.groupBy("a_id", "b_id").agg(F.sum("n").alias("n"))


def link_counts(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text") -> DataFrame:
    """(a_id, b_id, n): how many links of the whole corpus hold each id pair."""
    al = Aligner(path_a, path_b)
    rows = packed(docs.withColumn("_id", F.lit(None).cast("long")), path_a, path_b, "_id", text_col)
    return _pair_counts(rows, al.size_b, al.code_type)


def aligned(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``groups``, an array of (a: ids, b: ids) between shared cuts of space + text.

    Ids of the first vocabulary are those of space + text, of the second those of text (it puts the space
    itself); strings of special tokens are plain text. A null or empty text, and one whose
    tokens do not give the bytes back, has no groups. Long texts are aligned whole. Other columns pass
    through (a ``groups`` column is replaced); an empty table stays empty.
    """
    keep = [c for c in docs.columns if c != "groups"]
    ids = T.ArrayType(T.IntegerType())
    kind = T.ArrayType(T.StructType([T.StructField("a", ids), T.StructField("b", ids)]))
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("groups", kind)])

    def work(batches):
        import pyarrow as pa

        al = Aligner(path_a, path_b)
        kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            for start, end, rows in al.numbers(texts):
                out = []
                for r in rows:
                    text = b";".join([al.groups[i] for i in r]) if len(r) and al.stats[r, 3].all() else b""
                    sides = [g.split(b"|") for g in text.split(b";")] if text else []
                    out.append([{"a": [int(v) for v in x.split(b",")], "b": [int(v) for v in y.split(b",")]} for x, y in sides])
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(start, end - start) for c in keep], pa.array(out, kind)], [*keep, "groups"])

    return docs.select(*keep).mapInArrow(work, schema)


def _head(counts: DataFrame) -> tuple[int, int]:
    """(threshold, pairs below it): at most HEAD_PAIRS pairs have so high a count."""
    sizes = counts.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count(F.lit(1)).alias("pairs"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    held, least = 0, None
    for s in sizes:  # a row for each eighth of an octave
        if held + s["pairs"] > HEAD_PAIRS:
            break
        held, least = held + s["pairs"], s["least"]
    return (least if least is not None else (1 << 62)), sum(s["pairs"] for s in sizes) - held


def digests(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs``.

    n_best counts links whose pair is the commonest of its second id in the corpus, ties included;
    count_sum adds up the links' pair counts. Texts without tokens (see ``aligned``) have zeros and ''.
    Repeated rows come out once each and count each time; a null id stays null.
    """
    spark = docs.sparkSession
    al = Aligner(path_a, path_b)
    size_b, code_type = al.size_b, al.code_type
    rows = stored(packed(docs, path_a, path_b, id_col, text_col), "aligned", PACKED_ROWS)
    counts = stored(_pair_counts(rows, size_b, code_type), "pair-counts")
    most = counts.groupBy("b_id").agg(F.max("n").alias("most"))  # a row for each id of a vocabulary
    counts = stored(counts.join(F.broadcast(most), "b_id").select("a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")
    least, rest = _head(counts)
    head = counts.where(F.col("n") >= least).select("a_id", "b_id", "n", "best").toPandas()
    key = head["a_id"].to_numpy(np.int64) * size_b + head["b_id"].to_numpy(np.int64)
    order = np.argsort(key)
    # the last key is no pair's
    sent = spark.sparkContext.broadcast((np.r_[key[order], -1], np.r_[head["n"].to_numpy(np.int64)[order], 0], np.r_[head["best"].to_numpy(bool)[order], False]))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, n, best = sent.value
        for pdf in batches:
            for row in pdf.itertuples():
                piece, piece_at, code, code_at = _arrays(row, code_type)
                at = np.searchsorted(key[:-1], code)
                known = key[at] == code
                owner = np.repeat(np.arange(len(code_at) - 1), np.diff(code_at))

                def per_piece(x):  # sums over the links of each piece, exact in integers
                    total = np.r_[0, np.cumsum(x)]
                    return total[code_at[1:]] - total[code_at[:-1]]

                def per_doc(x):
                    total = np.r_[0, np.cumsum(x[piece])]
                    return total[piece_at[1:]] - total[piece_at[:-1]]

                stats = np.frombuffer(row.stats, np.int64).reshape(-1, 3)
                odd = np.flatnonzero(per_doc(per_piece((~known).astype(np.int64))))
                codes, times = [()] * len(stats), [()] * len(stats)
                for i in odd:
                    mine = piece[piece_at[i]: piece_at[i + 1]]
                    of = np.concatenate([code[code_at[j]: code_at[j + 1]][~known[code_at[j]: code_at[j + 1]]] for j in mine])
                    codes[i], times[i] = (v.tolist() for v in np.unique(of, return_counts=True))
                ids = pd.array(np.frombuffer(row.ids, np.int64), "Int64")
                ids[np.frombuffer(row.nulls, bool)] = pd.NA
                yield pd.DataFrame({"doc_id": ids, "n_a": stats[:, 0], "n_b": stats[:, 1], "n_groups": stats[:, 2],
                                    "n_best": per_doc(per_piece((known & best[at]).astype(np.int64))), "count_sum": per_doc(per_piece(np.where(known, n[at], 0))),
                                    "groups_sha256": row.shas.split(","), "codes": codes, "times": times})

    out = rows.mapInPandas(work, "doc_id long, n_a long, n_b long, n_groups long, n_best long, count_sum long, groups_sha256 string, codes array<long>, times array<long>")
    columns = ["doc_id", "n_a", "n_b", "n_groups", (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links"), "n_best", "count_sum", "groups_sha256"]
    if rest == 0:
        return out.select(*columns)
    out = stored(out.withColumn("row", F.monotonically_increasing_id()), "aligned-rows")
    odd = out.where(F.size("codes") > 0).select("row", F.explode(F.arrays_zip("codes", "times")).alias("p")).select("row", F.col("p.codes").alias("code"), F.col("p.times").alias("times"))
    tail = counts.where(F.col("n") < least).select((F.col("a_id") * size_b + F.col("b_id")).alias("code"), "n", "best")
    added = odd.join(tail, "code").groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    out = out.join(added, "row", "left").withColumns({
        "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return out.select(*columns)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def q_op12_alignment(spark, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), *default_paths())
