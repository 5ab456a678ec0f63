"""Operator 13: exact top-k inner products by an impact-ordered score-at-a-time index.

Vectors become integers, floor(scale * x). The index holds them in blocks. Each block has one posting
segment per (dimension, quantised impact): the vectors whose component falls into that band, with the
band's smallest and largest value. A query turns each segment into a contribution, its own
component times the band's better end, and takes the segments in descending contribution, whatever
their dimension, adding to one accumulator per vector. After every step a contribution that is still unseen is at
most that of its dimension's next segment, so a vector's score is at most what it has gathered plus these
bounds of its unseen dimensions. Who stays below the k-th best known score is proven out. The search stops
when rescoring the rest costs less than going on, and rescores them exactly.

Groups of queries meet blocks of the index, pair by pair: first one block each, which gives every query a
threshold, then all others with that threshold. No pair holds more than BLOCK vectors and GROUP queries, and a block's
postings are bounded whatever the vectors' width. A block is the larger side, so it is copied for as few groups as keep the tasks
busy; the queries go to every block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import shuffle_partitions, stored
from riskloom.session import spent_shuffles_deleted
from riskloom.sources.tables import read_table

BLOCK = 16_384        # vectors of an index block, at most
POSTINGS = 1 << 20    # postings of an index block, at most
GROUP = 4_096         # queries that meet a block together, at most
LEAST_GROUP = 32      # queries of a group if there are few
LEVELS = 32           # impact bands of a block
STEPS = 24            # parts in which the segments of a block are taken
TIGHTEN = (2, 5, 11)  # steps after which the best so far are rescored for a threshold
WRITERS = 4_096       # tasks that cut the index into blocks, at most
SAMPLE = 16           # every so many-th row tells whether it is worth while to bound them all
EXACT = 1 << 53       # integers below it are exact as doubles
LONG = (1 << 63) - 1
INDEX = "block long, n int, ids binary, kind string, raw binary, seg_dim binary, seg_lo binary, seg_hi binary, seg_at binary, posts binary"


def _taking_part(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, vec) of the rows whose vector has only finite components."""
    x = F.transform(F.col(vec_col), lambda v: v.cast("double") * scale)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("vec"))
    return rows.where(F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.floor(out)


def compact(x: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them."""
    for kind in (np.int16, np.int32):
        if np.iinfo(kind).min <= x.min(initial=0) and x.max(initial=0) <= np.iinfo(kind).max:
            return x.astype(kind)
    return x


def segments(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """The posting segments of a block: (dimension, least value, largest value, starts, row numbers)."""
    n, width = x.shape
    low, high = x.min(), x.max()
    band = max(1.0, np.ceil((high - low + 1) / LEVELS))
    level = np.minimum((x - low) // band, LEVELS - 1).astype(np.int64)
    key = (np.arange(width) * LEVELS + level).T.ravel()
    order = np.argsort(key, kind="stable")
    at = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
    values = x.T.ravel()[order]
    return key[order][at] // LEVELS, np.minimum.reduceat(values, at), np.maximum.reduceat(values, at), np.r_[at, n * width], order % n


def _index(rows: DataFrame, width: int, size: int, tasks: int) -> DataFrame:
    """One row per block of ``size`` vectors at most; a task cuts what it reads into blocks as it goes."""
    def block(number: int, held: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(held, ignore_index=True)
        x = _matrix(list(pdf["vec"]), width)
        # a null id comes after all others
        ids = pdf["id"].astype("Int64").fillna(LONG).to_numpy(np.int64)
        nulls = pdf["id"].isna().to_numpy()
        order = np.lexsort((nulls, ids))
        x, ids, nulls = x[order], ids[order], nulls[order]
        dim, lo, hi, at, posts = segments(x)
        raw = compact(x)
        return pd.DataFrame({
            "block": [number], "n": [len(ids)], "ids": [ids.tobytes() + nulls.tobytes()], "kind": [raw.dtype.str], "raw": [raw.tobytes()],
            "seg_dim": [dim.astype(np.int32).tobytes()], "seg_lo": [lo.tobytes()], "seg_hi": [hi.tobytes()],
            "seg_at": [at.astype(np.int64).tobytes()], "posts": [posts.astype(np.uint16).tobytes()]})

    def work(batches):
        number, held, count = TaskContext.get().partitionId(), [], 0
        for pdf in batches:
            for start in range(0, len(pdf), size):
                piece = pdf[start: start + size]
                if count + len(piece) > size:
                    take = size - count
                    yield block(number, [*held, piece[:take]])
                    number, held, count, piece = number + tasks, [], 0, piece[take:]
                held.append(piece)
                count += len(piece)
        if count:
            yield block(number, held)

    return rows.mapInPandas(work, INDEX)


def exact_scores(x: np.ndarray, q: np.ndarray, top: float | None = None) -> np.ndarray:
    """Integer inner products of rows and one query, without overflow or rounding. ``top``: no component of ``x`` is larger."""
    most = (float(np.abs(x).max(initial=0)) if top is None else top) * float(np.abs(q).max(initial=0)) * max(1, len(q))
    if most < EXACT:
        return (x @ q).astype(np.int64)
    if most < 1 << 62:
        return x.astype(np.int64) @ q.astype(np.int64)
    q = [int(v) for v in q]
    out = np.empty(len(x), object)
    out[:] = [sum(a * int(b) for a, b in zip(q, row)) for row in x]
    return out


class Block:
    """A block's vectors, its segments and what all its queries need of them.

    In the order in which a query takes a dimension's segments, a row's segment stands at ``place``: counted from the
    least values on (0) for a falling weight, from the largest on (1) for others.
    """

    def __init__(self, x: np.ndarray, parts: tuple[np.ndarray, ...]):
        self.x = x
        self.dim, self.lo, self.hi, self.at, posts = parts
        self.posts = posts.astype(np.int64)
        n, width = x.shape
        self.top = float(np.abs(x).max(initial=0))
        own = np.arange(len(self.dim))
        first, last = np.searchsorted(self.dim, np.arange(width)), np.searchsorted(self.dim, np.arange(width), "right") - 1
        self.turned = (first + last)[self.dim] - own
        many = np.diff(self.at)
        self.place = np.empty((2, width, n), np.uint8)
        self.place[0, np.repeat(self.dim, many), self.posts] = np.repeat(own - first[self.dim], many)
        np.subtract((last - first).astype(np.uint8)[:, None], self.place[0], out=self.place[1])
        self.room, self.some_room = np.empty((width, n), np.float32), np.empty((width, -(-n // SAMPLE)), np.float32)


def search_block(x: np.ndarray, parts: tuple[np.ndarray, ...], q: np.ndarray, k: int, known: int | None, block: Block | None = None) -> tuple[list[tuple[int, int]], int]:
    """((score, row) of the k best rows, best first, ties by row; postings added).

    ``known`` is a score that k rows elsewhere reach: rows below it may be left out. ``block`` holds ``x`` and ``parts``.
    """
    block = Block(x, parts) if block is None else block
    n, width = x.shape
    weight = q[block.dim]
    rising = weight >= 0
    # equal gains stay in the order in which their dimension is taken, so what is seen of it is a number of segments
    turn = np.where(rising, block.turned, np.arange(len(weight)))
    gain = np.where(rising, weight * block.hi, weight * block.lo)[turn]
    by = np.argsort(-gain, kind="stable")
    order, gain = turn[by], gain[by]
    of, start, stop = block.dim[order], block.at[:-1][order], block.at[1:][order]
    size = stop - start
    end = np.cumsum(size)
    cuts = np.unique(np.searchsorted(end, np.linspace(0, end[-1], STEPS + 1)[1:])) + 1
    place, acc = block.place[(q >= 0).astype(np.int8), np.arange(width)], np.zeros(n)
    # bounds may round, in single precision and where components are huge
    slack = float(np.abs(gain).max()) * width * 1e-12
    floor_, live, first, done = known, np.arange(n), 0, 0
    for step, last in enumerate(cuts):
        rows = np.concatenate([block.posts[a:b] for a, b in zip(start[first:last].tolist(), stop[first:last].tolist())])
        acc += np.bincount(rows, np.repeat(gain[first:last], size[first:last]), n)
        done, first = int(end[last - 1]), last
        left = int(end[-1]) - done
        if n > k and (step in TIGHTEN or last == len(gain)):
            many = min(2 * k, n)
            best = int(np.sort(exact_scores(x[np.argpartition(-acc, many - 1)[:many]], q))[-k])
            floor_ = best if floor_ is None else max(floor_, best)
        if floor_ is None:
            continue
        ahead = np.zeros(width)
        ahead[of[last:][::-1]] = gain[last:][::-1]  # of a dimension's segments the next one stays
        rest, single = ahead.sum() + slack + 1e-5 * np.abs(ahead).sum(), ahead.astype(np.float32)
        seen = np.bincount(of[:last], minlength=width).astype(np.uint8)[:, None]
        if left:
            some = acc[::SAMPLE] + rest - single @ np.less(place[:, ::SAMPLE], seen, out=block.some_room)
            if (np.count_nonzero(some >= floor_) - 4) * SAMPLE * width > 1.1 * left:
                continue
        live = np.flatnonzero(acc + rest - single @ np.less(place, seen, out=block.room) >= floor_)
        if len(live) * width <= left:
            break
    scores = exact_scores(x, q, block.top)[live] if 4 * len(live) > n else exact_scores(x[live], q, block.top)
    if known is not None:
        live, scores = live[scores >= known], scores[scores >= known]
    best = np.argsort(-scores, kind="stable")[:k]  # live is in row order
    return [(int(v), int(r)) for v, r in zip(scores[best], live[best])], done


def _searched(index: DataFrame, queries: DataFrame, width: int, k: int, tasks: int) -> DataFrame:
    """(query, q_id, id, score, own, rank) for the pairs (g, block) that both sides name, in ``tasks`` tasks."""
    def work(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cols = {"query": [], "q_id": [], "id": [], "score": [], "own": [], "rank": []}
        if len(left) and len(right):
            r = left.iloc[0]
            n = int(r["n"])
            ids, nulls = np.frombuffer(r["ids"][: 8 * n], np.int64), np.frombuffer(r["ids"][8 * n:], bool)
            x = np.frombuffer(r["raw"], r["kind"]).reshape(n, width).astype(np.float64)
            parts = (np.frombuffer(r["seg_dim"], np.int32), np.frombuffer(r["seg_lo"]), np.frombuffer(r["seg_hi"]),
                     np.frombuffer(r["seg_at"], np.int64), np.frombuffer(r["posts"], np.uint16))
            block = Block(x, parts)
            for row in right.itertuples():
                q = _matrix([row.vec], width)[0]
                known = None if pd.isna(row.known) else int(row.known)
                best, _ = search_block(x, parts, q, k + 1, known, block)
                for rank, (score, at) in enumerate(best):
                    cols["query"].append(row.query)
                    cols["q_id"].append(row.q_id)
                    cols["id"].append(None if nulls[at] else int(ids[at]))
                    cols["score"].append(max(-LONG - 1, min(LONG, score)))
                    cols["own"].append(bool(not nulls[at] and ids[at] == row.q_id and (x[at] == q).all()))
                    cols["rank"].append(rank)
        return pd.DataFrame({"query": pd.array(cols["query"], "Int64"), "q_id": pd.array(cols["q_id"], "Int64"), "id": pd.array(cols["id"], "Int64"),
                             "score": pd.array(cols["score"], "Int64"), "own": pd.array(cols["own"], "boolean"), "rank": pd.array(cols["rank"], "Int32")})

    index, queries = (side.repartition(tasks, "g", "block") for side in (index, queries))
    return index.groupBy("g", "block").cogroup(queries.groupBy("g", "block")).applyInPandas(
        work, "query long, q_id long, id long, score long, own boolean, rank int")


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``vectors`` with the highest integer inner product per row of ``queries``.

    Components count as floor(scale * x); ranks start at 1, ties go to the smaller id, a null id comes
    last. ``queries`` has the columns of ``vectors``. Of a query's own row (the same id and the same vector) one
    copy is no candidate; all other rows are, repeated ones as often as they occur. Repeated query rows
    are answered once. Null vectors and such with null or non-finite components (after scaling) take no
    part; a missing component of a shorter vector counts 0, so an empty vector scores 0. Query rows with a null
    id are left out. Scores beyond the long range are held at its ends. Other columns are ignored; empty tables
    give no rows.
    """
    spark = vectors.sparkSession
    rows = _taking_part(vectors, id_col, vec_col, scale)
    asked = _taking_part(queries, id_col, vec_col, scale).where("id is not null").withColumnRenamed("id", "q_id").distinct()
    asked = stored(asked.withColumn("query", F.monotonically_increasing_id()), "topk-queries")
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    n_queries, q_width = asked.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if not n or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(1, width, q_width)
    size = max(1, min(BLOCK, POSTINGS // width))
    tasks = min(WRITERS, -(-n // size))
    with spent_shuffles_deleted(spark):
        # the vectors are dealt out as they came, before they are scaled
        dealt = vectors.select(id_col, vec_col).repartition(tasks)
        index = stored(_index(_taking_part(dealt, id_col, vec_col, scale), width, size, tasks), "topk-index")
        n_blocks = index.agg(F.max("block")).first()[0] + 1
        wanted, least, most = shuffle_partitions(spark), -(-n_queries // GROUP), -(-n_queries // LEAST_GROUP)
        of_query = F.xxhash64("query")

        def met(groups: int, queries: DataFrame, blocks: Column, pairs: int) -> DataFrame:
            """``queries`` (with their group ``g`` and their ``block``) after they have met the ``blocks`` of their group."""
            every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")).alias("g")
            return _searched(index.select("*", every).where(blocks), queries, width, k, min(pairs, max(WRITERS, wanted)))

        groups = max(least, min(wanted, most))
        pilot = F.pmod(F.xxhash64("g"), F.lit(n_blocks))
        asked = asked.withColumn("g", F.pmod(of_query, F.lit(groups))).withColumn("pilot", pilot)
        found = first = stored(met(groups, asked.withColumn("block", F.col("pilot")).withColumn("known", F.lit(None).cast("long")), F.col("block") == pilot, groups), "topk-first")
    if n_blocks > 1:
        known = first.where(F.col("rank") == k).select("query", F.col("score").alias("known"))
        rest = asked.join(known, "query", "left").select("*", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<long>")).alias("block"))
        # a block is copied once for each group: no more of them than keep the tasks busy
        groups = max(least, min(-(-wanted // n_blocks), most))
        rest = rest.where(F.col("block") != F.col("pilot")).withColumn("g", F.pmod(of_query, F.lit(groups)))
        found = first.union(met(groups, rest, F.lit(True), groups * n_blocks))
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*order, F.col("own").desc()))).where(F.col("place") <= k + 1)
    # one copy of the query's own row goes
    drop = F.min(F.when(F.col("own"), F.col("place"))).over(Window.partitionBy("query"))
    left = best.withColumn("drop", drop).where("drop is null or place <> drop")
    rank = F.when(F.col("place") > F.col("drop"), F.col("place") - 1).otherwise(F.col("place"))
    return left.select(F.col("q_id").alias("query_id"), rank.cast("int").alias("rank"), F.col("id").alias("vec_id"), "score").where(F.col("rank") <= k)


def q_op13_topk_search(spark, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


# The same definition, by brute force.
ORACLE = {"op13_topk_search": """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as q, row_number() over () as r
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), scored as (
  select a.vec_id as query_id, a.r, b.vec_id, cast(list_inner_product(a.q, b.q) as bigint) as score
  from v a join v b on a.vec_id % 100 = 0 and a.r <> b.r
), ranked as (
  select *, row_number() over (partition by r order by score desc, vec_id) as rank from scored
)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 10
"""}
