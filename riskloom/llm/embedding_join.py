"""Operator 4: embedding near-duplicates by an epsilon grid order join.

Equal vectors fall into one class first. Class vectors are scaled to unit length and projected on the leading
principal directions; cosine >= t means distance <= epsilon = sqrt(2 - 2t), and projection never
lengthens a distance. Vectors are sorted by their epsilon grid cells and cut into blocks of
consecutive ones with bounding boxes. Starting from the whole sequence, pairs of intervals are split
level by level, and a pair whose boxes lie further apart than epsilon is dropped. What is left are
pairs of blocks; groups of neighbouring blocks meet in one task and are compared in double
precision. Tasks return a count per vector and a spanning forest of the links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import common  # noqa: F401  (ships this package's functions with the job)
from riskloom.llm.common import stored
from riskloom.llm.components import connected_components
from riskloom.operators.ordering import global_position
from riskloom.sources.tables import read_table

BASIS_ROWS = 20_000  # classes that the principal directions are fitted on, at most
DIRECTIONS = 8
BLOCK = 512          # vectors of a block
FAN_BITS = 3         # an interval splits into 2**FAN_BITS
SIDE_BITS = 3        # 2**SIDE_BITS neighbouring blocks share a task on each side
SLACK = 1e-9


def _usable(vec: str):
    x = F.col(vec)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return F.coalesce((F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _projected(classes: DataFrame, basis: np.ndarray, eps: float) -> DataFrame:
    """Classes with raw vector bytes, grid cells and coordinates along the basis."""
    width, m = basis.shape

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = _matrix(list(pdf["vec"]), width)
            at = _unit(x) @ basis
            out = {"key": pdf["key"], "many": pdf["many"], "dim": [len(v) for v in pdf["vec"]], "raw": [r.tobytes() for r in x]}
            cells = np.floor(at / eps).astype(np.int64)
            yield pd.DataFrame(out | {f"g{i}": cells[:, i] for i in range(m)} | {f"c{i}": at[:, i] for i in range(m)})

    schema = "key long, many long, dim int, raw binary, " + ", ".join(f"g{i} long" for i in range(m)) + ", " + ", ".join(f"c{i} double" for i in range(m))
    return classes.select("key", "many", "vec").mapInPandas(work, schema)


def _blocks(ordered: DataFrame, m: int) -> DataFrame:
    """One row per block of consecutive vectors: packed members and the bounding box."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        lo = {f"lo{i}": [pdf[f"c{i}"].min()] for i in range(m)}
        hi = {f"hi{i}": [pdf[f"c{i}"].max()] for i in range(m)}
        return pd.DataFrame({
            "block": [int(pdf["block"].iloc[0])], "keys": [pdf["key"].to_numpy(np.int64).tobytes()], "many": [pdf["many"].to_numpy(np.int64).tobytes()],
            "dims": [pdf["dim"].to_numpy(np.int32).tobytes()], "raw": [b"".join(pdf["raw"])]} | lo | hi)

    schema = "block long, keys binary, many binary, dims binary, raw binary, " + ", ".join(f"{s}{i} double" for s in ("lo", "hi") for i in range(m))
    return ordered.withColumn("block", F.floor((F.col("pos") - 1) / BLOCK)).groupBy("block").applyInPandas(pack, schema)


def _near_blocks(blocks: DataFrame, m: int, eps: float) -> DataFrame:
    """Pairs (a, b), a <= b, of blocks whose boxes come within epsilon, found by splitting intervals."""
    top = blocks.agg(F.max("block")).first()[0]
    spark = blocks.sparkSession
    if top is None:
        return spark.createDataFrame([], "a long, b long")
    boxes = blocks.select("block", *[c for c in blocks.columns if c[:2] in ("lo", "hi")])
    steps = 0
    while top >> (FAN_BITS * steps):
        steps += 1
    pairs = spark.range(1).select(F.col("id").alias("a"), F.col("id").alias("b"))

    def children(side: str):
        return F.explode(F.array(*[F.shiftleft(side, FAN_BITS) + i for i in range(2 ** FAN_BITS)])).alias(side)

    for step in range(steps - 1, -1, -1):
        merged = boxes.groupBy(F.shiftright("block", FAN_BITS * step).alias("i")).agg(
            *[F.min(f"lo{i}").alias(f"lo{i}") for i in range(m)], *[F.max(f"hi{i}").alias(f"hi{i}") for i in range(m)])
        x, y = merged.alias("x"), merged.alias("y")
        split = pairs.select(children("a"), "b").select("a", children("b")).where("a <= b")
        gap = sum((F.pow(F.greatest(F.col(f"x.lo{i}") - F.col(f"y.hi{i}"), F.col(f"y.lo{i}") - F.col(f"x.hi{i}"), F.lit(0.0)), F.lit(2.0)) for i in range(m)), F.lit(0.0))
        near = split.join(x, F.col("a") == F.col("x.i")).join(y, F.col("b") == F.col("y.i")).where(gap <= eps * eps + SLACK)
        pairs = stored(near.select("a", "b"), "block-pairs")
    return pairs


def _forest(adj: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Labels (smallest position reachable) of the row and column vectors; columns follow the rows unless ``same``."""
    r, c = adj.shape
    rows = np.arange(r)
    cols = rows if same else np.arange(r, r + c)
    big = r + c
    at = np.flatnonzero(adj.any(1))
    ct = np.flatnonzero(adj.any(0))
    sub = adj[np.ix_(at, ct)]
    rows, cols = rows.copy(), cols.copy()
    while len(at):
        new_rows = np.minimum(rows[at], np.where(sub, cols[ct][None, :], big).min(1))
        moved = (new_rows != rows[at]).any()
        rows[at] = new_rows
        if same:
            cols = rows
        new_cols = np.minimum(cols[ct], np.where(sub, rows[at][:, None], big).min(0))
        moved |= (new_cols != cols[ct]).any()
        cols[ct] = new_cols
        if not moved:
            break
    return rows, cols


def _links(blocks: DataFrame, pairs: DataFrame, width: int, threshold: float) -> DataFrame:
    """(key, n, other): per pair of blocks, each linked vector's number of links and one vector of its component."""
    sides = pairs.select(F.shiftright("a", SIDE_BITS).alias("p"), F.shiftright("b", SIDE_BITS).alias("q"), "a", "b")
    left = sides.groupBy("p", "q", F.col("a").alias("block")).agg(F.collect_set("b").alias("meets"))
    right = sides.select("p", "q", F.col("b").alias("block"), F.array().cast("array<bigint>").alias("meets"))
    need = left.union(right).groupBy("p", "q", "block").agg(F.max("meets").alias("meets"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        held = {}
        for r in pdf.itertuples():
            x = np.frombuffer(r.raw).reshape(-1, width)
            x = x / np.abs(x).max(1, keepdims=True)
            held[r.block] = (np.frombuffer(r.keys, np.int64), np.frombuffer(r.many, np.int64), np.frombuffer(r.dims, np.int32), x, np.sqrt((x * x).sum(1)))
        out = []
        for r in pdf.itertuples():
            for b in sorted(int(v) for v in r.meets):
                ka, ma, da, xa, na = held[r.block]
                kb, mb, db, xb, nb = held[b]
                adj = (xa @ xb.T) / (na[:, None] * nb[None, :]) >= threshold
                adj &= da[:, None] == db[None, :]
                same = b == r.block
                if same:
                    np.fill_diagonal(adj, False)
                if not adj.any():
                    continue
                rows, cols = _forest(adj, same)
                names = ka if same else np.r_[ka, kb]
                n = adj @ mb
                at = np.flatnonzero(n)
                out.append((ka[at], n[at], names[rows[at]]))
                if not same:
                    n = ma @ adj
                    at = np.flatnonzero(n)
                    out.append((kb[at], n[at], names[cols[at]]))
        cols = [np.concatenate([o[i] for o in out]) if out else np.empty(0, np.int64) for i in range(3)]
        return pd.DataFrame(dict(zip(("key", "n", "other"), cols)))

    met = need.join(blocks.select("block", "keys", "many", "dims", "raw"), "block")
    return met.groupBy("p", "q").applyInPandas(work, "key long, n long, other long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Vectors link when their cosine, in double precision, is at least ``threshold``. Null, empty or zero
    vectors, and such with null or non-finite components, link with nothing, and so do vectors of
    different lengths. Equal vectors link (repeated rows too, each counted). A null id takes part but
    names no component. Other columns are ignored; an empty table gives no rows.
    """
    eps = float(np.sqrt(2.0 - 2.0 * threshold))
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec")).withColumn("ok", _usable("vec"))
    rows = stored(base.select("vec_id", F.when(F.col("ok"), F.xxhash64("vec")).alias("key")), "vectors")
    classes = stored(base.where("ok").groupBy(F.xxhash64("vec").alias("key")).agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("many"), F.any_value("vec").alias("vec")), "classes")
    width = classes.agg(F.max(F.size("vec"))).first()[0] or 1
    sample = classes.orderBy(F.xxhash64(F.lit(1), "key"), "key").limit(BASIS_ROWS).select("vec").toPandas()
    x = _unit(_matrix(list(sample["vec"]), width)) if len(sample) else np.eye(width)
    m = min(DIRECTIONS, width)
    basis = np.linalg.eigh(np.cov(x.T).reshape(width, width) if len(x) > 1 else np.eye(width))[1][:, ::-1][:, :m].copy()
    order = [F.col(f"g{i}") for i in range(m)] + [F.col("c0"), F.col("key")]
    blocks = stored(_blocks(global_position(_projected(classes, basis, eps), order), m), "blocks")
    links = stored(_links(blocks, _near_blocks(blocks, m, eps), width, threshold), "links")
    comp = connected_components(links.where("key <> other").select(F.col("key").alias("src"), F.col("other").alias("dst")))
    near = comp.select(F.col("node").alias("key"), "component").join(classes.select("key", "least"), "key")
    near = near.join(near.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("key", "component_id")
    count = links.groupBy("key").agg(F.sum("n").alias("n"))
    known = stored(classes.select("key", "least", "many").join(near, "key", "left").join(count, "key", "left").select(
        "key", F.coalesce("component_id", "least").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links")), "known")
    out = rows.join(known, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def q_op4_embedding_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
