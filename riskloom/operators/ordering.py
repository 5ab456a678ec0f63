"""Order-dependent building blocks that avoid one-task windows.

* ``keyed_sequence`` gives each row its position inside its key and the previous
  value in key order. A hot key (a third of all rows) is split into time buckets:
  rows are windowed per (key, bucket), and a small per-(key, bucket) summary carries
  the count and the last value across bucket edges.
* ``global_position`` numbers rows 1..n in a total order with a range-partitioned
  sort and per-partition offsets, never a single-partition window over the data.
* ``running_total`` sums a column along such positions, block by block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyed_sequence(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    value: str | None = None,
    bucket: Column | None = None,
    descending: bool = False,
    seq_col: str = "seq",
    prev_col: str = "prev_value",
) -> DataFrame:
    """Add ``seq_col`` (1-based position within ``key`` by ``order``) and ``prev_col``.

    ``order`` must be a total order inside a key (end it with a unique id).
    ``bucket`` is a column monotone in ``order`` (default: the hour of ``order[0]``);
    rows are windowed per (key, bucket) so no task holds a whole hot key.
    """
    b = bucket if bucket is not None else F.date_trunc("hour", F.col(order[0]))
    sort = [F.col(c).desc() for c in order] if descending else [F.col(c).asc() for c in order]
    bsort = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    x = df.withColumn("_bucket", b)
    w_local = Window.partitionBy(key, "_bucket").orderBy(*sort)
    x = x.withColumn("_local_seq", F.row_number().over(w_local))
    if value is not None:
        x = x.withColumn("_local_prev", F.lag(F.col(value)).over(w_local))

    last_key = F.struct(*[F.col(c) for c in order])
    aggs = [F.count(F.lit(1)).alias("_n")]
    if value is not None:
        pick = F.min_by if descending else F.max_by
        aggs.append(pick(F.col(value), last_key).alias("_last"))
    summary = x.groupBy(key, "_bucket").agg(*aggs)
    w_b = Window.partitionBy(key).orderBy(bsort)
    summary = summary.withColumn(
        "_offset", F.coalesce(F.sum("_n").over(w_b.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    cols = [key, "_bucket", "_offset"]
    if value is not None:
        summary = summary.withColumn("_prev_last", F.lag("_last").over(w_b))
        cols.append("_prev_last")
    summary = summary.select(F.col(key).alias("_k"), F.col("_bucket").alias("_b"), *cols[2:])
    # null-safe, so that rows without a key or a time keep their place
    same = F.col(key).eqNullSafe(F.col("_k")) & F.col("_bucket").eqNullSafe(F.col("_b"))
    out = x.join(summary, same).drop("_k", "_b")
    out = out.withColumn(seq_col, F.col("_offset") + F.col("_local_seq"))
    if value is not None:
        out = out.withColumn(
            prev_col, F.when(F.col("_local_seq") == 1, F.col("_prev_last")).otherwise(F.col("_local_prev"))
        )
    return out.drop("_bucket", "_local_seq", "_local_prev", "_offset", "_prev_last")


def global_position(df: DataFrame, order: Sequence[Column], name: str = "pos") -> DataFrame:
    """Number rows 1..n in ``order`` (a total order) without a one-partition window.

    The sorted frame is checkpointed to the shared checkpoint folder so the counting
    pass and the numbering pass see the same partitions, even after executor loss.
    """
    from riskloom.session import checkpoint_dir

    spark = df.sparkSession
    checkpoint_dir(spark)
    ordered = df.orderBy(*order).checkpoint(eager=True)
    tagged = ordered.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    sizes = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: a bounded table, so the window and broadcast are safe
    offsets = sizes.withColumn(
        "_off",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).select("_pid", "_off")
    pos = F.col("_off") + (F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)) + 1
    return tagged.join(F.broadcast(offsets), "_pid").withColumn(name, pos).drop("_pid", "_mid", "_off")


POSITION_BLOCK = 4096


def running_total(df: DataFrame, pos: str, value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` up to and with each row, along the positions 1..n of ``pos``.

    Windows run inside blocks of positions; the totals of the blocks, a row each, carry the sums on.
    """
    x = df.withColumn("_block", F.floor((F.col(pos) - 1) / POSITION_BLOCK).cast("long"))
    totals = x.groupBy("_block").agg(F.sum(value).alias("_total"))
    before = F.coalesce(F.sum("_total").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("_block", before.alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("_inside", inside).join(offsets, "_block").withColumn(name, F.col("_before") + F.col("_inside")).drop("_block", "_before", "_inside")
