"""Connected components of an edge table by alternating star contractions, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import stored


SENT_EDGES = 200_000  # with so many edges or fewer the nodes' smallest neighbours are sent to the edges


def _large_star(e: DataFrame, few: bool) -> DataFrame:
    """Every node hands its larger neighbours to its smallest neighbour (itself included)."""
    both = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
    return (
        both.where("dst > src").join(F.broadcast(least) if few else least, "src")
        .select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst")
    )


def _small_star(e: DataFrame, few: bool) -> DataFrame:
    """Every node hands its smaller neighbours and itself to the smallest of them."""
    down = e.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = down.groupBy("src").agg(F.min("dst").alias("m"))
    # the smallest neighbour's own row hands over the node
    moved = F.when(F.col("dst") == F.col("m"), F.col("src")).otherwise(F.col("dst"))
    return down.join(F.broadcast(least) if few else least, "src").select(moved.alias("src"), F.col("m").alias("dst")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(src, dst)``; component is the smallest node reachable.

    Each pass is two joins on node ids with map-side combined minima; a hub's rows are split by the
    adaptive skew join. The loop ends when a pass changes nothing. Null ends and loops are dropped;
    an empty edge table gives an empty result.
    """
    e = stored(edges.where("src is not null and dst is not null and src <> dst")
               .select(F.col("src").cast("long"), F.col("dst").cast("long")).distinct(), "edges")
    last, few = None, e.count() <= SENT_EDGES  # a pass makes no more edges than there were
    while True:
        e = stored(_small_star(_large_star(e, few), few), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if last is not None and tuple(now) == last:
            break
        last = tuple(now)
        if not now[0]:
            break
    members = e.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    roots = e.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return members.union(roots)
