"""Connected components over a distributed edge table (alternating large-star and small-star rounds).

Edges are first reduced to spanning forests inside each partition; the rounds then run as aggregates and joins on at most
one edge per node and partition. Minima are taken by ``groupBy`` (partial aggregation before the shuffle), never by
gathering the neighbours of a node, and edges of the few nodes with a good part of all edges meet their minima by a broadcast
of bounded size (``join_unique``), so a node with a third of all edges is no hot task.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Links, join_unique, written

EDGES = "src long, dst long"


def _local_forest(batches):
    links = Links()
    for batch in batches:
        links.add(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False))
    src, dst = links.edges()
    yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])


def local_forests(edges: DataFrame) -> DataFrame:
    """Replace each partition's edges by star edges (node, smallest node) of its local components."""
    return edges.filter("src <> dst").mapInArrow(_local_forest, EDGES)


def _with_least(edges: DataFrame, total: int, own: bool) -> DataFrame:
    """Edges with ``low``: the smallest neighbour of src (``own``: or src itself, if that is smaller)."""
    least = edges.groupBy("src").agg(F.min("dst").alias("low"), F.count("*").alias("degree"))
    if own:
        least = least.withColumn("low", F.least("src", "low"))
    return join_unique(edges, least, "src", "degree", total)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return _with_least(both, 2 * total, True).filter("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Of edges that all lead to smaller nodes."""
    found = _with_least(edges, total, False)
    return found.select(F.col("dst").alias("src"), F.col("low").alias("dst")).filter("src <> dst").union(edges.groupBy("src").agg(F.min("dst").alias("dst")))


def _stars(edges: DataFrame) -> bool:
    """Whether the edges are a forest of stars: every child has one edge, and none has children itself."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up + down > 1").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node long, component long) for every node with an edge; component is the smallest node reachable.

    ``edges`` has long columns src and dst (loops and repeats allowed, either order, no nulls). Rounds end when only stars are
    left, whose centres are the smallest nodes; their number grows with the logarithm of the longest chain.
    """
    now = written(local_forests(edges), "edges")
    while not _stars(now):
        large = written(_large_star(now, now.count()).distinct(), "edges")
        now = written(_small_star(large, large.count()).distinct(), "edges")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
