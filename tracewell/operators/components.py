"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.storage import apart, store

#: A node with more edges is a hub; with so many edges in all that hubs could exceed MOST_HUBS rows, the bound rises.
HUB_EDGES, MOST_HUBS = 1000, 1_000_000


def _with_least(edges: DataFrame, n_edges: int) -> DataFrame:
    """edges with m, the smallest of u and its neighbours.

    The edges of a hub never meet in one task: its minimum is broadcast to where they lie. There are at most
    n_edges / HUB_EDGES hubs, and never more than MOST_HUBS.
    """
    low = store(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"), "n"), "least")
    bound = max(HUB_EDGES, n_edges // MOST_HUBS)
    hubs = low.where(F.col("n") > bound)
    if hubs.isEmpty():
        return edges.join(apart(low), F.col("u") == F.col("w")).select("u", "v", "m")
    hub = F.broadcast(hubs.drop("n"))
    plain = edges.join(F.broadcast(hubs.select("w")), F.col("u") == F.col("w"), "left_anti").join(apart(low.where(F.col("n") <= bound)), F.col("u") == F.col("w"))
    return plain.select("u", "v", "m").union(edges.join(hub, F.col("u") == F.col("w")).select("u", "v", "m"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, v) in any direction -> (node, root) with the smallest node as root, for the nodes that have an edge. A node's neighbours are only ever reduced to their minimum."""
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    e, seen = store(edges.select("u", "v").where("u <> v").distinct(), "edges"), None
    n = e.count()
    for _ in range(most_rounds):
        large = _with_least(e.union(e.select("v", "u")), 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = store(large.where("u <> v").distinct(), "large-star")
        small = _with_least(large, n)  # v < u throughout, so m is the smallest neighbour
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        e = store(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "small-star")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            roots = e.select(F.col("u").alias("r_node"), F.col("v").alias("root"))
            return nodes.join(apart(roots), F.col("node") == F.col("r_node"), "left").select("node", F.coalesce("root", "node").alias("root"))
        seen, n = now, now[0]
    raise RuntimeError("components did not settle")
