"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is one or two aggregations over the edges and a join of the edges with them. Aggregates are combined before
the shuffle, and in the joins the edges of a hub are dealt over several tasks, so no node is gathered in one. Every
round is written to the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.hot import HOT_ROWS, join_hot
from graphloom.plans.lineage import cut, drop


def _large_star(edges: DataFrame, rows: int, hot: int) -> DataFrame:
    """Every neighbour larger than a node is linked to the smallest of the node and its neighbours."""
    arcs = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = arcs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n"))
    linked = _with_least(arcs.where("b > a"), least, "a", 2 * rows, hot)
    return linked.select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(edges: DataFrame, rows: int, hot: int) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n"))
    moved = _with_least(edges, least, "b", rows, hot).select(F.col("m").alias("x"), F.col("a").alias("y"))
    kept = least.select(F.col("m").alias("x"), F.col("b").alias("y"))
    return moved.union(kept).where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def _with_least(arcs: DataFrame, least: DataFrame, key: str, rows: int, hot: int) -> DataFrame:
    if rows <= hot:  # no key can be hot
        return arcs.join(least.drop("n"), key)
    return join_hot(arcs, cut(least, "least"), [key], hot=hot)


def connected_components(edges: DataFrame, max_rounds: int = 50, hot: int = HOT_ROWS) -> DataFrame:
    """(a, b) edges of one orderable type to (node, component): the smallest node reachable, per node with an edge.

    Nulls and self-loops are ignored, repeated and reversed edges change nothing, an empty input gives no rows. Nodes
    with more than ``hot`` edges are dealt over several tasks.
    """
    current = cut(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc"
    )
    state, rows = None, current.count()
    for _ in range(max_rounds):
        middle = cut(_large_star(current, rows, hot), "cc")
        following = cut(_small_star(middle, rows, hot), "cc")
        drop(middle)
        row = following.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
        ).first()
        drop(current)
        current, rows = following, row.n
        if state == tuple(row):
            break
        state = tuple(row)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = current.select(F.col("b").alias("node"), F.col("a").alias("component"))
    roots = current.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return stars.union(roots)
