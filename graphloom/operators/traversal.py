"""Traversals: breadth first as joins level by level, depth first as one task per start."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.lineage import cut, drop
from graphloom.sources.graph import PropertyGraph


def bfs(graph: PropertyGraph, starts: DataFrame, max_depth: int | None = None, direction: str = "out") -> DataFrame:
    """(start, node, depth, parent) for every start at once; parent is the smallest predecessor of the level before.

    ``starts`` is (id); starts that are no nodes give no rows. Order within a start: depth, then node. Where arcs go
    both ways a step can only lead back to the last two levels, so only they are looked at; else all levels are.
    """
    arcs = cut(graph.neighbours(direction), "arcs")
    known = starts.select("id").distinct().join(graph.nodes.select("id"), "id", "left_semi")
    level = known.select(
        F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")
    )
    level = cut(level, "level")
    out, recent, depth = level, level.select("start", "node"), 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = level.select("start", F.col("node").alias("src")).join(arcs, "src")
        step = step.groupBy("start", "dst").agg(F.min("src").alias("parent")).withColumnRenamed("dst", "node")
        seen = out.select("start", "node") if graph.directed else recent
        fresh = step.join(seen, ["start", "node"], "left_anti")
        following = cut(fresh.select("start", "node", F.lit(depth).alias("depth"), "parent"), "level")
        if following.limit(1).count() == 0:
            break
        recent = level.select("start", "node").union(following.select("start", "node"))
        out, level = out.union(following), following
    return out


#: Starts of a block of ``bfs_masks``, a bit each.
WORD = 64


def bfs_masks(graph: PropertyGraph, starts: DataFrame, max_depth: int | None = None, direction: str = "out") -> DataFrame:
    """(block, node, depth, mask) of many searches at once: the bits of the starts that first reach node at depth.

    ``starts`` is (id, k), numbered from 0: start k is bit k % 64 of block k / 64. A level joins the arcs with the nodes
    that any start of a block has just reached and ORs their masks, so it costs arcs x blocks, not arcs x starts.
    """
    arcs = cut(graph.neighbours(direction).select("src", "dst"), "arcs")
    known = starts.join(graph.nodes.select("id"), "id", "left_semi")
    bits = known.select(F.floor(F.col("k") / WORD).cast("long").alias("block"), F.col("id").alias("node"), F.expr(f"shiftleft(1L, cast(k % {WORD} as int))").alias("mask"))
    fresh = cut(bits.groupBy("block", "node").agg(F.bit_or("mask").alias("mask")), "fresh")
    seen, out, depth = fresh, fresh.withColumn("depth", F.lit(0)), 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = fresh.join(arcs, F.col("node") == F.col("src")).groupBy("block", F.col("dst").alias("to")).agg(F.bit_or("mask").alias("come"))
        step = step.withColumnRenamed("to", "node").join(seen.select("block", "node", F.col("mask").alias("had")), ["block", "node"], "left")
        new = F.col("come").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long"))))
        fresh = cut(step.select("block", "node", new.alias("mask")).where("mask <> 0"), "fresh")
        if fresh.limit(1).count() == 0:
            break
        out = out.unionByName(fresh.withColumn("depth", F.lit(depth)))
        following = cut(seen.select("block", "node", "mask").union(fresh).groupBy("block", "node").agg(F.bit_or("mask").alias("mask")), "masks")
        if depth > 1:
            drop(seen)
        seen = following
    return out.select("block", "node", "depth", "mask")


def bfs_levels(graph: PropertyGraph, start: str) -> DataFrame:
    """(id, level) for every node, -1 where unreachable; an unknown start is an error."""
    first = graph.nodes.where(F.col("id") == start).select("id")
    if first.limit(1).count() == 0:
        raise ValueError(f"unknown start {start}")
    found = bfs(graph, first).select(F.col("node").alias("id"), "depth")
    return graph.nodes.select("id").join(found, "id", "left").select("id", F.coalesce("depth", F.lit(-1)).alias("level"))


def bfs_summary(graph: PropertyGraph, start: str) -> DataFrame:
    """One row: depth (levels, the start's included) and nodes_reached."""
    found = bfs_levels(graph, start).where("level >= 0")
    return found.agg((F.max("level") + 1).alias("depth"), F.count("*").alias("nodes_reached"))


def dfs(graph: PropertyGraph, starts: DataFrame) -> DataFrame:
    """(start, step, node, depth, parent): pre-order with neighbours ascending; depth and parent as of the push.

    Depth-first order is sequential, so each start is one task over the part of the graph that it reaches.
    """
    reach = bfs(graph, starts).select("start", "node")
    arcs = graph.arcs.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("near"))
    local = reach.join(arcs, F.col("node") == F.col("src"), "left").select("start", "node", "near")

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        near = {n: list(x) if x is not None else [] for n, x in zip(group["node"], group["near"], strict=True)}
        start = group["start"].iloc[0]
        stack, seen, out = [(start, 0, None)], set(), []
        while stack:
            node, depth, parent = stack.pop()
            if node in seen:
                continue
            seen.add(node)
            out.append((start, len(out), node, depth, parent))
            stack += [(n, depth + 1, node) for n in reversed(near[node]) if n not in seen]
        return pd.DataFrame(out, columns=["start", "step", "node", "depth", "parent"])

    return local.groupBy("start").applyInPandas(walk, "start string, step int, node string, depth int, parent string")


def ego_network(graph: PropertyGraph, centre: str, hops: int = 1) -> PropertyGraph:
    """The nodes within ``hops`` out-steps and all edges among them; unknown centre or negative hops are errors."""
    if hops < 0:
        raise ValueError("hops is negative")
    first = graph.nodes.where(F.col("id") == centre).select("id")
    if first.limit(1).count() == 0:
        raise ValueError(f"unknown centre {centre}")
    from graphloom.operators.extract import induced

    return induced(graph, bfs(graph, first, hops).select(F.col("node").alias("id")))


def k_hop(graph: PropertyGraph, seeds: DataFrame, k: int = 2) -> tuple[DataFrame, DataFrame]:
    """Paths between seeds that meet within ``k`` levels, and the visited nodes.

    ``seeds`` is (pos, id). Every node belongs to the seed that reaches it first, ties to the lowest pos, and a later
    arrival collides with it: one path per unordered pair of seeds, the shortest, ties to the smallest meeting node.
    """
    known = cut(seeds.select("pos", "id").join(graph.nodes.select("id"), "id", "left_semi"), "seeds")
    found = cut(bfs(graph, known, k), "khop").join(known.withColumnRenamed("id", "start"), "start")
    visited = cut(found.select("pos", "start", "node", "depth", "parent"), "visited")
    own = visited.groupBy("node").agg(F.min(F.struct("depth", "pos")).alias("o")).select("node", "o.depth", "o.pos")
    a = own.select("node", F.col("pos").alias("a"), F.col("depth").alias("da"))
    b = visited.select("node", F.col("pos").alias("b"), F.col("depth").alias("db"))
    met = a.join(b, "node").where("a <> b").select(
        F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), (F.col("da") + F.col("db")).alias("length"), "node"
    )
    best = met.groupBy("x", "y").agg(F.min(F.struct("length", "node")).alias("m")).select("x", "y", "m.length", "m.node")
    left = _back(best.select("x", "y", "node", F.col("x").alias("pos")), visited, k)
    right = _back(best.select("x", "y", "node", F.col("y").alias("pos")), visited, k)
    right = right.select("x", "y", F.reverse("chain").alias("tail"))
    joined = best.join(left, ["x", "y"]).join(right, ["x", "y"])
    nodes = F.concat("chain", F.slice("tail", F.lit(2), F.size("tail")))
    paths = joined.select(F.col("x").alias("from_pos"), F.col("y").alias("to_pos"), nodes.alias("nodes"))
    return paths, visited.select("pos", "node", "depth")


def _back(ends: DataFrame, visited: DataFrame, k: int) -> DataFrame:
    """(x, y, chain): from the seed ``pos`` to ``node`` along parents."""
    chain = ends.select("x", "y", "pos", F.col("node").alias("at"), F.array("node").alias("chain"))
    parents = visited.select("pos", F.col("node").alias("at"), "parent")
    for _ in range(k):
        joined = chain.join(parents, ["pos", "at"], "left")
        longer = F.when(F.col("parent").isNull(), F.col("chain")).otherwise(F.concat(F.array("parent"), "chain"))
        chain = joined.select("x", "y", "pos", F.coalesce("parent", "at").alias("at"), longer.alias("chain"))
    return chain.select("x", "y", "chain")
