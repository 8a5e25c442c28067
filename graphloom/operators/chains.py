"""Absorbing chains over joins: expected steps of random walks to many targets at once.

For a target v the times h of all other nodes solve (I - P) h = 1, with P the walk's steps among them. The system is not
symmetric; it is solved by the stabilised biconjugate gradient method (van der Vorst, 1992). All targets share every
step: a row is (target, node), a product with P is a join with the arcs and a sum, the method's numbers are sums per
target. Targets that have converged leave. A step costs (open targets) x (arcs of their parts) rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.traversal import bfs
from graphloom.plans.lineage import cut, drop
from graphloom.sources.graph import PropertyGraph

#: Steps after which the method starts anew from what it has.
RESTART = 60


def certain(graph: PropertyGraph, targets: DataFrame) -> DataFrame:
    """(v, node): nodes whose walks end for certain, in v or where there is no way on, for each of ``targets`` (id).

    A walk that can get where neither is in reach may never end; its nodes are left out, and so are those before them.
    """
    arcs = cut(graph.arcs.select("src", "dst").distinct(), "arcs")
    targets = cut(targets.select("id").distinct().join(graph.nodes.select("id"), "id", "left_semi"), "targets")
    reach = bfs(graph, targets, direction="in").select(F.col("start").alias("v"), "node")
    if not graph.directed:
        alone = graph.nodes.select(F.col("id").alias("node")).join(arcs, F.col("node") == F.col("src"), "left_anti")
        # a node without neighbours is where there is no way on, for any target
        return cut(reach.union(targets.select(F.col("id").alias("v")).crossJoin(alone)).distinct().where("v <> node"), "certain")
    sinks = graph.nodes.select("id").join(arcs, F.col("id") == F.col("src"), "left_anti")
    level = cut(sinks.select(F.col("id").alias("node")), "sinks")
    ends = level
    while level.limit(1).count():
        before = level.join(arcs, F.col("node") == F.col("dst")).select(F.col("src").alias("node")).distinct()
        level = cut(before.join(ends, "node", "left_anti"), "ends")
        ends = cut(ends.union(level), "ends")
    both = reach.union(targets.select(F.col("id").alias("v")).crossJoin(ends)).distinct()
    rows = cut(both.where("v <> node"), "certain")
    while True:
        inside = rows.select("v", F.col("node").alias("dst")).union(targets.select(F.col("id").alias("v"), F.col("id").alias("dst")))
        steps = rows.join(arcs, F.col("node") == F.col("src")).select("v", "node", "dst")
        lost = cut(steps.join(inside, ["v", "dst"], "left_anti").select("v", "node").distinct(), "lost")
        if lost.limit(1).count() == 0:
            return rows
        following = cut(rows.join(lost, ["v", "node"], "left_anti"), "certain")
        drop(rows)
        rows = following


def absorption(graph: PropertyGraph, targets: DataFrame, tolerance: float = 1e-9, iterations: int = 300) -> DataFrame:
    """(v, node, h): expected steps from node until v, or until there is no way on, for all nodes in ``certain``.

    Steps end where the residual's norm is ``tolerance`` times that of the right-hand side.
    """
    graph = graph.settled()
    rows = certain(graph, targets)
    out = graph.arcs.groupBy("src").agg(F.count("*").alias("d"))
    share = graph.arcs.select("src", "dst").join(out, "src").select("src", "dst", (1.0 / F.col("d")).alias("w"))
    share = cut(share.repartition("dst"), "share")
    key, zero = ["v", "node"], F.lit(0.0)

    def less_walked(state: DataFrame, name: str, made: str) -> DataFrame:
        """``state`` with ``made``: the column ``name`` times I - P."""
        given = state.select("v", F.col("node").alias("dst"), F.col(name).alias("z"))
        sums = given.join(share, "dst").groupBy("v", F.col("src").alias("node")).agg(F.sum(F.col("z") * F.col("w")).alias("come"))
        return state.join(sums, key, "left").withColumn(made, F.col(name) - F.coalesce("come", zero)).drop("come")

    state = rows.select(*key, zero.alias("x"), *(F.lit(1.0).alias(c) for c in ("r", "shadow", "p")))
    state, done = cut(state, "state"), []
    for step in range(1, iterations + 1):
        first = cut(less_walked(state, "p", "q"), "first")
        sums = first.groupBy("v").agg(F.sum(F.col("shadow") * F.col("r")).alias("rho"), F.sum(F.col("shadow") * F.col("q")).alias("sq"))
        alpha = F.coalesce(F.try_divide("rho", "sq"), zero)
        half = first.join(sums.select("v", "rho", alpha.alias("alpha")), "v").withColumn("s", F.col("r") - F.col("alpha") * F.col("q"))
        second = cut(less_walked(half, "s", "t"), "second")
        sums = second.groupBy("v").agg(F.sum(F.col("t") * F.col("s")).alias("ts"), F.sum(F.col("t") * F.col("t")).alias("tt"))
        omega = F.coalesce(F.try_divide("ts", "tt"), zero)
        third = second.join(sums.select("v", omega.alias("omega")), "v").select(
            *key, (F.col("x") + F.col("alpha") * F.col("p") + F.col("omega") * F.col("s")).alias("x"),
            (F.col("s") - F.col("omega") * F.col("t")).alias("r"), "shadow", "p", "q", "rho", "alpha", "omega",
        )
        third = cut(third, "third")
        sums = third.groupBy("v").agg(
            F.sum(F.col("shadow") * F.col("r")).alias("new"), F.sum(F.col("r") * F.col("r")).alias("rr"), F.count("*").alias("n")
        )
        known = third.join(sums, "v")
        settled = F.col("rr") <= tolerance * tolerance * F.col("n")
        done.append(cut(known.where(settled).select(*key, F.col("x").alias("h")), "done"))
        beta = F.coalesce(F.try_divide(F.col("new") * F.col("alpha"), F.col("rho") * F.col("omega")), zero)
        new_p = F.col("r") + beta * (F.col("p") - F.col("omega") * F.col("q"))
        anew = F.lit(step % RESTART == 0) | (F.col("omega") == 0) | (F.abs("new") < 1e-30)
        following = known.where(~settled).select(
            *key, "x", "r", F.when(anew, F.col("r")).otherwise(F.col("shadow")).alias("shadow"), F.when(anew, F.col("r")).otherwise(new_p).alias("p")
        )
        following = cut(following, "state")
        for old in (state, first, second, third):
            drop(old)
        state = following
        if state.limit(1).count() == 0:
            break
    else:
        done.append(state.select(*key, F.col("x").alias("h")))
    found = done[0]
    for part in done[1:]:
        found = found.union(part)
    return cut(found, "absorption")
