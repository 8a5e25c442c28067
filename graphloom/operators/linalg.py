"""Linear algebra over arcs, and fix-points as driver loops whose rounds are written tables."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.lineage import cut, drop
from graphloom.sources.graph import PropertyGraph

#: Rounds of a loop that share one plan before it is written.
ROUNDS_PER_CUT = 3


def spmv(graph: PropertyGraph, x: DataFrame) -> DataFrame:
    """(id, y): y = A x over out-arcs with their weights (1 where missing); x is (id, x)."""
    terms = graph.arcs.join(x.withColumnRenamed("id", "dst"), "dst")
    sums = terms.groupBy("src").agg(F.sum(F.coalesce("weight", F.lit(1.0)) * F.col("x")).alias("y"))
    joined = graph.nodes.select("id").join(sums, F.col("id") == F.col("src"), "left")
    return joined.select("id", F.coalesce("y", F.lit(0.0)).alias("y"))


def pagerank(
    graph: PropertyGraph,
    iterations: int = 100,
    damping: float = 0.85,
    tolerance: float | None = 1e-6,
    norm: str = "max",
) -> DataFrame:
    """(id, rank) by power iteration; ranks of nodes without out-arcs are not handed on.

    Stops early where the change (largest, or `l1` sum) falls below ``tolerance``; None always takes all iterations.
    """
    graph = graph.settled()
    n = graph.nodes.count()
    if not n:
        return graph.nodes.select("id", F.lit(0.0).alias("rank"))
    out = graph.arcs.groupBy("src").agg(F.count("*").alias("d"))
    share = cut(graph.arcs.select("src", "dst").join(out, "src").select("src", "dst", (1.0 / F.col("d")).alias("p")), "share")
    # dealt by src once, so that a round exchanges ranks and sums but not the arcs; lost parts are made again from the table
    share = share.repartition("src").persist(StorageLevel.DISK_ONLY)
    base = graph.nodes.select("id")
    ranks, written = base.withColumn("rank", F.lit(1.0 / n)), None
    for i in range(1, iterations + 1):
        given = share.join(ranks.withColumnRenamed("id", "src"), "src")
        sums = given.groupBy("dst").agg(F.sum(F.col("rank") * F.col("p")).alias("s"))
        following = ranks.select("id", F.col("rank").alias("old")).join(sums, F.col("id") == F.col("dst"), "left")
        value = (1 - damping) / n + damping * F.coalesce("s", F.lit(0.0))
        following = following.select("id", value.alias("rank"), F.abs(value - F.col("old")).alias("change"))
        if tolerance is not None or i % ROUNDS_PER_CUT == 0:
            following = cut(following, "ranks")
            if written is not None:
                drop(written)
            written = following
        if tolerance is not None:
            change = following.agg((F.sum if norm == "l1" else F.max)("change")).first()[0]
            if change < tolerance:
                ranks = following.select("id", "rank")
                break
        ranks = following.select("id", "rank")
    ranks = cut(ranks, "ranks")
    share.unpersist()
    return ranks


def _walks(graph: PropertyGraph, pairs: DataFrame, weights: list[float], start: float) -> DataFrame:
    """(u, v, score): start·[u = v] + sum over l of weights[l-1] × walks of length l from u to v.

    Walk counts are pushed from the side of the pairs that has fewer different nodes, all of them together, one join
    and aggregation a step. They are unscaled doubles, and a node's counts live on the nodes within its reach only: at
    most (nodes of that side) × (nodes of the graph) rows. The last step goes no further than to asked pairs.
    """
    graph = graph.settled()
    pairs = cut(pairs.select("u", "v").distinct(), "pairs")
    sides = pairs.agg(F.countDistinct("u"), F.countDistinct("v")).first()
    home, far = ("v", "u") if sides[1] <= sides[0] else ("u", "v")
    arcs = graph.arcs.select("src", "dst") if home == "v" else graph.arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    reach = pairs.select(F.col(home).alias("target"), F.col(home).alias("at")).distinct().withColumn("c", F.lit(1.0))
    score = pairs.withColumn("s", F.when(F.col("u") == F.col("v"), start).otherwise(0.0)) if start else None
    parts = [score.select("u", "v", "s")] if score is not None else []
    asked = pairs.select(F.col(home).alias("target"), F.col(far).alias("at"))
    for step, weight in enumerate(weights, 1):
        moved = reach.join(arcs, reach["at"] == arcs["dst"]).select("target", F.col("src").alias("at"), "c")
        if step == len(weights):
            moved = moved.join(asked, ["target", "at"], "left_semi")
        reach = cut(moved.groupBy("target", "at").agg(F.sum("c").alias("c")), "walks")
        hit = pairs.join(reach, (F.col(home) == F.col("target")) & (F.col(far) == F.col("at")))
        parts.append(hit.select("u", "v", (F.col("c") * weight).alias("s")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    sums = out.groupBy("u", "v").agg(F.sum("s").alias("score"))
    return pairs.join(sums, ["u", "v"], "left").select("u", "v", F.coalesce("score", F.lit(0.0)).alias("score"))


def katz(graph: PropertyGraph, pairs: DataFrame, beta: float = 0.005, length: int = 5) -> DataFrame:
    return _walks(graph, pairs, [beta**k for k in range(1, length + 1)], 0.0)


def communicability(graph: PropertyGraph, pairs: DataFrame, length: int = 15) -> DataFrame:
    import math

    return _walks(graph, pairs, [1 / math.factorial(k) for k in range(1, length + 1)], 1.0)


#: Sources whose levels are kept at once by ``betweenness``.
SOURCES = 512


def betweenness(graph: PropertyGraph, sources: DataFrame | None = None, compat: bool = False, block: int = SOURCES) -> DataFrame:
    """(id, betweenness): Brandes over all ordered source-target pairs, unnormalised, level by level.

    ``sources`` (id) restricts the sources. Without it, trees that hang on an undirected graph are folded first: what
    they add is a closed form, and the nodes that are left carry the number folded into them as their weight. Sources
    go in blocks of about ``block``, whose levels are deleted after each: at most block x nodes rows are kept.
    ``compat`` gives the zeros of the surveyed implementation.
    """
    if compat:
        return graph.nodes.select("id", F.lit(0.0).alias("betweenness"))
    graph = graph.settled()
    ids = graph.nodes.select("id")
    arcs = cut(graph.arcs.select("src", "dst").where("src <> dst").distinct(), "arcs")
    weights, total = ids.select(F.col("id").alias("node"), F.lit(1.0).alias("w")), None
    if sources is None and not graph.directed:
        arcs, weights, total = _folded(ids, arcs)
    weights = cut(weights, "weights")
    starts = weights if sources is None else weights.join(sources.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    starts = cut(starts, "starts")
    blocks = max(1, -(-starts.count() // block))
    for i in range(blocks):
        some = starts.where(F.pmod(F.xxhash64("node"), F.lit(blocks)) == i) if blocks > 1 else starts
        part = _dependencies(some, arcs, weights, both_ways=not graph.directed)
        total = part if total is None else total.union(part)
    sums = total.groupBy("node").agg(F.sum("delta").alias("b"))
    return ids.join(sums, F.col("id") == F.col("node"), "left").select("id", F.coalesce("b", F.lit(0.0)).alias("betweenness"))


def _folded(ids: DataFrame, arcs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Arcs and (node, w) without the trees that hang on the graph, and (node, delta) of the pairs with an end in them.

    A leaf of weight w, itself and what was folded into it, goes into its neighbour u, where its pairs with all nodes
    outside pass; those with leaves of the same u, of now or before, are counted once. N is the size of the component.
    """
    from graphloom.plans.components import connected_components

    home = connected_components(arcs.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    home = cut(home.join(home.groupBy("component").agg(F.count("*").alias("size")), "component").select("node", "size"), "sizes")
    weights = cut(ids.select(F.col("id").alias("node"), F.lit(1.0).alias("w")), "weights")
    gained = weights.select("node", F.lit(0.0).alias("delta")).limit(0)
    while True:
        only = arcs.groupBy("src").agg(F.count("*").alias("d"), F.first("dst").alias("dst")).where("d = 1")
        # of two that have only each other, the larger id is folded
        back = only.select(F.col("src").alias("dst"), F.lit(True).alias("mutual"))
        leaves = only.join(back, "dst", "left").where("mutual is null or src > dst").select(F.col("src").alias("leaf"), F.col("dst").alias("node"))
        leaves = cut(leaves.join(weights.select(F.col("node").alias("leaf"), F.col("w").alias("own")), "leaf"), "leaves")
        if leaves.limit(1).count() == 0:
            return arcs, weights, gained
        sums = leaves.groupBy("node").agg(F.sum("own").alias("s"), F.sum(F.col("own") * F.col("own")).alias("q"))
        sums = cut(sums.join(home, "node").join(weights, "node"), "folds")
        pairs = 2 * (F.col("s") * (F.col("size") - 1) - F.col("q")) - (F.col("s") * F.col("s") - F.col("q")) - 2 * F.col("s") * (F.col("w") - 1)
        gained = gained.union(sums.select("node", pairs.alias("delta")))
        gone = leaves.select(F.col("leaf").alias("node"))
        heavier = weights.join(gone, "node", "left_anti").join(sums.select("node", "s"), "node", "left")
        weights = cut(heavier.select("node", (F.col("w") + F.coalesce("s", F.lit(0.0))).alias("w")), "weights")
        rest = arcs.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        arcs = cut(rest.select("src", "dst"), "arcs")


def _dependencies(starts: DataFrame, arcs: DataFrame, weights: DataFrame, both_ways: bool) -> DataFrame:
    """(node, delta): what paths from ``starts`` (node, w) to all nodes add, source and target counted by their weights."""
    level = starts.select(F.col("node").alias("s"), "node", F.lit(1.0).alias("sigma"))
    level = cut(level, "level")
    levels = [level]
    while True:
        step = levels[-1].join(arcs, F.col("node") == F.col("src")).groupBy("s", "dst").agg(F.sum("sigma").alias("sigma"))
        # where arcs go both ways, a step leads back to the last two levels only
        seen = None
        for old in levels[-2:] if both_ways else levels:
            seen = old.select("s", "node") if seen is None else seen.union(old.select("s", "node"))
        fresh = cut(step.withColumnRenamed("dst", "node").join(seen, ["s", "node"], "left_anti"), "level")
        if fresh.limit(1).count() == 0:
            break
        levels.append(fresh)
    delta, parts = None, []
    for upper, lower in zip(reversed(levels[:-1]), reversed(levels[1:]), strict=True):
        below = lower.withColumn("delta", F.lit(0.0)) if delta is None else delta
        below = below.join(weights, "node").select("s", F.col("node").alias("dst"), F.col("sigma").alias("sw"), (F.col("w") + F.col("delta")).alias("dw"))
        joined = upper.join(arcs, F.col("node") == F.col("src")).join(below, ["s", "dst"])
        gain = joined.groupBy("s", "node").agg(F.sum(F.col("sigma") / F.col("sw") * F.col("dw")).alias("delta"))
        delta = upper.join(gain, ["s", "node"], "left").select("s", "node", "sigma", F.coalesce("delta", F.lit(0.0)).alias("delta"))
        delta = cut(delta, "delta")
        parts.append(delta)
    if not parts:
        return starts.select("node", F.lit(0.0).alias("delta"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    many = rows.where("s <> node").join(weights.select(F.col("node").alias("s"), "w"), "s")
    total = cut(many.groupBy("node").agg(F.sum(F.col("delta") * F.col("w")).alias("delta")), "dependencies")
    for old in [*levels, *parts]:
        drop(old)
    return total


def label_propagation(graph: PropertyGraph, iterations: int = 30) -> DataFrame:
    """(id, label): synchronous; the most frequent neighbour label, ties to the smallest; isolated nodes keep their own.

    Stops where no label changes or where labels alternate between two states (the smaller of both is taken).
    """
    graph = graph.settled()
    arcs = graph.both
    labels = cut(graph.nodes.select("id", F.col("id").alias("label"), F.col("id").alias("previous")), "labels")
    for _ in range(iterations):
        votes = arcs.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("src").agg(F.max("n").alias("most"))
        top = votes.join(best, "src").where("n = most").groupBy("src").agg(F.min("label").alias("new"))
        joined = labels.join(top, F.col("id") == F.col("src"), "left")
        following = joined.select("id", F.coalesce("new", "label").alias("label"), F.col("label").alias("previous"), F.col("previous").alias("older"))
        following = cut(following, "labels")
        drop(labels)
        state = following.agg(
            F.sum((F.col("label") != F.col("previous")).cast("long")), F.sum((F.col("label") != F.col("older")).cast("long"))
        ).first()
        path = following._cut_path
        labels = following.drop("older")
        labels._cut_path = path
        if not state[0]:
            break
        if not state[1]:
            return labels.select("id", F.least("label", "previous").alias("label"))
    return labels.select("id", "label")


__all__ = ["betweenness", "communicability", "katz", "label_propagation", "pagerank", "spmv"]
