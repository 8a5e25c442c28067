"""Orders in which explorations without a limit visit everything in reach, for many seeds at once.

A seed's order is that of best-first search, which takes one node after the other. Here a round takes all candidates
that are certain to come next, seed by seed: sorted by value, those up to the first that would be overtaken by a
neighbour nobody has seen yet. The bound of a round is an aggregation: with low(c) the least value of c's unseen
neighbours and U the least of max(value(c), low(c)), candidates below U come next, and of those at U the ones up to
the first whose own low is below it. Once all nodes in reach are seen, the rest is one round.

Candidates keep their arcs to unseen nodes (the fringe), so an arc is looked at once per seed and dropped when its end
is seen; no round reads all arcs or all visits again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators.traversal import dfs
from graphloom.plans.hot import HOT_ROWS
from graphloom.plans.lineage import cut, drop
from graphloom.plans.numbering import numbered
from graphloom.sources.graph import PropertyGraph

#: Priorities by the age of a candidate: oldest first, or newest first.
BY_AGE = ("standard_bfs", "round_robin", "frontier_balanced", "dfs_priority")
#: Rounds whose written tables of seen nodes are merged into one.
MERGED = 16


class _Seen:
    """Nodes that each seed has seen, as tables written round by round and merged now and then."""

    def __init__(self, first: DataFrame) -> None:
        self.parts, self.merged = [first], None

    def add(self, rows: DataFrame) -> None:
        self.parts.append(rows)
        if len(self.parts) > MERGED:
            whole = cut(self.rows, "seen")
            if self.merged is not None:
                drop(self.merged)
            self.parts, self.merged = [whole], whole

    @property
    def rows(self) -> DataFrame:
        out = self.parts[0]
        for p in self.parts[1:]:
            out = out.union(p)
        return out


def placed(rows: DataFrame, groups: list[str], order: list[str], most: int | None = None, hot: int = HOT_ROWS) -> DataFrame:
    """``rows`` with k: 0, 1, 2, … in ``order`` inside each group; tables that may be large are ranked by ranges.

    ``most`` is a bound of their number; without one they are counted and should be a written table.
    """
    if (rows.count() if most is None else most) <= hot:
        return rows.withColumn("k", F.row_number().over(W.partitionBy(*groups).orderBy(*order)).cast("long") - 1)
    keyed = rows.withColumn("id", F.struct(*order))
    return numbered(keyed, *groups).drop("id")


def by_value(arcs: DataFrame, starts: DataFrame, value: DataFrame) -> DataFrame:
    """(seed, node, parent, i, top): the best-first order of each of ``starts`` (seed) by ``value`` (node, p), lower first.

    Ties go to the candidate that was found first, then to the smaller node. top is the largest value taken so far,
    parent the node that found it. Starts without a value are not visited.
    """
    arcs = cut(arcs.where("src <> dst").join(value.withColumnsRenamed({"node": "dst", "p": "pu"}), "dst").select("src", "dst", "pu"), "arcs")
    first = starts.select("seed", F.col("seed").alias("node")).join(value, "node")
    queue = first.select("seed", "node", "p", F.lit(0).cast("long").alias("born"), F.lit(None).cast("string").alias("parent"))
    queue = cut(queue, "queue")
    seen = _Seen(queue.select("seed", "node"))
    found_by = lambda rows: rows.join(arcs, F.col("node") == F.col("src")).select("seed", F.col("node").alias("c"), F.col("dst").alias("u"), "pu")
    fringe = cut(found_by(queue), "fringe")
    done, out, most = None, [], queue.count() * value.count()
    while True:
        low = fringe.groupBy("seed", F.col("c").alias("node")).agg(F.min("pu").alias("low"))
        known = queue.join(low, ["seed", "node"], "left").withColumn("low", F.coalesce("low", F.lit(float("inf"))))
        bound = known.groupBy("seed").agg(F.min(F.greatest("p", "low")).alias("bound"))
        known = known.join(bound, "seed")
        key = F.struct("born", "node")
        breaks = known.where("p = bound and low < p").groupBy("seed").agg(F.min(key).alias("breaks"))
        sure = (F.col("p") < F.col("bound")) | ((F.col("p") == F.col("bound")) & (F.col("breaks").isNull() | (key <= F.col("breaks"))))
        batch = known.join(breaks, "seed", "left").where(sure).select("seed", "node", "p", "born", "parent")
        taken = placed(batch, ["seed"], ["p", "born", "node"], most)
        if done is None:
            taken = taken.withColumns({"i": F.col("k"), "top": F.col("p")})
        else:
            ends = done.groupBy("seed").agg((F.max("i") + 1).alias("from"), F.max("top").alias("above"))
            taken = taken.join(ends, "seed").withColumns({"i": F.col("k") + F.col("from"), "top": F.greatest("p", "above")})
        done = cut(taken.select("seed", "node", "parent", "i", "top"), "order")
        if done.limit(1).count() == 0:
            break
        out.append(done)
        hit = fringe.join(done.select("seed", F.col("node").alias("c"), "i"), ["seed", "c"])
        pushed = hit.groupBy("seed", F.col("u").alias("node")).agg(F.min("pu").alias("p"), F.min(F.struct("i", "c")).alias("m"))
        pushed = cut(pushed.select("seed", "node", "p", F.col("m.i").alias("born"), F.col("m.c").alias("parent")), "pushed")
        seen.add(pushed.select("seed", "node"))
        rest = queue.join(done.select("seed", "node"), ["seed", "node"], "left_anti").select(queue.columns)
        following = cut(rest.union(pushed), "queue")
        gone, new = done.select("seed", F.col("node").alias("c")), pushed.select("seed", F.col("node").alias("u"))
        kept = fringe.join(gone, ["seed", "c"], "left_anti").join(new, ["seed", "u"], "left_anti").select(fringe.columns)
        fresh = found_by(pushed).join(seen.rows.withColumnRenamed("node", "u"), ["seed", "u"], "left_anti").select(fringe.columns)
        beyond = cut(kept.union(fresh), "fringe")
        for old in (queue if len(out) > 1 else None, fringe):
            if old is not None:
                drop(old)
        queue, fringe = following, beyond
    return _joined(out, queue.select("seed", "node", "parent", F.col("born").alias("i"), F.col("p").alias("top")))


def _joined(parts: list[DataFrame], none: DataFrame) -> DataFrame:
    out = none
    for p in parts:
        out = out.unionByName(p)
    return cut(out, "orders")


def by_age(graph: PropertyGraph, arcs: DataFrame, starts: DataFrame, depth_first: bool = False) -> DataFrame:
    """(seed, node, parent, i, top, level): oldest candidates first, a level a round; or newest first.

    Newest first is depth-first order with neighbours ascending, which ``traversal.dfs`` gives; there level is 0.
    """
    alone = starts.select("seed", F.col("seed").alias("node"), F.lit(None).cast("string").alias("parent"))
    zero = F.lit(0).cast("long")
    if depth_first:
        found = dfs(graph, starts.withColumnRenamed("seed", "id"))
        found = cut(found.select(F.col("start").alias("seed"), "node", "parent", F.col("step").cast("long").alias("i")), "dfs")
        alone = alone.join(found.select("seed").distinct(), "seed", "left_anti").withColumn("i", zero)
        return found.unionByName(alone).withColumns({"top": F.lit(0.0), "level": zero})
    level = cut(alone.withColumns({"i": zero, "level": zero}), "level")
    seen, out = _Seen(level.select("seed", "node")), [level]
    while True:
        step = level.join(arcs, F.col("node") == F.col("src")).groupBy("seed", F.col("dst").alias("to")).agg(F.min(F.struct("i", "node")).alias("m"))
        step = step.select("seed", F.col("to").alias("node"), F.col("m.node").alias("parent"), F.col("m.i").alias("born"))
        fresh = cut(step.join(seen.rows, ["seed", "node"], "left_anti"), "fresh")
        if fresh.limit(1).count() == 0:
            return _joined(out, level.limit(0)).withColumn("top", F.lit(0.0))
        ends = level.groupBy("seed").agg((F.max("i") + 1).alias("from"))
        number = placed(fresh, ["seed"], ["born", "node"]).join(ends, "seed")
        level = cut(number.select("seed", "node", "parent", (F.col("k") + F.col("from")).alias("i"), F.lit(len(out)).cast("long").alias("level")), "level")
        seen.add(level.select("seed", "node"))
        out.append(level)
        drop(fresh)


def with_chains(found: DataFrame) -> DataFrame:
    """``found`` (seed, node, parent, …) with chain: the nodes from the seed to it, by pointer doubling."""
    rows = cut(found.select("seed", "node", F.col("parent").alias("up"), F.array("node").alias("chain")), "chains")
    while rows.where("up is not null").limit(1).count():
        above = rows.select("seed", F.col("node").alias("up"), F.col("up").alias("higher"), F.col("chain").alias("head"))
        longer = rows.join(above, ["seed", "up"], "left")
        chain = F.concat(F.coalesce("head", F.array().cast("array<string>")), "chain")
        following = cut(longer.select("seed", "node", F.col("higher").alias("up"), chain.alias("chain")), "chains")
        drop(rows)
        rows = following
    return found.join(rows.select("seed", "node", "chain"), ["seed", "node"])


def turns(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` of seed sets with turn: 1, 2, … in ``order`` inside each set."""
    ranked = placed(cut(rows, "merged"), ["seed_set_id"], order)
    return ranked.withColumn("turn", F.col("k") + 1).drop("k")


def levelled(rows: DataFrame) -> DataFrame:
    """``rows`` of seed sets with turn where the oldest candidate of all frontiers is first: level by level, by the
    turn of the node that found it, then by node."""
    rows = cut(rows, "merged")
    depth = rows.agg(F.max("level")).first()[0]
    if depth is None:
        return rows.withColumn("turn", F.lit(0).cast("long"))
    out, above = [], None
    for i in range(depth + 1):
        level = rows.where(F.col("level") == i)
        if above is None:
            level = level.withColumns({"before": F.lit(0).cast("long"), "from": F.lit(0).cast("long")})
            order = ["f"]
        else:
            ends = above.groupBy("seed_set_id").agg(F.max("turn").alias("from"))
            by = above.select("seed_set_id", "f", F.col("node").alias("parent"), F.col("turn").alias("before"))
            level = level.join(by, ["seed_set_id", "f", "parent"]).join(ends, "seed_set_id")
            order = ["before", "node"]
        ranked = placed(cut(level, "before"), ["seed_set_id"], order)
        above = cut(ranked.withColumn("turn", F.col("k") + 1 + F.col("from")).select(*rows.columns, "turn"), "turns")
        out.append(above)
    return _joined(out, above.limit(0))
