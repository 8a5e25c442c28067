"""Resistance distance by conjugate gradients or from a sketch, and hitting times by absorbing chains or samples."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.lineage import cut, drop
from graphloom.sources.graph import PropertyGraph

#: Fixed value: the shift of the Laplacian.
SHIFT = 1e-10
WALKS, MAX_STEPS, SEED = 1000, 10_000, 42


def resistance(graph: PropertyGraph, pairs: DataFrame, tolerance: float = 1e-9, iterations: int = 500) -> DataFrame:
    """(u, v, r): the effective resistance between two nodes with every edge a unit resistor; an unknown end gives 0.

    r is what a unit current from u to v needs in potential, by the inverse of the Laplacian shifted by SHIFT. The
    currents of all pairs are solved together by conjugate gradients with the degrees as preconditioner: a step is a
    join of the potentials with the arcs and two sums per pair. Ends in different components have no current; there the
    shift decides, at (1/a + 1/b) / SHIFT for components of a and b nodes. Costs pairs × nodes rows a step; the steps
    grow with the graph's mixing, not its size.
    """
    from graphloom.plans.components import connected_components

    graph = graph.settled()
    pairs = cut(pairs.select("u", "v").distinct(), "pairs")
    arcs = cut(graph.both.where("src <> dst"), "arcs")
    found = connected_components(arcs.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    home = graph.nodes.select("id").join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("c"))
    home = cut(home.join(home.groupBy("c").agg(F.count("*").alias("n")), "c"), "home")
    ends = lambda e: home.select(F.col("id").alias(e), F.col("c").alias(f"c{e}"), F.col("n").alias(f"n{e}"))
    known = cut(pairs.join(ends("u"), "u", "left").join(ends("v"), "v", "left"), "known")
    apart = (1 / F.col("nu") + 1 / F.col("nv")) / SHIFT
    solved = _potentials(known.where("cu = cv and u <> v").select("u", "v"), arcs, tolerance, iterations)
    joined = known.join(solved, ["u", "v"], "left")
    value = F.when(F.col("cu").isNull() | F.col("cv").isNull(), 0.0).when(F.col("cu") != F.col("cv"), apart)
    return joined.select("u", "v", value.otherwise(F.greatest(F.coalesce("r", F.lit(0.0)), F.lit(SHIFT))).alias("r"))


def _potentials(pairs: DataFrame, arcs: DataFrame, tolerance: float, iterations: int) -> DataFrame:
    """(u, v, r) of connected pairs: the potential of u over v for a unit current."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1.0).alias("b")), F.struct(F.col("v").alias("node"), F.lit(-1.0).alias("b"))))
    flows = pairs.select("u", "v", ends.alias("e")).select(F.struct("u", "v").alias("key"), "e.node", "e.b")
    found = _solved(flows, arcs, tolerance, iterations).select("key.u", "key.v", "node", "x")
    sign = F.when(F.col("node") == F.col("u"), F.col("x")).otherwise(-F.col("x"))
    return found.where("node = u or node = v").groupBy("u", "v").agg(F.sum(sign).alias("r"))


def _solved(flows: DataFrame, arcs: DataFrame, tolerance: float, iterations: int) -> DataFrame:
    """(key, node, x): the potentials of each system of ``flows`` (key, node, b: what flows in at node), whose b sum to 0.

    Conjugate gradients with the degrees as preconditioner, all systems together.
    """
    degree = cut(arcs.groupBy(F.col("src").alias("node")).agg(F.count("*").cast("double").alias("d")), "degree")
    zero = F.lit(0.0)
    state = flows.select("key", "node", zero.alias("x"), F.col("b").alias("r"), zero.alias("p"), zero.alias("rz"))
    state = cut(state, "state")
    key = ["key", "node"]
    for _ in range(iterations):
        size = state.join(degree, "node").groupBy("key").agg(F.sum(F.col("r") * F.col("r") / F.col("d")).alias("now"))
        beta = F.coalesce(F.try_divide("now", "rz"), zero)
        moved = state.join(degree, "node").join(size, "key")
        moved = cut(moved.select(*key, "x", "r", "d", (F.col("r") / F.col("d") + beta * F.col("p")).alias("p"), F.col("now").alias("rz")), "step")
        most = moved.agg(F.max("rz")).first()[0]
        if most is None or most < tolerance * tolerance:
            break
        own = moved.select(*key, ((F.col("d") + SHIFT) * F.col("p")).alias("y"))
        out = moved.join(arcs, moved["node"] == arcs["src"]).select("key", F.col("dst").alias("node"), (-F.col("p")).alias("y"))
        flow = own.union(out).groupBy(*key).agg(F.sum("y").alias("y"))
        flow = cut(flow.join(moved.drop("d"), key, "left").select(*key, "y", *(F.coalesce(c, zero).alias(c) for c in ("x", "r", "p", "rz"))), "flow")
        sums = flow.groupBy("key").agg(F.max("rz").alias("top"), F.sum(F.col("p") * F.col("y")).alias("bottom"))
        alpha = F.coalesce(F.try_divide("top", "bottom"), zero)
        following = flow.join(sums, "key").select(
            *key, (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("y")).alias("r"), "p", F.col("top").alias("rz")
        )
        following = cut(following, "state")
        for old in (state, moved, flow):
            drop(old)
        state = following
    return state.select("key", "node", "x")


def sketched_resistance(
    graph: PropertyGraph, pairs: DataFrame, error: float = 0.5, refine: float = 0.0, tolerance: float = 1e-3, seed: int = SEED
) -> DataFrame:
    """(u, v, r) like ``resistance``, from a random projection (Spielman and Srivastava, 2011).

    Every edge has a current of +1 or -1 in each of k random flows, k = 4 ln(n) / error^2; with z the potentials of a
    flow, r(u, v) is the mean of (z(u) - z(v))^2, with a relative standard error of sqrt(2 / k). So there are k systems
    to solve, however many pairs are asked for. Where two pairs or more share a band of r as wide as the factor 1 + ``refine``,
    they are measured exactly. Ends in different components, unknown ends and u = v are as in ``resistance``.
    """
    from graphloom.plans.components import connected_components

    graph = graph.settled()
    pairs = cut(pairs.select("u", "v").distinct(), "pairs")
    arcs = cut(graph.both.where("src <> dst"), "arcs")
    many = max(2, math.ceil(4 * math.log(max(2, graph.nodes.count())) / error**2))
    sign = F.when(F.conv(F.substring(F.md5(F.concat_ws(" ", "src", "dst", "key", F.lit(str(seed)))), 1, 1), 16, 10).cast("int") < 8, 1.0).otherwise(-1.0)
    drawn = arcs.where("src < dst").withColumn("key", F.explode(F.sequence(F.lit(1), F.lit(many)))).withColumn("s", sign)
    flows = drawn.select("key", F.col("src").alias("node"), F.col("s").alias("b")).union(drawn.select("key", F.col("dst").alias("node"), (-F.col("s")).alias("b")))
    solved = cut(_solved(flows.groupBy("key", "node").agg(F.sum("b").alias("b")), arcs, tolerance, 500), "sketch")
    vectors = solved.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("key", "x"))).alias("z"))
    vectors = cut(vectors.select("node", F.col("z.x").alias("z")), "vectors")
    home = connected_components(arcs.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    home = graph.nodes.select("id").join(home, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("c"))
    home = cut(home.join(home.groupBy("c").agg(F.count("*").alias("n")), "c"), "home")
    ends = lambda e: home.select(F.col("id").alias(e), F.col("c").alias(f"c{e}"), F.col("n").alias(f"n{e}"))
    at = lambda e: vectors.select(F.col("node").alias(e), F.col("z").alias(f"z{e}"))
    known = pairs.join(ends("u"), "u", "left").join(ends("v"), "v", "left").join(at("u"), "u", "left").join(at("v"), "v", "left")
    square = F.aggregate(F.zip_with("zu", "zv", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) / F.lit(float(many))
    value = F.when(F.col("cu").isNull() | F.col("cv").isNull(), 0.0).when(F.col("cu") != F.col("cv"), (1 / F.col("nu") + 1 / F.col("nv")) / SHIFT)
    found = cut(known.select("u", "v", value.otherwise(F.greatest(F.coalesce(square, F.lit(0.0)), F.lit(SHIFT))).alias("r")), "sketched")
    if not refine:
        return found
    bucket = F.floor(F.ln("r") / math.log1p(refine)).cast("long")
    near = found.where("u <> v and r > 0").withColumn("bucket", bucket)
    crowded = near.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket")
    close = cut(near.join(crowded, "bucket", "left_semi").select("u", "v"), "close")
    exact = resistance(graph, close).withColumnRenamed("r", "exact")
    return found.join(exact, ["u", "v"], "left").select("u", "v", F.coalesce("exact", "r").alias("r"))


def hitting_time(graph: PropertyGraph, pairs: DataFrame, mode: str = "auto", walks: int = WALKS) -> DataFrame:
    """(u, v, h): expected steps of a random walk from u to v.

    `exact` and `auto` solve the absorbing chains of all targets together, at any size; `sampled` averages ``walks``
    hashed walks of at most MAX_STEPS. A walk also ends where there is no way on. From u to itself h is 0, as where an
    end is unknown; where a walk from u may never end, h is 1, as the surveyed fallback has it.
    """
    if mode == "sampled":
        return _sampled_hitting(graph, pairs, walks)
    from graphloom.operators.chains import absorption

    pairs = cut(pairs.select("u", "v").distinct(), "pairs")
    times = absorption(graph, pairs.where("u <> v").select(F.col("v").alias("id"))).withColumnRenamed("node", "u")
    ids = graph.nodes.select("id")
    known = pairs.join(ids.withColumnRenamed("id", "u"), "u", "left_semi").join(ids.withColumnRenamed("id", "v"), "v", "left_semi")
    known = known.select("u", "v", F.lit(True).alias("known"))
    joined = pairs.join(known, ["u", "v"], "left").join(times, ["v", "u"], "left")
    value = F.when(F.col("known").isNull() | (F.col("u") == F.col("v")), 0.0).otherwise(F.coalesce("h", F.lit(1.0)))
    return joined.select("u", "v", value.alias("h"))


def _sampled_hitting(graph: PropertyGraph, pairs: DataFrame, walks: int, steps: int = MAX_STEPS) -> DataFrame:
    """All walks of all pairs advance one step per join; those that arrive leave."""
    graph = graph.settled()
    near = cut(graph.arcs.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("near")), "near")
    pairs = cut(pairs.select("u", "v").distinct(), "pairs")
    walk = F.explode(F.sequence(F.lit(0), F.lit(walks - 1)))
    live = cut(pairs.select("u", "v", walk.alias("w"), F.col("u").alias("at")).where("u <> v"), "live")
    done = None
    for step in range(1, steps + 1):
        pick = F.pmod(F.xxhash64("u", "v", "w", F.lit(step), F.lit(SEED)), F.size("near")).cast("int")
        moved = live.join(near, live["at"] == near["src"]).select("u", "v", "w", F.get("near", pick).alias("at"))
        moved = cut(moved, "live")
        here = moved.where("at = v").select("u", "v", F.lit(float(step)).alias("t"))
        done = here if done is None else done.union(here)
        live = moved.where("at <> v")
        if live.limit(1).count() == 0:
            break
        if step % 20 == 0:
            done = cut(done, "done")
    known = graph.nodes.select(F.col("id").alias("u")), graph.nodes.select(F.col("id").alias("v"))
    both = pairs.join(known[0], "u", "left_semi").join(known[1], "v", "left_semi").withColumn("known", F.lit(True))
    mean = done.groupBy("u", "v").agg(F.avg("t").alias("t"))
    joined = pairs.join(both, ["u", "v"], "left").join(mean, ["u", "v"], "left")
    value = F.when(F.col("known").isNull() | (F.col("u") == F.col("v")), 0.0).otherwise(F.coalesce("t", F.lit(float(steps))))
    return joined.select("u", "v", value.alias("h"))
