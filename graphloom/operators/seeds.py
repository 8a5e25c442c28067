"""Seed-pair selection. Every draw is a hash of (seed, draw number), so reruns choose the same pairs.

Candidates are made, scored and compared by joins; only the greedy diversity filter, which is sequential over a ranked
list, takes its decisions in one task, over a bounded block of candidates at a time.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.stats import kmeans, z_scores
from graphloom.operators.linalg import label_propagation, pagerank
from graphloom.operators.neighbours import triangle_counts
from graphloom.operators.similarity import pair_features
from graphloom.operators.traversal import WORD, bfs_masks
from graphloom.plans.draws import drawn
from graphloom.plans.lineage import cut, drop
from graphloom.plans.numbering import cumulated, numbered
from graphloom.sources.graph import PropertyGraph


def hashed(*parts: Column | str, seed: int) -> Column:
    """A non-negative hash."""
    return drawn(*parts, seed=seed)


def draws(left: DataFrame, right: DataFrame, count: int, seed: int) -> DataFrame:
    """(draw, source, target): ``count`` hashed pairs of a node of ``left`` and one of ``right``, both (k, id)."""
    spark = left.sparkSession
    sizes = left.agg(F.count("*").alias("nl")).crossJoin(right.agg(F.count("*").alias("nr")))
    rows = spark.range(count).withColumnRenamed("id", "draw").crossJoin(F.broadcast(sizes)).where("nl > 0 and nr > 0")
    rows = rows.select(
        "draw",
        F.pmod(hashed("draw", F.lit("a"), seed=seed), F.col("nl")).alias("i"),
        F.pmod(hashed("draw", F.lit("b"), seed=seed), F.col("nr")).alias("j"),
    )
    a = left.select(F.col("k").cast("long").alias("i"), F.col("id").alias("source"))
    b = right.select(F.col("k").cast("long").alias("j"), F.col("id").alias("target"))
    return rows.join(a, "i").join(b, "j").where("source <> target").select("draw", "source", "target")


def _unordered(pairs: DataFrame) -> DataFrame:
    """One row per unordered pair, the first drawn."""
    keyed = pairs.withColumns({"x": F.least("source", "target"), "y": F.greatest("source", "target")})
    first = keyed.groupBy("x", "y").agg(F.min("draw").alias("draw"))
    return keyed.join(first, ["x", "y", "draw"]).drop("x", "y")


def diverse(graph: PropertyGraph, ranked: DataFrame, n_pairs: int, threshold: float = 0.5, pool: int = 4) -> DataFrame:
    """The best pairs (source, target, score), none whose source and target both resemble an earlier pick's.

    Candidates are looked at in blocks of ``pool`` × ``n_pairs``, best first, until enough are picked or none is left.
    The greedy order is sequential, so a block is one task; what it looks at are the similarities of the block's ends
    with each other and with those of the earlier picks, made by joins. A block and its neighbourhoods are bounded by
    ``pool`` and ``n_pairs``, not by the graph.
    """
    ranked = cut(numbered(ranked.withColumn("id", F.struct((-F.col("score")).alias("s"), "source", "target"))).drop("id"), "ranked")
    total, size = ranked.count(), pool * n_pairs
    picked, start = None, 0
    while start < total:
        block = ranked.where((F.col("k") >= start) & (F.col("k") < start + size))
        before = ranked.limit(0) if picked is None else picked
        block = cut(before.union(block), "block")
        found = cut(_greedy(graph, block, start, n_pairs, threshold), "picked")
        if picked is not None:
            drop(picked)
        picked, start = found, start + size
        if picked.count() >= n_pairs:
            break
    columns = [c for c in ranked.columns if c != "k"]
    return (ranked.limit(0) if picked is None else picked).select(*columns)


def _greedy(graph: PropertyGraph, block: DataFrame, start: int, n_pairs: int, threshold: float) -> DataFrame:
    """Picks of a block in rank order ``k``; rows before ``start`` are picked already."""
    pairs = block.select("k", "source", "target")
    other = pairs.select(F.col("k").alias("j"), F.col("source").alias("s2"), F.col("target").alias("t2"))
    ends = pairs.select(F.col("source").alias("id")).union(pairs.select(F.col("target").alias("id"))).distinct()
    alike = cut(_alike(graph, ends, threshold), "alike")
    same = alike.select(F.col("a").alias("source"), F.col("b").alias("s2"))
    both = pairs.join(same, "source").join(other, "s2").where("j < k")
    both = both.join(alike.select(F.col("a").alias("target"), F.col("b").alias("t2")), ["target", "t2"])
    against = both.groupBy("k").agg(F.collect_set("j").alias("against"))
    rows = block.join(against, "k", "left")
    columns = block.columns

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        chosen: set[int] = set()
        for k, against in zip(rows["k"], rows["against"], strict=True):
            if k < start or (len(chosen) < n_pairs and (against is None or chosen.isdisjoint(against))):
                chosen.add(k)
        return rows[rows["k"].isin(chosen)][columns]

    return rows.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(pick, block.schema)


def _alike(graph: PropertyGraph, ends: DataFrame, threshold: float) -> DataFrame:
    """(a, b), both ways round and with itself: ends whose neighbourhoods have a Jaccard of ``threshold`` or more."""
    near = graph.arcs.select("src", "dst").distinct().join(ends.withColumnRenamed("id", "src"), "src")
    near = cut(near, "ends")
    size = near.groupBy("src").agg(F.count("*").alias("n"))
    a, b = near.select(F.col("src").alias("a"), "dst"), near.select(F.col("src").alias("b"), "dst")
    shared = a.join(b, "dst").groupBy("a", "b").agg(F.count("*").alias("c"))
    sizes = size.select(F.col("src").alias("a"), F.col("n").alias("na")), size.select(F.col("src").alias("b"), F.col("n").alias("nb"))
    known = shared.join(F.broadcast(sizes[0]), "a").join(F.broadcast(sizes[1]), "b")
    return known.where(F.col("c") >= threshold * (F.col("na") + F.col("nb") - F.col("c"))).select("a", "b")


def filled(graph: PropertyGraph, picked: DataFrame, n_pairs: int, seed: int) -> DataFrame:
    """``picked`` brought to ``n_pairs`` with hashed pairs of score 0 that it does not have."""
    picked = cut(picked.select("source", "target", "score"), "picked")
    short = n_pairs - picked.count()
    if short <= 0:
        return picked
    nodes = numbered(graph.nodes.select("id"))
    more = _unordered(draws(nodes, nodes, 20 * n_pairs, seed + 1))
    x, y = F.least("source", "target"), F.greatest("source", "target")
    have = picked.select(x.alias("x"), y.alias("y"))
    fresh = more.withColumns({"x": x, "y": y}).join(have, ["x", "y"], "left_anti").orderBy("draw").limit(short)
    return picked.union(fresh.select("source", "target", F.lit(0.0).alias("score")))


def terciles(values: DataFrame, low: str = "low", mid: str = "mid", high: str = "high") -> DataFrame:
    """(id, value, category) with cuts at the values of ranks n/3 and 2n/3."""
    cuts = values.agg(F.percentile_approx("value", [1 / 3, 2 / 3], 1_000_000).alias("p"))
    p = F.col("p")
    kind = F.when(F.col("value") <= p[0], low).when(F.col("value") <= p[1], mid).otherwise(high)
    return values.crossJoin(F.broadcast(cuts)).select("id", "value", kind.alias("category"))


def _by_category(table: DataFrame) -> dict[str, DataFrame]:
    ranked = cut(numbered(table, "category"), "categories")
    return {r.category: ranked.where(F.col("category") == r.category) for r in ranked.select("category").distinct().collect()}


def stride(graph: PropertyGraph, n_pairs: int = 100, seed: int = 42, bonus: float = 1.0) -> DataFrame:
    """Pairs of unlike triad counts: contrast plus a bonus across categories."""
    graph = graph.settled()
    triads = cut(triangle_counts(graph).select("id", F.col("triangles").cast("double").alias("value")), "triads")
    kinds = terciles(triads, "periphery", "bridge", "core")
    groups = _by_category(kinds)
    drawn, count = None, max(3 * n_pairs, 30)
    for i, a in enumerate(sorted(groups)):
        for j, b in enumerate(sorted(groups)):
            part = draws(groups[a], groups[b], count, seed + 10 * i + j)
            drawn = part if drawn is None else drawn.union(part.withColumn("draw", F.col("draw") + (3 * i + j) * count))
    value = lambda end, c: kinds.select(F.col("id").alias(end), F.col("value").alias(f"t{c}"), F.col("category").alias(f"k{c}"))
    rows = _unordered(drawn).join(value("source", "a"), "source").join(value("target", "b"), "target")
    most = F.greatest("ta", "tb", F.lit(1.0))
    contrast = F.abs(F.col("ta") - F.col("tb"))
    cross = F.when(F.col("ka") != F.col("kb"), bonus * most).otherwise(0.0)
    ranked = rows.select("source", "target", (contrast + cross).alias("score"))
    return filled(graph, diverse(graph, ranked, n_pairs), n_pairs, seed)


def bridge_scores(graph: PropertyGraph, pairs: DataFrame) -> DataFrame:
    """(source, target, score): exclusive over shared neighbours, or 1 over the exclusive ones where none is shared."""
    rows = pair_features(graph, pairs.select(F.col("source").alias("u"), F.col("target").alias("v")), exclude=False)
    alone = F.col("a") + F.col("b") - 2 * F.col("shared")
    score = F.when(F.col("shared") > 0, alone / F.col("shared")).otherwise(1.0 / F.greatest(alone, F.lit(1)))
    return rows.select(F.col("u").alias("source"), F.col("v").alias("target"), score.alias("score"))


def crest(graph: PropertyGraph, n_pairs: int = 100, seed: int = 42, sample: int = 5000) -> DataFrame:
    graph = graph.settled()
    nodes = cut(numbered(graph.nodes.select("id")), "numbered")
    ranked = bridge_scores(graph, _unordered(draws(nodes, nodes, sample, seed)))
    return filled(graph, diverse(graph, ranked, n_pairs), n_pairs, seed)


def neighbour_skewness(graph: PropertyGraph) -> DataFrame:
    """(id, value): population skewness of the neighbours' degrees; 0 below three neighbours or without variance."""
    degree = graph.degrees().select(F.col("id").alias("dst"), F.col("deg_both").cast("double").alias("d"))
    each = graph.arcs.select("src", "dst").join(degree, "dst").groupBy("src")
    stats = each.agg(F.count("*").alias("n"), F.var_pop("d").alias("v"), F.skewness("d").alias("s"))
    value = F.when((F.col("n") >= 3) & (F.col("v") >= 1e-10), F.col("s")).otherwise(0.0)
    joined = graph.nodes.select("id").join(stats, F.col("id") == F.col("src"), "left")
    return joined.select("id", F.coalesce(value, F.lit(0.0)).alias("value"))


def spine(graph: PropertyGraph, n_pairs: int = 100, seed: int = 42) -> DataFrame:
    """Pairs of high and low skewness; mixes with the middle count 0.8, two high ends 0.5."""
    graph = graph.settled()
    kinds = terciles(cut(neighbour_skewness(graph), "skewness"))
    groups = _by_category(kinds)
    count, drawn = max(20 * n_pairs, 200), None
    for i, (a, b, weight) in enumerate((("high", "low", 1.0), ("high", "mid", 0.8), ("mid", "low", 0.8), ("high", "high", 0.5))):
        if a in groups and b in groups:
            part = draws(groups[a], groups[b], count, seed + i).withColumn("w", F.lit(weight))
            part = part.withColumn("draw", F.col("draw") + i * count)
            drawn = part if drawn is None else drawn.union(part)
    if drawn is None:
        drawn = draws(*(groups[k] for k in list(groups)[:1] * 2), count, seed).withColumn("w", F.lit(1.0))
    value = lambda end, c: kinds.select(F.col("id").alias(end), F.col("value").alias(c))
    rows = _unordered(drawn).join(value("source", "a"), "source").join(value("target", "b"), "target")
    ranked = rows.select("source", "target", (F.abs(F.col("a") - F.col("b")) * F.col("w")).alias("score"))
    return filled(graph, diverse(graph, ranked, n_pairs), n_pairs, seed)


def pair_distances(graph: PropertyGraph, pairs: DataFrame, most: int) -> DataFrame:
    """(source, target, dist) of the pairs at most ``most`` steps apart.

    The sources search as bits of words, 64 together, so no table has a row per source and node; a pair looks its source's
    bit up in the words of its target.
    """
    pairs = cut(pairs.select("source", "target").distinct(), "pairs")
    starts = cut(numbered(pairs.select(F.col("source").alias("id")).distinct()), "starts")
    masks = bfs_masks(graph, starts, most).withColumnRenamed("node", "target")
    asked = pairs.join(starts.select(F.col("id").alias("source"), (F.col("k") % WORD).cast("int").alias("bit"), F.floor(F.col("k") / WORD).cast("long").alias("block")), "source")
    met = asked.join(masks, ["block", "target"]).where("getbit(mask, bit) = 1")
    return met.groupBy("source", "target").agg(F.min("depth").alias("dist"))


def crisp(graph: PropertyGraph, n_pairs: int = 100, seed: int = 42, sample: int = 5000, low: int = 2, high: int = 4, common: int = 2) -> DataFrame:
    """Pairs at distance ``low`` to ``high`` with ``common`` shared neighbours; a relaxed pass (1 to 6) if too few."""
    graph = graph.settled()
    nodes = cut(numbered(graph.nodes.select("id")), "numbered")
    pairs = cut(_unordered(draws(nodes, nodes, sample, seed)).select("source", "target"), "sampled")
    shared = pair_features(graph, pairs.select(F.col("source").alias("u"), F.col("target").alias("v")), exclude=False)
    shared = shared.select(F.col("u").alias("source"), F.col("v").alias("target"), F.col("shared").alias("cn"))
    # a pair with a common neighbour is at most two steps apart, so the distance is 1 or 2 there
    linked = graph.arcs.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit(1).alias("linked"))
    near = pairs.join(shared, ["source", "target"]).join(linked, ["source", "target"], "left")
    dist = F.when(F.col("linked").isNotNull(), 1).when(F.col("cn") > 0, 2)
    near = cut(near.select("source", "target", "cn", dist.alias("dist")), "near")
    weight = 1 + (1 - F.abs(F.col("dist") - 3) / 3)
    strict = near.where((F.col("dist") >= low) & (F.col("dist") <= high) & (F.col("cn") >= common))
    ranked = strict.select("source", "target", (F.col("cn") * weight).alias("score"))
    picked = diverse(graph, ranked, n_pairs)
    if cut(picked, "strict").count() < n_pairs:
        open_ = near.where("dist is null").select("source", "target")
        far = pair_distances(graph, open_, 6)
        wider = far.select("source", "target", F.lit(0).cast("long").alias("cn"), "dist")
        relaxed = near.where("dist is not null").union(wider).where("dist between 1 and 6")
        ranked = relaxed.select("source", "target", ((F.col("cn") + 0.1) * weight).alias("score"))
        picked = diverse(graph, ranked, n_pairs)
    return filled(graph, picked, n_pairs, seed)


def grasp_features(graph: PropertyGraph, sample: int = 200_000, seed: int = 42, iterations: int = 10) -> DataFrame:
    """(id, f1, f2, f3): log degree, triangles of the sample over possible pairs, PageRank on the sample.

    The sample is the ``sample`` nodes with an edge that have the smallest hashes; all of them where there are fewer.
    """
    from graphloom.operators.extract import induced

    ids = graph.both.select(F.col("src").alias("id")).distinct()
    part = induced(graph, ids.orderBy(hashed("id", seed=seed), "id").limit(sample)).settled()
    degree = graph.degrees().select("id", F.col("deg_both").alias("d"))
    ranks = pagerank(part, iterations=iterations, tolerance=None)
    rows = triangle_counts(part).join(degree, "id").join(ranks, "id")
    pairs = F.col("d") * (F.col("d") - 1) / 2
    return rows.select(
        "id",
        F.ln(F.col("d") + 1).alias("f1"),
        F.when(pairs > 0, F.col("triangles") / pairs).otherwise(0.0).alias("f2"),
        F.col("rank").alias("f3"),
    )


def grasp(graph: PropertyGraph, clusters: int = 100, per_cluster: int = 10, within: float = 0.5, sample: int = 200_000, seed: int = 42) -> DataFrame:
    """(source, target, source_cluster, target_cluster, score): pairs within and across clusters of structural features.

    The score is the distance of the standardised features.
    """
    graph = graph.settled()
    table = cut(z_scores(grasp_features(graph, sample, seed), "f1", "f2", "f3"), "features")
    points = table.select("id", F.array("f1", "f2", "f3").alias("v"))
    labels = kmeans(points, clusters, seed)
    ranked = cut(numbered(points.join(labels, "id"), "cluster"), "clusters")
    sizes = ranked.groupBy("cluster").agg(F.count("*").alias("size")).where("size >= 2")
    inner = math.floor(per_cluster * within)
    order = numbered(sizes.select(F.col("cluster").alias("id"), "size")).select(F.col("k").alias("ck"), F.col("id").alias("cluster"), "size")
    order = cut(order, "order")
    total = order.agg(F.count("*").alias("nc"))
    rows = order.crossJoin(F.broadcast(total)).select("*", F.explode(F.sequence(F.lit(0), F.lit(per_cluster - 1))).alias("draw"))
    to = F.when(F.col("draw") < inner, F.col("ck")).otherwise(F.pmod(hashed("cluster", "draw", F.lit("c"), seed=seed), F.col("nc")))
    rows = rows.withColumn("tk", to)
    other = order.select(F.col("ck").alias("tk"), F.col("cluster").alias("tc"), F.col("size").alias("tsize"))
    rows = rows.join(other, "tk").where((F.col("draw") < inner) | (F.col("tc") != F.col("cluster")))
    rows = rows.select(
        "cluster",
        "tc",
        F.pmod(hashed("cluster", "draw", F.lit("s"), seed=seed), F.col("size")).alias("i"),
        F.pmod(hashed("cluster", "draw", F.lit("t"), seed=seed), F.col("tsize")).alias("j"),
    )
    a = ranked.select("cluster", F.col("k").alias("i"), F.col("id").alias("source"), F.col("v").alias("va"))
    b = ranked.select(F.col("cluster").alias("tc"), F.col("k").alias("j"), F.col("id").alias("target"), F.col("v").alias("vb"))
    joined = rows.join(a, ["cluster", "i"]).join(b, ["tc", "j"]).where("source <> target")
    gap = F.sqrt(F.aggregate(F.zip_with("va", "vb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d))
    return joined.select("source", "target", F.col("cluster").alias("source_cluster"), F.col("tc").alias("target_cluster"), gap.alias("score")).distinct()


def stratified(graph: PropertyGraph, field_of: Column, strata: dict[str, Column], per_stratum: int = 10, seed: int = 42) -> tuple[DataFrame, list[str]]:
    """(stratum, source, target, same_field): hashed pairs of classified nodes for each stratum, and the empty strata.

    A stratum is a condition on field_a and field_b, with field_a <= field_b; it is a condition of the join that makes
    pairs of fields, so an equality in it is an equi-join. Node pairs of the eligible pairs of fields are numbered by
    running sums of how many there are, and drawn by number, with replacement: at most ``per_stratum``, and no more than
    there are. The draws are what is sent to the tasks; pairs of fields stay where they are.
    """
    spark = graph.nodes.sparkSession
    known = graph.nodes.select("id", field_of.alias("field")).where("field is not null")
    ranked = cut(numbered(known, "field"), "fields")
    sizes = cut(ranked.groupBy("field").agg(F.count("*").alias("size")), "sizes")
    a = sizes.select(F.col("field").alias("field_a"), F.col("size").alias("na"))
    b = sizes.select(F.col("field").alias("field_b"), F.col("size").alias("nb"))
    picked, empty = [], []
    for name, condition in strata.items():
        fits = a.join(b, condition & (F.col("field_a") <= F.col("field_b"))).where("field_a <> field_b or na > 1")
        same = F.col("field_a") == F.col("field_b")
        pairs = F.when(same, F.col("na") * (F.col("na") - 1) / 2).otherwise(F.col("na") * F.col("nb")).cast("long")
        kinds = cut(cumulated(fits.select("*", pairs.alias("pairs"), F.struct("field_a", "field_b").alias("id")), "pairs"), "kinds")
        total = kinds.agg(F.sum("pairs")).first()[0]
        if not total:
            empty.append(name)
            continue
        which = lambda n, name=name: drawn(F.lit(name), "draw", F.lit(n), seed=seed)
        rows = spark.range(min(per_stratum, total)).select(F.col("id").alias("draw"))
        rows = rows.select("draw", (which("pair") % total).alias("at"), which("i").alias("i"), which("j").alias("j"))
        found = kinds.join(F.broadcast(rows), (F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("pairs")))
        i, j = F.col("i") % F.col("na"), F.col("j") % (F.col("nb") - same.cast("long"))
        found = found.select(F.lit(name).alias("stratum"), "draw", "field_a", "field_b", i.alias("i"), j.alias("j"))
        picked.append(found.withColumn("j", F.col("j") + (same & (F.col("j") >= F.col("i"))).cast("long")))
    if not picked:
        return spark.createDataFrame([], "stratum string, source string, target string, same_field boolean"), empty
    out = picked[0]
    for rows in picked[1:]:
        out = out.union(rows)
    left = ranked.select(F.col("field").alias("field_a"), F.col("k").alias("i"), F.col("id").alias("source"))
    right = ranked.select(F.col("field").alias("field_b"), F.col("k").alias("j"), F.col("id").alias("target"))
    joined = out.join(left, ["field_a", "i"]).join(right, ["field_b", "j"])
    return joined.select("stratum", "source", "target", (F.col("field_a") == F.col("field_b")).alias("same_field")), empty


def degree_diverse(graph: PropertyGraph, n_pairs: int, seed: int) -> DataFrame:
    """Half low with high degree, a quarter low with low, the rest high with high; missing ones from the middle."""
    values = graph.degrees().select("id", F.col("deg_both").cast("double").alias("value"))
    groups = _by_category(terciles(cut(values, "degrees")))
    shares = (("low", "high", n_pairs // 2), ("low", "low", n_pairs // 4), ("high", "high", n_pairs - n_pairs // 2 - n_pairs // 4))
    out = None
    for i, (a, b, count) in enumerate(shares):
        if a in groups and b in groups and count:
            part = _unordered(draws(groups[a], groups[b], 3 * count, seed + i)).orderBy("draw").limit(count)
            out = part if out is None else out.union(part)
    none = graph.nodes.sparkSession.createDataFrame([], "source string, target string")
    out = cut(none if out is None else out.select("source", "target"), "chosen")
    short = n_pairs - out.count()
    if short > 0:
        rest = groups.get("mid")
        rest = numbered(graph.nodes.select("id")) if rest is None or rest.limit(2).count() < 2 else rest
        x, y = F.least("source", "target"), F.greatest("source", "target")
        more = _unordered(draws(rest, rest, 3 * n_pairs, seed + 3)).withColumns({"x": x, "y": y})
        more = more.join(out.select(x.alias("x"), y.alias("y")), ["x", "y"], "left_anti")
        out = out.union(more.orderBy("draw").limit(short).select("source", "target"))
    return out.select("source", "target", F.lit(1.0).alias("score"))


def max_distance(graph: PropertyGraph, n_pairs: int, seed: int, sources: int = 64) -> DataFrame:
    """The farthest pairs from at most ``sources`` hashed starts.

    The starts search as bits of one word a node; pairs are made of the deepest levels only, as many as it takes.
    """
    starts = cut(graph.nodes.select("id").orderBy(hashed("id", seed=seed), "id").limit(sources), "starts")
    starts = cut(numbered(starts), "numbered")
    masks = cut(bfs_masks(graph, starts).where("depth > 0"), "masks")
    sizes = masks.groupBy("depth").agg(F.sum(F.bit_count("mask")).alias("n")).orderBy(F.desc("depth")).collect()
    enough, least = 0, 0
    for r in sizes:
        enough, least = enough + r.n, r.depth
        if enough >= n_pairs:
            break
    bit = F.explode(F.expr(f"filter(sequence(0, {WORD - 1}), b -> getbit(mask, b) = 1)"))
    found = masks.where(F.col("depth") >= least).select("block", "node", "depth", bit.alias("bit"))
    named = starts.select(F.col("id").alias("source"), F.floor(F.col("k") / WORD).cast("long").alias("block"), (F.col("k") % WORD).cast("int").alias("bit"))
    rows = found.join(named, ["block", "bit"]).select("source", F.col("node").alias("target"), F.col("depth").cast("double").alias("score"))
    return rows.orderBy(F.desc("score"), hashed("source", "target", seed=seed), "source", "target").limit(n_pairs)


def community_bridge(graph: PropertyGraph, n_pairs: int, seed: int) -> DataFrame:
    """Pairs from different communities, largest product of sizes first.

    Pairs of communities are ranked, not pairs of nodes; enough of the best are expanded for ``n_pairs``.
    """
    labels = cut(label_propagation(graph), "communities")
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    best = cut(sizes.orderBy(F.desc("size"), "label").limit(2 * math.isqrt(n_pairs) + 4), "best")
    a = best.select(F.col("label").alias("la"), F.col("size").alias("sa"))
    b = best.select(F.col("label").alias("lb"), F.col("size").alias("sb"))
    kinds = a.join(b, F.col("la") < F.col("lb")).select("la", "lb", (F.col("sa") * F.col("sb")).alias("score"))
    few = numbered(labels.join(best.select("label"), "label"), "label").where(F.col("k") <= math.isqrt(n_pairs)).drop("k")
    left, right = few.select(F.col("label").alias("la"), F.col("id").alias("source")), few.select(F.col("label").alias("lb"), F.col("id").alias("target"))
    rows = kinds.join(left, "la").join(right, "lb")
    rows = rows.select("source", "target", F.col("score").cast("double").alias("score"))
    return rows.orderBy(F.desc("score"), hashed("source", "target", seed=seed), "source", "target").limit(n_pairs)


def _grasp_component(graph: PropertyGraph, n_pairs: int, seed: int) -> DataFrame:
    n = graph.nodes.count()
    k = min(24, max(8, round(math.sqrt(n))))
    pairs = grasp(graph, k, max(2, math.ceil(n_pairs / k)), 0.5, min(20_000, max(2_000, 20 * n)), seed)
    return pairs.select("source", "target", "score")


COMPONENTS = {
    "stride": lambda g, n, s: stride(g, n, s),
    "crest": lambda g, n, s: crest(g, n, s),
    "spine": lambda g, n, s: spine(g, n, s),
    "crisp": lambda g, n, s: crisp(g, n, s),
    "grasp": _grasp_component,
    "degree_diverse": degree_diverse,
    "max_distance": max_distance,
    "community_bridge": community_bridge,
}
#: Fixed values: (component, weight, blind) in order, and bias of each ensemble.
ENSEMBLES = {
    "brisk": (
        (
            ("stride", 1.0, True),
            ("crest", 1.0, True),
            ("spine", 0.95, True),
            ("degree_diverse", 0.6, True),
            ("grasp", 0.8, True),
        ),
        0.1,
    ),
    "basil": (
        (
            ("stride", 1.0, True),
            ("crest", 1.0, True),
            ("spine", 0.95, True),
            ("grasp", 0.85, True),
            ("degree_diverse", 0.6, True),
            ("crisp", 0.25, False),
        ),
        0.2,
    ),
    "prism": (
        (
            ("stride", 1.0, True),
            ("crest", 1.0, True),
            ("spine", 0.9, True),
            ("grasp", 0.8, True),
            ("degree_diverse", 0.7, True),
            ("max_distance", 0.7, False),
            ("crisp", 0.8, False),
        ),
        0.1,
    ),
    "omnia": (
        (
            ("stride", 1.0, True),
            ("crest", 1.0, True),
            ("spine", 0.9, True),
            ("grasp", 0.8, True),
            ("degree_diverse", 0.7, True),
            ("crisp", 0.85, False),
            ("max_distance", 0.9, False),
            ("community_bridge", 0.9, False),
        ),
        0.05,
    ),
}


def votes(parts: list[tuple[str, float, bool, DataFrame]], bias: float) -> DataFrame:
    """(source, target, score, support): weights by rank in each component, summed, with a bonus for agreement."""
    out = None
    for name, weight, blind, pairs in parts:
        x, y = F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")
        own = cut(pairs.select(x, y, "score").groupBy("source", "target").agg(F.max("score").alias("score")), name)
        n = own.count()
        # components return a bounded number of pairs, so their rank is a small window
        place = F.row_number().over(W.orderBy(F.desc("score"), "source", "target")) - 1
        value = weight * (1 + bias if blind else 1.0) * (0.5 + 0.5 * (1 - place / max(n, 1)))
        ranked = own.select("source", "target", value.alias("v"), F.lit(name).alias("component"))
        out = ranked if out is None else out.union(ranked)
    sums = out.groupBy("source", "target").agg(F.sum("v").alias("v"), F.countDistinct("component").alias("support"))
    return sums.select("source", "target", (F.col("v") * (1 + 0.05 * (F.col("support") - 1))).alias("score"), "support")


def ensemble(graph: PropertyGraph, name: str, n_pairs: int = 100, seed: int = 42, grasp_too: bool = True) -> DataFrame:
    """(source, target, score) by brisk, basil, prism or omnia: votes, then picks that avoid overused nodes.

    ``grasp_too`` is brisk's choice to have or leave out grasp.
    """
    components, bias = ENSEMBLES[name]
    if name == "brisk" and not grasp_too:
        components = tuple(c for c in components if c[0] != "grasp")
    graph, wanted = graph.settled(), max(3 * n_pairs, 30)
    parts = [(c, w, blind, COMPONENTS[c](graph, wanted, seed + 97 * (i + 1))) for i, (c, w, blind) in enumerate(components)]
    ranked = votes(parts, bias).select("source", "target", "score")

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "source", "target"], ascending=[False, True, True])
        left = list(rows.itertuples(index=False))
        used: dict[str, int] = {}
        out = []
        while left and len(out) < n_pairs:
            cost = [r.score - 0.15 * (used.get(r.source, 0) + used.get(r.target, 0)) for r in left]
            best = left.pop(max(range(len(left)), key=lambda i: (cost[i], -i)))
            for end in (best.source, best.target):
                used[end] = used.get(end, 0) + 1
            out.append((best.source, best.target, best.score))
        return pd.DataFrame(out, columns=["source", "target", "score"])

    top = ranked.orderBy(F.desc("score"), "source", "target").limit(10 * wanted)
    picked = top.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(pick, "source string, target string, score double")
    return filled(graph, picked, n_pairs, seed)
