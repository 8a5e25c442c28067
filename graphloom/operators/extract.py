"""Subgraph extraction: induced and filtered subgraphs, cores, trusses, motif census."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators.neighbours import canonical_edges, oriented, triangles
from graphloom.plans.lineage import cut, drop
from graphloom.sources.graph import PropertyGraph


def induced(graph: PropertyGraph, ids: DataFrame) -> PropertyGraph:
    """The nodes in ``ids`` (id) and the edges among them; unknown ids are ignored."""
    wanted = ids.select("id").distinct()
    edges = graph.edges
    for end in ("src", "dst"):
        edges = edges.join(wanted, edges[end] == wanted["id"], "left_semi")
    return PropertyGraph(graph.nodes.join(wanted, "id", "left_semi"), edges, graph.directed)


def filter_graph(
    graph: PropertyGraph,
    node_filter: Column | None = None,
    edge_filter: Column | None = None,
    remove_isolated: bool = False,
    compat: bool = False,
) -> PropertyGraph:
    """Nodes, then edges among them, then optionally nodes without edges (``compat``: without out-edges) dropped."""
    nodes = graph.nodes if node_filter is None else graph.nodes.where(node_filter)
    kept = induced(graph, nodes) if node_filter is not None else graph
    edges = kept.edges if edge_filter is None else kept.edges.where(edge_filter)
    out = PropertyGraph(kept.nodes, edges, graph.directed)
    if remove_isolated:
        ends = edges.select(F.col("src").alias("id"))
        if not (compat and graph.directed):
            ends = ends.union(edges.select(F.col("dst").alias("id")))
            out = PropertyGraph(out.nodes.join(ends.distinct(), "id", "left_semi"), edges, graph.directed)
        else:
            out = induced(PropertyGraph(out.nodes, edges, True), ends)
    return out


def _core_pairs(graph: PropertyGraph, k: int) -> DataFrame:
    """Canonical pairs of the k-core: peeled until no node has fewer than ``k`` neighbours left."""
    pairs = cut(canonical_edges(graph), "core")
    size = pairs.count()
    while True:
        ends = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
        poor = ends.groupBy("id").agg(F.count("*").alias("d")).where(F.col("d") < k).select("id")
        kept = pairs
        for end in ("a", "b"):
            kept = kept.join(poor, kept[end] == poor["id"], "left_anti")
        kept = cut(kept, "core")
        left = kept.count()
        drop(pairs)
        pairs = kept
        if left == size:
            return pairs
        size = left


def k_core(graph: PropertyGraph, k: int) -> PropertyGraph:
    """The largest subgraph whose nodes all have ``k`` neighbours or more in it; k = 0 is the graph itself."""
    if k < 0:
        raise ValueError("k is negative")
    if k == 0:
        return graph
    pairs = _core_pairs(graph, k)
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    return induced(graph, ends)


def _supported(pairs: DataFrame) -> DataFrame:
    """(a, b, support): triangles on every canonical pair that has any."""
    arcs = oriented(pairs)
    first = arcs.select(F.col("lo").alias("x"), F.col("hi").alias("y"))
    second = arcs.select(F.col("lo").alias("y"), F.col("hi").alias("z"))
    closing = arcs.select(F.col("lo").alias("x"), F.col("hi").alias("z"))
    found = first.join(second, "y").join(closing, ["x", "z"])
    sides = F.array(*(F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in (("x", "y"), ("y", "z"), ("x", "z"))))
    each = found.select(F.explode(sides).alias("e")).select("e.a", "e.b")
    return each.groupBy("a", "b").agg(F.count("*").alias("support"))


def _truss_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """Pairs of the k-truss of the undirected projection."""
    if k == 2:
        return pairs
    pairs, size = cut(pairs, "truss"), -1
    while True:
        kept = cut(_supported(pairs).where(F.col("support") >= k - 2).select("a", "b"), "truss")
        left = kept.count()
        drop(pairs)
        pairs = kept
        if left in (size, 0):
            return pairs
        size = left


def k_truss(graph: PropertyGraph, k: int) -> PropertyGraph:
    """Edges in at least k-2 triangles of the subgraph, and their nodes."""
    if k < 2:
        raise ValueError("k is below 2")
    pairs = _truss_pairs(canonical_edges(graph), k)
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    edges = graph.edges.withColumns({"a": low, "b": high}).join(pairs, ["a", "b"], "left_semi").drop("a", "b")
    return PropertyGraph(graph.nodes.join(ends, "id", "left_semi"), edges, graph.directed)


def edge_triangles(graph: PropertyGraph) -> DataFrame:
    """(a, b, triangles) for every canonical pair."""
    pairs = canonical_edges(graph)
    joined = pairs.join(_supported(pairs), ["a", "b"], "left")
    return joined.select("a", "b", F.coalesce("support", F.lit(0)).alias("triangles"))


def _h_indices(values: DataFrame, each: Callable[[DataFrame], DataFrame], label: str) -> tuple[DataFrame, int]:
    """(key, value) after replacing every value by the h-index of its parts until none changes, and the rounds it took.

    ``values``: (key, value), bounds from above. ``each(values)`` gives (key, part): a row per part of a key. The
    h-index is the largest h with at least h parts of h or more. Parts are counted by value before they are ranked, and
    those above a key's value count as it, so a key brings at most its value of rows to its window.
    """
    values, rounds = cut(values, label), 0
    while True:
        rounds += 1
        parts = each(values).join(values, "key").groupBy("key", "value", F.least("part", "value").alias("part")).agg(F.count("*").alias("n"))
        above = F.sum("n").over(W.partitionBy("key").orderBy(F.desc("part")))
        index = parts.withColumn("h", F.least("part", above)).groupBy("key").agg(F.max("h").alias("h"))
        found = values.join(index, "key", "left").select("key", F.least("value", F.coalesce("h", F.lit(0))).alias("value"), F.col("value").alias("before"))
        following = cut(found, label)
        changed = following.where("value < before").limit(1).count()
        drop(values)
        if not changed:
            return following.select("key", "value"), rounds
        path = following._cut_path
        values = following.select("key", "value")
        values._cut_path = path


def core_numbers(graph: PropertyGraph) -> DataFrame:
    """(id, core): the largest k whose k-core has the node, for all k at once.

    The numbers are the limit of h-indices (Lu et al., 2016): a node's bound, at first its degree, becomes the largest h
    such that h neighbours have a bound of h or more. A round is a join of the arcs with the bounds.
    """
    return _core_numbers(graph)[0]


def _core_numbers(graph: PropertyGraph) -> tuple[DataFrame, int]:
    pairs = canonical_edges(graph)
    arcs = cut(pairs.select(F.col("a").alias("key"), F.col("b").alias("other")).union(pairs.select("b", "a")), "arcs")
    degree = graph.nodes.select(F.col("id").alias("key")).join(arcs.groupBy("key").agg(F.count("*").alias("d")), "key", "left")
    bounds = degree.select("key", F.coalesce("d", F.lit(0)).alias("value"))
    each = lambda now: arcs.join(now.select(F.col("key").alias("other"), F.col("value").alias("part")), "other").select("key", "part")
    found, rounds = _h_indices(bounds, each, "cores")
    return found.select(F.col("key").alias("id"), F.col("value").cast("int").alias("core")), rounds


def truss_numbers(graph: PropertyGraph) -> DataFrame:
    """(a, b, truss): the largest k whose k-truss has the edge; edges in no triangle have 2.

    The triangles are listed once. An edge's bound, at first the number of its triangles, becomes the h-index of its
    triangles' lesser other bounds, until none changes; two more than that is its number.
    """
    return _truss_numbers(graph)[0]


def _truss_numbers(graph: PropertyGraph) -> tuple[DataFrame, int]:
    pairs = cut(canonical_edges(graph).select("a", "b", F.monotonically_increasing_id().alias("key")), "truss")
    arcs = cut(oriented(pairs.select("a", "b")), "oriented")
    first = arcs.select(F.col("lo").alias("x"), F.col("hi").alias("y"))
    second = arcs.select(F.col("lo").alias("y"), F.col("hi").alias("z"))
    closing = arcs.select(F.col("lo").alias("x"), F.col("hi").alias("z"))
    found = first.join(second, "y").join(closing, ["x", "z"])
    for name, p, q in (("xy", "x", "y"), ("yz", "y", "z"), ("xz", "x", "z")):
        found = found.withColumns({"a": F.least(p, q), "b": F.greatest(p, q)}).join(pairs, ["a", "b"]).drop("a", "b").withColumnRenamed("key", name)
    found = cut(found.select("xy", "yz", "xz"), "triangles")
    sides = F.explode(F.array(*(F.struct(F.col(k).alias("key"), F.col(p).alias("p"), F.col(q).alias("q")) for k, p, q in (("xy", "yz", "xz"), ("yz", "xy", "xz"), ("xz", "xy", "yz")))))
    three = cut(found.select(sides.alias("s")).select("s.*"), "sides")
    bounds = pairs.select("key").join(three.groupBy("key").agg(F.count("*").alias("value")), "key", "left").fillna(0)

    def each(now: DataFrame) -> DataFrame:
        other = lambda e: now.select(F.col("key").alias(e), F.col("value").alias(f"v{e}"))
        return three.join(other("p"), "p").join(other("q"), "q").select("key", F.least("vp", "vq").alias("part"))

    values, rounds = _h_indices(bounds, each, "trusses")
    return pairs.join(values, "key").select("a", "b", (F.col("value") + 2).cast("int").alias("truss")), rounds


#: Canonical edge lists of the graphs of 3 and 4 nodes, and their names. The matching has no common name
#: among them and is ours.
MOTIF_NAMES = {
    3: {"": "empty", "0-1": "1-edge", "0-1,0-2": "2-star", "0-1,0-2,1-2": "triangle"},
    4: {
        "": "empty",
        "0-1": "1-edge",
        "0-1,0-2": "2-star",
        "0-1,2-3": "matching",
        "0-1,0-2,1-2": "triangle",
        "0-1,0-2,0-3": "3-star",
        "0-1,0-2,1-3": "path-4",
        "0-1,0-2,0-3,1-2": "paw",
        "0-1,0-2,1-3,2-3": "4-cycle",
        "0-1,0-2,0-3,1-2,1-3": "diamond",
        "0-1,0-2,0-3,1-2,1-3,2-3": "K4",
    },
}


def motif_name(pattern: str) -> str:
    return next((names[pattern] for names in MOTIF_NAMES.values() if pattern in names), pattern)


def motif_census(graph: PropertyGraph, size: int = 3) -> DataFrame:
    """(pattern, name, count) of all node combinations of ``size`` 3 or 4, zero counts left out.

    Closed forms over edges, degrees, triangles, 4-cycles, diamonds and cliques; no combination is enumerated.
    """
    if size not in MOTIF_NAMES:
        raise ValueError("size is 3 or 4")
    small = PropertyGraph(graph.nodes, graph.edges, graph.directed).settled()
    counts = _counts3(small) if size == 3 else _counts4(small)
    rows = [(p, MOTIF_NAMES[size][p], int(c)) for p, c in counts.items() if c]
    return graph.nodes.sparkSession.createDataFrame(rows, "pattern string, name string, count long")


def _shape(graph: PropertyGraph) -> tuple[DataFrame, int, int, int]:
    pairs = cut(canonical_edges(graph), "pairs")
    tri = cut(triangles(graph), "triangles")
    return pairs, graph.nodes.count(), pairs.count(), tri.count()


def _degree(pairs: DataFrame) -> DataFrame:
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    return ends.groupBy("id").agg(F.count("*").cast("decimal(38,0)").alias("d"))


def _counts3(graph: PropertyGraph) -> dict[str, int]:
    pairs, n, m, t = _shape(graph)
    wedges = int(_degree(pairs).agg(F.sum(F.expr("d * (d - 1)"))).first()[0] or 0) // 2
    star = wedges - 3 * t
    one = m * (n - 2) - 2 * star - 3 * t
    return {"": n * (n - 1) * (n - 2) // 6 - one - star - t, "0-1": one, "0-1,0-2": star, "0-1,0-2,1-2": t}


def _counts4(graph: PropertyGraph) -> dict[str, int]:
    """Non-induced counts of the connected shapes, inverted to induced ones."""
    pairs, n, m, t = _shape(graph)
    degree = cut(_degree(pairs), "degree")
    sums = degree.agg(F.sum(F.expr("d * (d - 1)")), F.sum(F.expr("d * (d - 1) * (d - 2)"))).first()
    wedges, claws = int(sums[0] or 0) // 2, int(sums[1] or 0) // 6
    da, db = degree.select(F.col("id").alias("a"), F.col("d").alias("da")), degree.select(F.col("id").alias("b"), F.col("d").alias("db"))
    ends = pairs.join(da, "a").join(db, "b")
    paths = int(ends.agg(F.sum(F.expr("(da - 1) * (db - 1)"))).first()[0] or 0) - 3 * t
    corner = triangles(graph).select(F.explode(F.array("x", "y", "z")).alias("id")).join(degree, "id")
    paws = int(corner.agg(F.sum(F.expr("d - 2"))).first()[0] or 0)
    support = _supported(pairs)
    diamonds = int(support.agg(F.sum(F.expr("support * (support - 1)"))).first()[0] or 0) // 2
    arcs = oriented(pairs)
    # every 4-cycle once: from its highest node in (degree, id) order to the opposite one by two lower middles
    rank = degree.select("id", F.struct("d", "id").alias("o"))
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
    down = arcs.select(F.col("hi").alias("top"), F.col("lo").alias("mid"))
    far = both.select(F.col("u").alias("mid"), F.col("v").alias("end"))
    top, end = rank.select(F.col("id").alias("top"), F.col("o").alias("ot")), rank.select(F.col("id").alias("end"), F.col("o").alias("oe"))
    corners = down.join(far, "mid").join(top, "top").join(end, "end").where("oe < ot")
    pairs2 = corners.groupBy("top", "end").agg(F.count("*").cast("decimal(38,0)").alias("c"))
    cycles = int(pairs2.agg(F.sum(F.expr("c * (c - 1)"))).first()[0] or 0) // 2
    x = triangles(graph)
    fourth = arcs.select(F.col("lo").alias("z"), F.col("hi").alias("w"))
    edge = lambda p, q: arcs.select(F.col("lo").alias(p), F.col("hi").alias(q))
    cliques = x.join(fourth, "z").join(edge("x", "w"), ["x", "w"]).join(edge("y", "w"), ["y", "w"]).count()
    k4, dia = cliques, diamonds - 6 * cliques
    cyc = cycles - dia - 3 * k4
    paw = paws - 4 * dia - 12 * k4
    path = paths - 4 * cyc - 2 * paw - 6 * dia - 12 * k4
    claw = claws - paw - 2 * dia - 4 * k4
    tri = t * (n - 3) - paw - 2 * dia - 4 * k4
    match = (m * (m - 1) // 2 - wedges) - path - 2 * cyc - paw - 2 * dia - 3 * k4
    star = wedges * (n - 3) - 3 * tri - 3 * claw - 2 * path - 5 * paw - 4 * cyc - 8 * dia - 12 * k4
    one = m * (n - 2) * (n - 3) // 2 - 2 * star - 2 * match - 3 * (tri + claw + path) - 4 * (paw + cyc) - 5 * dia - 6 * k4
    rest = star + match + tri + claw + path + paw + cyc + dia + k4 + one
    return {
        "": n * (n - 1) * (n - 2) * (n - 3) // 24 - rest,
        "0-1": one,
        "0-1,0-2": star,
        "0-1,2-3": match,
        "0-1,0-2,1-2": tri,
        "0-1,0-2,0-3": claw,
        "0-1,0-2,1-3": path,
        "0-1,0-2,0-3,1-2": paw,
        "0-1,0-2,1-3,2-3": cyc,
        "0-1,0-2,0-3,1-2,1-3": dia,
        "0-1,0-2,0-3,1-2,1-3,2-3": k4,
    }


def motif_instances(graph: PropertyGraph, pattern: str) -> DataFrame:
    """(nodes): the induced instances of a connected pattern such as ``0-1,0-2,1-3``, node ids ascending.

    The pattern's edges are joined one after the other, missing ones are anti-joined. A triangle starts from its end of
    least degree; other patterns make a row per instance and symmetry, which is what listing them costs.
    """
    links = [tuple(map(int, e.split("-"))) for e in pattern.split(",") if e]
    places = sorted({x for e in links for x in e})
    if pattern == "0-1,0-2,1-2":
        return triangles(graph).select(F.array_sort(F.array("x", "y", "z")).alias("nodes"))
    if not links or links[0][0] != 0:
        raise ValueError("the pattern has no edge at its first node")
    pairs = cut(canonical_edges(graph), "pairs")
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    arc = lambda p, q: both.select(F.col("a").alias(f"n{p}"), F.col("b").alias(f"n{q}"))
    rows, have = arc(*links[0]), set(links[0])
    rest = links[1:]
    while rest:
        p, q = next(((p, q) for p, q in rest if p in have or q in have), (None, None))
        if p is None:
            raise ValueError("the pattern is not connected")
        rest.remove((p, q))
        rows = rows.join(arc(p, q), [f"n{x}" for x in (p, q) if x in have])
        have |= {p, q}
    for p in places:
        for q in places:
            if p < q:
                rows = rows.where(F.col(f"n{p}") != F.col(f"n{q}"))
                if (p, q) not in links and (q, p) not in links:
                    rows = rows.join(arc(p, q), [f"n{p}", f"n{q}"], "left_anti")
    return rows.select(F.array_sort(F.array(*(f"n{p}" for p in places))).alias("nodes")).distinct()
