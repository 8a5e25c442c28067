"""Neighbourhood statistics: type counts and entropies, triangles, clustering, local density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.sources.graph import PropertyGraph


def edge_type_counts(graph: PropertyGraph) -> DataFrame:
    return graph.edges.groupBy("type").agg(F.count("*").alias("n"))


def node_type_counts(graph: PropertyGraph) -> DataFrame:
    return graph.nodes.groupBy("type").agg(F.count("*").alias("n"))


def canonical_edges(graph: PropertyGraph) -> DataFrame:
    """Different unordered pairs (a, b), a < b, joined by an edge in either direction."""
    pairs = graph.edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return pairs.distinct() if graph.directed else pairs


def oriented(pairs: DataFrame) -> DataFrame:
    """(lo, hi): each pair from its end of smaller degree to the other, so that no hub has many out-pairs."""
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    degree = ends.groupBy("id").agg(F.count("*").alias("d"))
    a = degree.select(F.col("id").alias("a"), F.col("d").alias("da"))
    b = degree.select(F.col("id").alias("b"), F.col("d").alias("db"))
    known = pairs.join(a, "a").join(b, "b")
    forward = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    lo, hi = F.when(forward, F.col("a")).otherwise(F.col("b")), F.when(forward, F.col("b")).otherwise(F.col("a"))
    return known.select(lo.alias("lo"), hi.alias("hi"))


def triangles(graph: PropertyGraph) -> DataFrame:
    """(x, y, z): every triangle of the undirected projection once, found from its end of least degree."""
    arcs = oriented(canonical_edges(graph))
    first = arcs.select(F.col("lo").alias("x"), F.col("hi").alias("y"))
    second = arcs.select(F.col("lo").alias("y"), F.col("hi").alias("z"))
    closing = arcs.select(F.col("lo").alias("x"), F.col("hi").alias("z"))
    return first.join(second, "y").join(closing, ["x", "z"]).select("x", "y", "z")


def triangle_counts(graph: PropertyGraph) -> DataFrame:
    """(id, triangles) for every node."""
    corners = triangles(graph).select(F.explode(F.array("x", "y", "z")).alias("id"))
    counted = corners.groupBy("id").agg(F.count("*").alias("triangles"))
    joined = graph.nodes.select("id").join(counted, "id", "left")
    return joined.select("id", F.coalesce("triangles", F.lit(0)).alias("triangles"))


def clustering(graph: PropertyGraph, ids: DataFrame | None = None) -> DataFrame:
    """(id, clustering): share of pairs of a node's neighbours that are joined; 0 below two neighbours.

    ``ids`` (id) restricts the nodes; only the edges among them and their neighbours are then looked at.
    """
    if ids is not None:
        from graphloom.operators.extract import induced

        wanted = ids.select("id").distinct().join(graph.nodes.select("id"), "id", "left_semi")
        near = graph.both.join(wanted, F.col("src") == F.col("id"), "left_semi").select(F.col("dst").alias("id"))
        return clustering(induced(graph, wanted.union(near))).join(wanted, "id", "left_semi")
    ends = canonical_edges(graph)
    both = ends.select(F.col("a").alias("id")).union(ends.select(F.col("b").alias("id")))
    k = both.groupBy("id").agg(F.count("*").alias("k"))
    joined = triangle_counts(graph).join(k, "id", "left")
    pairs = F.col("k") * (F.col("k") - 1) / 2
    return joined.select("id", F.when(F.col("k") >= 2, F.col("triangles") / pairs).otherwise(0.0).alias("clustering"))


def approximate_clustering(graph: PropertyGraph, pairs: int = 100) -> DataFrame:
    """(id, clustering) from each node's first ``pairs`` neighbour pairs (ids ascending) where it has more."""
    import math

    # k neighbours are enough to form the first `pairs` pairs in (first, second) order: 1 + pairs of them
    from pyspark.sql import Window as W

    near = graph.both.where("src <> dst")
    ranked = near.withColumn("r", F.row_number().over(W.partitionBy("src").orderBy("dst")))
    size = near.groupBy("src").agg(F.count("*").alias("k"))
    head = ranked.where(F.col("r") <= pairs + 1).join(size, "src")
    left = head.select("src", "k", F.col("dst").alias("u"), F.col("r").alias("i"))
    right = head.select("src", F.col("dst").alias("v"), F.col("r").alias("j"))
    place = (F.col("i") - 1) * (2 * F.col("k") - F.col("i")) / 2 + F.col("j") - F.col("i")
    chosen = left.where(F.col("i") <= math.isqrt(2 * pairs) + 2).join(right, "src").where("i < j").where(place <= pairs)
    known = canonical_edges(graph).withColumn("hit", F.lit(1.0))
    low, high = F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")
    hits = chosen.select("src", low, high).join(known, ["a", "b"], "left")
    mean = hits.groupBy("src").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("c"))
    joined = graph.nodes.select("id").join(mean, F.col("id") == F.col("src"), "left")
    return joined.select("id", F.coalesce("c", F.lit(0.0)).alias("clustering"))


def local_density(graph: PropertyGraph) -> DataFrame:
    """(id, density): share of a node's out-neighbour pairs (smaller id first) with an edge in that direction."""
    arcs = graph.arcs.select("src", "dst").where("src <> dst")
    a = arcs.select("src", F.col("dst").alias("u"))
    b = arcs.select("src", F.col("dst").alias("v"))
    if graph.directed:
        forward = graph.edges.where("src < dst").select(F.col("src").alias("u"), F.col("dst").alias("v"))
        linked = forward.join(a, "u").join(b, ["src", "v"]).groupBy("src").agg(F.count("*").alias("t"))
    else:
        linked = triangle_counts(graph).select(F.col("id").alias("src"), F.col("triangles").alias("t"))
    k = arcs.groupBy("src").agg(F.count("*").alias("k"))
    pairs = F.col("k") * (F.col("k") - 1) / 2
    joined = graph.nodes.select("id").join(k, F.col("id") == F.col("src"), "left").drop("src")
    joined = joined.join(linked, F.col("id") == F.col("src"), "left")
    value = F.when(F.col("k") >= 2, F.coalesce("t", F.lit(0)) / pairs).otherwise(0.0)
    return joined.select("id", value.alias("density"))


def entropy(share: Column) -> Column:
    """Shannon entropy in bits of a column of shares, as an aggregate."""
    return -F.sum(F.when(share > 0, share * F.log2(share)).otherwise(0.0))


def type_entropy(graph: PropertyGraph, type_of: Column | None = None) -> DataFrame:
    """(id, entropy): entropy of the types of a node's out-neighbours over the number of types; 0 for one type."""
    kind = F.coalesce(type_of if type_of is not None else F.col("type"), F.lit("default"))
    types = graph.nodes.select(F.col("id").alias("dst"), kind.alias("kind"))
    counts = graph.arcs.select("src", "dst").join(types, "dst").groupBy("src", "kind").agg(F.count("*").alias("c"))
    totals = counts.groupBy("src").agg(
        F.sum("c").alias("n"), F.count("*").alias("kinds"), F.sum(F.col("c") * F.log2("c")).alias("clog")
    )
    bits = F.log2("n") - F.col("clog") / F.col("n")
    value = F.when((F.col("n") > 1) & (F.col("kinds") > 1), bits / F.log2("kinds")).otherwise(0.0)
    joined = graph.nodes.select("id").join(totals, F.col("id") == F.col("src"), "left")
    return joined.select("id", F.coalesce(value, F.lit(0.0)).alias("entropy"))


def degree_histogram(graph: PropertyGraph) -> DataFrame:
    """(degree, n) with zeros for the degrees between that no node has."""
    counted = graph.degrees().groupBy(F.col("out_deg").alias("degree")).agg(F.count("*").alias("n"))
    span = counted.agg(F.max("degree").alias("top")).select(F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("degree"))
    return span.join(counted, "degree", "left").select("degree", F.coalesce("n", F.lit(0)).alias("n"))


def degree_stats(graph: PropertyGraph) -> DataFrame:
    d = F.col("out_deg")
    return graph.degrees().agg(F.min(d).alias("least"), F.max(d).alias("greatest"), F.avg(d).alias("mean"))
