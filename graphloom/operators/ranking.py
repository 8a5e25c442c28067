"""Path ranking: PARSE (geometric mean of link similarity) and baselines.

Paths are (path_id, nodes ARRAY<STRING>). Hops are scored once per different pair and joined back, so a link shared by
many paths costs one similarity.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import linalg
from graphloom.operators.similarity import EPSILON, pair_similarity
from graphloom.plans.draws import BITS, drawn
from graphloom.plans.lineage import cut
from graphloom.sources.graph import PropertyGraph


def hops(paths: DataFrame) -> DataFrame:
    """(path_id, u, v): consecutive nodes of every path."""
    size = F.size("nodes")
    steps = F.when(size > 1, F.transform(F.sequence(F.lit(0), F.greatest(size - 2, F.lit(0))), _hop)).otherwise(F.array())
    return paths.select("path_id", F.explode(steps).alias("h")).select("path_id", "h.u", "h.v")


def _hop(i: Column) -> Column:
    return F.struct(F.get("nodes", i).alias("u"), F.get("nodes", i + 1).alias("v"))


#: A similarity of the caller's own: a graph and pairs (u, v) to (u, v, mi).
Similarity = Callable[[PropertyGraph, DataFrame], DataFrame]


def scored_hops(graph: PropertyGraph, paths: DataFrame, variant: str | Similarity, epsilon: float = EPSILON) -> DataFrame:
    """(u, v, path_id, mi): every hop with its similarity, each different pair scored once."""
    steps = hops(paths)
    pairs = steps.select("u", "v").distinct()
    if callable(variant):
        return steps.join(variant(graph, pairs).select("u", "v", "mi"), ["u", "v"])
    scores = pair_similarity(graph, pairs, (variant,), epsilon)
    return steps.join(scores.withColumnRenamed(variant, "mi"), ["u", "v"])


def parse(graph: PropertyGraph, paths: DataFrame, variant: str | Similarity = "jaccard", epsilon: float = EPSILON) -> DataFrame:
    """(path_id, nodes, salience): geometric mean over hops of max(epsilon, similarity), within [epsilon, 1].

    ``variant`` names a similarity or is one.
    """
    logs = F.avg(F.ln(F.greatest("mi", F.lit(epsilon))))
    mean = scored_hops(graph, paths, variant, epsilon).groupBy("path_id").agg(F.exp(logs).alias("mean"))
    kept = F.least(F.greatest(F.coalesce("mean", F.lit(epsilon)), F.lit(epsilon)), F.lit(1.0))
    return paths.join(mean, "path_id", "left").select("path_id", "nodes", kept.alias("salience"))


def parse_stats(ranked: DataFrame) -> DataFrame:
    """One row: paths_ranked, mean, median, max and min salience; zeros for no paths."""
    s = F.col("salience")
    named = {"mean": F.avg(s), "median": F.median(s), "max": F.max(s), "min": F.min(s)}
    values = [F.coalesce(e, F.lit(0.0)).alias(f"{k}_salience") for k, e in named.items()]
    return ranked.agg(F.count("*").alias("paths_ranked"), *values)


def normalised(scored: DataFrame, include_scores: bool = True) -> DataFrame:
    """(path_id, nodes, score): scores over their maximum; all 0 where that is 0 or not finite."""
    if not include_scores:
        return scored.select("path_id", "nodes", "score")
    top = scored.agg(F.max("score").alias("top"))
    fine = (F.col("top") > 0) & (F.col("top") < float("inf"))
    value = F.when(fine, F.col("score") / F.col("top")).otherwise(0.0)
    return scored.crossJoin(F.broadcast(top)).select("path_id", "nodes", value.alias("score"))


def _sum_over_nodes(paths: DataFrame, values: DataFrame) -> DataFrame:
    """``values`` (id, x) summed over each path's node occurrences."""
    each = paths.select("path_id", F.explode("nodes").alias("id")).join(values, "id")
    sums = each.groupBy("path_id").agg(F.sum("x").alias("s"))
    return paths.join(sums, "path_id", "left").select("path_id", "nodes", F.coalesce("s", F.lit(0.0)).cast("double").alias("score"))


def _by_ends(paths: DataFrame, scores: DataFrame) -> DataFrame:
    """``scores`` (u, v, score) of each path's first and last node."""
    ends = paths.select("*", F.get("nodes", F.lit(0)).alias("u"), F.get("nodes", F.size("nodes") - 1).alias("v"))
    return ends.join(scores, ["u", "v"], "left").select("path_id", "nodes", F.coalesce("score", F.lit(0.0)).alias("score"))


def _ends(paths: DataFrame) -> DataFrame:
    ends = paths.where(F.size("nodes") > 0).select(
        F.get("nodes", F.lit(0)).alias("u"), F.get("nodes", F.size("nodes") - 1).alias("v")
    )
    return ends.distinct()


def shortest(graph: PropertyGraph, paths: DataFrame) -> DataFrame:
    size = F.size("nodes")
    return paths.select("path_id", "nodes", F.when(size > 0, 1.0 / size).otherwise(0.0).alias("score"))


def degree_sum(graph: PropertyGraph, paths: DataFrame) -> DataFrame:
    return _sum_over_nodes(paths, graph.degrees().select("id", F.col("out_deg").alias("x")))


def _over_hops(graph: PropertyGraph, paths: DataFrame, agg: Callable[[str], Column]) -> DataFrame:
    found = scored_hops(graph, paths, "jaccard", EPSILON).groupBy("path_id").agg(agg("mi").alias("s"))
    return paths.join(found, "path_id", "left").select("path_id", "nodes", F.coalesce("s", F.lit(1.0)).alias("score"))


def widest_path(graph: PropertyGraph, paths: DataFrame) -> DataFrame:
    return _over_hops(graph, paths, F.min)


def jaccard_arithmetic(graph: PropertyGraph, paths: DataFrame) -> DataFrame:
    return _over_hops(graph, paths, F.avg)


def pagerank(graph: PropertyGraph, paths: DataFrame, **options) -> DataFrame:
    return _sum_over_nodes(paths, linalg.pagerank(graph, **options).withColumnRenamed("rank", "x"))


def betweenness(graph: PropertyGraph, paths: DataFrame, **options) -> DataFrame:
    return _sum_over_nodes(paths, linalg.betweenness(graph, **options).withColumnRenamed("betweenness", "x"))


def katz(graph: PropertyGraph, paths: DataFrame) -> DataFrame:
    return _by_ends(paths, linalg.katz(graph, _ends(paths)))


def communicability(graph: PropertyGraph, paths: DataFrame) -> DataFrame:
    return _by_ends(paths, linalg.communicability(graph, _ends(paths)))


def resistance(graph: PropertyGraph, paths: DataFrame, error: float | None = None) -> DataFrame:
    """By 1 / r of the ends: r exact, or with ``error`` from a sketch whose cost does not grow with the pairs."""
    from graphloom.operators import dense

    ends = _ends(paths)
    found = dense.resistance(graph, ends) if error is None else dense.sketched_resistance(graph, ends, error)
    return _by_ends(paths, found.select("u", "v", F.when(F.col("r") > 0, 1 / F.col("r")).otherwise(0.0).alias("score")))


def hitting_time(graph: PropertyGraph, paths: DataFrame) -> DataFrame:
    from graphloom.operators import dense

    scores = dense.hitting_time(graph, _ends(paths)).select("u", "v", F.when(F.col("h") > 0, 1 / F.col("h")).otherwise(0.0).alias("score"))
    return _by_ends(paths, scores)


def random_ranking(graph: PropertyGraph, paths: DataFrame, seed: int = 0) -> DataFrame:
    """A hash of the node list and the seed, in [0, 1)."""
    h = drawn(F.array_join("nodes", ","), seed=seed)
    return paths.select("path_id", "nodes", (h / float(1 << BITS)).alias("score"))


BASELINES: dict[str, Callable[[PropertyGraph, DataFrame], DataFrame]] = {
    f.__name__: f
    for f in (
        shortest,
        degree_sum,
        widest_path,
        jaccard_arithmetic,
        pagerank,
        betweenness,
        katz,
        communicability,
        resistance,
        hitting_time,
        random_ranking,
    )
}


def rank(graph: PropertyGraph, paths: DataFrame, method: str, include_scores: bool = True, **options) -> DataFrame:
    """(path_id, nodes, score) by a baseline, normalised by the largest score; order by score descending, path_id.

    ``options`` go to the baseline's measure: iterations and tolerance of pagerank, sources of betweenness.
    """
    scored = BASELINES[method](graph, paths, **options)
    return normalised(cut(scored, "scores"), include_scores)
