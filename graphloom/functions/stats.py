"""Entropies, standardisation and k-means as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.draws import BITS, drawn


def shannon_entropy(shares: Column) -> Column:
    """Entropy in bits of an array of shares; shares of 0 or less count nothing."""
    return F.aggregate(shares, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def normalised_entropy(shares: Column) -> Column:
    """Entropy over its maximum for the array's length; 0 for one share or none."""
    return F.when(F.size(shares) > 1, shannon_entropy(shares) / F.log2(F.size(shares))).otherwise(0.0)


def entropy_of_counts(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c)
    shares = F.transform(counts, lambda c: c / total)
    return F.when(total > 0, shannon_entropy(shares)).otherwise(0.0)


def z_scores(df: DataFrame, *columns: str, slack: float = 1e-10) -> DataFrame:
    """The columns standardised by mean and population variance (plus ``slack``)."""
    aggs = [e for c in columns for e in (F.avg(c).alias(f"{c}__m"), F.var_pop(c).alias(f"{c}__v"))]
    wide = df.crossJoin(F.broadcast(df.agg(*aggs)))
    scaled = [((F.col(c) - F.col(f"{c}__m")) / F.sqrt(F.col(f"{c}__v") + slack)).alias(c) for c in columns]
    return wide.select(*(c for c in df.columns if c not in columns), *scaled)


def mean_vector(df: DataFrame, *columns: str) -> DataFrame:
    """One row of column means; zeros for no rows."""
    return df.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)


def assign(points: DataFrame, centroids: DataFrame, squared: bool = True) -> DataFrame:
    """(id, cluster, distance): nearest of ``centroids`` (cluster, centre), ties to the smallest cluster.

    The centroids, a stated small set, are folded into one array that every row carries; no pairs are made.
    """
    folded = centroids.agg(F.array_sort(F.collect_list(F.struct("cluster", "centre"))).alias("centres"))
    each = lambda c: F.struct(squared_distance(F.col("v"), c["centre"]).alias("d"), c["cluster"].alias("cluster"))
    best = F.array_min(F.transform("centres", each))
    rows = points.crossJoin(F.broadcast(folded)).select("id", best.alias("b"))
    distance = F.col("b.d") if squared else F.sqrt("b.d")
    return rows.select("id", F.col("b.cluster").alias("cluster"), distance.alias("distance"))


def update_centroids(points: DataFrame, assigned: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """(cluster, i, value): the mean of each cluster's points, one row per dimension.

    ``clusters`` (cluster) names all of them; those without points get zeros.
    """
    each = points.join(assigned.select("id", "cluster"), "id").select("cluster", F.posexplode("v").alias("i", "x"))
    means = each.groupBy("cluster", "i").agg(F.avg("x").alias("value"))
    if clusters is None:
        return means
    every = clusters.select("cluster").crossJoin(F.broadcast(each.select("i").distinct()))
    return every.join(means, ["cluster", "i"], "left").select("cluster", "i", F.coalesce("value", F.lit(0.0)).alias("value"))


def _centre_rows(spark, centres: list[list[float]]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(centres)), "cluster int, centre array<double>")


def plus_plus(points: DataFrame, k: int, seed: int = 42) -> list[list[float]]:
    """``k`` starting centres by k-means++, fewer where there are fewer different points.

    Each is the point with the least exponential time at a rate of its squared distance, which draws it with that
    weight in one aggregation; the times come from a hash, so reruns agree.
    """
    spark = points.sparkSession
    draw = lambda n: (drawn("id", F.lit(n), seed=seed) + 1) / float((1 << BITS) + 1)
    first = points.agg(F.min_by("v", draw(0)).alias("v")).first().v
    centres = [list(first)] if first is not None else []
    while centres and len(centres) < k:
        near = points.join(assign(points, _centre_rows(spark, centres)), "id").where("distance > 0")
        found = near.agg(F.min_by("v", -F.ln(draw(len(centres))) / F.col("distance")).alias("v")).first().v
        if found is None:
            break
        centres.append(list(found))
    return centres


def minibatch_kmeans(
    points: DataFrame, k: int, seed: int = 42, iterations: int = 100, tolerance: float = 1e-6
) -> tuple[DataFrame, list[list[float]]]:
    """(id, cluster, distance) of all points, and the centres, by mini-batches.

    A batch is about a tenth of the points, 10 at least, by hash; a centre moves to the mean of the batch's points that
    are nearest to it, one without any stays. Ends where no centre moves more than ``tolerance``. Only centres pass
    through the driver.
    """
    spark, n = points.sparkSession, points.count()
    centres = plus_plus(points, min(k, n), seed)
    share = min(1.0, max(10, n // 10) / max(n, 1))
    for step in range(iterations if centres else 0):
        chosen = drawn("id", F.lit(step), F.lit("batch"), seed=seed) < int(share * (1 << BITS))
        centres, shift = _moved(points.where(chosen), centres)
        if shift < tolerance:
            break
    return _placed(points, centres)


def _moved(points: DataFrame, centres: list[list[float]]) -> tuple[list[list[float]], float]:
    """Centres at the means of their points, those without any where they were, and the largest step."""
    out = [list(c) for c in centres]
    for r in update_centroids(points, assign(points, _centre_rows(points.sparkSession, centres))).collect():
        out[r.cluster][r.i] = r.value
    return out, max(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) ** 0.5 for a, b in zip(centres, out, strict=True))


def _placed(points: DataFrame, centres: list[list[float]]) -> tuple[DataFrame, list[list[float]]]:
    if not centres:
        return points.select("id", F.lit(0).alias("cluster"), F.lit(0.0).alias("distance")), centres
    return assign(points, _centre_rows(points.sparkSession, centres)), centres


def lloyd(
    points: DataFrame, k: int, seed: int = 42, iterations: int = 100, tolerance: float = 1e-6
) -> tuple[DataFrame, list[list[float]]]:
    """(id, cluster, distance) of all points, and the centres, by Lloyd's steps from a k-means++ start.

    A step assigns all points and averages each cluster, combined before the shuffle; only centres pass through the
    driver. Ends where no centre moves more than ``tolerance``.
    """
    centres = plus_plus(points, k, seed)
    for _ in range(iterations if centres else 0):
        centres, shift = _moved(points, centres)
        if shift < tolerance:
            break
    return _placed(points, centres)


def kmeans(points: DataFrame, k: int, seed: int = 42, iterations: int = 100) -> DataFrame:
    """(id, cluster) of ``points`` (id, v ARRAY<DOUBLE>) by ``lloyd``; all in cluster 0 where there are fewer than two."""
    if points.limit(2).count() < 2:
        return points.select("id", F.lit(0).alias("cluster"))
    return lloyd(points, k, seed, iterations)[0].select("id", "cluster")
