"""Components, metrics, statistics and streaming."""

import math
import random

from pyspark.sql import functions as F

from graphloom.functions import stats
from graphloom.operators import metrics
from graphloom.plans import connected_components, join_hot
from graphloom.streaming.degrees import stream_degrees
from tests.fixtures import build


def test_components_against_union_find(spark):
    r = random.Random(4)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(40)]
    above = {x: x for p in pairs for x in p}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        above[max(a, b)] = min(a, b)
    edges = spark.createDataFrame([*pairs, (None, 3), (7, 7)], "a long, b long")
    found = {x.node: x.component for x in connected_components(edges).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert found == {x: root(x) for x in linked}
    assert connected_components(edges.limit(0)).count() == 0
    assert {x.node: x.component for x in connected_components(edges, hot=3).collect()} == found


def test_join_hot(spark):
    many = spark.createDataFrame([(i % 3 and 7, i) for i in range(90)] + [(None, 1), (8, 2)], "k int, v int")
    one = many.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s")).where("k is null or k <> 8")
    for how in ("inner", "left"):
        plain = many.join(one.drop("n"), ["k"], how)
        for hot in (5, 1000):
            found = join_hot(many, one, ["k"], how=how, hot=hot)
            assert found.columns == plain.columns
            assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))


def test_metrics(spark):
    graph = build(spark, "three-community")
    paths = spark.createDataFrame([(["bob", "alice", "mia"],), (["bob", "alice", "emma", "mia"],), (["bob"],)], "nodes array<string>")
    assert metrics.path_diversity(paths).first().diversity == 2
    edges = spark.createDataFrame([("bob", "alice"), ("mia", "noah"), ("x", "y")], "src string, dst string")
    assert metrics.community_span(edges, paths).first().span == 2
    all_nodes = graph.nodes.select("id")
    assert 0 < metrics.hub_deferral_ratio(graph, all_nodes).first().ratio <= 1
    a = spark.createDataFrame([("p", 1.0), ("q", 2.0), ("r", 3.0)], "item string, score double")
    b = spark.createDataFrame([("p", 9.0), ("q", 5.0), ("r", 1.0)], "item string, score double")
    assert math.isclose(metrics.spearman(a, b).first().rho, -1.0) and metrics.kendall(a, b).first().tau == -1.0
    flat = spark.createDataFrame([("p", 1.0), ("q", 1.0), ("r", 1.0)], "item string, score double")
    assert metrics.spearman(a, flat).first().rho == 0.0 and metrics.kendall(a, flat).first().tau == -1.0
    assert metrics.spearman(a, b.where("item = 'p'")).first().rho == 1.0 == metrics.kendall(a, b.where("item = 'p'")).first().tau
    assert metrics.spearman(a, b.limit(0)).first().rho == 0.0 == metrics.kendall(a, b.limit(0)).first().tau
    ranked = spark.createDataFrame([(["a", "b"], 0.5), (["a", "b"], 0.5)], "nodes array<string>, salience double")
    assert tuple(metrics.score_spread(ranked).first()) == (0.0, 0.0)
    ranked = spark.createDataFrame([(["a", "b"], 0.5), (["a", "b", "c"], 0.25), (["a"], 0.75)], "nodes array<string>, salience double")
    spread = metrics.score_spread(ranked).first()
    assert math.isclose(spread.score_variance, 0.0625) and math.isclose(spread.length_bias, -1.0)
    assert metrics.mean_ratio(ranked, F.col("salience") < 0.4, F.col("salience") > 0.4).first().ratio == 0.4
    assert metrics.mean_ratio(ranked, F.col("salience") > 2, F.col("salience") > 3).first().ratio == 1.0
    assert metrics.mean_ratio(ranked, F.col("salience") > 0, F.col("salience") > 3).first().ratio == math.inf
    assert {r.id: r.salience for r in metrics.salience_counts(ranked).collect()} == {"a": 3, "b": 2, "c": 1}
    hops = spark.createDataFrame([("p", 0.5), ("p", 0.125), ("q", 0.0), ("q", 1.0)], "path_id string, mi double")
    assert {r.path_id: round(r.mi, 9) for r in metrics.path_mi(hops).collect()} == {"p": 0.25, "q": 0.0}


def test_kendall_against_all_pairs(spark):
    r = random.Random(9)
    xs = [(f"i{i}", float(r.randrange(12)), float(r.randrange(9))) for i in range(60)]
    frame = spark.createDataFrame(xs, "item string, x double, y double")
    sign = lambda v: (v > 0) - (v < 0)
    agree = sum(1 if sign(a[1] - b[1]) == sign(a[2] - b[2]) else -1 for i, a in enumerate(xs) for b in xs[:i])
    found = metrics.kendall(frame.selectExpr("item", "x as score"), frame.selectExpr("item", "y as score")).first().tau
    assert math.isclose(found, agree / (60 * 59 / 2))


def test_minibatch_kmeans(spark):
    r = random.Random(3)
    centres = [(0.0, 0.0, 0.0), (10.0, 0.0, 5.0), (0.0, 12.0, -5.0)]
    points = [(i, [c + r.gauss(0, 0.3) for c in centres[i % 3]]) for i in range(300)]
    frame = spark.createDataFrame(points, "id long, v array<double>").cache()
    assigned, found = stats.minibatch_kmeans(frame, 3, iterations=15)
    assert len(found) == 3
    for c in centres:
        assert min(math.dist(c, f) for f in found) < 1.0
    groups = {}
    for row in assigned.collect():
        groups.setdefault(row.cluster, set()).add(row.id % 3)
    assert len(groups) == 3 and all(len(g) == 1 for g in groups.values())
    again = stats.minibatch_kmeans(frame, 3, iterations=15)[1]
    assert all(math.dist(a, b) < 1e-9 for a, b in zip(found, again, strict=True))
    few = stats.minibatch_kmeans(frame.where("id < 2"), 5, iterations=2)[1]
    assert len(few) == 2 and stats.minibatch_kmeans(frame.limit(0), 3)[1] == []
    empty = stats.update_centroids(frame.where("id < 3"), frame.selectExpr("id", "0 as cluster"), spark.createDataFrame([(0,), (1,)], "cluster int"))
    assert {r.value for r in empty.where("cluster = 1").collect()} == {0.0} and empty.where("cluster = 0").count() == 3


def test_entropies(spark):
    row = spark.range(1).select(
        stats.shannon_entropy(F.array(F.lit(0.5), F.lit(0.5), F.lit(0.0))).alias("a"),
        stats.normalised_entropy(F.array(F.lit(0.25), F.lit(0.25), F.lit(0.25), F.lit(0.25))).alias("b"),
        stats.normalised_entropy(F.array(F.lit(1.0))).alias("c"),
        stats.entropy_of_counts(F.array(F.lit(0.0), F.lit(0.0))).alias("d"),
    ).first()
    assert (row.a, row.b, row.c, row.d) == (1.0, 1.0, 0.0, 0.0)


def test_stream_degrees(spark, tmp_path):
    folder = str(tmp_path / "edges")
    rows = [("2024-01-01 00:00:01", "a", "b"), ("2024-01-01 00:00:02", "b", "c"), ("2024-01-01 00:00:03", "a", "a")]
    frame = spark.createDataFrame(rows, "ts string, src string, dst string").withColumn("ts", F.to_timestamp("ts"))
    frame.write.parquet(folder)
    stream = spark.readStream.schema(frame.schema).parquet(folder)
    query = (
        stream_degrees(stream)
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName("degrees")
        .option("checkpointLocation", str(tmp_path / "state"))
        .start()
    )
    query.processAllAvailable()
    query.stop()
    assert {r.id: r.degree for r in spark.table("degrees").collect()} == {"a": 2, "b": 2, "c": 1}
    windowed = {(r.id, r.degree) for r in stream_degrees(frame, window="1 minute").collect()}
    assert windowed == {("a", 2), ("b", 2), ("c", 1)}


def test_numbering(spark):
    from graphloom.plans import numbered

    rows = [(f"n{i:03d}", "a" if i % 3 else None) for i in range(100)]
    frame = spark.createDataFrame(rows, "id string, g string").repartition(5)
    assert {(r.id, r.k) for r in numbered(frame).collect()} == {(f"n{i:03d}", i) for i in range(100)}
    found = {r.id: r.k for r in numbered(frame, "g").collect()}
    for group in ("a", None):
        names = sorted(i for i, g in rows if g == group)
        assert [found[n] for n in names] == list(range(len(names)))
