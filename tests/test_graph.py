"""Graph operators against golden values and brute force."""

import itertools
import math
from collections import Counter

import pytest

from graphloom.operators import dense, explore, extract, linalg, neighbours, ranking, seeds, similarity, traversal
from graphloom.sources import PropertyGraph
from tests.fixtures import GOLDENS, build, edges


def one(df):
    return df.first()


@pytest.mark.parametrize("name", ["social-hub", "three-community", "quality-vs-popularity"])
def test_whole_graph_goldens(spark, name):
    graph = build(spark, name).settled()
    n, m, density, triangles, clustering, core2, core3, truss3, motifs = GOLDENS[name]
    row = one(graph.density())
    assert (row.n, row.m) == (n, m) and math.isclose(row.density, density, abs_tol=1e-6)
    assert neighbours.triangles(graph).count() == triangles
    values = [r.clustering for r in neighbours.clustering(graph).collect()]
    assert math.isclose(sum(values) / n, clustering, abs_tol=1e-6)
    assert extract.k_core(graph, 2).nodes.count() == core2
    assert extract.k_core(graph, 3).nodes.count() == core3
    assert extract.k_truss(graph, 3).edges.count() == truss3
    found = {r.pattern: r["count"] for r in extract.motif_census(graph, 3).collect()}
    assert tuple(found.get(p, 0) for p in ("", "0-1", "0-1,0-2", "0-1,0-2,1-2")) == motifs


def slow_census(name):
    pairs = {frozenset(e) for e in edges(name)}
    ids = sorted({x for e in pairs for x in e})
    counts = Counter()
    for four in itertools.combinations(ids, 4):
        best = None
        for order in itertools.permutations(range(4)):
            own = sorted(f"{min(order[i], order[j])}-{max(order[i], order[j])}" for i, j in itertools.combinations(range(4), 2) if frozenset((four[i], four[j])) in pairs)
            best = min(best, ",".join(own)) if best is not None else ",".join(own)
        counts[best] += 1
    return counts


def test_motif4(spark):
    found = {r.pattern: r["count"] for r in extract.motif_census(build(spark, "two-department"), 4).collect()}
    assert found == dict(slow_census("two-department"))
    assert extract.motif_name("0-1,0-2,0-3,1-2") == "paw" and extract.motif_name("?") == "?"


def test_motif_instances_match_the_census(spark):
    graph = build(spark, "two-department").settled()
    for size in (3, 4):
        census = {r.pattern: r["count"] for r in extract.motif_census(graph, size).collect()}
        for pattern, name in extract.MOTIF_NAMES[size].items():
            places = {x for e in pattern.split(",") for x in e.split("-")}
            if name in ("empty", "1-edge", "matching") or len(places) < size:
                continue
            rows = extract.motif_instances(graph, pattern).collect()
            assert len(rows) == census.get(pattern, 0) and all(len(set(r.nodes)) == size for r in rows), pattern
    names = {extract.motif_name(p) for p in ("", "0-1", "0-1,0-2", "0-1,0-2,1-2", "0-1,0-2,1-3,2-3", "0-1,0-2,0-3,1-2,1-3,2-3")}
    assert names == {"empty", "1-edge", "2-star", "triangle", "4-cycle", "K4"}
    with pytest.raises(ValueError):
        extract.motif_instances(graph, "0-1,2-3")


def test_ensemble_tables():
    listed = {n: [(c, w, blind) for c, w, blind in parts] for n, (parts, _) in seeds.ENSEMBLES.items()}
    blind = ["stride", "crest", "spine", "grasp", "degree_diverse"]
    assert [c for c, _, _ in listed["prism"]] == [*blind, "max_distance", "crisp"]
    assert [c for c, _, _ in listed["omnia"]] == [*blind, "crisp", "max_distance", "community_bridge"]
    assert [c for c, _, _ in listed["basil"]] == [*blind, "crisp"]
    assert sorted(c for c, _, _ in listed["brisk"]) == sorted(blind)
    assert [w for _, w, _ in listed["omnia"]] == [1.0, 1.0, 0.9, 0.8, 0.7, 0.85, 0.9, 0.9]
    assert [w for _, w, _ in listed["prism"]] == [1.0, 1.0, 0.9, 0.8, 0.7, 0.7, 0.8]
    assert [w for _, w, _ in listed["basil"]] == [1.0, 1.0, 0.95, 0.85, 0.6, 0.25]
    for parts in listed.values():
        assert all(b == (c in blind) for c, _, b in parts)
    assert {n: bias for n, (_, bias) in seeds.ENSEMBLES.items()} == {"brisk": 0.1, "basil": 0.2, "prism": 0.1, "omnia": 0.05}


def test_resistance_against_the_inverse(spark):
    import numpy as np

    graph = build(spark, "three-community")
    more = PropertyGraph(
        graph.nodes.select("id", "type", "weight").union(spark.createDataFrame([("x", None, 1.0), ("y", None, 1.0), ("z", None, 1.0)], "id string, type string, weight double")),
        graph.edges.select("src", "dst", "type", "weight").union(spark.createDataFrame([("x", "y", None, 1.0)], "src string, dst string, type string, weight double")),
    )
    ids = sorted({x for e in edges("three-community") for x in e})
    at = {x: i for i, x in enumerate(ids)}
    a = np.zeros((len(ids), len(ids)))
    for x, y in edges("three-community"):
        a[at[x], at[y]] = a[at[y], at[x]] = 1.0
    inverse = np.linalg.pinv(np.diag(a.sum(1)) - a)
    asked = [("bob", "mia"), ("mia", "bob"), ("alice", "bob"), ("bob", "bob"), ("x", "y"), ("x", "bob"), ("bob", "nobody"), ("z", "x")]
    found = {(r.u, r.v): r.r for r in dense.resistance(more, spark.createDataFrame(asked, "u string, v string")).collect()}
    for u, v in asked[:3]:
        i, j = at[u], at[v]
        assert math.isclose(found[u, v], inverse[i, i] + inverse[j, j] - 2 * inverse[i, j], rel_tol=1e-6), (u, v)
    assert found["bob", "bob"] == 1e-10 and math.isclose(found["x", "y"], 1.0, rel_tol=1e-6) and found["bob", "nobody"] == 0.0
    assert math.isclose(found["x", "bob"], (1 / 2 + 1 / 17) * 1e10) and math.isclose(found["z", "x"], 1.5e10)


def test_pair_distances_and_diverse_blocks(spark):
    graph = build(spark, "three-community").settled()
    ids = sorted(r.id for r in graph.nodes.collect())
    table = [(a, b) for a in ids for b in ids if a < b]
    pairs = spark.createDataFrame(table, "source string, target string")
    found = {(r.source, r.target): r.dist for r in seeds.pair_distances(graph, pairs, 5).collect()}
    near = {x: {y for e in edges("three-community") for y in e if x in e and y != x} for x in ids}
    for a, b in table:
        level, seen, d = {a}, {a}, 0
        while level and b not in level:
            level = {y for x in level for y in near[x]} - seen
            seen |= level
            d += 1
        assert found.get((a, b)) == (d if level and d <= 5 else None), (a, b)
    ranked = pairs.selectExpr("source", "target", "cast(crc32(concat(source, target)) % 97 as double) as score")
    order = sorted((-r.score, r.source, r.target) for r in ranked.collect())
    alike = lambda x, y: len(near[x] & near[y]) >= 0.5 * len(near[x] | near[y])
    wanted = []
    for _, s, t in order:
        if len(wanted) < 6 and not any(alike(s, a) and alike(t, b) for a, b in wanted):
            wanted.append((s, t))
    for pool in (1, 50):
        assert sorted((r.source, r.target) for r in seeds.diverse(graph, ranked, 6, pool=pool).collect()) == sorted(wanted)


def test_similarity_goldens(spark):
    graph = build(spark, "two-department")
    pairs = spark.createDataFrame([("alice", "bob"), ("carol", "frank"), ("alice", "nobody")], "u string, v string")
    rows = {(r.u, r.v): r for r in similarity.pair_similarity(graph, pairs, ("jaccard", "adamic_adar", "cosine", "etch")).collect()}
    assert math.isclose(rows["alice", "bob"].jaccard, 2 / 3) and math.isclose(rows["carol", "frank"].jaccard, 1 / 3)
    assert math.isclose(rows["alice", "bob"].adamic_adar, 0.3934418725907076)
    assert rows["alice", "nobody"].cosine == 0.0 and rows["alice", "nobody"].jaccard == 1e-10


def test_parse_and_baselines(spark):
    graph = build(spark, "quality-vs-popularity").settled()
    table = [("p", ["source", "fame_connector", "target"]), ("q", ["source", "specialist1", "specialist2", "target"]), ("r", ["source"])]
    paths = spark.createDataFrame(table, "path_id string, nodes array<string>")
    found = {r.path_id: r.salience for r in ranking.parse(graph, paths).collect()}
    assert math.isclose(found["p"], 1e-10) and math.isclose(found["q"], 0.0001493801582185723) and found["r"] == 1e-10
    degrees = {r.path_id: r.score for r in ranking.degree_sum(graph, paths).collect()}
    assert (degrees["p"], degrees["q"]) == (11, 14)
    top = {r.path_id: r.score for r in ranking.rank(graph, paths, "shortest").collect()}
    assert top["r"] == 1.0 and math.isclose(top["p"], 1 / 3)


def test_chain_measures(spark):
    graph = build(spark, "linear-chain").settled()
    ends = spark.createDataFrame([("A", "E")], "u string, v string")
    assert math.isclose(one(linalg.katz(graph, ends)).score, 6.25e-10)
    assert math.isclose(one(linalg.communicability(graph, ends)).score, 0.0475559225689434)
    assert math.isclose(one(dense.hitting_time(graph, ends)).h, 16)
    assert math.isclose(one(dense.resistance(graph, ends)).r, 4, abs_tol=1e-3)
    ranks = {r.id: r["rank"] for r in linalg.pagerank(graph).collect()}
    assert math.isclose(ranks["A"], 0.134527027, abs_tol=1e-5) and math.isclose(ranks["B"], 0.245945946, abs_tol=1e-5)
    found = {r.id: r.betweenness for r in linalg.betweenness(graph).collect()}
    assert [found[x] for x in "ABCDE"] == [0, 6, 8, 6, 0]


def test_traversal(spark):
    graph = build(spark, "linear-chain")
    start = spark.createDataFrame([("C",), ("X",)], "id string")
    rows = {(r.node): (r.depth, r.parent) for r in traversal.bfs(graph, start).collect()}
    assert rows == {"C": (0, None), "B": (1, "C"), "D": (1, "C"), "A": (2, "B"), "E": (2, "D")}
    order = [r.node for r in traversal.dfs(graph, start).orderBy("step").collect()]
    assert order == ["C", "B", "A", "D", "E"]
    with pytest.raises(ValueError):
        traversal.bfs_levels(graph, "nobody")
    ego = traversal.ego_network(graph, "C", 1)
    assert sorted(r.id for r in ego.nodes.collect()) == ["B", "C", "D"] and ego.edges.count() == 2
    ends = spark.createDataFrame([(0, "A"), (1, "E")], "pos int, id string")
    paths, _ = traversal.k_hop(graph, ends, 2)
    assert [r.nodes for r in paths.collect()] == [["A", "B", "C", "D", "E"]]


def test_store(spark):
    nodes = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "id string, type string, seq int")
    pairs = spark.createDataFrame([("b", "a", 1.0, 1), ("a", "b", 2.0, 2)], "src string, dst string, weight double, seq int")
    graph = PropertyGraph.build(nodes, pairs)
    assert {(r.id, r.type) for r in graph.nodes.collect()} == {("a", "x"), ("b", "x")}
    assert [(r.src, r.dst, r.weight) for r in graph.edges.collect()] == [("a", "b", 2.0)]
    both = PropertyGraph.build(nodes, pairs, directed=True)
    assert {(r.deg_both, r.n_both) for r in both.degrees().collect()} == {(2, 1)}
    with pytest.raises(ValueError):
        graph.add_edges(spark.createDataFrame([("a", "zz")], "src string, dst string"))
    assert graph.remove_nodes(spark.createDataFrame([("a",)], "id string")).edges.count() == 0
    assert graph.remove_edges(spark.createDataFrame([("b", "a")], "src string, dst string")).edges.count() == 0
    assert {r.n for r in graph.violations().collect()} == {0}
    found = graph.lookup_nodes(spark.createDataFrame([("a",), ("zz",)], "id string")).collect()
    assert {(r.id, r.type, r.found) for r in found} == {("a", "x", True), ("zz", None, False)}
    bad = PropertyGraph(
        spark.createDataFrame([("", 1.0), ("a", -1.0), ("a", 1.0), (None, 1.0)], "id string, weight double"),
        spark.createDataFrame([("a", "zz", -2.0), ("a", "zz", 1.0)], "src string, dst string, weight double"),
    )
    assert {r.rule: r.n for r in bad.violations().collect()} == {
        "empty node id": 2,
        "negative node weight": 1,
        "negative edge weight": 1,
        "unknown endpoint": 2,
        "repeated node": 1,
        "repeated edge": 1,
    }


def test_tables_round_trip(spark, tmp_path):
    graph = build(spark, "linear-chain", types={"A": "x"})
    folder = "file://" + str(tmp_path / "graph")
    graph.write_parquet(folder)
    again = PropertyGraph.from_parquet(spark, folder)
    for a, b in ((graph.nodes, again.nodes), (graph.edges, again.edges)):
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    into = build(spark, "linear-chain", directed=True).neighbours("in").collect()
    assert {(r.src, r.dst) for r in into} == {("B", "A"), ("C", "B"), ("D", "C"), ("E", "D")}


def test_own_similarity(spark):
    graph = build(spark, "linear-chain")
    paths = spark.createDataFrame([("p", ["A", "B", "C"])], "path_id string, nodes array<string>")
    half = lambda g, pairs: pairs.selectExpr("u", "v", "if(u = 'A', 0.25, 1.0) as mi")
    assert math.isclose(one(ranking.parse(graph, paths, half)).salience, 0.5)


def test_clustering_of_some(spark):
    graph = build(spark, "social-hub")
    some = spark.createDataFrame([("alice",), ("bob",), ("nobody",)], "id string")
    every = {r.id: r.clustering for r in neighbours.clustering(graph).collect()}
    assert {r.id: r.clustering for r in neighbours.clustering(graph, some).collect()} == {x: every[x] for x in ("alice", "bob")}

def test_random_walk_is_repeatable(spark):
    graph = build(spark, "social-hub").settled()
    start = spark.createDataFrame([(1, 0, "bob"), (1, 1, "kate")], "seed_set_id long, pos int, id string")
    a, b = (explore.random_walk(graph, start, 3, 6)[0] for _ in range(2))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() == 2 * 3 * 7


def test_truss_numbers(spark):
    found = {(r.a, r.b): r.truss for r in extract.truss_numbers(build(spark, "two-department")).collect()}
    assert found["alice", "bob"] == 4 and min(found.values()) >= 2


def test_selectors(spark):
    graph = build(spark, "three-community").settled()
    for f in (seeds.stride, seeds.crest, seeds.spine):
        pairs = f(graph, 5).collect()
        assert len(pairs) == 5 and all(r.source != r.target for r in pairs), f.__name__
    rows, empty = seeds.stratified(
        PropertyGraph(graph.nodes.selectExpr("id", "if(id < 'h', 'x', 'y') as type", "weight"), graph.edges),
        __import__("pyspark").sql.functions.col("type"),
        {"same": __import__("pyspark").sql.functions.expr("field_a = field_b"), "none": __import__("pyspark").sql.functions.lit(False)},
    )
    assert empty == ["none"] and rows.count() == 10 and all(r.same_field for r in rows.collect())


def test_stratified_with_many_fields(spark):
    """100000 fields: pairs of equal fields come from an equi-join, draws by running sums; reruns agree."""
    from pyspark.sql import functions as F

    nodes = spark.range(200_000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 100_000).cast("string").alias("type"), F.lit(1.0).alias("weight"))
    none = spark.createDataFrame([], "src string, dst string, type string, weight double")
    graph = PropertyGraph(nodes, none)
    runs = [seeds.stratified(graph, F.col("type"), {"same": F.col("field_a") == F.col("field_b")}, 25)[0].collect() for _ in range(2)]
    assert len(runs[0]) == 25 and sorted(runs[0]) == sorted(runs[1])
    assert all(r.same_field and r.source != r.target and int(r.source) % 100_000 == int(r.target) % 100_000 for r in runs[0])
    assert len({r.source for r in runs[0]}) > 15
