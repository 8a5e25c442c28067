"""Explorations by joins against one exploration after the other in plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import explore
from tests import slow_explore
from tests.fixtures import build, edges

SETS = {
    "three-community": {1: ["bob", "noah"], 2: ["bob", "grace", "mia"], 3: ["alice", "alice"], 4: ["kate", "ghost"]},
    "quality-vs-popularity": {1: ["source", "target"], 2: ["hub_leaf1", "sp2_peer2"]},
}


def seeds(spark, sets):
    rows = [(s, p, i) for s, ids in sets.items() for p, i in enumerate(ids)]
    return spark.createDataFrame(rows, "seed_set_id long, pos int, id string")


def local(graph, name):
    """The graph for the slow form, with the entropies, densities and hashes that Spark computes."""
    pairs = {frozenset(e) for e in edges(name)}
    ids = sorted({x for p in pairs for x in p})
    at = {v: i for i, v in enumerate(ids)}
    near = [np.array(sorted(at[y] for p in pairs for y in p if x in p and y != x)) for x in ids]
    rows = {r.node: r for r in explore.node_features(graph, "hae").withColumn("r", explore.hashed_priority(0)).collect()}
    dense = {r.node: r.density for r in explore.node_features(graph, "flux").collect()}
    made = slow_explore.Local(ids, near, [rows[i].entropy for i in ids], [dense[i] for i in ids], [rows[i].r for i in ids] + [0.5])
    return made


def rounded(paths):
    return sorted(map(str, paths))


@pytest.fixture(scope="module")
def graphs(spark):
    out = {}
    for name in SETS:
        ids = sorted({x for e in edges(name) for x in e})
        graph = build(spark, name, types={x: "abc"[i % 3] for i, x in enumerate(ids)}).settled()
        out[name] = graph, local(graph, name)
    return out


def check(spark, graphs, name, algorithm, config, exact=False):
    graph, slow = graphs[name]
    found = explore.explore(graph, seeds(spark, SETS[name]), algorithm, config)
    paths, visited, sampled, stats = (x.collect() for x in (found.paths, found.visited, found.sampled_edges, found.stats))
    for number, ids in SETS[name].items():
        wanted = slow_explore.run(slow, ids, slow_explore.PRIORITIES[algorithm], config, algorithm in explore.FAIR)
        own = [(r.from_frontier, r.to_frontier, r.nodes) for r in paths if r.seed_set_id == number]
        assert rounded(own) == rounded(wanted["paths"]), (name, algorithm, number)
        order = [(r.frontier, r.id) for r in sorted(visited, key=lambda r: r.turn) if r.seed_set_id == number]
        assert sorted(order) == sorted(wanted["nodes"]), (name, algorithm, number)
        assert not exact or order == wanted["order"], (name, algorithm, number)
        assert sorted((r.src, r.dst) for r in sampled if r.seed_set_id == number) == wanted["edges"]
        row = next(r for r in stats if r.seed_set_id == number)
        assert {k: row[k] for k in wanted["stats"]} == wanted["stats"] and row.termination == wanted["termination"], (algorithm, number)


@pytest.mark.parametrize("algorithm", sorted(set(explore.PRIORITIES) - {"base", "edge"}))
def test_every_priority(spark, graphs, algorithm):
    check(spark, graphs, "three-community", algorithm, explore.Config(max_iterations=12))


@pytest.mark.parametrize("algorithm", ["reach", "warp"])
def test_until_exhausted(spark, graphs, algorithm):
    check(spark, graphs, "quality-vs-popularity", algorithm, explore.Config())


CASES = [("three-community", x) for x in ("dome", "random_priority", "round_robin")]
CASES += [("quality-vs-popularity", x) for x in ("tide", "standard_bfs", "dfs_priority")]


@pytest.mark.parametrize(("name", "algorithm"), CASES)
def test_orders_until_exhausted(spark, graphs, name, algorithm):
    """Rounds of many visits and sorted orders give the very visits, paths and statistics of one visit at a time."""
    check(spark, graphs, name, algorithm, explore.Config(), exact=True)


def test_limits_and_compat(spark, graphs):
    check(spark, graphs, "three-community", "dome", explore.Config(max_nodes=7))
    check(spark, graphs, "three-community", "maze", explore.Config(max_paths=2))
    check(spark, graphs, "three-community", "maze", explore.Config(max_iterations=16, compat=True))


def test_own_priority_and_no_seeds(spark, graphs):
    graph, _ = graphs["three-community"]
    alphabetical = lambda state, rows: rows.withColumn("p", F.ascii("node").cast("double"))
    found = explore.explore(graph, seeds(spark, {1: ["bob", "noah"]}), priority=alphabetical, config=explore.Config(max_iterations=4))
    assert [r.id for r in found.visited.orderBy("turn").collect()] == ["bob", "alice", "carol", "david"]
    empty = explore.explore(graph, seeds(spark, {1: ["bob"]}).limit(0))
    assert empty.paths.count() == empty.visited.count() == empty.stats.count() == 0


def test_batch_priorities(spark, graphs):
    graph, slow = graphs["three-community"]
    others = ["alice", "bob", "mia"]
    sets = [set(x.tolist()) for x in slow.near]
    frame = lambda ids: spark.createDataFrame([(i,) for i in ids], "id string")
    means = {}
    for i, name in enumerate(slow.ids):
        each = [len(sets[i] & sets[slow.at[o]]) / len(sets[i] | sets[slow.at[o]]) for o in others if o != name]
        means[name] = sum(each) / len(each)
    found = {r.id: r["mean"] for r in explore.batch_mean_similarity(graph, frame(slow.ids), frame(others)).collect()}
    assert found == pytest.approx(means)
    for algorithm, value in (
        ("lace", lambda m, d: 1 - m),
        ("fuse", lambda m, d: 0.5 * d + 0.5 * (1 - m)),
        ("sift", lambda m, d: 1 - m if m >= 0.25 else d + 100),
    ):
        got = {r.id: r.priority for r in explore.batch_priority(graph, frame(slow.ids), frame(others), algorithm).collect()}
        assert got == pytest.approx({n: value(means[n], len(sets[i])) for i, n in enumerate(slow.ids)})
    alone = explore.batch_mean_similarity(graph, frame(["bob"]), frame(["bob"])).first()
    assert alone["mean"] == 0.0
