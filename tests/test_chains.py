"""Hitting times and resistances over joins against dense solutions."""

import math

import numpy as np
import pytest

from graphloom.operators import chains, dense
from graphloom.sources import PropertyGraph, trade_graph
from tests.fixtures import build

PAIRS = "u string, v string"


def dense_times(ids, steps, target):
    """The absorbing chain of one target, all nodes at once; None where it is singular."""
    at = {x: i for i, x in enumerate(ids)}
    p = np.zeros((len(ids), len(ids)))
    for x, near in steps.items():
        for y in near:
            p[at[x], at[y]] = 1 / len(near)
    rest = [i for i in range(len(ids)) if ids[i] != target]
    return dict(zip([ids[i] for i in rest], np.linalg.solve(np.eye(len(rest)) - p[np.ix_(rest, rest)], np.ones(len(rest))), strict=True))


def steps_of(graph):
    out = {r.id: [] for r in graph.nodes.collect()}
    for r in graph.arcs.select("src", "dst").distinct().collect():
        out[r.src].append(r.dst)
    return out


def test_every_pair_of_a_graph(spark):
    graph = build(spark, "three-community").settled()
    steps = steps_of(graph)
    ids = sorted(steps)
    found = {(r.v, r.node): r.h for r in chains.absorption(graph, graph.nodes.select("id")).collect()}
    assert len(found) == len(ids) * (len(ids) - 1)
    for target in ids:
        for u, h in dense_times(ids, steps, target).items():
            assert math.isclose(found[target, u], h, rel_tol=1e-6), (u, target)


def test_directed_walks_with_ends_and_traps(spark):
    """A walk may end early, never arrive, or be caught; other parts of the graph do not matter."""
    nodes = spark.createDataFrame([(x,) for x in "abcdefghpq"], "id string")
    arcs = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("c", "a"), ("e", "c"), ("e", "f"), ("f", "g"), ("g", "f"), ("h", "h"), ("p", "q"), ("q", "p"), ("d", "d")]
    graph = PropertyGraph.build(nodes, spark.createDataFrame(arcs, "src string, dst string"), directed=True)
    asked = [("a", "c"), ("b", "c"), ("e", "c"), ("a", "a"), ("p", "q"), ("a", "q"), ("zz", "a"), ("a", "zz"), ("h", "a")]
    found = {(r.u, r.v): r.h for r in dense.hitting_time(graph, spark.createDataFrame(asked, PAIRS)).collect()}
    # a -> b -> (a or c): b takes 1 + h(a) / 2, a takes 1 + h(b)
    assert math.isclose(found["a", "c"], 4.0) and math.isclose(found["b", "c"], 3.0)
    assert found["e", "c"] == 1.0  # may be caught between f and g
    assert found["a", "a"] == found["zz", "a"] == found["a", "zz"] == 0.0
    assert math.isclose(found["p", "q"], 1.0) and found["a", "q"] == found["h", "a"] == 1.0
    early = PropertyGraph.build(nodes.where("id in ('a', 'b', 'c')"), spark.createDataFrame([("a", "b"), ("a", "c")], "src string, dst string"), directed=True)
    # from a the walk arrives in b, or goes to c and ends there after a step
    assert math.isclose(dense.hitting_time(early, spark.createDataFrame([("a", "b")], PAIRS)).first().h, 1.5)


@pytest.fixture(scope="module")
def trade(spark):
    return trade_graph(spark, "/root/testdata/sf0.001").settled()


def test_trade_graph_both_ways(spark, trade):
    steps = steps_of(trade)
    ids = sorted(steps)
    targets = ["R:0", "N:3", "C:7"]
    asked = [(u, v) for v in targets for u in ids]
    found = {(r.u, r.v): r.h for r in dense.hitting_time(trade, spark.createDataFrame(asked, PAIRS)).collect()}
    for v in targets:
        for u, h in dense_times(ids, steps, v).items():
            assert math.isclose(found[u, v], h, rel_tol=1e-6), (u, v)


def test_sketched_resistance(spark, trade):
    """Within four standard errors of the exact values; refined pairs are exact."""
    ids = [r.id for r in trade.nodes.orderBy("id").collect()]
    asked = spark.createDataFrame([(ids[3 * i], ids[-1 - 2 * i]) for i in range(20)] + [(ids[0], "zz"), (ids[0], ids[0])], PAIRS)
    exact = {(r.u, r.v): r.r for r in dense.resistance(trade, asked).collect()}
    found = {(r.u, r.v): r.r for r in dense.sketched_resistance(trade, asked, 0.4).collect()}
    assert found.keys() == exact.keys()
    error = math.sqrt(2 / math.ceil(4 * math.log(len(ids)) / 0.4**2))
    for pair, r in exact.items():
        assert abs(found[pair] - r) <= 4 * error * r, pair
    refined = {(r.u, r.v): r.r for r in dense.sketched_resistance(trade, asked, 0.4, refine=10.0).collect()}
    close = [p for p in exact if exact[p] > 1e-6]
    assert all(math.isclose(refined[p], exact[p], rel_tol=1e-6) for p in close)
