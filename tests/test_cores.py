"""Core and truss numbers by h-indices against peeling, and the rounds they take."""

import random
from itertools import combinations

import pytest

from graphloom.operators import extract
from graphloom.sources import PropertyGraph
from tests.fixtures import build, edges


def slow_cores(near):
    out, left, k = {}, {v: set(n) for v, n in near.items()}, 0
    while left:
        k = max(k, min(len(n) for n in left.values()))
        for v in [v for v, n in left.items() if len(n) <= k]:
            out[v] = k
            for u in left.pop(v):
                if u in left:
                    left[u].discard(v)
    return out


def slow_trusses(pairs):
    out, left, k = {}, {frozenset(p) for p in pairs}, 2
    while left:
        near = {}
        for e in left:
            for v in e:
                near.setdefault(v, set()).update(e - {v})
        poor = [e for e in left if len(set.intersection(*(near[v] for v in e))) < k - 1]
        if poor:
            out.update(dict.fromkeys(poor, k))
            left -= set(poor)
        else:
            k += 1
    return {tuple(sorted(e)): k for e, k in out.items()}


@pytest.fixture(scope="module")
def random_graph(spark):
    r = random.Random(6)
    ids = [f"n{i:02}" for i in range(40)]
    pairs = [p for p in combinations(ids, 2) if r.random() < (0.5 if p[1] < "n15" else 0.08)]
    nodes = spark.createDataFrame([(i,) for i in [*ids, "alone"]], "id string")
    return PropertyGraph.build(nodes, spark.createDataFrame([*pairs, ("n01", "n01")], "src string, dst string")).settled(), pairs


def near(pairs, ids):
    out = {i: set() for i in ids}
    for a, b in pairs:
        out[a].add(b)
        out[b].add(a)
    return out


def test_core_numbers(spark, random_graph):
    graph, pairs = random_graph
    found, rounds = extract._core_numbers(graph)
    wanted = slow_cores(near(pairs, [r.id for r in graph.nodes.collect()]))
    assert {r.id: r.core for r in found.collect()} == wanted
    assert wanted["alone"] == 0 and rounds <= 8
    assert extract.core_numbers(graph.__class__(graph.nodes.limit(0), graph.edges.limit(0))).count() == 0


def test_truss_numbers(spark, random_graph):
    graph, pairs = random_graph
    found, rounds = extract._truss_numbers(graph)
    assert {(r.a, r.b): r.truss for r in found.collect()} == slow_trusses(pairs)
    assert rounds <= 8


def test_chain(spark):
    """Where bounds fall along a chain, as many rounds as it takes are made."""
    found = {r.id: r.core for r in extract.core_numbers(build(spark, "linear-chain")).collect()}
    assert found == dict.fromkeys("ABCDE", 1)
    numbers = {(r.a, r.b): r.truss for r in extract.truss_numbers(build(spark, "social-hub")).collect()}
    assert numbers == slow_trusses(edges("social-hub"))
