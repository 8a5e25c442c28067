"""Betweenness of all sources, with folded trees and in blocks, against every pair's shortest paths."""

import random
from collections import deque

import pytest

from graphloom.operators import linalg
from graphloom.sources import PropertyGraph


def slow(near):
    out = dict.fromkeys(near, 0.0)
    for s in near:
        order, depth, sigma, queue = [], {s: 0}, {s: 1.0}, deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in depth:
                    depth[w], sigma[w] = depth[v] + 1, 0.0
                    queue.append(w)
                if depth[w] == depth[v] + 1:
                    sigma[w] += sigma[v]
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in order:
                if w in near[v] and depth[w] == depth[v] + 1:
                    delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                out[w] += delta[w]
    return out


def edges_of(seed, n=22):
    """A core with a few trees on it, a tree apart, a single edge and a lone node."""
    r = random.Random(seed)
    core = [f"c{i}" for i in range(8)]
    pairs = {(a, b) for i, a in enumerate(core) for b in core[i + 1 :] if r.random() < 0.4} | set(zip(core, core[1:], strict=False))
    names = list(core)
    for i in range(n):
        pairs.add((r.choice(names), f"t{i}"))
        names.append(f"t{i}")
    pairs |= {("x0", f"x{i}") for i in (1, 2, 3)} | {("x3", "x4"), ("y0", "y1")}
    return pairs, [*names, *(f"x{i}" for i in range(5)), "y0", "y1", "alone"]


@pytest.mark.parametrize("block", [512, 5])
def test_undirected(spark, block):
    pairs, ids = edges_of(3)
    near = {i: set() for i in ids}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    graph = PropertyGraph.build(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(sorted(pairs), "src string, dst string"))
    found = {r.id: r.betweenness for r in linalg.betweenness(graph, block=block).collect()}
    assert found == pytest.approx(slow(near))


def test_directed_and_some_sources(spark):
    pairs, ids = edges_of(4, 6)
    near = {i: {b for a, b in pairs if a == i} for i in ids}
    nodes, arcs = spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(sorted(pairs), "src string, dst string")
    found = {r.id: r.betweenness for r in linalg.betweenness(PropertyGraph.build(nodes, arcs, directed=True)).collect()}
    assert found == pytest.approx(slow(near))
    undirected = PropertyGraph.build(nodes, arcs)
    whole = linalg.betweenness(undirected)
    each = linalg.betweenness(undirected, sources=undirected.nodes.select("id"))
    assert {r.id: r.betweenness for r in whole.collect()} == pytest.approx({r.id: r.betweenness for r in each.collect()})
