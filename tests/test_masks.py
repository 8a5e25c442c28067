"""Searches from many starts as bits against one search after the other."""

import random
from collections import deque

import pytest

from graphloom.operators import seeds
from graphloom.plans import numbered
from graphloom.operators.traversal import WORD, bfs_masks
from graphloom.sources import PropertyGraph


def depths(near, start):
    out, queue = {start: 0}, deque([start])
    while queue:
        v = queue.popleft()
        for w in near[v]:
            if w not in out:
                out[w] = out[v] + 1
                queue.append(w)
    return out


@pytest.fixture(scope="module", params=[False, True])
def made(spark, request):
    r = random.Random(1)
    ids = [f"n{i:03}" for i in range(150)]
    pairs = sorted({(r.choice(ids), r.choice(ids)) for _ in range(230)})
    graph = PropertyGraph.build(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(pairs, "src string, dst string"), request.param)
    near = {i: set() for i in ids}
    for a, b in pairs:
        near[a].add(b)
        if not request.param:
            near[b].add(a)
    return graph.settled(), near


def test_all_starts(spark, made):
    """150 starts, three words: every depth of every pair, and the same to a limit."""
    graph, near = made
    starts = numbered(graph.nodes.select("id"))
    names = {r.k: r.id for r in starts.collect()}
    for most in (None, 2):
        found = {}
        for r in bfs_masks(graph, starts, most).collect():
            for bit in range(WORD):
                if r.mask >> bit & 1:
                    assert (names[r.block * WORD + bit], r.node) not in found
                    found[names[r.block * WORD + bit], r.node] = r.depth
        wanted = {(s, v): d for s in near for v, d in depths(near, s).items() if most is None or d <= most}
        assert found == wanted


def test_selectors_over_masks(spark, made):
    graph, near = made
    every = {(s, v): d for s in near for v, d in depths(near, s).items()}
    asked = random.Random(2).sample([(a, b) for a in near for b in near], 300)
    found = seeds.pair_distances(graph, spark.createDataFrame(asked, "source string, target string"), 4).collect()
    assert {(r.source, r.target): r.dist for r in found} == {p: every[p] for p in asked if every.get(p, 9) <= 4}
    farthest = seeds.max_distance(graph, 20, 42, sources=70).collect()
    assert len(farthest) == 20 and all(every[r.source, r.target] == r.score for r in farthest)
    starts = {r.id for r in graph.nodes.select("id").orderBy(seeds.hashed("id", seed=42), "id").limit(70).collect()}
    best = sorted((d for (s, v), d in every.items() if s in starts and d), reverse=True)[:20]
    assert sorted((r.score for r in farthest), reverse=True) == best
