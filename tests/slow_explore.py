"""One exploration after the other, step by step in plain Python: what the joins are held against."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from graphloom.operators.explore import Config

EPSILON = 1e-10


class Local:
    """A graph in arrays: neighbours ascending, entropies and densities per node."""

    def __init__(self, ids: list[str], near: list[np.ndarray], entropy: list[float], density: list[float], random: list[float]) -> None:
        self.ids, self.near, self.entropy, self.density, self.random = ids, near, entropy, density, random
        self.at = {v: i for i, v in enumerate(ids)}
        self.sets: dict[int, frozenset[int]] = {}

    def neighbours(self, i: int) -> np.ndarray:
        return self.near[i] if i < len(self.near) else np.zeros(0, np.int64)

    def degree(self, i: int) -> int:
        return len(self.neighbours(i))

    def members(self, i: int) -> frozenset[int]:
        if i not in self.sets:
            self.sets[i] = frozenset(self.neighbours(i).tolist())
        return self.sets[i]

    def jaccard(self, i: int, j: int) -> float:
        a, b = self.members(i) - {j}, self.members(j) - {i}
        union = len(a | b)
        return max(EPSILON, len(a & b) / union) if union else 0.0


@dataclass
class State:
    """What a priority may look at while it ranks a node for a frontier."""

    graph: Local
    config: Config
    frontier: int = 0
    iteration: int = 0
    turn: int = 0
    last: dict[int, int] = field(default_factory=dict)
    paths: list[tuple[int, int, list[int]]] = field(default_factory=list)
    salience: dict[int, int] = field(default_factory=dict)
    holding: dict[int, int] = field(default_factory=dict)
    likeness: dict[tuple[int, int], float] = field(default_factory=dict)

    turns: list[int] = field(default_factory=list)

    def add_path(self, a: int, b: int, nodes: list[int]) -> None:
        self.paths.append((a, b, nodes))
        self.turns.append(self.turn)
        twice = self.config.compat and self.turn == self.turns[0]
        for n in nodes:
            self.salience[n] = self.salience.get(n, 0) + (2 if twice else 1)
        for n in set(nodes):
            self.holding[n] = self.holding.get(n, 0) + 1

    def like(self, a: int, b: int) -> float:
        key = (min(a, b), max(a, b))
        if key not in self.likeness:
            self.likeness[key] = self.graph.jaccard(a, b)
        return self.likeness[key]

    def mean_likeness(self, node: int) -> float:
        """Mean similarity with the nodes that this frontier visited last; 0 for none."""
        own = [n for n, f in self.last.items() if f == self.frontier and n != node]
        return sum(self.like(n, node) for n in own) / len(own) if own else 0.0

    def bridge(self, node: int) -> int:
        """Neighbours that another frontier visited last."""
        last = self.last
        return sum(last.get(n, self.frontier) != self.frontier for n in self.graph.neighbours(node).tolist())


Priority = Callable[[State, int], float]


def _degree(s: State, v: int) -> float:
    return s.graph.degree(v)


def _log_degree(s: State, v: int) -> float:
    return math.log(s.graph.degree(v) + 1)


def _hae(s: State, v: int) -> float:
    h = s.graph.entropy[v] if v < len(s.graph.entropy) else 0.0
    return _log_degree(s, v) / (h + 1e-10)


def _pipe(s: State, v: int) -> float:
    return s.graph.degree(v) / (1 + s.bridge(v))


def _sage(s: State, v: int) -> float:
    return -(1000 * s.salience.get(v, 0) - s.graph.degree(v)) if s.paths else _log_degree(s, v)


def _reach(s: State, v: int) -> float:
    if not s.paths:
        return _log_degree(s, v)
    ends = [n for _, _, nodes in s.paths for n in (nodes[0], nodes[-1])]
    return _log_degree(s, v) * (1 - sum(s.like(n, v) for n in ends) / len(ends))


def _maze(s: State, v: int) -> float:
    return _pipe(s, v) * (1 / (1 + 1000 * s.salience.get(v, 0)) if s.paths else 1)


def _tide(s: State, v: int) -> float:
    return s.graph.degree(v) + sum(s.graph.degree(n) for n in s.graph.neighbours(v).tolist())


def _warp(s: State, v: int) -> float:
    return 1 / (1 + s.bridge(v) + 2 * s.holding.get(v, 0))


def _fuse(s: State, v: int) -> float:
    w = s.config.salience_weight
    return (1 - w) * s.graph.degree(v) + w * (1 - s.mean_likeness(v))


def _sift(s: State, v: int) -> float:
    mean = s.mean_likeness(v)
    return 1 - mean if mean >= s.config.mi_threshold else s.graph.degree(v) + 100


def _flux(s: State, v: int) -> float:
    bridge, frontiers = s.bridge(v), len(set(s.last.values()))
    if frontiers and bridge / frontiers >= s.config.bridge_threshold:
        return 1 / (1 + bridge)
    dense = v < len(s.graph.density) and s.graph.density[v] >= s.config.density_threshold
    return 1 / (s.graph.degree(v) + 1) if dense else s.graph.degree(v)


def _random(s: State, v: int) -> float:
    return s.graph.random[v]


PRIORITIES: dict[str, Priority] = {
    "base": _degree,
    "dome": _degree,
    "dome_high_degree": lambda s, v: -s.graph.degree(v),
    "edge": _hae,
    "hae": _hae,
    "pipe": _pipe,
    "sage": _sage,
    "reach": _reach,
    "maze": _maze,
    "tide": _tide,
    "lace": lambda s, v: 1 - s.mean_likeness(v),
    "warp": _warp,
    "fuse": _fuse,
    "sift": _sift,
    "flux": _flux,
    "standard_bfs": lambda s, v: s.iteration,
    "dfs_priority": lambda s, v: -s.iteration,
    "frontier_balanced": lambda s, v: s.frontier * 1e9 + s.iteration,
    "round_robin": lambda s, v: s.iteration,
    "random_priority": _random,
}


def run(graph: Local, seeds: list[str], priority: Priority, config: Config, fair: bool = False) -> dict:
    """One exploration. Ties go to the earlier push; neighbours are pushed in ascending id."""
    names = list(graph.ids)
    index: list[int] = []
    extra: dict[str, int] = {}
    for s in seeds:
        if s not in graph.at and s not in extra:
            extra[s] = len(names)
            names.append(s)
        index.append(graph.at.get(s, extra.get(s, -1)))
    state = State(graph, config)
    heaps: list[list] = []
    visited: list[dict[int, int | None]] = [{} for _ in seeds]
    everyone: dict[int, None] = {}
    pushed = iterations = traversed = 0
    order_of: list[tuple[int, str]] = []
    edges: set[tuple[str, str]] = set()
    for f, v in enumerate(index):
        everyone[v] = None
        state.last[v] = f
    for f, v in enumerate(index):
        state.frontier, state.iteration = f, 0
        heaps.append([(round(priority(state, v), 9), pushed, v, None)])
        pushed += 1
    termination = "exhausted"
    while True:
        limits = ((config.max_iterations, iterations), (config.max_nodes, len(everyone)), (config.max_paths, len(state.paths)))
        if seeds and any(most and now >= most for most, now in limits):
            termination = "limit"
            break
        best, chosen = math.inf, -1
        for f, heap in enumerate(heaps):
            while heap and heap[0][2] in visited[f]:
                heapq.heappop(heap)
            order = len(visited[f]) if fair else heap[0][0] if heap else None
            if heap and order < best:
                best, chosen = order, f
        if chosen < 0:
            break
        _, _, v, before = heapq.heappop(heaps[chosen])
        state.turn = iterations + 1
        visited[chosen][v] = before
        order_of.append((chosen, names[v]))
        everyone[v] = None
        state.last[v] = chosen
        for other, own in enumerate(visited):
            if other != chosen and v in own:
                state.add_path(chosen, other, _joined(visited[chosen], own, v))
        near = graph.neighbours(v).tolist()
        traversed += len(near)
        state.frontier, state.iteration = chosen, iterations + 1
        for n in near:
            edges.add((min(names[v], names[n]), max(names[v], names[n])))
            if n not in visited[chosen]:
                heapq.heappush(heaps[chosen], (round(priority(state, n), 9), pushed, n, v))
                pushed += 1
        iterations += 1
    return {
        "paths": [(a, b, [names[n] for n in nodes]) for a, b, nodes in state.paths],
        "nodes": [(f, names[n]) for f, own in enumerate(visited) for n in own],
        "order": order_of,
        "edges": sorted(edges),
        "stats": {
            "iterations": iterations,
            "nodes_visited": len(everyone),
            "edges_traversed": traversed,
            "paths_found": len(state.paths),
        },
        "termination": termination,
    }


def _joined(one: dict, other: dict, node: int) -> list[int]:
    """From the seed of ``one`` to the node, and on to the seed of ``other``."""
    head, at = [], node
    while at is not None:
        head.append(at)
        at = one[at]
    tail, at = [], other[node]
    while at is not None:
        tail.append(at)
        at = other[at]
    return head[::-1] + tail
