"""Multi-seed exploration: several frontiers grow towards each other in priority order and meet in paths.

One exploration visits one node at a time, the best of all its frontiers' candidates. All seed sets advance together, a
visit each per round, and every part of a round is a join or an aggregation: the best candidate of a set is a minimum,
neighbours come from an equi-join with the arcs, meetings from a join of the visit with earlier visits of the same node,
and priorities are columns made from degrees, from counts over earlier visits, or from pair similarities. No graph, no
neighbourhood and no seed set is gathered in a task or on the driver. Rounds are written to the shared folder.

A visit pushes all its neighbours, but those that as many better ones precede as there are visits to come are never
visited. Where priorities tell that beforehand, they are left out (``LEADING``): the trails are the same.

With a limit, or where priorities depend on what was visited, the number of rounds is that of the visits of the longest
exploration: a sampling operator with a budget. Without a limit, and where a node's priority is fixed or its age, the
order of each seed is found apart, in rounds of as many visits as are certain to come next (``orders.py``), and the
orders of a set are merged by sorting.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators import orders
from graphloom.operators.neighbours import local_density, type_entropy
from graphloom.operators.similarity import Prepared, pair_similarity, prepared
from graphloom.plans.draws import BITS, drawn
from graphloom.plans.lineage import cut, drop
from graphloom.sources.graph import PropertyGraph

#: Decimal places to which priorities are compared.
DIGITS = 9
#: Rounds whose written tables are merged into one.
MERGED = 16
#: Rounds after which it is looked whether any exploration still goes on.
LOOKED = 8


@dataclass(frozen=True)
class Config:
    """Limits (0: none) and parameters of the priorities."""

    max_nodes: int = 0
    max_iterations: int = 0
    max_paths: int = 0
    seed: int = 0
    salience_weight: float = 0.5
    mi_threshold: float = 0.25
    density_threshold: float = 0.5
    bridge_threshold: float = 0.3
    #: maze counts the nodes of a set's first paths twice, as the surveyed implementation does.
    compat: bool = False


class Log:
    """A growing table: parts written round by round, merged now and then, when the parts are deleted."""

    def __init__(self, first: DataFrame, label: str) -> None:
        self.label, self.parts = label, [first]

    def add(self, rows: DataFrame) -> None:
        if len(self.parts) >= MERGED:
            whole = cut(self.rows, self.label)
            for p in self.parts:
                drop(p)
            self.parts = [whole]
        self.parts.append(rows)

    @property
    def rows(self) -> DataFrame:
        out = self.parts[0]
        for p in self.parts[1:]:
            out = out.unionByName(p)
        return out


@dataclass
class State:
    """What a priority may look at while it ranks candidates.

    ``seeds``: (seed_set_id, f, node). ``visits``: (seed_set_id, f, node, parent, turn, chain). ``met``: (seed_set_id,
    turn, a, b, nodes), every visit of a node that another frontier visited before.
    """

    graph: PropertyGraph
    arcs: DataFrame
    features: DataFrame
    config: Config
    seeds: DataFrame
    visits: Log
    met: Log
    likeness: Log | None = field(default=None)
    prepared: Prepared | None = field(default=None)
    #: Tables of this round, deleted when the next candidates are written.
    written: list[DataFrame] = field(default_factory=list)

    @property
    def paths(self) -> DataFrame:
        return self.met.rows

    @property
    def marks(self) -> DataFrame:
        """(seed_set_id, node, f, turn), every visit and every seed; the latest of a node tells who holds it."""
        columns = ["seed_set_id", "node", "f", "turn"]
        return self.seeds.withColumn("turn", F.lit(0)).select(columns).union(self.visits.rows.select(columns))

    def holders(self) -> DataFrame:
        """(seed_set_id, node, holder): the frontier that visited each node last."""
        last = self.marks.groupBy("seed_set_id", "node").agg(F.max(F.struct("turn", "f")).alias("m"))
        return last.select("seed_set_id", "node", F.col("m.f").alias("holder"))

    def bridge(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``bridge``: neighbours that another frontier visited last."""
        near = rows.select("seed_set_id", "f", "node").join(self.arcs, F.col("node") == F.col("src"))
        near = near.select("seed_set_id", "f", F.col("node").alias("at"), F.col("dst").alias("node"))
        found = near.join(self.holders(), ["seed_set_id", "node"]).where("holder <> f")
        found = found.groupBy("seed_set_id", "f", F.col("at").alias("node")).agg(F.count("*").alias("bridge"))
        return _with_count(rows, found, ["seed_set_id", "f", "node"], "bridge")

    def salience(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``salience`` (occurrences on paths), ``holding`` (paths with the node) and ``paths`` of the set."""
        paths = self.paths
        counted = paths
        if self.config.compat:
            first = paths.groupBy("seed_set_id").agg(F.min("turn").alias("turn"))
            counted = paths.unionByName(paths.join(first, ["seed_set_id", "turn"], "left_semi"))
        each = counted.select("seed_set_id", F.explode("nodes").alias("node"))
        once = paths.select("seed_set_id", F.explode(F.array_distinct("nodes")).alias("node"))
        key = ["seed_set_id", "node"]
        rows = _with_count(rows, each.groupBy(*key).agg(F.count("*").alias("salience")), key, "salience")
        rows = _with_count(rows, once.groupBy(*key).agg(F.count("*").alias("holding")), key, "holding")
        return _with_count(rows, paths.groupBy("seed_set_id").agg(F.count("*").alias("paths")), ["seed_set_id"], "paths")

    def mean_likeness(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``mean``: mean similarity with the nodes that the frontier visited last; 0 for none."""
        own = self.holders().select("seed_set_id", F.col("holder").alias("f"), F.col("node").alias("other"))
        return self._mean(rows, own.withColumn("c", F.lit(1)), ["seed_set_id", "f"])

    def end_likeness(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``mean``: mean similarity with the ends of all paths so far."""
        ends = F.explode(F.array(F.element_at("nodes", 1), F.element_at("nodes", -1)))
        each = self.paths.select("seed_set_id", ends.alias("other"))
        return self._mean(rows, each.groupBy("seed_set_id", "other").agg(F.count("*").alias("c")), ["seed_set_id"], itself=True)

    def _mean(self, rows: DataFrame, others: DataFrame, key: list[str], itself: bool = False) -> DataFrame:
        pairs = rows.select("seed_set_id", "f", "node").join(others, key)
        pairs = pairs if itself else pairs.where("other <> node")
        pairs = cut(pairs.withColumns({"u": F.least("node", "other"), "v": F.greatest("node", "other")}), "pairs")
        self._measure(pairs)
        known = pairs.join(self.likeness.rows, ["u", "v"])
        weighted = F.sum(F.col("jaccard") * F.col("c")) / F.sum("c")
        mean = cut(known.groupBy("seed_set_id", "f", "node").agg(weighted.alias("mean")), "mean")
        drop(pairs)
        self.written.append(mean)
        return _with_count(rows, mean, ["seed_set_id", "f", "node"], "mean")

    def _measure(self, pairs: DataFrame) -> None:
        """Add the similarities of pairs that are not known yet; each pair is measured once for all seed sets."""
        wanted = pairs.select("u", "v").distinct()
        if self.likeness is not None:
            wanted = wanted.join(self.likeness.rows, ["u", "v"], "left_anti")
        wanted = cut(wanted, "unmeasured")
        if self.likeness is not None and wanted.limit(1).count() == 0:
            drop(wanted)
            return
        self.prepared = self.prepared or prepared(self.graph)
        found = cut(pair_similarity(self.graph, wanted, ("jaccard",), given=self.prepared), "likeness")
        drop(wanted)
        if self.likeness is None:
            self.likeness = Log(found, "likeness")
        else:
            self.likeness.add(found)


def _with_count(rows: DataFrame, counts: DataFrame, key: list[str], name: str) -> DataFrame:
    return rows.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


#: Candidates (seed_set_id, f, node, parent, turn, degree, …) to the same with the priority ``p``, lower first.
Priority = Callable[[State, DataFrame], DataFrame]


def _plain(value: Callable[[Config], Column]) -> Priority:
    return lambda s, rows: rows.withColumn("p", value(s.config).cast("double"))


def _log() -> Column:
    return F.ln(F.col("degree") + 1)


def _hae(s: State, rows: DataFrame) -> DataFrame:
    return rows.withColumn("p", _log() / (F.col("entropy") + 1e-10))


def _pipe(s: State, rows: DataFrame) -> DataFrame:
    return s.bridge(rows).withColumn("p", F.col("degree") / (1 + F.col("bridge")))


def _sage(s: State, rows: DataFrame) -> DataFrame:
    later = (F.col("degree") - 1000 * F.col("salience")).cast("double")
    return s.salience(rows).withColumn("p", F.when(F.col("paths") > 0, later).otherwise(_log()))


def _reach(s: State, rows: DataFrame) -> DataFrame:
    rows = s.end_likeness(s.salience(rows))
    return rows.withColumn("p", F.when(F.col("paths") > 0, _log() * (1 - F.col("mean"))).otherwise(_log()))


def _maze(s: State, rows: DataFrame) -> DataFrame:
    rows = _pipe(s, s.salience(rows))
    return rows.withColumn("p", F.col("p") * F.when(F.col("paths") > 0, 1 / (1 + 1000 * F.col("salience"))).otherwise(1))


def _warp(s: State, rows: DataFrame) -> DataFrame:
    return s.bridge(s.salience(rows)).withColumn("p", 1 / (1 + F.col("bridge") + 2 * F.col("holding")))


def _lace(s: State, rows: DataFrame) -> DataFrame:
    return s.mean_likeness(rows).withColumn("p", 1 - F.col("mean"))


def _fuse(s: State, rows: DataFrame) -> DataFrame:
    w = s.config.salience_weight
    return s.mean_likeness(rows).withColumn("p", (1 - w) * F.col("degree") + w * (1 - F.col("mean")))


def _sift(s: State, rows: DataFrame) -> DataFrame:
    mean = F.col("mean")
    value = F.when(mean >= s.config.mi_threshold, 1 - mean).otherwise(F.col("degree") + 100.0)
    return s.mean_likeness(rows).withColumn("p", value)


def _flux(s: State, rows: DataFrame) -> DataFrame:
    kinds = s.holders().groupBy("seed_set_id").agg(F.countDistinct("holder").alias("frontiers"))
    rows = _with_count(s.bridge(rows), kinds, ["seed_set_id"], "frontiers")
    between = (F.col("frontiers") > 0) & (F.col("bridge") >= s.config.bridge_threshold * F.col("frontiers"))
    dense = F.col("density") >= s.config.density_threshold
    value = F.when(dense, 1 / (F.col("degree") + 1)).otherwise(F.col("degree"))
    return rows.withColumn("p", F.when(between, 1 / (1 + F.col("bridge"))).otherwise(value).cast("double"))


def hashed_priority(seed: int) -> Column:
    return drawn("node", seed=seed) / float(1 << BITS)


_degree = _plain(lambda c: F.col("degree"))
_oldest = _plain(lambda c: F.col("turn"))
PRIORITIES: dict[str, Priority] = {
    "base": _degree,
    "dome": _degree,
    "dome_high_degree": _plain(lambda c: -F.col("degree")),
    "edge": _hae,
    "hae": _hae,
    "pipe": _pipe,
    "sage": _sage,
    "reach": _reach,
    "maze": _maze,
    "tide": _plain(lambda c: F.col("degree") + F.col("around")),
    "lace": _lace,
    "warp": _warp,
    "fuse": _fuse,
    "sift": _sift,
    "flux": _flux,
    "standard_bfs": _oldest,
    "dfs_priority": _plain(lambda c: -F.col("turn")),
    "frontier_balanced": _plain(lambda c: F.col("f") * 1e9 + F.col("turn")),
    "round_robin": _oldest,
    "random_priority": _plain(lambda c: hashed_priority(c.seed)),
}
#: Those that let the frontier with the fewest visits go first, whatever the priorities.
FAIR = ("round_robin",)


def node_features(graph: PropertyGraph, algorithm: str, type_of: Column | None = None) -> DataFrame:
    """(node, degree, around, entropy, density): what priorities need of a node whatever the state."""
    degree = graph.arcs.groupBy("src").agg(F.count("*").alias("degree"))
    rows = graph.nodes.select(F.col("id").alias("node")).join(degree, F.col("node") == F.col("src"), "left")
    rows = rows.select("node", F.coalesce("degree", F.lit(0)).alias("degree"))
    if algorithm == "tide":
        far = graph.arcs.select(F.col("src").alias("node"), "dst").join(degree.withColumnRenamed("src", "dst"), "dst")
        rows = _with_count(rows, far.groupBy("node").agg(F.sum("degree").alias("around")), ["node"], "around")
    if algorithm in ("edge", "hae"):
        rows = _with_count(rows, type_entropy(graph, type_of).withColumnRenamed("id", "node"), ["node"], "entropy")
    if algorithm == "flux":
        rows = _with_count(rows, local_density(graph).withColumnRenamed("id", "node"), ["node"], "density")
    for name in ("around", "entropy", "density"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(0.0))
    return rows


@dataclass(frozen=True)
class Exploration:
    """Results of all seed sets, written once but for ``sampled_edges``, which has all arcs of all visits and is made
    where it is read.

    ``paths``: (seed_set_id, turn, from_frontier, to_frontier, nodes), a meeting each. ``visited``: (seed_set_id,
    frontier, id, turn). ``sampled_edges``: (seed_set_id, src, dst). ``stats``: (seed_set_id, iterations, nodes_visited,
    edges_traversed, paths_found, termination).
    """

    paths: DataFrame
    visited: DataFrame
    sampled_edges: DataFrame
    stats: DataFrame


CANDIDATE = ("seed_set_id", "f", "node", "parent", "turn", "p")


def explore(
    graph: PropertyGraph,
    seeds: DataFrame,
    algorithm: str = "base",
    config: Config | None = None,
    priority: Priority | None = None,
    type_of: Column | None = None,
) -> Exploration:
    """Explore from ``seeds`` (seed_set_id, pos, id), one frontier per seed in pos order.

    ``priority`` replaces the named algorithm's; ``type_of`` is the node type of edge and hae. Ties go to the lower
    frontier, then to the earlier push; neighbours are pushed in ascending id. Seeds that are no nodes are visited and
    have no neighbours. Limits of nodes and paths end an exploration at the visit that reaches them.
    """
    config, rank, fair = config or Config(), priority or PRIORITIES[algorithm], algorithm in FAIR
    graph = graph.settled()
    arcs = cut(graph.arcs.select("src", "dst").distinct(), "arcs")
    features = cut(node_features(graph, algorithm, type_of), "features")
    limited = config.max_nodes or config.max_iterations or config.max_paths
    listed = seeds.groupBy("seed_set_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("s"))
    listed = cut(listed.select("seed_set_id", F.posexplode("s").alias("f", "x")).select("seed_set_id", "f", F.col("x.id").alias("node")), "seeds")
    if not limited and priority is None and algorithm in ORDERED:
        return _exhausted(graph, arcs, features, config, listed, algorithm)
    none = F.lit(None).cast("string").alias("parent")
    start = listed.select("seed_set_id", "f", "node", none, F.lit(0).alias("turn"))
    visits = start.select("*", F.array("node").alias("chain")).limit(0)
    state = State(graph, arcs, features, config, listed, Log(visits, "visits"), Log(_met(visits, visits), "met"))
    ranked = cut(_ranked(state, start, rank), "open")
    pushed = arcs
    if priority is None and config.max_iterations and algorithm in LEADING:
        pushed = cut(_leading(state, LEADING[algorithm](config), config.max_iterations), "leading")
    turn = 0
    while not config.max_iterations or turn < config.max_iterations:
        turn += 1
        now = cut(_visit(state, ranked, turn, fair), "now")
        if turn % LOOKED == 0 and now.limit(1).count() == 0:
            break
        state.met.add(cut(_met(now, state.visits.rows), "met"))
        state.visits.add(now)
        taken = now.select("seed_set_id", "f", F.col("node").alias("taken"))
        rest = ranked.join(taken, ["seed_set_id", "f"], "left").where("taken is null or taken <> node").select(*CANDIDATE)
        near = now.join(pushed, now["node"] == pushed["src"]).select("seed_set_id", "f", F.col("dst").alias("node"), F.col("src").alias("parent"), "turn")
        if pushed is not arcs and algorithm in BY_PATHS:
            near = near.unionByName(_on_paths(state, now))
        fresh = near.join(state.visits.rows.select("seed_set_id", "f", "node"), ["seed_set_id", "f", "node"], "left_anti")
        both = rest.unionByName(_ranked(state, fresh, rank))
        # of the pushes of one node by one frontier only the best is ever visited
        best = both.groupBy("seed_set_id", "f", "node").agg(F.min(F.struct("p", "turn", "parent")).alias("m"))
        following = cut(best.select("seed_set_id", "f", "node", "m.parent", "m.turn", "m.p"), "open")
        for old in (ranked, *state.written):
            drop(old)
        ranked, state.written = following, []
    return _results(state, listed, arcs)


#: Priorities whose orders can be found seed by seed: by a fixed value of the node, or by age.
ORDERED = ("base", "dome", "dome_high_degree", "edge", "hae", "tide", "random_priority", *orders.BY_AGE)


#: Priorities whose order among the neighbours of one node is known beforehand, but for nodes on paths in BY_PATHS: what
#: orders them, and the most that a priority may lie above that.
LEADING: dict[str, Callable[[Config], tuple[Priority, float]]] = {
    **{name: lambda c, name=name: (PRIORITIES[name], 0.0) for name in (*ORDERED, "frontier_balanced")},
    "sage": lambda c: (_degree, 0.0),
    "fuse": lambda c: (_plain(lambda c: (1 - c.salience_weight) * F.col("degree") + min(0.0, c.salience_weight)), abs(c.salience_weight)),
}
#: Nodes on paths come before all others.
BY_PATHS = ("sage",)


def _leading(state: State, by: tuple[Priority, float], most: int) -> DataFrame:
    """(src, dst): the arcs without those to neighbours that ``most`` others precede, whatever is visited.

    With ``most`` visits in all, a frontier that visits a node at turn t has visited t nodes and has ``most`` - t to
    visit, so of the neighbours not visited by it the first ``most`` - t are among the first ``most`` of all.
    """
    rank, width = by
    zero = lambda c: F.lit(0).alias(c)
    rows = state.arcs.select(zero("seed_set_id"), zero("f"), F.col("dst").alias("node"), F.col("src").alias("parent"), zero("turn"))
    rows = _ranked(state, rows, rank).select("parent", "node", "p")
    place = F.row_number().over(W.partitionBy("parent").orderBy("p", "node"))
    ends = F.col("parent").alias("src"), F.col("node").alias("dst")
    first = rows.withColumn("place", place).where(F.col("place") <= most)
    if not width:
        return first.select(*ends)
    last = first.where(F.col("place") == most).select("parent", F.round(F.col("p") + width, DIGITS).alias("last"))
    return rows.join(last, "parent", "left").where("last is null or p <= last").select(*ends)


def _on_paths(state: State, now: DataFrame) -> DataFrame:
    """The neighbours of this turn's visits that lie on paths of their set."""
    on = state.paths.select("seed_set_id", F.explode("nodes").alias("dst")).distinct()
    asked = now.select("seed_set_id", "f", F.col("node").alias("src"), "turn").join(on, "seed_set_id")
    asked = cut(asked, "asked")
    state.written.append(asked)
    return asked.join(state.arcs, ["src", "dst"]).select("seed_set_id", "f", F.col("dst").alias("node"), F.col("src").alias("parent"), "turn")


def _met(now: DataFrame, earlier: DataFrame) -> DataFrame:
    """The paths that visits close with earlier visits of the same node by other frontiers."""
    before = earlier.select("seed_set_id", "node", F.col("f").alias("b"), F.col("chain").alias("tail"), F.col("turn").alias("earlier"))
    met = now.join(before, ["seed_set_id", "node"]).where("b <> f and earlier < turn")
    joined = F.concat("chain", F.slice(F.reverse("tail"), F.lit(2), F.size("tail")))
    return met.select("seed_set_id", "turn", F.col("f").alias("a"), "b", joined.alias("nodes"))


def _exhausted(
    graph: PropertyGraph, arcs: DataFrame, features: DataFrame, config: Config, listed: DataFrame, algorithm: str
) -> Exploration:
    """Everything in reach, for priorities that do not depend on other frontiers.

    At any time the frontier with the best candidate goes on, so the visits of a set are sorted by the worst value that
    their frontier has had to take so far, then by frontier, then in its order.
    """
    starts = cut(listed.select(F.col("node").alias("seed")).distinct(), "starts")
    if algorithm in orders.BY_AGE:
        found = orders.by_age(graph, arcs, starts, depth_first=algorithm == "dfs_priority")
    else:
        strange = starts.select(F.col("seed").alias("node")).join(features, "node", "left_anti")
        known = features.unionByName(strange, allowMissingColumns=True).fillna(0)
        none = Log(listed, "none")
        ranked = PRIORITIES[algorithm](State(graph, arcs, features, config, listed, none, none), known)
        found = orders.by_value(arcs, starts, ranked.select("node", F.round("p", DIGITS).alias("p")))
    found = orders.with_chains(found)
    rows = listed.select("seed_set_id", "f", F.col("node").alias("seed")).join(found, "seed")
    if algorithm == "standard_bfs":
        rows = orders.levelled(rows)
    else:
        order = {"frontier_balanced": ["f", "i"], "dfs_priority": ["f", "i"], "round_robin": ["i", "f"]}
        rows = orders.turns(rows, order.get(algorithm, ["top", "f", "i"]))
    visits = cut(rows.select("seed_set_id", "f", "node", "parent", "turn", "chain"), "visits")
    state = State(graph, arcs, features, config, listed, Log(visits, "visits"), Log(_met(visits, visits), "met"))
    return _results(state, listed, arcs)


def _ranked(state: State, rows: DataFrame, rank: Priority) -> DataFrame:
    known = rows.join(state.features, "node", "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("degree", "around", "entropy", "density")}
    )
    # sums of doubles depend on their order in the last digits, which must not decide ties
    return rank(state, known).withColumn("p", F.round("p", DIGITS)).select(*CANDIDATE)


def _visit(state: State, ranked: DataFrame, turn: int, fair: bool) -> DataFrame:
    """The best candidate of every seed set that has not reached a limit."""
    order, rows = ["p", "f", F.col("turn").alias("born"), "node", "parent"], ranked
    if fair:
        done = state.visits.rows.groupBy("seed_set_id", "f").agg(F.count("*").alias("done"))
        rows, order = _with_count(ranked, done, ["seed_set_id", "f"], "done"), ["done", *order[1:2], order[0], *order[2:]]
    best = rows.groupBy("seed_set_id").agg(F.min(F.struct(*order)).alias("m"))
    best = best.select("seed_set_id", "m.f", "m.node", "m.parent", F.lit(turn).alias("turn"))
    if state.config.max_nodes:
        held = state.marks.groupBy("seed_set_id").agg(F.countDistinct("node").alias("c"))
        best = best.join(held.where(F.col("c") >= state.config.max_nodes), "seed_set_id", "left_anti")
    if state.config.max_paths:
        held = state.paths.groupBy("seed_set_id").agg(F.count("*").alias("c"))
        best = best.join(held.where(F.col("c") >= state.config.max_paths), "seed_set_id", "left_anti")
    above = state.visits.rows.select("seed_set_id", "f", F.col("node").alias("parent"), F.col("chain").alias("above"))
    known = best.join(above, ["seed_set_id", "f", "parent"], "left")
    chain = F.concat(F.coalesce("above", F.array().cast("array<string>")), F.array("node"))
    return known.select("seed_set_id", "f", "node", "parent", "turn", chain.alias("chain"))


def _results(state: State, listed: DataFrame, arcs: DataFrame) -> Exploration:
    config = state.config
    paths = cut(state.paths.withColumnsRenamed({"a": "from_frontier", "b": "to_frontier"}), "paths")
    visits = cut(state.visits.rows, "visited")
    edges = visits.join(arcs, visits["node"] == arcs["src"])
    edges = edges.select("seed_set_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    seen = visits.join(arcs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n")), "node")
    sets = listed.select("seed_set_id").distinct()
    key = ["seed_set_id"]
    stats = _with_count(sets, visits.groupBy(*key).agg(F.count("*").alias("iterations")), key, "iterations")
    nodes = state.marks.groupBy(*key).agg(F.countDistinct("node").alias("nodes_visited"))
    stats = _with_count(stats, nodes, key, "nodes_visited")
    stats = _with_count(stats, seen.groupBy(*key).agg(F.sum("n").alias("edges_traversed")), key, "edges_traversed")
    stats = _with_count(stats, paths.groupBy(*key).agg(F.count("*").alias("paths_found")), key, "paths_found")
    limited = F.lit(False)
    for most, name in ((config.max_iterations, "iterations"), (config.max_nodes, "nodes_visited"), (config.max_paths, "paths_found")):
        limited = limited | (F.lit(most > 0) & (F.col(name) >= most))
    stats = cut(stats.withColumn("termination", F.when(limited, "limit").otherwise("exhausted")), "stats")
    visited = visits.select("seed_set_id", F.col("f").alias("frontier"), F.col("node").alias("id"), "turn")
    return Exploration(paths, visited, edges, stats)


def batch_mean_similarity(graph: PropertyGraph, nodes: DataFrame, others: DataFrame) -> DataFrame:
    """(id, mean): plain Jaccard of every node of ``nodes`` (id) with every one of ``others`` (id, a stated set) but
    itself, averaged; 0 for none. Neighbourhoods are whole, without a floor.

    Shared neighbours are counted by a join on the neighbour; what two nodes do not share adds nothing to the sum.
    """
    arcs = graph.arcs.select("src", "dst").distinct()
    size = arcs.groupBy("src").agg(F.count("*").alias("d"))
    a = nodes.select("id").distinct().join(arcs, F.col("id") == F.col("src")).select("id", "dst")
    b = others.select(F.col("id").alias("other")).distinct()
    near = b.join(arcs, F.col("other") == F.col("src")).select("other", "dst")
    shared = a.join(near, "dst").where("id <> other").groupBy("id", "other").agg(F.count("*").alias("c"))
    shared = shared.join(size.select(F.col("src").alias("id"), F.col("d").alias("x")), "id").join(
        size.select(F.col("src").alias("other"), F.col("d").alias("y")), "other"
    )
    sums = shared.groupBy("id").agg(F.sum(F.col("c") / (F.col("x") + F.col("y") - F.col("c"))).alias("s"))
    total = b.agg(F.count("*").alias("total"))
    own = b.select(F.col("other").alias("id"), F.lit(1).alias("own"))
    rows = nodes.select("id").distinct().join(sums, "id", "left").join(own, "id", "left").crossJoin(F.broadcast(total))
    count = F.col("total") - F.coalesce("own", F.lit(0))
    return rows.select("id", F.when(count > 0, F.coalesce("s", F.lit(0.0)) / count).otherwise(0.0).alias("mean"))


def batch_priority(graph: PropertyGraph, nodes: DataFrame, others: DataFrame, algorithm: str, config: Config | None = None) -> DataFrame:
    """(id, priority) of many nodes at once by lace, fuse or sift over one frontier's visited nodes ``others``."""
    config, mean = config or Config(), F.col("mean")
    rows = batch_mean_similarity(graph, nodes, others).join(graph.degrees().select("id", "out_deg"), "id", "left")
    degree = F.coalesce("out_deg", F.lit(0))
    w = config.salience_weight
    value = {
        "lace": 1 - mean,
        "fuse": (1 - w) * degree + w * (1 - mean),
        "sift": F.when(mean >= config.mi_threshold, 1 - mean).otherwise(degree + 100.0),
    }[algorithm]
    return rows.select("id", value.alias("priority"))


def random_walk(
    graph: PropertyGraph, seeds: DataFrame, walks: int = 10, length: int = 20, restart: float = 0.15, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Walks with restart from ``seeds`` (seed_set_id, pos, id), all advancing a step per join.

    Returns visits (seed_set_id, pos, walk, step, node) and paths (seed_set_id, from_seed, node, to_seed): one per pair
    of seeds of a set, at the smallest node that both visited.
    """
    near = cut(graph.arcs.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("near")), "near")
    known = seeds.join(graph.nodes.select("id"), "id", "left_semi")
    walk = F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk")
    now = known.select("seed_set_id", "pos", F.col("id").alias("home"), walk, F.col("id").alias("node"))
    visits = now.withColumn("step", F.lit(0))
    for step in range(1, length + 1):
        draw = lambda n, step=step: drawn("seed_set_id", "pos", "walk", F.lit(step), F.lit(n), seed=seed)
        joined = now.join(near, now["node"] == near["src"], "left")
        back = F.col("near").isNull() | (draw("back") < int(restart * (1 << BITS)))
        to = F.when(back, F.col("home")).otherwise(F.get("near", (draw("to") % F.size("near")).cast("int")))
        now = joined.select("seed_set_id", "pos", "home", "walk", to.alias("node"))
        if step % 5 == 0:
            now = cut(now, "walk")
        visits = visits.unionByName(now.withColumn("step", F.lit(step)))
    visits = cut(visits, "visits")
    seen = visits.select("seed_set_id", "pos", "home", "node").distinct()
    b = seen.select("seed_set_id", F.col("pos").alias("q"), F.col("home").alias("to_seed"), "node")
    met = seen.join(b, ["seed_set_id", "node"]).where("pos < q")
    paths = met.groupBy("seed_set_id", "pos", "q").agg(
        F.first("home").alias("from_seed"), F.min("node").alias("node"), F.first("to_seed").alias("to_seed")
    )
    return visits.drop("home"), paths.drop("pos", "q")
