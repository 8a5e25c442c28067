"""Registered explorations of the trade graph, and the same visit by visit in SQL.

There is a set for each supplier: two customers of its nation, so that frontiers meet. With a budget, exploration is a
sampling operator: BUDGET is the number of visits of every set. The trail of a set lists its visits in order, its
meetings the paths that were found. The explorations named ``exhaust_…`` have no limit and visit everything in reach.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import explore, extract
from graphloom.plans.draws import BITS, drawn_sql
from graphloom.plans.lineage import cut
from graphloom.plans.numbering import numbered
from graphloom.plans.queries import CLUSTERING, ENTROPY, ORACLES, QUERIES, query
from graphloom.sources import trade_graph

BUDGET = 12
#: Priorities that measure many pairs each visit have a smaller one.
SMALLER = dict.fromkeys(("lace", "fuse", "sift", "reach"), 4)


def seed_sets(graph) -> DataFrame:
    """A set per supplier: of the customers of its nation by degree, the first and the one of the supplier's rank.

    The supplier of rank r in its nation, from 1, takes the customer of place r (from 0) and the first one, in this order.
    """
    home = graph.arcs.where("type = 'located_in' and dst like 'N:%'").select(F.col("src").alias("node"), F.col("dst").alias("home"))
    degree = graph.arcs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d"))
    customers = home.where("node like 'C:%'").join(degree, "node").select("home", F.struct("d", "node").alias("id"))
    suppliers = home.where("node like 'S:%'").select("home", F.col("node").alias("id"))
    placed = cut(numbered(customers, "home").select("home", "id.node", "k"), "places")
    ranks = numbered(suppliers, "home").select("home", F.substring("id", 3, 20).cast("long").alias("seed_set_id"), (F.col("k") + 1).alias("k"))
    other = ranks.join(placed, ["home", "k"]).select("seed_set_id", F.lit(0).alias("pos"), F.col("node").alias("id"))
    first = ranks.select("home", "seed_set_id").join(placed.where("k = 0"), "home").select("seed_set_id", F.lit(1).alias("pos"), F.col("node").alias("id"))
    return other.union(first)


def summary(found: explore.Exploration) -> DataFrame:
    """One row per seed set: its statistics, trail and meetings."""
    step = F.struct("turn", F.concat_ws(" ", F.col("frontier").cast("string"), "id").alias("v"))
    trail = found.visited.groupBy("seed_set_id").agg(F.array_sort(F.collect_list(step)).alias("t"))
    trail = trail.select("seed_set_id", F.array_join("t.v", ", ").alias("trail"))
    met = found.paths.groupBy("seed_set_id").agg(F.array_sort(F.collect_list(F.array_join("nodes", ">"))).alias("m"))
    met = met.select("seed_set_id", F.array_join("m", ", ").alias("meetings"))
    rows = found.stats.join(trail, "seed_set_id", "left").join(met, "seed_set_id", "left")
    return rows.withColumn("meetings", F.coalesce("meetings", F.lit("")))


#: Likeness of pairs (u, v), as the similarity queries have it.
_LIKE = """(SELECT u, v, CASE WHEN a.d + b.d - 2 * adj > 0 THEN greatest(1e-10, s / greatest(a.d + b.d - 2 * adj - s, 1)) ELSE 0 END AS j
  FROM (SELECT u, v, len(list_intersect(x.l, y.l)) AS s, CAST(list_contains(x.l, v) AS INTEGER) AS adj
    FROM (SELECT DISTINCT node AS u, other AS v FROM o) JOIN near x ON x.src = u JOIN near y ON y.src = v)
  JOIN deg a ON a.id = u JOIN deg b ON b.id = v)"""
_BRIDGE = """LEFT JOIN (SELECT q.sid, q.f, q.node, count(*) AS bridge FROM q{k} q JOIN arcs ON src = q.node
  JOIN h{k} h ON h.sid = q.sid AND h.node = dst AND h.f <> q.f GROUP BY ALL) br ON br.sid = q.sid AND br.f = q.f AND br.node = q.node"""
_SALIENCE = """LEFT JOIN (SELECT sid, node, count(*) AS sal FROM (SELECT sid, unnest(nodes) AS node FROM t{k}) GROUP BY ALL) sa ON sa.sid = q.sid AND sa.node = q.node
  LEFT JOIN (SELECT sid, count(*) AS paths FROM t{k} GROUP BY sid) pa ON pa.sid = q.sid"""
_HOLDING = """LEFT JOIN (SELECT sid, node, count(*) AS hol FROM (SELECT sid, unnest(list_distinct(nodes)) AS node FROM t{k}) GROUP BY ALL) ho
  ON ho.sid = q.sid AND ho.node = q.node"""
_MEAN = (
    """LEFT JOIN (WITH o AS (SELECT q.sid, q.f, q.node, h.node AS other FROM q{k} q JOIN h{k} h ON h.sid = q.sid AND h.f = q.f AND h.node <> q.node)
  SELECT o.sid, o.f, o.node, avg(j) AS mean FROM o JOIN """
    + _LIKE
    + """ l ON l.u = o.node AND l.v = o.other GROUP BY ALL) me ON me.sid = q.sid AND me.f = q.f AND me.node = q.node"""
)
_ENDS = (
    """LEFT JOIN (WITH e AS (SELECT sid, unnest([nodes[1], nodes[-1]]) AS other FROM t{k}),
  o AS (SELECT q.sid, q.f, q.node, e.other, count(*) AS c FROM q{k} q JOIN e ON e.sid = q.sid GROUP BY ALL)
  SELECT o.sid, o.f, o.node, sum(j * c) / sum(c) AS mean FROM o JOIN """
    + _LIKE
    + """ l ON l.u = o.node AND l.v = o.other GROUP BY ALL) me ON me.sid = q.sid AND me.f = q.f AND me.node = q.node"""
)
_FLUX = "LEFT JOIN (SELECT sid, count(DISTINCT f) AS fr FROM h{k} GROUP BY sid) fl ON fl.sid = q.sid"
_B, _S = "coalesce(bridge, 0)", "coalesce(sal, 0)"
_PIPE = f"d / (1.0 + {_B})"
#: Joins on the candidates q{k} of a round, and the priority.
RULES = {
    "base": ("", "d"),
    "dome": ("", "d"),
    "dome_high_degree": ("", "-d"),
    "edge": ("", "ln(d + 1) / (h + 1e-10)"),
    "hae": ("", "ln(d + 1) / (h + 1e-10)"),
    "tide": ("", "d + around"),
    "standard_bfs": ("", "born"),
    "dfs_priority": ("", "-born"),
    "frontier_balanced": ("", "q.f * 1e9 + born"),
    "round_robin": ("", "born"),
    "random_priority": ("", f"{drawn_sql('q.node', seed=0)} / CAST({1 << BITS} AS DOUBLE)"),
    "pipe": (_BRIDGE, _PIPE),
    "sage": (_SALIENCE, f"CASE WHEN paths > 0 THEN d - 1000 * {_S} ELSE ln(d + 1) END"),
    "reach": (_SALIENCE + " " + _ENDS, "ln(d + 1) * CASE WHEN paths > 0 THEN 1 - mean ELSE 1 END"),
    "maze": (_BRIDGE + " " + _SALIENCE, f"{_PIPE} * CASE WHEN paths > 0 THEN 1 / (1.0 + 1000 * {_S}) ELSE 1 END"),
    "warp": (_BRIDGE + " " + _HOLDING, f"1 / (1.0 + {_B} + 2 * coalesce(hol, 0))"),
    "lace": (_MEAN, "1 - coalesce(mean, 0)"),
    "fuse": (_MEAN, "0.5 * d + 0.5 * (1 - coalesce(mean, 0))"),
    "sift": (_MEAN, "CASE WHEN coalesce(mean, 0) >= 0.25 THEN 1 - mean ELSE d + 100 END"),
    "flux": (
        _BRIDGE + " " + _FLUX,
        f"CASE WHEN {_B} >= 0.3 * fr THEN 1 / (1.0 + {_B}) WHEN c >= 0.5 THEN 1 / (d + 1.0) ELSE d END",
    ),
}


_PLACES = """places AS MATERIALIZED (
  SELECT a.dst AS home, a.src AS node, row_number() OVER (PARTITION BY a.dst, a.src[1] ORDER BY CASE WHEN a.src LIKE 'C:%' THEN d ELSE 0 END, a.src) AS k
  FROM arcs a JOIN deg ON deg.id = a.src WHERE a.type = 'located_in' AND a.dst LIKE 'N:%')"""
SEEDS = (
    _PLACES,
    """seeds AS MATERIALIZED (
  SELECT CAST(substr(s.node, 3) AS BIGINT) AS sid, CASE WHEN c.k = 1 THEN 1 ELSE 0 END AS f, c.node AS id
  FROM places s JOIN places c ON c.home = s.home AND c.node LIKE 'C:%' AND c.k IN (1, s.k + 1) WHERE s.node LIKE 'S:%')""",
)
NET_SEEDS = (
    _PLACES,
    """seeds AS MATERIALIZED (
  SELECT CAST(substr(s.node, 3) AS BIGINT) AS sid, u.f, CASE WHEN u.f = 0 THEN s.node ELSE c.node END AS id
  FROM places s JOIN places c ON c.home = s.home AND c.k = 1, (SELECT unnest([0, 1]) AS f) u)""",
)
#: Regions, nations and suppliers without the trades.
NET_SQL = """nodes AS (
  SELECT 'R:' || r_regionkey AS id, 'region' AS type FROM region
  UNION ALL SELECT 'N:' || n_nationkey, 'nation' FROM nation
  UNION ALL SELECT 'S:' || s_suppkey, 'supplier' FROM supplier
), edges AS MATERIALIZED (
  SELECT least(a, b) AS src, greatest(a, b) AS dst, type FROM (
    SELECT 'N:' || n_nationkey AS a, 'R:' || n_regionkey AS b, 'part_of' AS type FROM nation
    UNION ALL SELECT 'S:' || s_suppkey, 'N:' || s_nationkey, 'located_in' FROM supplier)
), arcs AS MATERIALIZED (
  SELECT src, dst, type FROM edges UNION ALL SELECT dst, src, type FROM edges
), deg AS MATERIALIZED (
  SELECT id, count(dst) AS d FROM nodes LEFT JOIN arcs ON src = id GROUP BY id
)"""


def _ctes(algorithm: str, rounds: int, seeds: tuple[str, ...] = SEEDS) -> str:
    joins, value = RULES[algorithm]
    out = [
        CLUSTERING,
        ENTROPY,
        "near AS MATERIALIZED (SELECT src, list(dst) AS l FROM arcs GROUP BY src)",
        """feat AS MATERIALIZED (SELECT deg.id, deg.d, h, c, coalesce((SELECT sum(n.d) FROM arcs JOIN deg n ON n.id = dst WHERE src = deg.id), 0) AS around
  FROM deg JOIN ent ON ent.id = deg.id JOIN cc ON cc.id = deg.id)""",
        *seeds,
        "v0 AS MATERIALIZED (SELECT sid, f, id AS node, CAST(NULL AS VARCHAR) AS parent, 0 AS turn, [id] AS chain FROM seeds LIMIT 0)",
        "q0 AS MATERIALIZED (SELECT sid, f, id AS node, CAST(NULL AS VARCHAR) AS parent, 0 AS born FROM seeds)",
    ]
    dynamic = bool(joins)
    first = "z.done, z.f, p" if algorithm in explore.FAIR else "p, z.f"
    for k in range(rounds + 1):
        if k:
            out.append(
                f"""b{k} AS MATERIALIZED (SELECT z.sid, z.f, z.node, z.parent, {k} AS turn, list_append(coalesce(u.chain, []), z.node) AS chain FROM (
  SELECT z.*, row_number() OVER (PARTITION BY z.sid ORDER BY {first}, born, z.node) AS rn FROM (
    SELECT o.*, (SELECT count(*) FROM v{k - 1} w WHERE w.sid = o.sid AND w.f = o.f) AS done
    FROM o{k - 1} o ANTI JOIN v{k - 1} w ON w.sid = o.sid AND w.f = o.f AND w.node = o.node) z) z
  LEFT JOIN v{k - 1} u ON u.sid = z.sid AND u.f = z.f AND u.node = z.parent WHERE rn = 1)"""
            )
            out.append(f"v{k} AS MATERIALIZED (SELECT * FROM v{k - 1} UNION ALL SELECT * FROM b{k})")
            if k == rounds:
                break
            out.append(
                f"""q{k} AS MATERIALIZED (SELECT b.sid, b.f, dst AS node, b.node AS parent, {k} AS born FROM b{k} b JOIN arcs ON src = b.node
  ANTI JOIN v{k} w ON w.sid = b.sid AND w.f = b.f AND w.node = dst)"""
            )
        if dynamic:
            out.append(
                f"""h{k} AS MATERIALIZED (SELECT sid, node, max([turn, f])[2] AS f FROM (
  SELECT sid, id AS node, 0 AS turn, f FROM seeds UNION ALL SELECT sid, node, turn, f FROM v{k}) GROUP BY ALL)"""
            )
            out.append(f"t{k} AS MATERIALIZED ({_meetings(k)})")
        ranked = f"SELECT q.sid, q.f, q.node, q.parent, q.born, round({value}, 9) AS p FROM q{k} q JOIN feat ON feat.id = q.node {joins.format(k=k)}"
        out.append(f"o{k} AS MATERIALIZED ({ranked}{f' UNION ALL SELECT * FROM o{k - 1}' if k else ''})")
    return ", ".join(out)


def _meetings(k: int) -> str:
    return f"""SELECT x.sid, x.turn, x.f AS a, y.f AS b, list_concat(x.chain, list_reverse(y.chain)[2:]) AS nodes
  FROM v{k} x JOIN v{k} y ON y.sid = x.sid AND y.node = x.node AND y.f <> x.f AND y.turn < x.turn"""


def _sql(rounds: int) -> str:
    return f"""SELECT s.sid AS seed_set_id, CAST(count(v.node) AS BIGINT) AS iterations,
  (SELECT count(DISTINCT node) FROM (SELECT sid, node FROM v{rounds} UNION ALL SELECT sid, id FROM seeds) n WHERE n.sid = s.sid) AS nodes_visited,
  CAST(coalesce(sum(deg.d), 0) AS BIGINT) AS edges_traversed,
  (SELECT count(*) FROM met WHERE met.sid = s.sid) AS paths_found,
  CASE WHEN count(v.node) >= {rounds} THEN 'limit' ELSE 'exhausted' END AS termination,
  string_agg(v.f || ' ' || v.node, ', ' ORDER BY v.turn) AS trail,
  coalesce((SELECT string_agg(array_to_string(nodes, '>'), ', ' ORDER BY array_to_string(nodes, '>')) FROM met WHERE met.sid = s.sid), '') AS meetings
FROM (SELECT DISTINCT sid FROM seeds) s LEFT JOIN v{rounds} v ON v.sid = s.sid LEFT JOIN deg ON deg.id = v.node GROUP BY s.sid"""


def _exploration(name: str) -> None:
    sql, ctes, budget = None, "", SMALLER.get(name, BUDGET)
    if name in RULES:
        sql, ctes = _sql(budget), f"{_ctes(name, budget)}, met AS MATERIALIZED ({_meetings(budget)})"

    @query(name, sql, ctes)
    def run(spark, d):
        graph = trade_graph(spark, d).settled()
        return summary(explore.explore(graph, seed_sets(graph), name, explore.Config(max_iterations=budget)))


for _name in explore.PRIORITIES:
    _exploration(_name)


def network(spark, d):
    """Regions, nations and suppliers, without the trades: a graph in which frontiers meet in a few visits."""
    graph = trade_graph(spark, d)
    return extract.filter_graph(graph, F.col("type") != "customer").settled()


def network_seeds(graph) -> DataFrame:
    """A set per supplier: itself and the first of its nation."""
    home = graph.arcs.where("type = 'located_in' and src like 'S:%'").select(F.col("src").alias("id"), F.col("dst").alias("home"))
    first = home.groupBy("home").agg(F.min("id").alias("first"))
    ends = F.posexplode(F.array("id", "first")).alias("pos", "end")
    rows = home.join(first, "home").select(F.substring("id", 3, 20).cast("long").alias("seed_set_id"), ends)
    return rows.withColumnRenamed("end", "id")


def _network_exploration(name: str) -> None:
    def run(spark, d):
        graph = network(spark, d)
        return summary(explore.explore(graph, network_seeds(graph), name, explore.Config(max_iterations=BUDGET)))

    QUERIES[f"net_{name}"] = run
    met = f"met AS MATERIALIZED ({_meetings(BUDGET)})"
    ORACLES[f"net_{name}"] = f"WITH RECURSIVE {NET_SQL}, {_ctes(name, BUDGET, NET_SEEDS)}, {met}\n{_sql(BUDGET)}"


for _name in ("dome", "pipe", "sage", "reach", "maze", "fuse", "flux"):
    _network_exploration(_name)

PATHS_BUDGET = 2 * BUDGET


@query(
    "explore_paths",
    """SELECT sid AS seed_set_id, turn, a AS from_frontier, b AS to_frontier, nodes FROM met
WHERE (SELECT count(*) FROM met e WHERE e.sid = met.sid AND e.turn < met.turn) < 3""",
    f"{_ctes('round_robin', PATHS_BUDGET)}, met AS MATERIALIZED ({_meetings(PATHS_BUDGET)})",
)
def explore_paths(spark, d):
    """In turns until the first three meetings of every set."""
    graph = trade_graph(spark, d).settled()
    found = explore.explore(graph, seed_sets(graph), "round_robin", explore.Config(max_paths=3, max_iterations=PATHS_BUDGET))
    return found.paths


def nation_seeds(graph) -> DataFrame:
    """A set per nation: its first supplier and its first customer."""
    home = graph.arcs.where("type = 'located_in' and dst like 'N:%'")
    first = home.groupBy("dst", F.substring("src", 1, 1).alias("kind")).agg(F.min("src").alias("id"))
    number = F.substring("dst", 3, 20).cast("long").alias("seed_set_id")
    return first.select(number, F.when(F.col("kind") == "S", 0).otherwise(1).alias("pos"), "id")


#: Levels that the SQL unrolls; the trade graph has six.
LEVELS = 8
_LEVELS = ["l0 AS MATERIALIZED (SELECT sid, f, id AS node, CAST(NULL AS VARCHAR) AS parent, 1 AS i, 0 AS lev FROM seeds)", "s0 AS MATERIALIZED (SELECT * FROM l0)"]
for _k in range(1, LEVELS + 1):
    _LEVELS += [
        f"""l{_k} AS MATERIALIZED (SELECT *, (SELECT max(i) FROM l{_k - 1} x WHERE x.sid = z.sid AND x.f = z.f) + row_number() OVER (PARTITION BY sid, f ORDER BY born, node) AS i, {_k} AS lev
  FROM (SELECT l.sid, l.f, dst AS node, arg_min(l.node, l.i) AS parent, min(l.i) AS born FROM l{_k - 1} l JOIN arcs ON src = l.node
    ANTI JOIN s{_k - 1} w ON w.sid = l.sid AND w.f = l.f AND w.node = dst GROUP BY ALL) z)""",
        f"s{_k} AS MATERIALIZED (SELECT * FROM s{_k - 1} UNION ALL SELECT sid, f, node, parent, i, lev FROM l{_k})",
    ]
_BY_NATION = """seeds AS MATERIALIZED (
  SELECT CAST(substr(dst, 3) AS BIGINT) AS sid, CASE WHEN src LIKE 'S:%' THEN 0 ELSE 1 END AS f, min(src) AS id
  FROM arcs WHERE type = 'located_in' AND dst LIKE 'N:%' GROUP BY ALL)"""


def _bfs_turns() -> list[str]:
    """Turns where the oldest candidate of all frontiers goes first."""
    out = ["g0 AS MATERIALIZED (SELECT sid, f, node, 1 + f AS turn FROM l0)"]
    for k in range(1, LEVELS + 1):
        out.append(f"""g{k} AS MATERIALIZED (SELECT l.sid, l.f, l.node, (SELECT max(turn) FROM g{k - 1} x WHERE x.sid = l.sid)
  + row_number() OVER (PARTITION BY l.sid ORDER BY g.turn, l.node) AS turn
  FROM l{k} l JOIN g{k - 1} g ON g.sid = l.sid AND g.f = l.f AND g.node = l.parent)""")
    return [*out, "g AS (" + " UNION ALL ".join(f"SELECT * FROM g{k}" for k in range(LEVELS + 1)) + ")"]


def _exhaustive(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()) -> None:
    @query(f"exhaust_{name}", sql, ", ".join([_BY_NATION, *_LEVELS, *ctes]))
    def run(spark, d):
        graph = trade_graph(spark, d).settled()
        found = explore.explore(graph, nation_seeds(graph), name)
        return found.visited.select("seed_set_id", "frontier", "id", F.col("turn").cast("long").alias("turn"))


_VISITS = "SELECT sid AS seed_set_id, f AS frontier, node AS id, {} AS turn FROM {}"
_exhaustive("standard_bfs", _VISITS.format("turn", "g"), tuple(_bfs_turns()))
_exhaustive("round_robin", _VISITS.format("row_number() OVER (PARTITION BY sid ORDER BY i, f)", f"s{LEVELS}"))
for _name in ("dome", "dfs_priority"):
    _exhaustive(_name)
