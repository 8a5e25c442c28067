"""Registered graph queries over the trade graph, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import extract, linalg, neighbours, ranking, similarity, traversal
from graphloom.plans.draws import BITS, drawn_sql
from graphloom.sources import directed_trade_graph, table, trade_graph, trade_paths
from graphloom.sources.tables import GRAPH_SQL, PATHS_SQL

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DIGITS = 9


def query(name: str, sql: str | None = None, ctes: str = ""):
    """Register a query; ``sql`` runs after the graph's CTEs and ``ctes``."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"WITH RECURSIVE {GRAPH_SQL}{', ' + ctes if ctes else ''}\n{sql}"
        return f

    return register


def rounded(df: DataFrame, *columns: str, digits: int = DIGITS) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def linked(graph) -> DataFrame:
    """The pairs of all edges."""
    return graph.edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))


@query("degree", "SELECT id, d AS out_deg, d AS in_deg, d AS deg_both, d AS n_both FROM deg")
def degree(spark, d):
    return trade_graph(spark, d).degrees()


@query(
    "degree_directed",
    """SELECT id, o AS out_deg, i AS in_deg, o + i AS deg_both, o + i AS n_both FROM (
  SELECT id, (SELECT count(*) FROM links WHERE a = id) AS o, (SELECT count(*) FROM links WHERE b = id) AS i FROM nodes)""",
)
def degree_directed(spark, d):
    return directed_trade_graph(spark, d).degrees()


@query("neighbours_both", "SELECT src, dst FROM arcs")
def neighbours_both(spark, d):
    return directed_trade_graph(spark, d).neighbours("both")


@query("neighbours_in", "SELECT b AS src, a AS dst FROM links")
def neighbours_in(spark, d):
    return directed_trade_graph(spark, d).neighbours("in")


@query(
    "node_lookup",
    "SELECT k.id, n.type, CASE WHEN n.id IS NULL THEN NULL ELSE CAST(1 AS DOUBLE) END AS weight, n.id IS NOT NULL AS found FROM (SELECT 'S:' || c_custkey AS id FROM customer) k LEFT JOIN nodes n ON n.id = k.id",
)
def node_lookup(spark, d):
    keys = table(spark, d, "customer").select(F.concat(F.lit("S:"), F.col("c_custkey").cast("string")).alias("id"))
    return trade_graph(spark, d).lookup_nodes(keys)


@query("density", "SELECT n, m, 2.0 * m / (n * (n - 1)) AS density FROM (SELECT count(*) AS n FROM nodes), (SELECT count(*) AS m FROM edges)")
def density(spark, d):
    return trade_graph(spark, d).density()


@query("edge_type_counts", "SELECT type, count(*) AS n FROM edges GROUP BY type")
def edge_type_counts(spark, d):
    return neighbours.edge_type_counts(trade_graph(spark, d))


@query("node_type_counts", "SELECT type, count(*) AS n FROM nodes GROUP BY type")
def node_type_counts(spark, d):
    return neighbours.node_type_counts(trade_graph(spark, d))


@query(
    "degree_histogram",
    """SELECT g AS degree, count(id) AS n FROM (SELECT unnest(range(0, (SELECT max(d) + 1 FROM deg))) AS g)
LEFT JOIN deg ON d = g GROUP BY g""",
)
def degree_histogram(spark, d):
    return neighbours.degree_histogram(trade_graph(spark, d))


@query("degree_stats", "SELECT min(d) AS least, max(d) AS greatest, avg(d) AS mean FROM deg")
def degree_stats(spark, d):
    return neighbours.degree_stats(trade_graph(spark, d))


@query(
    "validate",
    """SELECT 'empty node id' AS rule, (SELECT count(*) FROM nodes WHERE id IS NULL OR id = '') AS n
UNION ALL SELECT 'negative node weight', CAST(0 AS BIGINT)
UNION ALL SELECT 'negative edge weight', (SELECT count(*) FROM edges WHERE weight < 0)
UNION ALL SELECT 'unknown endpoint', (SELECT count(*) FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) e ANTI JOIN nodes n ON n.id = e.id)
UNION ALL SELECT 'repeated node', (SELECT count(*) FROM (SELECT id FROM nodes GROUP BY id HAVING count(*) > 1))
UNION ALL SELECT 'repeated edge', (SELECT count(*) FROM (SELECT src, dst FROM edges GROUP BY ALL HAVING count(*) > 1))""",
)
def validate(spark, d):
    return trade_graph(spark, d).violations()


@query(
    "csr",
    """SELECT idx, id, coalesce(nbr_idx, '') AS nbr_idx FROM ix LEFT JOIN (
  SELECT src, string_agg(CAST(j.idx AS VARCHAR), ',' ORDER BY j.idx) AS nbr_idx FROM arcs JOIN ix j ON j.id = dst GROUP BY src) ON src = id""",
    "ix AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM nodes)",
)
def csr(spark, d):
    rows = trade_graph(spark, d).csr()
    return rows.select("idx", "id", F.array_join(F.transform("nbr_idx", lambda i: i.cast("string")), ",").alias("nbr_idx"))


# --- similarity -------------------------------------------------------------------------------------------------

PAIRS = """pr AS MATERIALIZED (SELECT src AS u, dst AS v, type AS etype FROM edges),
com AS MATERIALIZED (
  SELECT p.u, p.v, count(*) AS shared, sum(1 / ln(w.d + 1)) AS aa, sum(1.0 / w.d) AS ra
  FROM pr p JOIN arcs x ON x.src = p.u JOIN arcs y ON y.src = p.v AND y.dst = x.dst JOIN deg w ON w.id = x.dst
  WHERE x.dst <> p.u AND x.dst <> p.v GROUP BY ALL
), f AS MATERIALIZED (
  SELECT p.u, p.v, p.etype, a.d AS du, b.d AS dv, a.d - 1 AS a, b.d - 1 AS b, coalesce(c.shared, 0) AS shared,
    coalesce(c.aa, 0) AS aa, coalesce(c.ra, 0) AS ra,
    CASE WHEN a.d + b.d - 2 - coalesce(c.shared, 0) > 0
      THEN coalesce(c.shared, 0) / (a.d + b.d - 2 - coalesce(c.shared, 0)) ELSE 0 END AS j
  FROM pr p JOIN deg a ON a.id = p.u JOIN deg b ON b.id = p.v LEFT JOIN com c ON c.u = p.u AND c.v = p.v
), g AS (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM edges) AS m)"""
CLUSTERING = """tri AS MATERIALIZED (
  SELECT x.src AS a, x.dst AS b, y.dst AS c FROM edges x JOIN edges y ON y.src = x.dst
  JOIN edges z ON z.src = x.src AND z.dst = y.dst
), tc AS MATERIALIZED (
  SELECT id, count(t) AS t FROM nodes LEFT JOIN (SELECT unnest([a, b, c]) AS t FROM tri) ON t = id GROUP BY id
), cc AS MATERIALIZED (
  SELECT id, CASE WHEN d >= 2 THEN t / (d * (d - 1) / 2.0) ELSE 0 END AS c FROM tc JOIN deg USING (id)
)"""
_E = "1e-10"
FORMULAS = {
    "jaccard": f"CASE WHEN a + b > 0 THEN greatest({_E}, j) ELSE 0 END",
    "adamic_adar": f"greatest({_E}, CASE WHEN shared > 0 THEN aa / (shared / ln(2)) ELSE 0 END)",
    "cosine": f"CASE WHEN a > 0 AND b > 0 THEN greatest({_E}, shared / (sqrt(a) * sqrt(b))) ELSE 0 END",
    "sorensen": f"CASE WHEN a + b > 0 THEN greatest({_E}, 2.0 * shared / (a + b)) ELSE 0 END",
    "resource_allocation": f"greatest({_E}, CASE WHEN shared > 0 THEN ra / shared ELSE 0 END)",
    "overlap": f"CASE WHEN a > 0 AND b > 0 THEN greatest({_E}, shared / least(a, b)) ELSE 0 END",
    "hub_promoted": f"CASE WHEN du > 0 AND dv > 0 THEN greatest({_E}, shared / least(du, dv)) ELSE 0 END",
    "scale": f"greatest({_E}, j / (2.0 * m / (n * (n - 1))))",
    "skew": f"greatest({_E}, j * ln(n / (du + 1)) * ln(n / (dv + 1)))",
    "span": f"greatest({_E}, j * (1 - greatest((SELECT c FROM cc WHERE id = u), (SELECT c FROM cc WHERE id = v))))",
    "etch": f"greatest({_E}, j * ln(m / (SELECT count(*) FROM edges e WHERE e.type = etype)))",
    "notch": f"""greatest({_E}, j * ln(n / (SELECT count(*) FROM nodes x WHERE x.type = (SELECT type FROM nodes y WHERE y.id = u)))
      * ln(n / (SELECT count(*) FROM nodes x WHERE x.type = (SELECT type FROM nodes y WHERE y.id = v))))""",
    "adaptive": f"""least(1, greatest({_E}, 0.4 * CASE WHEN a + b > 0 THEN greatest({_E}, j) ELSE 0 END
      + 0.3 * greatest({_E}, CASE WHEN shared > 0 THEN aa / (shared / ln(2)) ELSE 0 END)
      + 0.3 * greatest({_E}, CASE WHEN a > 0 AND b > 0 THEN shared / least(a, b) ELSE {_E} END)))""",
}
_TYPES = ", nt AS MATERIALIZED (SELECT id, count(*) OVER (PARTITION BY type) AS c FROM nodes)"
FORMULAS["notch"] = f"""greatest({_E}, j * ln(n / (SELECT c FROM nt WHERE id = u)) * ln(n / (SELECT c FROM nt WHERE id = v)))"""


def _similarity(variant: str):
    more = {"span": ", " + CLUSTERING, "notch": _TYPES}.get(variant, "")
    sql = f"SELECT u, v, round({FORMULAS[variant]}, {DIGITS}) AS {variant} FROM f, g"

    @query(variant, sql, PAIRS + more)
    def run(spark, d):
        graph = trade_graph(spark, d).settled()
        return rounded(similarity.pair_similarity(graph, linked(graph), (variant,)), variant)

    return run


for _variant in similarity.VARIANTS:
    _similarity(_variant)


@query(
    "batch_similarity",
    f"""SELECT u, v, s AS shared, du AS a, dv AS b, round(s / (du + dv - s), {DIGITS}) AS jaccard,
  round(s / sqrt(du * dv), {DIGITS}) AS cosine, round(2.0 * s / (du + dv), {DIGITS}) AS dice,
  round(s / least(du, dv), {DIGITS}) AS overlap FROM (SELECT *, shared AS s FROM f)""",
    PAIRS,
)
def batch_similarity(spark, d):
    graph = trade_graph(spark, d).settled()
    return rounded(similarity.batch_similarity(graph, linked(graph)), "jaccard", "cosine", "dice", "overlap")


# --- neighbourhoods ---------------------------------------------------------------------------------------------


@query("triangles", "SELECT id, t AS triangles FROM tc", CLUSTERING)
def triangle_counts(spark, d):
    return neighbours.triangle_counts(trade_graph(spark, d).settled())


@query("clustering", f"SELECT id, round(c, {DIGITS}) AS clustering FROM cc", CLUSTERING)
def clustering(spark, d):
    return rounded(neighbours.clustering(trade_graph(spark, d).settled()), "clustering")


@query(
    "approximate_clustering",
    f"""SELECT nodes.id, round(coalesce(avg(CASE WHEN e.src IS NULL THEN 0.0 ELSE 1.0 END) FILTER (WHERE p.u IS NOT NULL), 0), {DIGITS}) AS clustering
FROM nodes LEFT JOIN p ON p.src = nodes.id LEFT JOIN edges e ON e.src = p.u AND e.dst = p.v GROUP BY nodes.id""",
    """r AS MATERIALIZED (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS i FROM arcs),
p AS MATERIALIZED (
  SELECT x.src, x.dst AS u, y.dst AS v FROM r x JOIN r y ON x.src = y.src AND x.i < y.i AND y.i <= 101 AND x.i <= 101
  QUALIFY row_number() OVER (PARTITION BY x.src ORDER BY x.dst, y.dst) <= 100
)""",
)
def approximate_clustering(spark, d):
    return rounded(neighbours.approximate_clustering(trade_graph(spark, d).settled()), "clustering")


@query(
    "local_density",
    f"""SELECT id, round(CASE WHEN k >= 2 THEN coalesce(t, 0) / (k * (k - 1) / 2.0) ELSE 0 END, {DIGITS}) AS density
FROM nodes LEFT JOIN (SELECT a AS ka, count(*) AS k FROM links GROUP BY a) ON ka = id
LEFT JOIN (SELECT x.a AS ta, count(*) AS t FROM links x JOIN links y ON x.a = y.a AND x.b < y.b
  JOIN links z ON z.a = x.b AND z.b = y.b GROUP BY x.a) ON ta = id""",
)
def local_density(spark, d):
    return rounded(neighbours.local_density(directed_trade_graph(spark, d).settled()), "density")


ENTROPY = """tk AS MATERIALIZED (
  SELECT src, n.type, count(*) AS c FROM arcs JOIN nodes n ON n.id = dst GROUP BY ALL
), te AS MATERIALIZED (
  SELECT src, sum(c) AS n, count(*) AS kinds, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS bits FROM tk GROUP BY src
), ent AS MATERIALIZED (
  SELECT id, CASE WHEN n > 1 AND kinds > 1 THEN bits / log2(kinds) ELSE 0 END AS h FROM nodes LEFT JOIN te ON src = id
)"""


@query("type_entropy", f"SELECT id, round(h, {DIGITS}) AS entropy FROM ent", ENTROPY)
def type_entropy(spark, d):
    return rounded(neighbours.type_entropy(trade_graph(spark, d).settled()), "entropy")


# --- ranking ----------------------------------------------------------------------------------------------------

HOPS = """hop AS MATERIALIZED (
  SELECT path_id, nodes[i] AS u, nodes[i + 1] AS v FROM (SELECT *, unnest([1, 2, 3]) AS i FROM paths)
)"""
SCORED = f"{PATHS_SQL}, {HOPS}, {PAIRS}"
_MI = "JOIN f ON f.u = least(h.u, h.v) AND f.v = greatest(h.u, h.v), g"


def _salience(variant: str) -> str:
    mi = FORMULAS[variant]
    return f"""sal AS (SELECT path_id, least(1, greatest({_E}, exp(avg(ln(greatest({_E}, mi)))))) AS salience FROM (
  SELECT path_id, {mi} AS mi FROM hop h {_MI}) GROUP BY path_id)"""


for _variant in ("jaccard", "scale"):

    @query(
        f"parse_{_variant}",
        f"SELECT path_id, round(salience, {DIGITS}) AS salience FROM sal",
        f"{SCORED}, {_salience(_variant)}",
    )
    def _parse(spark, d, variant=_variant):
        graph = trade_graph(spark, d).settled()
        found = ranking.parse(graph, trade_paths(spark, d, graph), variant)
        return rounded(found.select("path_id", "salience"), "salience")


@query(
    "parse_stats",
    f"""SELECT count(*) AS paths_ranked, round(avg(salience), {DIGITS}) AS mean_salience,
  round(median(salience), {DIGITS}) AS median_salience, round(max(salience), {DIGITS}) AS max_salience,
  round(min(salience), {DIGITS}) AS min_salience FROM sal""",
    f"{SCORED}, {_salience('jaccard')}",
)
def parse_stats(spark, d):
    graph = trade_graph(spark, d).settled()
    stats = ranking.parse_stats(ranking.parse(graph, trade_paths(spark, d, graph)))
    return rounded(stats, *(c for c in stats.columns if c != "paths_ranked"))


def _baseline(name: str, score: str | None, ctes: str = SCORED, digits: int = DIGITS, options=lambda graph: {}) -> None:
    """A baseline's normalised scores; ``score`` is a query of (path_id, s), ``options`` what the measure is given."""
    sql = score and (
        f"SELECT path_id, round(CASE WHEN max(s) OVER () > 0 THEN s / max(s) OVER () ELSE 0 END, {digits}) AS score FROM ({score})"
    )

    @query(f"rank_{name}", sql, ctes)
    def run(spark, d):
        graph = trade_graph(spark, d).settled()
        found = ranking.rank(graph, trade_paths(spark, d, graph), name, **options(graph))
        return rounded(found.select("path_id", "score"), "score", digits=digits)


_JACCARD = FORMULAS["jaccard"]
_baseline("shortest", "SELECT path_id, 1.0 / len(nodes) AS s FROM paths", PATHS_SQL)
_baseline("degree_sum", "SELECT path_id, sum(d) AS s FROM (SELECT path_id, unnest(nodes) AS id FROM paths) JOIN deg USING (id) GROUP BY 1", PATHS_SQL)
_baseline("widest_path", f"SELECT path_id, min(mi) AS s FROM (SELECT path_id, {_JACCARD} AS mi FROM hop h {_MI}) GROUP BY 1")
_baseline("jaccard_arithmetic", f"SELECT path_id, avg(mi) AS s FROM (SELECT path_id, {_JACCARD} AS mi FROM hop h {_MI}) GROUP BY 1")
_baseline("random_ranking", f"SELECT path_id, {drawn_sql("array_to_string(nodes, ',')", seed=0)} / CAST({1 << BITS} AS DOUBLE) AS s FROM paths")


def _powers(steps: int) -> str:
    """CTEs w1..wk: walks of each length from path starts to path ends (both different pairs)."""
    out = ["ends AS MATERIALIZED (SELECT DISTINCT nodes[1] AS u, nodes[4] AS v FROM paths)"]
    out.append("w0 AS MATERIALIZED (SELECT DISTINCT v AS target, v AS node, CAST(1 AS DOUBLE) AS c FROM ends)")
    for k in range(1, steps + 1):
        out.append(
            f"w{k} AS MATERIALIZED (SELECT target, src AS node, sum(c) AS c FROM w{k - 1} JOIN arcs ON dst = node GROUP BY ALL)"
        )
    return ", ".join([PATHS_SQL, *out])


def _series(weights: list[str], start: str) -> str:
    terms = " + ".join(
        f"{w} * coalesce((SELECT c FROM w{k} WHERE target = v AND node = u), 0)" for k, w in enumerate(weights, 1)
    )
    return f"SELECT path_id, s FROM paths JOIN (SELECT u, v, {start} + {terms} AS s FROM ends) ON u = nodes[1] AND v = nodes[4]"


import math  # noqa: E402

_baseline("katz", _series([f"{0.005**k!r}" for k in range(1, 6)], "0"), _powers(5))
_baseline("communicability", _series([f"{1 / math.factorial(k)!r}" for k in range(1, 16)], "0"), _powers(15))


# --- fix-points -------------------------------------------------------------------------------------------------


def _pagerank_sql(rounds: int) -> str:
    out = ["r0 AS MATERIALIZED (SELECT id, 1.0 / (SELECT count(*) FROM nodes) AS r FROM nodes)"]
    for k in range(1, rounds + 1):
        out.append(
            f"""r{k} AS MATERIALIZED (SELECT nodes.id, 0.15 / (SELECT count(*) FROM nodes) + 0.85 * coalesce(sum(p.r / deg.d), 0) AS r
  FROM nodes LEFT JOIN arcs ON dst = nodes.id LEFT JOIN r{k - 1} p ON p.id = src LEFT JOIN deg ON deg.id = src GROUP BY nodes.id)"""
        )
    return ", ".join(out)


@query("pagerank_10", "SELECT id, round(r, 12) AS rank FROM r10", _pagerank_sql(10))
def pagerank_10(spark, d):
    return rounded(linalg.pagerank(trade_graph(spark, d), iterations=10, tolerance=None), "rank", digits=12)


@query("pagerank_20", "SELECT id, round(r, 12) AS rank FROM r20", _pagerank_sql(20))
def pagerank_20(spark, d):
    return rounded(linalg.pagerank(trade_graph(spark, d), iterations=20, tolerance=None), "rank", digits=12)


_baseline(
    "pagerank",
    "SELECT path_id, sum(r) AS s FROM (SELECT path_id, unnest(nodes) AS id FROM paths) JOIN r20 USING (id) GROUP BY 1",
    f"{PATHS_SQL}, {_pagerank_sql(20)}",
    options=lambda graph: {"iterations": 20, "tolerance": None},
)


@query("spmv", "SELECT id, coalesce(sum(weight * d), 0) AS y FROM nodes LEFT JOIN (SELECT src, weight, d FROM arcs JOIN deg ON deg.id = dst) ON src = nodes.id GROUP BY nodes.id")
def spmv(spark, d):
    graph = trade_graph(spark, d)
    return linalg.spmv(graph, graph.degrees().select("id", F.col("out_deg").alias("x")))


BFS = """lv AS (
  SELECT 'R:0' AS id, 0 AS level UNION
  SELECT dst, level + 1 FROM lv JOIN arcs ON src = id WHERE level < 6
), b AS MATERIALIZED (SELECT id, min(level) AS level FROM lv GROUP BY id)"""


@query("bfs_levels", "SELECT nodes.id, coalesce(level, -1) AS level FROM nodes LEFT JOIN b USING (id)", BFS)
def bfs_levels(spark, d):
    return traversal.bfs_levels(trade_graph(spark, d), "R:0")


@query("bfs_summary", "SELECT max(level) + 1 AS depth, count(*) AS nodes_reached FROM b", BFS)
def bfs_summary(spark, d):
    return traversal.bfs_summary(trade_graph(spark, d), "R:0")


@query("bfs_tree", "SELECT 'R:0' AS start, c.id AS node, c.level AS depth, min(p.id) AS parent FROM b c LEFT JOIN arcs ON dst = c.id LEFT JOIN b p ON p.id = src AND p.level = c.level - 1 GROUP BY 2, 3", BFS)
def bfs_tree(spark, d):
    graph = trade_graph(spark, d)
    return traversal.bfs(graph, graph.nodes.where("id = 'R:0'"))


@query("ego", "SELECT src, dst, type FROM edges WHERE src IN (SELECT id FROM b WHERE level <= 2) AND dst IN (SELECT id FROM b WHERE level <= 2)", BFS)
def ego(spark, d):
    return traversal.ego_network(trade_graph(spark, d), "R:0", 2).edges.select("src", "dst", "type")


DFS = """t AS MATERIALIZED (
  SELECT a AS start, b AS s, row_number() OVER (PARTITION BY a ORDER BY b) AS i FROM links WHERE type = 'trades'
), home AS MATERIALIZED (
  SELECT x.a AS id, x.b AS n, y.b AS r FROM links x JOIN links y ON y.a = x.b WHERE x.type = 'located_in'
), away AS MATERIALIZED (
  SELECT t.start, t.i, t.s, h.n, h.r FROM t JOIN home h ON h.id = t.s JOIN home o ON o.id = t.start WHERE h.n <> o.n
  QUALIFY row_number() OVER (PARTITION BY t.start, h.n ORDER BY t.i) = 1
), far AS MATERIALIZED (
  SELECT a.* FROM away a JOIN home o ON o.id = a.start WHERE a.r <> o.r QUALIFY row_number() OVER (PARTITION BY a.start, a.r ORDER BY a.i) = 1
), v AS (
  SELECT id AS start, 0 AS i, 0 AS j, id AS node, 0 AS depth, NULL AS parent FROM nodes WHERE type = 'customer'
  UNION ALL SELECT id, 0, 1, n, 1, id FROM home WHERE id LIKE 'C:%'
  UNION ALL SELECT id, 0, 2, r, 2, n FROM home WHERE id LIKE 'C:%'
  UNION ALL SELECT start, i, 0, s, 1, start FROM t
  UNION ALL SELECT start, i, 1, n, 2, s FROM away
  UNION ALL SELECT start, i, 2, r, 3, n FROM far
)"""


@query("dfs", "SELECT start, CAST(row_number() OVER (PARTITION BY start ORDER BY i, j) - 1 AS INTEGER) AS step, node, depth, parent FROM v", DFS)
def dfs(spark, d):
    graph = directed_trade_graph(spark, d)
    return traversal.dfs(graph, graph.nodes.where("type = 'customer'"))


@query("induced", "SELECT e.src, e.dst FROM edges e JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE a.type IN ('customer', 'supplier') AND b.type IN ('customer', 'supplier')")
def induced(spark, d):
    graph = trade_graph(spark, d)
    return extract.induced(graph, graph.nodes.where("type in ('customer', 'supplier')")).edges.select("src", "dst")


@query(
    "filter_isolated",
    "SELECT n.id FROM nodes n WHERE n.type <> 'nation' AND EXISTS (SELECT 1 FROM links l WHERE l.weight >= 2 AND l.type = 'trades' AND (l.a = n.id OR l.b = n.id))",
)
def filter_isolated(spark, d):
    graph = extract.filter_graph(trade_graph(spark, d), F.col("type") != "nation", F.col("weight") >= 2, True)
    return graph.nodes.select("id")


def _core_sql(k: int, rounds: int) -> str:
    out = ["k0 AS MATERIALIZED (SELECT src AS a, dst AS b FROM edges)"]
    for i in range(1, rounds + 1):
        out.append(
            f"""k{i} AS MATERIALIZED (WITH q AS (SELECT id FROM (SELECT a AS id FROM k{i - 1} UNION ALL SELECT b FROM k{i - 1})
  GROUP BY id HAVING count(*) >= {k}) SELECT a, b FROM k{i - 1} WHERE a IN (SELECT id FROM q) AND b IN (SELECT id FROM q))"""
        )
    return ", ".join(out)


@query("kcore", "SELECT a AS src, b AS dst FROM k40", _core_sql(33, 40))
def kcore(spark, d):
    return extract.k_core(trade_graph(spark, d), 33).edges.select("src", "dst")


def _core_numbers_sql(rounds: int) -> str:
    """CTEs h0..h{rounds}: every node's bound becomes the h-index of its neighbours'."""
    out = ["h0 AS MATERIALIZED (SELECT id, d AS c FROM deg)"]
    for i in range(1, rounds + 1):
        out.append(
            f"""h{i} AS MATERIALIZED (SELECT h.id, least(any_value(h.c), coalesce(max(x.h), 0)) AS c FROM h{i - 1} h LEFT JOIN (
  SELECT src, least(c, row_number() OVER (PARTITION BY src ORDER BY c DESC)) AS h FROM arcs JOIN h{i - 1} ON id = dst) x ON x.src = h.id GROUP BY h.id)"""
        )
    return ", ".join(out)


@query("core_numbers", "SELECT id, CAST(c AS INTEGER) AS core FROM h30", _core_numbers_sql(30))
def core_numbers(spark, d):
    return extract.core_numbers(trade_graph(spark, d).settled())


@query(
    "edge_triangles",
    "SELECT e.src AS a, e.dst AS b, count(t.a) AS triangles FROM edges e LEFT JOIN sides t ON t.a = e.src AND t.b = e.dst GROUP BY ALL",
    CLUSTERING + ", sides AS MATERIALIZED (SELECT a, b FROM tri UNION ALL SELECT b, c FROM tri UNION ALL SELECT a, c FROM tri)",
)
def edge_triangles(spark, d):
    return extract.edge_triangles(trade_graph(spark, d).settled())


def _truss_sql(k: int, rounds: int) -> str:
    out = ["s0 AS MATERIALIZED (SELECT src, dst FROM edges)"]
    for i in range(1, rounds + 1):
        p = f"s{i - 1}"
        out.append(
            f"""s{i} AS MATERIALIZED (WITH t AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM {p} x JOIN {p} y ON y.src = x.dst
  JOIN {p} z ON z.src = x.src AND z.dst = y.dst), e AS (SELECT a, b FROM t UNION ALL SELECT b, c FROM t UNION ALL SELECT a, c FROM t)
  SELECT a AS src, b AS dst FROM e GROUP BY a, b HAVING count(*) >= {k - 2})"""
        )
    return ", ".join(out)


@query("ktruss", "SELECT src, dst FROM s12", _truss_sql(3, 12))
def ktruss(spark, d):
    return extract.k_truss(trade_graph(spark, d), 3).edges.select("src", "dst")


def _truss_numbers_sql(most: int, rounds: int) -> str:
    """CTEs s3..s{most}: the edges of each truss, every one peeled out of the one before."""
    out, before = [], "edges"
    for k in range(3, most + 1):
        for i in range(rounds):
            name = f"s{k}" if i == rounds - 1 else f"s{k}_{i}"
            out.append(
                f"""{name} AS MATERIALIZED (WITH t AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM {before} x JOIN {before} y ON y.src = x.dst
  JOIN {before} z ON z.src = x.src AND z.dst = y.dst), e AS (SELECT a, b FROM t UNION ALL SELECT b, c FROM t UNION ALL SELECT a, c FROM t)
  SELECT a AS src, b AS dst FROM e GROUP BY a, b HAVING count(*) >= {k - 2})"""
            )
            before = name
    return ", ".join(out)


@query(
    "truss_numbers",
    "SELECT a, b, CAST(max(k) AS INTEGER) AS truss FROM (SELECT src AS a, dst AS b, 2 AS k FROM edges "
    + " ".join(f"UNION ALL SELECT src, dst, {k} FROM s{k}" for k in range(3, 7))
    + ") GROUP BY a, b",
    _truss_numbers_sql(6, 6),
)
def truss_numbers(spark, d):
    return extract.truss_numbers(trade_graph(spark, d))


@query(
    "motif3",
    """SELECT pattern, name, CAST(c AS BIGINT) AS count FROM (
  SELECT unnest(['', '0-1', '0-1,0-2', '0-1,0-2,1-2']) AS pattern, unnest(['empty', '1-edge', '2-star', 'triangle']) AS name,
    unnest([n * (n - 1) * (n - 2) // 6 - (m * (n - 2) - 2 * (w - 3 * t) - 3 * t) - (w - 3 * t) - t,
      m * (n - 2) - 2 * (w - 3 * t) - 3 * t, w - 3 * t, t]) AS c
  FROM (SELECT (SELECT count(*) FROM nodes)::HUGEINT AS n, (SELECT count(*) FROM edges)::HUGEINT AS m,
    (SELECT count(*) FROM tri)::HUGEINT AS t, (SELECT sum(d * (d - 1)) // 2 FROM deg)::HUGEINT AS w)) WHERE c <> 0""",
    CLUSTERING,
)
def motif3(spark, d):
    return extract.motif_census(trade_graph(spark, d), 3)


#: Subgraphs of each connected shape, induced or not, then the induced ones.
MOTIF4 = (
    CLUSTERING
    + """, support AS MATERIALIZED (
  SELECT a, b, count(*) AS s FROM (SELECT a, b FROM tri UNION ALL SELECT b, c FROM tri UNION ALL SELECT a, c FROM tri) GROUP BY a, b
), ends2 AS MATERIALIZED (
  SELECT x.dst AS u, y.dst AS w, count(*) AS c FROM arcs x JOIN arcs y ON y.src = x.src AND x.dst < y.dst GROUP BY ALL
), raw AS (SELECT
  (SELECT count(*) FROM nodes)::HUGEINT AS n, (SELECT count(*) FROM edges)::HUGEINT AS m, (SELECT count(*) FROM tri)::HUGEINT AS t,
  (SELECT sum(d * (d - 1) // 2) FROM deg)::HUGEINT AS w, (SELECT sum(d::HUGEINT * (d - 1) * (d - 2) // 6) FROM deg) AS claws,
  (SELECT sum((a.d - 1) * (b.d - 1)) FROM edges JOIN deg a ON a.id = src JOIN deg b ON b.id = dst)::HUGEINT AS p,
  (SELECT sum(d - 2) FROM (SELECT unnest([a, b, c]) AS id FROM tri) JOIN deg USING (id))::HUGEINT AS paws,
  (SELECT coalesce(sum(s * (s - 1) // 2), 0) FROM support)::HUGEINT AS dias,
  (SELECT sum(c * (c - 1) // 2) // 2 FROM ends2)::HUGEINT AS cycles,
  (SELECT count(*) FROM tri x JOIN tri y ON y.a = x.a AND y.b = x.b AND x.c < y.c JOIN edges e ON e.src = x.c AND e.dst = y.c)::HUGEINT AS k4
), q1 AS (SELECT *, dias - 6 * k4 AS dia FROM raw),
q2 AS (SELECT *, cycles - dia - 3 * k4 AS cyc, paws - 4 * dia - 12 * k4 AS paw FROM q1),
q3 AS (SELECT *, p - 3 * t - 4 * cyc - 2 * paw - 6 * dia - 12 * k4 AS path, claws - paw - 2 * dia - 4 * k4 AS claw,
  t * (n - 3) - paw - 2 * dia - 4 * k4 AS t4 FROM q2),
q4 AS (SELECT *, m * (m - 1) // 2 - w - path - 2 * cyc - paw - 2 * dia - 3 * k4 AS mat,
  w * (n - 3) - 3 * t4 - 3 * claw - 2 * path - 5 * paw - 4 * cyc - 8 * dia - 12 * k4 AS star FROM q3),
q5 AS (SELECT *, m * (n - 2) * (n - 3) // 2 - 2 * star - 2 * mat - 3 * (t4 + claw + path) - 4 * (paw + cyc) - 5 * dia - 6 * k4 AS one FROM q4),
q6 AS (SELECT *, n * (n - 1) * (n - 2) * (n - 3) // 24 - star - mat - t4 - claw - path - paw - cyc - dia - k4 - one AS none FROM q5)"""
)


@query(
    "motif4",
    """SELECT pattern, name, CAST(c AS BIGINT) AS count FROM (SELECT
  unnest(['', '0-1', '0-1,0-2', '0-1,2-3', '0-1,0-2,1-2', '0-1,0-2,0-3', '0-1,0-2,1-3', '0-1,0-2,0-3,1-2', '0-1,0-2,1-3,2-3',
    '0-1,0-2,0-3,1-2,1-3', '0-1,0-2,0-3,1-2,1-3,2-3']) AS pattern,
  unnest(['empty', '1-edge', '2-star', 'matching', 'triangle', '3-star', 'path-4', 'paw', '4-cycle', 'diamond', 'K4']) AS name,
  unnest([none, one, star, mat, t4, claw, path, paw, cyc, dia, k4]) AS c FROM q6) WHERE c <> 0""",
    MOTIF4,
)
def motif4(spark, d):
    return extract.motif_census(trade_graph(spark, d), 4)


def _betweenness_sql(kind: str, depth: int) -> str:
    """CTE bt (id, b) from all nodes of a type; v0..: shortest path counts by level, d0..: what hangs on them."""
    out = [f"v0 AS MATERIALIZED (SELECT id AS s, id AS node, CAST(1 AS DOUBLE) AS sigma FROM nodes WHERE type LIKE '{kind}')"]
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT s, node FROM v{i}" for i in range(k))
        out.append(
            f"""v{k} AS MATERIALIZED (SELECT x.s, x.dst AS node, x.sigma FROM (
  SELECT s, dst, sum(sigma) AS sigma FROM v{k - 1} JOIN arcs ON src = node GROUP BY ALL) x ANTI JOIN ({seen}) y ON y.s = x.s AND y.node = x.dst)"""
        )
    out.append(f"d{depth} AS (SELECT s, node, sigma, CAST(0 AS DOUBLE) AS delta FROM v{depth})")
    for k in range(depth - 1, -1, -1):
        out.append(
            f"""d{k} AS MATERIALIZED (SELECT v.s, v.node, v.sigma, coalesce(sum(v.sigma / w.sigma * (1 + w.delta)), 0) AS delta
  FROM v{k} v LEFT JOIN (SELECT d.s, d.sigma, d.delta, src FROM d{k + 1} d JOIN arcs ON dst = d.node) w ON w.s = v.s AND w.src = v.node GROUP BY ALL)"""
        )
    each = " UNION ALL ".join(f"SELECT node, delta FROM d{k} WHERE s <> node" for k in range(depth + 1))
    out.append(f"bt AS MATERIALIZED (SELECT id, coalesce(sum(delta), 0) AS b FROM nodes LEFT JOIN ({each}) ON node = id GROUP BY id)")
    return ", ".join(out)


BETWEENNESS = _betweenness_sql("region", 7)


@query("betweenness", "SELECT id, round(b, 6) AS betweenness FROM bt", BETWEENNESS)
def betweenness(spark, d):
    """From the regions; all sources make a row per source and node."""
    graph = trade_graph(spark, d)
    return rounded(linalg.betweenness(graph, graph.nodes.where("type = 'region'")), "betweenness", digits=6)


@query("betweenness_all", "SELECT id, round(b, 4) AS betweenness FROM bt", _betweenness_sql("%", 7))
def betweenness_all(spark, d):
    """Over all pairs of nodes."""
    return rounded(linalg.betweenness(trade_graph(spark, d)), "betweenness", digits=4)


_baseline(
    "betweenness",
    "SELECT path_id, sum(b) AS s FROM (SELECT path_id, unnest(nodes) AS id FROM paths) JOIN bt USING (id) GROUP BY 1",
    f"{PATHS_SQL}, {BETWEENNESS}",
    digits=6,
    options=lambda graph: {"sources": graph.nodes.where("type = 'region'")},
)


def _labels_sql(rounds: int) -> str:
    out = ["l0 AS MATERIALIZED (SELECT id, id AS label FROM nodes)"]
    for k in range(1, rounds + 1):
        out.append(
            f"""l{k} AS MATERIALIZED (SELECT o.id, coalesce(t.label, o.label) AS label FROM l{k - 1} o LEFT JOIN (
  SELECT src, label FROM (SELECT src, label, count(*) AS n FROM arcs JOIN l{k - 1} ON id = dst GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY src ORDER BY n DESC, label) = 1) t ON t.src = o.id)"""
        )
    return ", ".join(out)


@query(
    "label_propagation",
    """SELECT c.id, CASE WHEN (SELECT count(*) FROM l30 x JOIN l28 y ON y.id = x.id AND y.label <> x.label) = 0
  THEN least(b.label, c.label) ELSE c.label END AS label FROM l29 b JOIN l30 c ON c.id = b.id""",
    _labels_sql(30),
)
def label_propagation(spark, d):
    return linalg.label_propagation(trade_graph(spark, d))
