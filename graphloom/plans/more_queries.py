"""Registered queries of exploration, seed selection, statistics and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import stats
from graphloom.operators import dense, explore, extract, linalg, metrics, ranking, seeds, traversal
from graphloom.operators.neighbours import clustering, triangle_counts, type_entropy
from graphloom.plans import cut, numbered
from graphloom.plans.draws import BITS, drawn_sql
from graphloom.plans.explore_queries import SEEDS, seed_sets
from graphloom.plans.queries import _MI, CLUSTERING, DIGITS, ENTROPY, FORMULAS, SCORED, _salience, query, rounded
from graphloom.sources import PropertyGraph, directed_trade_graph, table, trade_graph, trade_paths
from graphloom.sources.tables import PATHS_SQL

def _walk_sql(walks: int, length: int, restart: float) -> tuple[str, str]:
    """The meetings of all walks, and their CTEs."""
    draw = lambda n: drawn_sql("w.sid", "w.f", "walk", "step + 1", f"'{n}'", seed=0)
    ctes = f"""near AS MATERIALIZED (SELECT src, list_sort(list(dst)) AS l FROM arcs GROUP BY src), walked AS (
  SELECT sid, f, id AS home, walk, 0 AS step, id AS node FROM seeds, (SELECT unnest(range({walks})) AS walk)
  UNION ALL SELECT w.sid, w.f, home, walk, step + 1, CASE WHEN l IS NULL OR {draw("back")} < {int(restart * (1 << BITS))} THEN home ELSE l[1 + {draw("to")} % len(l)] END
  FROM walked w LEFT JOIN near ON src = node WHERE step < {length}), seen AS (SELECT DISTINCT sid, f, home, node FROM walked)"""
    sql = """SELECT a.sid AS seed_set_id, any_value(a.home) AS from_seed, min(a.node) AS node, any_value(b.home) AS to_seed
FROM seen a JOIN seen b ON b.sid = a.sid AND b.node = a.node AND a.f < b.f GROUP BY a.sid, a.f, b.f"""
    return sql, f"{', '.join(SEEDS)}, {ctes}"


@query("random_walk", *_walk_sql(10, 20, 0.15))
def random_walk(spark, d):
    graph = trade_graph(spark, d).settled()
    return explore.random_walk(graph, seed_sets(graph))[1]


@query(
    "khop",
    """SELECT pos, node, min(depth) AS depth FROM (
  SELECT pos, id AS node, 0 AS depth FROM s UNION ALL SELECT pos, x.dst, 1 FROM s JOIN arcs x ON x.src = id
  UNION ALL SELECT pos, y.dst, 2 FROM s JOIN arcs x ON x.src = id JOIN arcs y ON y.src = x.dst) GROUP BY ALL""",
    "s AS (SELECT CAST(substr(id, 3) AS BIGINT) AS pos, id FROM nodes WHERE type = 'region')",
)
def khop(spark, d):
    graph = trade_graph(spark, d).settled()
    regions = graph.nodes.where("type = 'region'").select(F.substring("id", 3, 20).cast("long").alias("pos"), "id")
    return traversal.k_hop(graph, regions, 2)[1]


@query(
    "tide_priority",
    "SELECT id, d + coalesce((SELECT sum(n.d) FROM arcs JOIN deg n ON n.id = dst WHERE src = deg.id), 0) AS priority FROM deg",
)
def tide_priority(spark, d):
    graph = trade_graph(spark, d)
    degree = graph.degrees().select("id", F.col("out_deg").alias("x"))
    return degree.join(linalg_sum(graph, degree), "id").select("id", (F.col("x") + F.col("y")).alias("priority"))


def linalg_sum(graph, values):
    """(id, y): sum of ``values`` (id, x) over neighbours."""
    flat = PropertyGraph(graph.nodes, graph.edges.withColumn("weight", F.lit(1.0)), graph.directed)
    return linalg.spmv(flat, values)


@query("hae_priority", "SELECT deg.id, round(1 / (h + 1e-10) * ln(d + 1), 3) AS priority FROM deg JOIN ent ON ent.id = deg.id WHERE h > 0", ENTROPY)
def hae_priority(spark, d):
    graph = trade_graph(spark, d)
    rows = graph.degrees().join(type_entropy(graph), "id").where("entropy > 0")
    return rows.select("id", F.round(F.ln(F.col("out_deg") + 1) / (F.col("entropy") + 1e-10), 3).alias("priority"))


# --- seeds ------------------------------------------------------------------------------------------------------


@query("stride_triads", "SELECT id, t AS triangles FROM tc", CLUSTERING)
def stride_triads(spark, d):
    return triangle_counts(trade_graph(spark, d))


@query(
    "spine_skewness",
    """SELECT nodes.id, round(CASE WHEN n >= 3 AND v >= 1e-10 THEN m3 / pow(v, 1.5) ELSE 0 END, 6) AS value FROM nodes LEFT JOIN (
  SELECT src, count(*) AS n, avg((d - mu) ** 2) AS v, avg((d - mu) ** 3) AS m3 FROM (
    SELECT src, d, avg(d) OVER (PARTITION BY src) AS mu FROM arcs JOIN deg ON deg.id = dst) GROUP BY src) ON src = nodes.id""",
)
def spine_skewness(spark, d):
    return rounded(seeds.neighbour_skewness(trade_graph(spark, d)), "value", digits=6)


@query(
    "crest_bridge",
    f"""SELECT a AS source, b AS target, round(CASE WHEN s > 0 THEN (da + db - 2 * s) / s ELSE 1.0 / greatest(da + db - 2 * s, 1) END, {DIGITS}) AS score
FROM (SELECT l.a, l.b, x.d AS da, y.d AS db, (SELECT count(*) FROM arcs p JOIN arcs q ON q.dst = p.dst WHERE p.src = l.a AND q.src = l.b) AS s
  FROM links l JOIN deg x ON x.id = l.a JOIN deg y ON y.id = l.b WHERE l.type = 'trades')""",
)
def crest_bridge(spark, d):
    graph = trade_graph(spark, d)
    pairs = graph.edges.where("type = 'trades'").select(F.col("src").alias("source"), F.col("dst").alias("target"))
    return rounded(seeds.bridge_scores(graph, pairs), "score")


def _selector(name: str, run) -> None:
    @query(name)
    def select(spark, d):
        return rounded(run(trade_graph(spark, d)), "score")


_selector("stride", lambda g: seeds.stride(g))
_selector("crest", lambda g: seeds.crest(g))
_selector("spine", lambda g: seeds.spine(g))
_selector("crisp", lambda g: seeds.crisp(g))
_selector("grasp", lambda g: seeds.grasp(g, clusters=24))
for _name in seeds.ENSEMBLES:
    _selector(_name, lambda g, n=_name: seeds.ensemble(g, n))


def _stratum_sql(name: str, condition: str) -> str:
    draw = lambda n: drawn_sql(f"'{name}'", "draw", f"'{n}'", seed=42)
    return f"""SELECT '{name}' AS stratum, fa, fb, CAST({draw("i")} % na AS BIGINT) AS i, CAST({draw("j")} % (nb - same) AS BIGINT) AS j, same
  FROM (SELECT *, sum(pairs) OVER (ORDER BY fa, fb) - pairs AS start, sum(pairs) OVER () AS total FROM kinds WHERE {condition}), (SELECT unnest(range(10)) AS draw)
  WHERE draw < total AND {draw("pair")} % total >= start AND {draw("pair")} % total < start + pairs"""


@query(
    "stratified",
    """SELECT p.stratum, x.id AS source, y.id AS target, p.same = 1 AS same_field FROM picks p
JOIN ranked x ON x.type = fa AND x.k = i JOIN ranked y ON y.type = fb AND y.k = j + CASE WHEN p.same = 1 AND j >= i THEN 1 ELSE 0 END""",
    f"""ranked AS MATERIALIZED (SELECT id, type, row_number() OVER (PARTITION BY type ORDER BY id) - 1 AS k FROM nodes),
sizes AS (SELECT type, count(*) AS n FROM nodes GROUP BY type), kinds AS MATERIALIZED (
  SELECT a.type AS fa, b.type AS fb, a.n AS na, b.n AS nb, CAST(a.type = b.type AS INTEGER) AS same,
    CASE WHEN a.type = b.type THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END AS pairs
  FROM sizes a JOIN sizes b ON a.type <= b.type WHERE a.type <> b.type OR a.n > 1
), picks AS MATERIALIZED ({_stratum_sql("same", "same = 1")} UNION ALL {_stratum_sql("across", "same = 0")})""",
)
def stratified(spark, d):
    strata = {"same": F.col("field_a") == F.col("field_b"), "across": F.col("field_a") != F.col("field_b")}
    return seeds.stratified(trade_graph(spark, d), F.col("type"), strata)[0]


# --- statistics -------------------------------------------------------------------------------------------------


@query(
    "zscore",
    f"""SELECT id, round((d - (SELECT avg(d) FROM deg)) / sqrt((SELECT var_pop(d) FROM deg) + 1e-10), {DIGITS}) AS out_deg FROM deg""",
)
def zscore(spark, d):
    return rounded(stats.z_scores(trade_graph(spark, d).degrees().select("id", "out_deg"), "out_deg"), "out_deg")


@query("type_share_entropy", f"SELECT round(-sum(p * log2(p)), {DIGITS}) AS entropy FROM (SELECT count(*) / (SELECT count(*) FROM nodes) AS p FROM nodes GROUP BY type)")
def type_share_entropy(spark, d):
    counts = trade_graph(spark, d).nodes.groupBy("type").agg(F.count("*").cast("double").alias("c"))
    folded = counts.agg(F.array_sort(F.collect_list("c")).alias("counts"))
    return folded.select(F.round(stats.entropy_of_counts(F.col("counts")), DIGITS).alias("entropy"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


@query(
    "kmeans_assign",
    f"""SELECT v.vec_id AS id, arg_min(c.label, [CAST(sqd AS DOUBLE), CAST(c.label AS DOUBLE)]) AS cluster, round(min(sqd), 6) AS distance FROM (
  SELECT e.vec_id, c.label, list_sum(list_transform(list_zip(e.embedding, c.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) ** 2)) AS sqd
  FROM embeddings e CROSS JOIN cen c) v JOIN cen c ON c.label = v.label GROUP BY v.vec_id""",
    "cen AS (SELECT label, embedding FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1)",
)
def kmeans_assign(spark, d):
    points = _vectors(spark, d)
    first = points.groupBy("label").agg(F.min_by("v", "id").alias("centre")).select(F.col("label").alias("cluster"), "centre")
    return rounded(stats.assign(points, first), "distance", digits=6)


_POINTS = "p AS MATERIALIZED (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
_GAP = "list_sum(list_transform(list_zip(v, centre), lambda z: (z[1] - z[2]) ** 2))"


def _start_sql(k: int) -> list[str]:
    """CTEs: the points, and k-means++ centres c0, c1, …, each with those before it."""
    draw = lambda n: f"(({drawn_sql('id', str(n), seed=42)} + 1) / {float((1 << BITS) + 1)!r})"
    out = [_POINTS, f"c0 AS MATERIALIZED (SELECT 0 AS cluster, arg_min(v, {draw(0)}) AS centre FROM p)"]
    for n in range(1, k):
        out.append(f"""c{n} AS MATERIALIZED (SELECT * FROM c{n - 1} UNION ALL SELECT {n}, arg_min(v, -ln({draw(n)}) / d)
  FROM (SELECT id, v, (SELECT min({_GAP}) FROM c{n - 1}) AS d FROM p) WHERE d > 0)""")
    return out


def _steps_sql(first: str, rounds: int, batch=lambda r: "true") -> list[str]:
    """CTEs m0, m1, …: the centres after each step over the points that ``batch`` chooses."""
    out = [f"m0 AS MATERIALIZED (SELECT * FROM {first})"]
    for r in range(rounds):
        out.append(f"""m{r + 1} AS MATERIALIZED (SELECT m.cluster, coalesce(n.centre, m.centre) AS centre FROM m{r} m LEFT JOIN (
  SELECT cluster, list(x ORDER BY i) AS centre FROM (
    SELECT cluster, i, avg(v[i]) AS x FROM (
      SELECT v, (SELECT arg_min(cluster, [{_GAP}, cluster]) FROM m{r}) AS cluster FROM p WHERE {batch(r)}), (SELECT unnest(range(1, (SELECT max(len(v)) + 1 FROM p))) AS i)
    GROUP BY ALL) GROUP BY cluster) n USING (cluster))""")
    return out


_NEAREST = "SELECT id, (SELECT arg_min(cluster, [{gap}, cluster]) FROM {m}) AS cluster, round((SELECT min({gap}) FROM {m}), 6) AS distance FROM p"


@query("kmeans", _NEAREST.format(gap=_GAP, m="m6"), ", ".join([*_start_sql(10), *_steps_sql("c9", 6)]))
def kmeans(spark, d):
    """Six steps of Lloyd's from a k-means++ start."""
    return rounded(stats.lloyd(_vectors(spark, d).select("id", "v"), 10, iterations=6)[0], "distance", digits=6)


def _batch_sql(step: int) -> str:
    share = f"least(1.0, greatest(10, (SELECT count(*) FROM p) // 10) / (SELECT count(*) FROM p))"
    return f"{drawn_sql('id', str(step), chr(39) + 'batch' + chr(39), seed=42)} < CAST(trunc({share} * {1 << BITS}) AS BIGINT)"


@query("kmeans_minibatch", _NEAREST.format(gap=_GAP, m="m6"), ", ".join([*_start_sql(10), *_steps_sql("c9", 6, _batch_sql)]))
def kmeans_minibatch(spark, d):
    """Six steps over tenths of the points from a k-means++ start."""
    return rounded(stats.minibatch_kmeans(_vectors(spark, d).select("id", "v"), 10, iterations=6)[0], "distance", digits=6)


@query("kmeans_start", "SELECT cluster, i - 1 AS i, round(centre[i], 6) AS x FROM c9, (SELECT unnest(range(1, (SELECT max(len(v)) + 1 FROM p))) AS i)", ", ".join(_start_sql(10)))
def kmeans_start(spark, d):
    """Ten centres by k-means++."""
    centres = stats.plus_plus(_vectors(spark, d).select("id", "v"), 10)
    rows = spark.createDataFrame([(c, i, x) for c, v in enumerate(centres) for i, x in enumerate(v)], "cluster int, i long, x double")
    return rounded(rows, "x", digits=6)


@query(
    "csr_in",
    """SELECT i.idx, i.id, coalesce(string_agg(CAST(j.idx AS VARCHAR), ',' ORDER BY j.idx), '') AS neighbours
FROM ix i LEFT JOIN links l ON l.b = i.id LEFT JOIN ix j ON j.id = l.a GROUP BY ALL""",
    "ix AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM nodes)",
)
def csr_in(spark, d):
    """Compressed rows of the in-neighbours of the directed graph."""
    rows = directed_trade_graph(spark, d).settled().csr("in")
    return rows.select("idx", "id", F.array_join(F.col("nbr_idx").cast("array<string>"), ",").alias("neighbours"))


@query("hitting_time")
def hitting_time(spark, d):
    """Between every nation and its region, either way, and from every customer to the regions, over the whole graph."""
    graph = trade_graph(spark, d).settled()
    homes = graph.edges.where("type = 'part_of'").select(F.col("src").alias("u"), F.col("dst").alias("v"))
    kind = lambda k, e: graph.nodes.where(F.col("type") == k).select(F.col("id").alias(e))
    pairs = homes.union(homes.select("v", "u")).union(kind("customer", "u").crossJoin(F.broadcast(kind("region", "v"))))
    return rounded(dense.hitting_time(graph, pairs), "h", digits=4)


@query("rank_hitting_time")
def rank_hitting_time(spark, d):
    graph = trade_graph(spark, d).settled()
    found = ranking.rank(graph, trade_paths(spark, d, graph), "hitting_time")
    return rounded(found.select("path_id", "score"), "score", digits=6)


@query("rank_resistance")
def rank_resistance(spark, d):
    """From a sketch with a standard error of 13 % of a resistance at this size; no pair is measured on its own."""
    graph = trade_graph(spark, d).settled()
    found = ranking.rank(graph, trade_paths(spark, d, graph), "resistance", error=0.5)
    return rounded(found.select("path_id", "score"), "score", digits=6)


@query("resistance")
def resistance(spark, d):
    """Between every nation and its region, over the whole graph."""
    graph = trade_graph(spark, d)
    pairs = graph.edges.where("type = 'part_of'").select(F.col("src").alias("u"), F.col("dst").alias("v"))
    return rounded(dense.resistance(graph, pairs), "r", digits=6)


@query("salience_counts", "SELECT x AS id, count(*) AS salience FROM (SELECT unnest(nodes) AS x FROM paths) GROUP BY x", PATHS_SQL)
def salience_counts(spark, d):
    return metrics.salience_counts(trade_paths(spark, d))


@query(
    "motif_instances",
    "SELECT array_to_string(list_sort([a, b, c]), '>') AS nodes FROM tri",
    CLUSTERING,
)
def motif_instances(spark, d):
    found = extract.motif_instances(trade_graph(spark, d).settled(), "0-1,0-2,1-2")
    return found.select(F.array_join("nodes", ">").alias("nodes"))


@query("path_diversity", "SELECT count(DISTINCT x) AS diversity FROM (SELECT unnest(nodes[2:3]) AS x FROM paths)", PATHS_SQL)
def path_diversity(spark, d):
    return metrics.path_diversity(trade_paths(spark, d))


@query("hub_deferral", """SELECT avg(CASE WHEN d < (SELECT quantile_disc(d, 0.9) FROM deg) THEN 1.0 ELSE 0.0 END) AS ratio FROM deg JOIN nodes USING (id) WHERE type <> 'customer'""")
def hub_deferral(spark, d):
    graph = trade_graph(spark, d)
    return metrics.hub_deferral_ratio(graph, graph.nodes.where("type <> 'customer'"))


@query(
    "salience_spread",
    f"""SELECT round(coalesce(var_samp(salience), 0), {DIGITS}) AS score_variance,
  round(CASE WHEN stddev_pop(l) > 0 AND stddev_pop(salience) > 0 THEN covar_pop(l, salience) / (stddev_pop(l) * stddev_pop(salience)) ELSE 0 END, {DIGITS}) AS length_bias
FROM (SELECT CAST(len(nodes) AS DOUBLE) AS l, salience FROM sal JOIN paths USING (path_id))""",
    f"{SCORED}, {_salience('jaccard')}",
)
def salience_spread(spark, d):
    graph = trade_graph(spark, d).settled()
    found = metrics.score_spread(ranking.parse(graph, trade_paths(spark, d, graph)))
    return rounded(found, "score_variance", "length_bias")


@query(
    "hub_penalty",
    f"""SELECT round(coalesce(avg(salience) FILTER (WHERE d >= q), 0) / coalesce(avg(salience) FILTER (WHERE d < q), 0), {DIGITS}) AS ratio
FROM (SELECT salience, d, (SELECT quantile_disc(d, 0.9) FROM deg) AS q FROM sal JOIN paths USING (path_id) JOIN deg ON id = nodes[1])""",
    f"{SCORED}, {_salience('jaccard')}",
)
def hub_penalty(spark, d):
    """Paths from the customers of the highest degrees over those from all others."""
    graph = trade_graph(spark, d).settled()
    degree = graph.degrees().select(F.col("id").alias("first"), F.col("out_deg").alias("d"))
    top = degree.agg(F.expr("percentile_disc(0.9) within group (order by d)").alias("q"))
    ranked = ranking.parse(graph, trade_paths(spark, d, graph)).withColumn("first", F.get("nodes", F.lit(0)))
    ranked = ranked.join(degree, "first").crossJoin(F.broadcast(top))
    return rounded(metrics.mean_ratio(ranked, F.col("d") >= F.col("q"), F.col("d") < F.col("q")), "ratio")


@query(
    "path_mi",
    f"SELECT path_id, round(CASE WHEN min(mi) > 0 THEN exp(avg(ln(mi))) ELSE 0 END, {DIGITS}) AS mi FROM (SELECT path_id, {FORMULAS['overlap']} AS mi FROM hop h {_MI}) GROUP BY path_id",
    SCORED,
)
def path_mi(spark, d):
    graph = trade_graph(spark, d).settled()
    return rounded(metrics.path_mi(ranking.scored_hops(graph, trade_paths(spark, d, graph), "overlap")), "mi")


@query(
    "rank_agreement",
    f"""SELECT round((SELECT covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb)) FROM r), {DIGITS}) AS rho,
  round((SELECT sum(CASE WHEN sign(x.d - y.d) = sign(x.c - y.c) THEN 1 ELSE -1 END) / count(*) FROM r x JOIN r y ON x.id < y.id), {DIGITS}) AS tau""",
    CLUSTERING
    + """, r AS MATERIALIZED (SELECT id, d, c, rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2.0 AS ra,
  rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0 AS rb FROM (SELECT id, d, round(c, 9) AS c FROM cc JOIN deg USING (id)))""",
)
def rank_agreement(spark, d):
    """Do degree and clustering order all nodes alike?"""
    graph = trade_graph(spark, d).settled()
    a = graph.degrees().select(F.col("id").alias("item"), F.col("out_deg").cast("double").alias("score"))
    b = clustering(graph).select(F.col("id").alias("item"), F.round("clustering", 9).alias("score"))
    return rounded(metrics.spearman(a, b).crossJoin(metrics.kendall(a, b)), "rho", "tau")


@query(
    "components",
    "SELECT nodes.id, min(level_of.other) AS component FROM nodes LEFT JOIN level_of ON level_of.id = nodes.id GROUP BY nodes.id",
    """hop1 AS MATERIALIZED (SELECT id, least(id, coalesce(min(dst), id)) AS m FROM nodes LEFT JOIN arcs ON src = id GROUP BY id), """
    + ", ".join(
        f"hop{k} AS MATERIALIZED (SELECT a.id, least(any_value(a.m), coalesce(min(b.m), any_value(a.m))) AS m FROM hop{k - 1} a "
        f"LEFT JOIN arcs ON src = a.id LEFT JOIN hop{k - 1} b ON b.id = dst GROUP BY a.id)"
        for k in range(2, 13)
    )
    + ", level_of AS (SELECT id, m AS other FROM hop12)",
)
def components(spark, d):
    from graphloom.plans.components import connected_components

    graph = trade_graph(spark, d).settled()
    found = connected_components(graph.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    joined = graph.nodes.select("id").join(found, F.col("id") == F.col("node"), "left")
    return joined.select("id", F.coalesce("component", "id").alias("component"))


_OTHERS = "type IN ('region', 'nation') OR id LIKE 'S:1%'"
_BATCH = f"""near AS MATERIALIZED (SELECT src, list(dst) AS l FROM arcs GROUP BY src), o AS MATERIALIZED (
  SELECT nodes.id, l FROM nodes JOIN near ON src = nodes.id WHERE {_OTHERS}
), means AS MATERIALIZED (
  SELECT n.id, any_value(deg.d) AS d, coalesce(avg(len(list_intersect(x.l, o.l)) / CAST(len(x.l) + len(o.l) - len(list_intersect(x.l, o.l)) AS DOUBLE)), 0) AS mean
  FROM nodes n JOIN deg ON deg.id = n.id JOIN near x ON x.src = n.id LEFT JOIN o ON o.id <> n.id WHERE n.type = 'supplier' GROUP BY n.id)"""
_BATCHED = {"lace": "1 - mean", "fuse": "0.5 * d + 0.5 * (1 - mean)", "sift": "CASE WHEN mean >= 0.25 THEN 1 - mean ELSE d + 100.0 END"}
for _name, _value in _BATCHED.items():

    @query(f"batch_{_name}", f"SELECT id, round({_value}, {DIGITS}) AS priority FROM means", _BATCH)
    def _batched(spark, d, name=_name):
        """Priorities of all suppliers at once, after the regions, the nations and a part of the suppliers were visited."""
        graph = trade_graph(spark, d).settled()
        visited = graph.nodes.where(F.expr(_OTHERS)).select("id")
        found = explore.batch_priority(graph, graph.nodes.where("type = 'supplier'").select("id"), visited, name)
        return rounded(found, "priority")


def _searches_sql(starts: str, levels: int = 6) -> str:
    """CTE reached (s, node, depth) from the ids of ``starts``, level by level; the trade graph has fewer than six."""
    out = [f"a0 AS MATERIALIZED (SELECT id AS s, id AS node FROM ({starts}))"]
    for k in range(1, levels + 1):
        seen = " ".join(f"ANTI JOIN a{i} x{i} ON x{i}.s = w.s AND x{i}.node = w.node" for i in range(max(0, k - 2), k))
        out.append(f"a{k} AS MATERIALIZED (SELECT w.s, w.node FROM (SELECT DISTINCT s, dst AS node FROM a{k - 1} JOIN arcs ON src = node) w {seen})")
    return ", ".join([*out, "reached AS (" + " UNION ALL ".join(f"SELECT s, node, {k} AS depth FROM a{k}" for k in range(levels + 1)) + ")"])


@query(
    "farthest_pairs",
    f"""SELECT s AS source, node AS target, CAST(depth AS DOUBLE) AS score FROM reached WHERE depth > 0
ORDER BY depth DESC, {drawn_sql("s", "node", seed=42)}, s, node LIMIT 500""",
    _searches_sql(f"SELECT id FROM nodes ORDER BY {drawn_sql('id', seed=42)}, id LIMIT 64"),
)
def farthest_pairs(spark, d):
    """The 500 pairs that are farthest apart, from 64 drawn starts."""
    return seeds.max_distance(trade_graph(spark, d).settled(), 500, 42)


@query(
    "drawn_distances",
    "SELECT p.source, p.target, min(depth) AS dist FROM pairs p JOIN reached r ON r.s = p.source AND r.node = p.target GROUP BY ALL",
    f"""num AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM nodes), pairs AS MATERIALIZED (
  SELECT a.id AS source, b.id AS target FROM (SELECT unnest(range(2000)) AS draw), (SELECT count(*) AS n FROM nodes)
  JOIN num a ON a.k = {drawn_sql("draw", "'a'", seed=42)} % n JOIN num b ON b.k = {drawn_sql("draw", "'b'", seed=42)} % n WHERE a.id <> b.id
), {_searches_sql("SELECT DISTINCT source AS id FROM pairs")}""",
)
def drawn_distances(spark, d):
    """Steps between the nodes of 2000 drawn pairs, as CRISP measures its candidates."""
    graph = trade_graph(spark, d).settled()
    nodes = cut(numbered(graph.nodes.select("id")), "numbered")
    return seeds.pair_distances(graph, seeds.draws(nodes, nodes, 2000, 42), 6)
