"""Graphs and paths derived from the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.graph import PropertyGraph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(prefix: str, column: str):
    return F.concat(F.lit(prefix + ":"), F.col(column).cast("string"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = (
        ("R", "region", "r_regionkey"),
        ("N", "nation", "n_nationkey"),
        ("C", "customer", "c_custkey"),
        ("S", "supplier", "s_suppkey"),
    )
    out = None
    for prefix, name, column in kinds:
        part = table(spark, sf_dir, name).select(
            _key(prefix, column).alias("id"), F.lit(name).alias("type"), F.lit(1.0).alias("weight")
        )
        out = part if out is None else out.union(part)
    return out


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downward links: customer to supplier, customer and supplier to nation, nation to region."""
    read = lambda name: table(spark, sf_dir, name)
    lines = read("lineitem").select("l_orderkey", "l_suppkey")
    sold = lines.join(read("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    trades = sold.groupBy("o_custkey", "l_suppkey").agg(F.count("*").cast("double").alias("weight"))

    def fixed(name: str, a: str, b: str, kind: str) -> DataFrame:
        (pa, ca), (pb, cb) = a.split("."), b.split(".")
        return read(name).select(_key(pa, ca).alias("src"), _key(pb, cb).alias("dst"), F.lit(kind).alias("type"), F.lit(1.0).alias("weight"))

    return (
        fixed("nation", "N.n_nationkey", "R.n_regionkey", "part_of")
        .union(fixed("customer", "C.c_custkey", "N.c_nationkey", "located_in"))
        .union(fixed("supplier", "S.s_suppkey", "N.s_nationkey", "located_in"))
        .union(
            trades.select(
                _key("C", "o_custkey").alias("src"), _key("S", "l_suppkey").alias("dst"), F.lit("trades").alias("type"), "weight"
            )
        )
    )


def trade_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Undirected: regions, nations, customers and suppliers. Keys of the tables are unique, so no row repeats."""
    links = _links(spark, sf_dir)
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    edges = links.select(low.alias("src"), high.alias("dst"), "type", "weight")
    return PropertyGraph(_nodes(spark, sf_dir), edges, directed=False)


def directed_trade_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Directed: customer to supplier to nation to region; customers point to their nation as well."""
    return PropertyGraph(_nodes(spark, sf_dir), _links(spark, sf_dir), directed=True)


def trade_paths(spark: SparkSession, sf_dir: str, graph: PropertyGraph | None = None) -> DataFrame:
    """(path_id, nodes): customer, supplier, the supplier's nation and region, for every trade.

    They are read off the edges of the trade ``graph`` where the caller has it, written or not.
    """
    edges = (graph or trade_graph(spark, sf_dir)).edges
    kind = lambda name, a, b: edges.where(F.col("type") == name).select(F.col("src").alias(a), F.col("dst").alias(b))
    # edges run from the smaller id: C to S, N to S, N to R
    homes = kind("located_in", "n", "s").where("s like 'S:%'").join(kind("part_of", "n", "r"), "n")
    nodes = F.array("c", "s", "n", "r")
    return kind("trades", "c", "s").join(homes, "s").select(F.array_join(nodes, ">").alias("path_id"), nodes.alias("nodes"))


#: The same graph in SQL: CTEs nodes, edges, arcs and deg.
GRAPH_SQL = """nodes AS (
  SELECT 'R:' || r_regionkey AS id, 'region' AS type FROM region
  UNION ALL SELECT 'N:' || n_nationkey, 'nation' FROM nation
  UNION ALL SELECT 'C:' || c_custkey, 'customer' FROM customer
  UNION ALL SELECT 'S:' || s_suppkey, 'supplier' FROM supplier
), links AS (
  SELECT 'N:' || n_nationkey AS a, 'R:' || n_regionkey AS b, 'part_of' AS type, CAST(1 AS DOUBLE) AS weight FROM nation
  UNION ALL SELECT 'C:' || c_custkey, 'N:' || c_nationkey, 'located_in', 1 FROM customer
  UNION ALL SELECT 'S:' || s_suppkey, 'N:' || s_nationkey, 'located_in', 1 FROM supplier
  UNION ALL SELECT 'C:' || o_custkey, 'S:' || l_suppkey, 'trades', count(*)
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2
), edges AS MATERIALIZED (
  SELECT least(a, b) AS src, greatest(a, b) AS dst, type, weight FROM links
), arcs AS MATERIALIZED (
  SELECT src, dst, type, weight FROM edges UNION ALL SELECT dst, src, type, weight FROM edges
), deg AS MATERIALIZED (
  SELECT id, count(dst) AS d FROM nodes LEFT JOIN arcs ON src = id GROUP BY id
)"""

PATHS_SQL = """paths AS (
  SELECT concat_ws('>', t.a, t.b, n.b, r.b) AS path_id, [t.a, t.b, n.b, r.b] AS nodes
  FROM links t JOIN links n ON n.a = t.b AND n.type = 'located_in' JOIN links r ON r.a = n.b AND r.type = 'part_of'
  WHERE t.type = 'trades'
)"""
