"""Property graphs as two DataFrames.

``nodes``: id STRING, type STRING, weight DOUBLE and any more columns. ``edges``: src STRING, dst STRING, type STRING,
weight DOUBLE and any more columns. A graph is simple: the first row of a node id and the last row of an edge count,
by an explicit ``seq`` column where the caller has one. Undirected edges are kept once, smaller id first.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.plans.lineage import cut
from graphloom.plans.numbering import numbered

NODE_COLUMNS = {"type": "string", "weight": "double"}


def _filled(df: DataFrame) -> DataFrame:
    for name, kind in NODE_COLUMNS.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def _one_of(df: DataFrame, keys: list[str], last: bool) -> DataFrame:
    """One row per key: the first or last by ``seq``, else the least by its own columns."""
    if "seq" in df.columns:
        order: list[Column] = [F.col("seq").desc() if last else F.col("seq").asc()]
    else:
        order = [F.col(c) for c in df.columns if c not in keys and not df.schema[c].dataType.typeName().startswith("map")]
    ranked = df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*(order or [F.lit(1)]))))
    return ranked.where("__r = 1").drop("__r")


@dataclass(frozen=True)
class PropertyGraph:
    nodes: DataFrame
    edges: DataFrame
    directed: bool = False

    @classmethod
    def build(cls, nodes: DataFrame, edges: DataFrame, directed: bool = False) -> PropertyGraph:
        """A simple graph from raw rows: duplicates resolved, undirected edges in canonical order."""
        nodes, edges = _one_of(_filled(nodes), ["id"], last=False), _filled(edges)
        if not directed:
            low, high = F.least("src", "dst"), F.greatest("src", "dst")
            edges = edges.select(low.alias("src"), high.alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])
        return cls(nodes, _one_of(edges, ["src", "dst"], last=True), directed)

    @classmethod
    def from_parquet(cls, spark, folder: str, directed: bool = False) -> PropertyGraph:
        return cls(spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges"), directed)

    def write_parquet(self, folder: str) -> None:
        self.nodes.write.parquet(f"{folder}/nodes")
        self.edges.write.parquet(f"{folder}/edges")

    def settled(self) -> PropertyGraph:
        """The same graph, written once: for operators that read it many times."""
        return PropertyGraph(cut(self.nodes, "nodes"), cut(self.edges, "edges"), self.directed)

    # --- views -------------------------------------------------------------------------------------------------

    @cached_property
    def arcs(self) -> DataFrame:
        """(src, dst, type, weight) as seen from src: out-edges, or every edge from both ends."""
        out = self.edges.select("src", "dst", "type", "weight")
        if self.directed:
            return out
        back = out.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "weight")
        return out.union(back)

    @cached_property
    def reversed_arcs(self) -> DataFrame:
        if not self.directed:
            return self.arcs
        return self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "weight")

    @cached_property
    def both(self) -> DataFrame:
        """Different (src, dst) neighbours in either direction."""
        if not self.directed:
            return self.arcs.select("src", "dst")
        return self.arcs.select("src", "dst").union(self.reversed_arcs.select("src", "dst")).distinct()

    def neighbours(self, direction: str = "out") -> DataFrame:
        views = {"out": lambda: self.arcs, "in": lambda: self.reversed_arcs, "both": lambda: self.both}
        return views[direction]().select("src", "dst")

    def degrees(self) -> DataFrame:
        """(id, out_deg, in_deg, deg_both, n_both); deg_both counts a reciprocal pair twice, n_both once."""
        out = self.arcs.groupBy("src").agg(F.count("*").alias("out_deg"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
        ids = self.nodes.select("id")
        if not self.directed:
            d = ids.join(out, F.col("id") == F.col("src"), "left").select("id", zero("out_deg"))
            return d.select("id", "out_deg", *(F.col("out_deg").alias(c) for c in ("in_deg", "deg_both", "n_both")))
        into = self.reversed_arcs.groupBy("src").agg(F.count("*").alias("in_deg"))
        each = self.both.groupBy("src").agg(F.count("*").alias("n_both"))
        for part in (out, into, each):
            ids = ids.join(part.withColumnRenamed("src", "id"), "id", "left")
        ids = ids.select("id", zero("out_deg"), zero("in_deg"), zero("n_both"))
        return ids.select("id", "out_deg", "in_deg", (F.col("out_deg") + F.col("in_deg")).alias("deg_both"), "n_both")

    def lookup_nodes(self, ids: DataFrame) -> DataFrame:
        """``ids`` (id) with ``found`` and the type and weight of their node, null where there is none."""
        own = self.nodes.select("id", "type", "weight", F.lit(True).alias("found"))
        return ids.select("id").join(own, "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))

    def counts(self) -> DataFrame:
        """One row: n nodes, m edges."""
        return self.nodes.agg(F.count("*").alias("n")).crossJoin(self.edges.agg(F.count("*").alias("m")))

    def density(self) -> DataFrame:
        pairs = F.col("n") * (F.col("n") - 1)
        found = F.col("m") * (1 if self.directed else 2)
        return self.counts().select("n", "m", F.when(pairs > 0, found / pairs).otherwise(0.0).alias("density"))

    def csr(self, direction: str | None = None) -> DataFrame:
        """(idx, id, nbr_idx, w): dense ids in id order, neighbours ascending; a missing weight is 1."""
        direction = direction or ("out" if self.directed else "both")
        view = self.arcs if direction == "out" or not self.directed else None
        if view is None:
            pairs = self.neighbours(direction)
            view = pairs.withColumn("weight", F.lit(1.0))
        index = numbered(self.nodes.select("id")).withColumnRenamed("k", "idx")
        target = index.select(F.col("id").alias("dst"), F.col("idx").alias("to"))
        rows = view.join(target, "dst").groupBy("src").agg(
            F.array_sort(F.collect_list(F.struct("to", F.coalesce("weight", F.lit(1.0)).alias("w")))).alias("r")
        )
        joined = index.join(rows, F.col("id") == F.col("src"), "left")
        empty = lambda c, kind: F.coalesce(F.col(c), F.array().cast(f"array<{kind}>"))
        return joined.select("idx", "id", empty("r.to", "bigint").alias("nbr_idx"), empty("r.w", "double").alias("w"))

    # --- mutation and checks -----------------------------------------------------------------------------------

    def add_nodes(self, more: DataFrame) -> PropertyGraph:
        """First row of an id wins: ids that exist keep their data."""
        new = _one_of(_filled(more), ["id"], last=False).join(self.nodes.select("id"), "id", "left_anti")
        return PropertyGraph(self.nodes.unionByName(new, allowMissingColumns=True), self.edges, self.directed)

    def add_edges(self, more: DataFrame) -> PropertyGraph:
        """Existing edges are replaced; an edge with an unknown endpoint is an error."""
        new = PropertyGraph.build(self.nodes.limit(0), more, self.directed).edges
        ids = self.nodes.select("id")
        ends = new.select(F.col("src").alias("id")).union(new.select(F.col("dst").alias("id")))
        missing = ends.join(ids, "id", "left_anti").limit(1).collect()
        if missing:
            raise ValueError(f"edge to an unknown node: {missing[0].id}")
        kept = self.edges.join(new.select("src", "dst"), ["src", "dst"], "left_anti")
        return PropertyGraph(self.nodes, kept.unionByName(new, allowMissingColumns=True), self.directed)

    def remove_nodes(self, ids: DataFrame) -> PropertyGraph:
        """Without the nodes ``id`` and every edge at them."""
        gone = ids.select("id").distinct()
        edges = self.edges
        for end in ("src", "dst"):
            edges = edges.join(gone, edges[end] == gone["id"], "left_anti")
        return PropertyGraph(self.nodes.join(gone, "id", "left_anti"), edges, self.directed)

    def remove_edges(self, pairs: DataFrame) -> PropertyGraph:
        if not self.directed:
            pairs = pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        return PropertyGraph(self.nodes, self.edges.join(pairs, ["src", "dst"], "left_anti"), self.directed)

    def lookup_edges(self, pairs: DataFrame) -> DataFrame:
        """(u, v) pairs with the type and weight of their edge, null where there is none."""
        low, high = (F.least("u", "v"), F.greatest("u", "v")) if not self.directed else (F.col("u"), F.col("v"))
        keyed = pairs.withColumns({"src": low, "dst": high})
        return keyed.join(self.edges.select("src", "dst", "type", "weight"), ["src", "dst"], "left").drop("src", "dst")

    def violations(self) -> DataFrame:
        """(rule, n): rows that break the schema's rules; all zero for a valid graph."""
        ids = self.nodes.select("id")
        ends = self.edges.select(F.col("src").alias("id")).union(self.edges.select(F.col("dst").alias("id")))
        bad_id = F.col("id").isNull() | (F.length("id") == 0)
        checks = {
            "empty node id": self.nodes.where(bad_id),
            "negative node weight": self.nodes.where("weight < 0"),
            "negative edge weight": self.edges.where("weight < 0"),
            "unknown endpoint": ends.join(ids, "id", "left_anti"),
            "repeated node": self.nodes.groupBy("id").count().where("count > 1"),
            "repeated edge": self.edges.groupBy("src", "dst").count().where("count > 1"),
        }
        out = None
        for rule, rows in checks.items():
            one = rows.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
            out = one if out is None else out.union(one)
        return out
