"""The prefix trie of conversations, from Spark SQL's ROLLUP over positional turn columns.

A conversation is cut into blocks of WIDTH turns, a column each. One ROLLUP over these columns, grouped by the block's
number and the node that the block starts from, aggregates the conversations of all prefixes together; grouping_id()
says how many columns a row of it keeps. A node is known by a sum over its turns of 128-bit hashes of (place, role,
text), so the node that a block starts from is a running sum, found without following the conversation turn by turn.

What a node sums over its subtree is a sum over conversations, and a second ROLLUP: with rep the smallest member,
every node of the subtree but those of rep is the first place where its own smallest member leaves smaller ones. So

* n_leaves counts members that are the smallest one of the childless node they end in;
* saved(v) = sum of Z over the members - Z(rep) - (n_convs - 1) * P, where Z is the code points of a conversation in
  nodes of which it is not the smallest member, and P those of v's prefix before its last turn.

Turns of long conversations, and conversations of common nodes, are dealt over several tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.merkle import CRC32_SQL
from graphloom.llm.tables import table
from graphloom.plans import cut, join_hot, numbered
from graphloom.plans.hot import HOT_ROWS

#: Turns of a block, a column of the ROLLUP each.
WIDTH = 8
#: The key of the root: no turns, and the four sums of 32 bits each.
ROOT = "0:0:0:0:0"
SUMS = ("a", "b", "c", "d")
#: Ids whose text goes into one piece of a node's list of ends.
PIECE = 1 << 16
NO_ENDS = hashlib.sha256(b"").hexdigest()


def placed(turns: DataFrame, hot: int = HOT_ROWS) -> DataFrame:
    """Turns (conv_id, turn, role, text) as (conv_id, k, what, size): the place, a digest and the code points of each.

    A conversation is ordered by turn, null first; turns that tie there by the digest of role and text. A null role or
    text is empty. Rows without a conv_id belong to no conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    what = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = turns.where("conv_id is not null").select("conv_id", F.struct("turn", what.alias("what")).alias("id"), F.length(text).cast("long").alias("size"))
    rows = cut(rows, "turns")
    longest = rows.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    if longest > hot:
        ranked = numbered(rows, "conv_id")
    else:
        ranked = rows.withColumn("k", F.row_number().over(W.partitionBy("conv_id").orderBy("id")).cast("long") - 1)
    return cut(ranked.select("conv_id", "k", "id.what", "size"), "placed")


def forked(turns: DataFrame, first: int = 6, every: int = 100, hot: int = HOT_ROWS) -> DataFrame:
    """``placed`` turns of conversations that start with turns of another: (conv_id, pos, what, size).

    Conversation c takes the first h turns of conversation c - c % ``every`` (all that it has, if fewer) and then its
    own turns after its first h, where h is crc32(c) % ``first``.
    """
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = convs.select("conv_id", "n", (F.crc32(F.col("conv_id").cast("string")) % first).alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    convs = cut(convs, "convs")
    heads = turns.where(F.col("k") < first - 1).where(F.col("conv_id") % every == 0).withColumnRenamed("conv_id", "base")
    heads = cut(heads, "heads")
    taken = convs.select("conv_id", "h", "base").join(heads, "base").where("k < h")
    taken = taken.select("conv_id", F.col("k").alias("pos"), "what", "size")
    have = heads.groupBy("base").agg(F.count("*").alias("m"))
    shift = convs.join(have, "base", "left").select("conv_id", "n", "h", F.least("h", F.coalesce("m", F.lit(0))).alias("m"))
    own = join_hot(turns, cut(shift, "shift"), ["conv_id"], hot=hot).where("k >= h")
    return cut(taken.union(own.select("conv_id", (F.col("k") - F.col("h") + F.col("m")).alias("pos"), "what", "size")), "forked")


def _key(depth, sums: dict):
    return F.concat_ws(":", depth.cast("string"), *(sums[x].cast("string") for x in SUMS))


def _blocks(convs: DataFrame, turns: DataFrame, hot: int) -> DataFrame:
    """A row per block of a conversation: its turns as columns t0, t1, …, the node before it, and that after it.

    Every conversation has a first block, if without turns.
    """
    hashed = F.sha2(F.concat(F.col("pos").cast("string"), F.lit(":"), F.col("what")).cast("binary"), 256)
    limbs = [F.conv(F.substring("at", 1 + 8 * i, 8), 16, 10).cast("long").alias(x) for i, x in enumerate(SUMS)]
    turns = turns.withColumn("at", hashed).select("conv_id", "pos", F.struct(*limbs, "size").alias("t"))
    cells = [F.max(F.when(F.col("pos") % WIDTH == i, F.col("t"))).alias(f"t{i}") for i in range(WIDTH)]
    added = [F.sum(f"t.{x}").alias(x) for x in (*SUMS, "size")]
    rows = turns.groupBy("conv_id", F.floor(F.col("pos") / WIDTH).cast("long").alias("id")).agg(F.count("*").alias("n"), *cells, *added)
    bare = convs.join(rows.where("id = 0"), "conv_id", "left").withColumn("id", F.lit(0).cast("long"))
    rows = cut(bare.union(rows.where("id > 0").select(bare.columns)).fillna(0, ["n", *SUMS, "size"]), "blocks")
    most = rows.agg(F.max("id")).first()[0] or 0
    sums = ["n", *SUMS, "size"]
    if most <= hot:
        before = W.partitionBy("conv_id").orderBy("id").rowsBetween(W.unboundedPreceding, -1)
        found = rows.select("*", *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}_0") for x in sums))
    else:
        found = _running(rows, sums)
    start = {x: F.col(f"{x}_0") for x in SUMS}
    end = {x: F.col(f"{x}_0") + F.col(x) for x in SUMS}
    return cut(
        found.select(
            "conv_id",
            F.col("id").alias("block"),
            *(F.col(f"{x}_0") for x in (*SUMS, "size")),
            _key(F.col("n_0"), start).alias("start"),
            _key(F.col("n_0") + F.col("n"), end).alias("end"),
            (F.col("n_0") + F.col("n")).alias("depth"),
            (F.col("size_0") + F.col("size")).alias("total"),
            *(f"t{i}" for i in range(WIDTH)),
        ),
        "starts",
    )


def _running(rows: DataFrame, sums: list[str]) -> DataFrame:
    """``rows`` with x_0, the sum of x over the rows of the conversation before it, by ranges of (conv_id, id)."""
    parts = cut(rows.repartitionByRange("conv_id", "id").withColumn("part", F.spark_partition_id()), "ranges")
    totals = parts.groupBy("conv_id", "part").agg(*(F.sum(x).alias(x) for x in sums))
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("conv_id", "part", *(F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"{x}_1") for x in sums))
    inside = W.partitionBy("conv_id", "part").orderBy("id").rowsBetween(W.unboundedPreceding, -1)
    own = parts.select("*", *(F.coalesce(F.sum(x).over(inside), F.lit(0)).alias(f"{x}_2") for x in sums))
    both = own.join(totals, ["conv_id", "part"])
    return both.select(*rows.columns, *((F.col(f"{x}_1") + F.col(f"{x}_2")).alias(f"{x}_0") for x in sums))


def _rolled(blocks: DataFrame, aggregates: str) -> DataFrame:
    """A row per node: key, parent (its key), depth, len (of the last turn), before (of the turns above it), aggregates."""
    turns = [f"t{i}" for i in range(WIDTH)]
    query = f"""
      SELECT block, start, {", ".join(turns)}, log2(grouping_id() + 1) AS rest,
        max(size_0) AS size_0, {", ".join(f"max({x}_0) AS {x}_0" for x in SUMS)}, {aggregates}
      FROM {{blocks}} GROUP BY block, start, ROLLUP({", ".join(turns)})"""
    rows = blocks.sparkSession.sql(query, blocks=blocks).withColumn("level", (WIDTH - F.round("rest")).cast("int"))
    cells = F.array(*turns)
    # a block's own first node is the one it starts from, which its predecessor has; a missing turn is no node
    rows = rows.where("(block = 0 AND level = 0) OR level > 0")
    rows = rows.withColumn("last", F.get(cells, F.col("level") - 1)).where("level = 0 OR last IS NOT NULL")
    depth = F.col("block") * WIDTH + F.col("level")
    over = lambda part, x: F.aggregate(F.slice(cells, 1, part), F.col(f"{x}_0"), lambda s, t: s + t[x])
    own = {x: over(F.col("level"), x) for x in SUMS}
    above = {x: over(F.greatest(F.col("level") - 1, F.lit(0)), x) for x in SUMS}
    return rows.select(
        _key(depth, own).alias("key"),
        F.when(depth > 0, _key(depth - 1, above)).alias("parent"),
        depth.alias("depth"),
        F.coalesce("last.size", F.lit(0)).cast("long").alias("len"),
        over(F.greatest(F.col("level") - 1, F.lit(0)), "size").alias("before"),
        *(x.rsplit(" ", 1)[1] for x in aggregates.split(", ")),
    )


def _pieces(most: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of ids of one node, joined by commas."""
        node, ids, first = None, [], None

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"key": [node], "first": [first], "ids": [",".join(map(str, ids))]})

        for batch in batches:
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (key != node or len(ids) >= most):
                    yield piece()
                    ids = []
                if not ids:
                    node, first = key, conv
                ids.append(conv)
        if ids:
            yield piece()

    return pieces


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's pieces, joined by commas; a piece is in memory at a time."""
    node, state = None, None
    for batch in batches:
        keys, shas = [], []
        for key, _, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if key != node:
                if state:
                    keys.append(node)
                    shas.append(state.hexdigest())
                node, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.string()), "ends_sha256": pa.array(shas, pa.string())})
    if state:
        yield pa.RecordBatch.from_pydict({"key": [node], "ends_sha256": [state.hexdigest()]})


def ends(blocks: DataFrame) -> DataFrame:
    """(key, ends_sha256) of each node that conversations end in.

    Ids are sorted over ranges of (node, id), where a common node lies in several, and joined to pieces of up to PIECE
    ids there; what reads a node's list in order is given its pieces alone.
    """
    last = blocks.groupBy("conv_id").agg(F.max_by("end", "block").alias("key"))
    ordered = cut(last, "ends").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").select("key", "conv_id")
    pieces = cut(ordered.mapInArrow(_pieces(PIECE), "key string, first long, ids string"), "pieces")
    gathered = pieces.repartition("key").sortWithinPartitions("key", "first")
    return gathered.mapInArrow(_digests, "key string, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame, hot: int = HOT_ROWS) -> DataFrame:
    """The prefix trie of conversations: (conv_id) of each, and their turns (conv_id, pos from 0, what, size).

    A node is a distinct sequence of the first turns of a conversation, from the root without turns, of which every
    conversation is a member. Per node: conv_id, its smallest member; depth; parent_conv_id, that of its parent (null
    at the root); n_convs; n_children; n_leaves, the childless nodes of its subtree, itself included; saved_tokens, the
    sum over its subtree of (n_convs - 1) times the size of the last turn; ends_sha256, of the ids that end there,
    ascending and comma-joined. No conversations give no node. Sequences are told apart by 128 bits of their turns'
    hashes.
    """
    blocks = _blocks(convs, turns, hot)
    nodes = cut(_rolled(blocks, "count(*) AS n_convs, min(conv_id) AS conv_id"), "nodes")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "key", "left").fillna(0, ["n_children"])
    nodes = cut(nodes, "children")
    # what each conversation is the smallest member of
    own = nodes.groupBy("conv_id").agg(F.sum("len").alias("own"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    whole = blocks.groupBy("conv_id").agg(F.max("total").alias("total"), F.count("*").alias("n"))
    z = F.col("total") - F.coalesce("own", F.lit(0))
    facts = whole.join(own, "conv_id", "left").select("conv_id", "n", z.alias("z"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    facts = cut(facts, "facts")
    weighed = join_hot(blocks, facts, ["conv_id"], hot=hot)
    sums = _rolled(weighed, "sum(z) AS z_all, sum(leaf) AS n_leaves").select("key", "z_all", "n_leaves")
    named = nodes.join(sums, "key").join(ends(blocks), "key", "left")
    many = facts.join(nodes.groupBy("conv_id").agg(F.count("*").alias("m")), "conv_id").select("conv_id", "m", F.col("z").alias("z_rep"))
    named = join_hot(cut(named, "sums"), cut(many, "reps"), ["conv_id"], "m", hot=hot)
    parents = nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    linked = join_hot(cut(named.where("parent IS NOT NULL"), "named"), cut(parents, "parents"), ["parent"], "n_children", hot=hot)
    root = named.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long"))
    saved = F.col("z_all") - F.col("z_rep") - (F.col("n_convs") - 1) * F.col("before")
    return linked.unionByName(root).select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        saved.alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = placed(table(spark, sf_dir, "conversations"))
    return trie(turns.select("conv_id").distinct(), forked(turns))


ORACLE_SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS k
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT DISTINCT conv_id, {CRC32_SQL.replace('doc_id', 'conv_id')} % 6 AS h, conv_id - conv_id % 100 AS base FROM turns
), rebuilt AS (
  SELECT c.conv_id, 0 AS own, k, role, text FROM convs c JOIN turns t ON t.conv_id = base AND k < h
  UNION ALL SELECT c.conv_id, 1, k, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND k >= h
), paths AS MATERIALIZED (
  SELECT conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY own, k) FILTER (role IS NOT NULL), []) AS path
  FROM convs LEFT JOIN rebuilt USING (conv_id) GROUP BY conv_id
), prefixes AS (
  SELECT conv_id, len(path) AS whole, path[1 : d] AS node, d FROM paths, unnest(range(len(path) + 1)) AS u(d)
), nodes AS MATERIALIZED (
  SELECT node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (whole = d), '')) AS ends_sha256,
    coalesce((count(*) - 1) * length(node[d].text), 0) AS saved
  FROM prefixes GROUP BY node, d
), children AS (
  SELECT node[1 : depth - 1] AS node, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), facts AS MATERIALIZED (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.node = n.node AND c.depth = n.depth
), sums AS (
  SELECT f.node[1 : d] AS node, d AS depth, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM facts f, unnest(range(f.depth + 1)) AS u(d) GROUP BY ALL
)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM facts f JOIN sums s ON s.node = f.node AND s.depth = f.depth
LEFT JOIN facts p ON p.node = f.node[1 : f.depth - 1] AND p.depth = f.depth - 1
"""
