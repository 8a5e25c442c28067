"""Merkle manifest of a dataset: leaves of rows, a tree per source, a tree of the sources, proofs and folding.

A tree has runs of RUN consecutive nodes as the children of a node, and as many levels as it takes. Rows are numbered
in their source and meet in blocks of consecutive ones, which give LEVELS levels at once (4096 rows); the blocks' digests
are numbered rows again, so a source of any size takes a few rounds and no group is larger than a block. The way from a
block up to the root is one row that all its members share.

SHA-256 reads its input in order, so a parent keeps a copy of its hash state before each child (a midstate). To see
what a changed child makes of it, folding resumes that state with the replacement and the children on its right only.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.exact import normalised
from graphloom.llm.tables import table
from graphloom.plans import cut, join_hot, numbered

RUN = 16
LEVELS = 3
#: Bytes of a digest as hex text.
WIDTH = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


class Run:
    """Consecutive digests, the hash states before each of them, and the digest of all."""

    def __init__(self, data: bytes) -> None:
        self.data, self.states, whole = data, [], hashlib.sha256()
        for at in range(0, len(data), WIDTH):
            self.states.append(whole.copy())
            whole.update(data[at : at + WIDTH])
        self.digest = whole.hexdigest().encode()


def step(run: Run, slot: int) -> tuple:
    """What folding and proofs need of a run: the state before a slot, and the siblings on either side."""
    return run.states[slot], run.data[: slot * WIDTH], run.data[(slot + 1) * WIDTH :]


def fold(digest: bytes, steps: list[tuple]) -> bytes:
    """The top digest with ``digest`` in place of the child that the steps lead up from."""
    for state, _, right in steps:
        resumed = state.copy()
        resumed.update(digest)
        resumed.update(right)
        digest = resumed.hexdigest().encode()
    return digest


def siblings(steps: list[tuple]) -> bytes:
    """Digests that prove a leaf: the others of its run from left to right, level by level."""
    return b"".join(left + right for _, left, right in steps)


def _levels(digests: list[bytes], size: int, most: int) -> list[list[Run]]:
    """The runs of each of ``most`` levels over a block; ``size`` is the number of nodes of its whole tree."""
    out = []
    while len(out) < most and (len(digests) > 1 or size > RUN**most):
        out.append([Run(b"".join(digests[i : i + RUN])) for i in range(0, len(digests), RUN)])
        digests = [r.digest for r in out[-1]]
    return out


def _steps(levels: list[list[Run]], at: int) -> list[tuple[Run, int]]:
    return [(level[at // RUN ** (i + 1)], at // RUN**i % RUN) for i, level in enumerate(levels)]


def _hex(column: pa.ChunkedArray) -> list[bytes]:
    return [x.hex().encode() for x in column.to_pylist()]


def _roof(most: int):
    def roof(rows: pa.Table) -> pa.Table:
        """The one node that a block of nodes comes to."""
        rows = rows.sort_by("k")
        size, digests = rows["size"][0].as_py(), _hex(rows["digest"])
        levels = _levels(digests, size, most)
        top = levels[-1][0].digest if levels else digests[0]
        values = [rows["tree"][0].as_py(), rows["block"][0].as_py(), -(-size // RUN**most), bytes.fromhex(top.decode())]
        return pa.Table.from_pydict({n: [v] for n, v in zip(("tree", "k", "size", "digest"), values, strict=True)})

    return roof


NODE = "tree long, k long, size long, digest binary"
WAY = "array<struct<slot: int, run: binary>>"
_WAY = pa.list_(pa.struct([("slot", pa.int32()), ("run", pa.binary())]))


def _blocked(nodes: DataFrame, most: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("k") / RUN**most).cast("long"))


def _tiers(nodes: DataFrame, most: int) -> list[DataFrame]:
    """``nodes`` and, tier by tier, the nodes that their blocks come to, until each tree has one."""
    out = [nodes]
    while (out[-1].agg(F.max("size")).first()[0] or 0) > 1:
        rows = _blocked(out[-1].select("tree", "k", "size", "digest"), most)
        out.append(cut(rows.groupBy("tree", "block").applyInArrow(_roof(most), NODE), "nodes"))
    return out


def _extended(most: int):
    def extended(rows: pa.Table, ways: pa.Table) -> pa.Table:
        """Each node of a block with its way to the root: first through the block, then the block's own."""
        rows = rows.sort_by("k")
        levels, rest = _levels(_hex(rows["digest"]), rows["size"][0].as_py(), most), ways["way"][0].as_py()
        found = [[{"slot": slot, "run": run.data} for run, slot in _steps(levels, i)] + rest for i in range(len(rows))]
        shared = [pa.array([ways[c][0].as_py()] * len(rows), pa.binary()) for c in ("subroot", "root")]
        return pa.Table.from_arrays([rows["tree"], rows["k"], *shared, pa.array(found, _WAY)], ["tree", "k", "subroot", "root", "way"])

    return extended


def _below(tier: DataFrame, ways: DataFrame, most: int) -> DataFrame:
    """The ways of the nodes of a tier, from those of the tier above it."""
    above = ways.withColumnRenamed("k", "block").groupBy("tree", "block")
    found = _blocked(tier, most).groupBy("tree", "block").cogroup(above)
    return cut(found.applyInArrow(_extended(most), f"tree long, k long, subroot binary, root binary, way {WAY}"), "ways")


@dataclass
class Manifest:
    """Leaves (tree, k, size, doc_id, digest, changed), the sources' trees and numbers, and the ways of leaf blocks."""

    leaves: DataFrame
    sources: DataFrame
    ways: DataFrame
    levels: int


def _field(column: Column) -> Column:
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(text: Column) -> Column:
    """SHA-256 over the row's fields with ``text`` as its text: `-` for a null, else byte count, colon and value."""
    parts = [_field(text if name == "text" else F.col(name)) for name in FIELDS]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def build(docs: DataFrame, changed: Column | None = None, most: int = LEVELS) -> Manifest:
    """The manifest of documents (doc_id, source, lang, n_chars, text, any more columns, which are not read).

    ``changed`` is another text of the same row, null for an unchanged row; its leaf is kept beside the true one. In a
    source, rows ascend by doc_id, null first; rows that tie there by their leaves, and equal leaves are
    interchangeable. A null source is a source of its own, the first. An empty table has no leaves and no root.
    ``most`` levels are built in a group; it changes the work and not the result.
    """
    other = F.when(changed.isNotNull(), leaf(changed)) if changed is not None else F.lit(None).cast("binary")
    keys = [F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("none")]
    rows = docs.select(*keys, F.struct("doc_id", leaf(F.col("text")).alias("digest")).alias("id"), other.alias("changed"))
    rows = cut(rows, "leaves")
    counted = rows.groupBy("name", "none").agg(F.count("*").alias("n"))
    # a null source is the first
    ordered = numbered(counted.select(F.struct(~F.col("none"), "name").alias("id"), "name", "none", "n"))
    sources = cut(ordered.select("name", "none", "n", F.col("n").alias("size"), F.col("k").alias("tree")), "sources")
    placed = numbered(join_hot(rows, sources, ["name", "none"]).select("tree", "size", "id", "changed"), "tree")
    placed = placed.select("tree", "k", "size", "id.doc_id", "id.digest", "changed")
    leaves = cut(placed, "placed")
    tiers = _tiers(leaves, most)
    number = sources.count()
    subroots = tiers[-1].select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("k"), F.lit(number).cast("long").alias("size"), "digest"
    )
    above = _tiers(cut(subroots, "subroots"), most)
    none = F.lit(None).cast("binary")
    ways = above[-1].select("tree", "k", none.alias("subroot"), F.col("digest").alias("root"), F.array().cast(WAY).alias("way"))
    for tier in above[-2::-1]:
        ways = _below(tier, ways, most)
    tops = tiers[-1].select("tree", F.col("digest").alias("subroot"))
    ways = ways.select(F.col("k").alias("tree"), F.lit(0).cast("long").alias("k"), "root", "way").join(tops, "tree")
    ways = cut(ways.select("tree", "k", "subroot", "root", "way"), "ways")
    for tier in tiers[-2:0:-1]:
        ways = _below(tier, ways, most)
    return Manifest(leaves, sources, ways, most)


PROOF = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, proof binary"
)


def _proved(most: int, with_siblings: bool):
    def prove(rows: pa.Table, ways: pa.Table) -> pa.Table:
        rows = rows.sort_by("k")
        leaves = _hex(rows["digest"])
        levels = _levels(leaves, rows["size"][0].as_py(), most)
        rest = [step(Run(x["run"]), x["slot"]) for x in ways["way"][0].as_py()]
        proofs, folded, kept = [], [], []
        for i, (own, other) in enumerate(zip(leaves, rows["changed"].to_pylist(), strict=True)):
            steps = [step(run, slot) for run, slot in _steps(levels, i)] + rest
            proof = siblings(steps)
            proofs.append(hashlib.sha256(proof).hexdigest())
            folded.append(fold(own if other is None else other.hex().encode(), steps).decode())
            kept.append(proof if with_siblings else None)
        n, subroot, root = len(leaves), ways["subroot"][0].as_py().hex(), ways["root"][0].as_py().hex()
        columns = [rows["doc_id"], [x.decode() for x in leaves], [subroot] * n, [root] * n, proofs, folded, [x == root for x in folded], pa.array(kept, pa.binary())]
        return pa.Table.from_arrays([c if isinstance(c, pa.ChunkedArray | pa.Array) else pa.array(c) for c in columns], [x.split()[0] for x in PROOF.split(", ")])

    return prove


def prove(manifest: Manifest, with_siblings: bool = False) -> DataFrame:
    """A row per leaf: its digest, subroot and root, the SHA-256 of its proof, and the root folded from its change.

    A leaf without a change is folded as it is. ``with_siblings`` also returns the proof itself, RUN - 1 digests of 64
    bytes a level.
    """
    rows = _blocked(manifest.leaves, manifest.levels)
    ways = manifest.ways.withColumnRenamed("k", "block")
    found = rows.groupBy("tree", "block").cogroup(ways.groupBy("tree", "block")).applyInArrow(_proved(manifest.levels, with_siblings), PROOF)
    return found if with_siblings else found.drop("proof")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    struck = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    changed = F.when(struck & F.col("text").isNotNull(), normalised())
    return prove(build(docs, changed))


#: Levels that the SQL unrolls: of a source's tree and of the sources' tree.
SQL_LEVELS = (6, 4)
#: CRC-32 of a decimal text: reflected, polynomial 0xEDB88320.
CRC32_SQL = """xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda c: CAST(ord(c) AS UBIGINT))), lambda acc, x: list_reduce([xor(acc, x), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, b: xor(a >> 1, CAST(3988292384 AS UBIGINT) * (a & 1)))), 4294967295)"""


def _sql_field(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


def _oracle() -> str:
    fields = lambda text: "sha256(" + " || ".join(_sql_field(text if n == "text" else n) for n in FIELDS) + ")"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"""d AS (
  SELECT doc_id, source, {fields("text")} AS leaf,
    CASE WHEN {CRC32_SQL} % 5 = 0 THEN {fields(lowered)} END AS other
  FROM documents
), t0 AS MATERIALIZED (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k,
    count(*) OVER (PARTITION BY source) AS n, leaf AS h
  FROM d
), f0 AS (
  SELECT doc_id, leaf, tree, k, n, coalesce(other, leaf) AS folded, '' AS proof FROM t0
)"""
    ]

    def levels(tree: str, rows: str, many: int, extra: str) -> None:
        for i in range(many):
            parts.append(f"""{tree}{i}r AS MATERIALIZED (
  SELECT tree, k // {RUN} AS k, max(n) AS n, list(h ORDER BY k) AS hs FROM {tree}{i} GROUP BY ALL
), {tree}{i + 1} AS MATERIALIZED (
  SELECT tree, k, (n + {RUN - 1}) // {RUN} AS n, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {tree}{i}r
), {rows}{i + 1} AS MATERIALIZED (
  SELECT doc_id, leaf, {extra}f.tree, f.k // {RUN} AS k, (f.n + {RUN - 1}) // {RUN} AS n,
    CASE WHEN f.n = 1 THEN folded ELSE sha256(array_to_string(hs[1 : f.k % {RUN}], '') || folded || array_to_string(hs[f.k % {RUN} + 2 :], '')) END AS folded,
    CASE WHEN f.n = 1 THEN proof ELSE proof || array_to_string(hs[1 : f.k % {RUN}], '') || array_to_string(hs[f.k % {RUN} + 2 :], '') END AS proof
  FROM {rows}{i} f JOIN {tree}{i}r r ON r.tree = f.tree AND r.k = f.k // {RUN}
)""")

    down, up = SQL_LEVELS
    levels("t", "f", down, "")
    parts.append(f"""s0 AS MATERIALIZED (
  SELECT 0 AS tree, tree AS k, count(*) OVER () AS n, h FROM t{down}
), g0 AS (
  SELECT doc_id, leaf, s.h AS subroot, s.tree, s.k, s.n, folded, proof FROM f{down} f JOIN s0 s ON s.k = f.tree
)""")
    levels("s", "g", up, "subroot, ")
    return f"""WITH {", ".join(parts)}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = h AS verified
FROM g{up}, s{up}"""


ORACLE_SQL = _oracle()
