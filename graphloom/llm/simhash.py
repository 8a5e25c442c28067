"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then the Hamming distance.

A fingerprint is cut into six blocks. Two that differ in at most four bits differ in at most four blocks, so they agree
on two whole blocks: each fingerprint is filed under its 15 pairs of blocks (20 to 22 bits a key), the keys are joined
and the distance verified inside the join. From 16 million distinct fingerprints on, seven blocks by three or eight by
four (27 and 32 bits a key) keep the buckets small; every plan finds the same links.

Equal fingerprints are one node, so copies cost nothing; where the documents of one fingerprint, or the fingerprints of
one component, meet in a join, they are dealt over several tasks. A bucket above ``BUCKET`` distinct fingerprints (a large family
of near copies) is not joined pair by pair: two fingerprints within four bits share a point within two bits of both,
so each member of such a bucket is filed under its 2081 points, and per point only the link to the least member is
made. That is linear in the members, exact, and splits over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.tables import table
from graphloom.llm.words import signed
from graphloom.plans import connected_components, cut, join_hot

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Distinct fingerprints in a bucket that are still joined pair by pair.
BUCKET = 1024
#: (blocks, blocks that must agree, distinct fingerprints up to which it is used)
PLANS = ((6, 2, 1 << 24), (7, 3, 1 << 30), (8, 4, 1 << 62))
#: Fingerprint hashes counted at a time, so that a very long text needs no more memory.
CHUNK = 8192


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles; 0 where it has no word."""
    words = [] if text is None else text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), seed)
    n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + shingle - 1]
        grams = map(b" ".join, zip(*(part[j:] for j in range(shingle)), strict=False))
        h = np.fromiter((digest(g, seed) for g in grams), np.uint64, len(part) - shingle + 1)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed(fps))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) per row; fp is the fingerprint's bits as a signed long. A null text counts as empty."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def _block_keys(fp: Column, blocks: int, agree: int) -> Column:
    """An array of (index of the choice, its bits) for each choice of ``agree`` blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), agree)):
        key = F.lit(0).cast("long")
        for b in chosen:
            width = edges[b + 1] - edges[b]
            bits = F.shiftrightunsigned(fp, edges[b]).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            key = F.shiftleft(key, width).bitwiseOR(bits)
        keys.append(F.struct(F.lit(n).alias("choice"), key.alias("bits")))
    return F.array(*keys)


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one = [1 << i for i in range(64)]
    masks = np.array([0, *one, *(a | b for a, b in combinations(one, 2))], np.uint64)
    for batch in batches:
        fps = np.asarray(batch.column(0)).view(np.uint64)
        for at in range(0, len(fps), 256):
            part = fps[at : at + 256]
            points = (part[:, None] ^ masks[None, :]).ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(points)), pa.array(signed(np.repeat(part, len(masks))))], ["point", "fp"]
            )


def links(nodes: DataFrame, bucket: int = BUCKET, plans: tuple = PLANS) -> DataFrame:
    """(a, b) links among distinct fingerprints ``fp``: enough for the same components as all pairs within 4 bits."""
    count = nodes.count()
    blocks, agree, _ = next(p for p in plans if count <= p[2])
    filed = nodes.select("fp", F.explode(_block_keys(F.col("fp"), blocks, agree)).alias("k")).select("fp", "k.*")
    sizes = filed.groupBy("choice", "bits").agg(F.count("*").alias("n"), F.count("*").alias("size")).where("n > 1")
    sized = cut(join_hot(filed, cut(sizes, "sizes"), ["choice", "bits"]).withColumnRenamed("size", "n"), "buckets")
    cold = sized.where(F.col("n") <= bucket).select("choice", "bits", "fp")
    a, b = cold.withColumnRenamed("fp", "a"), cold.withColumnRenamed("fp", "b")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
    pairs = a.join(b, ["choice", "bits"]).where(close).select("a", "b")
    hot = sized.where(F.col("n") > bucket).select("fp").distinct()
    points = hot.mapInArrow(_points, "point long, fp long")
    least = points.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("z"), F.count("*").alias("n")).where("a < z")
    spokes = join_hot(points, cut(least.drop("z"), "points"), ["point"]).where("a < fp").select("a", F.col("fp").alias("b"))
    return pairs.union(spokes).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text, any more columns) to (doc_id, fp, component_id), one row per input row.

    component_id is the smallest doc_id reachable over links of fingerprints that differ in at most four bits. Null and
    empty texts have fingerprint 0 and are linked like any other; a null doc_id keeps its row and lends no id; repeated
    rows stay; an empty table gives no rows. Only doc_id and text are read, so other columns cannot clash.
    """
    prints = cut(fingerprints(docs), "fingerprints")
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes")
    component = connected_components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    labelled = cut(nodes.join(component, "fp", "left"), "labelled")
    # a fingerprint without links is a component of its own and needs no join
    linked = labelled.where("component is not null").select("fp", "n", "first", "component")
    roots = linked.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("members"))
    roots = cut(roots.withColumnRenamed("members", "m"), "roots")
    joined = join_hot(linked.drop("first"), roots, ["component"], count="m").select("fp", "n", "component_id")
    alone = labelled.where("component is null").select("fp", "n", F.col("first").alias("component_id"))
    ids = cut(joined.union(alone), "components")
    return join_hot(prints, ids, ["fp"]).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate group, with all its columns: the one with the smallest doc_id.

    A null doc_id comes after all others and is kept where a group has no other. Of rows with one doc_id the one with
    the least hash of its text stays; of rows equal in both, any one. An empty table gives no rows.
    """
    row = "row"
    while row in map(str.lower, docs.columns):
        row += "_"
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"))
    groups = found.select(F.col("doc_id").alias("at"), "component_id")
    order = numbered.select(
        F.col(row).alias("at"), F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash")
    )
    first = groups.join(order, "at").groupBy("component_id").agg(F.min(F.struct("none", "doc_id", "hash", "at")).alias("m"))
    return numbered.join(first.select(F.col("m.at").alias(row)), row, "left_semi").select(*docs.columns)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")
