"""Exact deduplication by two-pass Bloom filtering.

The first pass puts a hash of every text into a Bloom filter whose cells also remember a second hit. The second pass
looks each hash up: where a cell of it was hit only once, no other row has this text, and the row passes straight
through. Only the other rows, the repeated ones and a few false alarms, shuffle and are compared by the SHA-256 of
their normalised text. A filter has no false negatives, so the result is exact whatever its size.

Tasks send the cells that they hit, merged per chunk of the filter; no task holds more than a few chunks, and what is
broadcast never has more than ``FILTER_BYTES``. Beyond that, ranges of the hashes are filtered one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.tables import table
from graphloom.plans import cut, join_hot

#: Cells of the filter per row and cells per hash: about one row in forty is a false alarm.
CELLS_PER_ROW = 8
CELLS = 5
#: Bytes of a filter that is broadcast, at most; eight cells each.
FILTER_BYTES = 1 << 26
#: Cells of a chunk, and hashes that a task gathers before it sends their cells.
CHUNK = 1 << 18
FLUSH = 1 << 20


def normalised(text: str = "text") -> Column:
    """The text with A-Z lower-cased, empty where it is null."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(text, upper, upper.lower()), F.lit(""))


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def cells_of(hashes: np.ndarray, cells: int) -> np.ndarray:
    """CELLS rows with a cell of each hash."""
    h = hashes.astype(np.uint64)
    first, step = _spread(h), _spread(h ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    return np.stack([(first + np.uint64(i) * step) % np.uint64(cells) for i in range(CELLS)])


def _hits(cells: int, size: int, flush: int):
    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            rows += len(held[-1])
            if rows >= flush:
                yield chunks(np.concatenate(held))
                held, rows = [], 0
        if rows:
            yield chunks(np.concatenate(held))

    def chunks(hashes: np.ndarray) -> pa.RecordBatch:
        """Per chunk, the offsets of cells that were hit, and of those hit more than once."""
        found, times = np.unique(cells_of(hashes, cells), return_counts=True)
        bounds = np.searchsorted(found, np.arange(0, cells + size, size, dtype=np.uint64))
        rows = []
        for c in np.flatnonzero(np.diff(bounds)):
            at = slice(bounds[c], bounds[c + 1])
            offsets = (found[at] - np.uint64(c * size)).astype(np.uint32)
            rows.append((int(c), offsets.tobytes(), offsets[times[at] > 1].tobytes()))
        number, once, again = zip(*rows, strict=True)
        columns = [pa.array(number, pa.int64()), pa.array(once, pa.binary()), pa.array(again, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "once", "again"])

    return hits


def _merged(size: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells of each chunk that two rows or more have hit, as bits."""
        state: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for number, once, again in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if number not in state:
                    state[number] = np.zeros(size, bool), np.zeros(size, bool)
                hit, repeated = state[number]
                new = np.frombuffer(once, np.uint32)
                repeated[new[hit[new]]] = True
                repeated[np.frombuffer(again, np.uint32)] = True
                hit[new] = True
        for number, (_, repeated) in state.items():
            bits = pa.array([np.packbits(repeated).tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([number]), bits], ["chunk", "bits"])

    return merge


def repeated_cells(hashes: DataFrame, cells: int) -> np.ndarray:
    """The filter over the column ``h``: a bit per cell, set where two rows or more hit it."""
    found = hashes.select("h").mapInArrow(_hits(cells, CHUNK, FLUSH), "chunk long, once binary, again binary")
    number = -(-cells // CHUNK)
    merged = found.repartition(max(1, -(-number // 64)), "chunk").mapInArrow(_merged(CHUNK), "chunk long, bits binary")
    out = np.zeros(number * CHUNK // 8, np.uint8)
    for row in merged.collect():  # FILTER_BYTES at most
        out[row.chunk * CHUNK // 8 : (row.chunk + 1) * CHUNK // 8] = np.frombuffer(row.bits, np.uint8)
    return out


def _looked_up(spark: SparkSession, bits: np.ndarray, cells: int):
    """A function of the column ``h``: true where each of its cells was hit twice or more."""
    sent = spark.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def hit_again(h: pa.Array) -> pa.Array:
        at = cells_of(h.to_numpy(zero_copy_only=False).view(np.uint64), cells)
        return pa.array((sent.value[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8) & 1).all(axis=0))

    return hit_again


def possibly_repeated(rows: DataFrame, hashes: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``rows``, which have the column h, with ``again``: false only where ``hashes`` has the row's h once.

    ``hashes`` should be a written table; a range of it more is read for every ``filter_bytes`` of filter.
    """
    wanted = max(1, hashes.count()) * CELLS_PER_ROW
    ranges = -(-wanted // (8 * filter_bytes))
    cells = max(64, -(-wanted // ranges))
    parts = []
    for i in range(ranges):
        inside = F.pmod("h", F.lit(ranges)) == i
        bits = repeated_cells(hashes.where(inside), cells)
        own = rows.where(inside) if ranges > 1 else rows
        parts.append(own.withColumn("again", _looked_up(rows.sparkSession, bits, cells)("h")))
    return reduce(DataFrame.union, parts)


def _decided(rows: DataFrame) -> DataFrame:
    """Rows that may repeat, with ``group_size``, ``keep_id`` and ``kept``; few or many may share a sha."""
    again = cut(rows.withColumn("uid", F.monotonically_increasing_id()), "again")
    rank = F.struct("doc_id", "raw", "uid")  # nulls are the smallest
    groups = again.groupBy("sha").agg(F.count("*").alias("n"), F.max(rank).alias("last"))
    groups = cut(groups.withColumn("group_size", F.col("n")), "groups")
    found = join_hot(again, groups, ["sha"]).withColumn("keep_id", F.col("last.doc_id"))
    return found.withColumn("kept", F.col("uid") == F.col("last.uid")).drop("uid", "last")


def _hashed(docs: DataFrame) -> DataFrame:
    """sha of the normalised text, 64 bits of it for the filter, and a hash of the text as it is for ties."""
    sha = F.unhex(F.sha2(normalised().cast("binary"), 256))
    out = docs.withColumn("sha", sha).withColumn("raw", F.xxhash64("text"))
    return out.withColumn("h", F.xxhash64("sha"))


def duplicates(docs: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of ``docs``; keep_id is that of the row that stays.

    Texts are equal when they are identical after lower-casing A-Z; a null text equals an empty one. Of equal texts the
    row with the largest doc_id stays; a null id is smaller than any. Of rows that tie in doc_id as well, one stays: by
    a hash of the text as it is, and any of them where that ties too. An empty table gives no rows; columns besides
    doc_id and text are not read.
    """
    hashes = cut(_hashed(docs.select("doc_id", "text")).select("doc_id", "sha", "raw", "h"), "hashes")
    found = possibly_repeated(hashes, hashes, filter_bytes)
    digest = F.lower(F.hex("sha")).alias("text_sha256")
    single = found.where("not again").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), digest
    )
    return single.union(_decided(found.where("again").drop("h", "again")).select("doc_id", "keep_id", "group_size", "kept", digest))


def keep_last(docs: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, by the rules of ``duplicates``."""
    packed = docs.select("doc_id", "text", F.struct("*").alias("row"))
    rows = _hashed(packed).drop("text")
    hashes = cut(rows.select("h"), "hashes")
    found = possibly_repeated(rows, hashes, filter_bytes)
    decided = _decided(found.where("again").drop("h", "again")).where("kept")
    return found.where("not again").select("row.*").union(decided.select("row.*"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, sha256(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')) AS text_sha256,
    row_number() OVER () AS r
  FROM documents
), g AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    first_value(doc_id) OVER w AS keep_id, row_number() OVER w = 1 AS kept
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST, r)
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, kept, text_sha256 FROM g
"""
