"""Substring dedup: suffix automata of reference shards, matching statistics, spans above a length.

A word is removed from a document if a window of ``WINDOW`` words that covers it also starts in a document with a
smaller doc_id. All other documents are the reference, so one automaton, or one broadcast, of the reference would grow
with the corpus. The reference is sharded instead, and each shard's automaton meets only the text that can match it:

1. The anchor of a window is the least hash among its ``GRAM``-word runs, so equal windows have equal anchors. A
   document has about one anchor per 20 words; an anchor is shared if two different texts have it.
2. Stretches of windows with one shared anchor are the passages. Equal passages are kept once, with the smallest
   doc_id that has them. Where an anchor has more than ``CROWD`` different passages (a common passage in many
   contexts), they are first cut down to the windows whose hash occurs in two documents.
3. Passages are dealt to shards by anchor, so equal windows meet. A task builds a shard's generalised suffix automaton
   over the words, in ascending doc_id, each state knowing the first document that has its strings. Every passage is
   streamed over it for its matching statistics; where the match has WINDOW words or more and began in an earlier
   document, the window is removed.
4. An anchor that still has more than ``WIDE`` different passages would make its shard too large. Its windows are
   instead joined, one by one, with the first document that has the window, so no shard holds more than WIDE passages
   of an anchor.

What compares words and what compares hashes: the automaton compares the words themselves. Whole documents with equal
word sequences (all but the first lose all words from WINDOW words on) are found by 128-bit hashes, equal passages by
128-bit hashes inside an anchor, and the windows of step 4 by 64-bit hashes inside an anchor.

Rows are told apart by ``row``, a hash of doc_id and text: rows with one doc_id and different texts do not mix, and rows
equal in both have the same result anyway. Keys that many rows share (anchors, passages, windows) are dealt over several
tasks in every join.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.tables import table
from graphloom.llm.words import gram_hashes, signed, sliding_min, word_hashes, words_of
from graphloom.plans import cut, join_hot

WINDOW = 50
GRAM = 10
#: Different passages of an anchor up to which they are taken as they are.
CROWD = 32
#: Different passages of an anchor up to which its automaton is built.
WIDE = 2000
#: Words of passages in a shard, about.
SHARD_WORDS = 60_000


class SuffixAutomaton:
    """Generalised suffix automaton; each state has the first document whose text holds its strings."""

    def __init__(self) -> None:
        self.step: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.first = [-1]

    def add(self, words: list, doc: int) -> None:
        """Add one text. Texts are added in ascending ``doc``."""
        step, link, length, first = self.step, self.link, self.length, self.first
        last = 0
        for w in words:
            to = step[last].get(w)
            if to is not None:
                if length[to] == length[last] + 1:
                    last = to
                else:
                    last = self._split(last, w, to)
                continue
            now = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            first.append(doc)
            p = last
            while p != -1 and w not in step[p]:
                step[p][w] = now
                p = link[p]
            if p != -1:
                q = step[p][w]
                link[now] = q if length[q] == length[p] + 1 else self._split(p, w, q)
            last = now

    def _split(self, p: int, w: object, q: int) -> int:
        """The part of ``q`` whose longest string ends a step from ``p``; it was first seen where ``q`` was."""
        step, link, length, first = self.step, self.link, self.length, self.first
        new = len(step)
        step.append(dict(step[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        first.append(first[q])
        link[q] = new
        while p != -1 and step[p].get(w) == q:
            step[p][w] = new
            p = link[p]
        return new

    def matches(self, words: list, window: int) -> Iterator[tuple[int, int]]:
        """(start, first document) of each ``window``-word run of ``words`` that some added text holds."""
        step, link, length, first = self.step, self.link, self.length, self.first
        state, size = 0, 0
        for i, w in enumerate(words):
            while state and w not in step[state]:
                state = link[state]
                size = length[state]
            to = step[state].get(w)
            if to is None:
                continue
            state, size = to, size + 1
            if size >= window:
                while length[link[state]] >= window:
                    state = link[state]
                    size = length[state]
                yield i - window + 1, first[state]


def runs(starts: np.ndarray) -> list[list[int]]:
    """Ascending window starts as [first start, one past the last start] of each unbroken run."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > 1)
    heads = np.concatenate(([0], breaks + 1))
    tails = np.concatenate((breaks, [len(starts) - 1]))
    return [[int(starts[a]), int(starts[b]) + 1] for a, b in zip(heads, tails, strict=True)]


def window_anchors(hashes: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The anchor of each window of a text."""
    return sliding_min(gram_hashes(hashes, gram), window - gram + 1)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")


def _anchor_table(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, ids, sizes = [np.zeros(0, np.uint64)], [], []
            for doc, row, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                words = words_of(text.as_py())
                if not doc.is_valid or len(words) < window:
                    continue
                found.append(np.unique(window_anchors(word_hashes(words), window, gram)))
                ids.append((doc.as_py(), row.as_py(), *_key(b" ".join(words))))
                sizes.append(len(found[-1]))
            owner = np.repeat(np.array(ids, np.int64).reshape(-1, 4), sizes, axis=0)
            arrays = [pa.array(signed(np.concatenate(found))), *(pa.array(owner[:, i]) for i in range(4))]
            yield pa.RecordBatch.from_arrays(arrays, ["anchor", "doc_id", "row", "high", "low"])

    schema = "anchor long, doc_id long, row long, high long, low long"
    return _keyed(docs).mapInArrow(emit, schema)


PASSAGES = "anchor long, doc_id long, row long, start int, windows int, high long, low long, passage binary"
_NAMES = [x.split()[0] for x in PASSAGES.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, _KINDS, strict=True)], _NAMES)


def _passages(docs: DataFrame, wanted: DataFrame, window: int, gram: int) -> DataFrame:
    """Passages of the documents in ``wanted`` (row, anchors)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, row, text, shared in zip(*(batch.column(i) for i in range(4)), strict=True):
                words = words_of(text.as_py())
                anchors = window_anchors(word_hashes(words), window, gram)
                chosen = np.sort(np.array(shared.as_py(), np.int64))
                own = signed(anchors)
                heads = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]))
                at = np.searchsorted(chosen, own[heads[:-1]])
                hit = (at < len(chosen)) & (chosen[np.minimum(at, len(chosen) - 1)] == own[heads[:-1]])
                for i in np.flatnonzero(hit).tolist():
                    a, b = int(heads[i]), int(heads[i + 1])
                    passage = b" ".join(words[a : b + window - 1])
                    out.append((int(own[a]), doc.as_py(), row.as_py(), a, b - a, *_key(passage), passage))
            yield _batch(out)

    chosen = _keyed(docs).join(wanted, "row").select("doc_id", "row", "text", "shared")
    return chosen.mapInArrow(emit, PASSAGES)


def _key(text: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", xxhash.xxh3_128_digest(text))


#: Bits of Spark's bitmap_construct_agg.
BITS = 1 << 15


def _windows(passages: DataFrame, window: int) -> DataFrame:
    """(anchor, doc_id, row, at, window): the hash of every window of the passages and where it starts."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [gram_hashes(word_hashes(p.as_py().split()), window) for p in batch.column(4)]
            sizes = [len(f) for f in found]
            starts = np.repeat(np.asarray(batch.column(3), np.int64), sizes)
            inner = np.concatenate([np.zeros(0, np.int64), *(np.arange(n) for n in sizes)])
            arrays = [
                *(pa.array(np.repeat(np.asarray(batch.column(i)), sizes), pa.int64()) for i in range(3)),
                pa.array((starts + inner).astype(np.int32), pa.int32()),
                pa.array(signed(np.concatenate([np.zeros(0, np.uint64), *found]))),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["anchor", "doc_id", "row", "at", "window"])

    schema = "anchor long, doc_id long, row long, at int, window long"
    return passages.select("anchor", "doc_id", "row", "start", "passage").mapInArrow(hashed, schema)


def _first_holders(windows: DataFrame) -> DataFrame:
    """(anchor, window, first, n) of the windows that two documents have."""
    held = windows.groupBy("anchor", "window")
    twice = held.agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    return twice.where("first < last").drop("last")


def _trimmed(crowded: DataFrame, window: int) -> DataFrame:
    """Passages cut down to windows whose hash occurs in two documents.

    The repeated hashes of an anchor are sent to its passages as a bitmap of fixed size. A window that only shares its
    bit with a repeated one stays in; the automaton then finds no match for it.
    """
    place = F.pmod(F.col("window"), F.lit(BITS).cast("long"))
    repeated = _first_holders(_windows(crowded, window)).groupBy("anchor").agg(F.bitmap_construct_agg(place).alias("bits"))

    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                words = row["passage"].split()
                bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little")
                places = signed(gram_hashes(word_hashes(words), window)) % BITS
                for a, b in runs(np.flatnonzero(bits[places])):
                    part = b" ".join(words[a : b + window - 1])
                    out.append((row["anchor"], row["doc_id"], row["row"], row["start"] + a, b - a, *_key(part), part))
            yield _batch(out)

    sizes = crowded.groupBy("anchor").agg(F.count("*").alias("n"))
    marked = cut(repeated.join(sizes, "anchor"), "repeated")
    columns = ["anchor", "doc_id", "row", "start", "passage", "bits"]
    return join_hot(crowded, marked, ["anchor"]).select(*columns).mapInArrow(cutting, PASSAGES)


def _removed(window: int):
    """A shard of different passages to the windows that an earlier document has."""

    def match(shard: pd.DataFrame) -> pd.DataFrame:
        automaton, out = SuffixAutomaton(), []
        shard = shard.sort_values(["first", "anchor", "high", "low"], kind="stable")
        for anchor, high, low, first, passage in shard[["anchor", "high", "low", "first", "passage"]].itertuples(index=False):
            words = passage.split()
            found = [i for i, doc in automaton.matches(words, window) if doc < first]
            if found:
                out.append((anchor, high, low, runs(np.array(found))))
            automaton.add(words, first)
        return pd.DataFrame(out, columns=["anchor", "high", "low", "spans"])

    return match


def _split(passages: DataFrame, most: int, label: str) -> tuple[DataFrame, DataFrame]:
    """Passages of anchors with at most ``most`` different ones, and those of the others."""
    kinds = passages.groupBy("anchor", "high", "low").agg(F.count("*").alias("rows"))
    sizes = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("rows").alias("n"))
    many = cut(sizes.where(F.col("kinds") > most).select("anchor", "n"), label)
    marked = join_hot(passages, many.withColumn("many", F.lit(True)), ["anchor"], how="left")
    return marked.where("many is null").drop("many"), marked.where("many").drop("many")


def removed_spans(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD, wide: int = WIDE
) -> DataFrame:
    """(row, whole, spans): rows that lose words, wholly or by spans [first word, one past the last]."""
    anchors = cut(_anchor_table(docs, window, gram), "anchors")
    texts = anchors.groupBy("high", "low").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    owners = cut(anchors.select("doc_id", "row", "high", "low").distinct(), "owners")
    counts = owners.groupBy("high", "low").agg(F.count("*").alias("n"))
    copied = cut(texts.where("first < last").drop("last").join(counts, ["high", "low"]), "copied")
    copies = cut(join_hot(owners, copied, ["high", "low"]).where("doc_id > first").select("row").distinct(), "copies")
    shared = anchors.groupBy("anchor").agg(F.min("low").alias("a"), F.max("low").alias("b"), F.count("*").alias("n"))
    shared = cut(shared.where("a < b").select("anchor", "n"), "shared")
    wanted = join_hot(anchors.select("anchor", "row"), shared, ["anchor"]).join(copies, "row", "left_anti")
    wanted = wanted.groupBy("row").agg(F.collect_set("anchor").alias("shared"))
    passages = cut(_passages(docs, wanted, window, gram), "passages")

    few, crowded = _split(passages, crowd, "crowded")
    trimmed = cut(_trimmed(crowded, window), "trimmed")
    narrow, over = _split(trimmed, wide, "wide")
    ready = few.union(narrow)

    same = ["anchor", "high", "low"]
    least = ready.groupBy(*same).agg(F.min(F.struct("doc_id", "start", "row")).alias("m"), F.count("*").alias("n"))
    least = cut(least.select(*same, "n", F.col("m.doc_id").alias("first"), F.col("m.start").alias("start"), F.col("m.row").alias("row")), "least")
    once = ready.join(least.drop("n"), [*same, "start", "row"])
    once = cut(once.select(*same, "first", "windows", "passage").dropDuplicates(same), "once")
    words = once.agg(F.sum(F.col("windows") + window)).first()[0] or 0
    shards = int(words // SHARD_WORDS) + 1
    dealt = once.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    matched = dealt.groupBy("shard").applyInPandas(
        _removed(window), "anchor long, high long, low long, spans array<array<int>>"
    )
    matched = cut(matched, "matched")

    known = least.select(*same, "n", "first").join(matched, same, "left")
    known = join_hot(ready.select(*same, "doc_id", "row", "start", "windows"), cut(known, "known"), same)
    repeats = known.where("doc_id > first").select(
        "row", F.col("start").alias("a"), (F.col("start") + F.col("windows") + window - 1).alias("b")
    )
    # the first document may hold the passage more than once: its windows go at every start
    parts = known.where("doc_id = first").select("row", "start", F.explode("spans").alias("s")).select(
        "row",
        (F.col("start") + F.col("s")[0]).alias("a"),
        (F.col("start") + F.col("s")[1] + window - 1).alias("b"),
    )
    single = _windows(over, window)
    late = join_hot(single, cut(_first_holders(single), "holders"), ["anchor", "window"]).where("doc_id > first")
    late = late.select("row", F.col("at").alias("a"), (F.col("at") + window).alias("b"))
    spans = repeats.union(parts).union(late).groupBy("row").agg(F.array_sort(F.collect_set(F.array("a", "b"))).alias("spans"))
    whole = copies.select("row", F.lit(True).alias("whole"))
    return whole.join(spans, "row", "full").select("row", F.coalesce("whole", F.lit(False)).alias("whole"), "spans")


RESULT = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"


def substring_dedup(
    docs: DataFrame, window: int = WINDOW, with_text: bool = True, crowd: int = CROWD, wide: int = WIDE
) -> DataFrame:
    """Documents (doc_id, text, any more columns) to (doc_id, n_words, n_removed, kept, kept_sha256) per input row.

    ``kept`` is the kept words joined by spaces (null without ``with_text``). A null text has no words; a document with
    a null doc_id is neither reference nor cut; rows with one doc_id are each other's equals, not earlier, and each is
    judged by its own text; an empty table gives no rows; other columns are not read. Windows are judged on the input, not on what is left.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, whole, spans in zip(*(batch.column(i) for i in range(4)), strict=True):
                words = words_of(text.as_py())
                n, at, kept = len(words), 0, []
                if not whole.as_py():
                    for a, b in spans.as_py() or ():
                        kept += words[at:a]
                        at = max(at, b)
                    kept += words[at:]
                joined = b" ".join(kept)
                digest = hashlib.sha256(joined).hexdigest()
                out.append((doc.as_py(), n, n - len(kept), joined.decode() if with_text else None, digest))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    found = removed_spans(docs, window, crowd=crowd, wide=wide)
    joined = _keyed(docs).join(found, "row", "left")
    return joined.select("doc_id", "text", "whole", "spans").mapInArrow(apply, RESULT)


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), w AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM d)
), f AS (
  SELECT k, min(doc_id) AS first FROM w GROUP BY k
), r AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM w JOIN f USING (k) WHERE first < doc_id
), x AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d
), k AS (
  SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.p) AS kept, count(*) AS n
  FROM x ANTI JOIN r ON r.doc_id = x.doc_id AND r.p = x.p GROUP BY x.doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
