"""Benchmark decontamination: latent semantic retrieval, then longest common subsequence and answer checks.

0. Every document is written once as term numbers, the benchmark's terms apart from all other words.
1. Document frequencies of the benchmark's terms over all passages of ``PASSAGE`` words of the corpus.
2. A randomised SVD of the corpus's TF-IDF passage matrix A: every task adds up its rows' part of AᵀAΩ for a seeded
   random Ω; the sum over tasks gives the leading right singular vectors in one pass (Nyström form, as AᵀA is symmetric
   and positive). The terms are the benchmark's, so all that is broadcast or gathered is bounded by the benchmark.
3. Windows slide over every document, in sizes that double from eight words (or the shortest item) to the longest
   item. A window's cosine with an item is taken in the latent space,
   times the root of the share of the window's TF-IDF energy that falls on benchmark terms. That share alone bounds
   the cosine, so windows below the threshold need no projection.
4. Candidates are verified on the words around them: enough of the item must be a common subsequence, and enough of
   its last sentence (the answer) must be there.

Vocabulary, weights and basis are fitted once for the whole benchmark, so its size changes no result; only the product
of windows and items is taken in blocks of ``BLOCK_ITEMS`` items, to bound its memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.tables import table
from graphloom.plans import cut

PASSAGE = 64
RANK = 64
OVERSAMPLE = 8
SEED = 11
#: Least window size in words, unless the shortest item is shorter.
LEAST_WINDOW = 8
COSINE = 0.6
#: Share of an item's words in the common subsequence, and of its answer's weight found nearby.
SUBSEQUENCE = 0.6
ANSWER = 0.5
#: Items whose cosines with the windows of a batch are computed at once.
BLOCK_ITEMS = 2000
#: Documents of a batch whose windows are projected together, and words whose windows are summed at once.
TOGETHER = 64
SUMMED = 1 << 15
#: Text of the items that are collected and sent at once, and different words of a benchmark, 300 bytes each where held.
PART_BYTES = 1 << 28
MAX_TERMS = 1 << 22

_APART = b""".,;:!?"'()[]{}#*$%&|<>"""
_TABLE = bytes.maketrans(_APART, b" " * len(_APART))


def tokens(text: str | None) -> list[bytes]:
    """Lower-case words without punctuation."""
    return [] if text is None else text.lower().encode("utf-8", "replace").translate(_TABLE).split()


def last_sentence(text: str) -> list[bytes]:
    """Words of the last sentence that has three or more, else all words."""
    for part in reversed(re.split(r"[.!?\n]+", text)):
        if len(tokens(part)) >= 3:
            return tokens(part)
    return tokens(text)


def common_subsequence(words: list, masks: dict, size: int) -> int:
    """Length of the longest common subsequence with an item given as bit masks of its words (Hyyrö, 2004)."""
    full = (1 << size) - 1
    v = full
    for w in words:
        hit = v & masks.get(w, 0)
        if hit:
            v = ((v + hit) | (v - hit)) & full
    return size - v.bit_count()


@dataclass
class Item:
    """A benchmark item as term numbers."""

    item_id: int
    words: np.ndarray
    answer: np.ndarray

    @cached_property
    def masks(self) -> dict[int, int]:
        """For each word, the bits of its places; made in the task that has a candidate."""
        out: dict[int, int] = {}
        for i, w in enumerate(self.words.tolist()):
            out[w] = out.get(w, 0) | 1 << i
        return out


@dataclass
class Space:
    """What is broadcast: terms, their weights, the latent basis and the items in it."""

    items: list[Item]
    terms: int
    idf: np.ndarray
    foreign: float
    basis: np.ndarray
    latent: np.ndarray
    widths: list[int]


def _ids(words: list[bytes], terms: dict[bytes, int]) -> np.ndarray:
    """Term numbers of words; the number of terms stands for any other word."""
    return np.fromiter(map(terms.get, words, repeat(len(terms))), np.int64, len(words))


def _kind(terms: int) -> type:
    """The smallest integers that number ``terms`` terms and the rest."""
    return np.uint16 if terms < 1 << 16 else np.uint32


def _numbered(docs: DataFrame, terms) -> DataFrame:
    """(doc_id, ids): the term numbers of every document, as bytes of the smallest integers."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value
        kind = _kind(len(known))
        for batch in batches:
            ids = [_ids(tokens(t.as_py()), known).astype(kind).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return cut(docs.select("doc_id", "text").mapInArrow(emit, "doc_id long, ids binary"), "terms")


def _frequencies(rows: DataFrame, terms: int) -> tuple[np.ndarray, int]:
    """Passages that have each term, and the number of passages."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, passages = np.zeros(terms + 1, np.int64), 0
        for batch in batches:
            for held in batch.column(0):
                ids = np.frombuffer(held.as_py(), _kind(terms))
                passages += -(-len(ids) // PASSAGE)
                inside = np.flatnonzero(ids < terms)
                seen = np.unique((inside // PASSAGE) * terms + ids[inside]) % max(terms, 1)
                counts[:-1] += np.bincount(seen.astype(np.int64), minlength=terms)
        counts[-1] = passages
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["term", "n"])

    found = rows.select("ids").mapInArrow(emit, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(terms + 1, np.int64)
    for r in found.collect():
        out[r.term] = r.n
    return out[:-1], int(out[-1])


def _sketch(rows: DataFrame, idf: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """AᵀAΩ over all passages, rows of A scaled to unit length."""
    terms, width = omega.shape
    sent = rows.sparkSession.sparkContext.broadcast((idf, (idf[:, None] * omega).astype(np.float32)))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, weighted = sent.value
        total = np.zeros((terms, width))
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                held = [np.frombuffer(x.as_py(), _kind(terms)) for x in batch.column(0).slice(at, TOGETHER)]
                passages = np.cumsum([0, *(-(-len(h) // PASSAGE) for h in held)])
                inside = [np.flatnonzero(h < terms) for h in held]
                ids = np.concatenate([h[i] for h, i in zip(held, inside, strict=True)]).astype(np.int64)
                if not len(ids):
                    continue
                row = np.concatenate([i // PASSAGE + p for i, p in zip(inside, passages, strict=False)])
                heads = np.concatenate(([0], np.flatnonzero(np.diff(row)) + 1))
                sums = np.add.reduceat(weighted[ids], heads, axis=0)
                sums /= np.maximum(np.add.reduceat(weight[ids] ** 2, heads), 1e-12)[:, None]
                order = np.argsort(ids, kind="stable")
                of = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(ids))))[order]
                sorted_ids = ids[order]
                starts = np.concatenate(([0], np.flatnonzero(np.diff(sorted_ids)) + 1))
                total[sorted_ids[starts]] += np.add.reduceat(sums[of], starts, axis=0)
        total *= weight[:, None]
        some = np.flatnonzero(np.any(total, axis=1))
        arrays = [pa.array(some), *(pa.array(total[some, j]) for j in range(width))]
        yield pa.RecordBatch.from_arrays(arrays, ["term", *(f"y{j}" for j in range(width))])

    schema = "term long, " + ", ".join(f"y{j} double" for j in range(width))
    parts = rows.select("ids").mapInArrow(emit, schema)
    sums = cut(parts.groupBy("term").agg(*(F.sum(f"y{j}").alias(f"y{j}") for j in range(width))), "sketch")
    out = np.zeros(omega.shape)
    for r in sums.toLocalIterator():
        out[r[0]] = r[1:]
    return out


def basis_of(sketch: np.ndarray, omega: np.ndarray, rank: int) -> np.ndarray:
    """Leading eigenvectors of a positive matrix G from GΩ (Nyström, shifted for stability)."""
    shift = np.sqrt(len(sketch)) * 1e-12 * max(np.linalg.norm(sketch), 1e-300)
    moved = sketch + shift * omega
    inner = omega.T @ moved
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    keep = values > values.max() * 1e-10
    half = moved @ (vectors[:, keep] / np.sqrt(values[keep]))
    left, _, _ = np.linalg.svd(half, full_matrices=False)
    return left[:, :rank]


def fit(docs: DataFrame, items: list[tuple[int, str]], rank: int = RANK) -> tuple[Space, DataFrame]:
    """Weights and latent space for all items over all documents, and the documents as term numbers."""
    listed = [tokens(t) for _, t in items]
    terms = _terms(w for words in listed for w in words)
    space, rows = fit_terms(docs, terms, window_sizes([len(w) for w in listed if w]), rank)
    return with_items(space, terms, items), rows


def _terms(words: Iterable[bytes]) -> dict[bytes, int]:
    return {w: n for n, w in enumerate(sorted(set(words)))}


def fit_terms(docs: DataFrame, terms: dict[bytes, int], widths: list[int], rank: int = RANK) -> tuple[Space, DataFrame]:
    """The space of ``terms`` over all documents, as yet without items, and the documents as term numbers."""
    rows = _numbered(docs, docs.sparkSession.sparkContext.broadcast(terms))
    found, passages = _frequencies(rows, len(terms))
    idf = np.log((passages + 1.0) / (found + 1.0)) + 1e-3
    foreign = float(np.median(idf)) if len(idf) else 1.0
    basis = np.zeros((len(terms), 1))
    if passages and terms:
        width = min(rank + OVERSAMPLE, len(terms))
        omega = np.linalg.qr(np.random.default_rng(SEED).standard_normal((len(terms), width)))[0]
        basis = basis_of(_sketch(rows, idf, omega), omega, rank)
    none = np.zeros((0, basis.shape[1]), np.float32)
    return Space([], len(terms), idf, foreign, basis, none, widths), rows


def with_items(space: Space, terms: dict[bytes, int], items: list[tuple[int, str]]) -> Space:
    """The same space with these items in it; others change nothing for them."""
    kind = _kind(len(terms))
    made = [(i, tokens(t), last_sentence(t)) for i, t in items]
    listed = [Item(i, _ids(w, terms).astype(kind), _ids(a, terms).astype(kind)) for i, w, a in made if w]
    latent = np.zeros((len(listed), space.basis.shape[1]))
    for n, m in enumerate(listed):
        latent[n] = space.idf[m.words] @ space.basis[m.words]
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    return replace(space, items=listed, latent=latent.astype(np.float32), basis=space.basis.astype(np.float32))


def window_sizes(lengths: list[int]) -> list[int]:
    """Sizes of windows for items of so many words: powers of two, the last one holds the longest item."""
    if not lengths:
        return []
    out = [min(LEAST_WINDOW, 1 << min(lengths).bit_length() - 1)]
    while out[-1] < max(lengths):
        out.append(2 * out[-1])
    return out


def windows(sizes: np.ndarray, widths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of all windows of documents of so many words laid end to end.

    Each size slides by a quarter of itself. A document no longer than a window size is one window itself, at the first such size only.
    """
    offsets = np.cumsum(sizes) - sizes
    owners, starts, ends, before = [], [], [], 0
    for size in widths:
        longer = np.flatnonzero(sizes > size)
        step = max(1, size // 4)
        counts = -(-(sizes[longer] - size) // step) + 1
        owner = np.repeat(longer, counts)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = offsets[owner] + np.minimum(k * step, sizes[owner] - size)
        whole = np.flatnonzero((sizes > before) & (sizes <= size))
        owners += [owner, whole]
        starts += [at, offsets[whole]]
        ends += [at + size, offsets[whole] + sizes[whole]]
        before = size
    return np.concatenate(owners), np.concatenate(starts), np.concatenate(ends)


#: Rows whose running sums one small product with a triangle of ones makes.
TRIANGLE = np.tril(np.ones((64, 64), np.float32), -1)


def _sums(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of rows a..b-1 for each window, as differences of running sums within and over groups of rows."""
    size = len(TRIANGLE)
    groups = np.zeros((len(rows) // size + 1, size, rows.shape[1]), np.float32)
    groups.reshape(-1, rows.shape[1])[: len(rows)] = rows
    inner = (TRIANGLE @ groups).reshape(-1, rows.shape[1])
    totals = groups.sum(axis=1, dtype=np.float64)
    outer = np.cumsum(totals, axis=0) - totals
    return (outer[b // size] - outer[a // size]).astype(np.float32) + (inner[b] - inner[a])


def candidates(
    ids: np.ndarray, sizes: np.ndarray, space: Space, scaled: np.ndarray, energy: np.ndarray, block: int = BLOCK_ITEMS
) -> dict:
    """(document, item number) to [best cosine, windows] for documents laid end to end as term numbers."""
    own = energy[ids]
    whole = np.concatenate(([0.0], np.cumsum(own)))
    own[ids == space.terms] = 0.0
    known = np.concatenate(([0.0], np.cumsum(own)))
    owner, start, end = windows(sizes, space.widths)
    share = (known[end] - known[start]) / np.maximum(whole[end] - whole[start], 1e-12)
    close = share >= COSINE**2
    owner, start, end, share = owner[close], start[close], end[close], np.sqrt(np.minimum(share[close], 1.0))
    order = np.argsort(start, kind="stable")
    owner, start, end, share = owner[order], start[order], end[order], share[order]
    offsets = np.cumsum(sizes) - sizes
    found: dict[tuple[int, int], list] = {}
    cuts = np.searchsorted(start, np.arange(0, len(ids) + SUMMED, SUMMED))
    for at, to in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if at == to:
            continue
        a, b = start[at:to], end[at:to]
        low = int(a[0])
        summed = _sums(scaled[ids[low : int(b.max())]], a - low, b - low)
        summed *= (share[at:to] / np.maximum(np.linalg.norm(summed, axis=1), 1e-12)).astype(np.float32)[:, None]
        for first in range(0, len(space.latent), block):
            near = summed @ space.latent[first : first + block].T
            for w, item in zip(*(x.tolist() for x in np.nonzero(near >= COSINE)), strict=True):
                doc = int(owner[at + w])
                held = found.setdefault((doc, first + item), [0.0, []])
                held[0] = max(held[0], float(near[w, item]))
                held[1].append((int(a[w] - offsets[doc]), int(b[w] - offsets[doc])))
    return found


def verify(words: np.ndarray, item: Item, spans: list[tuple[int, int]], weights: list[float]) -> tuple[float, float]:
    """Best share of the item's words, and its answer's weight there, near any candidate window.

    A place that has enough of the answer goes before one that has more of the item.
    """
    size, best = len(item.words), (False, 0.0, 0.0)
    spans = sorted(spans)
    merged: list[list[int]] = []
    for a, b in spans:
        a, b = max(0, a - size), min(len(words), b + size)
        if merged and a <= merged[-1][1] and b - merged[-1][0] <= 8 * size + 256:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    for a, b in merged:
        region = words[a:b]
        # words that the item does not have change no subsequence and no answer
        own = np.flatnonzero(np.isin(region, item.words, kind="table"))
        region, length = region[own].tolist(), b - a
        # a subsequence counts only if it stays within twice the item's length
        step = max(1, size // 2)
        for at in range(0, max(1, length - size), step):
            first, last = np.searchsorted(own, (at, at + 2 * size)).tolist()
            if last - first < SUBSEQUENCE * size:
                continue
            near = region[first:last]
            share = common_subsequence(near, item.masks, size) / size
            if share >= SUBSEQUENCE:
                have = set(near)
                listed = item.answer.tolist()
                total = sum(weights[w] for w in listed)
                answer = sum(weights[w] for w in listed if w in have) / max(total, 1e-12)
                best = max(best, (answer >= ANSWER, share, answer))
    return best[1:]


RESULT = "doc_id long, item_id long, cosine double, subsequence double, answer double"


def _matches(rows: DataFrame, space: Space, block: int) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(space)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Space = sent.value
        weights = np.append(own.idf, own.foreign)
        scaled = np.vstack([own.idf[:, None] * own.basis, np.zeros((1, own.basis.shape[1]))]).astype(np.float32)
        energy, listed = weights**2, weights.tolist()
        for batch in batches:
            out: list[tuple] = []
            for at in range(0, batch.num_rows if own.items else 0, TOGETHER):
                part = batch.slice(at, TOGETHER)
                held = [np.frombuffer(x.as_py(), _kind(own.terms)).astype(np.int64) for x in part.column(1)]
                sizes = np.array([len(h) for h in held], np.int64)
                found = candidates(np.concatenate(held), sizes, own, scaled, energy, block)
                for (doc, n), (cosine, spans) in found.items():
                    share, answer = verify(held[doc], own.items[n], spans, listed)
                    if share >= SUBSEQUENCE and answer >= ANSWER:
                        name = part.column(0)[doc].as_py()
                        out.append((name, own.items[n].item_id, min(1.0, cosine), share, answer))
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            names = ["doc_id", "item_id", "cosine", "subsequence", "answer"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return rows.mapInArrow(search, RESULT)


def _words_and_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different words of the items of a batch, and a row of each different number of words (-1: no length)."""
    for batch in batches:
        listed = [tokens(t.as_py()) for t in batch.column(0)]
        words, sizes = sorted({w for x in listed for w in x}), sorted({len(x) for x in listed if x})
        columns = [pa.array([*words, *[b""] * len(sizes)], pa.binary()), pa.array([-1] * len(words) + sizes, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["word", "size"])


def contaminated(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK_ITEMS, part: int = PART_BYTES) -> DataFrame:
    """(doc_id, item_id, cosine, subsequence, answer): documents and the benchmark items that they hold.

    Null and empty texts and items match nothing; repeated rows give repeated results; a null doc_id is carried; an
    empty table on either side gives no rows. Whole texts are searched. Only doc_id, item_id and the texts are read.
    The space is fitted once, on the words of the whole benchmark; its items are sent in parts of about ``part`` bytes
    of text, and a part more reads the documents' term numbers once more. ``block`` and ``part`` change no result. The
    benchmark's different words are held by every task; more than MAX_TERMS of them are refused.
    """
    benchmark = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    listed = lambda rows: sorted({(r.item_id, r.text) for r in rows.collect()})
    if size <= part:
        space, rows = fit(docs, listed(benchmark))
        return _matches(rows, space, block)
    benchmark, parts = cut(benchmark.distinct(), "benchmark"), -(-size // part)
    facts = cut(benchmark.select("text").mapInArrow(_words_and_lengths, "word binary, size long").distinct(), "words")
    if facts.where("size < 0").count() > MAX_TERMS:
        raise ValueError(f"a benchmark of more than {MAX_TERMS} different words")
    terms = _terms(bytes(r.word) for r in facts.where("size < 0").select("word").collect())
    ends = facts.where("size > 0").agg(F.min("size"), F.max("size")).first()
    space, rows = fit_terms(docs, terms, window_sizes([x for x in ends if x]))
    out = None
    for i in range(parts):
        some = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i)
        found = _matches(rows, with_items(space, terms, listed(some)), block)
        out = found if out is None else out.union(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns.

    Rows are told apart by doc_id and text, so that a null or repeated doc_id neither saves nor condemns another row.
    """
    row = "row"
    while row in map(str.lower, docs.columns):
        row += "_"
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    leaks = contaminated(keyed.select(F.col(row).alias("doc_id"), "text"), benchmark)
    leaks = cut(leaks.select(F.col("doc_id").alias(row)).distinct(), "leaks")
    return keyed.join(leaks, row, "left_anti").select(*docs.columns)


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
