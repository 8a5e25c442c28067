"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is bound from its letters' vectors, each permuted by its
place, a text is the bundle (sum) of its trigrams, and a language the bundle of its training texts. A text gets the
language whose prototype has the largest cosine with it. Bundling is linear, so trigrams are counted first and vectors
are summed once per different trigram.

Training texts weigh alike, however long: the counts of each are brought to unit length before they join their
language. Vectors of different trigrams are all but orthogonal, so its bundle has unit length up to that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.tables import table
from graphloom.plans import cut

DIMENSIONS = 1024
SEED = 7
FOLDS = 5
#: Languages whose prototypes, DIMENSIONS doubles each, are broadcast at once; more are compared block by block.
BLOCK = 2000
#: Different trigrams whose vectors a task keeps.
CACHED = 1 << 15
#: Trigrams counted or bundled at a time.
CHUNK = 1 << 18


class Encoder:
    """Trigram counts of texts, and bundles of trigram vectors."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED) -> None:
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.kept: dict[int, int] = {}
        self.vectors = np.zeros((1024, dimensions), np.int8)
        self.is_letter = np.zeros(0x110000, bool)
        self.seen = np.zeros(0x110000, bool)

    def _codes(self, text: str) -> np.ndarray:
        """Code points of the lower-cased text, anything that is no letter as one 0, with a 0 at either end."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        new = np.unique(points[~self.seen[points]])
        self.seen[new] = True
        self.is_letter[new] = [chr(c).isalpha() for c in new]
        codes = np.concatenate(([0], np.where(self.is_letter[points], points, 0), [0])).astype(np.uint64)
        return codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]

    def count(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Different trigrams of the text, three 21-bit code points each, and how often it has them."""
        if not text:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        c = self._codes(text)
        grams = (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]
        return np.unique(grams, return_counts=True)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            bits = np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions)
            self.letters[code] = (2 * bits - 1).astype(np.int8)
        return self.letters[code]

    def bind(self, gram: int) -> np.ndarray:
        """The vectors of three letters, rotated by two, one and no places, multiplied."""
        a, b, c = gram >> 42, gram >> 21 & 0x1FFFFF, gram & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def _rows(self, grams: np.ndarray) -> np.ndarray:
        if len(self.kept) + len(grams) > CACHED:
            self.kept.clear()
        rows = np.empty(len(grams), np.int64)
        for i, g in enumerate(grams.tolist()):
            at = self.kept.get(g)
            if at is None:
                at = self.kept[g] = len(self.kept)
                if at >= len(self.vectors):
                    more = np.zeros((max(at + 1, 2 * len(self.vectors)), self.dimensions), np.int8)
                    more[: len(self.vectors)] = self.vectors
                    self.vectors = more
                self.vectors[at] = self.bind(g)
            rows[i] = at
        return rows

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.zeros(self.dimensions, np.float64)
        kind = np.float32 if counts.dtype.kind == "i" else np.float64
        for at in range(0, len(grams), 4096):
            rows = self._rows(grams[at : at + 4096])
            out += counts[at : at + 4096].astype(kind) @ self.vectors[rows].astype(kind)
        return out


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder, open_, bundles = Encoder(), {}, {}

    def settle(lang: str) -> None:
        grams = np.concatenate([g for g, _ in open_[lang]])
        counts = np.concatenate([c for _, c in open_[lang]])
        grams, back = np.unique(grams, return_inverse=True)
        counts = np.bincount(back, counts, len(grams))
        bundles[lang] = bundles.get(lang, 0) + encoder.bundle(grams, counts)
        open_[lang] = []

    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1), strict=True):
            grams, counts = encoder.count(text.as_py())
            if len(grams):
                held = open_.setdefault(lang.as_py(), [])
                held.append((grams, counts / np.linalg.norm(counts)))
                if sum(len(g) for g, _ in held[-64:]) > CHUNK or len(held) > 512:
                    settle(lang.as_py())
    for lang in open_:
        if open_[lang]:
            settle(lang)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * DIMENSIONS), pa.array(np.arange(DIMENSIONS)), pa.array(bundles[lang])],
            ["lang", "i", "v"],
        )


def train(docs: DataFrame) -> DataFrame:
    """(lang, vector): language prototypes of unit length from all rows with a lang and a letter in their text."""
    labelled = docs.where(F.col("lang").isNotNull()).select("text", "lang")
    parts = labelled.mapInArrow(_train, "lang string, i long, v double")
    sums = parts.groupBy("lang", "i").agg(F.sum("v").alias("v"))
    folded = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    unit = F.transform("s", lambda x: x["v"] / F.col("norm"))
    return cut(folded.where("norm > 0").select("lang", unit.alias("vector")), "prototypes")


def predict(docs: DataFrame, prototypes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, lang_pred, score) per row from the text alone; score is the cosine, 0 where it is negative.

    A text that is null or has no letter, and any text where no language was learned, is `und` with score 0. Equal
    cosines go to the first language by code point. Repeated rows and null ids stay; whole texts are read, however long;
    an empty table gives no rows; other columns are not read. Any number of languages: ``block`` of them are sent at a
    time, and a block more reads the texts once more.
    """
    empty = F.lit(None)
    rows = docs.select("doc_id", "text", empty.cast("string").alias("lang_pred"), empty.cast("double").alias("cosine"))
    last, more = None, True
    while more:
        rest = prototypes if last is None else prototypes.where(F.col("lang") > last)
        found = rest.orderBy("lang").limit(block + 1).collect()
        more = len(found) > block
        if found:
            rows = _nearest(rows, [r.lang for r in found[:block]], np.array([r.vector for r in found[:block]]))
            last = found[:block][-1].lang
    score = F.least(F.greatest(F.coalesce("cosine", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return rows.select("doc_id", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), score.alias("score"))


def _nearest(rows: DataFrame, names: list[str], vectors: np.ndarray) -> DataFrame:
    """(doc_id, text, lang_pred, cosine) with the nearest of ``names`` where it is nearer than the one before."""
    sent = rows.sparkSession.sparkContext.broadcast(vectors)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        for batch in batches:
            best_names, best = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for row, text in enumerate(batch.column(1)):
                grams, counts = encoder.count(text.as_py())
                if not len(grams) or not grams.any():
                    continue
                vector = encoder.bundle(grams, counts)
                norm = float(np.linalg.norm(vector))
                if norm:
                    near = sent.value @ vector / norm
                    at = int(np.argmax(near))
                    if best[row] is None or near[at] > best[row]:
                        best_names[row], best[row] = names[at], float(near[at])
            columns = [batch.column(0), batch.column(1), pa.array(best_names, pa.string()), pa.array(best, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "lang_pred", "cosine"])

    return rows.mapInArrow(label, "doc_id long, text string, lang_pred string, cosine double")


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of the documents that nothing is learned from; null ids are never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = train(docs.where(~held_out()))
    found = predict(docs, prototypes)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
