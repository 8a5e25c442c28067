"""Quality rules: word, symbol, line and repetition counts, then zstandard compression bands.

Natural prose compresses into a band that depends on its length. Text below the band repeats itself, text above it is
noise. The whole document is measured, and every fixed chunk of it, the last and shorter one too, so that a long
document cannot hide bad stretches. Chunks are held against the band of their own length.

The upper limits lie between natural text and encoded bytes: at level 3 wrapped base64 stays above 0.95, 0.84, 0.79 and
0.75 of its size at 200, 500, 1000 and 64000 bytes, and random words of letters and digits above 0.66 from 1000 bytes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.tables import table
from graphloom.llm.words import gram_hashes, word_hashes, words_of

#: (from so many bytes, least ratio, greatest ratio) of compressed to raw size. Below 100 bytes the frame's own header
#: decides the ratio, so nothing is judged there.
BANDS = (
    (0, 0.0, 9.0),
    (100, 0.30, 1.00),
    (200, 0.30, 0.88),
    (350, 0.26, 0.80),
    (500, 0.24, 0.74),
    (1000, 0.22, 0.66),
    (2000, 0.20, 0.63),
    (4000, 0.20, 0.60),
    (8000, 0.18, 0.60),
    (64000, 0.12, 0.60),
)
CHUNK = 4096
#: Greatest share of a text's bytes that may lie in chunks outside their band.
CHUNKS_OUTSIDE = 0.3
LEVEL = 3
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 20
REPEAT_WINDOW = 8
REPEAT_PERCENT = 30

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, ratio double, chunks_outside double, kept boolean"
)


def repeated_words(words: list[bytes], width: int = REPEAT_WINDOW) -> int:
    """Words covered by a ``width``-word window that the text has twice or more."""
    grams = gram_hashes(word_hashes(words), width)
    if not len(grams):
        return 0
    _, back, counts = np.unique(grams, return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[back] > 1)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def in_band(size: int, ratio: float) -> bool:
    _, low, high = next(b for b in reversed(BANDS) if size >= b[0])
    return low <= ratio <= high


def ratios(raw: bytes, squeeze: zstandard.ZstdCompressor) -> tuple[float, float]:
    """Compressed share of the whole text, and the share of its bytes in chunks outside their band."""
    if not raw:
        return 0.0, 0.0
    whole, outside = len(squeeze.compress(raw)) / len(raw), 0
    for at in range(0, len(raw), CHUNK):
        part = raw[at : at + CHUNK]
        ratio = whole if len(part) == len(raw) else len(squeeze.compress(part)) / len(part)
        outside += 0 if in_band(len(part), ratio) else len(part)
    return whole, outside / len(raw)


def measure(text: str | None, squeeze: zstandard.ZstdCompressor) -> tuple:
    raw = b"" if text is None else text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    inside = np.frombuffer(b"".join(words), np.uint8)
    chars = int(((inside & 0xC0) != 0x80).sum())
    repeat = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeat > REPEAT_PERCENT * n
    whole, outside = ratios(raw, squeeze)
    symbols = sum(raw.count(bytes([c])) for c in SYMBOLS)
    kept = not failed and in_band(len(raw), whole) and outside <= CHUNKS_OUTSIDE
    return n, chars, symbols, duplicate_lines(raw), repeat, failed, whole, outside, kept


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=LEVEL)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
    for batch in batches:
        rows = [measure(t.as_py(), squeeze) for t in batch.column(1)]
        columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
        arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *arrays], names)


def quality(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text, any more columns) to one row of counts, ratios and verdicts per input row.

    A null or empty text has no words and fails the base rules; a null doc_id and repeated rows are kept as they are;
    an empty table gives no rows. Whole texts are measured, however long. Only doc_id and text are read.
    """
    return docs.select("doc_id", "text").mapInArrow(_measured, SCHEMA)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns, judged row by row in one pass over the table."""
    columns = docs.columns
    at = columns.index("text")

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            yield batch.filter(pa.array([measure(t.as_py(), squeeze)[-1] for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(passing, docs.schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


__all__ = ["keep_good", "measure", "op4_quality", "quality", "words_of"]
