"""Words, their hashes and polynomial hashes of word sequences, shared by the text operators."""

from __future__ import annotations

import numpy as np
import xxhash

#: Base of the polynomial hashes, odd so that it has an inverse modulo 2^64.
BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8; bytes.split() without arguments parts at just these bytes."""
    return [] if text is None else text.encode("utf-8", "replace").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Polynomial hashes spread over all 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` word hashes; empty where the text is shorter."""
    size = len(h) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = h[:size].copy()
    for j in range(1, n):
        out *= BASE
        out += h[j : size + j]
    return mixed(out)


def sliding_min(g: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` consecutive ones, by doubling."""
    if len(g) < width:
        return g[:0]
    out, have = g, 1
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def signed(h: np.ndarray) -> np.ndarray:
    """The same bits as Spark's LongType."""
    return h.view(np.int64)
