"""Exact deduplication against brute force, with filters of one and of many ranges and with hot groups."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from graphloom.llm import exact
from graphloom.plans import join_hot
from tests.llm.data import SCHEMA, rows


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def slow(table):
    groups = defaultdict(list)
    for t in table:
        groups[lowered(t[1])].append(t[0])
    out = []
    for text, ids in groups.items():
        known = sorted((i for i in ids if i is not None), reverse=True)
        keep = known[0] if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        order = known + [None] * (len(ids) - len(known))
        out += [(i, keep, len(ids), n == 0, sha) for n, i in enumerate(order)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def table():
    out = rows()
    out += [(200 + i, "One Text That MANY documents have", "en", "s0", 9, "x", "y", 1, 2) for i in range(80)]
    out += [(300 + i, "one text that many documents hAVE", "en", "s0", 9, "x", "y", 1, 2) for i in range(40)]
    out += [(None, "no id", "en", "s0", 5, "x", "y", 1, 2), (None, "No id", None, "s0", 5, "x", "y", 1, 2)]
    out += [(7, "ÄÖ É", "de", "s1", 4, "x", "y", 1, 2), (8, "äö é", "de", "s1", 4, "x", "y", 1, 2), (9, "ÄÖ é", "de", "s1", 4, "x", "y", 1, 2)]
    out += [(900, "Tie", "en", "s0", 3, "x", "y", 1, 2), (900, "tie", "en", "s0", 3, "x", "y", 1, 2), (900, "tie", "en", "s0", 3, "x", "y", 1, 2)]
    return out


@pytest.fixture(scope="module")
def docs(spark, table):
    return spark.createDataFrame(table, SCHEMA).repartition(5)


def got(frame):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in frame.collect()), key=str)


@pytest.mark.parametrize("size", [exact.FILTER_BYTES, 24, 7])
def test_duplicates(docs, table, size):
    """A filter of 7 bytes takes the table in some twenty ranges and raises false alarms; the result is the same."""
    found = exact.duplicates(docs, size)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert got(found) == slow(table)


def test_hot_groups(docs, table, monkeypatch):
    monkeypatch.setattr(exact, "join_hot", lambda *a, **k: join_hot(*a, **k, hot=3))
    assert got(exact.duplicates(docs)) == slow(table)


def test_small_chunks_and_flushes(docs, table, monkeypatch):
    monkeypatch.setattr(exact, "CHUNK", 64)
    monkeypatch.setattr(exact, "FLUSH", 5)
    assert got(exact.duplicates(docs)) == slow(table)


def test_keep_last(docs, table):
    """One row of each group stays, with all its columns, also those that are named like the operator's own."""
    kept = exact.keep_last(docs.withColumnRenamed("fp", "sha").withColumnRenamed("size", "group_size"))
    assert kept.columns == [*docs.columns[:7], "sha", "group_size"]
    found = [(r.doc_id, lowered(r.text)) for r in kept.collect()]
    assert len(found) == len(set(found)) == len({lowered(t[1]) for t in table})
    wanted = {(i, k) for i, k, _, stays, _ in slow(table) if stays}
    assert {i for i, _ in found} == {i for i, _ in wanted}
    assert set(map(tuple, kept.collect())) <= set(table)


def test_reruns_agree(spark, table):
    first = sorted(map(tuple, exact.keep_last(spark.createDataFrame(table, SCHEMA).repartition(2)).collect()), key=str)
    again = sorted(map(tuple, exact.keep_last(spark.createDataFrame(table[::-1], SCHEMA).repartition(7)).collect()), key=str)
    assert [x[:2] for x in first] == [x[:2] for x in again]


def test_empty(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert exact.duplicates(nothing).count() == 0
    assert exact.keep_last(nothing).count() == 0


def test_filter_has_no_false_negatives(spark):
    """Every repeated hash is found; of 20000 single ones at most a twentieth are false alarms."""
    r = np.random.default_rng(5)
    single, twice = r.integers(-(2**63), 2**63, 20000), r.integers(-(2**63), 2**63, 500)
    values = [(int(x),) for x in np.concatenate([single, twice, twice])]
    frame = spark.createDataFrame(values, "h long").repartition(6).cache()
    found = {x.h for x in exact.possibly_repeated(frame, frame).where("again").collect()}
    assert found >= set(map(int, twice))
    assert len(found) - 500 < 1000
