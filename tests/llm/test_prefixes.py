"""The prefix trie against a dictionary of all prefixes, with long conversations, hot nodes and odd rows; its SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from graphloom.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string, what string, size long, block int"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(table):
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in table:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[conv].append((turn is not None, turn or 0, tie, role, text))
    plain = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = plain.get(base, [])[:h] + own[h:]
    return out


def slow(paths):
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        saved[node] = sum(saved[c] for c in children[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    out = []
    for node, of in members.items():
        ended = ",".join(str(c) for c in sorted(of) if len(paths[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(of), len(node), parent, len(of), len(children[node]), leaves[node], saved[node], hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def table():
    r = random.Random(2)
    out = []

    def add(conv, turns):
        out.extend((conv, i, role, text, "w", 1, 2) for i, (role, text) in enumerate(turns))

    short = [[(r.choice(["user", "bot"]), r.choice(["hi", "Ünï 😀", "yes", ""])) for _ in range(r.randrange(1, 7))] for _ in range(12)]
    for c in range(0, 260):
        if c != 100:  # its followers find no base
            add(c, r.choice(short))
    long = [("user", f"turn {i % 7}") for i in range(45)]
    for c in range(300, 330):
        add(c, long[: r.choice([8, 9, 16, 17, 24, 40, 45])])
    for c in range(330, 340):
        add(c, [*long[:20], ("bot", f"branch {c % 3}"), *long[21:30]])
    add(-5, short[0])
    add(-250, short[1])
    out += [(500, None, "user", "first", "w", 1, 2), (500, 3, None, None, "w", 1, 2), (500, 3, "bot", None, "w", 1, 2), (500, 3, "bot", None, "w", 1, 2)]
    out += [(None, 1, "user", "of no conversation", "w", 1, 2), (501, 7, "user", "x" * 100_000, "w", 1, 2)]
    out += [(600, 0, "ab", "c", "w", 1, 2), (601, 0, "a", "bc", "w", 1, 2)]
    return out


@pytest.fixture(scope="module")
def frame(spark, table):
    return spark.createDataFrame(table, SCHEMA).repartition(5)


def run(frame, hot=prefixes.HOT_ROWS):
    turns = prefixes.placed(frame, hot)
    found = prefixes.trie(turns.select("conv_id").distinct(), prefixes.forked(turns, hot=hot), hot)
    assert found.columns == NAMES
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_trie(frame, table):
    assert run(frame) == slow(rebuilt(table))


def test_hot_conversations_and_narrow_blocks(frame, table, monkeypatch):
    """Ranges instead of windows, dealt joins, blocks of three turns and pieces of five ids change nothing."""
    monkeypatch.setattr(prefixes, "WIDTH", 3)
    monkeypatch.setattr(prefixes, "PIECE", 5)
    assert run(frame, hot=4) == slow(rebuilt(table))


def test_without_forks(frame, table):
    """The operator on conversations as they are."""
    turns = prefixes.placed(frame)
    found = prefixes.trie(turns.select("conv_id").distinct(), turns.withColumnRenamed("k", "pos"))
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in table:
        if conv is not None:
            tie = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()
            convs[conv].append((turn is not None, turn or 0, tie, role or "", text or ""))
    paths = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    assert sorted((tuple(r) for r in found.collect()), key=str) == slow(paths)


def test_sql(frame, table):
    con = duckdb.connect()
    con.register("conversations", frame.toArrow())
    found = con.execute(prefixes.ORACLE_SQL)
    assert [d[0] for d in found.description] == NAMES
    assert sorted(found.fetchall(), key=str) == slow(rebuilt(table))


def test_empty(frame):
    assert run(frame.limit(0)) == []
