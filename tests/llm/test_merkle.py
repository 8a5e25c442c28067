"""The Merkle manifest against a recursive version, at several group sizes, and its SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.llm import exact, merkle
from graphloom.plans import join_hot
from tests.llm.data import SCHEMA, rows


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    doc_id, _, lang, source, n_chars = row[:5]
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree(leaves):
    """Levels of digests, the leaves first."""
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def climb(levels, at, new, proof):
    for level in levels[:-1]:
        run = level[at // 16 * 16 : at // 16 * 16 + 16]
        proof += run[: at % 16] + run[at % 16 + 1 :]
        run[at % 16] = new
        at, new = at // 16, digest("".join(run))
    return new


def slow(table):
    sources = {}
    for row in table:
        text = row[1]
        struck = row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
        sources.setdefault(row[3], []).append((row[0], leaf_of(row, text), leaf_of(row, lowered(text) if struck else text)))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        sources[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[name] = tree([x[1] for x in sources[name]])
    top = tree([trees[n][-1][0] for n in names])
    out = []
    for number, name in enumerate(names):
        for at, (doc, leaf, other) in enumerate(sources[name]):
            proof = []
            folded = climb(top, number, climb(trees[name], at, other, proof), proof)
            root = top[-1][0]
            out.append((doc, leaf, trees[name][-1][0], root, digest("".join(proof)), folded, folded == root))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def table():
    r = random.Random(8)
    out = rows()
    for i in range(100, 420):
        out.append((i, r.choice(["Some Text", "plain", None, f"Text {i}"]), r.choice(["en", None]), "large", i, "x", "y", 1, 2))
    out += [(i, "One Only", "en", f"only{i}", 3, "x", "y", 1, 2) for i in range(500, 540)]
    out += [(None, "a", None, None, None, "x", "y", 1, 2), (None, "a", None, None, None, "x", "y", 1, 2), (-3, "B", "en", "", 1, "x", "y", 1, 2)]
    return out


@pytest.fixture(scope="module")
def docs(spark, table):
    return spark.createDataFrame(table, SCHEMA).repartition(5)


def changed():
    struck = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return F.when(struck & F.col("text").isNotNull(), exact.normalised())


def got(found):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert found.columns == names
    return sorted((tuple(r[n] for n in names) for r in found.collect()), key=str)


@pytest.mark.parametrize("most", [3, 1, 2])
def test_against_recursive_version(docs, table, most):
    assert got(merkle.prove(merkle.build(docs, changed(), most))) == slow(table)


def test_hot_sources(docs, table, monkeypatch):
    monkeypatch.setattr(merkle, "join_hot", lambda *a, **k: join_hot(*a, **k, hot=3))
    assert got(merkle.prove(merkle.build(docs, changed()))) == slow(table)


def test_sql(docs, table):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    assert sorted(con.execute(merkle.ORACLE_SQL).fetchall(), key=str) == slow(table)


def test_without_changes_and_with_siblings(docs, table):
    """Every row verifies; a verifier folds its proof to the root without the tree."""
    found = merkle.prove(merkle.build(docs, most=1), with_siblings=True).collect()
    assert len(found) == len(table) and all(r.verified and r.folded_root == r.root for r in found)
    assert all(digest(r.proof.decode()) == r.proof_sha256 and len(r.proof) % 64 == 0 for r in found)


def test_one_row_and_none(spark, docs):
    one = spark.createDataFrame([(5, "Text", "en", "s", 4, "x", "y", 1, 2)], SCHEMA)
    assert got(merkle.prove(merkle.build(one, changed()))) == slow([tuple(r) for r in one.collect()])
    assert merkle.prove(merkle.build(docs.limit(0), changed())).count() == 0


def test_midstates():
    """Resuming the state before a slot gives the digest of the run with the slot replaced."""
    parts = [digest(str(i)).encode() for i in range(16)]
    run = merkle.Run(b"".join(parts))
    assert run.digest.decode() == hashlib.sha256(b"".join(parts)).hexdigest()
    for slot in range(16):
        new = digest("new").encode()
        wanted = hashlib.sha256(b"".join([*parts[:slot], new, *parts[slot + 1 :]])).hexdigest()
        assert merkle.fold(new, [merkle.step(run, slot)]).decode() == wanted
