"""The pipeline against a brute-force version of all its stages."""

from collections import Counter

import corpus_pipeline
from graphloom.llm import decontam
from tests.llm.data import SCHEMA, rows
from tests.llm.test_operators import slow_components, slow_fingerprint, slow_quality, slow_spans, slow_targets, split

LEAK = " ".join(f"leak{i}" for i in range(40))


def tables(spark, folder, table):
    spark.createDataFrame(table, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    bench = spark.createDataFrame([(1, LEAK), (2, None)], "item_id long, text string")
    bench.write.parquet(f"{folder}/benchmark.parquet")


def common(a, b):
    """Length of the longest common subsequence."""
    before = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(before[j] + 1 if x == y else max(before[j + 1], now[-1]))
        before = now
    return before[-1]


def slow_redacted(text):
    if text is None:
        return None
    out, at = "", 0
    for start, _, end, _ in slow_spans(text)[1]:
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def slow_pipeline(table):
    """(doc_id, source, size) of what is mixed."""
    good = [t for t in table if slow_quality(t[1])[-1]]
    prints = [(i, slow_fingerprint(t[1])) for i, t in enumerate(good)]
    groups = {}
    for (i, component), t in zip(slow_components(prints), good, strict=True):
        groups.setdefault(component, []).append((t[0] is None, t[0] or 0, i))
    kept = [good[min(g)[2]] for g in groups.values()]
    leak = LEAK.split()
    clean = [t for t in kept if common([w.decode() for w in decontam.tokens(t[1])], leak) < 0.6 * len(leak)]
    return [(t[0], t[3], len(split(slow_redacted(t[1])))) for t in clean]


def test_pipeline(spark, tmp_path):
    table = rows(11, 80)
    more = lambda i, text, source="s0": (i, text, "en", source, len(text), "x", "y", 1, 2)
    filler = " ".join(f"w{i}" for i in range(60))
    table += [
        more(900, "key words " * 3 + filler + " password=abcdef123456"),
        more(901, " ".join(f"q{i}" for i in range(60)) + " " + LEAK, "s1"),
        more(None, " ".join(f"n{i}" for i in range(70)), None),
        more(None, " ".join(f"m{i}" for i in range(70)) + " " + LEAK.upper()),
        more(902, " ".join(f"r{i}" for i in range(80)), "s9"),
        more(902, " ".join(f"t{i}" for i in range(50)), "s9"),
        more(902, " ".join(f"t{i}" for i in range(50)), "s9"),
    ]
    folder = str(tmp_path / "sf")
    tables(spark, folder, table)
    found = corpus_pipeline.run(spark, folder).collect()
    wanted = slow_pipeline(table)
    assert sorted(((r.doc_id, r.source, r.size) for r in found), key=str) == sorted(wanted, key=str)
    assert {900, 902, None} <= {r.doc_id for r in found} and 901 not in {r.doc_id for r in found}
    sizes, taken = Counter(), Counter()
    for _, source, size in wanted:
        sizes[source] += size
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(names, slow_targets([sizes[s] for s in names]), strict=True))
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == targets[r.source]
        assert r.taken % r.size == 0 and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in names:
        least = min(size for _, source, size in wanted if source == s)
        assert abs(taken[s] - targets[s]) <= least + 1, s


def test_stages_keep_the_columns(spark, tmp_path):
    folder = str(tmp_path / "sf")
    tables(spark, folder, rows(3, 30))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "simhash", "decontam", "secrets", "mixing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_empty_pipeline(spark, tmp_path):
    folder = str(tmp_path / "sf")
    tables(spark, folder, [])
    assert corpus_pipeline.run(spark, folder).count() == 0
