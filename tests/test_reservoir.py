"""The sample of an edge stream against the same over all edges, for several cuts into batches and after a restart."""

import hashlib
import random

import pytest

from graphloom.streaming.reservoir import sample_stream, sampled

SIZE = 12


def hashed(node, seed=42):
    return int(hashlib.md5(f"{node}:{seed}".encode()).hexdigest()[:13], 16)


@pytest.fixture(scope="module")
def edges():
    r = random.Random(3)
    names = [f"n{i}" for i in range(60)]
    out = [(r.choice(names), r.choice(names)) for _ in range(400)]
    return [*out, ("n1", "n1"), (None, "n2"), out[0], out[0][::-1]]


def wanted(edges):
    known = [e for e in edges if None not in e]
    best = sorted({x for e in known for x in e}, key=lambda x: (hashed(x), x))[:SIZE]
    inside = {tuple(sorted(e)) for e in known if e[0] != e[1] and set(e) <= set(best)}
    return set(best), inside


def run(spark, folder, batches, name):
    """A query over one file a batch; a new start for each file resumes from the checkpoint."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "src string, dst string").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("src string, dst string").parquet(f"{folder}/in")
        found = sample_stream(stream, SIZE, shards=3)
        query = found.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("append").parquet(f"{folder}/out")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    nodes, inside = sampled(spark.read.parquet(f"{folder}/out"), SIZE)
    return {r.id for r in nodes.collect()}, {(r.src, r.dst) for r in inside.collect()}


@pytest.mark.parametrize("parts", [1, 3])
def test_any_cut_into_batches(spark, tmp_path, edges, parts):
    """Nodes are evicted and edges kept alike whatever the batches; every batch after the first is a restart."""
    shuffled = edges if parts == 1 else random.Random(parts).sample(edges, len(edges))
    step = -(-len(edges) // parts)
    batches = [shuffled[i : i + step] for i in range(0, len(edges), step)]
    assert run(spark, f"file://{tmp_path}", batches, f"r{parts}") == wanted(edges)
