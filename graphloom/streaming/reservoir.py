"""A bounded sample of the nodes of an edge stream, with the edges inside it, kept by Structured Streaming.

The sample is the ``size`` nodes of the smallest hashes seen so far, so it does not depend on the order of the edges or
on how the stream is cut into batches. Shards of nodes keep their own smallest hashes as state; of all shards together,
the smallest ``size`` are the sample. An edge is inside exactly when its end of the larger hash is, so it is kept with
that end alone and goes when that end is evicted: no shard looks at another, and no edge has to be found again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from graphloom.plans.draws import drawn

SHARDS = 32
OUT = "shard int, version long, h long, id string, near array<string>"
STATE = "version long, h array<long>, id array<string>, near array<array<string>>"


def _kept(size: int):
    def keep(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, hashes, ids, near = state.get if state.exists else (0, [], [], [])
        held = {i: (h, set(n)) for h, i, n in zip(hashes, ids, near, strict=True)}
        for part in parts:
            for h, i, other in zip(part["h"], part["id"], part["other"], strict=True):
                if i not in held:
                    held[i] = (int(h), set())
                if other is not None:
                    held[i][1].add(other)
            if len(held) > 2 * size:
                held = dict(sorted(held.items(), key=lambda x: (x[1][0], x[0]))[:size])
        best = sorted((h, i, sorted(n)) for i, (h, n) in held.items())[:size]
        hashes, ids, near = [b[0] for b in best], [b[1] for b in best], [b[2] for b in best]
        state.update((version + 1, hashes, ids, near))
        yield pd.DataFrame({"shard": key[0], "version": version + 1, "h": hashes, "id": ids, "near": near})

    return keep


def sample_stream(edges: DataFrame, size: int, seed: int = 42, shards: int = SHARDS) -> DataFrame:
    """(shard, version, h, id, near) in update mode from a stream of (src, dst): a shard's whole sample when it changes.

    ``near`` are the neighbours of smaller hash; ``sampled`` makes the sample of all shards of them. Repeated edges and
    loops add nothing but their nodes, null ends are ignored, and late edges count like any other: nothing is dropped by
    time. A shard's state has at most ``size`` nodes, and their edges to nodes of smaller hash.
    """
    ends = edges.where("src is not null and dst is not null").select("src", "dst", drawn("src", seed=seed).alias("hs"), drawn("dst", seed=seed).alias("hd"))
    larger = F.struct("hs", "src") > F.struct("hd", "dst")
    pair = lambda at, h, other: F.struct(F.col(at).alias("id"), F.col(h).alias("h"), other.alias("other"))
    none = F.lit(None).cast("string")
    loop = F.col("src") == F.col("dst")
    both = F.array(
        pair("src", "hs", F.when(larger & ~loop, F.col("dst")).otherwise(none)), pair("dst", "hd", F.when(~larger & ~loop, F.col("src")).otherwise(none))
    )
    rows = ends.select(F.explode(both).alias("e")).select("e.*").withColumn("shard", (F.col("h") % shards).cast("int"))
    grouped = rows.groupBy("shard")
    return grouped.applyInPandasWithState(_kept(size), OUT, STATE, "update", "NoTimeout")


def sampled(states: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(id) of the ``size`` nodes of the smallest hashes, and (src, dst) of the edges inside, from all rows so far."""
    last = states.groupBy("shard").agg(F.max("version").alias("version"))
    rows = states.join(last, ["shard", "version"])
    best = rows.orderBy("h", "id").limit(size)
    edges = best.select("id", F.explode("near").alias("other"))
    return best.select("id"), edges.select(F.least("id", "other").alias("src"), F.greatest("id", "other").alias("dst")).distinct()
