"""Mixing sources to target weights by subset-sum fitting over exact document lengths.

Documents are counted by (source, length). Per source, whole epochs are taken first; the remaining budget is fitted on
the length histogram: an even share of every length, then long lengths greedily down to ``RESERVE`` words, then a
bounded-knapsack dynamic programme over the rest. The number chosen per length is filled with documents in seeded
hash order. A source's histogram has at most as many rows as there are different lengths, however many documents it has.

Sources are rows of a table like any other: they are numbered in their order, and their targets are found by a few
aggregations over them, so there may be any number. Documents of a large source, or of a common length, are dealt over
several tasks where they meet their source's numbers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.tables import table
from graphloom.plans import cut, drop, join_hot, numbered

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = 20240607
#: Words left to the dynamic programme; its tables are bit sets of about this many bits.
RESERVE = 1 << 15


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) with sid, the place of the source by code point, null last, and its target.

    All sizes are shared by repeating weights; a source above ``cap`` times its size stops there and the excess is
    shared again by the others, until none is above. Every round stops one source at least, a few rounds stop most.
    """
    # a null sorts before all names, so it is numbered apart
    named = numbered(totals.where("source is not null").withColumnRenamed("source", "id")).withColumnRenamed("id", "source")
    last = totals.where("source is null").crossJoin(totals.agg((F.count("source")).alias("k")))
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("k") % len(weights)).cast("int"))
    rows = named.select("source", "source_size", "k").union(last.select("source", "source_size", "k"))
    rows = rows.select("source", "source_size", F.col("k").alias("sid"), weight.alias("w"), F.lit(None).cast("double").alias("target"))
    rows = cut(rows, "sources")
    free = F.col("target").isNull()
    while True:
        sums = rows.agg(
            F.sum("source_size"), F.sum(F.when(~free, F.col("source_size") * cap)), F.sum(F.when(free, F.col("w")))
        ).first()
        whole, rest = sums[2] or 0, (sums[0] or 0) - (sums[1] or 0)
        share = F.lit(float(rest)) * F.col("w") / F.lit(float(whole or 1))
        limit = (F.col("source_size") * cap).cast("double")
        over = free & (share > limit)
        if not rows.where(over).limit(1).count():
            return rows.withColumn("target", F.coalesce("target", share)).drop("w")
        following = cut(rows.withColumn("target", F.when(over, limit).otherwise(F.col("target"))), "sources")
        drop(rows)
        rows = following


def knapsack(lengths: list[int], counts: list[int], budget: int) -> dict[int, int]:
    """How many of each length to take so that their sum is the largest possible up to ``budget``."""
    reach, steps, mask = 1, [], (1 << (budget + 1)) - 1
    for length, count in zip(lengths, counts, strict=True):
        part = 1
        while count > 0 and not reach >> budget & 1:
            take = min(part, count)
            if length * take <= budget:
                steps.append((length, take, reach))
                reach |= (reach << length * take) & mask
            count, part = count - take, part * 2
    at, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, most: int = 1, reserve: int = RESERVE) -> np.ndarray:
    """How often to take documents of each length, in all at most ``most`` times their number.

    The total comes as near to ``budget`` from below as the steps above reach. Documents are repeated only where
    single takes leave a gap, as where the longest ones do not fit. Where a gap is left, less is shared out evenly, at
    last nothing, so a budget within ``reserve`` is met as well as any sum of takes can.
    """
    total = int((lengths * counts).sum())
    best = np.zeros(len(lengths), np.int64)
    if budget <= 0 or not total:
        return best
    for share in (min(budget, total), min(budget, total) // 2, 0):
        take = _filled(lengths, counts, budget, most, reserve, np.array([int(c) * share // total for c in counts], np.int64))
        if int((take * lengths).sum()) > int((best * lengths).sum()):
            best = take
        if int((best * lengths).sum()) == budget:
            break
    return best


def _filled(lengths: np.ndarray, counts: np.ndarray, budget: int, most: int, reserve: int, take: np.ndarray) -> np.ndarray:
    """``take`` filled up: longest first down to the reserve, then the best sum of the rest."""
    rest = budget - int((take * lengths).sum())
    order = [int(i) for i in np.argsort(-lengths, kind="stable") if lengths[i] > 0]
    for limit in (1, most):
        for i in order:
            more = min(int(limit * counts[i] - take[i]), max(0, rest - reserve) // int(lengths[i]))
            take[i] += more
            rest -= more * int(lengths[i])
    single = [max(0, int(counts[i] - take[i])) for i in order]
    again = [int(most * counts[i] - take[i]) - one for i, one in zip(order, single, strict=True)]
    chosen = knapsack([int(lengths[i]) for i in order] * 2, single + again, rest)
    return take + np.array([chosen.get(int(x), 0) for x in lengths], np.int64)


def _plan(group: pd.DataFrame) -> pd.DataFrame:
    total, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
    epochs = min(CAP, int(target // total)) if total else 0
    budget = round(target) - epochs * total
    lengths, counts = group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
    take = fit(lengths, counts, budget, CAP - epochs) if epochs < CAP else np.zeros(len(lengths), np.int64)
    return pd.DataFrame(
        {"sid": group["sid"], "size": lengths, "n": counts, "epochs": epochs + take // counts, "extra": take % counts}
    )


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Documents (doc_id, text, source, any more columns) to one row each with the words the mix takes of it.

    Columns: doc_id, source, size, source_size, target (of its source), epochs (takes of all of its length), taken. A null text has no
    words and is never taken; a null source is a source of its own, the last; equal documents are told apart by nothing,
    so any of them may be the one taken; an empty table gives no rows. Reruns choose the same documents.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sized = cut(docs.select("doc_id", "source", words.alias("size")), "sizes")
    totals = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), "totals")
    found = source_targets(totals.select("source", "source_size"))
    found = found.join(totals.select(F.col("source").alias("s"), "docs"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # a null is a key like any other, which an equi-join would not match
    keys = [F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("none")]
    found = cut(found.select(*keys, "sid", "source_size", "target", "docs"), "targets")
    named = join_hot(sized.select("doc_id", *keys, "size"), found, ["name", "none"], count="docs")
    histogram = named.groupBy("sid", "size", "source_size", "target").agg(F.count("*").alias("n"))
    plan = histogram.groupBy("sid").applyInPandas(_plan, "sid long, size long, n long, epochs long, extra long")
    plan = cut(plan.withColumn("slots", F.ceil(F.sqrt("n"))), "plan")
    slot = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("slots"))
    ready = cut(join_hot(named, plan, ["sid", "size"]).withColumn("slot", slot), "slots")
    open_ = ready.where("extra > 0")
    before = W.partitionBy("sid", "size").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    slots = open_.groupBy("sid", "size", "slot").agg(F.count("*").alias("m"))
    slots = slots.withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0))).select(
        "sid", "size", "slot", "before"
    )
    inside = W.partitionBy("sid", "size", "slot").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id")
    ranked = open_.withColumn("r", F.row_number().over(inside)).join(slots, ["sid", "size", "slot"])
    ranked = ranked.withColumn("more", (F.col("before") + F.col("r") <= F.col("extra")).cast("long"))
    rest = ready.where("extra = 0").withColumn("more", F.lit(0).cast("long"))
    columns = ["doc_id", "name", "none", "size", "source_size", "target", "epochs", "more"]
    out = ranked.select(*columns).union(rest.select(*columns))
    return out.select(
        "doc_id",
        F.when(~F.col("none"), F.col("name")).alias("source"),
        "size",
        "source_size",
        "target",
        "epochs",
        (F.col("size") * (F.col("epochs") + F.col("more"))).alias("taken"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
