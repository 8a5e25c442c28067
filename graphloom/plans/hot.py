"""Equi-joins with keys that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that one task takes, at least, and keys above that limit that are broadcast, at most.
HOT_ROWS = 200_000
MOST_HOT = 50_000


def join_hot(many: DataFrame, one: DataFrame, keys: list[str], count: str = "n", how: str = "inner", hot: int = HOT_ROWS) -> DataFrame:
    """``many`` joined with ``one``, which has one row per key; ``count`` says how many rows of ``many`` have the key.

    A key with more than ``hot`` rows is dealt over as many parts as it takes: its rows by a hash of themselves, its row
    of ``one`` once to each part. The list of such keys is broadcast; ``hot`` grows with the table, so the list never has
    more than MOST_HOT rows. ``one`` is read up to three times and should be a written table. ``how`` is inner or left.
    """
    total, most = one.agg(F.sum(count), F.max(count)).first()
    hot = max(hot, (total or 0) // MOST_HOT)
    if (most or 0) <= hot:
        return many.join(one.drop(count), keys, how)
    parts = F.ceil(F.col(count) / hot).cast("int")
    listed = one.where(F.col(count) > hot).select(*keys, parts.alias("__parts"))
    part = F.pmod(F.xxhash64(*many.columns), F.coalesce("__parts", F.lit(1))).cast("int")
    dealt = many.join(F.broadcast(listed), keys, "left").withColumn("__part", part).drop("__parts")
    copies = one.withColumn("__part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop(count)
    return dealt.join(copies, [*keys, "__part"], how).drop("__part")
