"""Dense numbers in id order without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.plans.lineage import cut


def numbered(rows: DataFrame, *groups: str) -> DataFrame:
    """``rows`` with k: 0, 1, 2, … in ``id`` order, inside each group where ``groups`` are given.

    Ranges of (groups, id) are ranked apart and offset by the counts of the ranges before; only those counts, one row
    per range and group, pass through a window. A group that holds most rows is spread over many ranges.
    """
    spread = rows.repartitionByRange(*groups, "id").withColumn("__p", F.spark_partition_id())
    parts = cut(spread, "ranges")
    counts = parts.groupBy(*groups, "__p").agg(F.count("*").alias("__c"))
    before = F.sum("__c").over(W.partitionBy(*groups).orderBy("__p")) - F.col("__c")
    offsets = counts.select(*groups, "__p", before.alias("__o"))
    rank = F.row_number().over(W.partitionBy(*groups, "__p").orderBy("id")) - 1
    ranked = parts.withColumn("__r", rank)
    same = ranked["__p"] == offsets["__p"]
    for g in groups:
        same = same & ranked[g].eqNullSafe(offsets[g])
    joined = ranked.join(offsets, same)
    return joined.select(*(ranked[c] for c in rows.columns), (F.col("__r") + F.col("__o")).alias("k"))


def cumulated(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` with before: the sum of the column ``value`` over the rows of smaller ``id``.

    Ranges of id are summed apart; only their sums, a row each, pass through one window.
    """
    parts = cut(rows.repartitionByRange("id").withColumn("__p", F.spark_partition_id()), "ranges")
    sums = parts.groupBy("__p").agg(F.sum(value).alias("__s"))
    offsets = sums.select("__p", (F.sum("__s").over(W.orderBy("__p")) - F.col("__s")).alias("__o"))
    own = F.sum(value).over(W.partitionBy("__p").orderBy("id").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col(value)
    joined = parts.withColumn("__b", own).join(offsets, "__p")
    return joined.select(*rows.columns, (F.col("__b") + F.col("__o")).alias("before"))
