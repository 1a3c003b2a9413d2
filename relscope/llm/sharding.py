"""Sharding by weighted rendezvous hashing, in DataFrame expressions only.

A record's key and a shard's name make a uniform number u; the shard with the largest weight / -ln(u) takes the
record. Another shard can only win records for itself, and a larger weight wins a proportional share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT_BUCKETS = 1024


def scores(key: Column, weights: Sequence[float]) -> Column:
    """For each shard a struct of the key's score there and minus its index. A null key acts as ''."""
    name = F.coalesce(key.cast("string"), F.lit(""))
    found = []
    for shard, weight in enumerate(weights):
        digits = F.conv(F.substring(F.md5(F.concat(name, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("double")
        found.append(F.struct((F.lit(float(weight)) / -F.log((digits + 0.5) / F.lit(float(1 << 52)))).alias("score"), F.lit(-shard).alias("minus")))
    return F.array(*found)


def rendezvous(scored: Column) -> Column:
    """Index of the shard with the largest score; equal scores go to the smaller index."""
    return (-F.array_max(scored)["minus"]).cast("int")


def number_within(df: DataFrame, group: str, order: Sequence[str], slot: str, buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Number each group's rows 0, 1, ... without sorting a group in one task.

    Rows of a group go to hash buckets; each bucket is sorted alone, and starts where the smaller buckets of its group
    end. The table of starts has at most groups x buckets rows. Order within a bucket: the order columns, which
    should make rows distinct (equal rows are numbered in any order).
    """
    b, n, base = "__bucket", "__n", "__base"
    rows = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = rows.groupBy(group, b).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("__group"), F.col(b).alias("__b"), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base))
    inside = Window.partitionBy(group, b).orderBy(*order)
    numbered = rows.withColumn(n, F.row_number().over(inside))
    joined = numbered.join(F.broadcast(starts), F.col(group).eqNullSafe(F.col("__group")) & (F.col(b) == F.col("__b")))
    return joined.withColumn(slot, F.col(base) + F.col(n) - 1).drop(b, n, base, "__group", "__b")


def shard(df: DataFrame, key: str, weights: Sequence[float], grown_weight: float | None = None) -> DataFrame:
    """Add shard (int), slot (its rows numbered from 0, in no order that matters) and, with grown_weight, grown_shard:
    the shard if one more of that weight came last.

    Null keys share a shard. Repeated keys share a shard and get slots of their own. Columns of the same names as
    the new ones are replaced. An empty table gives an empty result.
    """
    if grown_weight is None:
        return number_within(df.withColumn("shard", rendezvous(scores(F.col(key), weights))), "shard", [key], "slot")
    every = scores(F.col(key), [*weights, grown_weight])  # computed once: a common subexpression
    out = df.withColumns({"shard": rendezvous(F.slice(every, 1, len(weights))), "grown_shard": rendezvous(every)})
    return number_within(out, "shard", [key], "slot")
