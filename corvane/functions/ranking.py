"""Ranks over a whole table without a single-task window."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.storage import materialize


def ordinal(df: DataFrame, order: list[str], out: str = "rank0") -> DataFrame:
    """df with out: 0, 1, ... in the given ascending order.

    Rows are dealt by range and sorted in their partitions; the position in a partition plus the
    sizes of those before it is the rank. The only window runs over one row for each partition.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = materialize(dealt, "ordinal")
    part = F.shiftright("_at", 33)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_start"))
    ranked = dealt.withColumn("_part", part).join(F.broadcast(starts), "_part")  # one row for each partition
    return ranked.withColumn(out, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_start")


def rank_within(df: DataFrame, group: str, order: list[str], out: str = "rank0", size: str = "group_size") -> DataFrame:
    """df with out: 0, 1, ... in each group, and the group's size; a large group spreads over many tasks.

    The rank over (group, order) less the group's first rank; groups meet their rows in a plain
    equi-join, which adaptive execution can split.
    """
    ranked = ordinal(df, [group, *order], "_rank")
    starts = ranked.groupBy(F.col(group).alias("_group")).agg(F.min("_rank").alias("_first"), F.count("*").alias(size))
    both = ranked.join(starts, F.col(group).eqNullSafe(F.col("_group")))
    return both.withColumn(out, F.col("_rank") - F.col("_first")).drop("_rank", "_group", "_first")


def midrank(df: DataFrame, value: str, tie: str, out: str = "midrank") -> DataFrame:
    """Ordinal percentile (rank + 0.5) / n; ties go by the tie column, they are not averaged."""
    n = df.count()
    return ordinal(df, [value, tie], "_rank0").withColumn(out, (F.col("_rank0") + 0.5) / F.lit(float(max(n, 1)))).drop("_rank0")


def buckets(df: DataFrame, value: str, tie: str, k: int, out: str = "bucket") -> DataFrame:
    """Quantile buckets 0 .. k-1; the first n mod k of them hold one row more."""
    n = df.count()
    size, more = divmod(n, k)
    r = F.col("_rank0")
    edge = more * (size + 1)
    no = F.when(r < edge, F.floor(r / (size + 1))).otherwise(more + F.floor((r - edge) / max(size, 1)))
    return ordinal(df, [value, tie], "_rank0").withColumn(out, no.cast("int")).drop("_rank0")


def draw(seed: str, *keys: Column | str) -> Column:
    """A number in [0, 1) by md5 of seed and keys, the same in every engine."""
    text = F.concat_ws(":", F.lit(seed), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def mixed_seed(seed: int, *names: str) -> int:
    """A seed of its own for each name (a domain and tier, say): the CRC of "a/b" mod 997 beside the seed."""
    return seed * 1000 + zlib.crc32("/".join(names).encode()) % 997
