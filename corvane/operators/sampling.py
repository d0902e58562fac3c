"""Reproducible samples: every draw is a hash of seed and key, so partitions and reruns don't matter."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.ranking import draw, ordinal, rank_within
from corvane.functions.storage import materialize


def stratified(df: DataFrame, stratum: str, key: str, fraction: float, seed: str) -> DataFrame:
    """From each stratum greatest(1, round half even (n * fraction)) rows in hashed order; none if fraction is 0."""
    if fraction <= 0:
        return df.limit(0)
    ranked = rank_within(df.withColumn("_u", draw(seed, key)), stratum, ["_u", key], "_r", "_n")
    size = F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(float(fraction)), 0))
    return ranked.where(F.col("_r") < size).drop("_u", "_r", "_n")


def first_per_group(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_r") <= n).drop("_r")


def round_robin(df: DataFrame, key: str, order: str, pool: list[str], out: str) -> DataFrame:
    """The rows of each key take the names of the pool in turn."""
    ranked = rank_within(df, key, [order], "_r", "_n")
    return ranked.withColumn(out, F.element_at(F.array(*[F.lit(x) for x in pool]), (F.col("_r") % len(pool) + 1).cast("int"))).drop("_r", "_n")


def running_weights(df: DataFrame, order: str, weight: str) -> DataFrame:
    """df with lo and hi, the row's interval of the running sum of weights; sums by range of the order."""
    dealt = materialize(ordinal(df, [order], "_i").withColumn("_block", F.expr("_i div 8192")), "weights")
    sums = dealt.groupBy("_block").agg(F.sum(weight).alias("_w"))
    before = F.coalesce(F.sum("_w").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("double"))
    own = F.sum(weight).over(Window.partitionBy("_block").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    out = dealt.withColumn("_own", own).join(sums.select("_block", before.alias("_before")), "_block")
    return out.withColumn("hi", F.col("_before") + F.col("_own")).withColumn("lo", F.col("hi") - F.col(weight)).drop("_i", "_block", "_own", "_before")


def running_columns(df: DataFrame, order: str, weights: list[str]) -> DataFrame:
    """df with lo_<w> and hi_<w> for several columns of weights, from one sort by range."""
    dealt = materialize(ordinal(df, [order], "_i").withColumn("_block", F.expr("_i div 8192")), "weights")
    sums = dealt.groupBy("_block").agg(*[F.sum(w).alias(f"_{w}") for w in weights])
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_block", *[F.coalesce(F.sum(f"_{w}").over(earlier), F.lit(0).cast("double")).alias(f"_{w}") for w in weights])
    own = Window.partitionBy("_block").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.select("*", *[F.sum(w).over(own).alias(f"hi_{w}") for w in weights]).join(before, "_block")
    out = out.withColumns({f"hi_{w}": F.col(f"_{w}") + F.col(f"hi_{w}") for w in weights})
    return out.withColumns({f"lo_{w}": F.col(f"hi_{w}") - F.col(w) for w in weights}).drop("_i", "_block", *[f"_{w}" for w in weights])


def weighted_draws(df: DataFrame, order: str, weight: str, n: int, seed: str, cells: int = 1024) -> DataFrame:
    """(draw, order) of n draws with replacement, each row in proportion to its weight.

    The interval join of draws and running weights goes by cells: an interval is listed under the
    cells that it touches, a draw under its own, so that it is an equi-join with a test.
    """
    line = running_weights(df.where(F.col(weight) > 0), order, weight)
    total = line.agg(F.max("hi")).first()[0] or 0.0
    width = max(total / cells, 1e-300)
    spread = line.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width)))).select(order, "lo", "hi", "_cell")
    u = df.sparkSession.range(n if total else 0).select(F.col("id").alias("draw"), (draw(seed, "id") * total).alias("u"))
    hit = u.withColumn("_cell", F.floor(F.col("u") / width)).join(spread, "_cell").where("lo <= u and u < hi")
    return hit.select("draw", order)


def window_ends(n: int, alpha: float, batch: int) -> tuple[Column, Column]:
    """Of draw `k`: the number of rows that its window holds, and of draws that share that window before it.

    The window of step t holds the first ceil(n * min(1, (t + 1) / reach)) rows, reach being
    ceil(alpha * steps), and as many more as the step needs.
    """
    steps = -(-n // batch)
    reach = max(1, math.ceil(alpha * steps))
    t = F.expr(f"k div {batch}")
    share = F.least(F.lit(1.0), (t + 1) / F.lit(float(reach)))
    grown = F.greatest(F.lit(1), F.ceil(share * float(n)))
    return F.greatest(grown, F.least(F.lit(n), (t + 1) * batch)).cast("long"), (F.col("k") % batch)


def expanding_window(df: DataFrame, order: str, alpha: float, batch: int, seed: str) -> DataFrame:
    """(order, position): a permutation drawn batch by batch, uniformly, from a window that grows over the order.

    It is the shuffle in which draw k swaps slot k with a slot j of those from k to the end of its
    window, so that the slots behind k hold just what has entered and not been drawn. Each j is a hash
    of seed and k, so all are known at once, and what a slot holds when it is drawn follows from
    pointers to earlier draws: slot j got its content from the last draw that chose j before, and that
    draw's own slot in the same way. Chains of pointers are shortened by doubling, some log log n
    equi-joins of pairs of numbers; no task sees more than its share of rows. order must be unique.
    """
    n = df.count()
    rows = ordinal(df.select(order), [order], "_rank")
    if not n:
        return rows.select(order, F.col("_rank").alias("position"))
    end, _ = window_ends(n, alpha, batch)
    k = F.col("k")
    drawn = df.sparkSession.range(n).withColumnRenamed("id", "k")
    drawn = drawn.withColumn("j", k + F.floor(draw(seed, "k") * (end - k)))
    # the last draw before that chose the same slot; a draw that chooses its own slot changes nothing
    drawn = materialize(drawn.withColumn("last", F.lag("k").over(Window.partitionBy("j").orderBy("k"))), "swaps")
    held = drawn.where("j > k").groupBy(F.col("j").alias("slot")).agg(F.max("k").alias("of"))  # what slot k held before draw k came from draw `of`
    held = materialize(held, "swap-pointers")
    while True:
        further = held.join(held.select(F.col("slot").alias("of"), F.col("of").alias("_of")), "of", "left")
        held = materialize(further.select("slot", F.coalesce("_of", "of").alias("of"), F.col("_of").isNotNull().alias("moved")), "swap-pointers")
        if held.where("moved").isEmpty():
            break
        held = held.select("slot", "of")
    held = held.select(F.col("slot").alias("last"), "of")
    placed = drawn.join(held, "last", "left").select(F.col("k").alias("position"), F.coalesce("of", "last", "j").alias("_rank"))
    return rows.join(placed, "_rank").select(order, "position")


def shuffled(df: DataFrame, column: str, key: str, seed: str) -> DataFrame:
    """df with the values of a column dealt anew over its rows, by a hash of seed and key: each value stays as frequent."""
    rows = materialize(df.withColumn("_u", draw(seed, key)), "to-shuffle")
    to = ordinal(rows.select("_u", F.col(key).alias("_key")), ["_u", "_key"], "_rank").select("_rank", "_key")
    values = ordinal(rows.select(F.col(column).alias("_value"), F.col(key).alias("_from")), ["_from"], "_rank").select("_rank", "_value")
    dealt = to.join(values, "_rank").select("_key", "_value")
    return rows.join(dealt, F.col(key) == F.col("_key")).withColumn(column, F.col("_value")).drop("_u", "_key", "_value")


def replace_selected(df: DataFrame, selected: DataFrame, key: str, column: str) -> DataFrame:
    """Rows with a replacement take it, the others stay."""
    new = selected.select(F.col(key).alias("_key"), F.col(column).alias("_new"))
    return df.join(new, F.col(key) == F.col("_key"), "left").withColumn(column, F.coalesce("_new", column)).drop("_key", "_new")


def first_of_equal(df: DataFrame, scope: list[str], text: str, order: str) -> DataFrame:
    """The first row of each text in its scope, by the text's hash; partial minima, no window."""
    key = F.sha2(F.col(text), 256).alias("text_key")
    return df.groupBy(*scope, key).agg(F.min(order).alias(order), F.count("*").alias("n"))
