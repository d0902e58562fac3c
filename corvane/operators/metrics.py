"""Grouped success, paired comparison and order statistics."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.ranking import draw, midrank, ordinal, rank_within
from corvane.functions.storage import materialize


def group_success(results: DataFrame, ok: str, groups: list[str]) -> DataFrame:
    """n, ok and rate for every group column alone, all of them together, and overall."""
    sets = [groups, *[[g] for g in groups], []]
    return results.groupingSets([[F.col(c) for c in s] for s in sets], *groups).agg(
        F.count("*").alias("n"), F.sum(F.col(ok).cast("long")).alias("ok"),
        F.round(F.sum(F.col(ok).cast("double")) / F.greatest(F.count("*"), F.lit(1)), 6).alias("success_rate"),
    )


def fail_histogram(results: DataFrame, success: str, reason: str) -> DataFrame:
    """Failures for every reason that occurs, the success reason with zero too."""
    return results.groupBy(reason).agg(F.sum((~F.col(success)).cast("long")).alias("failures"), F.count("*").alias("n"))


def failures_only(results: DataFrame, success: str, reason: str) -> DataFrame:
    """Failures for the reasons that failures have, no others."""
    return results.where(~F.col(success)).groupBy(reason).agg(F.count("*").alias("failures"))


def error_counts(failures: DataFrame, kind: str, scenario: str) -> DataFrame:
    """How many failures each kind has, in every scenario and over all (null), with its place from the most frequent down."""
    counts = failures.where(F.col(kind).isNotNull()).groupingSets([[F.col(scenario), F.col(kind)], [F.col(kind)]], scenario, kind)
    counts = counts.agg(F.count("*").alias("n"), F.grouping(scenario).alias("_all"))
    place = F.row_number().over(Window.partitionBy("_all", scenario).orderBy(F.desc("n"), kind))  # one row for each kind
    return counts.select(scenario, kind, "n", place.alias("place"))


def success_report(results: DataFrame, success: str, wellformed: str) -> DataFrame:
    """n, and the shares of successes and of well-formed outputs; 0 for an empty table."""
    n = F.greatest(F.count("*"), F.lit(1))
    rate = lambda c: F.round(F.count_if(c) / n, 6)
    return results.agg(F.count("*").alias("n"), rate(success).alias("exec_success_rate"), rate(wellformed).alias("xml_wellformed_rate"))


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Interpolated quantiles from the rows of two ranks each; nothing is held in one task."""
    df = df.select(F.col(value).cast("double").alias("_v")).where("_v is not null")
    ranked = materialize(ordinal(df, ["_v"], "_rank"), "ranked")
    n = ranked.count()
    if not n:
        return [None] * len(shares)
    places = [(n - 1) * q for q in shares]
    wanted = sorted({int(at) + k for at in places for k in (0, 1)})
    held = {r["_rank"]: r["_v"] for r in ranked.where(F.col("_rank").isin(wanted)).collect()}  # two rows for each share
    low = [held[int(at)] for at in places]
    return [a + (at - int(at)) * (held.get(int(at) + 1, a) - a) for a, at in zip(low, places, strict=True)]


def contingency(pairs: DataFrame, a: str, b: str, scenario: str) -> DataFrame:
    """Both, A only, B only and neither, by scenario and overall (null)."""
    cell = lambda x, y: F.count_if((F.col(a) == x) & (F.col(b) == y))
    return pairs.rollup(scenario).agg(
        F.count("*").alias("n"), cell(True, True).alias("both"), cell(True, False).alias("a_only"),
        cell(False, True).alias("b_only"), cell(False, False).alias("neither"),
    )


def mcnemar(a_only: Column, b_only: Column) -> Column:
    """Exact two-sided p: 1 without discordant pairs, at most 1. Log space, so large counts don't overflow."""
    n, k = a_only + b_only, F.least(a_only, b_only)
    one = F.lit(1.0)
    start = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.lit(0.0).alias("sum"))

    def add(acc, i):
        return F.struct((acc["term"] + F.log((n - i).cast("double")) - F.log((i + 1).cast("double"))).alias("term"), (acc["sum"] + F.exp(acc["term"])).alias("sum"))

    # the term after the last is never added, but its logarithm must exist
    total = F.aggregate(F.sequence(F.lit(0).cast("long"), k), start, lambda acc, i: F.when(i < n, add(acc, i)).otherwise(F.struct(acc["term"].alias("term"), (acc["sum"] + F.exp(acc["term"])).alias("sum"))))["sum"]
    return F.when(n == 0, one).otherwise(F.least(one, 2 * total))


def alignment_violations(a: DataFrame, b: DataFrame, key: str, same: list[str] = ()) -> DataFrame:
    """How many keys are on one side only, and how many differ in columns that must be the same."""
    x = a.select(F.col(key).alias("_a"), *[F.col(c).alias(f"_a_{c}") for c in same])
    y = b.select(F.col(key).alias("_b"), *[F.col(c).alias(f"_b_{c}") for c in same])
    both = x.join(y, F.col("_a") == F.col("_b"), "full_outer")
    differ = F.lit(False)
    for c in same:
        differ = differ | ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
    return both.agg(
        F.count_if(F.col("_b").isNull()).alias("left_only"), F.count_if(F.col("_a").isNull()).alias("right_only"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull() & differ).alias("different"),
    )


def crosstab(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) for every value of a with every value of b, zeros too: the values that occur, few of each."""
    counts = rows.groupBy(a, b).agg(F.count("*").alias("_n")).select(F.col(a).alias("_a"), F.col(b).alias("_b"), "_n")
    cells = rows.select(a).distinct().crossJoin(rows.select(b).distinct())  # the result's own cells
    both = cells.join(counts, F.col(a).eqNullSafe(F.col("_a")) & F.col(b).eqNullSafe(F.col("_b")), "left")
    return both.select(a, b, F.coalesce("_n", F.lit(0)).cast("long").alias("n"))


def rank_correlation(df: DataFrame, a: str, b: str, tie: str) -> DataFrame:
    """One row: the correlation of the midranks of two columns, ties by the tie column."""
    ranked = midrank(midrank(df, a, tie, "_ra"), b, tie, "_rb")
    return ranked.agg(F.round(F.corr("_ra", "_rb"), 6).alias("rank_correlation"))


def composition(df: DataFrame, distinct: str, **conditions: Column) -> DataFrame:
    """One row: how many rows there are, how many of each condition, and how many different values of a column."""
    counts = [F.count_if(c).alias(name) for name, c in conditions.items()]
    return df.agg(F.count("*").alias("n"), *counts, F.countDistinct(distinct).alias(f"{distinct}s"))


def order_statistics(df: DataFrame, group: str, value: str, tie: str) -> DataFrame:
    """Mean, and the elements at floor(n q) of the sorted values for q = .5 and .9; not interpolated."""
    r = rank_within(df, group, [value, tie], "_r", "_n")
    at = lambda q: F.max(F.when(F.col("_r") == F.floor(F.col("_n") * q), F.col(value)))
    return r.groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), at(F.lit(0.5)).alias("median"), at(F.lit(0.9)).alias("p90"))


#: More different values than that are no outcomes of trials.
MOST_VALUES = 64
#: Up to this deviation a binomial quantile comes from summed probabilities, beyond it from an expansion.
EXACT_DEVIATION = 1000.0


def _log_factorials(x: np.ndarray) -> np.ndarray:
    """ln x! by Stirling's series, from a product where x is small."""
    y = x + 16.0
    series = (y + 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - np.log(np.stack([x + k for k in range(1, 17)])).sum(0)


def binomial_quantile(n: int, p: float, u: np.ndarray) -> np.ndarray:
    """For each u the least k of which at least a share u of binomial(n, p) lies at or below k.

    Summed probabilities within 40 deviations of the mean; where the deviation passes
    EXACT_DEVIATION, Cornish and Fisher's expansion, which is then off by one at most.
    """
    if n <= 0 or p <= 0:
        return np.zeros(len(u), np.int64)
    if p >= 1:
        return np.full(len(u), n, np.int64)
    mean, deviation = n * p, math.sqrt(n * p * (1 - p))
    if deviation > EXACT_DEVIATION:
        z = np.array([NormalDist().inv_cdf(min(max(x, 1e-300), 1 - 1e-16)) for x in u])
        skew, excess = (1 - 2 * p) / deviation, (1 - 6 * p * (1 - p)) / deviation**2
        w = z + (z**2 - 1) * skew / 6 + (z**3 - 3 * z) * excess / 24 - (2 * z**3 - 5 * z) * skew**2 / 36
        return np.clip(np.ceil(mean + deviation * w - 0.5), 0, n).astype(np.int64)
    k = np.arange(max(0, int(mean - 40 * deviation - 40)), min(n, int(mean + 40 * deviation + 40)) + 1, dtype=np.float64)
    log = _log_factorials(np.array([float(n)]))[0] - _log_factorials(k) - _log_factorials(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    below = np.cumsum(np.exp(log))
    return (k[0] + np.minimum(np.searchsorted(below, u), len(k) - 1)).astype(np.int64)


def multinomial_means(values: list[float], counts: list[int], u: np.ndarray) -> np.ndarray:
    """The mean of as many draws with replacement as there are rows, for each row of u: u has a
    column for each value but the last, which the binomials of one value after the other take."""
    left = np.full(len(u), sum(counts), np.int64)
    rest, total = sum(counts), np.zeros(len(u))
    for v, (value, count) in enumerate(zip(values[:-1], counts[:-1], strict=True)):
        taken = np.zeros(len(u), np.int64)
        for n in np.unique(left):
            at = left == n
            taken[at] = binomial_quantile(int(n), count / rest, u[at, v])
        total += value * taken
        left, rest = left - taken, rest - count
    return (total + values[-1] * left) / max(1, sum(counts))


def bootstrap_ci(pairs: DataFrame, a: str, b: str, rounds: int, seed: str) -> DataFrame:
    """Mean difference and the 2.5 and 97.5 percentiles of it over resamples of the rows.

    A resample matters only by how often it has each difference, and those counts are one
    multinomial draw: the rows are counted once, and a round costs a number for each difference
    and not one for each row. Its draws are hashes of seed, round and difference, so rounds are
    dealt over tasks and reruns agree. Without rows all figures are null.
    """
    spark = pairs.sparkSession
    difference = (F.col(a).cast("double") - F.col(b).cast("double")).alias("_d")
    found = pairs.select(difference).where("_d is not null").groupBy("_d").agg(F.count("*").alias("n")).orderBy("_d").limit(MOST_VALUES + 1).collect()
    if len(found) > MOST_VALUES:
        raise ValueError(f"more than {MOST_VALUES} different differences")
    values, counts = [r._d for r in found], [r.n for r in found]
    n = sum(counts)
    u = [draw(seed, "id", F.lit(str(v))) for v in range(max(0, len(values) - 1))]

    @F.arrow_udf("double")
    def means(draws: pa.Array) -> pa.Array:
        if not n:
            return pa.nulls(len(draws), pa.float64())
        u = np.array(draws.to_pylist(), np.float64).reshape(len(draws), -1)
        return pa.array(multinomial_means(values, counts, u))

    drawn = spark.range(rounds).select(means(F.array(*u).cast("array<double>")).alias("m"))
    # some number for each round
    ci = drawn.agg(F.round(F.expr("percentile(m, 0.025)"), 6).alias("low"), F.round(F.expr("percentile(m, 0.975)"), 6).alias("high"), F.count("*").alias("rounds"))
    mean = sum(v * c for v, c in zip(values, counts, strict=True)) / n if n else None
    return ci.withColumn("difference", F.round(F.lit(mean).cast("double"), 6))
