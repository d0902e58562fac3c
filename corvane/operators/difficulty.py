"""Composite scores: difficulty of opening tags, of a tree's structure, and utility from two views."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.ranking import midrank
from corvane.functions.storage import arrow_batches, materialize
from corvane.operators import scoring

BATCH = 256  # records that a Python worker holds at a time


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def sums_before(lengths: pa.Array) -> pa.Array:
    """For each element of a row's array the sum of those before it; a fold in SQL copies what it has at every step."""
    ends = np.concatenate([[0], np.cumsum(lengths.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)])
    at = np.concatenate([[0], np.cumsum(lengths.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    own = ends[:-1] - np.repeat(ends[at[:-1]], np.diff(at))
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(own, pa.int32()))


def opening_spans(records: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, begin, end) of every opening tag, in characters, end exclusive."""
    pattern = r"<[^/!?>][^>]*>"
    tags = F.regexp_extract_all(F.col(xml), F.lit(pattern), F.lit(0))
    steps = records.select(key, F.transform(tags, F.length).alias("t"), F.transform(F.split(F.col(xml), pattern, -1), F.length).alias("g"))
    steps = steps.select(key, "t", F.zip_with(F.slice("g", 1, F.size("t")), "t", lambda g, t: g + t).alias("s"), "g")
    begins = steps.select(key, F.explode(F.arrays_zip("t", F.slice("g", 1, F.size("t")).alias("g"), sums_before("s").alias("b"))).alias("x"))
    begin = F.col("x.b") + F.col("x.g")
    return begins.select(key, begin.alias("begin"), (begin + F.col("x.t")).alias("end"))


def in_spans(tokens: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """tokens (key, pos, char_start, char_end, ...) with in_tag: whether a span overlaps the token.

    One sort of the record's tokens by their ends and spans by their beginnings: of the spans that begin before
    a token's end, the farthest end must lie behind its start. No token meets the spans one by one.
    """
    line = tokens.select(key, F.col("char_end").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_end"), F.struct("*").alias("_t"))
    s = spans.select(key, F.col("begin").alias("_at"), F.lit(1).alias("_kind"), F.col("end").cast("long").alias("_end"))
    farthest = F.max("_end").over(Window.partitionBy(key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seen = line.unionByName(s, allowMissingColumns=True).withColumn("_far", farthest).where("_kind = 0")
    hit = F.col(f"_t.{key}").isNotNull() & (F.col("_far") > F.col("_t.char_start"))
    return seen.select("_t.*", F.coalesce(hit, F.lit(False)).alias("in_tag"))


def semantic_difficulty(tokens: DataFrame, spans: DataFrame, key: str, mode: str = "pca") -> DataFrame:
    """(key, nll, error, difficulty) from scored tokens (token_id, nll, top1_ok).

    Tokens of opening tags are weighted by how rare they are over the records; the weighted loss and
    the weighted share of wrong first guesses are ranked and fused. The tokens are read once: a record's
    tokens of one id have one weight, so their sums are what is kept and weighted.
    """
    wrong = 1.0 - F.col("top1_ok").cast("double")
    marked = in_spans(tokens, spans, key).select(key, "token_id", "nll", wrong.alias("error"), "in_tag")
    sums = [F.count_if("in_tag").alias("tag_n"), F.count("*").alias("all_n")]
    for c in ("nll", "error"):
        sums += [F.sum(F.when(F.col("in_tag"), F.col(c))).alias(f"tag_{c}"), F.sum(c).alias(f"all_{c}")]
    with arrow_batches(tokens.sparkSession, BATCH):
        held = materialize(marked.groupBy(key, "token_id").agg(*sums), "token-sums")
    n = held.select(key).distinct().count()
    idf = held.groupBy("token_id").agg(F.count(key).alias("_df")).select("token_id", F.log(F.lit(n + 1.0) / (F.col("_df") + 1)).alias("_idf"))
    scores = materialize(_weighted_means(held.join(idf, "token_id"), key, "_idf", ["nll", "error"]), "scores")
    return scoring.fused_midranks(scores, ["nll", "error"], key, mode, "difficulty").select(key, "nll", "error", "difficulty")


def _weighted_means(held: DataFrame, key: str, weight: str, values: list[str]) -> DataFrame:
    """(key, values): scoring.weighted_mean of each value, from sums and numbers of the target's tokens (tag_) and of all (all_)."""
    sums = []
    for side in ("tag", "all"):
        sums += [F.sum(f"{side}_n").alias(f"{side}_n"), F.sum(F.col(f"{side}_n") * F.col(weight)).alias(f"{side}_w")]
        for c in values:
            sums += [F.sum(f"{side}_{c}").alias(f"{side}_{c}"), F.sum(F.col(f"{side}_{c}") * F.col(weight)).alias(f"{side}_w_{c}")]

    def mean(side: str, c: str) -> Column:
        weighted = F.col(f"{side}_w_{c}") / F.greatest(f"{side}_w", F.lit(1.0))
        return F.when(F.col(f"{side}_w") > 0, weighted).otherwise(F.col(f"{side}_{c}") / F.greatest(F.col(f"{side}_n").cast("double"), F.lit(1.0)))

    return held.groupBy(key).agg(*sums).select(key, *[F.when(F.col("tag_n") > 0, mean("tag", c)).otherwise(mean("all", c)).alias(c) for c in values])


def two_view_utility(train: DataFrame, val: DataFrame, key: str, vector: str, features: list[str], k: int, mode: str = "pca") -> DataFrame:
    """(key, utility): neighbours by text (cosine) and by z-scored structure (euclid), ranked and fused."""
    stats = train.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features])

    def standard(df: DataFrame) -> DataFrame:
        one = df.join(F.broadcast(stats), F.lit(True))  # one row
        z = [(F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") < 1e-6, 1.0).otherwise(F.col(f"s_{c}")) for c in features]
        return one.select(key, F.array(*z).alias("z"))

    text = scoring.knn_utility(train, val, key, vector, k, "cosine").withColumnRenamed("utility", "u_text")
    struct = scoring.knn_utility(standard(train), standard(val), key, "z", k, "euclid").withColumnRenamed("utility", "u_struct")
    return scoring.fused_midranks(text.join(struct, key), ["u_text", "u_struct"], key, mode, "utility").select(key, "utility")


def reuse(records: DataFrame, scores: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """records with scores made before; fails if a record has none, or a score has no record."""
    both = records.join(scores.select(F.col(key).alias("_k"), *columns), F.col(key) == F.col("_k"), "full_outer")
    lost = both.agg(F.count_if(F.col("_k").isNull()).alias("a"), F.count_if(F.col(key).isNull()).alias("b")).first()
    if lost.a or lost.b:
        raise ValueError(f"{lost.a} records without a score, {lost.b} scores without a record")
    return both.drop("_k")


def structure_difficulty(featured: DataFrame, key: str, columns: list[str], mode: str = "pca") -> DataFrame:
    """(key, difficulty): each feature's midrank, fused."""
    return scoring.fused_midranks(featured, columns, key, mode, "difficulty").select(key, "difficulty")


def ranked(df: DataFrame, value: str, key: str) -> DataFrame:
    return midrank(df, value, key, f"rank_{value}")
