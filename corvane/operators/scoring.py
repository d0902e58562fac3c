"""Difficulty and utility scores, their fusion, and the dose of each bucket."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.ranking import midrank, ordinal
from corvane.functions.storage import materialize
from corvane.operators.metrics import quantiles


#: Rows of one cell of running weights.
CELL_ROWS = 64
#: Validation vectors are broadcast up to this size.
BROADCAST_BYTES = 64 << 20


def token_idf(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(token, df, idf) with idf = ln((n + 1) / (df + 1)); a token counts once for a document."""
    n = docs.count()
    words = F.array_distinct(F.filter(F.split(F.col(text), r"\s+"), lambda w: w != ""))
    counts = docs.select(F.explode(words).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return counts.withColumn("idf", F.log((F.lit(float(n)) + 1) / (F.col("df") + 1)))


def weighted_mean(tokens: DataFrame, key: str, value: str, weight: str, target: str) -> DataFrame:
    """Weighted mean of the target tokens of each key; all tokens where none is a target, even weights
    where all are zero; the sum of weights counts as 1 at least."""
    any_target = F.max(F.col(target)).over(Window.partitionBy(key))
    use = tokens.withColumn("_any", any_target).where(F.col(target) | ~F.col("_any"))
    total = F.sum(weight).over(Window.partitionBy(key))
    w = use.withColumn("_total", total).withColumn("_w", F.when(F.col("_total") > 0, F.col(weight)).otherwise(F.lit(1.0)))
    return w.groupBy(key).agg((F.sum(F.col("_w") * F.col(value)) / F.greatest(F.sum("_w"), F.lit(1.0))).alias("score"))


def zscores(train: DataFrame, rows: DataFrame, value: str, out: str = "z") -> DataFrame:
    """(value - mean) / deviation by the training side's population figures; a deviation below 1e-6 counts as 1."""
    stats = train.agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"))
    std = F.when(F.col("_std") < 1e-6, 1.0).otherwise(F.col("_std"))
    return rows.join(F.broadcast(stats), F.lit(True)).withColumn(out, (F.col(value) - F.col("_mean")) / std).drop("_mean", "_std")  # one row


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with each of the columns as its z-score, from one aggregate."""
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    z = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") < 1e-6, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns}
    return df.join(F.broadcast(stats), F.lit(True)).withColumns(z).select(df.columns)  # one row


def _distance(a: Column, b: Column, metric: str) -> Column:
    """a, b: arrays of doubles."""
    if metric == "cosine":  # of unit vectors
        dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot))
    if metric == "euclid":
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    raise ValueError(f"no such metric: {metric}")


def nearest(train: DataFrame, val: DataFrame, key: str, vector: str, k: int, metric: str, block: int = 4096) -> DataFrame:
    """(key, distances): the k smallest distances of every training row to the validation rows, ascending.

    The validation rows are a stated query set. They go over the training rows in blocks of vectors,
    each a matrix that is sent once to every executor and at most BROADCAST_BYTES large; one matrix
    product serves an Arrow batch. Pairs are never made into rows, and the k best of a block are
    merged with those of the blocks before it.
    """
    if metric not in ("cosine", "euclid"):
        raise ValueError(f"no such metric: {metric}")
    spark, v = train.sparkSession, F.col(vector).cast("array<double>")
    size = val.agg(F.count("*"), F.max(F.size(vector))).first()
    block = max(1, min(block, BROADCAST_BYTES // max(1, 8 * (size[1] or 1))))
    numbered = materialize(ordinal(val.select(v.alias("_v")), ["_v"], "_no"), "validation")
    rows = train.select(F.col(key), v.alias("_v"), F.array().cast("array<double>").alias("distances"))
    for start in range(0, size[0], block):
        some = numbered.where((F.col("_no") >= start) & (F.col("_no") < start + block)).select("_v").toArrow()["_v"]  # one block
        sent = spark.sparkContext.broadcast(np.array(some.to_pylist(), np.float64))
        rows = rows.withColumn("distances", _closest(sent, k, metric)("_v", "distances"))
        if start + block < size[0]:
            rows = materialize(rows, "nearest")
    return rows.select(key, "distances")


def _closest(sent, k: int, metric: str):
    @F.arrow_udf("array<double>")
    def best(vectors: pa.Array, so_far: pa.Array) -> pa.Array:
        m, out = sent.value, []
        for at in range(0, len(vectors), 256):
            x = np.array(vectors.slice(at, 256).to_pylist(), np.float64).reshape(-1, m.shape[1])
            if metric == "cosine":
                d = np.sqrt(np.maximum(0, 2 - 2 * x @ m.T))
            else:
                d = np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (m * m).sum(1) - 2 * x @ m.T))
            for row, before in zip(d, so_far.slice(at, 256).to_pylist(), strict=True):
                row = np.partition(row, k - 1)[:k] if k < len(row) else row
                out.append(np.sort(np.concatenate([before, row]))[:k])
        return pa.array(out, pa.list_(pa.float64()))

    return best


def knn_utility(train: DataFrame, val: DataFrame, key: str, vector: str, k: int, metric: str = "cosine") -> DataFrame:
    """(key, utility): mean of exp(-d^2 / 2 sigma^2) over the k nearest validation rows, sigma the
    median of the distances above 1e-8; without any, utility is 1."""
    k = min(max(1, k), val.count())
    near = nearest(train, val, key, vector, k, metric)
    near = materialize(near, "distances")
    sigma = quantiles(near.select(F.explode("distances").alias("d")).where("d > 1e-8"), "d", [0.5])[0]
    if sigma is None:
        return near.select(key, F.lit(1.0).alias("utility"))
    kernel = F.transform("distances", lambda d: F.exp(-d * d / (2 * sigma * sigma)))
    return near.select(key, (F.aggregate(kernel, F.lit(0.0), lambda s, x: s + x) / F.size("distances")).alias("utility"))


def fusion_weights(df: DataFrame, columns: list[str], mode: str = "pca") -> list[float]:
    """Weights that sum to 1: even, or the absolute loadings of the first principal component.

    Without any variance the weights are even. The covariance is one aggregate.
    """
    even = [1.0 / len(columns)] * len(columns)
    if mode == "mean" or len(columns) == 1:
        return even
    if mode != "pca":
        raise ValueError(f"no such fusion: {mode}")
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(*[F.covar_pop(columns[i], columns[j]) for i, j in pairs]).first()
    c = np.zeros((len(columns),) * 2)
    for (i, j), x in zip(pairs, row, strict=True):
        c[i, j] = c[j, i] = x or 0.0
    if not np.abs(c).max() > 0:
        return even
    first = np.abs(np.linalg.eigh(c)[1][:, -1])
    return list(first / first.sum())


def fuse(df: DataFrame, columns: list[str], mode: str = "pca", out: str = "fused") -> DataFrame:
    weights = fusion_weights(df, columns, mode)
    return df.withColumn(out, sum((F.col(c) * w for c, w in zip(columns, weights, strict=True)), F.lit(0.0)))


def fused_midranks(df: DataFrame, columns: list[str], tie: str, mode: str = "pca", out: str = "fused") -> DataFrame:
    """Each column's midrank, then their fusion."""
    for c in columns:
        df = midrank(df, c, tie, f"rank_{c}")
    return fuse(df, [f"rank_{c}" for c in columns], mode, out)


def due_order(df: DataFrame, difficulty: str, utility: str, tie: str) -> DataFrame:
    """due = rank(difficulty) / max(rank(utility), 1e-12)."""
    both = midrank(midrank(df, difficulty, tie, "rank_d"), utility, tie, "rank_u")
    return both.withColumn("due", F.col("rank_d") / F.greatest("rank_u", F.lit(1e-12)))


def gated_dose(multiplier: Column, residual: Column) -> Column:
    """Multipliers above 1 shrink with the residual, cut to [0, 1]."""
    r = F.greatest(F.lit(0.0), F.least(F.lit(1.0), residual))
    return F.when(multiplier > 1, 1 + (multiplier - 1) * r).otherwise(multiplier)


def adaptive_dose(rows: DataFrame, bucket: str, difficulty: str, utility: str, first_round: bool, window: list[int] | None = None) -> DataFrame:
    """(bucket, n, dose): mean difficulty over mean utility (1 over it in the first round), scaled so that
    its mean over the rows of the pool, the buckets of the window or all, is 1; a pool without mass is an error."""
    per = rows.groupBy(bucket).agg(F.count("*").alias("n"), F.avg(difficulty).alias("d"), F.avg(utility).alias("u"))
    raw = (F.lit(1.0) if first_round else F.col("d")) / F.greatest("u", F.lit(1e-12))
    return _scaled(per.withColumn("raw", raw), bucket, window)


def _scaled(per: DataFrame, bucket: str, window: list[int] | None) -> DataFrame:
    """(bucket, n, dose): raw over its mean over the rows of the window's buckets. per: one row for each bucket."""
    per = materialize(per, "doses")
    pool = per if window is None else per.where(F.col(bucket).isin(window))
    mean = pool.agg(F.sum(F.col("raw") * F.col("n")) / F.sum("n")).first()[0]
    if mean is None or not 0 < mean < float("inf"):
        raise ValueError("the active buckets have no positive mass")
    return per.select(bucket, "n", (F.col("raw") / F.lit(mean)).alias("dose"))


def residual_dose(rows: DataFrame, bucket: str, difficulty: str, residuals: list[float], window: list[int]) -> DataFrame:
    """(bucket, n, dose): mean difficulty times the residual, cut to [0, 1], over the mean of that in the
    buckets of the window; a window without any mass is an error."""
    per = rows.groupBy(bucket).agg(F.count("*").alias("n"), F.avg(difficulty).alias("d"))
    r = F.try_element_at(F.array(*[F.lit(min(1.0, max(0.0, float(x)))) for x in residuals]), (F.col(bucket) + 1).cast("int"))
    return _scaled(per.withColumn("raw", F.col("d") * r), bucket, window)


def check_rounds(windows: list[int], doses: list[list[float]], k: int, only_round: int | None = None, adaptive: bool = False, gated: bool = False) -> None:
    """The flags that go together: one window and one dose for each round, the last window over all buckets."""
    if adaptive and gated:
        raise ValueError("adaptive and gated doses exclude each other")
    if adaptive and not only_round:
        raise ValueError("an adaptive dose needs the round")
    if not adaptive and len(windows) != len(doses):
        raise ValueError("a dose is missing, or a window")
    for w, dose in zip(windows, doses, strict=False):
        if not 1 <= w <= k or len(dose) != w:
            raise ValueError("a dose has one multiplier for each bucket of its window")
    if only_round is None and windows and windows[-1] != k:
        raise ValueError("the last window holds all buckets")


def draw_round(rows: DataFrame, key: str, bucket: str, k: int, window: int, dose: list[float], size: int, seed: str, reverse: bool = False, mixture: bool = False) -> DataFrame:
    """(draw, key) of one round: the pool is the window's buckets, weights the bucket's multiplier."""
    from corvane.operators.sampling import weighted_draws

    b = F.col(bucket)
    inside = F.lit(True) if mixture else (b >= k - window) if reverse else (b < window)
    at = (k - 1 - b) if reverse else b
    w = F.coalesce(F.try_element_at(F.array(*[F.lit(float(x)) for x in dose]), (at + 1).cast("int")), F.lit(0.0))
    pool = rows.where(inside).withColumn("_w", F.greatest(w, F.lit(1e-6)))
    return weighted_draws(pool, key, "_w", size, seed)


def round_weights(bucket: Column, k: int, window: int, dose: list[float], utility: Column, reverse: bool = False, mixture: bool = False) -> Column:
    """A row's weight in a round: its utility times its bucket's multiplier, 1e-6 at least; 0 outside of the window."""
    inside = F.lit(True) if mixture else (bucket >= k - window) if reverse else (bucket < window)
    at = (k - 1 - bucket) if reverse else bucket
    multiplier = F.coalesce(F.try_element_at(F.array(*[F.lit(float(x)) for x in dose]), (at + 1).cast("int")), F.lit(0.0))
    return F.when(inside, F.greatest(utility * multiplier, F.lit(1e-6))).otherwise(F.lit(0.0))


def build_rounds(
    rows: DataFrame, key: str, bucket: str, k: int, windows: list[int], doses: list[list[float]], size: int, seed: str,
    utility: str | None = None, reverse: bool = False, mixture: bool = False, cells: int | None = None,
) -> DataFrame:
    """(round, position, key): all rounds of a curriculum, from one sort of the rows.

    Each round draws `size` rows with replacement, in proportion to their weights, and shuffles them.
    The running weights of all rounds come from one sort by range; draws meet them through cells of
    equal weight, some CELL_ROWS rows each, in an equi-join with a test. The order within a round is
    a hash of seed, round and draw, ranked by range. A round whose window is empty has no rows.
    """
    from corvane.functions.ranking import draw, rank_within
    from corvane.operators.sampling import running_columns

    check_rounds(windows, doses, k)
    n = len(windows)
    u = F.col(utility).cast("double") if utility else F.lit(1.0)
    weights = [round_weights(F.col(bucket), k, windows[r], doses[r], u, reverse, mixture).alias(f"w{r}") for r in range(n)]
    line = running_columns(rows.select(key, *weights), key, [f"w{r}" for r in range(n)])
    one = line.agg(F.count("*").alias("rows"), *[F.max(f"hi_w{r}").alias(f"t{r}") for r in range(n)]).first()
    totals = [one[f"t{r}"] or 0.0 for r in range(n)]
    cells = cells or max(1024, one.rows // CELL_ROWS)
    of_round = lambda values: F.array(*[F.lit(float(v)) for v in values])[F.col("round")]
    each = F.array(*[F.struct(F.lit(r).alias("round"), F.col(f"lo_w{r}").alias("lo"), F.col(f"hi_w{r}").alias("hi")) for r in range(n)])
    held = line.select(key, F.explode(each).alias("x")).select(key, "x.*").where("hi > lo")
    cell = lambda x: F.floor(x / of_round(max(t / cells, 1e-300) for t in totals))
    spread = held.withColumn("_cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))))
    drawn = rows.sparkSession.range(n * size).select(F.expr(f"cast(id div {max(1, size)} as int)").alias("round"), (F.col("id") % max(1, size)).alias("draw"))
    drawn = drawn.withColumn("u", draw(seed, "round", "draw") * of_round(totals))
    drawn = drawn.where(of_round(totals) > 0).withColumn("_cell", cell(F.col("u")))
    hit = drawn.join(spread, ["round", "_cell"]).where("lo <= u and u < hi")
    hit = hit.select("round", "draw", key, draw(f"{seed}:order", "round", "draw").alias("_order"))
    ranked = rank_within(hit, "round", ["_order", "draw"], "position", "_n")
    return ranked.select("round", "position", "draw", key)


def write_rounds(rounds: DataFrame, records: DataFrame, key: str, path: str) -> None:
    """The rounds' records as JSON lines, a folder for each round, its files in the order of positions."""
    full = rounds.select("round", "position", F.col(key).alias("_key")).join(records, F.col("_key") == F.col(key)).drop("_key")
    full.repartitionByRange("round", "position").sortWithinPartitions("round", "position").write.partitionBy("round").json(path)


def distinct_drawn(rounds: DataFrame, key: str) -> DataFrame:
    """(round, drawn, distinct): how many draws each round has, and of how many different rows."""
    times = rounds.groupBy("round", key).agg(F.count("*").alias("n"))
    return times.groupBy("round").agg(F.sum("n").alias("drawn"), F.count("*").alias("distinct"))


def ordered_scores(scored: DataFrame, key: str, difficulty: str, utility: str, alpha: float, batch: int, seed: str) -> DataFrame:
    """scored with due, the ratio of the ranks of difficulty and utility, and position, drawn from a window that grows over due."""
    from corvane.operators.sampling import expanding_window

    ranked = due_order(scored, difficulty, utility, key).drop("rank_d", "rank_u")
    ranked = materialize(ordinal(ranked, ["due", key], "_place"), "due")
    return ranked.join(expanding_window(ranked.select("_place"), "_place", alpha, batch, seed), "_place").drop("_place")


def score_report(ordered: DataFrame, difficulty: str, utility: str) -> DataFrame:
    """One row: means, medians and 90th percentiles of the scores, and whether the positions are a permutation."""
    columns = {"difficulty": difficulty, "utility": utility, "due": "due"}
    held = {name: quantiles(ordered, c, [0.5, 0.9]) for name, c in columns.items()}
    found = [F.round(F.lit(x).cast("double"), 6).alias(f"{name}_{q}") for name, xs in held.items() for q, x in zip(("p50", "p90"), xs, strict=True)]
    means = [F.round(F.avg(columns[n]), 6).alias(f"{n}_mean") for n in ("difficulty", "utility")]
    whole = (F.count("*") == F.countDistinct("position")) & (F.coalesce(F.max("position") + 1, F.lit(0)) == F.count("*"))
    return ordered.agg(F.count("*").alias("n"), *means, *found, whole.alias("is_permutation"))
