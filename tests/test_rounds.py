import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions.ranking import draw
from corvane.operators import metrics, sampling, scoring


@pytest.mark.parametrize(("n", "alpha", "batch"), [(0, 0.8, 4), (1, 0.8, 4), (50, 0.8, 4), (37, 0.3, 5), (10, 1.0, 4), (60, 0.9, 1), (23, 3.0, 7)])
def test_expanding_window_is_the_sequential_shuffle(spark, n, alpha, batch):
    """The same draws, one after the other."""
    got = {r.position: r.id for r in sampling.expanding_window(spark.range(n), "id", alpha, batch, "7").collect()}
    u = [r.u for r in spark.range(n).select("id", draw("7", "id").alias("u")).orderBy("id").collect()]
    slots, steps = list(range(n)), math.ceil(n / batch)
    reach = max(1, math.ceil(alpha * steps))
    for k in range(n):
        t = k // batch
        end = max(max(1, math.ceil(min(1.0, (t + 1) / reach) * n)), min(n, (t + 1) * batch))
        j = k + math.floor(u[k] * (end - k))
        slots[k], slots[j] = slots[j], slots[k]
    assert got == dict(enumerate(slots))


def test_every_order_that_the_windows_allow_is_as_likely_as_another():
    """Of all choices of j, which are equally likely, each leads to one order, and all orders to as many."""
    ends = [3, 3, 5, 5, 5]
    seen: dict[tuple, int] = {}
    for js in itertools.product(*[range(k, e) for k, e in enumerate(ends)]):
        slots = list(range(5))
        for k, j in enumerate(js):
            slots[k], slots[j] = slots[j], slots[k]
        seen[tuple(slots)] = seen.get(tuple(slots), 0) + 1
    allowed = [p for p in itertools.permutations(range(5)) if all(x < e for x, e in zip(p, ends, strict=True))]
    assert sorted(seen) == sorted(allowed) and set(seen.values()) == {1}


def test_binomial_quantiles():
    def plain(n, p, u):
        total, k = 0.0, 0
        while True:
            total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
            if total >= u or k == n:
                return k
            k += 1

    u = np.array([0.0001, 0.1, 0.37, 0.5, 0.5001, 0.9, 0.99999])
    for n, p in ((1, 0.3), (10, 0.5), (57, 0.01), (200, 0.97), (0, 0.4), (9, 0.0), (9, 1.0)):
        want = [plain(n, p, x) if 0 < p < 1 else n * p for x in u]
        assert metrics.binomial_quantile(n, p, u).tolist() == want
    n, p = 10_000_000, 0.3  # the expansion against the sums
    far = metrics.binomial_quantile(n, p, u)
    metrics.EXACT_DEVIATION, held = 1e9, metrics.EXACT_DEVIATION
    try:
        assert np.abs(metrics.binomial_quantile(n, p, u) - far).max() <= 1
    finally:
        metrics.EXACT_DEVIATION = held


def test_bootstrap_is_that_of_drawn_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(bool(a), bool(b)) for a, b in zip(rng.random(400) < 0.6, rng.random(400) < 0.5, strict=True)]
    d = np.array([int(a) - int(b) for a, b in rows])
    means = d[rng.integers(0, 400, (20_000, 400))].mean(1)
    df = spark.createDataFrame(rows, "a boolean, b boolean").select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"))
    got = metrics.bootstrap_ci(df, "a", "b", 20_000, "s").first()
    assert got.rounds == 20_000 and got.difference == pytest.approx(d.mean())
    assert (got.low, got.high) == pytest.approx(np.quantile(means, [0.025, 0.975]), abs=0.006)
    assert metrics.bootstrap_ci(df, "a", "b", 50, "s").first() == metrics.bootstrap_ci(df.repartition(5), "a", "b", 50, "s").first()
    one = metrics.bootstrap_ci(df.where("a = 1 and b = 0"), "a", "b", 10, "s").first()
    assert (one.low, one.high, one.difference) == (1, 1, 1)
    assert metrics.bootstrap_ci(df.limit(0), "a", "b", 10, "s").first() == (None, None, 10, None)
    with pytest.raises(ValueError, match="different"):
        metrics.bootstrap_ci(spark.range(100).select("id", F.lit(0).alias("z")), "id", "z", 5, "s")


def pool(spark, n=200):
    return spark.range(n).select("id", (F.col("id") % 4).cast("int").alias("b"), (F.col("id") % 7 + 1).cast("double").alias("u"))


def test_rounds_follow_their_weights_and_windows(spark):
    got = scoring.build_rounds(pool(spark), "id", "b", 4, [1, 2, 4], [[1.0], [1.0, 3.0], [1.0] * 4], 3000, "r", utility="u").collect()
    for r, buckets in enumerate(({0}, {0, 1}, {0, 1, 2, 3})):
        own = [x for x in got if x.round == r]
        assert sorted(x.position for x in own) == list(range(3000)) and {x.id % 4 for x in own} == buckets
        assert [x.draw for x in sorted(own, key=lambda x: x.position)] != list(range(3000))
    second = [x.id for x in got if x.round == 1]
    assert sum(i % 4 == 1 for i in second) / 3000 == pytest.approx(0.75, abs=0.04)
    assert sum(i % 7 == 6 for i in second) / sum(i % 7 == 0 for i in second) == pytest.approx(7, rel=0.4)
    reverse = scoring.build_rounds(pool(spark), "id", "b", 4, [1, 4], [[1.0], [1.0] * 4], 50, "r", reverse=True)
    assert {x.id % 4 for x in reverse.where("round = 0").collect()} == {3}
    drawn = {x.round: (x.drawn, x.distinct) for x in scoring.distinct_drawn(reverse, "id").collect()}
    assert drawn[0][0] == 50 and drawn[0][1] <= 50


def test_rounds_of_nothing_and_wrong_flags(spark):
    assert scoring.build_rounds(pool(spark).where("b = 3"), "id", "b", 4, [1, 4], [[1.0], [1.0] * 4], 5, "r").groupBy("round").count().collect() == [(1, 5)]
    assert scoring.build_rounds(pool(spark, 0), "id", "b", 4, [4], [[1.0] * 4], 5, "r").count() == 0
    with pytest.raises(ValueError, match="last window"):
        scoring.build_rounds(pool(spark), "id", "b", 4, [1], [[1.0]], 5, "r")


def test_rounds_are_written_in_order(spark, tmp_path):
    rounds = scoring.build_rounds(pool(spark), "id", "b", 4, [2, 4], [[1.0] * 2, [1.0] * 4], 40, "r")
    records = pool(spark).select("id", F.concat(F.lit("é"), "id").alias("text"))
    scoring.write_rounds(rounds, records, "id", str(tmp_path / "out"))
    for r in range(2):
        lines = [json.loads(x) for p in sorted((tmp_path / "out" / f"round={r}").glob("part*")) for x in p.read_text(encoding="utf-8").splitlines()]
        assert [x["position"] for x in lines] == list(range(40)) and all(x["text"] == f"é{x['id']}" for x in lines)


def test_shuffled_keeps_counts(spark):
    rows = pool(spark).unionByName(pool(spark).where("id = 3").withColumn("b", F.lit(None).cast("int")).withColumn("id", F.lit(999).cast("long")))
    out = sampling.shuffled(rows, "b", "id", "s")
    count = lambda df: sorted((str(r.b), r["count"]) for r in df.groupBy("b").count().collect())
    assert count(out) == count(rows) and out.count() == 201
    assert out.join(rows.withColumnRenamed("b", "old"), "id").where("b != old").count() > 50
