import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import mission_text, ranking
from corvane.functions import text as T
from corvane.operators import masks, metrics, prose, sampling, scoring
from corvane.sources import jsonl


def test_midrank_is_ordinal(spark):
    of = lambda values: [r.midrank for r in ranking.midrank(spark.createDataFrame(list(enumerate(values)), "i int, v double"), "v", "i").orderBy("i").collect()]
    assert of([3.0, 1.0, 2.0]) == pytest.approx([2.5 / 3, 0.5 / 3, 1.5 / 3])
    assert of([5.0, 5.0, 1.0]) == pytest.approx([1.5 / 3, 2.5 / 3, 0.5 / 3])
    assert of([]) == []


@pytest.mark.parametrize(("n", "k"), [(10, 4), (7, 3), (3, 4), (0, 4)])
def test_buckets_like_array_split(spark, n, k):
    got = [r.bucket for r in ranking.buckets(spark.range(n).withColumn("v", -F.col("id")), "v", "id", k).orderBy("v").collect()]
    assert got == [b for b, part in enumerate(np.array_split(np.arange(n), k)) for _ in part]


def test_ordinal_over_many_partitions(spark):
    df = spark.range(5000).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(50)))
    got = [(r.v, r.id) for r in ranking.ordinal(df.repartition(7), ["v", "id"]).orderBy("rank0").collect()]
    assert got == sorted(got) and len(got) == 5000


def test_fusion(spark):
    rows = [(float(a), float(a) + 1) for a in np.linspace(0, 1, 50)]
    df = spark.createDataFrame(rows, "a double, b double")
    assert scoring.fusion_weights(df, ["a", "b"]) == pytest.approx([0.5, 0.5])
    assert [r.fused for r in scoring.fuse(df, ["a", "b"]).orderBy("a").collect()] == pytest.approx(list(np.linspace(0.5, 1.5, 50)))
    assert scoring.fusion_weights(spark.createDataFrame([(1.0, 1.0)] * 3, "a double, b double"), ["a", "b"]) == [0.5, 0.5]
    with pytest.raises(ValueError):
        scoring.fusion_weights(df, ["a", "b"], "median")
    x = np.random.default_rng(0).normal(size=(200, 3)) @ np.diag([1, 2, 3])
    got = scoring.fusion_weights(spark.createDataFrame(x.tolist(), "a double, b double, c double"), ["a", "b", "c"])
    v = np.abs(np.linalg.eigh(np.cov(x.T, bias=True))[1][:, -1])
    assert got == pytest.approx(list(v / v.sum()))


def test_mcnemar(spark):
    rows = [(0, 0), (0, 5), (5, 0), (3, 3), (3, 12), (400, 900)]
    got = [r.p for r in spark.createDataFrame(rows, "a long, b long").select(metrics.mcnemar(F.col("a"), F.col("b")).alias("p")).collect()]
    from math import comb

    want = [min(1.0, 2 * sum(comb(a + b, i) for i in range(min(a, b) + 1)) / 2 ** (a + b)) if a + b else 1.0 for a, b in rows]
    assert got == pytest.approx(want, rel=1e-9) and got[:2] == pytest.approx([1.0, 0.0625])


def test_contingency_of_the_toy_pair(spark):
    pairs = spark.createDataFrame([(True, True, "x"), (False, True, "x")], "a boolean, b boolean, s string")
    r = metrics.contingency(pairs, "a", "b", "s").where("s is null").first()
    assert (r.both, r.a_only, r.b_only, r.neither) == (1, 0, 1, 0)


def test_knn_against_numpy(spark):
    r = np.random.default_rng(1)
    train, val = r.normal(size=(40, 6)), r.normal(size=(15, 6))
    frame = lambda m: spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "i int, v array<double>")
    d = np.sort(np.sqrt(((train[:, None] - val[None]) ** 2).sum(2)), 1)[:, :4]
    sigma = np.median(d[d > 1e-8])
    got = {x.i: x.utility for x in scoring.knn_utility(frame(train), frame(val), "i", "v", 4, "euclid").collect()}
    assert [got[i] for i in range(40)] == pytest.approx(list(np.exp(-(d**2) / (2 * sigma**2)).mean(1)))
    assert {x.utility for x in scoring.knn_utility(frame(val[:1]), frame(val[:1]), "i", "v", 3, "euclid").collect()} == {1.0}
    with pytest.raises(ValueError):
        scoring.knn_utility(frame(train), frame(val), "i", "v", 4, "manhattan")


def test_weighted_draws_follow_the_weights(spark):
    df = spark.createDataFrame([(i, w) for i, w in enumerate([1.0, 0.0, 7.0, 2.0])], "i int, w double")
    counts = {r.i: r["count"] for r in sampling.weighted_draws(df, "i", "w", 4000, "s").groupBy("i").count().collect()}
    assert 1 not in counts and sum(counts.values()) == 4000
    assert [counts[i] / 4000 for i in (0, 2, 3)] == pytest.approx([0.1, 0.7, 0.2], abs=0.03)


def test_expanding_window_is_a_permutation_of_its_windows(spark):
    got = [r.id for r in sampling.expanding_window(spark.range(50), "id", 0.8, 4, "7").orderBy("position").collect()]
    assert sorted(got) == list(range(50))
    steps = -(-50 // 4)
    for p, x in enumerate(got):
        assert x < max(np.ceil(min(1, (p // 4 + 1) / np.ceil(0.8 * steps)) * 50), p + 4)


def test_stratified_rounds_half_to_even(spark):
    df = spark.range(60).withColumn("s", F.when(F.col("id") < 25, "a").when(F.col("id") < 26, "b").otherwise("c"))
    got = {r.s: r["count"] for r in sampling.stratified(df, "s", "id", 0.1, "x").groupBy("s").count().collect()}
    assert got == {"a": 2, "b": 1, "c": 3}
    assert sampling.stratified(df, "s", "id", 0, "x").count() == 0


def test_flags():
    scoring.check_rounds([2, 3, 4], [[1, 1], [1, 1, 1.5], [0.5, 0.75, 1.5, 3]], 4)
    for bad in (lambda: scoring.check_rounds([2], [[1, 1]], 4), lambda: scoring.check_rounds([4], [[1]], 4), lambda: scoring.check_rounds([4], [], 4, adaptive=True)):
        with pytest.raises(ValueError):
            bad()


def test_jsonl(spark, tmp_path):
    record = {"instruction": "a b", "input": "é", "output": "<root/>", "meta": {"domain": "d", "faults": [{"type": "battery", "robot": "r", "budget": 2}, {"type": "blocked_edge", "edge": ["a", "b"]}]}}
    good = tmp_path / "good.jsonl"
    good.write_text("\n" + json.dumps(record, ensure_ascii=False) + "\n\n" + json.dumps(record) + "\n", encoding="utf-8")
    rows = jsonl.read_validated(spark, str(good)).orderBy("row_idx").collect()
    assert [r.row_idx for r in rows] == [2, 4] and rows[0].instruction == "a b" and rows[0].meta.faults[0].budget == 2
    bad = tmp_path / "bad.jsonl"
    bad.write_text(json.dumps(record) + "\n" + json.dumps({k: v for k, v in record.items() if k != "input"}) + "\n")
    with pytest.raises(ValueError, match="line 2: missing:input"):
        jsonl.read_validated(spark, str(bad))
    bad.write_text("{oops\n")
    with pytest.raises(ValueError, match="line 1: bad_json"):
        jsonl.read_validated(spark, str(bad))
    bad.write_text("\n")
    with pytest.raises(ValueError, match="no record"):
        jsonl.read_validated(spark, str(bad))
    jsonl.write_ordered(jsonl.read_validated(spark, str(good)), str(tmp_path / "out"))
    assert "é" in "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("part*"))


def test_cache(spark):
    jobs = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    compute = lambda df: df.withColumn("content", F.upper("k"))
    all_, new = jsonl.cached(jobs, spark.createDataFrame([("a", "held")], "k string, content string"), "k", compute)
    assert sorted((r.k, r.content) for r in all_.collect()) == [("a", "held"), ("b", "B"), ("b", "B")]
    assert [r.k for r in new.collect()] == ["b"]


def test_masks(spark):
    schema = "case_id int, text string, robots array<string>, items array<string>, edges array<array<string>>, charge_stations array<string>"
    platform = (["alpha", "beta"], ["kit", "crate"], [["hall", "lab"], ["lab", "store"]], ["store"])
    texts = ['<MoveTo robot="al', '<MoveTo robot="alpha" from="hall" to="', '<PickUp item="k', "<Sequence>", '<Recharge robot="alpha" station="', '<SignalReady robot="alpha" item="kit" to="', '<X location="']
    cases = spark.createDataFrame([(i, t, *platform) for i, t in enumerate(texts)], schema)
    done = masks.allowed_values(cases)
    got = {r.case_id: r.allowed for r in done.collect()}
    assert got == {0: ['alpha"'], 1: ['lab"'], 2: ['kit"'], 3: None, 4: ['store"'], 5: ['alpha"', 'beta"'], 6: ['hall"', 'lab"', 'store"']}
    vocabulary = spark.createDataFrame([(t,) for t in ('pha"', "pha", "p", "x", "it", 'it"/>', "la")], "token string")
    tokens = masks.allowed_tokens(done.where("case_id in (0, 2)"), vocabulary)
    assert sorted((r.case_id, r.token) for r in tokens.collect()) == [(0, "p"), (0, "pha"), (0, 'pha"'), (2, "it"), (2, 'it"/>')]
    with pytest.raises(KeyError):
        masks.platform(cases.withColumn("task", F.lit(1)), "goal")


def test_mission_parts(spark):
    text = "The hall (hall) connects to the dock (dock) and the lab (lab). Nothing here; the lab (lab) leads to store (store)."
    r = prose.mission_parts(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").first()
    assert r.places == ["dock", "hall", "lab", "store"] and ["store", "lab"] in r.edges and len(r.edges) == 6


def test_text(spark):
    one = lambda **c: spark.range(1).select(*[v.alias(k) for k, v in c.items()]).first()
    long = "word " * 20
    r = one(a=T.passes_gate(F.lit(long)), b=T.passes_gate(F.lit("x" * 60)), c=T.passes_gate(F.lit(long + " PDDL")), d=T.passes_gate(F.lit("\n" + "x" * 61 + "\t")))
    assert tuple(r) == (True, False, False, True)
    r = one(a=T.clean_name(F.lit("The Old  Lab at")), b=T.word_suffixes(F.lit("big red box")), c=T.rename_tag(F.lit("<p><pre></p><p/>"), "p", "para"))
    assert tuple(r) == ("old lab", ["big red box", "red box"], "<para><pre></para><para/>")


def test_provider_retries_and_second_round(spark):
    jobs = spark.createDataFrame([(1, "ok"), (2, "late"), (3, "never")], "k int, p string")

    def provider(prompt, temperature):
        if prompt == "never":
            raise OSError("no answer")
        return "short" if prompt == "late" and temperature > 0.5 else "a mission that is told at some length, " * 3

    got = {r.k: r.content for r in mission_text.ask(jobs, "k", "p", provider, 0.9, tries=1).collect()}
    assert got[2] == "short" and got[3] == "" and len(got[1]) > 60


def test_stream(spark, tmp_path):
    from corvane.streaming import events

    rows = [(i, f"2024-01-{1 + i // 10:02d} 00:00:00", i % 3, "click", 1.0, "{}") for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    events.run_to_table(events.windowed(events.read_events(spark, str(tmp_path / "in"), 10)), "seen", str(tmp_path / "state"))
    assert sum(r.n for r in spark.table("seen").collect()) >= 20
