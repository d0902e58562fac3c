import hashlib
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import identity, usage
from corvane.functions.storage import materialize
from corvane.operators import grounding
from corvane.sources import jsonl, results
from corvane.sources.cache import ScoreCache, WrongProvenance, provenance

OUTCOME = "no long, n long, record_id string, domain string, scenario string, success boolean, reason string"


def outcomes(spark, n, flip=()):
    rows = [(k // 7, k, f"r{k}", "d", "s", (k % 3 == 0) != (k in flip), "é\n") for k in range(n)]
    return spark.createDataFrame(rows, OUTCOME).repartition(3)


def test_documents_are_read_by_position(spark, tmp_path):
    results.write_documents(outcomes(spark, 30), str(tmp_path / "a"), "A", "no", "n")
    results.write_documents(outcomes(spark, 30, {4}), str(tmp_path / "b"), "B", "no", "n")
    a, b = (results.read_documents(spark, str(tmp_path / x)) for x in "ab")
    assert sorted((r.no * 7 + r.pos, r.record_id, r.reason) for r in a.collect()) == sorted((k, f"r{k}", "é\n") for k in range(30))
    both = results.paired(a, b, ["no", "pos"]).collect()
    assert [(r.no * 7 + r.pos) for r in both if r.a != r.b] == [4] and len(both) == 30
    (tmp_path / "one.json").write_text(json.dumps({"label": "x", "no": 0, "details": [{"record_id": "q", "success": True}, {"record_id": "p"}]}, indent=1))
    assert [(r.pos, r.record_id, r.success) for r in results.read_documents(spark, str(tmp_path / "one.json"), multi_line=True).collect()] == [(0, "q", True), (1, "p", None)]


def test_pairing_fails_on_other_lengths_and_other_tasks(spark, tmp_path):
    for name, n in (("a", 20), ("b", 19)):
        jsonl.write_ordered(outcomes(spark, n), str(tmp_path / name), "n")
    a, b = (results.read_outcomes(spark, str(tmp_path / x)) for x in "ab")
    assert [(r.line, r.record_id) for r in a.orderBy("line").collect()] == [(k, f"r{k}") for k in range(20)]
    with pytest.raises(results.Misaligned, match="1 positions on the left"):
        results.paired(a, b, ["line"])
    with pytest.raises(results.Misaligned, match="20 positions hold"):
        results.paired(a, a.withColumn("record_id", F.lit("x")), ["line"])


def test_lines_are_counted_in_the_order_of_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    lines = [f"{k} " + "x" * (k % 50) for k in range(900)]
    for name, some in (("part-0", lines[:5]), ("part-1", lines[5:800]), ("part-2", []), ("part-3", lines[800:])):
        (tmp_path / "t" / name).write_text("".join(f"{x}\n" for x in some))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = [r.value for r in results.numbered_lines(spark, str(tmp_path / "t")).orderBy("line").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == lines


def test_usage_is_what_an_aggregate_counts(spark):
    rows = spark.createDataFrame([(True, 5, 6), (False, 7, None), (None, 1, 2), (False, 10, 20)], "hit boolean, p int, c int")
    for df, want in ((rows, (3, 1, 18, 22)), (rows.limit(0), (0, 0, 0, 0))):
        out, seen = usage.observed(df, F.col("hit"), F.col("p"), F.col("c"))
        assert materialize(out, "answers").count() == df.count()
        assert tuple(usage.usage(seen)[n] for n in usage.COUNTERS) == want


def test_second_run_computes_misses_only(spark, tmp_path):
    cache, made_by, asked = ScoreCache(spark, str(tmp_path / "c"), "k", "k string, score double"), provenance("m", t=1), []

    def compute(rows):
        asked.append(sorted(r.k for r in rows.collect()))
        return rows.select("k", F.length("k").cast("double").alias("score"))

    jobs = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k string")
    assert cache.versions() == [] and cache.entries().count() == 0
    cache.scored(jobs("a", "bb", "bb"), made_by, compute)
    got = cache.scored(jobs("a", "ccc", "a"), made_by, compute).collect()
    assert asked == [["a", "bb"], ["ccc"]] and sorted((r.k, r.score, r._version) for r in got) == [("a", 1.0, 1), ("a", 1.0, 1), ("ccc", 3.0, 2)]
    cache.scored(jobs("a"), made_by, compute)
    assert len(asked) == 2 and cache.versions() == [1, 2]
    cache.append(jobs("a").withColumn("score", F.lit(9.0)), made_by)  # a late entry supersedes
    assert [(r.score, r._version) for r in cache.entries().where("k = 'a'").collect()] == [(9.0, 3)]
    with pytest.raises(WrongProvenance, match="not by"):
        cache.scored(jobs("a"), provenance("other", t=1), compute)
    (tmp_path / "c" / "version=4").mkdir()  # a run that was lost has no end
    assert cache.versions() == [1, 2, 3]
    assert sorted(r.score for r in cache.reused(jobs("a", "bb", "ccc"), made_by).collect()) == [2.0, 3.0, 9.0]
    with pytest.raises(ValueError, match="1 scores without a record"):
        cache.reused(jobs("a", "bb"), made_by)
    with pytest.raises(ValueError, match="1 records without a score"):
        cache.reused(jobs("a", "bb", "ccc", "d"), made_by)


def test_identities_are_canonical_json(spark):
    odd = ['plain "quoted" \\ back', "line\nbreak\ttab\r", "\x01\x1f\x7f\x85 é 日本 😀  ", "", "</script>"]
    df = spark.createDataFrame([(t, t[::-1], "out" + t) for t in odd], "a string, b string, c string")
    got = df.select("a", "b", "c", identity.record_id(F.col("a"), F.col("b"), F.col("c")).alias("r"), identity.stable_record_id(F.col("a"), F.col("b")).alias("s")).collect()
    for x in got:
        plain = lambda d: hashlib.sha256(json.dumps(d, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        assert x.r == plain({"instruction": x.a, "input": x.b, "output": x.c}) and x.s == plain({"input": x.b, "instruction": x.a})
    # fixed vectors: the bytes are written out
    assert identity.canonical({"b": "\x01\n", "a": "é"}) == '{"a":"é","b":"\\u0001\\n"}'
    one = spark.range(1).select(identity.record_id(F.lit("i"), F.lit("n"), F.lit("o")).alias("r"), identity.record_id(F.lit("i"), F.lit(None), F.lit("o")).alias("none")).first()
    assert one.r == hashlib.sha256(b'{"input":"n","instruction":"i","output":"o"}').hexdigest() and one.none is None
    assert identity.task_key("d", [], [["at", "é"]], [], ["x"]) == hashlib.sha256(b'{"d": "d", "f": [], "g": [["at", "\\u00e9"]], "i": [], "r": ["x"]}').hexdigest()
    key = spark.range(1).select(identity.request_key(F.lit("m"), F.lit("é"), {"t": 0.5}).alias("k")).first().k
    assert key == hashlib.sha256('{"kw": {"t": 0.5}, "m": "m", "msg": [{"content": "é", "role": "user"}]}'.encode()).hexdigest()


def test_groundings_are_those_of_the_product(spark):
    r = random.Random(6)
    robots, places, items = [f"r{i}" for i in range(4)], [f"p{i}" for i in range(5)], ["i0", "i1"]
    of = {"robot": robots, "place": places, "item": items}
    facts = {"connected": {(r.choice(places), r.choice(places)) for _ in range(9)}, "reach": {(r.choice(robots), r.choice([*places, "gone"])) for _ in range(12)}, "lit": {("p1",), ("p3",)}}
    pools = {k: spark.createDataFrame([(x,) for x in v], "o string") for k, v in of.items()}
    tables = {k: spark.createDataFrame(sorted(v), ", ".join(f"c{i} string" for i in range(len(next(iter(v)))))) for k, v in facts.items()}
    S = grounding.Schema
    schemas = [
        S("Move", (("r", "robot"), ("a", "place"), ("b", "place")), (("connected", ("a", "b")), ("reach", ("r", "a")), ("reach", ("r", "b")))),
        S("Hand", (("g", "robot"), ("t", "robot"), ("i", "item"), ("l", "place")), (("reach", ("g", "l")), ("reach", ("t", "l"))), ("g", "t")),
        S("Loop", (("a", "place"), ("r", "robot")), (("connected", ("a", "a")),)),
        S("Free", (("g", "robot"), ("t", "robot")), (), ("g", "t")),
        S("Apart", (("r", "robot"), ("a", "place"), ("b", "place")), (("lit", ("a",)), ("reach", ("r", "b")))),
    ]
    for schema in schemas:
        names = [n for n, _ in schema.params]
        want = []
        for combo in itertools.product(*[of[t] for _, t in schema.params]):
            bound = dict(zip(names, combo, strict=True))
            if all(tuple(bound[a] for a in args) in facts[rel] for rel, args in schema.static) and len({bound[a] for a in schema.agents}) == len(schema.agents):
                want.append(combo)
        assert sorted(tuple(x) for x in grounding.ground(schema, pools, tables).collect()) == sorted(want), schema.name
    assert grounding.join_order(schemas[0].static, {"connected": 9, "reach": 5}) == [1, 2, 0]


def test_groundings_begin_where_few_rows_meet(spark):
    """Robots share few places: two of them must be tied by an item before their places meet."""
    static = (("reach", ("g", "l")), ("reach", ("t", "l")), ("carry", ("g", "i")), ("carry", ("t", "i")))
    order = grounding.join_order(static, {"reach": 3000, "carry": 20000}, {"reach": (600, 25), "carry": (600, 10000)})
    assert set(order[:2]) == {2, 3} and sorted(order) == [0, 1, 2, 3]
    assert grounding.join_order((), {}, {"x": (1,)}) == []
    # 600 robots at one place: 359,400 pairs of them, 600 of which share an item
    robots = spark.range(600).select(F.col("id").alias("o"))
    facts = {"reach": robots.select("o", F.lit(0).alias("p")), "carry": robots.select("o", F.expr("o div 2").alias("c"))}
    pools = {"robot": robots, "place": spark.createDataFrame([(0,)], "o int"), "item": robots}
    schema = grounding.Schema("Hand", (("g", "robot"), ("t", "robot"), ("i", "item"), ("l", "place")), static, ("g", "t"))
    got = grounding.ground(schema, pools, facts)
    assert sorted(tuple(x) for x in got.collect()) == sorted((i, i ^ 1, i // 2, 0) for i in range(600))
