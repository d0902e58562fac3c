import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane import __main__ as cli
from corvane.functions import ranking, storage
from corvane.functions import text as T
from corvane.operators import difficulty, graph, metrics, scoring, trees
from corvane.plans import contract, inline
from corvane.sources import jsonl


def test_command_line(spark, sf, tmp_path, capsys):
    assert cli.main(["--list"]) == 0 and "group_success" in capsys.readouterr().out
    assert cli.main(["failures_only", "--data", sf, "--out", str(tmp_path)], spark) == 0
    assert spark.read.parquet(str(tmp_path / "failures_only")).count() > 0
    assert cli.main(["failures_only", "--data", sf, "--show", "1"], spark) == 0 and "failures" in capsys.readouterr().out
    for wrong in ([], ["no_such", "--data", sf]):
        with pytest.raises(SystemExit):
            cli.main(wrong, spark)


def test_residuals_are_one_for_each_bucket(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"label": "x", "R_b": [0.5, 1.7, -1]}, indent=1))
    assert jsonl.read_residuals(spark, str(tmp_path / "r.json"), 3) == [0.5, 1.0, 0.0]
    with pytest.raises(ValueError, match="3 residuals for 4"):
        jsonl.read_residuals(spark, str(tmp_path / "r.json"), 4)


def test_doses_fail_without_mass(spark):
    rows = spark.createDataFrame([(0, 1.0, 0.5), (0, 3.0, 0.5), (1, 4.0, 2.0), (2, 0.0, 1.0)], "b int, d double, u double")
    got = {r.b: r.dose for r in scoring.adaptive_dose(rows, "b", "d", "u", False).collect()}
    assert got == pytest.approx({0: 4 / 2.5, 1: 2 / 2.5, 2: 0})  # means 4, 2 and 0 over 2, 1 and 1 rows
    got = {r.b: r.dose for r in scoring.adaptive_dose(rows, "b", "d", "u", True, [0, 1]).collect()}
    assert got == pytest.approx({0: 2 / 1.5, 1: 0.5 / 1.5, 2: 1 / 1.5})
    for window in ([2], [9]):
        with pytest.raises(ValueError, match="no positive mass"):
            scoring.adaptive_dose(rows, "b", "d", "u", False, window)


def test_small_parts(spark):
    rows = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "row_idx int, x string")
    assert [r.x for r in jsonl.first_rows(rows, 2).collect()] == ["a", "b"] and jsonl.first_rows(rows, 0).count() == 0
    assert sorted((r.x, r.batch, r.place) for r in jsonl.batches(rows, 2, "row_idx").collect()) == [("a", 0, 0), ("b", 0, 1), ("c", 1, 0)]
    missions = spark.createDataFrame([(1, ([],)), (2, ([5],)), (3, (None,))], "k int, meta struct<faults: array<int>>")
    assert [r.k for r in jsonl.without_faults(missions).orderBy("k").collect()] == [1, 3] and jsonl.without_faults(missions, True).count() == 3
    assert T.per_stage("2", 3, int) == [2, 2, 2] and T.per_stage("1,2", 2) == [1.0, 2.0]
    with pytest.raises(ValueError, match="2 values for 3"):
        T.per_stage("1,2", 3)
    assert ranking.mixed_seed(7, "lib", "T1") != ranking.mixed_seed(7, "lib", "T2") and 7000 <= ranking.mixed_seed(7, "x") < 7997
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a<e>"), (1, 2, "user", "more"), (2, 0, "user", "q"), (3, 0, "user", "q"), (3, 1, "assistant", None)], "c int, t int, r string, x string")
    got = {r.c: (r.prompt, r.completion) for r in T.prompt_and_completion(turns, "c", "t", "r", "x", "<e>").collect()}
    assert got == {1: ("user: q\n\nassistant:\n", "a<e>"), 3: ("user: q\n\nassistant:\n", "<e>")}
    one = spark.createDataFrame([("Red Box (b) and red box (c)",)], "t string").select(T.name_map(F.col("t")).alias("m")).first().m
    assert one == {"red box": "b", "and red box": "c"}
    cells = metrics.crosstab(spark.createDataFrame([(1, "x"), (2, None)], "a int, b string"), "a", "b")
    assert sorted((r.a, str(r.b), r.n) for r in cells.collect()) == [(1, "None", 0), (1, "x", 1), (2, "None", 1), (2, "x", 0)]


def test_reused_scores_and_structure(spark):
    records = spark.createDataFrame([("a", 3, 1), ("b", 1, 2), ("c", 2, 3)], "k string, x int, y int")
    scores = records.select("k", F.lit(1.0).alias("s"))
    assert difficulty.reuse(records, scores, "k", ["s"]).count() == 3
    with pytest.raises(ValueError, match="1 records without"):
        difficulty.reuse(records, scores.where("k != 'a'"), "k", ["s"])
    got = {r.k: r.difficulty for r in difficulty.structure_difficulty(records, "k", ["x", "y"]).collect()}
    assert got == pytest.approx({"a": 0.5, "b": 1 / 3, "c": 2 / 3})


def test_structure_vector_has_zeros_for_broken_trees(spark):
    good = '<root><Fallback><SignalReady/><CoMoveTo a="1"/></Fallback></root>'
    xmls = [good, good.replace("</Fallback>", ""), "<a></b></a>", "", None, "<a/><b/>", "<a><b></a></b>", "text"]
    records = spark.createDataFrame([(i, x) for i, x in enumerate(xmls)], "i int, xml string")
    got = {r.i: (r.plan_len, r.n_agents, r.n_faults, r.n_sync, r.n_co, r.n_fb, r.depth, r.n_nodes) for r in trees.structure_vector(records, "xml", F.lit(4), F.lit(2), F.lit(None).cast("int")).collect()}
    assert got[0] == (4, 2, 0, 1, 1, 1, 2, 4) and all(got[i] == (4, 2, 0, 0, 0, 0, 0, 0) for i in range(1, 8))


def test_ordered_scores_report(spark):
    rows = spark.range(40).select("id", (F.col("id") % 7).cast("double").alias("d"), (F.col("id") % 5 + 1).cast("double").alias("u"))
    ordered = scoring.ordered_scores(rows, "id", "d", "u", 0.8, 4, "1")
    assert sorted(r.position for r in ordered.collect()) == list(range(40))
    report = scoring.score_report(ordered, "d", "u").first()
    assert report.n == 40 and report.is_permutation and report.difficulty_mean == pytest.approx(2.875)
    assert not scoring.score_report(ordered.withColumn("position", F.lit(0)), "d", "u").first().is_permutation


def test_graph_parts(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")], "src string, dst string")
    reach = spark.createDataFrame([("r", "a"), ("r", "c"), ("q", "b")], "robot string, loc string")
    blocked = spark.createDataFrame([("b", "c")], "src string, dst string")
    got = {(r.loc, r.robot): r.ways for r in graph.valid_outgoing(edges, blocked, reach).collect()}
    assert got == {("b", "r"): ["a"], ("a", "q"): ["b"], ("c", "q"): ["b"]}
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "n string")
    extra = graph.extra_edges(nodes, "n", edges, 5, "s").collect()
    assert len({(r.a, r.b) for r in extra}) == 5 and all(r.a < r.b and (r.a, r.b) not in {("a", "b"), ("b", "c")} for r in extra)
    tree = {r.k: r.parent for r in graph.spanning_tree(spark.range(1, 30).withColumnRenamed("id", "k"), "k", "s").collect()}
    assert tree[1] is None and all(1 <= p < k for k, p in tree.items() if k > 1)
    plans = spark.createDataFrame([(1, 1, "x", "x", "y"), (1, 2, "y", "y", "y"), (2, 1, "x", "x", "z"), (2, 2, "y", "z", "q")], "plan int, no int, need string, gone string, came string")
    assert sorted(tuple(r) for r in inline.replay(plans).collect()) == [(1, True, "free,y"), (2, False, "free,z")]


def test_station_distance_within_steps(spark):
    """A line of places, the station at its start: what lies beyond the steps, or on no list of places, has no distance or no row."""
    line = [(f"p{i}", f"p{i + 1}") for i in range(20)]
    edges = spark.createDataFrame([*line, *[(b, a) for a, b in line]], "src string, dst string")
    places = spark.createDataFrame([(f"p{i}",) for i in range(20)], "loc string")  # p20 is none of them
    stations, robots = places.where("loc = 'p0'"), spark.createDataFrame([("r",), ("idle",)], "robot string")
    reach = places.select(F.lit("r").alias("robot"), "loc")
    far = graph.UNREACHED
    got = {(x.robot, x.loc): x.distance for x in graph.station_distance(edges, stations, reach, robots, places, most=16).collect()}
    assert got == {**{("r", f"p{i}"): i if i <= 16 else far for i in range(20)}, **{("idle", f"p{i}"): far if i else 0 for i in range(20)}}
    got = {x.loc: x.distance for x in graph.station_distance(edges, stations, reach).collect()}
    assert got == {f"p{i}": i for i in range(21)}


def test_tokens_meet_spans_in_one_sort(spark):
    tokens = [(k, i, 3 * i, 3 * i + 2 + i % 3) for k in ("a", "b", None) for i in range(30)]
    spans = [("a", 1, 3), ("a", 2, 40), ("a", 50, 51), ("b", 89, 95), ("c", 0, 9), (None, 0, 90)]
    t = spark.createDataFrame(tokens, "k string, pos int, char_start int, char_end int")
    got = difficulty.in_spans(t, spark.createDataFrame(spans, "k string, begin int, end int"), "k")
    assert {(r.k, r.pos, r.in_tag) for r in got.collect()} == {(k, p, k is not None and any(k == s and a < e and z > b for s, b, e in spans)) for k, p, a, z in tokens}
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()  # tokens times spans of a long page
    rows = [(0, [3, 1, 2]), (1, []), (2, None), (3, [5]), (4, [1] * 9)]
    sums = spark.createDataFrame(rows, "i int, n array<int>").coalesce(1).select("i", difficulty.sums_before("n").alias("s"))
    assert {r.i: r.s or [] for r in sums.collect()} == {0: [0, 3, 4], 1: [], 2: [], 3: [0], 4: list(range(9))}
    xml = 'é <a b="1">x</a><c/><!-- n --><d>'
    found = difficulty.opening_spans(spark.createDataFrame([(1, xml), (2, "none"), (3, None)], "k int, x string"), "k", "x").collect()
    assert [(r.k, xml[r.begin : r.end]) for r in sorted(found)] == [(1, '<a b="1">'), (1, "<c/>"), (1, "<d>")]


def test_shortest_paths_write_each_pair_once(spark, monkeypatch):
    ring = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "a"), ("f", "g"), ("x", "x")]
    written, write = [], graph.materialize

    def noted(df, name):
        out = write(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(graph, "materialize", noted)
    edges = spark.createDataFrame([*ring, *[(b, a) for a, b in ring]], "src string, dst string")
    got = {(r.src, r.dst): (r.n, r.path) for r in graph.shortest(edges).collect()}
    assert len(got) == 42 and got["a", "d"] == (3, "a>b>c>d") and got["g", "c"] == (4, "g>f>a>b>c") and got["e", "b"] == (3, "e>d>c>b")
    assert sum(n for name, n in written if name != "links") == len(got)


def test_shortest_paths_of_the_query_write_no_pair(spark, sf, monkeypatch):
    written, write = [], storage.materialize

    def noted(df, name):
        written.append(name)
        return write(df, name)

    monkeypatch.setattr(storage, "materialize", noted)
    monkeypatch.setattr(graph, "materialize", noted)
    assert contract.queries()["bfs_shortest"](spark, sf).count() and written == ["links"]


def test_searches_from_each_place_find_the_same_paths(spark, monkeypatch):
    """Ways of one direction, ties by name (s10 before s1 where a sign follows), parts without a way, nulls, loops, repeated rows; batches of a few rows."""
    r = np.random.default_rng(5)
    rows = [(f"s{a}", f"s{b}") for a, b in r.integers(0, 40, (70, 2)).tolist()] + [("a", "s1"), ("a", "s10"), ("s1", "é"), ("s10", "é"), ("x", "y"), ("é", None), (None, "a"), ("a", "s1")]
    edges = lambda more=(): spark.createDataFrame([*rows, *more], "src string, dst string")
    found = lambda df: sorted(tuple(x) for x in df.select("src", "dst", "n", "path").collect())
    want = found(graph.shortest(edges()))
    assert len(want) > 300 and ("a", "é", 2, "a>s10>é") in want
    monkeypatch.setattr(graph, "ROWS", 3)
    got = graph.shortest_from_each(edges())
    assert found(got) == want and "MapInArrow" in got._jdf.queryExecution().toString()
    larger = graph.shortest_from_each(edges(), most_bytes=100)
    assert found(larger) == want and "MapInArrow" not in larger._jdf.queryExecution().toString()
    assert found(graph.shortest_from_each(edges([("x>", "x")]))) == sorted([*want, ("x>", "x", 1, "x>>x"), ("x>", "y", 2, "x>>x>y")])
    assert found(graph.shortest_from_each(edges().limit(0))) == []
