import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corvane.llm import mixing as M


def fill(sizes):
    """Targets by repeated sharing; sizes in source order."""
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    target, open_, left = [0.0] * len(sizes), set(range(len(sizes))), 1.5 * sum(sizes)
    while open_:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / w >= 2 * sizes[i]}
        if not over:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = 2.0 * sizes[i]
            left -= target[i]
        open_ -= over
    return target


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_targets_and_taken(docs, held):
    got = M.report(docs).collect()
    size = defaultdict(int)
    for r in held:
        size[r[3]] += len(words(r[1]))
    sources = sorted(size, key=lambda s: (s is None, s))
    want = dict(zip(sources, fill([size[s] for s in sources]), strict=True))
    of = defaultdict(set)
    for r in held:
        of[r[0], len(words(r[1]))].add(r[3])
    taken = defaultdict(int)
    for r in got:
        (source, *_) = of[r.doc_id, r.size]
        assert r.source_size == size[source] and r.target == pytest.approx(want[source])
        assert 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
    for s in sources:
        assert taken[s] == pytest.approx(want[s], rel=0.02, abs=3)
    assert sorted(map(str, got)) == sorted(map(str, M.report(docs.repartition(7)).collect()))


def test_apportion_is_sainte_lague(spark):
    votes = [53_000, 24_000, 23_000, 10, 0, 24_000, 1]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(votes)], "party long, v long")
    for seats in (0, 1, 7, 10, 101, 1000):
        seat = F.lit(seats).cast("double")
        got = {r.party: r.won for r in M.apportion(df.withColumn("seats", seat), [], "seats", "v", "party", "won").collect()}
        quotients = sorted(((-v / (2 * s - 1), i, s) for i, v in enumerate(votes) if v for s in range(1, seats + 1)))[:seats]
        assert got == {i: sum(q[1] == i for q in quotients) for i in range(len(votes))}


def test_many_shards_stay_near_the_target(spark):
    rows = [(i, "w " * (1 + i % 50), "hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    got = M.report(spark.createDataFrame(rows, "doc_id long, text string, source string"), shard_rows=100).collect()
    by = defaultdict(lambda: [0, 0.0])
    for r in got:
        by[r.source_size][0] += r.taken
        by[r.source_size][1] = r.target
    for taken, target in by.values():
        assert taken == pytest.approx(target, rel=0.02)


@pytest.mark.parametrize("sources", [1, 3])
def test_short_texts_meet_the_targets_at_default_settings(spark, sources):
    n = 30_000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.expr(f"repeat('w ', cast(if({sources} = 1, 1, 1 + id % 3) as int))").alias("text"), F.expr(f"concat('s', if(id % 2 = 0, 0, id % {sources}))").alias("source"))
    size, taken, said = defaultdict(int), defaultdict(int), {}
    for r in M.report(df).collect():
        source = f"s{0 if r.doc_id % 2 == 0 else r.doc_id % sources}"
        size[source] += r.size
        taken[source] += r.taken
        said[source] = r.target
        assert r.taken <= 2 * r.size
    names = sorted(size)
    for name, want in zip(names, fill([size[s] for s in names]), strict=True):
        assert said[name] == pytest.approx(want) and taken[name] == pytest.approx(want, rel=0.005)


def test_places_are_those_of_listed_blocks(spark):
    """Every word of a ring, against blocks that are written out one by one."""
    for n, rest, q, phase in ((13, 12, 5, 4), (100, 37, 4, 99), (7, 6, 6, 0), (50, 1, 1, 17), (64, 63, 9, 5)):
        marks = []
        for k in range(q):
            stretch, chosen = n // q + (k < n % q), rest // q + (k < rest % q)
            marks += [1] * chosen + [0] * (stretch - chosen)
        df = spark.range(n).select("id", *[F.lit(x).cast("long").alias(c) for c, x in (("shard_size", n), ("rest", rest), ("q", q))])
        at = F.col("id") + phase
        got = [r[0] for r in df.orderBy("id").select((M.words_before(at + 1) - M.words_before(at)).alias("w")).collect()]
        assert sum(got) == rest and got == [marks[(i + phase) % n] for i in range(n)]


def test_mix_gives_what_the_report_says(docs, held):
    out = M.mix(docs)
    assert out.columns == docs.columns
    taken = defaultdict(int)
    for r in out.collect():
        taken[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
    want = defaultdict(int)
    for r in M.report(docs).collect():
        want[r.doc_id] += r.taken
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in want.items() if v}


def test_empty(none):
    assert M.report(none).collect() == [] and M.mix(none).collect() == []
