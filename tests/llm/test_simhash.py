import re
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from corvane.llm import simhash as S
from corvane.llm.components import components


def brute(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    shingles = [" ".join(w)] if len(w) < 4 else [" ".join(w[i : i + 4]) for i in range(len(w) - 3)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(values):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(parent)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in order}


def test_report_is_the_brute_force_result(docs, held):
    fp = [(r[0], brute(r[1])) for r in held]
    root, least = roots({f for _, f in fp}), defaultdict(list)
    for i, f in fp:
        if i is not None:
            least[root[f]].append(i)
    want = sorted(((i, f"{f:016x}", min(least[root[f]], default=None)) for i, f in fp), key=str)
    assert sorted((tuple(r) for r in S.report(docs).collect()), key=str) == want


def test_links_lose_no_component(spark):
    r = np.random.default_rng(5)
    base = [int(x) for x in r.integers(0, 1 << 63, 40)]
    values = set(base)
    for b in base[:12]:  # dense groups, chains, and neighbours at distance 5 that must stay apart
        x = b
        for _ in range(25):
            for bit in r.choice(64, r.integers(1, 6), replace=False):
                x ^= 1 << int(bit)
            values.add(x)
            if r.random() < 0.5:
                x = b
    for i in range(64):
        values.add(base[20] ^ (1 << i))
    nodes = spark.createDataFrame([(S._signed(v),) for v in values], "fp long")
    got = {x.node % (1 << 64): x.root for x in S.links(nodes).collect()}
    want = roots(values)
    groups = defaultdict(set)
    for v in values:
        groups[got.get(v, ("alone", v))].add(v)
    expected = defaultdict(set)
    for v, top in want.items():
        expected[top].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_key_masks_catch_every_small_difference():
    r, masks = np.random.default_rng(1), S.key_masks()
    ring = S._ring()
    for _ in range(3000):
        d = 0
        for b in r.choice(64, r.integers(0, 5), replace=False):
            d |= 1 << int(b)
        chains = []
        for i, mask in masks:
            ok, held = d & mask == 0, 0
            for n in range(1, 6):
                held |= S._mask(*ring[(i + n - 1) % 5])
                ok = ok and (d & held).bit_count() <= 4 * n // 5
            chains.append(ok)
        assert any(chains)


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (11, 12), (12, 10), (5, 5), *((100, k) for k in range(101, 140))]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[1], got[2], got[3]}) == 1 and got[10] == got[12] != got[1]
    assert len({got[k] for k in range(100, 140)}) == 1 and 5 not in got


def test_deduplicate(docs, held):
    kept = S.deduplicate(docs)
    assert kept.columns == docs.columns
    assert kept.count() == S.report(docs).select(F.coalesce("component_id", F.lit(-1))).distinct().count()


def test_empty(none):
    assert S.report(none).collect() == [] and S.deduplicate(none).collect() == []


def test_components_run_three_plans_a_round(spark):
    """The driver keeps every plan that has run: edges are counted as they are written, and labels go with them."""
    chain = [(k, k + 1) for k in range(64)]
    ran = lambda: spark._jsparkSession.sharedState().statusStore().executionsCount()
    before, read = ran(), spark.createDataFrame(chain, "a long, b long")
    out = components(read)
    made = ran() - before
    assert made <= 1 + 3 * 32  # a chain of 64 links takes 32 rounds, which were 163 plans
    assert {r.root for r in out.collect()} == {0} and out.count() == 65
    assert components(spark.createDataFrame([(3, 3)], "a long, b long")).collect() == []
