import math
import random
import zlib

import numpy as np
import pytest

from corvane.llm import bands

LINE = "sale_id long, line_no int, item_id long, quantity int, amount double, u long, id long"
ITEM = "item_id long, price double, u long, part int"


def cents(x):
    return None if x is None or not math.isfinite(x) else math.floor(100 * x + 0.5)


def brute(lines, items, most=10, apart=50, per_mille=5):
    out = []
    for item, price, *_ in items:
        p, pairs, crc = cents(price), [], 0
        for sale, no, of, q, amount, *_ in lines:
            a = cents(amount)
            if p is None or None in (sale, of, q, a) or q == 0 or of == item:
                continue
            u = (2 * a + q) // (2 * q)
            if abs(u - p) <= apart or 1000 * abs(u - p) <= per_mille * min(u, p):
                pairs.append((abs(u - p), u, sale, -(1 << 70) if no is None else no, of))
                crc += zlib.crc32(",".join(str(x) for x in (sale, no, of) if x is not None).encode())
        total = (len(pairs), sum(x[0] for x in pairs), crc)
        first = [(*x[:3], None if x[3] == -(1 << 70) else x[3], x[4]) for x in sorted(pairs)[:most]] or [(None,) * 5]
        out += [(item, k + bool(pairs), *x, *total) for k, x in enumerate(first)]
    return sorted(out, key=str)


def got(spark, lines, items, **how):
    df = bands.near_prices(spark.createDataFrame(lines, LINE).repartition(3), spark.createDataFrame(items, ITEM).repartition(2), **how)
    return sorted((tuple(r) for r in df.collect()), key=str)


def line(r, items, prices):
    of, q = r.choice(items), r.choice([1, 1, 2, 3, 7, -2])
    price = r.choice(prices)
    return (r.randint(1, 40), r.choice([None, 1, 2, 3]), of, q, round(price * q * r.choice([1, 1, 1.001, 0.99]), 2), 0, 0)


@pytest.mark.parametrize("seed", range(3))
def test_all_pairs_by_brute_force(spark, seed):
    """Hot prices, an item with a third of all lines, dear and cheap items, nulls, repeated lines and items."""
    r = random.Random(seed)
    ids, prices = list(range(1, 25)), [1.0, 1.3, 2.49, 2.5, 10.0, 99.99, 100.0, 100.4, 103.0, 400.0, 401.9, 0.0, -1.0]
    lines = [line(r, [1] if k % 3 == 0 else ids, prices[:3] if seed == 1 else prices) for k in range(500)]
    lines += [lines[5]] * 15 + [(None, 1, 2, 1, 1.0, 0, 0), (3, 1, None, 1, 1.0, 0, 0), (3, 1, 2, None, 1.0, 0, 0), (3, 1, 2, 1, None, 0, 0), (3, 1, 2, 0, 1.0, 0, 0)]
    lines += [(3, 1, 2, 1, math.nan, 0, 0), (3, 1, 2, 1, math.inf, 0, 0), (3, 1, 2, 1, 1e300, 0, 0)]
    items = [(k, r.choice(prices), 0, 0) for k in ids] + [(1, 100.0, 0, 0), (1, 100.0, 0, 0), (None, 2.5, 0, 0), (7, None, 0, 0), (8, math.nan, 0, 0), (9, 5e6, 0, 0)]
    want = brute([x for x in lines if x[4] != 1e300], items)
    assert got(spark, lines, items) == want
    assert got(spark, lines, items, most=2, apart=0, per_mille=40) == brute([x for x in lines if x[4] != 1e300], items, 2, 0, 40)


def test_empty_tables(spark):
    items = [(1, 2.0, 0, 0), (2, None, 0, 0)]
    assert got(spark, [], items) == [(1, 0, *[None] * 5, 0, 0, 0), (2, 0, *[None] * 5, 0, 0, 0)]
    assert got(spark, [(1, 1, 1, 1, 2.0, 0, 0)], []) == []


def test_cursors_pass_over_long_runs_of_own_lines(spark):
    """Only the very first partition holds another item's lines; all between are the item's own."""
    lines = [(k, 1, 2, 1, 90.0, 0, 0) for k in range(3)] + [(k, k % 5, 1, 1, 90.01 + k / 100, 0, 0) for k in range(900)]
    items = [(1, 99.5, 0, 0), (2, 99.5, 0, 0), (3, 90.45, 0, 0)]
    assert got(spark, lines, items, apart=2000) == brute(lines, items, apart=2000)


def test_intervals_are_exact(spark):
    rows = [(p,) for p in [*range(-300, 300), *range(9_900, 10_200), 1_000_000, 12_345_678]]
    for apart, per_mille in ((50, 5), (0, 7), (3, 1000)):
        least, most = bands.interval(bands.F.col("p"), apart, per_mille)
        for r in spark.createDataFrame(rows, "p long").select("p", least.alias("a"), most.alias("b")).collect():
            near = lambda u, p=r.p, a=apart, m=per_mille: abs(u - p) <= a or 1000 * abs(u - p) <= m * min(u, p)
            assert near(r.a) and near(r.b) and not near(r.a - 1) and not near(r.b + 1), r


def test_the_last_lines_are_enough():
    r = np.random.default_rng(3)
    for _ in range(100):
        held = np.stack([np.sort(r.integers(0, 50, 60)), *r.integers(0, 9, (2, 60)), r.choice([1, 1, 1, 2, 3], 60)], 1)
        kept = bands._last(held, 4)
        assert len(kept) <= 8
        for own in (1, 2, 3, 9):
            want = [tuple(x) for x in held[::-1] if x[3] != own][:4]
            assert [tuple(x) for x in kept[::-1] if x[3] != own][:4] == want
