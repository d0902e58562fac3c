import bisect
import random
from collections import Counter, defaultdict

import numpy as np

from corvane.llm import best_fit, packing
from tests.llm.test_tokens_packing import check_packing, ids


def plain(lengths, window):
    """Best-fit decreasing, one piece after the other: the number of windows, and the free places of those that are not full."""
    free, made = [], 0
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(free, n)
        made += k == len(free)
        room = (window if k == len(free) else free.pop(k)) - n
        if room:
            bisect.insort(free, room)
    return made, free


def filled(lengths, window):
    counts = Counter(lengths)
    of, ranks = [], []
    for n, k in counts.items():
        of += [n] * k
        ranks += range(k)
    windows, offsets = best_fit.place(best_fit.plan(counts, window), np.array(of, np.int64), np.array(ranks, np.int64))
    used = defaultdict(int)
    for w, at, n in sorted(zip(windows.tolist(), offsets.tolist(), of, strict=True)):
        assert used[w] == at  # without a gap
        used[w] += n
    return used


def test_plan_is_what_one_piece_after_the_other_gives():
    r = random.Random(11)
    for _ in range(200):
        window = r.choice([7, 10, 64, 2047, 2048])
        lengths = [r.randint(1, window) if r.random() < 0.7 else r.choice([1, window // 2 + 1, window // 3 + 1, window]) for _ in range(r.randint(1, 300))]
        used = filled(lengths, window)
        made, free = plain(lengths, window)
        assert len(used) == made and sorted(window - x for x in used.values() if x < window) == free


def test_plan_does_not_grow_with_the_counts():
    r = random.Random(5)
    few, many = ({k: r.randint(1, n) for k in range(1, 2049)} for n in (1_000, 1_000_000_000))
    assert len(best_fit.plan(many)) < 10_000 and len(best_fit.plan(few)) < 10_000
    assert len(best_fit.plan({})) == 0


def test_tightest_free_places():
    tree, held = best_fit.FreePlaces(100), set()
    r = random.Random(2)
    for _ in range(2000):
        free = r.randint(0, 100)
        tree.mark(free, there := r.random() < 0.3)
        (held.add if there else held.discard)(free)
        length = r.randint(0, 100)
        assert tree.tightest(length) == min((x for x in held if x >= length), default=None)


def test_packing_is_an_exact_round_trip(spark, held):
    rows = {r[0]: r[1] for r in held if r[0] is not None}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    texts = {k: [*ids(t), 0] for k, t in rows.items()}
    for window in (2048, 64):
        got = best_fit.pack(docs, window=window).collect()
        lengths = check_packing(got, texts, window)
        pieces = [min(window, len(t) - at) for t in texts.values() for at in range(0, len(t), window)]
        assert sorted(p.length for p in got) == sorted(pieces)
        assert len(lengths) == plain(pieces, window)[0]
        assert all(p.start == p.piece * window for p in got)


def test_repeated_ids_nulls_and_names_of_ours(docs, held, none):
    pieces = best_fit.pack(docs).collect()
    assert sum(p.length for p in pieces) == sum(len(ids(r[1])) + 1 for r in held)
    assert len({(p.sequence_id, p.offset) for p in pieces}) == len(pieces)
    assert best_fit.pack(none).collect() == [] and best_fit.pack(none).columns == best_fit.pack(docs).columns
    clash = docs.selectExpr("doc_id", "text", "1 as part", "2 as at", "3 as piece", "4 as length", "'x' as before")
    assert best_fit.pack(clash).count() == len(pieces)


def test_fewer_windows_than_online(docs):
    n = lambda df: df.select("sequence_id").distinct().count()
    assert n(best_fit.pack(docs)) <= 1.35 * n(packing.pack(docs))  # whole documents, and so few of them
