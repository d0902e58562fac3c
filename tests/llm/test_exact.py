import hashlib
from collections import defaultdict

import numpy as np
import pytest

from corvane.llm import exact_dedup as E


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        first = True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and first, hashlib.sha256(text.encode()).hexdigest()))
            first = first and i != keep
    return out


def key(r):
    return tuple((x is None, x) for x in r)


@pytest.mark.parametrize("options", [{}, {"chunk": 64}, {"hashes": ((3, 2), (2, 1)), "chunk": 16}], ids=["default", "small chunks", "colliding hashes"])
def test_report_is_the_brute_force_result(docs, held, options):
    got = [tuple(r) for r in E.report(docs, **options).collect()]
    assert sorted(got, key=key) == sorted(expected(held), key=key)


def test_hashes_compose():
    data = np.random.default_rng(0).integers(0, 256, 10_001, np.uint8).tobytes()
    for p, b in E.HASHES:
        table = E.powers(p, b, 4000)
        whole = E.chunk_hash(data, p, table)
        head, tail = data[:4096], data[4096:]
        assert (E.shift(E.chunk_hash(head, p, table), -(-len(tail) // 4), p, b) + E.chunk_hash(tail, p, table)) % p == whole


def test_deduplicate_keeps_one_row_of_each_text(docs, held):
    got = E.deduplicate(docs)
    assert got.columns == docs.columns
    texts = [r.text or "" for r in got.collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {r[1] or "" for r in held}


def test_empty(none):
    assert E.report(none).collect() == [] and E.deduplicate(none).collect() == []
