import re
from collections import Counter

import corvane.llm.queries as Q
import corpus_pipeline as P


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == columns
        if k == 1:
            assert docs.select("text").distinct().count() == counts[-1]
        if k == 2:
            kept = docs
            assert docs.select("doc_id").distinct().count() == counts[-1]
        if k == 3:
            words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
            size, taken = {r.doc_id: words(r.text) for r in kept.collect()}, Counter()
            for r in docs.collect():
                taken[r.doc_id] += words(r.text)
            assert all(n <= 2 * size[i] for i, n in taken.items())
            assert abs(sum(taken.values()) - 1.5 * sum(size.values())) < 0.03 * sum(size.values())
    assert counts[0] >= counts[1] >= counts[2] >= counts[3]
    lines = Counter()
    for r in docs.collect():
        lines[r.sequence_id] += r.length
    padding = sum(2048 - n for n in lines.values())
    assert max(lines.values()) <= 2048 and padding <= 2048 + 0.01 * sum(lines.values())


def test_edge_cases_have_their_results(spark, docs, none, held, sf):
    """Nulls, blank, long and repeated rows, and columns named like ours: what each stage does with them."""
    rows, columns = docs, docs.columns
    texts, by_stage = {r[1] or "" for r in held}, []
    for _, stage in P.STAGES[:-1]:
        rows = stage(spark, rows, sf)
        by_stage.append(rows.collect())
        assert rows.columns == columns
    clean, exact, near, mixed = by_stage
    assert len(clean) == len(held)
    assert sorted(r.text or "" for r in exact) == sorted(texts)
    largest = {t: max((r[0] for r in held if (r[1] or "") == t), key=lambda x: (x is not None, x)) for t in texts}
    assert all(r.doc_id == largest[r.text or ""] for r in exact)
    blank = [r for r in near if not (r.text or "").strip()]
    assert len(blank) == 1 and len(near) < len(exact) and {str(r) for r in near} <= {str(r) for r in exact}
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in near} and all(r.fp == "f" for r in mixed)
    pieces = P.pack_sequences(spark, spark.createDataFrame(mixed, docs.schema), sf).collect()
    assert sum(p.start == 0 for p in pieces) == len(mixed)
    for _, stage in P.STAGES:
        none = stage(spark, none, sf)
    assert none.collect() == []


def test_every_operator_has_a_query():
    assert [n for n in Q.queries() if n != "pipeline"] == sorted((n for n in Q.queries() if n != "pipeline"), key=lambda n: int(n[2:].split("_")[0]))
    assert len(Q.queries()) == 14
