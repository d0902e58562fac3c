import random
import struct
import zlib
from collections import defaultdict

import pytest

from corvane.llm import packing, tokens


def ids(text):
    return tokens.tokenizer(tokens.tokenizer_path()).encode(text or "", add_special_tokens=False).ids


def test_counts_are_the_tokenizers(docs, held):
    got = sorted((tuple(r) for r in tokens.report(docs).collect()), key=str)
    want = sorted(((r[0], len((r[1] or "").encode()), len(ids(r[1])), len(ids(r[1])) > 2048) for r in held), key=str)
    assert got == want


def test_cache_agrees_with_the_tokenizer_on_odd_strings():
    letters = [*"aZé'sß中<|>endoftext 12\t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　́​Σİ\x00😀", "<|endoftext|>", "<|STARTOFTEXT|>", "'s", "'ll", " ́"]
    r, cache = random.Random(3), tokens.Cache(tokens.tokenizer_path(), len, sum)
    for _ in range(1500):
        text = "".join(r.choices(letters, k=r.randint(0, 30)))
        assert tokens._count(cache, text) == len(ids(text)), text


def test_other_tokenizers_are_asked_for_whole_texts(docs, held):
    import sentencepiece

    path = tokens.tokenizer_path("byte_bpe_50k.json")
    assert tokens.cuts_at_space(tokens.tokenizer_path()) and not tokens.cuts_at_space(path)
    want = sorted(len(tokens.tokenizer(path).encode(r[1] or "", add_special_tokens=False).ids) for r in held)
    assert sorted(r.n_tokens for r in tokens.report(docs, path).collect()) == want
    path = tokens.tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert sorted(r.n_tokens for r in tokens.report(docs, path).collect()) == sorted(len(model.encode(r[1] or "")) for r in held)
    with pytest.raises(ValueError, match="white space"):
        packing.ids_of(path, "a b")


def test_counts_do_not_depend_on_the_table(docs, held, monkeypatch):
    want = sorted(len(ids(r[1])) for r in held)
    for tasks, rows in ((1, 5), (64, 1)):
        monkeypatch.setattr(tokens.frequent, "__defaults__", (rows, 3, tasks))
        assert sorted(r.n_tokens for r in tokens.report(docs).collect()) == want


def test_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ROWS", 5)
    cache = tokens.Cache(tokens.tokenizer_path(), len, sum)
    for k in range(50):
        text = f"word{k} again {k} word{k % 7}"
        assert tokens._count(cache, text) == len(ids(text)) and len(cache) <= 6


def check_packing(pieces, texts, window=2048):
    docs, lines = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append(p)
        lines[p.sequence_id].append(p)
    for doc, want in texts.items():
        at = 0
        for p in sorted(docs[doc], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want) and p.ids_crc32 == zlib.crc32(struct.pack(f"<{p.length}I", *want[at : at + p.length]))
            at += p.length
        assert at == len(want)
    lengths = []
    for line in lines.values():
        at = 0
        for p in sorted(line, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= window
        lengths.append(at)
    return lengths


def test_packing_is_an_exact_round_trip(spark, held):
    rows = {r[0]: r[1] for r in held if r[0] is not None}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    texts = {k: [*ids(t), 1] for k, t in rows.items()}
    lengths = check_packing(packing.pack(docs).collect(), texts)
    assert sum(x < 2048 for x in lengths) <= 1
    check_packing(packing.pack(docs, window=64, most_open=2, least_cut=8).collect(), texts, 64)


def test_repeated_ids_and_nulls_are_documents(docs, held):
    pieces = packing.pack(docs).collect()
    assert sum(p.length for p in pieces) == sum(len(ids(r[1])) + 1 for r in held)


def test_best_fit_keeps_few_windows_open():
    packer = packing.Packer(10, 3, 2)
    for k in range(200):
        for _ in packer.add(k, struct.pack("<7I", *range(7))):
            pass
        assert len(packer.free) <= 3


def test_empty(none):
    assert tokens.report(none).collect() == [] and packing.pack(none).collect() == []
