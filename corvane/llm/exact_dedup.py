"""Exact duplicates by composable polynomial fingerprints.

A text is cut into chunks of CHUNK bytes. Each chunk gets two polynomial hashes of its 32-bit
words, modulo two primes below 2**31. Hashes of neighbouring chunks compose: the hash of a whole
text is the sum of its chunks' hashes, each shifted by the base to the number of words behind it.
So a huge text is hashed chunk by chunk, where it is read, and only 16-byte hashes meet.

Texts of equal length and equal fingerprints are then compared byte by byte, chunk by chunk:
chunks of equal hash meet in a partial minimum and maximum, which must agree. A third of all rows
in one group thus costs one chunk for each task, never a group in one task. Only texts that may
have a copy are read for that; a bitmap of bounded size picks them out.

Defined results: null counts as the empty text. Rows that repeat a doc_id together with its text
are copies, and one of them stays. A null doc_id loses to any other. An empty table gives an empty
result. Columns beside doc_id and text are carried by the kept rows and may have any name; of rows
that repeat both, which differ in other columns, one stays, the same in every run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import build_filter, carried, counted, materialize, one_row, text_or_empty, with_filter

CHUNK = 65_536
#: (modulus, base) of the two hashes.
HASHES = ((2_147_483_647, 1_000_003), (2_147_483_629, 69_069_069))


def powers(prime: int, base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo prime."""
    out = np.empty(n, np.uint64)
    out[:1] = 1
    have = 1
    while have < n:
        step = pow(base, have, prime)
        take = min(have, n - have)
        out[have : have + take] = out[:take] * np.uint64(step) % np.uint64(prime)
        have += take
    return out


def chunk_hash(data: bytes, prime: int, table: np.ndarray) -> int:
    """The polynomial of the chunk's little-endian words, zero bytes filling up the last."""
    words = np.frombuffer(data + b"\0" * (-len(data) % 4), "<u4").astype(np.uint64)
    if not len(words):
        return 0
    return int((words * table[len(words) - 1 :: -1][: len(words)] % np.uint64(prime)).sum() % np.uint64(prime))


def shift(value: int, words: int, prime: int, base: int) -> int:
    """The hash of a chunk with that many words behind it, as a part of the whole text's hash."""
    return value * pow(base, words, prime) % prime


def _hash_udf(hashes, chunk: int):
    tables: dict = {}

    @F.arrow_udf("struct<c1: long, c2: long, s1: long, s2: long>")
    def hashed(data: pa.Array, behind: pa.Array) -> pa.Array:
        if not tables:
            tables.update({k: powers(p, b, chunk // 4 + 1) for k, (p, b) in enumerate(hashes)})
        out = [[], [], [], []]
        for piece, words in zip(data, behind.to_pylist(), strict=True):
            raw = piece.as_buffer().to_pybytes()
            for k, (p, b) in enumerate(hashes):
                value = chunk_hash(raw, p, tables[k])
                out[k].append(value)
                out[2 + k].append(shift(value, words, p, b) if words else value)
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in out], ["c1", "c2", "s1", "s2"])

    return hashed


def _key() -> list[Column]:
    """Rows of the same doc_id and text share this; it only names rows, it doesn't group texts."""
    text = text_or_empty()
    return [F.octet_length(text).cast("long").alias("n_bytes"), F.xxhash64(text).alias("row_hash")]


def _chunks(df: DataFrame, chunk: int) -> DataFrame:
    """One row for each chunk of each text, the empty text having one empty chunk."""
    last = F.greatest(F.floor((F.col("n_bytes") - 1) / chunk), F.lit(0)).cast("int")
    pieces = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(i.alias("no"), F.substring(F.col("_raw"), i * chunk + 1, F.lit(chunk)).alias("data")),
    )
    words = F.ceil(F.col("n_bytes") / 4)
    return (
        df.withColumn("_raw", F.to_binary(text_or_empty(), F.lit("utf-8")))
        .withColumn("_piece", F.explode(pieces))
        .drop("_raw", "text")
        .withColumn("_behind", F.greatest(words - (F.col("_piece.no") + 1).cast("long") * (chunk // 4), F.lit(0)).cast("long"))
    )


def fingerprints(docs: DataFrame, hashes=HASHES, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(one row for each doc_id and text with its fingerprint, one row for each of its chunks)."""
    hashed = _hash_udf(hashes, chunk)
    rows = docs.select("doc_id", "text", *_key())
    rows = rows.withColumn("text_sha256", F.sha2(F.to_binary(text_or_empty(), F.lit("utf-8")), 256))
    pieces = _chunks(rows, chunk).withColumn("_h", hashed("_piece.data", "_behind"))
    (p1, _), (p2, _) = hashes
    key = ["doc_id", "n_bytes", "row_hash"]
    pieces = materialize(
        pieces.select(*key, "text_sha256", F.col("_piece.no").alias("no"), "_h.c1", "_h.c2", "_h.s1", "_h.s2"), "chunk-hashes"
    )
    copies = F.count_if(F.col("no") == 0)
    whole = pieces.groupBy(*key, "text_sha256").agg(
        copies.alias("copies"),
        F.expr(f"(sum(s1) div count_if(no = 0)) % {p1}").alias("h1"),
        F.expr(f"(sum(s2) div count_if(no = 0)) % {p2}").alias("h2"),
    )
    return materialize(whole, "fingerprints"), pieces


FINGERPRINT = ["n_bytes", "h1", "h2"]


def classes(docs: DataFrame, hashes=HASHES, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(rows with their fingerprint and variant, classes of equal texts with keep_id and size).

    variant is null but for texts that share a fingerprint and differ: there it is the text.
    """
    whole, pieces = fingerprints(docs, hashes, chunk)
    again = materialize(
        whole.groupBy(*FINGERPRINT).agg(F.sum("copies").alias("n"), F.count("*").alias("_rows")).where("n > 1"), "repeated"
    )
    repeated = whole.join(again.where("_rows > 1").select(*FINGERPRINT), FINGERPRINT, "left_semi")
    n = again.agg(F.sum("_rows")).first()[0] or 0
    bad = differing(docs, repeated, pieces, n, hashes, chunk)
    rows = whole.withColumn("variant", F.lit(None).cast("string"))
    if bad is not None:
        # texts that differ under one fingerprint: told apart by the texts themselves
        key = ["doc_id", "n_bytes", "row_hash"]
        texts = docs.select("doc_id", text_or_empty().alias("text"), *_key())
        marked = whole.join(bad, FINGERPRINT, "left_semi").select(*[F.col(k).alias(f"_{k}") for k in key])
        named = texts.join(marked, F.expr(" and ".join(f"{k} <=> _{k}" for k in key)), "left_semi").distinct()
        named = named.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("text").alias("_text"))
        rows = (
            whole.join(named, F.expr(" and ".join(f"{k} <=> _{k}" for k in key)), "left")
            .withColumn("variant", F.col("_text"))
            .drop("_text", *[f"_{k}" for k in key])
        )
    groups = rows.groupBy(*FINGERPRINT, "variant").agg(
        F.max(F.struct("doc_id", "row_hash")).alias("_keep"), F.sum("copies").alias("group_size")
    )
    return rows, groups.select(*FINGERPRINT, "variant", "_keep", F.col("_keep.doc_id").alias("keep_id"), "group_size")


def differing(docs: DataFrame, repeated: DataFrame, pieces: DataFrame, n: int, hashes, chunk: int) -> DataFrame | None:
    """Fingerprints under which texts differ, found chunk by chunk; None if there are none."""
    if not n:
        return None
    key = ["n_bytes", "row_hash"]
    table, width = build_filter(F.struct(*key), repeated, n)
    maybe = with_filter(docs.select("text", *_key()), F.struct(*key), table, width).where("_maybe").drop("_maybe")
    hashed = _hash_udf(hashes, chunk)
    data = _chunks(maybe, chunk).select(F.col("_piece.data").alias("data"), hashed("_piece.data", "_behind").alias("h"))
    unequal = (
        data.groupBy(F.octet_length("data").alias("size"), "h.c1", "h.c2")
        .agg(F.min("data").alias("least"), F.max("data").alias("most"))
        .where("least != most")
        .select("c1", "c2")
    )
    unequal, n_unequal = counted(unequal, "unequal-chunks")
    of = repeated.select("doc_id", "n_bytes", "row_hash", "h1", "h2")
    on = F.expr("doc_id <=> _d and n_bytes = _n and row_hash = _r")
    own = pieces.select(F.col("doc_id").alias("_d"), F.col("n_bytes").alias("_n"), F.col("row_hash").alias("_r"), "no", "c1", "c2")
    long = own.where(F.col("_n") > chunk).join(of, on).groupBy(*FINGERPRINT, "no")
    split = long.agg(F.min(F.struct("c1", "c2")).alias("a"), F.max(F.struct("c1", "c2")).alias("b")).where("a != b").select(*FINGERPRINT)
    bad = split
    if n_unequal:
        bad = bad.union(own.join(unequal, ["c1", "c2"], "left_semi").join(of, on).select(*FINGERPRINT))
    bad, n_bad = counted(bad.distinct(), "differing")
    return bad if n_bad else None


def _join(rows: DataFrame, groups: DataFrame) -> DataFrame:
    g = groups.select(*[F.col(c).alias(f"_{c}") for c in (*FINGERPRINT, "variant")], "_keep", "keep_id", "group_size")
    on = " and ".join([*(f"{c} = _{c}" for c in FINGERPRINT), "variant <=> _variant"])
    return rows.join(g, F.expr(on))


def report(docs: DataFrame, hashes=HASHES, chunk: int = CHUNK) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows, groups = classes(docs, hashes, chunk)
    first = F.struct("doc_id", "row_hash") == F.col("_keep")
    return (
        _join(rows, groups)
        .withColumn("_own", first)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select("doc_id", "keep_id", F.col("group_size").cast("long"), (F.col("_own") & (F.col("_copy") == 1)).alias("kept"), "text_sha256")
    )


def deduplicate(docs: DataFrame, hashes=HASHES, chunk: int = CHUNK) -> DataFrame:
    """The rows that stay, with all their columns.

    Rows without a copy pass straight through; only those that may have one are shuffled, and
    they meet in a partial maximum.
    """
    rows, groups = classes(docs, hashes, chunk)
    several, n = counted(_join(rows, groups.where("group_size > 1")).select(
        "doc_id", "n_bytes", "row_hash", (F.struct("doc_id", "row_hash") == F.col("_keep")).alias("stays")), "copies")
    if not n:
        return docs
    table, width = build_filter(F.struct("n_bytes", "row_hash"), several, n)
    rows = carried(docs, "doc_id", "text").select("doc_id", "_all", *_key())
    marked = with_filter(rows, F.struct("n_bytes", "row_hash"), table, width)
    look = several.select(F.col("doc_id").alias("_d"), F.col("n_bytes").alias("_n"), F.col("row_hash").alias("_r"), "stays").distinct()
    maybe = marked.where("_maybe").join(look, F.expr("doc_id <=> _d and n_bytes = _n and row_hash = _r"), "left")
    kept = maybe.where("stays").groupBy("_d", "_n", "_r").agg(one_row(docs))
    return marked.where("not _maybe").select("_all.*").union(maybe.where("stays is null").select("_all.*")).union(kept.select("_all.*"))
