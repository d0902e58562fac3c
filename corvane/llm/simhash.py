"""SimHash near duplicates, candidates by pigeonring chains.

A fingerprint's 64 bits lie on a ring of SEGMENTS = 5 segments. If two fingerprints differ in at
most 4 bits, then some segment starts a chain whose first l segments hold at most 4 * l / 5
differences, for each l: none in the first, one at most in the first two, two in three, three in
four, four in all. Candidates must agree on the first segment and on two of three pieces of the
second (of which one piece at most may differ), which makes 15 keys of some 21 bits; the rest of
the chain and the full distance are tested inside the join.

Documents with the same fingerprint are one node. Links are wanted for connectedness alone, so a
bucket does not emit its pairs: its members link to the bucket's least, largest and a drawn
member; after the components of those links are known, only members of buckets that still hold
several components are compared, across components. No candidate is left out.

Defined results: a null or blank text has the fingerprint zero, which links like any other. A null
doc_id is never the smallest of a component that has another. An empty table gives an empty result.
Other columns are carried by the rows that stay and may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import near_copies
from corvane.llm.common import counted, keep_least, materialize, text_or_empty
from corvane.llm.components import components

DISTANCE = 4
SEGMENTS = 5
SHINGLE = 4
SEED = 42
_UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, as a signed 64-bit number."""
    words = text.translate(_UPPER).split()  # of bytes: at the six ASCII white-space characters only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[: len(words) - shingle] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes; counted in blocks, so that memory is bounded."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[at : at + 4096, None].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def _simhash_udf(shingle: int):
    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([simhash(t.as_buffer().to_pybytes(), shingle) for t in texts], pa.int64())

    return of


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, row_hash (names the row within its doc_id), fp."""
    text = text_or_empty()
    of = _simhash_udf(shingle)
    return materialize(docs.select("doc_id", F.xxhash64(text).alias("row_hash"), of(text).alias("fp")), "simhash")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _ring() -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    out, at = [], 0
    for i in range(SEGMENTS):
        width = (64 + SEGMENTS - 1 - i) // SEGMENTS
        out.append((at, width))
        at += width
    return out


def _mask(at: int, width: int) -> int:
    return ((1 << width) - 1) << at


def key_masks() -> list[tuple[int, int]]:
    """(starting segment, mask of the bits that must agree) of each key."""
    ring, out = _ring(), []
    for i in range(SEGMENTS):
        at, width = ring[(i + 1) % SEGMENTS]
        cuts = [at + width * p // 3 for p in range(4)]
        out += [(i, _mask(*ring[i]) | (_mask(at, width) & ~_mask(a, b - a))) for a, b in zip(cuts, cuts[1:], strict=False)]
    return out


def chain_holds(difference: Column, tag: Column) -> Column:
    """Whether the chain from the key's first segment stays within its budgets, and all bits within DISTANCE."""
    ring = _ring()
    per_start = []
    for i in range(SEGMENTS):
        mask, test = 0, F.lit(True)
        for n in range(1, SEGMENTS + 1):
            mask |= _mask(*ring[(i + n - 1) % SEGMENTS])
            test = test & (F.bit_count(difference.bitwiseAND(F.lit(_signed(mask)))) <= DISTANCE * n // SEGMENTS)
        per_start.append(test)
    of = F.floor(tag / 3)
    out = per_start[-1]
    for i in range(SEGMENTS - 1):
        out = F.when(of == i, per_start[i]).otherwise(out)
    return out


def _keys(nodes: DataFrame) -> DataFrame:
    masks = key_masks()
    keys = F.array(*[F.struct(F.lit(t).alias("tag"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, (_, m) in enumerate(masks)])
    return nodes.select("fp", F.explode(keys).alias("_k")).select("fp", "_k.tag", "_k.key")


def links(nodes: DataFrame) -> DataFrame:
    """(node, root) of every fingerprint that has a neighbour; nodes: distinct fp."""
    keys = _keys(nodes)
    drawn = F.min(F.struct(F.xxhash64("fp", "tag").alias("o"), "fp"))["fp"]
    shared = keys.groupBy("tag", "key").agg(F.min("fp").alias("least"), F.max("fp").alias("most"), drawn.alias("drawn"), F.count("*").alias("n")).where("n > 1")
    members = materialize(keys.join(shared, ["tag", "key"]), "buckets")

    def near(a: str, b: str) -> Column:
        return chain_holds(F.col(a).bitwiseXOR(F.col(b)), F.col("tag"))

    hubs = members.select("fp", "tag", F.explode(F.array_distinct(F.array("least", "most", "drawn"))).alias("hub"))
    found = hubs.where(F.col("fp") != F.col("hub")).where(near("fp", "hub")).select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    known = components(found)

    # buckets of three or more that still hold several components
    open_ = members.where("n > 2").select("tag", "key", "fp").join(known.withColumnRenamed("node", "fp"), "fp", "left")
    open_ = open_.select("tag", "key", "fp", F.coalesce("root", "fp").alias("root"))
    several = open_.groupBy("tag", "key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("tag", "key")
    rest = materialize(open_.join(several, ["tag", "key"], "left_semi"), "open-buckets")
    x = rest.select("tag", "key", F.col("fp").alias("x"), F.col("root").alias("a"))
    y = rest.select("tag", "key", F.col("fp").alias("y"), F.col("root").alias("b"))
    joined = x.join(y, (x.tag == y.tag) & (x.key == y.key) & (x.a < y.b) & chain_holds(F.col("x").bitwiseXOR(F.col("y")), x.tag))
    across = components(joined.select("a", "b"))
    if across.isEmpty():
        return known
    # a root of a known component, or a fingerprint that had no link yet
    everyone = known.select("node", "root").union(across.select(F.col("node"), F.col("node").alias("root")).join(known, "node", "left_anti"))
    top = across.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return materialize(everyone.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "linked")


def classes(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row for each row of docs: doc_id, row_hash, fp, component_id, n (rows of the component)."""
    rows = fingerprints(docs, shingle)
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "nodes")
    root = links(nodes.select("fp")).withColumnRenamed("node", "fp")
    nodes = nodes.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    whole = nodes.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("rows").alias("n"))
    return rows.join(nodes.select("fp", "root").join(whole, "root"), "fp").select("doc_id", "row_hash", "fp", "component_id", "n")


def report(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id."""
    out = classes(docs, shingle)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, like: tuple[int, int] | None = None) -> DataFrame:
    """The rows that stay: of each component the one with the smallest doc_id, with all columns.

    like: a Jaccard likeness of the shingle sets as a fraction (see near_copies), instead of DISTANCE bits.
    """
    if like:
        return near_copies.deduplicate(docs, shingle, like)
    return keep_least(docs, *counted(classes(docs, shingle).where("n > 1"), "near-copies"))
