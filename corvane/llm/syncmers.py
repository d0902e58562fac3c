"""Document fingerprints of closed syncmers.

The letters are words, maximal runs of non-space characters, by their hashes. A word of more than
LONG code points (a sentence of a script without spaces, say) stands for its code points, and in a
text of at most SHORT code points each code point is a letter; so long and short texts have no anchors
in common. A k-mer of K letters is a closed syncmer if the least of its inner s-mers (S letters) is its
first or its last one.
Whether a k-mer is chosen depends on nothing but itself, so the same passage gives the same anchors
wherever it stands. A fingerprint keeps the SKETCH least distinct anchor hashes of the whole text,
each with the place where the anchor stands first. The likeness of two fingerprints compares the
least anchors of both: those in common count if their places agree with the prevailing offset up to
DRIFT words, and the share is taken as 2 c / (a + b) of sets estimated from it.

The next document in descending doc_id is found without a global window: quantiles of doc_id cut
the table into ranges of some RANGE_ROWS rows, each of which gets a copy of the first row of the
range after it, so that one window for each range finds every successor. Texts are shuffled once.

Defined results: null counts as the empty text; without words a fingerprint is empty; two empty fingerprints
have likeness 1, an empty and another one 0. A text of fewer than K letters is one anchor. Blanks count as
letters of short texts only. Rows that repeat
a doc_id follow one another in the order of their texts' hashes; a null doc_id comes last. The only
row of a table is its own successor. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import WORD, text_or_empty

K = 4
S = 2
LONG = 24
SHORT = 256
SKETCH = 64
DRIFT = 16
RANGE_ROWS = 512
MOST_RANGES = 65_536


def with_anchors(df: DataFrame, text: str, out: str, k: int = K, sketch: int = SKETCH) -> DataFrame:
    """df with out: the array of struct<h: long, at: int> of the text's least anchors, ascending."""
    held, size, inner = f"_{out}_letters", f"_{out}_size", f"_{out}_inner"
    every = lambda t: F.regexp_extract_all(t, F.lit(r"(?s)."), F.lit(0))
    words = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    cut = F.flatten(F.transform(words, lambda w: F.when(F.length(w) > LONG, every(w)).otherwise(F.array(w))))
    letters = F.when(F.length(F.col(text)) <= SHORT, every(F.col(text))).when(F.regexp_like(F.col(text), F.lit(f"{WORD[:-1]}{{{LONG + 1}}}")), cut).otherwise(words)
    df = df.withColumn(held, F.transform(letters, lambda w: F.xxhash64(w))).withColumn(size, F.size(held))
    df = df.withColumn(inner, F.zip_with(held, F.slice(held, F.lit(2), F.greatest(F.col(size) - 1, F.lit(0))), lambda x, y: F.xxhash64(x, y)))
    at = lambda i, n: F.element_at(F.col(held), i + n)
    pair = lambda i, n: F.element_at(F.col(inner), i + n)
    ends = lambda i: F.least(pair(i, 0), pair(i, k - S))

    def closed(i: Column) -> Column:
        return reduce(lambda x, y: x & y, [pair(i, n) >= ends(i) for n in range(1, k - S)], F.lit(True))

    # an anchor is one number, 31 bits of hash above 32 bits of place, so that numbers are sorted
    word = lambda x, i: F.shiftleft(F.shiftrightunsigned(x, 33), 32).bitwiseOR(i.cast("long"))
    places = F.filter(F.sequence(F.lit(1), F.col(size) - (k - 1)), closed)
    found = F.transform(places, lambda i: word(F.xxhash64(*[at(i, n) for n in range(k)]), i))
    whole = F.when(F.col(size) > 0, F.array(word(F.xxhash64(F.col(held)), F.lit(1))))
    none = F.array().cast("array<bigint>")
    line = f"_{out}_every"
    df = df.withColumn(line, F.sort_array(F.when(F.col(size) >= k, found).otherwise(F.coalesce(whole, none)))).drop(held, size, inner)
    # the line stands twice in what follows, so it is made once and not again for each element
    hash_of = lambda x: F.shiftright(x, 32)
    first = F.filter(F.col(line), lambda x, i: (i == 0) | (hash_of(x) != hash_of(F.element_at(F.col(line), F.greatest(i, F.lit(1))))))
    split = F.transform(F.slice(first, 1, sketch), lambda x: F.struct(hash_of(x).alias("h"), x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("at")))
    return df.withColumn(out, split).drop(line)


def likeness(df: DataFrame, a: str, b: str, out: str, sketch: int = SKETCH) -> DataFrame:
    """df with out: from 0 to 1, how alike the fingerprints a and b are."""
    union = F.slice(F.sort_array(F.array_union(F.col(f"{a}.h"), F.col(f"{b}.h"))), 1, sketch)
    tag = lambda side, no: F.transform(F.col(side), lambda x: F.struct(x["h"].alias("h"), F.lit(no).alias("no"), x["at"].alias("at")))
    df = df.withColumn("_union", union).withColumn("_both", F.sort_array(F.concat(tag(a, 0), tag(b, 1))))
    df = df.withColumn("_most", F.try_element_at("_union", F.lit(-1)))

    def offset(i: Column) -> Column:
        """Of an anchor that both have, which stand side by side."""
        x, y = F.element_at("_both", i), F.element_at("_both", i + 1)
        return F.when((x["h"] == y["h"]) & (x["h"] <= F.col("_most")), y["at"] - x["at"])

    pairs = F.when(F.size("_both") > 1, F.transform(F.sequence(F.lit(1), F.size("_both") - 1), offset)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_offsets", F.sort_array(F.filter(pairs, lambda o: o.isNotNull())))
    middle = F.try_element_at(F.col("_offsets"), F.floor(F.size("_offsets") / 2).cast("int") + 1)
    agree = F.size(F.filter(F.col("_offsets"), lambda o: F.abs(o - F.col("_middle")) <= DRIFT))
    df = df.withColumn("_middle", middle).withColumn("_share", agree / F.greatest(F.size("_union"), F.lit(1)))
    dice = F.when(F.size("_union") == 0, F.lit(1.0)).otherwise(2 * F.col("_share") / (1 + F.col("_share")))
    return df.withColumn(out, dice).drop("_union", "_both", "_most", "_offsets", "_middle", "_share")


def written(fingerprint: str) -> Column:
    one = lambda x: F.concat_ws(":", F.lpad(F.lower(F.hex(x["h"])), 8, "0"), x["at"].cast("string"))
    return F.array_join(F.transform(F.col(fingerprint), one), " ")


def _range_of(df: DataFrame, key: str, rows: int) -> Column:
    """The number of cut points up to the key, ascending with it; two steps through at most 256 each."""
    side = max(1, min(math.isqrt(MOST_RANGES), math.ceil(math.sqrt(rows / RANGE_ROWS))))
    cuts = df.approxQuantile(key, [i / side**2 for i in range(1, side**2)], 1 / (4 * side**2)) if side > 1 else []
    if not cuts:
        return F.lit(0)
    cuts = sorted(cuts)
    k = F.col(key).cast("double")
    groups = [cuts[i : i + side] for i in range(0, len(cuts), side)]
    upto = lambda values: F.size(F.filter(values, lambda c: c <= k))
    firsts = F.array(*[F.lit(g[0]) for g in groups])
    fine = F.array(*[F.array(*[F.lit(c) for c in g]) for g in groups])
    coarse = upto(firsts)
    return F.coalesce(F.when(coarse == 0, 0).otherwise((coarse - 1) * side + upto(F.element_at(fine, F.greatest(coarse, F.lit(1))))), F.lit(-1))


def with_next(df: DataFrame, rows: int, order: str = "doc_id", tie: str = "_tie", prepare=lambda x: x, carried: tuple[str, ...] = ("text",)) -> DataFrame:
    """df with next_<c> of the row after each, in descending order; after the last comes the first.

    prepare: what is to be added to a row before the rows are dealt out, so that it is done once.
    """
    df = df.withColumn("_range", _range_of(df, order, rows))
    first = df.groupBy("_range").agg(F.max(F.struct(order, tie)).alias("_first"))
    after = Window.orderBy(F.desc("_range"))  # one row for each range
    every = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    links = first.select("_range").withColumn("_after", F.coalesce(F.lead("_range").over(after), F.max("_range").over(every)))
    wanted = links.join(first.select(F.col("_range").alias("_after"), "_first"), "_after").select(F.col("_range").alias("_to"), "_after", "_first")
    # at most MOST_RANGES rows of a few numbers
    ends = df.join(F.broadcast(wanted), (df["_range"] == F.col("_after")) & F.struct(order, tie).eqNullSafe(F.col("_first")))
    ends = ends.withColumn("_range", F.col("_to")).drop("_to", "_after", "_first").dropDuplicates(["_range"]).withColumn("_end", F.lit(1))
    both = prepare(df.withColumn("_end", F.lit(0)).unionByName(ends))
    line = Window.partitionBy("_range").orderBy("_end", F.struct(order, tie).desc())
    out = both.withColumn("_next", F.lead(F.struct(*carried)).over(line)).where("_end = 0")
    return out.select(*[c for c in both.columns if c not in ("_range", "_end")], *[F.col(f"_next.{c}").alias(f"next_{c}") for c in carried])


def report(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("_tie", F.xxhash64("text"))
    own = with_next(rows, docs.count(), prepare=lambda x: with_anchors(x, "text", "fp"), carried=("text", "fp"))
    n = F.length("text")
    cut = F.floor(n / 2).cast("int")
    own = own.withColumn("n_chars", n.cast("long"))
    own = own.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)))
    out = with_anchors(own.drop("text", "next_text", "_tie"), "edited", "edited_fp")
    out = out.withColumn("edited_sha256", F.sha2(F.col("edited"), 256)).drop("edited")
    out = likeness(likeness(out, "fp", "edited_fp", "near_edited"), "fp", "next_fp", "near_next")
    return out.select("doc_id", "n_chars", "edited_sha256", written("fp").alias("fingerprint"), written("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next")
