"""Source divergence audit: how far the vocabularies of a language's sources lie apart.

Terms are runs of ASCII letters and of anything beyond ASCII, with A-Z lower-cased. A language keeps
the terms that stand in at least LEAST_DOCS of its documents. A group, one source of one language,
gives each kept term the share p = 1 + floor(10**9 (count + 5) / (N + 5 V)), where N sums its counts
of the V kept terms; the language as a whole gives shares in the same way.

Each task counts the terms of its documents by group, and hands its sums on, never words. The sums of
a term become one wide row: an array over the language's sources, of counts and then of shares. From
that row higher-order functions emit what each pair of sources adds to the pair's distance, and
partial aggregates sum that up before anything is shuffled: as many rows leave a task as there are
pairs. The pairs of a language are the result itself, so they are quadratic in its sources, but never
in documents or terms.

Shares are long division, three decimal digits a step, so that no product leaves 64 bits below 9 * 10**15
words a group. The table of groups, with N and V, is broadcast if it takes at most MOST_BYTES, and
joined by the language otherwise.

Defined results: null text, language and source count as ''. Rows that repeat are documents of their
own. A group without terms has shares of its own too; a language that keeps no term has pairs of
value 0 and no terms. Ties go by the item's UTF-8 bytes. An empty table gives an empty result; other
columns may have any name.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import materialize

LEAST_DOCS = 30
MOST_TERMS = 50
ADDED = 5
#: Terms that a task holds before it hands its sums on.
HELD = 200_000
MOST_BYTES = 32 << 20

#: What is not part of a term becomes a space, A-Z become a-z.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def _counted(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs): partial sums, some `held` of them and one document's at a time."""
    count, docs = defaultdict(Counter), defaultdict(Counter)
    size = 0

    def sums():
        for (lang, source), found in count.items():
            terms, ns = list(found), list(found.values())
            ds = list(map(docs[lang, source].__getitem__, terms))
            group = [pa.repeat(pa.scalar(x, pa.string()), len(terms)) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*group, pa.array(terms, pa.binary()), pa.array(ns, pa.int64()), pa.array(ds, pa.int64())], ["lang", "source", "term", "n", "docs"])
        count.clear()
        docs.clear()

    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            terms, own = terms_of(text.as_buffer().to_pybytes()), count[lang, source]
            size -= len(own)
            own.update(terms)
            docs[lang, source].update(set(terms))
            size += len(own)
            if size > held:
                yield from sums()
                size = 0
    yield from sums()


def term_counts(docs: DataFrame, held: int = HELD) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it)."""
    read = docs.select("lang", "source", "text").mapInArrow(lambda it: _counted(it, held), "lang string, source string, term binary, n long, docs long")
    return read.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10**9 (n + ADDED) / (total + ADDED * kept)), exact, by long division."""
    below, rest, out = total + ADDED * kept, n + ADDED, F.lit(0).cast("long")
    for _ in range(3):
        out = out * 1000 + F.call_function("div", rest * 1000, below)
        rest = rest * 1000 % below
    return out + 1


def _languages(docs: DataFrame, wide: DataFrame) -> DataFrame:
    """lang, sources (array of source, total, by source), total, kept."""
    groups = docs.select("lang", "source").distinct()
    totals = wide.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("total"))
    kept = wide.groupBy("lang").agg(F.count("*").alias("kept"))
    each = groups.join(totals, ["lang", "source"], "left").select("lang", F.struct("source", F.coalesce("total", F.lit(0)).alias("total")).alias("s"))
    found = each.groupBy("lang").agg(F.sort_array(F.collect_list("s")).alias("sources"), F.sum("s.total").alias("total"))
    return materialize(found.join(kept, "lang", "left").select("lang", "sources", "total", F.coalesce("kept", F.lit(0)).alias("kept")), "term-groups")


def _vectors(wide: DataFrame, languages: DataFrame) -> DataFrame:
    """lang, term, q (the language's share), v: count n and share p of each source, in their order."""
    size = languages.agg(F.sum(F.aggregate("sources", F.lit(0).cast("long"), lambda n, s: n + F.octet_length(s["source"]) + 64))).first()[0] or 0
    both = wide.join(F.broadcast(languages) if size <= MOST_BYTES else languages, "lang")
    held = both.withColumn("found", F.map_from_entries("counts"))
    n = F.transform("sources", lambda s: F.struct(s["source"].alias("source"), s["total"].alias("total"), F.coalesce(F.try_element_at("found", s["source"]), F.lit(0)).alias("n")))
    q = share(F.col("n"), F.col("total"), F.col("kept")).alias("q")
    v = F.transform(n, lambda x: F.struct(x["source"].alias("source"), x["n"].alias("n"), share(x["n"], x["total"], F.col("kept")).alias("p")))
    return held.select("lang", "term", q, v.alias("v"))


def _pairs(vectors: DataFrame, languages: DataFrame) -> DataFrame:
    """lang, source, item, value: of every two sources of a language, both ways."""
    # of each term and source what the pairs with the later sources add; partial sums leave the task
    first = vectors.select("lang", F.posexplode("v.p").alias("a", "p"), F.col("v.p").alias("every"))
    added = F.transform(F.slice("every", F.col("a") + 2, F.size("every")), lambda x, k: F.struct((k + 1).alias("on"), F.abs(x - F.col("p")).alias("f")))
    values = first.select("lang", "a", F.explode(added).alias("x")).groupBy("lang", "a", (F.col("a") + F.col("x.on")).alias("b")).agg(F.sum("x.f").alias("value"))
    own = languages.select("lang", "sources", F.posexplode("sources.source").alias("i", "source"))
    both = own.select("lang", "i", "source", F.posexplode("sources.source").alias("j", "item")).where("i != j")
    both = both.withColumn("a", F.least("i", "j")).withColumn("b", F.greatest("i", "j"))
    return both.join(values, ["lang", "a", "b"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))


def _ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    if most:  # each task leaves out what is beyond that rank before the shuffle
        ranked = ranked.where(F.col("rank") <= most)
    return ranked.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: the distances to the other sources, and the terms that a source uses more than its language."""
    read = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = F.collect_list(F.struct("source", "n")).alias("counts")
    wide = term_counts(read).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), counts).where(F.col("docs") >= least_docs)
    wide = materialize(wide.withColumn("term", F.col("term").cast("string")), "wide-terms")
    languages = _languages(read, wide)
    vectors = _vectors(wide, languages)
    terms = vectors.select("lang", F.col("term").alias("item"), "q", F.explode("v").alias("x")).where("x.n > 0 and x.p > q")
    terms = terms.select("lang", "x.source", "item", (F.col("x.p") - F.col("q")).alias("value"))
    return _ranked(_pairs(vectors, languages), "pair").unionByName(_ranked(terms, "term", most_terms))
