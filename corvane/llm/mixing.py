"""Mixing sources to target weights by Sainte-Laguë apportionment.

Every source gets a target number of words: a share by weight of RATIO times all words, at most
REPEATS times what it has, the excess shared again by weight until none is above. Targets are
turned into whole blocks of equal size by the highest quotients target / (2 s - 1), first over the
sources and then, in each source, over its shards of some SHARD_ROWS documents. In a shard the
documents lie in a seeded order on a ring; a quota of more words than the shard has takes whole
passes, and the rest is taken in blocks at even distances from a seeded start, no more and no fewer
words than the quota says. What a document gives is the overlap of its words with these blocks,
which is arithmetic on the words before it; blocks are never listed. All orders come from md5 of
seed and doc_id, so runs agree.

A block is small beside the smallest target and beside the smallest shard, so that neither the
rounding of a source nor that of a shard shows, however short the texts are.

A source with a third of all rows is spread over as many more shards. The windows hold one row for
each source, for each shard of a source, or for each document of a shard. Quotients that win in any
case are not listed: with k rivals, the seats that a divisor for (seats - k/2) gives are sure, and
only some 2 k quotients after them are ranked.

Defined results: a null, empty or blank text has no words and gives none, so mix() leaves it out;
sources without words have the target 0; null is a source, the last one. Rows that repeat a doc_id and a size are taken alike, each from its
own place. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import WORD, carried, materialize, text_or_empty, whole_hash

WEIGHTS = (3, 1, 2)
RATIO = 1.5
REPEATS = 2
SHARD_ROWS = 4096
LARGEST_BLOCK = 2048
#: A block is at most this share of the smallest target, which bounds the rounding of any source.
BLOCKS_OF_SMALLEST = 200
#: And at most this share of the mean shard of any source that gives words.
BLOCKS_OF_SHARD = 64
SEED = "mix-1"
#: A word with the white space before it.
SPACED_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _draw(salt: str, *of: Column) -> Column:
    """48 bits of md5, the same in every engine."""
    parts = [F.coalesce(x.cast("string"), F.lit("")) for x in of]
    return F.conv(F.substring(F.md5(F.concat_ws("\x01", F.lit(salt), *parts)), 1, 12), 16, 10).cast("long")


def _everything():
    """Over one row for each source."""
    return Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def targets(sizes: DataFrame, weights=WEIGHTS, ratio: float = RATIO, repeats: int = REPEATS) -> DataFrame:
    """(source, rows, source_size, target): water filling, closed by prefix sums over cap / weight.

    In ascending order of cap / weight the sources that reach their cap are a prefix. Source i is in
    it if the level (total - caps before i) / (weights from i on) is not below its cap / weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights)).cast("int") + 1).cast("long")
    everything = _everything()
    per = per.withColumn("rank", rank).withColumn("w", weight).withColumn("cap", F.col("source_size") * repeats)
    by_level = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("total", F.sum("source_size").over(everything) * ratio)
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("full", F.col("cap") * F.col("w_left") <= F.col("left") * F.col("w"))
    )
    first = F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("w")).alias("o"), "rank", "left", "w_left"))).over(everything)
    per = per.withColumn("level", first)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("level.left") / F.col("level.w_left"))
    return per.select("source", "rank", "rows", "source_size", target.alias("target"))


def apportion(votes: DataFrame, within: list[str], seats: str, vote: str, order: str, out: str) -> DataFrame:
    """Sainte-Laguë: votes with a column out, whole seats that sum to the column seats of each group.

    within: the columns of a group, or none; order: breaks ties between equal quotients.
    """
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    votes = (
        votes.withColumn("_k", F.count("*").over(group))
        .withColumn("_sum", F.sum(F.col(vote).cast("double")).over(group))
        .withColumn("_share", F.when(F.col("_sum") > 0, F.col(vote) / F.col("_sum")).otherwise(0.0))
        .withColumn("_sure", F.greatest(F.floor(F.col("_share") * (F.col(seats) - F.col("_k") / 2 - 1) + 0.5), F.lit(0)))
        .withColumn("_top", F.floor(F.col("_share") * (F.col(seats) + F.col("_k") / 2 + 1) + 0.5) + 1)
        .withColumn("_open", F.col(seats) - F.sum("_sure").over(group))
    )
    rivals = votes.where("_share > 0").withColumn("_seat", F.explode(F.expr("sequence(_sure + 1, greatest(_top, _sure + 1))")))
    quotient = F.col(vote) / (2 * F.col("_seat") - 1)
    ranked = Window.partitionBy(*(within or [F.lit(0)])).orderBy(quotient.desc(), order, "_seat")
    won = rivals.withColumn("_rank", F.row_number().over(ranked)).where("_rank <= _open")
    key = [*within, order]
    won = won.groupBy(*[F.col(k).alias(f"_key_{k}") for k in key]).agg(F.count("*").alias("_won"))
    on = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in key]
    out_ = votes.join(won, on, "left").withColumn(out, (F.col("_sure") + F.coalesce("_won", F.lit(0))).cast("long"))
    return out_.drop("_k", "_sum", "_share", "_sure", "_top", "_open", "_won", *[f"_key_{k}" for k in key])


def _plan(sizes: DataFrame, weights, ratio, repeats, shard_rows, seed) -> tuple[DataFrame, DataFrame]:
    """(sources with target, shards, block and quota; shards with size, passes, rest, q and phase)."""
    per = targets(sizes, weights, ratio, repeats).withColumn("shards", F.ceil(F.col("rows") / shard_rows).cast("long"))
    per = materialize(per, "targets")
    gives = F.col("target") > 0
    least = F.min(F.when(gives, F.least(F.col("target") / BLOCKS_OF_SMALLEST, F.col("source_size") / (F.col("shards") * BLOCKS_OF_SHARD)))).over(_everything())
    block = F.greatest(F.lit(1), F.least(F.lit(LARGEST_BLOCK), F.floor(least)))
    per = per.withColumn("block", F.coalesce(block, F.lit(1)).cast("long"))
    per = per.withColumn("seats", F.floor(F.sum("target").over(_everything()) / F.col("block") + 0.5))
    per = materialize(apportion(per, [], "seats", "target", "rank", "quota"), "quotas")
    parts = _sharded(sizes, per, seed).groupBy("rank", "shard", "quota", "block").agg(F.sum("size").alias("shard_size"))
    parts = apportion(parts, ["rank"], "quota", "shard_size", "shard", "blocks")
    n = F.greatest("shard_size", F.lit(1))
    parts = (
        parts.withColumn("words", F.least(F.col("blocks") * F.col("block"), F.col("shard_size") * repeats))
        .withColumn("passes", _div("words", n))
        .withColumn("rest", F.col("words") % n)
        .withColumn("q", F.ceil(F.col("rest") / F.col("block")).cast("long"))
        .withColumn("phase", _draw(f"{seed}/phase", F.col("rank"), F.col("shard")) % n)
    )
    return per, materialize(parts.select("rank", "shard", "shard_size", "passes", "rest", "q", "phase"), "shard-quotas")


def _sharded(sizes: DataFrame, per: DataFrame, seed: str) -> DataFrame:
    """Rows with their source's columns and their shard. per: one row for each source."""
    look = per.select(F.col("source").alias("_source"), "rank", "source_size", "target", "shards", "block", "quota")
    joined = sizes.join(look, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return joined.withColumn("shard", F.pmod(_draw(f"{seed}/shard", F.col("doc_id"), F.col("size")), F.col("shards")))


def _div(a: str | Column, b: Column) -> Column:
    """Whole division of numbers that are not negative."""
    a = F.col(a) if isinstance(a, str) else a
    return ((a - a % b) / b).cast("long")


def block_at(x: Column) -> tuple[Column, Column, Column]:
    """(number k, place within k's stretch, chosen words of it) for the place x of a ring.

    A ring of shard_size words is cut into q stretches, and the head of each is a chosen block: rest
    words in all. Stretches as well as blocks differ by one word at most, the longer ones first.
    """
    n, rest, q = F.col("shard_size"), F.col("rest"), F.greatest("q", F.lit(1))
    wide, more = _div(n, q), n % q
    edge = more * (wide + 1)
    k = F.when(x < edge, _div(x, wide + 1)).otherwise(more + _div(x - edge, F.greatest(wide, F.lit(1))))
    return k, x - (k * wide + F.least(k, more)), _div(rest, q) + F.when(k < rest % q, 1).otherwise(0)


def words_before(at: Column) -> Column:
    """Chosen words among the first words of the ring, round after round."""
    n, rest, q = F.greatest("shard_size", F.lit(1)), F.col("rest"), F.greatest("q", F.lit(1))
    k, within, chosen = block_at(at % n)
    return _div(at, n) * rest + k * _div(rest, q) + F.least(k, rest % q) + F.least(within, chosen)


def place(sizes: DataFrame, weights=WEIGHTS, ratio=RATIO, repeats=REPEATS, shard_rows=SHARD_ROWS, seed=SEED) -> DataFrame:
    """sizes (doc_id, source, size) with source_size, target, shard_size, passes, rest, q, begin (on the ring), partial."""
    per, parts = _plan(sizes, weights, ratio, repeats, shard_rows, seed)
    rows = _sharded(sizes, per, seed).join(parts, ["rank", "shard"])
    line = Window.partitionBy("rank", "shard").orderBy(_draw(f"{seed}/order", F.col("doc_id"), F.col("size")), "doc_id")
    rows = rows.withColumn("begin", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") + F.col("phase"))
    partial = F.when(F.col("q") > 0, words_before(F.col("begin") + F.col("size")) - words_before(F.col("begin"))).otherwise(0)
    return rows.withColumn("partial", partial.cast("long"))


def report(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken."""
    sizes = materialize(docs.select("doc_id", "source", n_words(text_or_empty()).alias("size")), "sizes")
    rows = place(sizes, **options)
    taken = F.col("passes") * F.col("size") + F.col("partial")
    return rows.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), taken.cast("long").alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows, with all columns of docs: a row for each whole pass over a document, and one
    with the chosen words (and the white space before each) where a pass takes only some of them.
    A column n_chars is brought up to date."""
    whole = carried(docs, "doc_id", "text", "source").withColumn("_row", F.xxhash64(text_or_empty()))
    sizes = materialize(whole.select("doc_id", "source", n_words(text_or_empty()).alias("size"), "_row"), "sizes")
    rows = place(sizes, **options)
    plan = ["size", "passes", "partial", "begin", "q", "rest", "shard_size"]
    # rows that repeat doc_id and text go one to one: the n-th row takes the n-th place
    turn = lambda *o: F.row_number().over(Window.partitionBy("doc_id", "_row").orderBy(*o))
    places = rows.withColumn("_turn", turn("rank", "shard", "begin")).select(F.col("doc_id").alias("_d"), F.col("_row").alias("_r"), F.col("_turn").alias("_t"), *plan)
    places = materialize(places.where("size > 0 and (passes > 0 or partial > 0)"), "taken")
    numbered = whole.withColumn("_turn", turn(F.col("source").asc_nulls_last(), whole_hash(docs)))
    both = numbered.join(places, F.expr("doc_id <=> _d and _row = _r and _turn = _t"))
    words = F.regexp_extract_all(text_or_empty(), F.lit(SPACED_WORD), F.lit(0))

    def taken(_, at):
        _, within, chosen = block_at((F.col("begin") + at) % F.col("shard_size"))
        return within < chosen

    some = F.ltrim(F.array_join(F.filter(words, taken), ""), F.lit(" \t\n\x0b\x0c\r"))
    copies = (F.col("passes") + F.when(F.col("partial") == F.col("size"), 1).otherwise(0)).cast("int")
    part = F.when((F.col("partial") > 0) & (F.col("partial") < F.col("size")), F.array(some)).otherwise(F.array().cast("array<string>"))
    out = both.select("_all", F.explode(F.concat(F.array_repeat(F.col("text"), copies), part)).alias("_text"))
    row = F.col("_all").withField("text", F.col("_text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("_text").cast(docs.schema["n_chars"].dataType))
    return out.select(row.alias("_all")).select("_all.*")
