"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.storage import arrow_batches, counted, counting, discard, materialize, tables_within  # noqa: F401  for the operators here

#: A word is a maximal run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def carried(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and the whole row as _all, so that no name of docs meets one of ours."""
    return docs.select(*needed, F.struct("*").alias("_all"))


def whole_hash(docs: DataFrame) -> Column:
    """A hash of a row _all of docs; maps can be hashed as text only."""
    return F.xxhash64(F.to_json("_all") if "map<" in docs.schema.simpleString() else F.col("_all"))


def one_row(docs: DataFrame) -> Column:
    """An aggregate: one of the group's rows _all, the same one in every run."""
    return F.min_by("_all", whole_hash(docs)).alias("_all")


# --- a bounded membership filter ---------------------------------------------------------------

#: Bits of the largest filter: 2**28 bits are 32 MiB, in 8,192 rows of 4 KiB.
MAX_FILTER_BITS = 28
_BUCKET_BITS = 32_768


def build_filter(keys: Column, df: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """A bitmap of hashed keys, as rows (bucket, bits), of at most 2**MAX_FILTER_BITS bits.

    rows is the number of keys and sets the size. A fuller filter only lets more rows through to
    the exact test that always follows it; it never loses one.
    """
    width = min(MAX_FILTER_BITS, max(15, (16 * max(rows, 1)).bit_length()))
    at = F.pmod(F.xxhash64(keys), F.lit(1 << width))
    table = (
        df.select(F.bitmap_bucket_number(at + 1).alias("_bucket"), F.bitmap_bit_position(at + 1).alias("_bit"))
        .groupBy("_bucket")
        .agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    )
    return table, width


def with_filter(df: DataFrame, keys: Column, table: DataFrame, width: int) -> DataFrame:
    """Adds _maybe: false where the key is certainly not in the filter.

    The filter is at most 32 MiB whatever the input (see build_filter), so it is broadcast.
    """
    at = F.pmod(F.xxhash64(keys), F.lit(1 << width))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    mask = F.element_at(F.array(*[F.lit(1 << b) for b in range(8)]), (F.col("_bit") % 8).cast("int") + 1)
    return (
        df.withColumn("_at", at + 1)
        .withColumn("_bucket", F.bitmap_bucket_number("_at"))
        .withColumn("_bit", F.bitmap_bit_position("_at"))
        .join(F.broadcast(table), "_bucket", "left")
        .withColumn("_maybe", F.coalesce(byte.bitwiseAND(mask) != 0, F.lit(False)))
        .drop("_at", "_bucket", "_bit", "_bits")
    )


def keep_least(docs: DataFrame, several: DataFrame, n: int) -> DataFrame:
    """The rows of docs that stay of the components of several rows (doc_id, row_hash, component_id), a table of n rows.

    Rows that are alone in their component pass straight through; only the others are shuffled.
    """
    if not n:
        return docs
    stays = several.groupBy("component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("own")).agg(F.min("row_hash").alias("first"))
    several = several.join(stays.where("own").select(F.col("component_id").alias("_c"), "first"), F.expr("component_id <=> _c"), "left")
    look = several.select(F.col("doc_id").alias("_d"), F.col("row_hash").alias("_r"), F.expr("doc_id <=> component_id and row_hash = first").alias("_stays")).distinct()
    table, width = build_filter(F.col("row_hash"), several, n)
    rows = carried(docs, "doc_id", "text").select("doc_id", "_all", F.xxhash64(text_or_empty()).alias("_row"))
    marked = with_filter(rows, F.col("_row"), table, width)
    maybe = marked.where("_maybe").join(look, F.expr("doc_id <=> _d and _row = _r"), "left")
    kept = maybe.where("_stays").groupBy("_d", "_r").agg(one_row(docs))
    return marked.where("not _maybe").select("_all.*").union(maybe.where("_stays is null").select("_all.*")).union(kept.select("_all.*"))
