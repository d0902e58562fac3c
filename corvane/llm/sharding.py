"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table, offset + j * skip. The
shards take turns, each claiming the first slot of its permutation that is still free, until all
slots are claimed; so shards hold equal numbers of slots up to one, and when a shard leaves or joins
most slots keep theirs. A row's key is hashed to a slot, and the table tells the shard: a constant
time look-up in a broadcast table of one row for each slot, whose size the number of shards sets
and never the data.

Defined results: a null key is a key like any other. Rows of equal keys share a shard. An empty
table gives an empty result. One key never needs more than one task here, since no row is moved; a
writer that does move rows deals each shard over several files (see write).
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537
SHARDS = 64
SEED = "shard-1"


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _number(of: str) -> int:
    return int(hashlib.md5(of.encode()).hexdigest()[:12], 16)


def lookup_table(shards: list[str], slots: int = SLOTS, seed: str = SEED) -> np.ndarray:
    """The shard number of each slot."""
    if not shards or not _is_prime(slots) or slots < len(shards):
        raise ValueError("the table needs at least one shard, and a prime number of slots that is not below theirs")
    table = np.full(slots, -1, np.int32)
    offset = [_number(f"{seed}/offset/{s}") % slots for s in shards]
    skip = [_number(f"{seed}/skip/{s}") % (slots - 1) + 1 for s in shards]
    at = offset[:]
    left = slots
    while True:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            table[at[k]] = k
            left -= 1
            if not left:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """A slot by md5, the same in every engine."""
    text = F.coalesce(key.cast("string"), F.lit("\x00"))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") % slots).cast("int")


def assign(df: DataFrame, key: str, shards: list[str] | int = SHARDS, slots: int = SLOTS, seed: str = SEED) -> DataFrame:
    """df with the columns slot and shard."""
    names = [f"shard-{i:05d}" for i in range(shards)] if isinstance(shards, int) else shards
    table = [(i, int(x)) for i, x in enumerate(lookup_table(names, slots, seed))]
    held = df.sparkSession.createDataFrame(table, "slot int, shard int")
    # one row of two numbers for each slot: some 0.5 MB, whatever the data
    return df.withColumn("slot", slot_of(F.col(key), slots)).join(F.broadcast(held), "slot")


def write(df: DataFrame, path: str, key: str, shards: int = SHARDS, files: int = 8, **options) -> None:
    """Writes df as Parquet, a folder for each shard and up to files files in each."""
    placed = assign(df, key, shards, **options).drop("slot")
    placed.repartition(shards * files, "shard", F.pmod(F.xxhash64(F.struct(*df.columns)), F.lit(files))).write.partitionBy("shard").parquet(path)


def report(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, slot, shard."""
    return assign(docs.select("doc_id"), "doc_id").select("doc_id", "slot", "shard")
