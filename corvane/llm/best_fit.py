"""Best-fit decreasing packing of whole documents into windows.

Documents longer than a window are cut into pieces of one window each, and a last one; everything
else stays whole. Best-fit decreasing looks at nothing of a piece but its length, and of an open
window but its free places, and neither takes more than `window` values. So the placement is worked
out for lengths: from the longest to the shortest, all pieces of a length go into the tightest open
windows that take them, as many in a window as it holds, which is what one piece after the other
would do. The tightest is found in a segment tree over free places, in a logarithmic number of
steps; windows of equal free places that were opened one after the other are one run. The result is
a plan of runs (length, first rank, first window, pieces a window, offset), bounded by the window and
not by the number of documents: the placement of the whole corpus, as good as one task over all
pieces would make it, and no more than a histogram of at most `window` rows goes to the driver.

Each task cuts and numbers its pieces by length once. Their rank among all pieces of that length is that
number and those of the tasks before (a running sum over tasks for each length), and a lookup in the
broadcast plan gives window and offset. Ids are not shuffled, only their lengths and checksums.

Defined results: null and empty texts give one piece, the closing id. Rows that repeat a doc_id are
documents of their own; which of equally long pieces goes where is arbitrary, but fixed in a result.
A text of any length is cut in its task, one document at a time. An empty table gives an empty
result; other columns may have any name.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import materialize, text_or_empty
from corvane.llm.packing import ids_of
from corvane.llm.tokens import tokenizer_path

WINDOW = 2048
CLOSING = 0
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, doc_tokens long, part long, at long"


class FreePlaces:
    """A segment tree over the numbers of free places, 0 to window: which of them some window has."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.some = [False] * (2 * self.leaves)

    def mark(self, free: int, there: bool) -> None:
        node = self.leaves + free
        self.some[node] = there
        while node > 1:
            node //= 2
            self.some[node] = self.some[2 * node] or self.some[2 * node + 1]

    def tightest(self, length: int) -> int | None:
        """The least number of free places that is not below length, if any window has so many."""
        node = self.leaves + length
        while not self.some[node]:  # up, until something to the right has windows
            while node % 2:
                node //= 2
                if node <= 1:
                    return None
            node += 1
        while node < self.leaves:  # down, to the left where possible
            node = 2 * node if self.some[2 * node] else 2 * node + 1
        return node - self.leaves


def plan(counts: dict[int, int], window: int = WINDOW) -> np.ndarray:
    """Runs (length, first rank, first window, pieces a window, offset) of best-fit decreasing.

    counts: how many pieces each length has. Within a run ranks fill one window after the other.
    """
    tree, open_, made, runs = FreePlaces(window), {}, 0, []

    def put_back(free: int, first: int, n: int) -> None:
        if n and free:
            open_.setdefault(free, deque()).append((first, n))
            tree.mark(free, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            free = tree.tightest(length)
            if free is None:  # as many new windows as the rest needs
                free = window
                first, n = made, -(-left // (window // length))
                made += n
            else:
                first, n = open_[free].popleft()
                if not open_[free]:
                    del open_[free]
                    tree.mark(free, False)
            each = free // length
            full, more = divmod(min(left, n * each), each)
            runs.append((length, rank, first, each, window - free))
            rank, left = rank + full * each + more, left - full * each - more
            put_back(free - each * length, first, full)
            if more:
                put_back(free - more * length, first + full, 1)
            put_back(free, first + full + (more > 0), n - full - (more > 0))
    return np.array(runs, np.int64).reshape(-1, 5)


def place(runs: np.ndarray, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of the pieces of these lengths and ranks."""
    shift = np.int64(48)
    keys = (-runs[:, 0] << shift) + runs[:, 1]  # ascending, as the longest come first
    run = runs[np.searchsorted(keys, (-lengths << shift) + ranks, side="right") - 1]
    nth = ranks - run[:, 1]
    return run[:, 2] + nth // run[:, 3], run[:, 4] + nth % run[:, 3] * lengths


def _cut(batches: Iterator[pa.RecordBatch], path: str, window: int, closing: int) -> Iterator[pa.RecordBatch]:
    part, seen, end = TaskContext.get().partitionId(), Counter(), struct.pack("<I", closing)
    names = [x.split()[0] for x in _PIECE.split(", ")]
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 6]
    for b in batches:
        out = []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ids = ids_of(path, text.as_py()) + end
            for k, start in enumerate(range(0, len(ids), 4 * window)):
                piece = ids[start : start + 4 * window]
                n = len(piece) // 4
                out.append((doc, k, start // 4, n, zlib.crc32(piece), len(ids) // 4, part, seen[n]))
                seen[n] += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, closing: int = CLOSING) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path, spark = path or tokenizer_path(), docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    pieces = materialize(rows.mapInArrow(lambda it: _cut(it, path, window, closing), _PIECE), "pieces")
    of_task = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))  # at most `window` rows for each task
    counts = {r.length: r.n for r in of_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    runs = spark.sparkContext.broadcast(plan(counts, window))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = of_task.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def placed(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(x) for x in place(runs.value, lengths.to_numpy(), ranks.to_numpy())], ["sequence_id", "offset"])

    ranked = pieces.join(before, ["part", "length"]).withColumn("_at", placed("length", F.col("at") + F.col("before")))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "doc_tokens", "_at.sequence_id", "_at.offset")
