"""Packing token sequences into windows, online and in bounded space.

Each task reads its documents once. The tokens of a document (with the closing id) are cut at every
WINDOW tokens; whole windows leave at once, and the remainder goes to the open window that it fits
best. A task keeps at most OPEN windows open. When a piece fits in none, the fullest window is
topped up with the head of that piece if at least LEAST_CUT places are free, and is emitted; the
rest of the piece goes on. At the end each task hands its open windows on with their ids, at most
OPEN * WINDOW of them, and these are merged: they are laid end to end over all tasks (a prefix sum
over one total for each task) and cut at every WINDOW tokens, so that only the last sequence of all
is short.

Defined results: null and empty texts give one piece, the closing id. Rows that repeat a doc_id are
documents of their own. The largest task holds OPEN windows and one document. An empty table gives
an empty result. sequence_id is unique over all tasks; ids from 2**62 on are merged leftovers.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import materialize, text_or_empty
from corvane.llm.tokens import Cache, cuts_at_space, pre_tokens, tokenizer_path

WINDOW = 2048
OPEN = 64
LEAST_CUT = 32
CLOSING = 1
MERGED = 1 << 62

_caches: dict[str, Cache] = {}
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def ids_of(path: str, text: str) -> bytes:
    """The ids of a text as little-endian 32-bit numbers."""
    if path not in _caches:
        if not cuts_at_space(path):
            raise ValueError(f"{path} is no tokenizer that texts can be cut for at white space")
        _caches[path] = Cache(path, _pack, b"".join)
    return b"".join(map(_caches[path].__getitem__, pre_tokens(text)))


class Packer:
    """Best fit into a fixed number of open windows."""

    def __init__(self, window: int, most_open: int, least_cut: int):
        self.window, self.most_open, self.least_cut = window, most_open, least_cut
        self.free: list[tuple[int, int]] = []  # (free places, window), ascending: the fullest first
        self.held: dict[int, list] = {}
        self.made = 0

    def _emit(self, no: int):
        at = 0
        for doc, start, ids, total in self.held.pop(no):
            yield doc, start, ids, total, no, at
            at += len(ids) // 4

    def _put(self, room: int, no: int, piece: tuple) -> Iterator[tuple]:
        self.held[no].append(piece)
        room -= len(piece[2]) // 4
        if room:
            insort(self.free, (room, no))
        else:
            yield from self._emit(no)

    def _new(self) -> int:
        self.made += 1
        self.held[self.made - 1] = []
        return self.made - 1

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        """Yields (doc, start, ids, document's tokens, window, offset) of the windows that leave."""
        total, whole = len(ids) // 4, 4 * self.window
        at = 0
        while len(ids) - at >= whole:
            yield doc, at // 4, ids[at : at + whole], total, self._new(), 0
            del self.held[self.made - 1]
            at += whole
        while at < len(ids):
            n = (len(ids) - at) // 4
            k = bisect_left(self.free, (n, -1))
            if k < len(self.free):
                room, no = self.free.pop(k)
            elif len(self.free) < self.most_open:
                room, no = self.window, self._new()
            else:
                room, no = self.free.pop(0)
                if room < self.least_cut:
                    yield from self._emit(no)
                    room, no = self.window, self._new()
            take = min(n, room)
            yield from self._put(room, no, (doc, at // 4, ids[at : at + 4 * take], total))
            at += 4 * take

    def rest(self) -> Iterator[tuple]:
        """The pieces of the open windows, fullest first."""
        for _, no in self.free:
            yield from self.held[no]


def _rows(batches: Iterator[pa.RecordBatch], path: str, window: int, most_open: int, least_cut: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    packer, closing = Packer(window, most_open, least_cut), _pack([CLOSING])
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "at", "ids"]
    types = [pa.int64()] * 9 + [pa.binary()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    for b in batches:
        out = []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ids = ids_of(path, text.as_py()) + closing
            for d, start, piece, total, no, offset in packer.add(doc, ids):
                out.append((d, start, len(piece) // 4, zlib.crc32(piece), total, part << 32 | no, offset, part, None, None))
        if out:
            yield batch(out)
    at, out = 0, []
    for d, start, piece, total in packer.rest():
        out.append((d, start, len(piece) // 4, None, total, None, None, part, at, piece))
        at += len(piece) // 4
    if out:
        yield batch(out)


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    for b in batches:
        out = []
        for doc, start, total, at, ids in zip(*(b.column(k).to_pylist() for k in ("doc_id", "start", "doc_tokens", "at", "ids")), strict=True):
            done = 0
            while done < len(ids) // 4:
                offset = (at + done) % window
                take = min(window - offset, len(ids) // 4 - done)
                piece = ids[4 * done : 4 * (done + take)]
                out.append((doc, start + done, take, zlib.crc32(piece), total, MERGED + (at + done) // window, offset))
                done += take
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(7)], names)


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, most_open: int = OPEN, least_cut: int = LEAST_CUT) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or tokenizer_path()
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    placed = rows.mapInArrow(lambda it: _rows(it, path, window, most_open, least_cut), PIECE + ", part long, at long, ids binary")
    placed = materialize(placed, "packed")
    left = placed.where("ids is not null")
    totals = left.groupBy("part").agg(F.sum("length").alias("n"))  # one row for each task of the first pass
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    laid = left.join(totals.select("part", before.alias("base")), "part").withColumn("at", F.col("at") + F.col("base"))
    merged = laid.select("doc_id", "start", "doc_tokens", "at", "ids").mapInArrow(lambda it: _cut(it, window), PIECE)
    kept = placed.where("ids is null").select(*merged.columns)
    return kept.unionByName(merged)
