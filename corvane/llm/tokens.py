"""Token counts by a map-side two-tier lookup.

Texts are cut at ASCII white space, which no token crosses, into pre-tokens. A first pass lets some
tasks, SAMPLE_TASKS or so, count their own pre-tokens and hand on the FREQUENT_PER_TASK most frequent
ones; the driver adds these lists up, and the TABLE_ROWS most frequent of all are encoded once and
broadcast as a compact table of token lengths. A second pass looks every pre-token up in that table,
and else in a bounded cache that the worker keeps, whose misses are encoded word by word. Pre-tokens
are never shuffled, and the table decides only which tier answers: every count is the tokenizer's own.

That holds for a tokenizer that lower-cases, drops white space and splits words as this one does, as
its file says. Texts are encoded whole for any other, and for sentencepiece models.

Defined results: null counts as the empty text, which has no token. Special strings in a text are
treated as the tokenizer treats them by default. A text of any length is counted whole.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import text_or_empty

TABLE_ROWS = 65_536
FREQUENT_PER_TASK = 2048
#: Tasks of the first pass that look at their texts: 64 * 2,048 pre-tokens of up to 32 characters go to the driver.
SAMPLE_TASKS = 64
#: The longest pre-token that enters the table, which bounds it: 65,536 * (4 * 32 + 3) bytes, 8.6 MB.
LONGEST = 32
CACHE_ROWS = 300_000
CACHED_CHARS = 64
#: str.split() cuts here too, but the tokenizers don't.
_NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
OVER = 2048

_loaded: dict[str, object] = {}
_apart: dict[str, bool] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer(path: str):
    if path not in _loaded:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


#: What a tokenizer's file says if pre_tokens() and Cache may take its texts apart. Fixed values.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def cuts_at_space(path: str) -> bool:
    """Whether a tokenizer is one of which texts can be taken apart at white space."""
    if not path.endswith(".json"):
        return False
    if path not in _apart:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        _apart[path] = held.get("normalizer") == _NORMALIZER and held.get("pre_tokenizer") == _PRE_TOKENIZER
    return _apart[path]


def whole_lengths(path: str, texts: list[str]) -> list[int]:
    """The number of tokens of each text, encoded as it is."""
    if path.endswith(".model"):
        if path not in _loaded:
            import sentencepiece

            _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(_loaded[path].encode(t)) for t in texts]
    return [len(tokenizer(path).encode(t, add_special_tokens=False).ids) for t in texts]


def pre_tokens(text: str) -> list[str]:
    """The text cut at white space, where a cut cannot change its tokens."""
    if any(c in text for c in _NOT_SPACE):
        return [x for x in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
    return text.split()


def encode_each(path: str, pieces: list[str]) -> list[list[int]]:
    """The ids of each pre-token, all encoded in one call."""
    out: list[list[int]] = []
    t = tokenizer(path)
    for at in range(0, len(pieces), 20_000):
        out += [e.ids for e in t.encode_batch_fast(pieces[at : at + 20_000], add_special_tokens=False)]
    return out


#: Pre-tokens of these characters are split into words here: letters, single digits, the rest.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-;=-@\[-`{-~]+")
_PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable ones for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


_LETTER = _byte_letters()


class Cache(dict):
    """The value of each pre-token: value(its ids), which combine() makes of those of its words.

    It holds at most CACHE_ROWS pre-tokens and as many that were in use before; those that are not
    asked for in all that time are forgotten. Long ones are never kept.
    """

    def __init__(self, path: str, value: Callable, combine: Callable, first: dict | None = None):
        super().__init__(first or {})
        self.whole, self.model = tokenizer(path), tokenizer(path).model
        self.value, self.combine, self.first, self.older = value, combine, first or {}, {}

    def __missing__(self, piece: str):
        found = self.older.get(piece)
        if found is None:
            found = self._encode(piece)
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHE_ROWS + len(self.first):
                self.older = dict(self)
                self.clear()
                self.update(self.first)
            self[piece] = found
        return found

    def _encode(self, piece: str):
        if len(piece) > CACHED_CHARS or not _PLAIN.fullmatch(piece):
            return self.value(self.whole.encode(piece, add_special_tokens=False).ids)
        parts = _PARTS.findall(piece.lower())
        if len(parts) > 1:
            return self.combine(self[p] for p in parts)
        letters = "".join(map(_LETTER.__getitem__, parts[0].encode()))
        return self.value([t.id for t in self.model.tokenize(letters)])


_caches: dict[object, Cache] = {}


def _count(cache: Cache, text: str) -> int:
    return sum(map(cache.__getitem__, pre_tokens(text)))


def _frequent(batches: Iterator[pa.RecordBatch], most: int, longest: int) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            counts.update(pre_tokens(text.as_py()))
        if len(counts) > 128 * most:  # keep the summary bounded
            counts = Counter(dict(counts.most_common(32 * most)))
    top = [(k, n) for k, n in counts.most_common(most) if n > 1 and len(k) <= longest]
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])


def frequent(docs: DataFrame, rows: int = TABLE_ROWS, per_task: int = FREQUENT_PER_TASK, tasks: int = SAMPLE_TASKS) -> list[str]:
    """The most frequent pre-tokens of a bounded sample of the table's partitions, from bounded summaries of each."""
    every = max(1, docs.rdd.getNumPartitions() // tasks)
    some = docs.where(F.spark_partition_id() % every == 0).select(text_or_empty().alias("text"))
    found = some.mapInArrow(lambda it: _frequent(it, per_task, LONGEST), "piece string, n long")
    counts: Counter = Counter()
    lists = found.toArrow()  # at most per_task rows of each of some `tasks` tasks
    for piece, n in zip(lists["piece"].to_pylist(), lists["n"].to_pylist(), strict=True):
        counts[piece] += n
    return [p for p, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:rows]]


def pack_table(pieces: list[str], lengths: list[int]) -> bytes:
    """Pre-tokens hold no white space, so a line break parts them."""
    lines = "\n".join(f"{p}\t{n}" for p, n in zip(pieces, lengths, strict=True))
    return zlib.compress(lines.encode(), 1)


def unpack_table(data: bytes) -> dict[str, int]:
    lines = (x.rpartition("\t") for x in zlib.decompress(data).decode().split("\n") if x)
    return {p: int(n) for p, _, n in lines}


def with_token_counts(docs: DataFrame, path: str | None = None, text: str = "text", out: str = "n_tokens", table_rows: int = TABLE_ROWS) -> DataFrame:
    """docs with a column of the number of tokens of each text."""
    path = path or tokenizer_path()
    if not cuts_at_space(path):

        @F.arrow_udf("long")
        def whole(texts: pa.Array) -> pa.Array:
            return pa.array(whole_lengths(path, texts.to_pylist()), pa.int64())

        return docs.withColumn(out, whole(text_or_empty(text)))
    pieces = frequent(docs.select(F.col(text).alias("text")), table_rows)
    table = pack_table(pieces, list(map(len, encode_each(path, pieces))))
    sent = docs.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("long")
    def counted(texts: pa.Array) -> pa.Array:
        key = (path, hash(sent.value))
        if key not in _caches:
            _caches.clear()
            _caches[key] = Cache(path, len, sum, unpack_table(sent.value))
        cache = _caches[key]
        return pa.array([_count(cache, t.as_py()) for t in texts], pa.int64())

    return docs.withColumn(out, counted(text_or_empty(text)))


def report(docs: DataFrame, path: str | None = None, most: int = OVER) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_tokens, over_limit."""
    n_bytes = F.octet_length(text_or_empty()).cast("long").alias("n_bytes")
    out = with_token_counts(docs.select("doc_id", "text"), path)
    return out.select("doc_id", n_bytes, "n_tokens").withColumn("over_limit", F.col("n_tokens") > most)
