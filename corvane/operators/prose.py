"""Names in prose: where they stand, which of them count, and what a sentence ties together.

All names go into one automaton that finds them in a single walk over a text, whatever their number.
Occurrences are then chosen from left to right so that none overlap. The automaton of a list of
names is broadcast, in parts of at most MOST_BYTES of names, so a longer list costs more walks and
not more memory.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T

# --- fixed values -------------------------------------------------------------------------------
CONNECTING = ("connects to", "connected to", "connecting", "links to", "links", "linked to", "linked", "joins", "joined to", "leads to")
ROBOTS = ("alpha", "beta", "gamma", "delta", "epsilon")
# -------------------------------------------------------------------------------------------------
MOST_BYTES = 16 << 20
_VERB = re.compile(rf"\b(?:{'|'.join(CONNECTING)})\b")
_EXITS = re.compile(r"\bexits?:[^;.]+", re.IGNORECASE)
_NAMED = re.compile(T.NAME_ID)
_WORD = re.compile(r"\w")
_SPANS = "array<struct<start: int, end: int, id: string>>"
_FIELDS = ("start", "end", "id")

Span = tuple[int, int, str]


def folded(text: str) -> str:
    """Lower case, as long as the text itself, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def variants(name: str) -> list[str]:
    """The name, and what is left of it without its first words, of two words at least."""
    words = name.split()
    return [name, *[" ".join(words[k:]) for k in range(1, len(words) - 1)]]


def automaton(names: Iterable[tuple[str, str]]):
    """Of (name, id): finds all names at once; the least id speaks for a name that has several."""
    import ahocorasick

    least: dict[str, str] = {}
    for name, id_ in names:
        least[name] = min(id_, least.get(name, id_))
    found = ahocorasick.Automaton()
    for name, id_ in least.items():
        if name:
            found.add_word(name, (name, id_))
    found.make_automaton()
    return found


def occurrences(found, text: str) -> list[Span]:
    """Whole-word occurrences of the automaton's names, in any case; those of one name don't overlap."""
    if not len(found):
        return []
    low, out, until = folded(text), [], {}
    inner = lambda i: 0 <= i < len(text) and _WORD.match(text[i]) is not None
    for last, (name, id_) in found.iter(low):
        start = last + 1 - len(name)
        if start >= until.get(name, 0) and inner(start - 1) != inner(start) and inner(last) != inner(last + 1):
            until[name] = last + 1
            out.append((start, last + 1, id_))
    return out


def chosen(spans: list[Span], longest: bool = False) -> list[Span]:
    """From left to right what does not overlap; of those that start together the shortest, or the longest."""
    out: list[Span] = []
    for span in sorted(spans, key=lambda s: (s[0], -s[1] if longest else s[1], s[2])):
        if not out or span[0] >= out[-1][1]:
            out.append(span)
    return out


def ties(text: str, spans: list[Span]) -> set[tuple[str, str]]:
    """Pairs of ids that the text connects, both ways. spans: chosen ones.

    The last id before a verb, not before the clause's start at `;`, `.` or `:`, goes with all ids
    behind it up to `;` or `.`; the last id before "exits:" goes with all in that clause.
    """
    starts, ends = [s[0] for s in spans], [s[1] for s in spans]
    opens = [m.start() for m in re.finditer(r"[;.:]", text)]
    closes = [p for p in opens if text[p] != ":"]
    out: set[tuple[str, str]] = set()

    def tie(before: int, least: int, first: int, stop: int) -> None:
        k = bisect_right(ends, before) - 1
        if k >= 0 and starts[k] >= least:
            for other in spans[bisect_left(starts, first) : bisect_right(ends, stop)]:
                if other[2] != spans[k][2]:
                    out.update([(spans[k][2], other[2]), (other[2], spans[k][2])])

    for verb in _VERB.finditer(text):
        k, j = bisect_left(opens, verb.start()), bisect_left(closes, verb.end())
        tie(verb.start(), opens[k - 1] + 1 if k else 0, verb.end(), closes[j] if j < len(closes) else len(text))
    for clause in _EXITS.finditer(text):
        tie(clause.start(), 0, clause.start(), clause.end())
    return out


def _stripped(name: str) -> str:
    return " ".join(w for w in name.lower().split() if w not in T.STOP_WORDS)


def parts(text: str) -> dict[str, list]:
    """Robots, items, places and edges of a mission's prose, by the names that the text itself gives ids."""
    ids = {name: id_ for name, id_ in ((_stripped(n), i) for n, i in _NAMED.findall(text)) if name}
    spans = chosen(occurrences(automaton((v, i) for n, i in ids.items() for v in variants(n)), text))
    edges = ties(text, spans)
    places = {a for a, _ in edges}
    robots = {i for i in ids.values() if i in ROBOTS}
    return {"robots": sorted(robots), "items": sorted(set(ids.values()) - places - robots), "places": sorted(places), "edges": sorted(map(list, edges))}


def mission_parts(missions: DataFrame, key: str, text: str) -> DataFrame:
    """(key, robots, items, places, edges) read from prose such as "hall (hall) connects to dock (dock) and the lab (lab)"."""

    @F.arrow_udf("struct<robots: array<string>, items: array<string>, places: array<string>, edges: array<array<string>>>")
    def read(texts: pa.Array) -> pa.Array:
        list_ = pa.list_(pa.string())
        kind = pa.struct([("robots", list_), ("items", list_), ("places", list_), ("edges", pa.list_(list_))])
        return pa.array([parts(t or "") for t in texts.to_pylist()], kind)

    return missions.select(key, read(text).alias("_p")).select(key, "_p.*")


def name_variants(names: DataFrame) -> DataFrame:
    """(name, id): cleaned names and their word suffixes, the least id of each. names: name, id."""
    clean = names.select(T.clean_name(F.col("name")).alias("name"), F.col("id").cast("string").alias("id")).where("name != ''")
    each = clean.select("id", F.explode(F.array_union(F.array("name"), T.word_suffixes(F.col("name")))).alias("name"))
    return each.groupBy("name").agg(F.min("id").alias("id"))


_built: dict[str, object] = {}


def _located(sent, which: str):
    @F.arrow_udf(_SPANS)
    def found(texts: pa.Array) -> pa.Array:
        if which not in _built:  # a worker keeps one
            _built.clear()
            _built[which] = automaton(zip(*sent.value, strict=True))
        spans = [occurrences(_built[which], t or "") for t in texts.to_pylist()]
        return _spans(spans)

    return found


def _spans(spans: list[list[Span]]) -> pa.Array:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("id", pa.string())]))
    return pa.array([[dict(zip(_FIELDS, s, strict=True)) for s in row] for row in spans], kind)


def located(docs: DataFrame, names: DataFrame, text: str = "text", out: str = "spans", most_bytes: int = MOST_BYTES) -> DataFrame:
    """docs with all occurrences of the names (name, id) in each text, overlapping ones too; null texts have none."""
    spark = docs.sparkSession
    bytes_ = names.agg(F.sum(F.octet_length("name") + F.octet_length("id") + 8)).first()[0] or 0
    n = -(-bytes_ // most_bytes)
    found = [F.array().cast(_SPANS)]
    for k in range(n):
        some = names.where(F.pmod(F.xxhash64("name"), F.lit(n)) == k).select("name", "id").toArrow()  # at most most_bytes or so
        sent = spark.sparkContext.broadcast((some["name"].to_pylist(), some["id"].to_pylist()))
        docs = docs.withColumn(f"_found{k}", _located(sent, uuid.uuid4().hex)(F.coalesce(F.col(text), F.lit(""))))
        found.append(F.col(f"_found{k}"))
    return docs.withColumn(out, F.array_sort(F.concat(*found))).drop(*[f"_found{k}" for k in range(n)])


def without_overlap(docs: DataFrame, spans: str = "spans", longest: bool = False) -> DataFrame:
    """docs with those spans alone that chosen() keeps."""

    @F.arrow_udf(_SPANS)
    def kept(rows: pa.Array) -> pa.Array:
        return _spans([chosen([(s["start"], s["end"], s["id"]) for s in row], longest) for row in rows.to_pylist()])

    return docs.withColumn(spans, kept(spans))
