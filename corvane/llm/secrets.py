"""Secret scans with multipart credential linking.

Three base kinds stand alone: assignments, access identifiers, hexadecimal strings. Four weak kinds
(a bare blob, a vaguely named assignment, a user identifier, an endpoint) say little by themselves
and are reported only when a complementary part lies in their scope, REACH code points to either
side: a weak secret next to an identifier or an endpoint, an identifier or an endpoint next to a
secret. That is an interval semi-join of the parts within one text, by a sweep: all parts are sorted
by their start once, and a part has a partner if the furthest end of a complementary part before it
or the next start of one after it lies in its scope. It needs no shuffle, emits each candidate once
however many partners it has, and its work grows with the number of parts and not with their pairs.
Texts without a hit of any pattern cost one search for each pattern.

Positions come from the text between the matches: a match starts after all gaps and matches before
it, a running sum. Running values are made in pieces of PIECE elements, so that no list is copied
for each of its elements. Everything is built-in functions in one projection over the scan.

Defined results: null counts as the empty text, without spans. Rows that repeat a doc_id are
scanned alike. Spans are in code points, end exclusive. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import text_or_empty

REACH = 256
PIECE = 128
VALUE = r"""["']?\x20*[:=]\x20*["']?"""
#: kind: (pattern, group whose length counts, least length, part: secret, name or place)
BASE = {
    "assign": (rf"((?i:password|passwd|secret|token|api_?key)){VALUE}([A-Za-z0-9+/_.=-]+)", 2, 12, "secret"),
    "access": (r"AKIA[A-Z0-9]+", 0, 18, "name"),
    "hex": (r"[0-9a-f]{16,}", 0, 16, "secret"),
}
WEAK = {
    "blob": (r"[A-Za-z0-9+/]{32,}", 0, 32, "secret"),
    "weak": (rf"((?i:pwd|passphrase|private_?key|credential|auth)){VALUE}([A-Za-z0-9+/_.=-]+)", 2, 6, "secret"),
    "ident": (rf"((?i:client_?id|account_?id|key_?id|user_?name|login)){VALUE}([A-Za-z0-9+/_.@-]+)", 2, 3, "name"),
    "endpoint": (r"https?://[A-Za-z0-9.-]+", 0, 10, "place"),
}
KINDS = [*BASE, *WEAK]
_SPAN = "array<struct<start: int, no: int, end: int>>"


def _let(value: Column, body) -> Column:
    """body(value), the value being made once: an expression inside a lambda is made for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, zero: Column, of: str, step) -> Column:
    """The accumulator (of SQL type of) after each element, in pieces: n * PIECE / 2 + (n / PIECE)**2 / 2 copies."""
    none = F.array().cast(f"array<{of}>")

    def piece(acc, values):
        one = lambda a, x: _let(step(a["at"], x), lambda y: F.struct(y.alias("at"), F.concat(a["out"], F.array(y)).alias("out")))
        return F.aggregate(values, F.struct(acc.cast(of).alias("at"), none.alias("out")), one)

    def pieces(values):
        cuts = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / PIECE).cast("int")), lambda c: F.slice(values, c * PIECE + 1, F.lit(PIECE)))
        start = F.struct(zero.cast(of).alias("at"), F.array().cast(f"array<array<{of}>>").alias("done"))
        add = lambda a, p: _let(piece(a["at"], p), lambda r: F.struct(r["at"].alias("at"), F.concat(a["done"], F.array(r["out"])).alias("done")))
        return F.aggregate(cuts, start, add, lambda a: F.flatten(a["done"]))

    return _let(values, lambda v: F.when(F.size(v) > 0, pieces(v)).otherwise(none))


def _placed(steps: Column) -> Column:
    """Starts and ends of matches from the gaps and lengths, the latter null behind the last match."""
    ends = running(steps, F.lit(0), "int", lambda at, x: at + x["gap"] + F.coalesce(x["n"], F.lit(0)))
    each = F.zip_with(steps, ends, lambda x, end: F.struct((end - x["n"]).alias("start"), x["no"].alias("no"), end.alias("end"), (x["c"] >= x["least"]).alias("long")))
    return F.transform(F.filter(each, lambda x: x["long"]), lambda x: F.struct(x["start"].alias("start"), x["no"].alias("no"), x["end"].alias("end")))


def spans(text: Column, kinds: dict) -> Column:
    """The matches of each of some kinds that are long enough: leftmost, non-overlapping, in order; an array of arrays."""

    def steps(kind: str) -> Column:
        pattern, group, least, _ = kinds[kind]
        pat = F.lit(pattern)
        whole = F.regexp_extract_all(text, pat, F.lit(0))
        counted = F.regexp_extract_all(text, pat, F.lit(group)) if group else whole
        matches = F.zip_with(whole, counted, lambda w, c: F.struct(F.length(w).alias("n"), F.length(c).alias("c")))
        fixed = (F.lit(KINDS.index(kind)).alias("no"), F.lit(least).alias("least"))
        found = F.zip_with(F.split(text, pattern, -1), matches, lambda gap, m: F.struct(F.length(gap).alias("gap"), m["n"].alias("n"), m["c"].alias("c"), *fixed))
        return F.when(F.regexp_like(text, pat), found).otherwise(F.array().cast("array<struct<gap: int, n: int, c: int, no: int, least: int>>"))

    return F.transform(F.array(*[steps(k) for k in kinds]), _placed)


def near(sides: list[tuple[Column, Column, int, bool]]) -> Column:
    """Of each side (parts, to, reach, meet) the parts whose scope, reach to either side, meets a span of to, or
    meets none: a sweep over both in the order of their starts; an array of arrays."""

    def line(parts, to, reach, meet):
        tag = lambda spans, own: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), s["no"].alias("no")))
        whole = F.sort_array(F.concat(tag(to, 0), tag(parts, 1)))
        return F.struct(whole.alias("line"), F.lit(reach).alias("reach"), F.lit(meet).alias("meet"), (F.size(to) > 0).alias("any"))

    def furthest(x):
        """The greatest value of the spans looked for, up to each place; their ends, or their starts from behind, negative."""
        return running(x, F.lit(-(1 << 30)), "int", lambda at, y: F.greatest(at, y))

    def sweep(side):
        looked = lambda x, value: F.when(x["own"] == 0, value).otherwise(F.lit(-(1 << 30)))
        both = F.array(F.transform(side["line"], lambda x: looked(x, x["end"])), F.reverse(F.transform(side["line"], lambda x: looked(x, -x["start"]))))

        def met(ways):
            ends = F.zip_with(ways[0], F.reverse(ways[1]), lambda f, n: F.struct(f.alias("end"), (-n).alias("start")))
            return F.zip_with(side["line"], ends, lambda x, e: F.struct(x["start"], x["no"], x["end"], (x["own"] == 1).alias("own"),
                ((e["end"] > x["start"] - side["reach"]) | (e["start"] < x["end"] + side["reach"])).alias("meets")))

        found = _let(F.transform(both, furthest), met)
        return F.transform(F.filter(found, lambda x: x["own"] & (x["meets"] == side["meet"])), lambda x: F.struct(x["start"].alias("start"), x["no"].alias("no"), x["end"].alias("end")))

    return F.transform(F.array(*[line(*s) for s in sides]), sweep)


def _written(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["no"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(found), one), ",")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with an array of spans (start, no, end) for each kind: _assign .. _endpoint, weak kinds linked."""
    t = text_or_empty(text)
    nothing = F.array(*[F.array().cast(_SPAN)] * len(WEAK))
    weak_hit = F.regexp_like(t, F.lit("|".join(WEAK[k][0] for k in WEAK)))
    out = docs.withColumn("_found_base", spans(t, BASE)).withColumn("_found_weak", F.when(weak_hit, spans(t, WEAK)).otherwise(nothing))
    of = lambda every, part: F.flatten(F.array(*[F.col(c)[i] for c, kinds in (("_found_base", BASE), ("_found_weak", every)) for i, k in enumerate(kinds) if kinds[k][3] == part]))
    secrets = F.concat(*[F.col("_found_weak")[i] for i, k in enumerate(WEAK) if WEAK[k][3] == "secret"])
    others = F.concat(*[F.col("_found_weak")[i] for i, k in enumerate(WEAK) if WEAK[k][3] != "secret"])
    # a weak secret that overlaps a base span is that span again
    apart = near([(secrets, F.flatten("_found_base"), 0, False)])[0]
    out = out.withColumn("_apart", F.when(F.size(secrets) > 0, apart).otherwise(F.array().cast(_SPAN)))
    own = F.concat(of({}, "secret"), F.col("_apart"))
    named = F.concat(of(WEAK, "name"), of(WEAK, "place"))
    # weak secrets look for names and places, weak names and places for secrets
    linked = F.flatten(near([(F.col("_apart"), named, REACH, True), (others, own, REACH, True)]))
    out = out.withColumn("_linked", F.when(F.size(F.flatten("_found_weak")) > 0, linked).otherwise(F.array().cast(_SPAN)))
    only = lambda no: F.filter("_linked", lambda s: s["no"] == no)
    out = out.withColumns({f"_{k}": F.col("_found_base")[i] for i, k in enumerate(BASE)} | {f"_{k}": only(KINDS.index(k)) for k in WEAK})
    return out.drop("_found_base", "_found_weak", "_apart", "_linked")


def report(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = scan(docs.select("doc_id", "text"))
    count = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in BASE]
    base = _written(F.concat(*[F.col(f"_{k}") for k in BASE]))
    return found.select("doc_id", *count, F.sha2(base, 256).alias("base_sha256"), _written(F.concat(*[F.col(f"_{k}") for k in KINDS])).alias("spans"))
