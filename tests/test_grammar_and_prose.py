import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.operators import masks, prose

SCHEMA = {"Sequence": ["name"], "MoveTo": ["from", "robot", "to"], "Move": [], "Wait": ["msec"]}


def follows(text, vocabulary, schema=SCHEMA):
    """What the grammar allows after a half-written text, told token by token; None where anything goes."""
    if re.search(r'(from|to|location|item|robot|station|giver|receiver|robot1|robot2|edge_from|edge_to)="([^"]*)$', text):
        return None
    naming = re.search(r"</?([A-Za-z]*)$", text)
    if naming:
        typed, inside = naming[1], True
        names = [] if typed in schema else [t for t in schema if t.startswith(typed)]
    else:
        tag = re.search(r'<([A-Za-z]+)((?:\s+\w+="[^"]*")*)\s*$', text) if text.rfind("<") > text.rfind(">") else None
        if not tag or tag[1] not in schema:
            return None
        typed, inside = "", False
        names = [a + '="' for a in schema[tag[1]] if a not in re.findall(r"(\w+)=", tag[2])] + [">", "/>"]
    every = [*schema, ">", "/>", *[a + '="' for at in schema.values() for a in at]]
    out = set()
    for token in vocabulary:
        core = token if inside else token.lstrip()
        pooled = not core or any(w.startswith(core) or core.startswith(w) or core in w for w in every)
        if (not inside or token == token.strip()) and pooled and any(n.startswith(typed + core) or (typed + core).startswith(n) for n in names):
            out.add(token)
    return out or None


def test_grammar_masks_by_brute_force(spark):
    texts = ["<", "</", "<M", "<Mo", "<Move", "<MoveT", "<X", "<Wait ", "<Wait", '<Wait msec="1" ', '<Wait msec="1"', '<Wait msec="', '<MoveTo robot="a" to="b"', '<MoveTo robot="', "<MoveTo ", "<MoveTo rob", "", "a > b", "<Sequence>",
             "<Sequence>\n  <", '<Move >', "<Unknown ", "< ", '<MoveTo from="a"\n', "x<Seq"]
    names = ["Sequence", "MoveTo", "Wait", "name", 'name="', "robot", 'robot="a', "msec=", ">", "/>", "/", "><", "oveTo", "veTo>", "equence name", "Zeta"]
    vocabulary = {x[i:j] for x in names for i in range(len(x)) for j in range(i + 1, len(x) + 1)} | {" ", "\n", " name", ' to="', "  ", "\t>", "M ", "e ", "quence x", "\xa0robot"}
    schema = spark.createDataFrame(list(SCHEMA.items()), "tag string, attributes array<string>")
    cases = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    states = masks.grammar_states(cases, "id")
    hit = masks.grammar_tokens(states, schema, spark.createDataFrame([(t,) for t in vocabulary], "token string"))
    got = {}
    for r in states.select("id", "state").join(hit, "state").collect():
        got.setdefault(r.id, set()).add(r.token)
    for i, t in enumerate(texts):
        assert got.get(i) == follows(t, vocabulary), t


def test_grammar_of_nothing(spark):
    none = spark.createDataFrame([], "tag string, attributes array<string>")
    states = masks.grammar_states(spark.createDataFrame([(1, "<")], "id int, text string"), "id")
    assert masks.grammar_tokens(states, none, spark.createDataFrame([("a",)], "token string")).count() == 0


def plain_spans(names, text, longest=False):
    found = []
    for name, id_ in names:
        found += [(m.start(), m.end(), id_) for m in re.finditer(rf"\b{re.escape(name)}\b", text, re.IGNORECASE)]
    out, last = [], -1
    for s, e, i in sorted(found, key=lambda x: (x[0], -x[1] if longest else x[1], x[2])):
        if s >= last:
            out.append((s, e, i))
            last = e
    return out


def test_automaton_finds_what_a_search_for_each_name_finds():
    r = random.Random(8)
    words = ["old", "lab", "hall", "Old", "LAB", "o'hall", "lab-a", "é", "É", "x", "lab.", "(hall)", "İ", "a"]
    for _ in range(400):
        names = {" ".join(r.choices(["old", "lab", "hall", "x", "a", "é", "o'hall", "lab-a"], k=r.randint(1, 3))): f"n{k}" for k in range(r.randint(1, 6))}
        text = " ".join(r.choices(words, k=r.randint(0, 25)))
        found = prose.occurrences(prose.automaton(names.items()), text)
        for longest in (False, True):
            assert prose.chosen(found, longest) == plain_spans(names.items(), text, longest), (names, text)


def test_ties_by_brute_force():
    r = random.Random(1)
    for _ in range(300):
        pieces = r.choices(["A1", "B2", "C3", "D4", "connects to", "links", "exits:", ";", ".", ":", "and", "Exit: B2"], k=r.randint(0, 18))
        text = " ".join(pieces)
        spans = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[A-D]\d", text)]
        want = set()
        for m in re.finditer(r"\b(connects to|links)\b", text):
            left = max(text.rfind(c, 0, m.start()) for c in ";.:") + 1
            right = min([p for p in (text.find(c, m.end()) for c in ";.") if p > 0], default=len(text))
            before = [x for x in spans if x[1] <= m.start() and x[0] >= left]
            if before:
                want |= {(a, b) for x in spans if x[0] >= m.end() and x[1] <= right and x[2] != before[-1][2] for a, b in ((x[2], before[-1][2]), (before[-1][2], x[2]))}
        for m in re.finditer(r"\bexits?:([^;.]+)", text, re.I):
            before = [x for x in spans if x[1] <= m.start()]
            if before:
                want |= {(a, b) for x in spans if x[0] >= m.start() and x[1] <= m.end() and x[2] != before[-1][2] for a, b in ((x[2], before[-1][2]), (before[-1][2], x[2]))}
        assert prose.ties(text, spans) == want, text


def test_parts_of_a_mission():
    text = "Robot alpha (alpha) wakes at the Loading Dock (dock_1). The loading dock connects to: the cold store (store) and main hall (hall_2); main hall exits: lab (lab). Bring the red crate (crate)."
    got = prose.parts(text)
    assert got["robots"] == ["alpha"] and got["items"] == ["crate"] and got["places"] == ["dock_1", "hall_2", "lab", "store"]
    assert got["edges"] == [["dock_1", "hall_2"], ["dock_1", "store"], ["hall_2", "dock_1"], ["hall_2", "lab"], ["lab", "hall_2"], ["store", "dock_1"]]
    assert prose.parts("") == {"robots": [], "items": [], "places": [], "edges": []}


@pytest.mark.parametrize("most_bytes", [1 << 20, 40])
def test_names_over_a_table(spark, most_bytes):
    names = spark.createDataFrame([("the Old Mill Pond", 1), ("mill pond", 2), ("Pond", 3), ("of the", 4), (None, 5)], "name string, id int")
    texts = ["By the old mill pond, a Pond; MILL POND!", "ponds", None, "", "mill  pond", "x" * 50_000 + " pond"]
    docs = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "id int, text string, _found0x string")
    variants = prose.name_variants(names)
    held = [(r.name, r.id) for r in variants.collect()]
    assert dict(held) == {"old mill pond": "1", "mill pond": "1", "pond": "3"}
    got = {r.id: [(s.start, s.end, s.id) for s in r.spans] for r in prose.without_overlap(prose.located(docs, variants, most_bytes=most_bytes)).collect()}
    assert got == {i: plain_spans(held, t or "") for i, t in enumerate(texts)} and len(got[0]) == 3
    assert prose.located(docs, variants.where(F.lit(False))).select(F.sum(F.size("spans"))).first()[0] == 0
