"""Constrained decoding as data: which values a half-written tree allows, and which tokens lead to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.storage import materialize

#: Attributes whose values come from the platform. Fixed values.
LOCATION_ATTRS = ("from", "to", "location", "station", "edge_from", "edge_to")
ROBOT_ATTRS = ("robot", "giver", "receiver", "robot1", "robot2")
ITEM_ATTRS = ("item",)
_OPEN = r'(from|to|location|item|robot|station|giver|receiver|robot1|robot2|edge_from|edge_to)="([^"]*)$'
PLATFORM = ("robots", "items", "edges", "charge_stations")


def platform(tasks: DataFrame, *also: str) -> DataFrame:
    """The platform columns and nothing else: a goal or a plan must not reach the decoder."""
    wrong = [c for c in also if c not in PLATFORM]
    if wrong:
        raise KeyError(f"not a part of the platform: {', '.join(wrong)}")
    return tasks.select("task", *PLATFORM)


def open_attribute(text: Column) -> tuple[Column, Column, Column, Column]:
    """(attribute, what is typed of its value, tag, value of from in the same tag) at the end of the text; '' if there is none."""
    tail = F.regexp_extract(text, r"<([A-Za-z]+)([^<>]*)$", 2)
    start = F.regexp_extract(tail, r'\b(?:from|edge_from)="([^"]*)"', 1)
    return F.regexp_extract(text, _OPEN, 1), F.regexp_extract(text, _OPEN, 2), F.regexp_extract(text, r"<([A-Za-z]+)[^<>]*$", 1), start


def allowed_values(cases: DataFrame, text: str = "text", topology: bool = True) -> DataFrame:
    """cases (with the platform's columns) and allowed: null where no value is being written.

    Targets of a move are the neighbours of its start; partners of a signal are robots. A value ends
    with its quote, and what is typed must be its beginning.
    """
    attr, typed, tag, start = open_attribute(F.col(text))
    ends = F.flatten(F.transform("edges", lambda e: e))
    places = F.array_sort(F.array_distinct(ends))
    out_ = F.transform(F.filter("edges", lambda e: e[0] == F.col("_start")), lambda e: e[1])
    back = F.transform(F.filter("edges", lambda e: e[1] == F.col("_start")), lambda e: e[0])
    beside = F.array_sort(F.array_distinct(F.concat(out_, back)))
    df = cases.withColumns({"_attr": attr, "_typed": typed, "_tag": tag, "_start": start})
    partner = ((F.col("_tag") == "SignalReady") & (F.col("_attr") == "to")) | ((F.col("_tag") == "WaitReady") & (F.col("_attr") == "from"))
    near = F.col("_attr").isin("to", "edge_to") & (F.col("_start") != "") & F.lit(topology)
    pool = (
        F.when(F.col("_attr") == "", F.lit(None))
        .when(partner | F.col("_attr").isin(*ROBOT_ATTRS), F.col("robots"))
        .when(F.col("_attr").isin(*ITEM_ATTRS), F.col("items"))
        .when(F.col("_attr") == "station", F.col("charge_stations"))
        .when(near & (F.size(beside) > 0), beside)
        .otherwise(places)
    )
    quoted = F.transform(pool, lambda v: F.concat(v, F.lit('"')))
    df = df.withColumn("allowed", F.filter(quoted, lambda v: v.startswith(F.col("_typed"))))
    return df.drop("_attr", "_tag", "_start")


def allowed_tokens(cases: DataFrame, vocabulary: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, token): tokens that continue a value or go beyond its end; a case without any is unconstrained.

    Tokens and rests of values meet on their first letter, then the longer must begin with the shorter.
    """
    rests = cases.where("allowed is not null").select(key, F.explode("allowed").alias("v"), "_typed")
    rests = rests.select(key, F.expr("substring(v, length(_typed) + 1)").alias("rest")).where("rest != ''").distinct()
    rests = rests.withColumn("_first", F.substring("rest", 1, 1))
    tokens = vocabulary.select("token").where("token != ''").withColumn("_first", F.substring("token", 1, 1))
    hit = rests.join(tokens, "_first").where(F.col("rest").startswith(F.col("token")) | F.col("token").startswith(F.col("rest")))
    return hit.select(key, "token").distinct()


# --- grammar level: names of tags and attributes --------------------------------------------------

#: A tag's name being written, and an open tag whose attributes so far are complete.
_WRITING_TAG = r"</?([A-Za-z]*)$"
_IN_TAG = r'<([A-Za-z]+)((?:\s+\w+="[^"]*")*)\s*$'
_EDGE_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+"
CLOSINGS = (">", "/>")


def grammar_states(cases: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, state, place, tag, typed, used): where in the grammar each half-written text ends.

    place: `tag` while a tag's name is written, `attribute` where an attribute's name or the tag's
    end may come; else null, like the state, and the text goes on freely. Texts that end alike have
    one state, so that what follows is worked out once for each.
    """
    t = F.col(text)
    after = lambda c: F.length(F.substring_index(t, c, -1))
    open_tag = t.contains("<") & (after("<") < after(">")) & F.regexp_like(t, F.lit(_IN_TAG))
    place = F.when(F.regexp_like(t, F.lit(_OPEN)), F.lit(None)).when(F.regexp_like(t, F.lit(_WRITING_TAG)), "tag").when(open_tag, "attribute")
    used = F.array_sort(F.array_distinct(F.regexp_extract_all(F.regexp_extract(t, _IN_TAG, 2), F.lit(r"(\w+)="), F.lit(1))))
    at = F.col("place")
    df = cases.select(key, place.alias("place"), F.regexp_extract(t, _WRITING_TAG, 1).alias("typed"), F.regexp_extract(t, _IN_TAG, 1).alias("tag"), used.alias("used"))
    only = lambda p, c, other: F.when(at == p, F.col(c)).otherwise(other).alias(c)
    df = df.select(key, "place", only("tag", "typed", F.lit("")), only("attribute", "tag", F.lit("")), only("attribute", "used", F.array().cast("array<string>")))
    state = F.when(at.isNotNull(), F.concat_ws(":", "place", F.concat("tag", "typed"), F.array_join("used", ",")))
    return df.select(key, state.alias("state"), "place", "tag", "typed", "used")


def _trie(names: DataFrame, name: str) -> DataFrame:
    """(node, rest): each beginning of each name, and what is left of it."""
    at = F.explode(F.sequence(F.lit(0), F.length(name) - 1)).alias("_n")
    return names.select(name, at).select(F.expr(f"left({name}, _n)").alias("node"), F.expr(f"substring({name}, _n + 1)").alias("rest")).distinct()


def grammar_rests(states: DataFrame, schema: DataFrame) -> DataFrame:
    """(state, place, rest): what may follow in each state. schema: tag, attributes (an array).

    A name that is complete goes on freely, and so does a tag that the schema does not have.
    Attributes that the tag has already are left out.
    """
    writing = states.where("place = 'tag'").join(schema.select(F.col("tag").alias("typed")), "typed", "left_anti")
    names = writing.join(_trie(schema, "tag"), F.col("typed") == F.col("node")).select("state", "place", "rest")
    inside = states.where("place = 'attribute'").join(schema, "tag")
    left = F.transform(F.array_except(F.coalesce("attributes", F.array().cast("array<string>")), "used"), lambda a: F.concat(a, F.lit('="')))
    ends = F.array(*[F.lit(c) for c in CLOSINGS])
    return names.union(inside.select("state", "place", F.explode(F.concat(left, ends)).alias("rest"))).distinct()


def _in_pool(cores: DataFrame, schema: DataFrame, longest: int) -> DataFrame:
    """The cores that can go with any name: a part of one, or longer than one from its start."""
    attributes = schema.select(F.explode("attributes").alias("a")).select(F.concat("a", F.lit('="')).alias("name"))
    names = schema.select(F.col("tag").alias("name")).union(attributes).union(schema.sparkSession.createDataFrame([(c,) for c in CLOSINGS], "name string")).distinct()
    parts = names.select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("_i"))
    parts = parts.select(F.explode(F.transform(F.sequence(F.col("_i"), F.length("name")), lambda j: F.substring("name", F.col("_i"), j - F.col("_i") + 1))).alias("core")).distinct()
    starts = cores.select("core", F.explode(F.sequence(F.lit(1), F.least(F.length("core"), F.lit(longest)))).alias("_n")).withColumn("name", F.expr("left(core, _n)"))
    return cores.join(parts, "core", "left_semi").union(starts.join(names, "name", "left_semi").select("core")).distinct()


def grammar_tokens(states: DataFrame, schema: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(state, token): the tokens that go on with a name of the schema; a state without any is unconstrained.

    A token fits a rest if one of them begins with the other. Both are met through tries: beginnings
    of a rest are looked up among the tokens, beginnings of a token among the rests, so that all
    joins are equi-joins and the cost goes with the lengths of names and not with their pairs. Within a
    tag's name a token has no space at its edges; before an attribute those in front don't count.
    """
    # the schema, its states and rests are small and read several times
    schema = materialize(schema.select("tag", "attributes"), "schema")
    states = materialize(states.where("place is not null").select("state", "place", "tag", "typed", "used").distinct(), "states")
    rests = materialize(grammar_rests(states, schema), "rests")
    wanted = rests.select("place", "rest").distinct()
    longest = wanted.agg(F.max(F.length("rest"))).first()[0] or 0
    tokens = vocabulary.where("token != ''").select("token").distinct()
    bare = tokens.where(F.regexp_replace("token", f"^{_EDGE_SPACE}|{_EDGE_SPACE}$", "") == F.col("token"))
    cores = bare.select(F.lit("tag").alias("place"), F.col("token").alias("core"), "token")
    cores = cores.union(tokens.select(F.lit("attribute"), F.regexp_replace("token", f"^{_EDGE_SPACE}", ""), "token"))
    begun = wanted.select("place", "rest", F.explode(F.sequence(F.lit(0), F.length("rest"))).alias("_n")).withColumn("core", F.expr("left(rest, _n)"))
    shorter = begun.join(cores, ["place", "core"]).select("place", "rest", "token")
    beyond = cores.where(F.length("core") > 1).select("place", "core", "token", F.explode(F.sequence(F.lit(1), F.least(F.length("core") - 1, F.lit(max(1, longest))))).alias("_n"))
    longer = beyond.withColumn("rest", F.expr("left(core, _n)")).join(wanted, ["place", "rest"])
    pool = _in_pool(longer.select("core").distinct(), schema, max(1, longest + 1))
    hit = shorter.union(longer.join(pool, "core", "left_semi").select("place", "rest", "token")).distinct()
    return rests.join(hit, ["place", "rest"]).select("state", "token").distinct()
