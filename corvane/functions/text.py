"""Text expressions: gates, tags, names, chat turns, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------------------
#: What gives a formal description away, in any case.
LEAKS = (
    r"\(:", r"\bPDDL\b", r"\bSTRIPS\b", r"\bprecondition", r"\bpredicate", "∀", "∃", "∧", "∨", "¬", "→", "<root", "<Sequence", "<Fallback",
    "<BehaviorTree", r"\bitem_at\b", r"\bcan_reach\b", r"\bco_carrying\b", r"\bcarrying\(", r"\bat\(", r"\bconnected\(",
)
#: Words that are no part of a name.
STOP_WORDS = (
    "at", "the", "a", "an", "to", "where", "you", "your", "start", "starts", "take", "it", "directly", "and", "connects", "connect", "is", "are", "in",
    "on", "of", "wakes", "already", "left", "into", "one", "two", "has", "have", "exits", "exit", "straight", "through", "coordinate", "routes", "each",
    "other", "watch", "for", "be", "ready", "retry", "may", "fumble", "between", "only", "available", "report", "when", "both", "items", "places",
    "place", "avoid", "unnecessary", "delays", "shared", "corridors", "charging", "station", "stations", "recharging", "recharge", "set", "leads", "lead",
    "links", "link", "linked", "joins", "joined", "begin", "begins", "from", "mission", "objective", "objectives", "relocate", "relocates", "deposit",
    "plan", "approach", "transport", "execute", "use", "layout", "damaging", "property", "needed", "need", "must", "will", "then", "next", "finally",
    "first", "second", "team", "robots", "robot", "wake", "started", "beginning",
)
#: A name and the id in parentheses after it.
NAME_ID = r"([A-Za-z][A-Za-z'\- ]*?)\s*\(([a-z_0-9]+)\)"
#: Names that a renamed skill can take.
RENAMES = {
    "PickUp": ("FetchItem", "GrabItem", "RetrieveItem", "CollectItem", "AcquireItem"),
    "PlaceDown": ("PlaceItem", "DepositItem", "DeliverItem", "SetItemDown", "UnloadItem"),
    "MoveTo": ("DriveTo", "NavigateTo", "TravelTo", "GoTo"),
    "Recharge": ("PowerUp", "ChargeUp", "DockAndCharge", "RechargeBattery"),
    "ClearPath": ("ClearDebris", "UnblockPath", "RemoveDebris", "OpenPath"),
}
# -------------------------------------------------------------------------------------------------


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def passes_gate(text: Column, least: int = 60, most: int = 2000) -> Column:
    """Not empty, no leak in any case, and strictly between the two lengths."""
    t = stripped(text)
    leak = F.regexp_like(t, F.lit("(?i)" + "|".join(LEAKS)))
    return (F.length(t) > least) & (F.length(t) < most) & ~leak


def rename_tag(xml: Column, old: str, new: str) -> Column:
    return F.regexp_replace(xml, rf"<(/?){old}([\s/>])", rf"<$1{new}$2")


def opening_tags(xml: Column) -> Column:
    return F.regexp_extract_all(xml, F.lit(r"<[^/!?>][^>]*>"), F.lit(0))


def tag_names(xml: Column) -> Column:
    return F.regexp_extract_all(xml, F.lit(r"<([A-Za-z][A-Za-z0-9]*)[\s/>]"), F.lit(1))


def attribute_schema(pages: DataFrame, html: str) -> DataFrame:
    """(tag, attributes): the sorted names of attributes that each tag has anywhere."""
    tags = pages.select(F.explode(opening_tags(F.col(html))).alias("t"))
    name = F.regexp_extract("t", r"^<([A-Za-z][A-Za-z0-9]*)", 1)
    names = F.regexp_extract_all("t", F.lit(r"\s([A-Za-z-]+)="), F.lit(1))
    pairs = tags.select(name.alias("tag"), F.explode_outer(names).alias("a")).where("tag != ''")
    return pairs.groupBy("tag").agg(F.array_join(F.array_sort(F.collect_set("a")), ",").alias("attributes"))


def chat_prompt(turns: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """Plain chat template: the turns' texts in order, parted by blank lines, then the assistant's cue."""
    line = F.concat(F.col(role), F.lit(": "), F.col(text))
    held = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), line.alias("line"))))
    joined = F.array_join(F.transform(held, lambda x: x["line"]), "\n\n")
    return turns.groupBy(key).agg(F.concat(F.regexp_replace(joined, r"\s+$", ""), F.lit("\n\nassistant:\n")).alias("prompt"))


def prompt_and_completion(turns: DataFrame, key: str, turn: str, role: str, text: str, end: str) -> DataFrame:
    """(key, prompt, completion): a conversation up to its last answer, and that answer with the end of text, once."""
    last = turns.where(F.col(role) == "assistant").groupBy(key).agg(F.max(F.struct(turn, text)).alias("_last"))
    before = turns.join(last, key).where(F.col(turn) < F.col(f"_last.{turn}"))
    answer = F.coalesce(F.col(f"_last.{text}"), F.lit(""))
    closed = F.when(answer.endswith(end), answer).otherwise(F.concat(answer, F.lit(end)))
    return chat_prompt(before, key, turn, role, text).join(last.select(key, closed.alias("completion")), key)


def per_stage(given: str, stages: int, kind: type = float) -> list:
    """A parameter for each stage from "1" or "1,2,3"; another number of values is an error."""
    held = [kind(x) for x in given.split(",")]
    if len(held) not in (1, stages):
        raise ValueError(f"{len(held)} values for {stages} stages")
    return held * stages if len(held) == 1 else held


def names_and_ids(text: Column) -> Column:
    """Pairs of a name and the id in parentheses after it; names may hold apostrophes and hyphens."""
    pattern = F.lit(NAME_ID)
    return F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("name"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("id"))


def name_map(text: Column) -> Column:
    """Names in lower case to their ids; of several ids of a name the last one counts."""
    each = F.transform(names_and_ids(text), lambda p: F.struct(F.lower(p["name"]).alias("name"), p["id"].alias("id")))
    last = F.filter(each, lambda p, i: ~F.exists(F.slice(each, i + 2, F.greatest(F.size(each), F.lit(1))), lambda q: q["name"] == p["name"]))
    return F.map_from_entries(last)


def clean_name(name: Column) -> Column:
    """Lower case, without stop words."""
    words = F.filter(F.split(F.lower(name), r"\s+"), lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    return F.array_join(words, " ")


def word_suffixes(name: Column, least: int = 2) -> Column:
    """The name without its first words, as long as least words are left."""
    words = F.split(name, r"\s+")
    starts = F.when(F.size(words) >= least, F.sequence(F.lit(1), F.size(words) - (least - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.size(words)), " "))


def record_id(*fields: Column) -> Column:
    """Identity of a record: SHA-256 of its fields, each with its length before it."""
    parts = [F.concat(F.octet_length(f).cast("string"), F.lit(":"), f) for f in fields]
    return F.sha2(F.concat(*parts), 256)
