"""Sentences about a mission: the summary of its facts, and prompts; a provider of texts with retries."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import passes_gate

STYLES = ("a direct, imperative mission briefing", "a narrative scenario description told like a short story setup", "a casual request, as if a facility manager is talking to the robot team")


def shown(name: Column, names: Column) -> Column:
    """The display name, or the id itself."""
    return F.coalesce(F.try_element_at(names, name), name)


def summary(meta: Column, names: Column) -> Column:
    """English lines for a mission's meta struct: who and what is where, the goals, the map, the faults."""
    at = F.filter(meta["init_dynamic"], lambda f: f[0].isin("at", "item_at"))
    starts = F.transform(at, lambda f: F.concat(shown(f[1], names), F.lit(" starts at "), shown(f[2], names), F.lit(".")))
    goals = F.transform(meta["goal"], lambda f: F.concat(F.lit("Goal: "), f[0], F.lit(" of "), F.array_join(F.transform(F.slice(f, 2, 8), lambda x: shown(x, names)), ", "), F.lit(".")))
    ways = F.transform(F.array_sort(meta["connected"]), lambda e: F.concat(shown(e[0], names), F.lit(" connects to "), shown(e[1], names), F.lit(".")))

    def trouble(f: Column) -> Column:
        blocked = F.concat(F.lit("The way between "), shown(f["edge"][0], names), F.lit(" and "), shown(f["edge"][1], names), F.lit(" is blocked."))
        weak = F.concat(shown(f["robot"], names), F.lit(" has power for "), f["budget"].cast("string"), F.lit(" moves."))
        fumble = F.concat(F.lit("The handover of "), shown(f["item"], names), F.lit(" may fail once."))
        return F.when(f["type"] == "blocked_edge", blocked).when(f["type"] == "battery", weak).otherwise(fumble)

    return F.array_join(F.concat(starts, goals, ways, F.transform(F.coalesce(meta["faults"], F.array().cast("array<struct<type:string,edge:array<string>,robot:string,budget:int,giver:string,receiver:string,item:string,times:int>>")), trouble)), "\n")


def prompt(facts: Column, row: Column) -> Column:
    """A request for a text; styles take turns."""
    style = F.element_at(F.array(*[F.lit(s) for s in STYLES]), (row % len(STYLES)).cast("int") + 1)
    return F.concat(F.lit("Write "), style, F.lit(" that states these facts and nothing else.\n\n"), facts)


def ask(jobs: DataFrame, key: str, text: str, provider: Callable[[str, float], str], temperature: float, tries: int = 4, wait: float = 2.0) -> DataFrame:
    """(key, content): the provider's answer to each prompt, '' after the last failure.

    Partitions bound how many calls run at once; each call waits longer after each failure.
    """

    def call(prompt_: str) -> str:
        for n in range(tries):
            try:
                return provider(prompt_, temperature)
            except Exception:
                time.sleep(min(2**n * wait, 30))
        return ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "content": [call(p) for p in b[text]]})

    kind = jobs.schema[key].dataType.simpleString()
    return jobs.select(key, text).mapInPandas(run, f"{key} {kind}, content string")


def written_missions(jobs: DataFrame, key: str, text: str, provider: Callable[[str, float], str]) -> DataFrame:
    """(key, content): two rounds, the second for those whose text did not pass; null where none did."""
    first = ask(jobs, key, text, provider, 0.9).where(passes_gate(F.col("content")))
    second = ask(jobs.join(first, key, "left_anti"), key, text, provider, 0.4).where(passes_gate(F.col("content")))
    return jobs.join(first.unionByName(second), key, "left")
