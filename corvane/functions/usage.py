"""Counters of what a job used, collected while it runs: no second pass over its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

COUNTERS = ("calls", "cache_hits", "prompt_tokens", "completion_tokens")


def observed(answers: DataFrame, hit: Column, prompt_tokens: Column, completion_tokens: Column) -> tuple[DataFrame, Observation]:
    """answers, and an observation that holds the counters once they have been computed.

    Tokens are those of calls; what came out of a cache used none. A failed task's second attempt
    is not counted twice: an observation takes the figures of the plan that was run.
    """
    seen = Observation("usage")
    hit = F.coalesce(hit, F.lit(False))
    spent = lambda c: F.coalesce(F.sum(F.when(~hit, c)), F.lit(0)).cast("long")
    counters = F.count_if(~hit), F.count_if(hit), spent(prompt_tokens), spent(completion_tokens)
    return answers.observe(seen, *[c.alias(n) for c, n in zip(counters, COUNTERS, strict=True)]), seen


def usage(seen: Observation) -> dict[str, int]:
    """The counters; 0 where nothing was computed."""
    held = seen.get
    return {n: int(held.get(n) or 0) for n in COUNTERS}
