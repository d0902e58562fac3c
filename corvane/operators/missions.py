"""Missions as rows: corpus building, bulk judging and diagnosis of failures.

The state machines are local to a row, so they run in Arrow batches; what surrounds them (quotas,
filters, deduplication, classification, metrics) is DataFrame algebra.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.storage import materialize
from corvane.plans.compiler import compile_tree
from corvane.plans.judge import judge
from corvane.plans.world import DOMAINS, sample_mission, world_of

_STR, _LONG = T.StringType(), T.LongType()
VERDICT = T.StructType([T.StructField(n, t) for n, t in (("success", T.BooleanType()), ("reason", _STR), ("ticks", _LONG), ("recoveries", _LONG))])
_EVENT = T.StructType([T.StructField(n, t) for n, t in (
    ("name", _STR), ("binding", T.MapType(_STR, _STR)), ("result", _STR), ("missing", T.ArrayType(_STR)), ("note", _STR))])
TRACED = T.StructType([T.StructField(n, t) for n, t in (
    ("verdict", VERDICT), ("trace", T.ArrayType(_EVENT)), ("places", T.ArrayType(_STR)), ("reach", T.ArrayType(_STR)))])
# fixed values: share of the tiers T1, T2, T3 by split
MIX = {"train": (0.3, 0.5, 0.2), "val": (0.3, 0.5, 0.2), "test": (0.2, 0.4, 0.4)}


@F.pandas_udf(VERDICT)
def verdict(meta: pd.Series, xml: pd.Series) -> pd.DataFrame:
    """Judges each row's tree against its mission (meta as JSON)."""
    rows = [judge(json.loads(m), x) if x else {"success": False, "reason": "no_xml_block", "ticks": 0, "recoveries": 0} for m, x in zip(meta, xml, strict=True)]
    return pd.DataFrame(rows, columns=["success", "reason", "ticks", "recoveries"])


@F.pandas_udf(TRACED)
def traced(meta: pd.Series, xml: pd.Series) -> pd.DataFrame:
    """The verdict with the events of the leaves, and what the classifier must know of the world."""
    out = []
    for m, x in zip(meta, xml, strict=True):
        m, events = json.loads(m), []
        result = judge(m, x or "", events.append)
        world = world_of(m)
        trace = [{"name": e["name"], "binding": dict(e["binding"]), "result": e["result"], "missing": [" ".join(map(str, f)) for f in e["missing"]], "note": e["note"]} for e in events]
        out.append({"verdict": result, "trace": trace, "places": world.locations, "reach": sorted(f"{f[1]} {f[2]}" for f in world.static if f[0] == "can_reach")})
    return pd.DataFrame(out, columns=["verdict", "trace", "places", "reach"])


def error_type(reason: Column, first: Column, places: Column, reach: Column) -> Column:
    """The kind of a failure, from the verdict's reason and the first leaf that failed (null: none)."""
    r, note = F.lower(reason), F.coalesce(first["note"], F.lit(""))
    has = lambda *words: F.regexp_like(r, F.lit("|".join(words)))
    error = (
        F.when(has("parse", "no <root", "top tag"), "structural_parse")
        .when(has("unknown action", "unknown node tag"), "hallucinated_node")
        .when(has("missing attr"), "missing_attr")
        .when(has("subtree", "main tree", "empty"), "structural_tree")
        .when(has("tick limit", "deadlock"), "deadlock")
        .otherwise("structural_other")
    )
    attr = lambda k: F.try_element_at(first["binding"], F.lit(k))
    start, end = attr("from"), attr("to")
    known = F.array_contains(places, start) & F.array_contains(places, end) & (start != end)
    wrong_move = (
        F.when(~F.coalesce(known, F.lit(False)), "attr_value_hallucinated")
        .when(~F.array_contains(reach, F.concat_ws(" ", attr("robot"), end)), "attr_wrong_location")
        .otherwise("missing_intermediate_leg")
    )
    missing = F.array_join(first["missing"], ", ")
    return (
        F.when(reason.startswith("error:"), error)
        .when(reason == "cycle_limit", "deadlock")
        .when(reason == "tree_done_goal_missing", "goal_segment_missing")
        .when(first.isNull(), "other")
        .when(note == "condition", "condition_guard_failed")
        .when((note == "ungroundable") & (first["name"] == "MoveTo"), wrong_move)
        .when(note == "ungroundable", "attr_value_hallucinated")
        .when(note == "joint", "handover_miscoord")
        .when(note.contains("cannot_reach"), "attr_wrong_location")
        .when(note.contains("blocked"), "fault_recovery_missing")
        .when(note.contains("battery"), "battery_recovery_missing")
        .when(F.exists(first["missing"], lambda m: m.startswith("at ")), "position_precondition_missing")
        .when(missing != "", "other_precondition_missing")
        .otherwise("other")
    )


def diagnose(runs: DataFrame, key: str, meta: str = "meta", xml: str = "xml") -> DataFrame:
    """(key, success, reason, first_failure, terminal_failure, error_type) of each run."""
    t = runs.withColumn("_t", traced(meta, xml))
    failed = F.filter("_t.trace", lambda e: e["result"] == "FAILURE")
    t = t.withColumn("_first", F.try_element_at(failed, F.lit(1))).withColumn("_last", F.try_element_at(failed, F.lit(-1)))
    kind = error_type(F.col("_t.verdict.reason"), F.col("_first"), F.col("_t.places"), F.col("_t.reach"))
    return t.select(
        key, F.col("_t.verdict.success").alias("success"), F.col("_t.verdict.reason").alias("reason"), F.col("_first.name").alias("first_failure"),
        F.col("_last.name").alias("terminal_failure"), F.when(~F.col("_t.verdict.success"), kind).alias("error_type"),
    )


def quotas(spark: SparkSession, split: str, per_domain: int) -> DataFrame:
    """(domain, tier, n): per_domain times the tier's share, rounded half to even."""
    of = "test" if split == "test" else "train"
    rows = [(d, t, m) for d, (s, *_) in DOMAINS.items() if s == of for t, m in zip(("T1", "T2", "T3"), MIX[split], strict=True)]
    return spark.createDataFrame(rows, "domain string, tier string, share double").select("domain", "tier", F.bround(F.col("share") * per_domain).cast("int").alias("n"))


def _candidates(batches: Iterator[pd.DataFrame], seed: str) -> Iterator[pd.DataFrame]:
    for jobs in batches:
        out = []
        for domain, tier, n, no in zip(jobs["domain"], jobs["tier"], jobs["n"], jobs["no"], strict=True):
            made = sample_mission(domain, tier, f"{seed}/{no}")
            if made:
                steps = made.pop("steps")
                key = json.dumps([made[k] for k in ("domain", "init_dynamic", "goal", "faults", "connected")], sort_keys=True)
                out.append((domain, tier, n, no, json.dumps(made, sort_keys=True), compile_tree(made, steps), key))
        yield pd.DataFrame(out, columns=["domain", "tier", "n", "no", "meta", "xml", "task"])


def build_corpus(spark: SparkSession, split: str, per_domain: int, seed: str, spares: tuple[float, ...] = (1.5, 8.0, 40.0)) -> DataFrame:
    """(domain, tier, no, record_id, meta, xml): missions that the judge drives to their goal.

    Candidates are drawn by number, each from its own seed, so any task can make any of them. Equal
    tasks of a domain and tier count once, the first by number. Quotas that stay open are tried
    with more candidates, up to 40 times as many as wanted; one that is open after that is an error.
    """
    wanted = quotas(spark, split, per_domain)
    kept, todo = None, wanted.withColumn("begin", F.lit(0))
    for spare in spares:
        kept = materialize(_built(spark, wanted, todo, split, seed, spare, kept), "corpus")
        have = kept.groupBy("domain", "tier").agg(F.count("*").alias("_have"))
        open_ = wanted.join(have, ["domain", "tier"], "left").where("coalesce(_have, 0) < n").collect()  # quotas
        if not open_:
            return kept.drop("task")
        todo = spark.createDataFrame([(r.domain, r.tier, r.n, int(-(-r.n * spare // 1)) + 4) for r in open_], "domain string, tier string, n int, begin int")
    raise ValueError(f"too few missions reach their goal: {[(r.domain, r.tier) for r in open_]}")


def _built(spark: SparkSession, wanted: DataFrame, todo: DataFrame, split: str, seed: str, spare: float, kept: DataFrame | None) -> DataFrame:
    """The missions kept so far and those of the candidates from begin on, the first n of each quota."""
    jobs = todo.withColumn("no", F.explode(F.sequence(F.col("begin"), F.ceil(F.col("n") * spare).cast("int") + 3))).drop("begin")
    jobs = jobs.repartition(max(1, spark.sparkContext.defaultParallelism), "domain", "tier", "no")
    made = jobs.mapInPandas(lambda it: _candidates(it, f"{seed}/{split}"), "domain string, tier string, n int, no int, meta string, xml string, task string")
    good = made.withColumn("v", verdict("meta", "xml")).where("v.success")
    good = good.select("domain", "tier", "no", F.sha2(F.concat("meta", F.lit("\n"), "xml"), 256).alias("record_id"), "meta", "xml", F.col("v.ticks").alias("ticks"), F.col("v.recoveries").alias("recoveries"), "task")
    both = good if kept is None else kept.unionByName(good)
    first = Window.partitionBy("domain", "tier", "task").orderBy("no")
    line = Window.partitionBy("domain", "tier").orderBy("no")
    ranked = both.withColumn("_r", F.row_number().over(first)).where("_r = 1").withColumn("_k", F.row_number().over(line))
    return ranked.join(F.broadcast(wanted), ["domain", "tier"]).where("_k <= n").select(*good.columns)  # one row for each quota


def fault_candidates(steps: DataFrame) -> DataFrame:
    """(task, kind, what, most): every way that a task's plan takes may be blocked; a robot of two moves or more may
    run out of power after all but one. steps: task, robot, l1, l2, one row for each move."""
    ways = steps.select("task", F.lit("blocked_edge").alias("kind"), F.concat_ws(">", "l1", "l2").alias("what"), F.lit(None).cast("long").alias("most")).distinct()
    robots = steps.groupBy("task", "robot").agg(F.count("*").alias("n")).where("n >= 2")
    return ways.unionByName(robots.select("task", F.lit("battery").alias("kind"), F.col("robot").alias("what"), (F.col("n") - 1).alias("most")))
