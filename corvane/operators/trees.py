"""Features of behavior trees, renamed skills, and damaged trees for the diagnosis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.ranking import draw
from corvane.functions.storage import materialize
from corvane.operators.missions import verdict
from corvane.operators.sampling import round_robin, stratified


def depth(xml: Column) -> Column:
    """Deepest nesting, the root at 0: a fold over the tags."""
    tags = F.regexp_extract_all(xml, F.lit(r"<(/?[A-Za-z][^>]*)>"), F.lit(1))

    def step(acc, t):
        closes, single = t.startswith("/"), t.endswith("/")
        here = F.when(closes, acc["at"] - 1).otherwise(acc["at"] + 1)
        return F.struct(F.when(single, acc["at"]).otherwise(here).alias("at"), F.greatest(acc["most"], F.when(closes, acc["most"]).otherwise(acc["at"] + 1)).alias("most"))

    return F.aggregate(tags, F.struct(F.lit(-1).alias("at"), F.lit(-1).alias("most")), step)["most"]


def tag_counts(names: Column, groups: dict[str, tuple[str, ...]]) -> list[Column]:
    """How many of the names are in each group, and all of them as n_nodes."""
    count = lambda of: F.size(F.filter(names, lambda x: x.isin(*of))).cast("long")
    return [*[count(of).alias(out) for out, of in groups.items()], F.size(names).cast("long").alias("n_nodes")]


def well_formed(xml: Column) -> Column:
    """Whether tags are closed in the order in which they were opened, under one root: a fold that keeps the open ones."""
    tags = F.regexp_extract_all(xml, F.lit(r"<(/?[A-Za-z][^>]*)>"), F.lit(1))
    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit(0).alias("roots"), F.lit(True).alias("ok"))

    def step(acc, t):
        name, closes, single = F.regexp_extract(t, r"^/?([A-Za-z][\w.:-]*)", 1), t.startswith("/"), t.endswith("/")
        fits = F.try_element_at(acc["open"], F.lit(-1)) == name
        left = F.slice(acc["open"], F.lit(1), F.greatest(F.size(acc["open"]) - 1, F.lit(0)))
        held = F.when(closes, left).when(single, acc["open"]).otherwise(F.concat(acc["open"], F.array(name)))
        root = (~closes & (F.size(acc["open"]) == 0)).cast("int")
        return F.struct(held.alias("open"), (acc["roots"] + root).alias("roots"), (acc["ok"] & (~closes | F.coalesce(fits, F.lit(False)))).alias("ok"))

    return F.coalesce(F.aggregate(tags, start, step, lambda a: a["ok"] & (F.size(a["open"]) == 0) & (a["roots"] == 1)), F.lit(False))


TREE_FEATURES = ("n_sync", "n_co", "n_fb", "depth", "n_nodes")


def structure_vector(records: DataFrame, xml: str, plan_len: Column, n_agents: Column, n_faults: Column) -> DataFrame:
    """records with the eight structural features; a tree that is not well formed has zeros for its five."""
    df = features(records.withColumn("_ok", well_formed(F.col(xml))), xml)
    df = df.withColumns({c: F.when(F.col("_ok"), F.col(c)).otherwise(0).cast("long") for c in TREE_FEATURES})
    own = {"plan_len": plan_len, "n_agents": n_agents, "n_faults": n_faults}
    return df.withColumns({k: F.coalesce(v, F.lit(0)).cast("long") for k, v in own.items()}).drop("_ok", "stage")


def features(trees: DataFrame, xml: str) -> DataFrame:
    """trees with counts of waits, joint actions, recoveries and nodes, the depth, and the stage."""
    df = trees.withColumn("_names", T.tag_names(F.col(xml)))
    count = lambda *of: F.size(F.filter("_names", lambda x: x.isin(*of)))
    df = df.withColumns({
        "n_sync": count("SignalReady", "WaitReady", "HandoverGive", "HandoverTake"), "n_co": count("CoPickUp", "CoMoveTo", "CoPlaceDown"),
        "n_fb": count("Fallback"), "n_nodes": F.size("_names"), "depth": depth(F.col(xml)),
    })
    return df.withColumn("stage", stage(F.col("n_fb"), F.col("n_sync"), F.col("n_co"))).drop("_names")


def stage(n_fb: Column, n_sync: Column, n_co: Column) -> Column:
    return F.when(n_fb > 0, 3).when((n_sync > 0) | (n_co > 0), 2).otherwise(1)


def stage_report(featured: DataFrame) -> DataFrame:
    """Rows and true means of the features by stage."""
    return featured.groupBy("stage").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("n_sync", "n_co", "n_fb", "depth", "n_nodes")])


#: Ways to damage a tree, as a pattern and what takes its place. The first tag that fits is meant.
DAMAGES = {
    "none": None,
    "no_block": (r"<root", "<rot"),
    "unknown_tag": (r"<PlaceDown ", "<PutAway "),
    "missing_attr": (r'<MoveTo robot="[a-z]+"', "<MoveTo"),
    "wrong_place": (r'(<MoveTo robot="[a-z]+" from="[a-z_]+" to=")[a-z_]+', "$1nowhere"),
    "no_recovery": (r"(?s)<Fallback>\s*(<[^>]*/>).*?</Fallback>", "$1"),
    "undefined_subtree": (r'<SubTree ID="Agent_alpha"', '<SubTree ID="Agent_omega"'),
}


def damaged(runs: DataFrame) -> DataFrame:
    """Every tree once for each damage."""
    cases = []
    for name, change in DAMAGES.items():
        xml = F.col("xml") if change is None else F.regexp_replace("xml", *change)
        cases.append(F.struct(F.lit(name).alias("damage"), xml.alias("xml")))
    return runs.withColumn("_c", F.explode(F.array(*cases))).withColumn("damage", F.col("_c.damage")).withColumn("xml", F.col("_c.xml")).drop("_c")


def family(scenario: Column) -> Column:
    return F.when(scenario.contains("+service"), "new_primitive").when(scenario.startswith("relay"), "relay").when(scenario.startswith("heavy"), "heavy").otherwise("independent")


def rename_skills(records: DataFrame, fraction: float, seed: str) -> DataFrame:
    """The sampled records with one simple skill renamed, judged again with the alias; others as they were.

    Families are sampled by their own share; a record's skill is drawn among those it has; names of a
    skill's pool take turns. A record whose renamed tree the judge refuses
    stays as it was, with success false and the name that was tried.
    """
    records = records.withColumn("family", family(F.get_json_object("meta", "$.scenario"))).withColumn("row", F.concat_ws("/", "domain", "tier", F.col("no").cast("string")))
    chosen = stratified(records, "family", "row", fraction, seed)
    skills = F.array_sort(F.array_intersect(F.array_distinct(T.tag_names(F.col("xml"))), F.array(*[F.lit(s) for s in T.RENAMES])))
    pick = F.try_element_at("_skills", (F.floor(draw(seed, F.lit("skill"), "row") * F.size("_skills")) + 1).cast("int"))
    chosen = chosen.withColumn("_skills", skills).withColumn("skill", pick).where("skill is not null")
    parts = []
    for skill, names in T.RENAMES.items():
        named = round_robin(chosen.where(F.col("skill") == skill), "skill", "row", list(names), "renamed_skill")
        xml = F.regexp_replace("xml", rf"<(/?){skill}([\s/>])", F.concat(F.lit("<$1"), F.col("renamed_skill"), F.lit("$2")))
        alias = F.concat(F.lit('"skill_aliases": {"'), F.col("renamed_skill"), F.lit(f'": "{skill}"}}'))
        parts.append(named.withColumn("xml", xml).withColumn("meta", F.replace("meta", F.lit('"skill_aliases": {}'), alias)))
    renamed = parts[0]
    for p in parts[1:]:
        renamed = renamed.unionByName(p)
    renamed = materialize(renamed.withColumn("success", verdict("meta", "xml")["success"]).drop("_skills", "skill").withColumn("tried_skill", F.col("renamed_skill")), "renamed")
    none = F.lit(None).cast("string")
    refused = renamed.where("not success").select(F.col("row").alias("_row"), "tried_skill")
    rest = records.join(renamed.where("success").select("row"), "row", "left_anti").join(refused, F.expr("row = _row"), "left").drop("_row")
    rest = rest.withColumn("renamed_skill", none).withColumn("success", F.col("tried_skill").isNull())
    return renamed.where("success").unionByName(rest)


def node_table(trees: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, node_id, parent_id, ord, depth, tag, attrs): a row for each element, the root's parent is null.

    Trees without a well-formed block give no rows.
    """
    import xml.etree.ElementTree as ET

    import pandas as pd

    from corvane.plans.judge import _BLOCK

    def nodes(batches):
        for b in batches:
            out = []
            for k, text in zip(b[key], b[xml], strict=True):
                block = _BLOCK.search(text or "")
                try:
                    line = [(ET.fromstring(block[0]), None, 0, 0)] if block else []
                except ET.ParseError:
                    line = []
                no = 0
                while line:
                    e, parent, ord_, level = line.pop()
                    out.append((k, no, parent, ord_, level, e.tag, dict(e.attrib)))
                    line += [(kid, no, i, level + 1) for i, kid in reversed(list(enumerate(e)))]
                    no += 1
            frame = pd.DataFrame(out, columns=[key, "node_id", "parent_id", "ord", "depth", "tag", "attrs"])
            yield frame.astype({"parent_id": "Int64"})

    kind = trees.schema[key].dataType.simpleString()
    return trees.select(key, xml).mapInPandas(nodes, f"{key} {kind}, node_id long, parent_id long, ord long, depth long, tag string, attrs map<string,string>")


def rename_report(records: DataFrame) -> DataFrame:
    """By family and new name (null: not sampled): how many were tried, renamed and refused by the judge."""
    return records.groupBy("family", "tried_skill").agg(F.count("*").alias("n"), F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("exec_failed"))
