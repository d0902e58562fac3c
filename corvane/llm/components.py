"""Connected components of an undirected graph, as repeated joins over its shrinking edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import counted, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is one node of the component.

    Every round hooks each node to the least of its neighbours and itself, follows the hooks one
    step further, and contracts the edges to what they point at. Edges inside a component vanish,
    so later rounds touch less. Minima are aggregated before they are shuffled, and the joins carry
    only pairs of numbers, which adaptive execution can split where a hub holds many edges.

    The first hooks are the first labels. After that a round writes its edges and its labels as one table, and counts the
    edges as it writes them, so that the driver has three plans to keep for each round.
    """
    pairs = edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, left = counted(pairs, "edges")
    labels = None
    while left:
        both = edges.union(edges.select("b", "a"))
        hook = materialize(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("w")).select("v", F.least("v", "w").alias("p")), "hooks")
        up = hook.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        hook = materialize(hook.join(up, "p", "left").select("v", F.coalesce("pp", "p").alias("p")), "hooks")
        to = lambda c: hook.select(F.col("v").alias(c), F.col("p").alias(f"p_{c}"))
        edges = (
            edges.join(to("a"), "a", "left").join(to("b"), "b", "left")
            .select(F.coalesce("p_a", "a").alias("x"), F.coalesce("p_b", "b").alias("y")).where("x != y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
        if labels is None:
            labels = hook.select(F.col("v").alias("node"), F.col("p").alias("root"))
            edges, left = counted(edges, "edges")
        else:
            labels = labels.join(to("root"), "root", "left").select("node", F.coalesce("p_root", "root").alias("root"))
            is_edge = F.col("edge")
            table, _, left = counted(edges.withColumn("edge", F.lit(True)).union(labels.withColumn("edge", F.lit(False))), "edges-labels", is_edge)
            edges = table.where(is_edge).select("a", "b")
            labels = table.where(~is_edge).select(F.col("a").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if labels is None else labels
