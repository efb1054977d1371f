"""Connected components by contraction: hook every node to its least neighbour, follow two steps, contract, repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.tables import stage


def components(edges: DataFrame) -> DataFrame:
    """(a, b) pairs to (node, component), component being one node of each; nodes without edges are absent.

    Every round is a written table; least neighbours are found with map-side combining, so a node with very many
    neighbours costs one row per task. Trees at least halve the nodes that still have edges.
    """
    left = stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while True:
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = stage(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")), "hooks")
        step = hooks.select(F.col("node").alias("_n"), F.col("up").alias("_u"))
        twice = stage(hooks.join(step, F.col("up") == F.col("_n")).select("node", F.col("_u").alias("up")), "hooks")
        labels = twice.select("node", F.col("up").alias("component")) if labels is None else stage(
            labels.join(twice.select(F.col("node").alias("_n"), "up"), F.col("component") == F.col("_n"), "left")
            .select("node", F.coalesce("up", "component").alias("component")), "labels")
        to_a = twice.select(F.col("node").alias("a"), F.col("up").alias("_a"))
        to_b = twice.select(F.col("node").alias("b"), F.col("up").alias("_b"))
        left = stage(left.join(to_a, "a").join(to_b, "b").where("_a <> _b")
                     .select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "edges")
        if left.isEmpty():
            return labels
