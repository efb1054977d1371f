"""Links inside families of similar sets, without comparing all pairs of a family.

A family holds all sets that can be links of each other, and maybe more. Its middle is made of the shingles that more than half of
its sets have; ``delta`` is how a set differs from it (shingles beyond the middle, and missing ones as their complement).
Two sets differ where exactly one of their deltas has an element, so deltas decide links as whole sets do, but are
short in a group of near copies. With ``excess`` = (100 + percent) * |delta| - (100 - percent) * n, two sets are links if and only if

    excess(x) + excess(y) <= 2 * (100 + percent) * |delta(x) & delta(y)|.

1. Every set is compared with its family's center, the one of least excess.
2. Sets that are not links of the center are loose. As no excess is less than the center's, a loose set shares elements of
   its delta with each of its links: at least half the sum of both excesses, over 100 + percent. So both have a common element among their
   rarest ones (prefix filter), and enough elements from there on (positional filter). Edits are rare in a group, so few sets
   that are no links meet there.

Every link of a loose set is found, and sets that are links of the center are one component, so components are exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.graph import components
from tidewatch.llm.tables import stage

# (a, b, delta_a, delta_b) rows to the same rows with ``both``, the number of common elements.
Overlap = Callable[[DataFrame], DataFrame]


def whole_overlap(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("both", F.size(F.array_intersect("delta_a", "delta_b")))


def families(members: DataFrame) -> DataFrame:
    """(node, family) from (key, node) rows: sets that share a key, directly or over others, are one family."""
    least = stage(members.groupBy("key").agg(F.min("node").alias("least")), "bucket-heads")
    edges = members.join(least, "key").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    return components(stage(edges, "family-edges")).withColumnRenamed("component", "family")


def deltas(sets: DataFrame, family_of: DataFrame, percent: int) -> DataFrame:
    """(family, node, n, delta, excess) from (node, n, shingles) and (node, family)."""
    sizes = family_of.groupBy("family").agg(F.count("*").alias("size"))
    members = stage(sets.join(stage(family_of.join(sizes, "family"), "sized-families"), "node"), "family-sets")
    counts = members.select("family", "size", F.explode("shingles").alias("shingle")).groupBy("family", "shingle").agg(F.count("*").alias("c"), F.first("size").alias("size"))
    middle = stage(counts.where("2 * c > size").groupBy("family").agg(F.collect_list("shingle").alias("middle")), "middles")
    none = F.array().cast("array<bigint>")
    beside = members.join(middle, "family", "left").withColumn("middle", F.coalesce("middle", none))
    missing = F.transform(F.array_except("middle", "shingles"), lambda x: F.bitwise_not(x))
    differing = beside.select("family", "node", "n", F.concat(F.array_except("shingles", "middle"), missing).alias("delta"))
    excess = F.lit(100 + percent) * F.size("delta") - F.lit(100 - percent) * F.col("n")
    return stage(differing.withColumn("excess", excess), "deltas")


def linked(percent: int) -> Column:
    return F.col("excess_a") + F.col("excess_b") <= F.lit(2 * (100 + percent)) * F.col("both")


def side(rows: DataFrame, name: str, *more: str) -> DataFrame:
    return rows.select(F.col("node").alias(name), F.col("delta").alias(f"delta_{name}"), F.col("excess").alias(f"excess_{name}"), *more)


def loose_pairs(differing: DataFrame, loose: DataFrame, percent: int) -> DataFrame:
    """(a, b): every link of a loose set is among these pairs; centers, which are compared already, are left out.

    ``loose``: (node, family, center, center_excess) of the loose sets.
    """
    unit = F.lit(2 * (100 + percent))
    marks = loose.join(differing.select("node", "excess"), "node").groupBy("family").agg(
        F.first("center").alias("center"), F.first("center_excess").alias("center_excess"), F.min("excess").alias("loose_excess"))
    open_sets = differing.join(stage(marks, "open-families"), "family").where("node <> center").join(loose.select("node", F.lit(True).alias("is_loose")), "node", "left")
    least_both = lambda other: F.greatest(F.lit(1), F.ceil((F.col("excess") + F.col(other)) / unit))
    elements = stage(open_sets.select("family", "node", "excess", F.coalesce("is_loose", F.lit(False)).alias("is_loose"), F.size("delta").alias("size"),
                                      least_both("center_excess").alias("need_loose"), least_both("loose_excess").alias("need"), F.explode("delta").alias("element")), "delta-elements")
    repeated = stage(elements.groupBy("family", "element").agg(F.count("*").alias("c")).where("c > 1"), "repeated-elements")
    rare_first = Window.partitionBy("node").orderBy("c", "element")
    found = elements.join(repeated, ["family", "element"]).withColumn("rank", F.row_number().over(rare_first)).withColumn("left", F.count("*").over(Window.partitionBy("node")) - F.col("rank") + 1)
    # The elements that no other set has come first in the order; ``left`` counts an element and what follows it.
    placed = stage(found, "placed-elements")
    a = placed.where("is_loose AND left >= need_loose").select("family", "element", F.col("node").alias("a"), F.col("excess").alias("excess_a"), F.col("left").alias("left_a"))
    b = placed.where("left >= need").select("family", "element", F.col("node").alias("b"), F.col("excess").alias("excess_b"), F.col("left").alias("left_b"), F.col("is_loose").alias("loose_b"))
    enough = unit * F.least("left_a", "left_b") >= F.col("excess_a") + F.col("excess_b")
    once = (F.col("a") < F.col("b")) | (~F.col("loose_b") & (F.col("a") > F.col("b")))
    return a.join(b, ["family", "element"]).where(enough & once).select("a", "b").distinct()


def links(sets: DataFrame, family_of: DataFrame, percent: int, overlap: Overlap = whole_overlap) -> DataFrame:
    """(a, b) links whose components are those of all links inside the families."""
    differing = deltas(sets, family_of, percent)
    centers = differing.groupBy("family").agg(F.min(F.struct("excess", "node")).alias("least")).select("family", F.col("least.node").alias("node"))
    center = stage(side(differing.join(centers, ["family", "node"]), "b", "family"), "centers")
    rays = side(differing, "a", "family").join(center, "family").where("a <> b")
    compared = stage(overlap(rays).select("a", "b", "family", "excess_b", linked(percent).alias("link")), "rays")
    near = compared.where("link").select("a", "b")
    loose = compared.where("NOT link").select(F.col("a").alias("node"), "family", F.col("b").alias("center"), F.col("excess_b").alias("center_excess"))
    if loose.isEmpty():
        return near
    pairs = stage(loose_pairs(differing, loose, percent), "loose-pairs")
    found = overlap(pairs.join(side(differing, "a"), "a").join(side(differing, "b"), "b"))
    return stage(near.unionByName(found.where(linked(percent)).select("a", "b")), "links")
