"""Repairs: suggest a column mapping, test it on a sample, replay quarantined rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import batches, checks
from tidewatch.operators.contracts import Contract

SIMILARITY = 0.5
SAMPLE = 20


def likeness(a: Column, b: Column) -> Column:
    """1 less the edits between two names as a share of the longer one."""
    return F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def suggest_mapping(drift: DataFrame) -> DataFrame:
    """(source, renames, drops) from (source, missing[], extra[]).

    A new column becomes a missing one where each is the other's closest name (ties: the first in order of
    name) and their likeness reaches ``SIMILARITY``; the other new columns are dropped. Equal drifts are one row.
    """
    def closest(name: Column, among: str) -> Column:
        ranked = F.transform(among, lambda o: F.struct((-likeness(name, o)).alias("far"), o.alias("name")))
        return F.array_min(ranked)

    pairs = F.transform("missing", lambda m: F.struct(m.alias("to"), closest(m, "extra").alias("near")))
    mutual = F.filter(pairs, lambda p: (p["near"]["far"] <= -SIMILARITY) & (closest(p["near"]["name"], "missing")["name"] == p["to"]))
    taken = F.transform("pairs", lambda p: p["near"]["name"])
    return drift.select("source", "missing", "extra").distinct().withColumn("pairs", mutual).select(
        "source", F.array_join(F.transform("pairs", lambda p: F.concat(p["near"]["name"], F.lit("->"), p["to"])), ",").alias("renames"),
        F.array_join(F.array_except("extra", taken), ",").alias("drops"))


def replay(quarantined: DataFrame, contract: Contract, order: Sequence[str], rename: Mapping[str, str],
           drop: Sequence[str] = (), check: Callable[[DataFrame], DataFrame] | None = None, held_for: Sequence[str] = ("schema",)) -> DataFrame:
    """Re-check unreleased rows held for one of ``held_for`` under a mapping; ``reasons`` is empty on rows that may be released.

    Rows are checked per source batch with the real context, in one job. ``quarantined`` carries
    ``payload`` (raw map), ``batch_file``, ``check_name``, ``released`` and the ``order`` columns.
    """
    held = quarantined.where((F.col("released") == 0) & F.col("check_name").isin(*held_for))
    # The mapping works on the few distinct key lists and on one key per column; no row is rebuilt as a map.
    gated = batches.schema_gate(held, batches.schema_drift(held, contract, order, rename=rename, drop=drop))
    view = batches.contract_view(gated, contract, list(dict.fromkeys(["batch_file", "gate_reason", *order])), rename, drop)
    checked = check(view) if check else checks.evaluate(view, contract, order)
    return batches.gate_reasons(checked)


def replay_test(quarantined: DataFrame, contract: Contract, order: Sequence[str], rename: Mapping[str, str],
                drop: Sequence[str] = (), n: int = SAMPLE) -> DataFrame:
    """Mapping tested on the first rows held for schema: passed when columns fit and a row is good."""
    held = quarantined.where((F.col("released") == 0) & (F.col("check_name") == "schema"))
    checked = replay(held.orderBy(*order).limit(n), contract, order, rename, drop)
    good = F.size("reasons") == 0
    counts = checked.agg(
        F.count(F.lit(1)).alias("sampled"), F.count_if(good).alias("good"), F.count_if(~good).alias("bad"),
        F.count_if(F.col("gate_reason").isNotNull()).alias("drifted"))
    return counts.select("sampled", "good", "bad", ((F.col("sampled") == 0) | (
        (F.col("drifted") == 0) & (F.col("good") > 0))).alias("passed"))


def left_in_quarantine(replayed: DataFrame) -> DataFrame:
    """Schema rows that stay after a replay, because they also had other problems."""
    return replayed.agg(F.count_if(F.size("reasons") == 0).alias("released"),
                        F.count_if(F.size("reasons") > 0).alias("remaining"))
