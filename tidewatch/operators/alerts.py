"""Alerts as a pure function of the findings log: one open alert per (source, check).

The history is a set of islands. Batches are numbered per source; a failure opens a new alert when
more than ``resolve_after`` batches lie between it and the failure before it, because that many
clean batches have closed the earlier alert.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import skew
from tidewatch.operators.contracts import RESOLVE_AFTER_CLEAN_BATCHES
from tidewatch.operators.sequence import scan

KEY = ["source", "check_name"]


def number_batches(registry: DataFrame) -> DataFrame:
    """``batch_no`` per source in order of arrival, over (source, file, ingested_at)."""
    days = registry.withColumn("day", F.to_date("ingested_at"))
    return scan(days, ["source"], "day", ["ingested_at", "file"], {"batch_no": ("ordinal", None)})


def mark_episodes(failures: DataFrame, resolve_after: int = RESOLVE_AFTER_CLEAN_BATCHES,
                  repairs: DataFrame | None = None) -> DataFrame:
    """Add ``episode`` (1, 2, ... per source and check) to failures (source, check_name, batch_no, ts, ...).

    ``repairs(source, check_name, ts)`` close the open alert at once, so the next failure opens a
    new one. Repair rows come out too, with ``is_repair`` set and the episode they closed.
    """
    rows = failures.withColumn("is_repair", F.lit(0))
    if repairs is not None:
        rows = rows.unionByName(repairs.withColumn("is_repair", F.lit(1)), allowMissingColumns=True)
    rows = rows.withColumn("__day", F.to_date("ts")).withColumn("__no", F.coalesce("batch_no", F.lit(-1).cast("long")))
    order = ["ts", "is_repair", "__no"]
    rows = scan(rows, KEY, "__day", order, {"__prev": ("previous", F.struct("__no", "is_repair"))})
    opens = F.col("__prev").isNull() | (F.col("__prev.is_repair") == 1) | (
        F.col("__no") - F.col("__prev.__no") > resolve_after)
    starts = F.when((F.col("is_repair") == 0) & opens, 1).otherwise(0).cast("long")
    rows = scan(rows, KEY, "__day", order, {"episode": ("running_sum", starts)})
    return rows.drop("__day", "__no", "__prev")


def episodes(failures: DataFrame, batches: DataFrame, resolve_after: int = RESOLVE_AFTER_CLEAN_BATCHES,
             repairs: DataFrame | None = None) -> DataFrame:
    """One row per alert. ``batches(source, batch_no, ts)`` holds every batch, clean ones included."""
    marked = mark_episodes(failures, resolve_after, repairs).where(F.col("episode") > 0)
    failed = F.col("is_repair") == 0
    when = lambda c: F.when(failed, F.col(c))
    alerts = marked.groupBy(*KEY, "episode").agg(
        F.min(when("ts")).alias("first_seen"), F.max(when("ts")).alias("last_seen"),
        F.count(when("ts")).alias("occurrences"), F.max(when("batch_no")).alias("last_batch"),
        F.min(F.when(~failed, F.col("ts"))).alias("repaired_at"))
    closing = batches.select("source", (F.col("batch_no") - resolve_after).alias("last_batch"), F.col("ts").alias("cleared_at"))
    newest = batches.groupBy("source").agg(F.max("batch_no").alias("newest_batch"))
    alerts = alerts.join(closing, ["source", "last_batch"], "left")
    alerts = skew.lookup(alerts, ["source"], newest)
    resolved = F.least("cleared_at", "repaired_at")
    return alerts.select(
        *KEY, "episode", "first_seen", "last_seen", "occurrences",
        F.least(F.col("newest_batch") - F.col("last_batch"), F.lit(resolve_after)).cast("long").alias("clean_batches"),
        F.when(resolved.isNull(), "OPEN").otherwise("RESOLVED").alias("status"), resolved.alias("resolved_at"))


def state(failures: DataFrame, resolve_after: int = RESOLVE_AFTER_CLEAN_BATCHES) -> DataFrame:
    """What each alert shows: first severity and node, latest problem, details merged key by key
    with later batches winning. ``failures`` carries severity, node, problem and a ``detail`` map."""
    marked = mark_episodes(failures, resolve_after)
    key = [*KEY, "episode"]
    shown = marked.groupBy(*key).agg(
        F.min_by("severity", "batch_no").alias("severity"), F.min_by("node", "batch_no").alias("node"),
        F.max_by("problem", "batch_no").alias("problem"))
    merged = marked.select(*key, "batch_no", F.explode("detail").alias("k", "v")).groupBy(*key, "k").agg(
        F.max_by("v", "batch_no").alias("v"))
    merged = merged.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("detail"))
    return shown.join(merged, key, "left")


def advance(known: DataFrame, failures: DataFrame, batches: DataFrame, resolve_after: int = RESOLVE_AFTER_CLEAN_BATCHES) -> DataFrame:
    """The alerts that one load opens, extends or clears: ``known`` (alerts so far) advanced by the load's failures and batches.

    Applied load by load, this gives the same alerts as ``episodes`` and ``state`` over the whole log, while it orders and folds only
    the load's own failures and the newest alert of each failing (source, check). Rows carry ``last_batch``, from which the
    next load goes on. Batch numbers continue from load to load; ``failures`` and ``batches`` are as in ``state`` and ``episodes``.
    """
    by_batch = known.where(F.col("last_batch").isNotNull())  # alerts of ``stand`` follow no batches
    newest = by_batch.groupBy(*KEY).agg(F.max_by(F.struct("episode", "last_batch", "last_seen"), "episode").alias("a"))
    top = known.groupBy(*KEY).agg(F.max("episode").alias("top"))
    seeds = newest.join(failures.select(*KEY).distinct(), KEY, "left_semi").select(
        *KEY, F.col("a.last_batch").alias("batch_no"), F.col("a.last_seen").alias("ts"), F.col("a.episode").alias("base"))
    marked = mark_episodes(failures.withColumn("base", F.lit(None).cast("long")).unionByName(seeds, allowMissingColumns=True), resolve_after)
    base = seeds.select(*KEY, F.col("base").alias("before"))
    # The first episode here goes on with the newest alert, if there is one; later ones count on from the last number used.
    seeded = F.col("before").isNotNull()
    new = marked.where(F.col("base").isNull()).join(base, KEY, "left").join(top, KEY, "left").withColumn("episode", F.when(
        seeded & (F.col("episode") == 1), F.col("before")).otherwise(
        F.col("episode") + F.coalesce("top", F.lit(0)) - F.when(seeded, 1).otherwise(0))).drop("top")
    key = [*KEY, "episode"]
    added = new.groupBy(*key).agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("occurrences"),
        F.max("batch_no").alias("last_batch"), F.min_by("severity", "batch_no").alias("severity"), F.min_by("node", "batch_no").alias("node"),
        F.max_by("problem", "batch_no").alias("problem"))
    details = new.select(*key, "batch_no", F.explode("detail").alias("k", "v")).groupBy(*key, "k").agg(F.max_by("v", "batch_no").alias("v")).groupBy(
        *key).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("detail"))
    added = added.join(details, key, "left")
    # An alert that is still open may be extended or cleared; one that has cleared stays as it is.
    both = by_batch.where(F.col("status") == "OPEN").select(*added.columns).unionByName(added)
    merged = both.groupBy(*key).agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("occurrences").alias("occurrences"),
        F.min_by("severity", "last_batch").alias("severity"), F.min_by("node", "last_batch").alias("node"),
        F.max_by("problem", "last_batch").alias("problem"), F.min_by("detail", "last_batch").alias("older"),
        F.max_by("detail", "last_batch").alias("newer"), F.max("last_batch").alias("last_batch"))
    blank = F.create_map().cast("map<string,string>")
    detail = F.map_zip_with(F.coalesce("older", blank), F.coalesce("newer", blank), lambda k, a, b: F.coalesce(b, a))
    closing = batches.select("source", (F.col("batch_no") - resolve_after).alias("last_batch"), F.col("ts").alias("resolved_at"))
    reached = batches.groupBy("source").agg(F.max("batch_no").alias("newest_batch"))
    out = merged.join(closing, ["source", "last_batch"], "left").join(reached, "source")
    return out.select(
        *key, "first_seen", "last_seen", "occurrences",
        F.least(F.col("newest_batch") - F.col("last_batch"), F.lit(resolve_after)).cast("long").alias("clean_batches"),
        F.when(F.col("resolved_at").isNull(), "OPEN").otherwise("RESOLVED").alias("status"), "resolved_at", "severity", "node", "problem",
        F.map_from_entries(F.array_sort(F.map_entries(detail))).alias("detail"), "last_batch")


def stand(known: DataFrame, judged: DataFrame, as_of: Column) -> DataFrame:
    """Alerts of checks on a state, not on a batch: silence of a feed, readable personal data in Silver.

    ``judged(source, check_name, failing, severity, node, problem, detail)`` says how things stand now, one row per pair. A failing
    check opens an alert or extends the one that stands open; one that holds again resolves it at once. Returns the changed alerts; their
    ``last_batch`` is NULL, which keeps batches from clearing them.
    """
    columns = ["episode", "first_seen", "last_seen", "occurrences", "severity", "node", "problem", "detail"]
    standing = known.where((F.col("status") == "OPEN") & F.col("last_batch").isNull()).select(*KEY, F.struct(*columns).alias("a"))
    top = known.groupBy(*KEY).agg(F.max("episode").alias("top"))
    j = judged.join(standing, KEY, "left").join(top, KEY, "left").where(F.col("failing") | F.col("a").isNotNull())
    failing = F.col("failing")
    blank = F.create_map().cast("map<string,string>")
    merged = F.map_zip_with(F.coalesce("a.detail", blank), F.when(failing, F.coalesce("detail", blank)).otherwise(blank), lambda k, old, new: F.coalesce(new, old))
    return j.select(
        *KEY, F.coalesce("a.episode", F.coalesce("top", F.lit(0)) + 1).cast("long").alias("episode"),
        F.coalesce("a.first_seen", as_of).alias("first_seen"), F.when(failing, as_of).otherwise(F.col("a.last_seen")).alias("last_seen"),
        (F.coalesce("a.occurrences", F.lit(0)) + failing.cast("long")).cast("long").alias("occurrences"), F.lit(0).cast("long").alias("clean_batches"),
        F.when(failing, "OPEN").otherwise("RESOLVED").alias("status"), F.when(~failing, as_of).alias("resolved_at"),
        F.coalesce("a.severity", "severity").alias("severity"), F.coalesce("a.node", "node").alias("node"),
        F.when(failing, F.col("problem")).otherwise(F.col("a.problem")).alias("problem"),
        F.map_from_entries(F.array_sort(F.map_entries(merged))).alias("detail"), F.lit(None).cast("long").alias("last_batch"))
