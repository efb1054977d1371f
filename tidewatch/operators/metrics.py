"""Time-bucketed metrics and headline numbers over batches, alerts and incidents.

``batches(source, file, n_rows, ingested_at, good)``. "Now" is always the ``as_of`` argument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Health weights and freshness bands.
SEVERITY_WEIGHT = {"CRITICAL": 25, "HIGH": 12, "MEDIUM": 5, "LOW": 2}
DEFAULT_WEIGHT = 2
BLOCKED_WEIGHT = 10


def recent(df: DataFrame, column: str, as_of: Column, minutes: int) -> DataFrame:
    return df.where(F.col(column) >= as_of - F.make_dt_interval(mins=F.lit(minutes)))


def bucket(column: str, seconds: int) -> Column:
    return F.window(column, f"{seconds} seconds")["start"]


def _trimmed(batches: DataFrame, seconds: int) -> DataFrame:
    """Rows with ``time``; the first and last buckets are partly filled and go when there are more than three."""
    rows = batches.withColumn("time", bucket("ingested_at", seconds))
    per = rows.groupBy("time").agg(F.count(F.lit(1)).alias("n"))
    edges = per.agg(F.struct(F.min("time").alias("lo"), F.max("time").alias("hi"), F.count(F.lit(1)).alias("n"))).scalar()
    rows = rows.withColumn("__e", edges)
    inner = (F.col("time") > F.col("__e.lo")) & (F.col("time") < F.col("__e.hi"))
    return rows.where((F.col("__e.n") <= 3) | inner).drop("__e")


def _grid(rows: DataFrame, per: str, values: str) -> DataFrame:
    """Every observed ``per`` with every observed value of ``values``: the values travel as one list, so nothing is multiplied by rows."""
    listed = rows.agg(F.array_sort(F.collect_set(values))).scalar()
    return rows.select(per).distinct().withColumn(values, F.explode(listed))


def throughput(batches: DataFrame, as_of: Column, minutes: int, seconds: int) -> DataFrame:
    """Rows per bucket and source. A source seen at all shows 0 in buckets where it was silent."""
    rows = _trimmed(recent(batches, "ingested_at", as_of, minutes), seconds)
    per = rows.groupBy("time", "source").agg(F.sum("n_rows").alias("n_rows"))
    dense = _grid(per, "time", "source").join(per, ["time", "source"], "left")
    n = F.coalesce("n_rows", F.lit(0)).cast("long")
    return dense.select("time", "source", n.alias("n_rows"), (n * 60 / F.lit(float(seconds))).alias("rows_per_min"))


def quality_trend(batches: DataFrame, as_of: Column, minutes: int, seconds: int) -> DataFrame:
    rows = _trimmed(recent(batches, "ingested_at", as_of, minutes), seconds)
    return rows.groupBy("time").agg(F.sum("n_rows").alias("n_rows"), F.sum("good").alias("good")).select(
        "*", F.round(100 * F.col("good") / F.col("n_rows"), 1).alias("pass_rate"))


def alert_events(alerts: DataFrame, as_of: Column, minutes: int, seconds: int) -> DataFrame:
    return recent(alerts, "first_seen", as_of, minutes).groupBy(
        bucket("first_seen", seconds).alias("time"), "severity").agg(F.count(F.lit(1)).alias("alerts"))


def failure_matrix(quarantine: DataFrame, alerts: DataFrame, as_of: Column, minutes: int) -> DataFrame:
    """Stopped rows by source and check, plus occurrences of freshness and pii alerts, with 0 for pairs of an observed
    source and an observed check that did not meet."""
    stopped = recent(quarantine, "quarantined_at", as_of, minutes).groupBy("source", "check_name").agg(
        F.count(F.lit(1)).alias("n"))
    raised = recent(alerts, "last_seen", as_of, minutes).where(F.col("check_name").isin("freshness", "pii")).select(
        "source", "check_name", F.col("occurrences").alias("n"))
    counts = stopped.unionByName(raised).groupBy("source", "check_name").agg(F.sum("n").alias("n"))
    return _grid(counts, "source", "check_name").join(counts, ["source", "check_name"], "left").select(
        "source", "check_name", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def freshness_state(registry: DataFrame, limits: DataFrame, as_of: Column, factor: int) -> DataFrame:
    last = registry.groupBy("source").agg(F.max("ingested_at").alias("last_ingested"))
    silent = (F.unix_micros(as_of) - F.unix_micros("last_ingested")) / F.lit(1e6)
    limit = (F.col("interval_seconds") * factor).cast("double")
    pct = F.round(100 * silent / limit, 0)
    return last.join(limits, "source").select(
        "source", "last_ingested", silent.alias("silent_s"), limit.alias("limit_s"), pct.alias("pct_of_limit"),
        F.least(pct, F.lit(200.0)).alias("bar_pct"),
        F.concat(F.bround(silent, 0).cast("long").cast("string"), F.lit("s"),
                 F.when(pct > 200, F.lit(" · stopped")).otherwise("")).alias("label"),
        F.when(pct <= 60, "Fresh").when(pct <= 100, "Late").otherwise("Stale").alias("state"))


def health(alerts: DataFrame, blocked: DataFrame) -> DataFrame:
    """100 less a weight per open alert and per blocked product, never below 0."""
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in SEVERITY_WEIGHT.items() for x in p]),
                                         F.col("severity")), F.lit(DEFAULT_WEIGHT))
    held = blocked.where(F.col("blocked") == 1).agg(F.count(F.lit(1))).scalar()
    alerts_cost = alerts.where(F.col("status") == "OPEN").agg(F.coalesce(F.sum(weight), F.lit(0)).alias("p"))
    penalty = F.col("p") + held * BLOCKED_WEIGHT
    return alerts_cost.select(penalty.cast("long").alias("penalty")).select(
        F.greatest(100 - F.col("penalty"), F.lit(0)).cast("long").alias("health"), "penalty")


def counts(alerts: DataFrame, incidents: DataFrame, blocked: DataFrame, registry: DataFrame) -> DataFrame:
    """Headline counts, one pass per table. ``incidents`` carries ``status`` and ``llm_used``."""
    is_open = F.col("status") == "OPEN"
    a = alerts.agg(F.count_if(is_open).alias("open_alerts"), F.count_if(is_open & (F.col("severity") == "CRITICAL")).alias("critical"))
    i = incidents.agg(F.struct(F.count_if(F.col("status") != "CLOSED").alias("active"),
                               F.count_if(F.col("status") == "AWAITING_APPROVAL").alias("waiting"),
                               F.coalesce(F.sum("llm_used"), F.lit(0)).cast("long").alias("llm"))).scalar()
    held = blocked.where(F.col("blocked") == 1).agg(F.count(F.lit(1))).scalar()
    total = registry.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).cast("long")).scalar()
    one = a.withColumn("i", i)
    return one.select("open_alerts", "critical", F.col("i.active").alias("active_incidents"), F.col("i.waiting").alias("waiting"),
                      held.alias("blocked"), total.alias("total_rows"), F.col("i.llm").alias("llm_incidents"))


def rates(batches: DataFrame, as_of: Column, minutes: int = 5) -> DataFrame:
    """Rows per minute and pass rate over the last minutes; no rows give 0 and NULL."""
    r = recent(batches, "ingested_at", as_of, minutes).agg(F.sum("n_rows").alias("n"), F.sum("good").alias("g"))
    return r.select((F.coalesce("n", F.lit(0)) / F.lit(float(minutes))).alias("rows_per_min"),
                    (100 * F.col("g") / F.nullif(F.col("n"), F.lit(0))).alias("pass_rate"))


def node_metrics(nodes: DataFrame, batches: DataFrame, refresh: DataFrame, as_of: Column, minutes: int = 5) -> DataFrame:
    """Label per lineage node (``nodes(id, layer, source)``): row rates, or the age of a data product."""
    per = recent(batches, "ingested_at", as_of, minutes).groupBy("source").agg(
        (F.sum("n_rows") / F.lit(float(minutes))).alias("in_rate"), (F.sum("good") / F.lit(float(minutes))).alias("good_rate"))
    whole = lambda c: F.bround(c, 0).cast("long").cast("string")
    rated = nodes.where(F.col("layer") != "gold").join(per, "source").select(
        F.col("id").alias("node"),
        F.concat(whole(F.when(F.col("layer").isin("source", "bronze"), F.col("in_rate")).otherwise(F.col("good_rate"))),
                 F.lit(" rows/min")).alias("metric"))
    age = (F.unix_micros(as_of) - F.unix_micros("last_refreshed")) / F.lit(1e6)
    gold = refresh.select("node", F.when(F.col("blocked") == 1, F.lit("publishing halted")).otherwise(
        F.concat(F.lit("refreshed "), whole(age), F.lit("s ago"))).alias("metric"))
    return rated.unionByName(gold)


def pass_rate_by_source(batches: DataFrame, as_of: Column, minutes: int) -> DataFrame:
    return recent(batches, "ingested_at", as_of, minutes).groupBy("source").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("good").alias("good")).select(
        "*", F.round(100 * F.col("good") / F.col("n_rows"), 1).alias("pass_rate"))


def compliance_counts(customers: DataFrame, alerts: DataFrame) -> DataFrame:
    pii = alerts.where((F.col("check_name") == "pii") & (F.col("status") == "OPEN")).agg(F.count(F.lit(1))).scalar()
    c = customers.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("masked") == 0).alias("unmasked"))
    c = c.withColumn("pii_alerts", pii)
    return c.select("total", "unmasked", "pii_alerts", F.when(
        (F.col("unmasked") > 0) | (F.col("pii_alerts") > 0), "AT RISK").otherwise("PASS").alias("state"))


def cycle_runs(registry: DataFrame, alerts: DataFrame, cycle: Column) -> DataFrame:
    """Files, rows and new alerts per cycle. ``cycle`` maps a ``ts`` column to the cycle it belongs to."""
    loaded = registry.withColumn("ts", F.col("ingested_at")).groupBy(cycle.alias("cycle")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("n_rows").alias("n_rows"))
    opened = alerts.withColumn("ts", F.col("first_seen")).groupBy(cycle.alias("cycle")).agg(
        F.count(F.lit(1)).alias("new_alerts"))
    return loaded.join(opened, "cycle", "left").select(
        "cycle", "files", "n_rows", F.coalesce("new_alerts", F.lit(0)).cast("long").alias("new_alerts"))
