"""Incidents: overlapping alerts of one source, their evidence, cause, fix and timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.contracts import SEVERITY_RANK
from tidewatch.operators.sequence import scan
from tidewatch.session import salt_count

EVIDENCE_MINUTES = 15
EVIDENCE_LINES = 12
EVIDENCE_BLOCK = 96  # buckets of a block: a day of quarter hours
FAR = "9999-12-31 00:00:00"

# Cause categories, the one allowed action for each, and the prevention advice.
PLAYBOOK = {
    "expired_credential": "renew_vault_token",
    "schema_change": "add_column_mapping",
    "source_outage": "restart_connector",
    "delayed_delivery": "restart_connector",
    "bad_source_values": "quarantine_and_notify_source",
    "duplicate_records": "quarantine_and_notify_source",
    "referential_break": "quarantine_and_notify_source",
}
DEFAULT_ACTION = "quarantine_and_notify_source"
PREVENTION = {
    "expired_credential": ["Alert 7 days before any pipeline token expires",
                           "Make masking fail closed: stop the load instead of passing raw data"],
    "schema_change": ["Agree column changes with the source team before release",
                      "Keep the schema contract in version control and review changes"],
    "source_outage": ["Add a heartbeat check on the connector", "Restart the connector automatically once"],
    "delayed_delivery": ["Agree a delivery SLA with the source", "Alert the source team when files run late"],
    "bad_source_values": ["Share the failing rules with the source team",
                          "Add the same validation at the source system"],
    "duplicate_records": ["Add an idempotency key at the source", "Deduplicate on ingest"],
    "referential_break": ["Validate references at the source before sending",
                          "Load reference data before dependent feeds"],
}
CAUSES = {
    "token": "The Vault token used by the PII masking step expired (Vault returned 403), so masking was "
             "skipped and raw personal data reached silver_customer.",
    "masking": "The PII masking step failed, so raw personal data reached silver_customer.",
    "columns": " source changed its columns (",
    "silence": " feed stopped delivering files",
    "duplicates": " source is sending duplicate records.",
    "references": " source sent records that point to missing or expired items.",
    "values": " source is sending invalid values",
}
DEFAULT_PREVENTION = PREVENTION["bad_source_values"]


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(SEVERITY_RANK), severity), F.lit(0))


def link_alerts(alerts: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Add ``incident_no`` per source to alerts (source, check_name, severity, first_seen, resolved_at, ...).

    An alert joins the incident that is still running when it opens. Without ``decisions`` an incident
    ends when its alerts have cleared. ``decisions(source, check_name, first_seen, outcome, decided_at)``
    says how each alert's incident was handled: ``approved`` ends at ``decided_at``, ``rejected`` when
    cleared; undecided or failed fixes never end and absorb what follows.
    """
    far = F.lit(FAR).cast("timestamp")
    rows = alerts.withColumn("__end", F.coalesce("resolved_at", far))
    if decisions is not None:
        rows = rows.join(decisions, ["source", "check_name", "first_seen"], "left").withColumn(
            "__end", F.when(F.col("outcome") == "approved", F.col("decided_at")).when(
                F.col("outcome") == "rejected", F.col("__end")).otherwise(far)).drop("outcome", "decided_at")
    rows = rows.withColumn("__day", F.to_date("first_seen"))
    order = ["first_seen", "check_name"]
    rows = scan(rows, ["source"], "__day", order, {"__running": ("prior_max", F.col("__end"))})
    starts = (F.col("__running").isNull() | (F.col("__running") < F.col("first_seen"))).cast("long")
    return scan(rows, ["source"], "__day", order, {"incident_no": ("running_sum", starts)}).drop("__day", "__running")


def rollup(alerts: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Incidents with ids ``INC-nnnn`` in order of opening."""
    linked = link_alerts(alerts, decisions)
    first = F.struct("first_seen", "check_name")
    top = F.max(F.struct(severity_rank(F.col("severity")).alias("rank"), "severity"))
    end = F.max("__end")
    incidents = linked.groupBy("source", "incident_no").agg(
        F.min("first_seen").alias("opened_at"), end.alias("__end"), top.alias("top"),
        F.min_by("problem", first).alias("problem"), F.count(F.lit(1)).alias("alerts"))
    incidents = incidents.withColumn("__day", F.to_date("opened_at"))
    numbered = scan(incidents, [], "__day", ["opened_at", "source"], {"n": ("ordinal", None)})
    ended = F.col("__end") < F.lit(FAR).cast("timestamp")
    return numbered.select(
        F.concat(F.lit("INC-"), F.when(F.col("n") < 10000, F.lpad(F.col("n").cast("string"), 4, "0")).otherwise(
            F.col("n").cast("string"))).alias("incident_id"),
        "source", "incident_no", "opened_at", F.when(ended, F.col("__end")).alias("closed_at"),
        F.when(ended, "CLOSED").otherwise("OPEN").alias("status"), F.col("top.severity").alias("severity"), "alerts",
        F.concat("source", F.lit(": "), F.substring("problem", 1, 90)).alias("title"))


def _cells(grain: int, first: Column, last: Column) -> Column:
    """(grain, at) for every number from first to last; none when last is smaller."""
    numbers = F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(numbers, lambda n: F.struct(F.lit(grain).alias("grain"), n.alias("at")))


def evidence(incidents: DataFrame, logs: DataFrame, minutes: int = EVIDENCE_MINUTES, lines: int = EVIDENCE_LINES,
             pieces: int | None = None) -> DataFrame:
    """Log lines around each incident: first line per message, then the latest ``lines`` of them.

    ``incidents(incident_id, source, opened_at, until)``; ``logs(ts, source, level, message)`` as from
    ``evidence_lines``. The time range becomes equal buckets: its two end buckets meet single lines, the buckets and
    blocks of buckets wholly inside it meet only the first line of each message there, so that an incident that stays
    open for long meets few rows. Each incident is copied to every piece of a bucket, so a talkative source spreads
    over many tasks.
    """
    pieces = pieces or salt_count(incidents.sparkSession)  # a source spreads over as many tasks as there are
    width = minutes * 60
    bucket = lambda c: F.floor(F.unix_micros(c) / F.lit(width * 1_000_000)).cast("long")
    since = F.col("opened_at") - F.make_dt_interval(mins=F.lit(minutes))
    ranges = incidents.select("incident_id", F.col("source").alias("i_source"), since.alias("since"), "until").where(F.col("since") <= F.col("until"))
    ranges = ranges.withColumn("a", bucket(F.col("since"))).withColumn("b", bucket(F.col("until")))
    cells = F.array_union(_cells(0, F.col("a"), F.col("a")), _cells(0, F.col("b"), F.col("b")))
    low, high = F.ceil((F.col("a") + 1) / EVIDENCE_BLOCK).cast("long"), F.floor(F.col("b") / EVIDENCE_BLOCK).cast("long") - 1
    inside = F.when(low > high, _cells(1, F.col("a") + 1, F.col("b") - 1)).otherwise(
        F.concat(_cells(1, F.col("a") + 1, low * EVIDENCE_BLOCK - 1), _cells(2, low, high), _cells(1, (high + 1) * EVIDENCE_BLOCK, F.col("b") - 1)))
    ranges = ranges.withColumn("i_cell", F.explode(F.concat(cells, inside))).drop("a", "b")
    ranges = ranges.withColumn("i_piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    single = logs.select("source", bucket(F.col("ts")).alias("at"), "message", F.struct("ts", "level").alias("first"))
    by_bucket = single.groupBy("source", "at", "message").agg(F.min("first").alias("first"))
    by_block = by_bucket.groupBy("source", F.floor(F.col("at") / EVIDENCE_BLOCK).cast("long").alias("at"), "message").agg(F.min("first").alias("first"))
    grains = [rows.select("source", "message", F.col("first.ts").alias("ts"), F.col("first.level").alias("level"),
                          F.struct(F.lit(g).alias("grain"), "at").alias("cell")) for g, rows in enumerate((single, by_bucket, by_block))]
    placed = grains[0].unionByName(grains[1]).unionByName(grains[2]).withColumn(
        "piece", F.pmod(F.xxhash64("ts", "message"), F.lit(pieces)).cast("int"))
    found = placed.join(ranges, (F.col("source") == F.col("i_source")) & (F.col("cell") == F.col("i_cell"))
                        & (F.col("piece") == F.col("i_piece")) & (F.col("ts") >= F.col("since"))
                        & (F.col("ts") <= F.col("until")))
    firsts = found.groupBy("incident_id", "message").agg(F.min(F.struct("ts", "level")).alias("first"))
    firsts = firsts.select("incident_id", F.col("first.ts").alias("ts"), F.col("first.level").alias("level"), "message")
    latest = Window.partitionBy("incident_id").orderBy(F.desc("ts"), F.desc("message"))
    return firsts.withColumn("__n", F.row_number().over(latest)).where(F.col("__n") <= lines).drop("__n")


def root_cause(linked: DataFrame, lines: DataFrame) -> DataFrame:
    """Rule-based cause per incident from its alerts (incident_id, source, check_name, problem) and evidence."""
    has = lambda name: F.bool_or(F.col("check_name") == name)
    checks = linked.groupBy("incident_id", "source").agg(
        *[has(c).alias(c) for c in ("pii", "schema", "freshness", "duplicates", "referential")],
        F.min_by(F.when(F.col("check_name") == "schema", F.col("problem")),
                 F.when(F.col("check_name") == "schema", F.col("first_seen"))).alias("schema_problem"))
    low = F.lower("message")
    mentions = lambda *words: F.bool_or(_any([low.contains(w) for w in words]))
    earliest = F.min_by("message", F.struct((F.col("level") != "ERROR").cast("int"), "ts", "message"))
    logs = lines.groupBy("incident_id").agg(
        mentions("403", "token").alias("credential"), mentions("delay", "timed out").alias("delayed"),
        earliest.alias("best_log"))
    j = checks.join(logs, "incident_id", "left")
    credential, delayed = F.coalesce("credential", F.lit(False)), F.coalesce("delayed", F.lit(False))
    category = (F.when(F.col("pii") & credential, "expired_credential").when(F.col("pii"), "bad_source_values")
                .when(F.col("schema"), "schema_change")
                .when(F.col("freshness") & delayed, "delayed_delivery").when(F.col("freshness"), "source_outage")
                .when(F.col("duplicates"), "duplicate_records").when(F.col("referential"), "referential_break")
                .otherwise("bad_source_values"))
    log, src = F.col("best_log"), F.col("source")
    after = lambda prefix, suffix: F.coalesce(F.concat(F.lit(prefix), log, F.lit(suffix)), F.lit("."))
    columns = F.replace(F.coalesce("schema_problem", F.lit("")), F.lit("Columns changed: "), F.lit(""))
    cause = (F.when(F.col("pii") & credential, F.lit(CAUSES["token"]))
        .when(F.col("pii"), F.lit(CAUSES["masking"]))
        .when(F.col("schema"), F.concat(F.lit("The "), src, F.lit(CAUSES["columns"]), columns, F.lit(")"),
                                        after(", after: ", ".")))
        .when(F.col("freshness"), F.concat(F.lit("The "), src, F.lit(CAUSES["silence"]), after(": ", ".")))
        .when(F.col("duplicates"), F.concat(F.lit("The "), src, F.lit(CAUSES["duplicates"])))
        .when(F.col("referential"), F.concat(
            F.lit("The "), src, F.lit(CAUSES["references"])))
        .otherwise(F.concat(F.lit("The "), src, F.lit(CAUSES["values"]),
                            after(" (possible trigger: ", ")."))))
    return j.select("incident_id", "source", category.alias("category"), cause.alias("root_cause"),
                    F.when(log.isNull(), 0.55).otherwise(0.7).alias("confidence"), log.alias("best_log"))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def fix_lookup(causes: DataFrame) -> DataFrame:
    """Action and prevention per cause category; unknown categories get the defaults."""
    advice = literal_map({k: "; ".join(v) for k, v in PREVENTION.items()})
    return causes.select(
        "*", F.coalesce(F.try_element_at(literal_map(PLAYBOOK), F.col("category")), F.lit(DEFAULT_ACTION)).alias("fix_action"),
        F.coalesce(F.try_element_at(advice, F.col("category")), F.lit("; ".join(DEFAULT_PREVENTION))).alias("prevention"))


def _minutes(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(6e7)


def mttr(incidents: DataFrame) -> DataFrame:
    """Mean minutes from opening to closing over closed incidents, NULL when there are none."""
    closed = incidents.where((F.col("status") == "CLOSED") & F.col("closed_at").isNotNull())
    return closed.agg(F.avg(_minutes(F.col("opened_at"), F.col("closed_at"))).alias("mttr_minutes"),
                      F.count(F.lit(1)).alias("closed"))


def timeline(incidents: DataFrame, as_of: Column) -> DataFrame:
    """Start, end (``as_of`` while running), minutes and display state."""
    end = F.coalesce("closed_at", as_of)
    shown = F.when(F.col("status") == "CLOSED", "Resolved").when(
        F.col("status") == "AWAITING_APPROVAL", "Awaiting approval").otherwise("Open")
    return incidents.select("incident_id", "source", "severity", "title", F.col("opened_at").alias("start"),
                            end.alias("end"), F.round(_minutes(F.col("opened_at"), end), 1).alias("minutes"),
                            shown.alias("state"))
