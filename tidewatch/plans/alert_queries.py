"""Alerts and incidents over a findings log derived from the event table.

Each event type is a source and each hour with events is one of its batches. A batch fails
``range`` with a value above 150, ``duplicates`` with a repeated user, ``schema`` and ``pii`` with
certain property values.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import alerts, incidents
from tidewatch.plans.feeds import read_table
from tidewatch.plans.registry import AS_OF, query
from tidewatch.session import cut_lineage, spread

BATCHES_SQL = """hourly AS (
  SELECT event_type AS source, date_trunc('hour', ts) AS ts, count(*) AS total,
         count(CASE WHEN value > 150 THEN 1 END) AS n_range, count(*) - count(DISTINCT user_id) AS n_dup,
         count(CASE WHEN props IN ('{"k": 97}', '{"k": 98}') THEN 1 END) AS n_schema,
         count(CASE WHEN props = '{"k": 11}' THEN 1 END) AS n_pii
  FROM events GROUP BY 1, 2),
batches AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts) AS batch_no FROM hourly),
failures AS (
  SELECT source, ts, batch_no, total, 'range' AS check_name, n_range AS n, 'MEDIUM' AS severity FROM batches WHERE n_range > 0
  UNION ALL SELECT source, ts, batch_no, total, 'duplicates', n_dup, 'MEDIUM' FROM batches WHERE n_dup > 0
  UNION ALL SELECT source, ts, batch_no, total, 'schema', n_schema, 'HIGH' FROM batches WHERE n_schema > 0),
problems AS (SELECT *, n || ' of ' || total || ' rows failed ' || check_name AS problem FROM failures)"""


def _episodes_sql(table: str, gap: int) -> str:
    return f"""lagged AS (SELECT *, lag(batch_no) OVER (PARTITION BY source, check_name ORDER BY batch_no) AS prev FROM {table}),
marked AS (SELECT *, sum(CASE WHEN prev IS NULL OR batch_no - prev > {gap} THEN 1 ELSE 0 END)
           OVER (PARTITION BY source, check_name ORDER BY batch_no)::BIGINT AS episode FROM lagged),
islands AS (SELECT source, check_name, episode, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS occurrences,
            max(batch_no) AS last_batch, min_by(problem, batch_no) AS first_problem, max_by(problem, batch_no) AS problem,
            min_by(severity, batch_no) AS severity, max_by(n, batch_no) AS failed_rows, max_by(total, batch_no) AS total_rows
            FROM marked GROUP BY 1, 2, 3),
episodes AS (SELECT i.*, least(m.newest - last_batch, {gap})::BIGINT AS clean_batches, b.ts AS resolved_at,
             CASE WHEN b.ts IS NULL THEN 'OPEN' ELSE 'RESOLVED' END AS status
             FROM islands i JOIN (SELECT source, max(batch_no) AS newest FROM batches GROUP BY 1) m ON m.source = i.source
             LEFT JOIN batches b ON b.source = i.source AND b.batch_no = i.last_batch + {gap})"""


EPISODES_SQL = f"{BATCHES_SQL}, {_episodes_sql('problems', 2)}"
EPISODE_COLUMNS = ("source, check_name, episode, first_seen, last_seen, occurrences, clean_batches, status, resolved_at")


def hourly(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("int")
    rows = spread(read_table(spark, sf_dir, "events")).select(
        F.col("event_type").alias("source"), F.date_trunc("hour", "ts").alias("ts"), "value", "user_id", k.alias("k"))
    # Users first: distinct users of an hour are counted from combined rows, not collected.
    users = rows.groupBy("source", "ts", "user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 150).alias("n_range"),
        F.count_if(F.col("k").isin(97, 98)).alias("n_schema"), F.count_if(F.col("k") == 11).alias("n_pii"))
    return users.groupBy("source", "ts").agg(
        F.sum("n").alias("total"), F.sum("n_range").alias("n_range"), (F.sum("n") - F.count(F.lit(1))).alias("n_dup"),
        F.sum("n_schema").alias("n_schema"), F.sum("n_pii").alias("n_pii"))


def numbered(spark, sf_dir):
    """The batch log: one row per file, kept as a written table because every alert query reads it often."""
    rows = hourly(spark, sf_dir).withColumn("file", F.col("ts").cast("string")).withColumn("ingested_at", F.col("ts"))
    return cut_lineage(alerts.number_batches(rows).drop("file", "ingested_at", "day"))


def failures_of(batches, checks=(("range", "MEDIUM"), ("duplicates", "MEDIUM"), ("schema", "HIGH"))):
    column = {"range": "n_range", "duplicates": "n_dup", "schema": "n_schema", "pii": "n_pii"}
    each = F.array(*[F.struct(F.lit(c).alias("check_name"), F.col(column[c]).alias("n"), F.lit(s).alias("severity"))
                     for c, s in checks])
    rows = batches.select("source", "ts", "batch_no", "total", F.inline(each)).where(F.col("n") > 0)
    text = lambda c: F.col(c).cast("string")
    return rows.select(
        "source", "ts", "batch_no", "check_name", "severity", F.concat(F.lit("silver_"), "source").alias("node"),
        F.concat(text("n"), F.lit(" of "), text("total"), F.lit(" rows failed "), "check_name").alias("problem"),
        F.create_map(F.lit("failed_rows"), text("n"), F.lit("total_rows"), text("total")).alias("detail"))


def alert_table(spark, sf_dir):
    """Alerts with what they show."""
    batches = numbered(spark, sf_dir)
    failed = failures_of(batches)
    return cut_lineage(alerts.episodes(failed, batches).join(alerts.state(failed), ["source", "check_name", "episode"]))


@query("alert_episodes", sql=f"WITH {EPISODES_SQL} SELECT {EPISODE_COLUMNS} FROM episodes")
def alert_episodes(spark, sf_dir):
    batches = numbered(spark, sf_dir)
    return alerts.episodes(failures_of(batches), batches)


@query("alert_state", sql=f"""
WITH {EPISODES_SQL}
SELECT source, check_name, episode, severity, 'silver_' || source AS node, problem,
       failed_rows::VARCHAR AS failed_rows, total_rows::VARCHAR AS total_rows FROM episodes""")
def alert_state(spark, sf_dir):
    shown = alerts.state(failures_of(numbered(spark, sf_dir)))
    return shown.select("source", "check_name", "episode", "severity", "node", "problem",
                        F.col("detail")["failed_rows"].alias("failed_rows"), F.col("detail")["total_rows"].alias("total_rows"))


@query("alert_resolve", sql=f"""
WITH {BATCHES_SQL}, pii AS (SELECT source, ts, batch_no, total, 'pii' AS check_name, n_pii AS n, 'CRITICAL' AS severity,
                                   '' AS problem FROM batches WHERE n_pii > 0),
{_episodes_sql('pii', 1)} SELECT {EPISODE_COLUMNS} FROM episodes""")
def alert_resolve(spark, sf_dir):
    batches = numbered(spark, sf_dir)
    return alerts.episodes(failures_of(batches, (("pii", "CRITICAL"),)), batches, resolve_after=1)


INCIDENTS_SQL = f"""{EPISODES_SQL},
spans AS (SELECT *, coalesce(resolved_at, TIMESTAMP '9999-12-31') AS span_end FROM episodes),
runs AS (SELECT *, max(span_end) OVER (PARTITION BY source ORDER BY first_seen, check_name
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS running FROM spans),
linked AS (SELECT *, sum(CASE WHEN running IS NULL OR running < first_seen THEN 1 ELSE 0 END)
           OVER (PARTITION BY source ORDER BY first_seen, check_name)::BIGINT AS incident_no FROM runs),
grouped AS (SELECT source, incident_no, min(first_seen) AS opened_at, max(span_end) AS span_end, count(*) AS alerts,
            max(CASE severity WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END) AS top,
            arg_min(problem, first_seen::VARCHAR || check_name) AS problem FROM linked GROUP BY 1, 2),
incidents AS (SELECT 'INC-' || CASE WHEN n < 10000 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END AS incident_id, *,
              CASE WHEN span_end < TIMESTAMP '9999-12-31' THEN span_end END AS closed_at,
              CASE WHEN span_end < TIMESTAMP '9999-12-31' THEN 'CLOSED' ELSE 'OPEN' END AS status,
              CASE top WHEN 2 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
              source || ': ' || substr(problem, 1, 90) AS title
              FROM (SELECT *, row_number() OVER (ORDER BY opened_at, source) AS n FROM grouped))"""


def rolled_up(spark, sf_dir):
    return incidents.rollup(alert_table(spark, sf_dir))


@query("incident_rollup", sql=f"""
WITH {INCIDENTS_SQL} SELECT incident_id, source, incident_no, opened_at, closed_at, status, severity, alerts, title FROM incidents""")
def incident_rollup(spark, sf_dir):
    return rolled_up(spark, sf_dir)


@query("incident_severity", sql=f"WITH {INCIDENTS_SQL} SELECT source, severity, count(*) AS incidents FROM incidents GROUP BY 1, 2")
def incident_severity(spark, sf_dir):
    return incidents.rollup(alert_table(spark, sf_dir)).groupBy("source", "severity").agg(
        F.count(F.lit(1)).alias("incidents"))


LOGS_SQL = """logs AS (
  SELECT ts, event_type AS source, CASE WHEN value > 100 THEN 'ERROR' ELSE 'WARN' END AS level,
         CASE WHEN props IN ('{"k": 1}', '{"k": 2}') THEN 'token refused ' ELSE 'slow delivery ' END || props AS message
  FROM events WHERE value > 40)"""
EVIDENCE_SQL = f"""{LOGS_SQL},
around AS (SELECT i.incident_id, l.message, min(l.ts) AS ts, arg_min(l.level, l.ts) AS level FROM incidents i JOIN logs l ON l.source = i.source
           AND l.ts >= i.opened_at - INTERVAL 15 MINUTE AND l.ts <= coalesce(i.closed_at, TIMESTAMP '{AS_OF}') GROUP BY 1, 2),
evidence AS (SELECT incident_id, ts, level, message FROM (
  SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY ts DESC, message DESC) AS k FROM around) WHERE k <= 12)"""


def log_lines(spark, sf_dir):
    """Log lines of each source: large values are errors, middling ones warnings."""
    rows = read_table(spark, sf_dir, "events").where(F.col("value") > 40)
    prefix = F.when(F.col("props").isin('{"k": 1}', '{"k": 2}'), "token refused ").otherwise("slow delivery ")
    return rows.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("source"),
                       F.when(F.col("value") > 100, "ERROR").otherwise("WARN").alias("level"),
                       F.concat(prefix, "props").alias("message"))


def evidence_of(rolled, spark, sf_dir):
    """Lines up to the incident's end, or up to now while it is open."""
    seen = rolled.select("incident_id", "source", "opened_at", F.coalesce("closed_at", F.lit(AS_OF).cast("timestamp")).alias("until"))
    return incidents.evidence(seen, log_lines(spark, sf_dir))


@query("incident_evidence", sql=f"WITH {INCIDENTS_SQL}, {EVIDENCE_SQL} SELECT incident_id, ts, level, message FROM evidence")
def incident_evidence(spark, sf_dir):
    return evidence_of(rolled_up(spark, sf_dir), spark, sf_dir)


CAUSES_SQL = f"""{INCIDENTS_SQL}, {EVIDENCE_SQL},
flags AS (SELECT i.incident_id, i.source, bool_or(l.check_name = 'schema') AS is_schema, bool_or(l.check_name = 'duplicates') AS is_dup,
          arg_min(l.problem, l.first_seen) FILTER (WHERE l.check_name = 'schema') AS schema_problem
          FROM incidents i JOIN linked l ON l.source = i.source AND l.incident_no = i.incident_no GROUP BY 1, 2),
best AS (SELECT incident_id, arg_min(message, (CASE level WHEN 'ERROR' THEN '0' ELSE '1' END) || ts::VARCHAR || message) AS best_log FROM evidence GROUP BY 1),
causes AS (SELECT f.incident_id, f.source, CASE WHEN is_schema THEN 'schema_change' WHEN is_dup THEN 'duplicate_records' ELSE 'bad_source_values' END AS category,
  CASE WHEN is_schema THEN 'The ' || f.source || ' source changed its columns (' || schema_problem || ')' || coalesce(', after: ' || best_log || '.', '.')
       WHEN is_dup THEN 'The ' || f.source || ' source is sending duplicate records.'
       ELSE 'The ' || f.source || ' source is sending invalid values' || coalesce(' (possible trigger: ' || best_log || ').', '.') END AS root_cause,
  CASE WHEN best_log IS NULL THEN 0.55::DOUBLE ELSE 0.7::DOUBLE END AS confidence, best_log
  FROM flags f LEFT JOIN best b ON b.incident_id = f.incident_id)"""


def causes(spark, sf_dir):
    table = alert_table(spark, sf_dir)
    rolled = cut_lineage(incidents.rollup(table))
    linked = incidents.link_alerts(table).join(rolled.select("source", "incident_no", "incident_id"), ["source", "incident_no"])
    return incidents.root_cause(linked, evidence_of(rolled, spark, sf_dir))


@query("root_cause_rules", sql=f"WITH {CAUSES_SQL} SELECT incident_id, source, category, root_cause, confidence, best_log FROM causes")
def root_cause_rules(spark, sf_dir):
    return causes(spark, sf_dir)


@query("fix_lookup", sql=f"""
WITH {CAUSES_SQL}
SELECT incident_id, category, CASE category WHEN 'schema_change' THEN 'add_column_mapping' ELSE 'quarantine_and_notify_source' END AS fix_action,
  CASE category WHEN 'schema_change' THEN 'Agree column changes with the source team before release; Keep the schema contract in version control and review changes'
    WHEN 'duplicate_records' THEN 'Add an idempotency key at the source; Deduplicate on ingest'
    ELSE 'Share the failing rules with the source team; Add the same validation at the source system' END AS prevention FROM causes""")
def fix_lookup(spark, sf_dir):
    return incidents.fix_lookup(causes(spark, sf_dir)).select("incident_id", "category", "fix_action", "prevention")


@query("mttr", sql=f"""
WITH {INCIDENTS_SQL}
SELECT avg((epoch_us(closed_at) - epoch_us(opened_at)) / 6e7::DOUBLE) AS mttr_minutes, count(*) AS closed FROM incidents WHERE status = 'CLOSED'""")
def mttr(spark, sf_dir):
    return incidents.mttr(incidents.rollup(alert_table(spark, sf_dir)))


@query("incident_timeline", sql=f"""
WITH {INCIDENTS_SQL}
SELECT incident_id, source, severity, title, opened_at AS "start", coalesce(closed_at, TIMESTAMP '{AS_OF}') AS "end",
       round((epoch_us(coalesce(closed_at, TIMESTAMP '{AS_OF}')) - epoch_us(opened_at)) / 6e7::DOUBLE, 1) AS minutes,
       CASE status WHEN 'CLOSED' THEN 'Resolved' ELSE 'Open' END AS state FROM incidents""")
def incident_timeline(spark, sf_dir):
    return incidents.timeline(incidents.rollup(alert_table(spark, sf_dir)), F.lit(AS_OF).cast("timestamp"))
