"""Metrics, lists and headline numbers. A batch is an event type's hour; values above 100 are bad rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import batches, incidents, metrics, reports
from tidewatch.plans.alert_queries import (
    EPISODES_SQL, INCIDENTS_SQL, alert_table, log_lines, numbered, LOGS_SQL)
from tidewatch.plans.check_queries import ALL_CHECKED
from tidewatch.plans.feeds import read_table
from tidewatch.plans.registry import AS_OF, query
from tidewatch.plans.silver_queries import CUSTOMER_SQL, all_quarantine, silver_customer
from tidewatch.session import spread

# The event types are this feed's configured sources, with their expected interval.
INTERVALS = {"click": 600, "view": 900, "purchase": 1200, "signup": 300, "error": 60}
SOURCES = sorted(INTERVALS)
DAY = 24 * 60
BATCHES = f"""batches_m AS (
  SELECT event_type AS source, event_type || '_' || strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS file, count(*) AS n_rows,
         max(ts) AS ingested_at, count(CASE WHEN value <= 100 THEN 1 END) AS good FROM events GROUP BY event_type, 2)"""
LIMITS = "limits(source, interval_seconds) AS (VALUES " + ", ".join(f"('{s}', {n})" for s, n in INTERVALS.items()) + ")"
NOW = f"TIMESTAMP '{AS_OF}'"


def _bucket(column: str, seconds: int) -> str:
    return f"time_bucket(INTERVAL '{seconds} seconds', {column}, TIMESTAMP '1970-01-01')"


def now():
    return F.lit(AS_OF).cast("timestamp")


def batch_table(spark, sf_dir):
    rows = spread(read_table(spark, sf_dir, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH")
    return rows.groupBy(F.col("event_type").alias("source"), F.concat("event_type", F.lit("_"), hour).alias("file")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("ts").alias("ingested_at"),
        F.count_if(F.col("value") <= 100).alias("good"))


def limits(spark):
    return spark.createDataFrame(list(INTERVALS.items()), "source string, interval_seconds int")


@query("check_freshness", sql=f"""
WITH {BATCHES}, {LIMITS}, l AS (SELECT b.source, max(ingested_at) AS last_ingested, any_value(interval_seconds) AS s
  FROM batches_m b JOIN limits ON limits.source = b.source GROUP BY 1),
a AS (SELECT *, (epoch_us({NOW}) - epoch_us(last_ingested)) / 1e6::DOUBLE AS silent FROM l)
SELECT source, last_ingested, floor(silent)::BIGINT AS silent_seconds, (s * 4)::BIGINT AS limit_seconds, silent > s * 4 AS stale,
  'No new ' || source || ' data for ' || floor(silent)::BIGINT || 's (expected every ' || s || 's)' AS problem FROM a""")
def check_freshness(spark, sf_dir):
    return batches.freshness(batch_table(spark, sf_dir), limits(spark), now())


TRIMMED = """seen AS (SELECT *, {b} AS time FROM batches_m WHERE ingested_at >= {now} - INTERVAL '{m} minutes'),
kept AS (SELECT * FROM seen WHERE (SELECT count(DISTINCT time) FROM seen) <= 3
         OR (time > (SELECT min(time) FROM seen) AND time < (SELECT max(time) FROM seen)))"""
TRIMMED_6H = TRIMMED.format(b=_bucket("ingested_at", 21600), now=NOW, m=25 * DAY)


@query("throughput", sql=f"""
WITH {BATCHES}, {TRIMMED_6H}, grid AS (SELECT t.time, s.source FROM (SELECT DISTINCT time FROM kept) t, (SELECT DISTINCT source FROM kept) s),
per AS (SELECT time, source, sum(n_rows)::BIGINT AS n FROM kept GROUP BY 1, 2)
SELECT g.time, g.source, coalesce(n, 0) AS n_rows, coalesce(n, 0) * 60 / 21600::DOUBLE AS rows_per_min
FROM grid g LEFT JOIN per ON per.time = g.time AND per.source = g.source""")
def throughput(spark, sf_dir):
    return metrics.throughput(batch_table(spark, sf_dir), now(), 25 * DAY, 21600)


@query("quality_trend", sql=f"""
WITH {BATCHES}, {TRIMMED_6H}
SELECT time, sum(n_rows)::BIGINT AS n_rows, sum(good)::BIGINT AS good, round(100 * sum(good)::DOUBLE / sum(n_rows), 1) AS pass_rate FROM kept GROUP BY 1""")
def quality_trend(spark, sf_dir):
    return metrics.quality_trend(batch_table(spark, sf_dir), now(), 25 * DAY, 21600)


@query("alert_events", sql=f"""
WITH {EPISODES_SQL}
SELECT {_bucket('first_seen', 86400)} AS time, severity, count(*) AS alerts FROM episodes
WHERE first_seen >= {NOW} - INTERVAL '{20 * DAY} minutes' GROUP BY 1, 2""")
def alert_events(spark, sf_dir):
    return metrics.alert_events(alert_table(spark, sf_dir), now(), 20 * DAY, 86400)


@query("failure_matrix", sql=f"""
WITH {EPISODES_SQL}, stopped AS (SELECT event_type AS source, CASE WHEN value > 150 THEN 'range' ELSE 'type' END AS check_name, count(*) AS n FROM events
  WHERE value > 100 AND ts >= {NOW} - INTERVAL '{15 * DAY} minutes' GROUP BY 1, 2),
raised AS (SELECT source, 'pii' AS check_name, sum(occurrences)::BIGINT AS n FROM episodes
  WHERE check_name = 'schema' AND last_seen >= {NOW} - INTERVAL '{15 * DAY} minutes' GROUP BY 1),
both_kinds AS (SELECT * FROM stopped UNION ALL SELECT * FROM raised),
grid AS (SELECT s.source, c.check_name FROM (SELECT DISTINCT source FROM both_kinds) s, (SELECT DISTINCT check_name FROM both_kinds) c)
SELECT g.source, g.check_name, coalesce(sum(n), 0)::BIGINT AS n FROM grid g LEFT JOIN both_kinds k
ON k.source = g.source AND k.check_name = g.check_name GROUP BY 1, 2""")
def failure_matrix(spark, sf_dir):
    """Bad events as quarantined rows; the schema alerts of the log stand in for pii alerts."""
    bad = read_table(spark, sf_dir, "events").where(F.col("value") > 100).select(
        F.col("event_type").alias("source"), F.when(F.col("value") > 150, "range").otherwise("type").alias("check_name"),
        F.col("ts").cast("timestamp").alias("quarantined_at"))
    raised = alert_table(spark, sf_dir).where(F.col("check_name") == "schema").withColumn("check_name", F.lit("pii"))
    return metrics.failure_matrix(bad, raised, now(), 15 * DAY)


@query("freshness_state", sql=f"""
WITH {BATCHES}, {LIMITS}, l AS (SELECT b.source, max(ingested_at) AS last_ingested, any_value(interval_seconds) AS s
  FROM batches_m b JOIN limits ON limits.source = b.source GROUP BY 1),
a AS (SELECT source, last_ingested, (epoch_us({NOW}) - epoch_us(last_ingested)) / 1e6::DOUBLE AS silent_s, (s * 4)::DOUBLE AS limit_s FROM l),
p AS (SELECT *, round(100 * silent_s / limit_s, 0) AS pct_of_limit FROM a)
SELECT *, least(pct_of_limit, 200.0::DOUBLE) AS bar_pct,
  round_even(silent_s, 0)::BIGINT || 's' || CASE WHEN pct_of_limit > 200 THEN ' · stopped' ELSE '' END AS label,
  CASE WHEN pct_of_limit <= 60 THEN 'Fresh' WHEN pct_of_limit <= 100 THEN 'Late' ELSE 'Stale' END AS state FROM p""")
def freshness_state(spark, sf_dir):
    return metrics.freshness_state(batch_table(spark, sf_dir), limits(spark), now(), 4)


# Data products with a refresh time and a block flag: one per order, with its SLA by priority.
REFRESH_SQL = f"""refresh AS (
  SELECT 'gold_' || o_orderkey AS node, {NOW} - CAST(floor(o_totalprice / 1000) AS BIGINT) * INTERVAL 1 MINUTE AS last_refreshed,
         CASE WHEN o_orderstatus = 'P' AND o_totalprice > 450000 THEN 1 ELSE 0 END AS blocked,
         o_orderpriority AS owner, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 30 WHEN '2' THEN 60 WHEN '3' THEN 120 ELSE 240 END AS sla_minutes
  FROM orders)"""


def refresh_table(spark, sf_dir):
    """(node, last_refreshed, blocked) and (id, owner, sla_minutes) of the data products."""
    orders = read_table(spark, sf_dir, "orders")
    level = F.substring("o_orderpriority", 1, 1)
    return orders.select(
        F.concat(F.lit("gold_"), F.col("o_orderkey").cast("string")).alias("node"),
        (now() - F.make_dt_interval(mins=F.floor(F.col("o_totalprice") / 1000).cast("int"))).alias("last_refreshed"),
        F.when((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 450000), 1).otherwise(0).alias("blocked"),
        F.col("o_orderpriority").alias("owner"),
        F.when(level == "1", 30).when(level == "2", 60).when(level == "3", 120).otherwise(240).alias("sla_minutes"))


@query("kpi_health", sql=f"""
WITH {EPISODES_SQL}, {REFRESH_SQL}, p AS (
SELECT coalesce((SELECT sum(CASE severity WHEN 'CRITICAL' THEN 25 WHEN 'HIGH' THEN 12 WHEN 'MEDIUM' THEN 5 ELSE 2 END)
  FROM episodes WHERE status = 'OPEN'), 0) + 10 * (SELECT count(*) FROM refresh WHERE blocked = 1) AS penalty)
SELECT greatest(0, 100 - penalty)::BIGINT AS health, penalty::BIGINT AS penalty FROM p""")
def kpi_health(spark, sf_dir):
    return metrics.health(alert_table(spark, sf_dir), refresh_table(spark, sf_dir))


@query("kpi_counts", sql=f"""
WITH {INCIDENTS_SQL}, {REFRESH_SQL}
SELECT (SELECT count(*) FROM episodes WHERE status = 'OPEN') AS open_alerts,
  (SELECT count(*) FROM episodes WHERE status = 'OPEN' AND severity = 'CRITICAL') AS critical,
  (SELECT count(*) FROM incidents WHERE status <> 'CLOSED') AS active_incidents,
  (SELECT count(*) FROM incidents WHERE status = 'OPEN' AND alerts > 1) AS waiting,
  (SELECT count(*) FROM refresh WHERE blocked = 1) AS blocked, (SELECT count(*) FROM events) AS total_rows,
  (SELECT count(*) FROM incidents WHERE severity = 'HIGH') AS llm_incidents""")
def kpi_counts(spark, sf_dir):
    """Open incidents with several alerts wait for approval; severe ones count as analysed by a model."""
    alerts = alert_table(spark, sf_dir)
    inc = incidents.rollup(alerts)
    waiting = (F.col("status") == "OPEN") & (F.col("alerts") > 1)
    inc = inc.withColumn("status", F.when(waiting, "AWAITING_APPROVAL").otherwise(F.col("status"))).withColumn(
        "llm_used", (F.col("severity") == "HIGH").cast("int"))
    return metrics.counts(alerts, inc, refresh_table(spark, sf_dir), batch_table(spark, sf_dir))


@query("kpi_rates", sql=f"""
WITH {BATCHES}
SELECT coalesce(sum(n_rows), 0) / {DAY}::DOUBLE AS rows_per_min, 100 * sum(good)::DOUBLE / sum(n_rows) AS pass_rate
FROM batches_m WHERE ingested_at >= {NOW} - INTERVAL '{DAY} minutes'""")
def kpi_rates(spark, sf_dir):
    return metrics.rates(batch_table(spark, sf_dir), now(), DAY)


@query("pass_rate_source", sql=f"""
WITH {BATCHES}
SELECT source, sum(n_rows)::BIGINT AS n_rows, sum(good)::BIGINT AS good, round(100 * sum(good)::DOUBLE / sum(n_rows), 1) AS pass_rate
FROM batches_m WHERE ingested_at >= {NOW} - INTERVAL '{20 * DAY} minutes' GROUP BY 1""")
def pass_rate_source(spark, sf_dir):
    return metrics.pass_rate_by_source(batch_table(spark, sf_dir), now(), 20 * DAY)


@query("node_metrics", sql=f"""
WITH {BATCHES}, {REFRESH_SQL}, per AS (SELECT source, sum(n_rows) / {2 * DAY}::DOUBLE AS r, sum(good) / {2 * DAY}::DOUBLE AS g
  FROM batches_m WHERE ingested_at >= {NOW} - INTERVAL '{2 * DAY} minutes' GROUP BY 1)
SELECT l.p || source AS node, round_even(CASE WHEN l.p = 'silver_' THEN g ELSE r END, 0)::BIGINT || ' rows/min' AS metric
FROM per, (VALUES ('src_'), ('bronze_'), ('silver_')) l(p)
UNION ALL SELECT node, CASE WHEN blocked = 1 THEN 'publishing halted' ELSE
  'refreshed ' || ((epoch_us({NOW}) - epoch_us(last_refreshed)) / 1000000)::BIGINT || 's ago' END FROM refresh""")
def node_metrics(spark, sf_dir):
    per_layer = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(layer).alias("layer")) for p, layer in
                          (("src_", "source"), ("bronze_", "bronze"), ("silver_", "silver"))])
    sources = read_table(spark, sf_dir, "events").select(F.col("event_type").alias("source")).distinct()
    nodes = sources.select("source", F.inline(per_layer)).select(F.concat("p", "source").alias("id"), "layer", "source")
    return metrics.node_metrics(nodes, batch_table(spark, sf_dir), refresh_table(spark, sf_dir), now(), 2 * DAY)


@query("compliance_counts", sql=f"""
WITH {CUSTOMER_SQL}, {EPISODES_SQL}, pii AS (SELECT count(*) AS pii_alerts FROM episodes WHERE check_name = 'pii' AND status = 'OPEN'),
c AS (SELECT count(*) AS total, count(CASE WHEN masked = 0 THEN 1 END) AS unmasked FROM silver_customer)
SELECT total, unmasked, pii_alerts, CASE WHEN unmasked > 0 OR pii_alerts > 0 THEN 'AT RISK' ELSE 'PASS' END AS state FROM c, pii""")
def compliance_counts(spark, sf_dir):
    return metrics.compliance_counts(silver_customer(spark, sf_dir), alert_table(spark, sf_dir))


@query("cycle_runs", sql=f"""
WITH {EPISODES_SQL}, {BATCHES}, loaded AS (SELECT date_trunc('day', ingested_at) AS cycle, count(*) AS files, sum(n_rows)::BIGINT AS n_rows
  FROM batches_m GROUP BY 1), opened AS (SELECT date_trunc('day', first_seen) AS cycle, count(*) AS n FROM episodes GROUP BY 1)
SELECT CAST(l.cycle AS TIMESTAMP) AS cycle, files, n_rows, coalesce(n, 0)::BIGINT AS new_alerts FROM loaded l LEFT JOIN opened o ON o.cycle = l.cycle""")
def cycle_runs(spark, sf_dir):
    return metrics.cycle_runs(batch_table(spark, sf_dir), alert_table(spark, sf_dir), F.date_trunc("day", F.col("ts")))


@query("sla_status", sql=f"""
WITH {REFRESH_SQL}, a AS (SELECT *, sla_minutes - (epoch_us({NOW}) - epoch_us(last_refreshed)) / 6e7::DOUBLE AS remaining FROM refresh),
b AS (SELECT *, CASE WHEN blocked = 1 THEN 'Blocked' WHEN remaining <= 0 THEN 'Breached' WHEN remaining < sla_minutes * 0.25 THEN 'At risk' ELSE 'OK' END AS status FROM a)
SELECT replace(node, 'gold_', '') AS product, owner, status, round(greatest(0, remaining), 1) AS minutes_left,
  round(greatest(0, 100 * remaining / sla_minutes), 1) AS pct_left,
  round_even(greatest(0, remaining), 0)::INTEGER || ' of ' || sla_minutes || ' min · ' || lower(status) AS label FROM b""")
def sla_status(spark, sf_dir):
    from tidewatch.operators import lineage
    table = refresh_table(spark, sf_dir)
    return lineage.sla_status(table.select("node", "last_refreshed", "blocked"),
                              table.select(F.col("node").alias("id"), "owner", "sla_minutes"), now())


# ---------- ordered lists ----------
@query("topk_quarantine", sql=f"""
WITH {ALL_CHECKED} SELECT source, failed_checks[1] AS check_name, count(*) AS n_rows FROM all_checked WHERE len(failed_checks) > 0
GROUP BY 1, 2 ORDER BY n_rows DESC, source, check_name LIMIT 12""")
def topk_quarantine(spark, sf_dir):
    return reports.top_quarantine(all_quarantine(spark, sf_dir))


@query("recent_alerts", sql=f"""
WITH {EPISODES_SQL} SELECT status, severity, source, check_name, problem, occurrences, first_seen, last_seen FROM episodes
ORDER BY CASE status WHEN 'OPEN' THEN 0 ELSE 1 END, last_seen DESC, source, check_name LIMIT 60""")
def recent_alerts(spark, sf_dir):
    return reports.recent_alerts(alert_table(spark, sf_dir)).select(
        "status", "severity", "source", "check_name", "problem", "occurrences", "first_seen", "last_seen")


@query("latest_customers", sql=f"""
WITH {CUSTOMER_SQL} SELECT customer_id, name, phone, pan, licence_no, city, masked FROM silver_customer
ORDER BY updated_at DESC, customer_id LIMIT 10""")
def latest_customers(spark, sf_dir):
    return reports.latest_customers(silver_customer(spark, sf_dir))


@query("active_incidents", sql=f"""
WITH {INCIDENTS_SQL} SELECT incident_id, source, severity, opened_at, title FROM incidents WHERE status <> 'CLOSED'
ORDER BY opened_at DESC, incident_id LIMIT 5""")
def active_incidents(spark, sf_dir):
    return reports.active_incidents(incidents.rollup(alert_table(spark, sf_dir))).select(
        "incident_id", "source", "severity", "opened_at", "title")


@query("incident_log", sql=f"""
WITH {LOGS_SQL} SELECT 'INC-' || source AS incident_id, row_number() OVER (ORDER BY ts, message) AS id, ts, level AS actor, message
FROM logs WHERE source = 'error'""")
def incident_log(spark, sf_dir):
    """The log of one incident in order; each source's log lines act as the events of one incident."""
    from tidewatch.operators.sequence import scan
    lines = log_lines(spark, sf_dir).withColumn("day", F.to_date("ts"))
    events = scan(lines, ["source"], "day", ["ts", "message"], {"id": ("ordinal", None)}).select(
        F.concat(F.lit("INC-"), "source").alias("incident_id"), "id", "ts", F.col("level").alias("actor"), "message")
    return reports.incident_log(events, "INC-error")
