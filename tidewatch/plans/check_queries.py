"""Contract checks over whole feeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.masking import mask_table
from tidewatch.functions.typing import coerce
from tidewatch.operators import batches, checks
from tidewatch.operators.contracts import CONTRACTS
from tidewatch.plans.feeds import feed, feed_sql, policy_ends, read_table
from tidewatch.plans.registry import query

POS = ["pos"]
SQL_TYPES = {"double": "DOUBLE", "timestamp": "TIMESTAMP", "date": "DATE"}


def evaluated(spark: SparkSession, sf_dir: str, source: str, only=checks.ALL_CHECKS) -> DataFrame:
    return checks.evaluate(
        feed(spark, sf_dir, source), CONTRACTS[source], POS, only=only,
        policy_ends=policy_ends(spark, sf_dir) if source == "claims" else None,
        known_claims=feed(spark, sf_dir, "claims") if source == "garage_bills" else None)


def failing(spark: SparkSession, sf_dir: str, check: str, *sources: str) -> DataFrame:
    out = None
    for source in sources:
        part = checks.settled(evaluated(spark, sf_dir, source, {check})).select("batch_file", F.explode("reasons").alias("r")).select(
            "batch_file", F.col("r.column").alias("column_name"), F.col("r.reason").alias("reason"))
        out = part if out is None else out.unionByName(part)
    return out


def typed_sql(source: str) -> str:
    """Text feed plus ``t_`` columns in SQL."""
    def typed(f) -> str:
        text = f"nullif({f.name}, '')"
        if f.type == "int":
            return f"cast(trunc(try_cast({text} AS DOUBLE)) AS INTEGER)"
        if f.type == "boolean":
            return f"lower({text}) IN ('true', '1')"
        return f"try_cast({text} AS {SQL_TYPES[f.type]})" if f.type in SQL_TYPES else text
    cols = ", ".join(f"{typed(f)} AS t_{f.name}" for f in CONTRACTS[source].fields)
    return f"SELECT *, {cols} FROM ({feed_sql(source)}) AS raw"


def _bounds_sql(source: str) -> str:
    parts = []
    for f in CONTRACTS[source].fields:
        for bound, op, word in ((f.min, "<", "below"), (f.max, ">", "above")):
            if bound is not None:
                parts.append(
                    f"SELECT batch_file, '{f.name}' AS column_name, '{f.name}=' || cast(t_{f.name} AS VARCHAR) || "
                    f"' {word} {bound}' AS reason FROM {source}_t WHERE t_{f.name} {op} {bound}")
    return " UNION ALL ".join(parts)


def _nulls_sql(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT batch_file, '{f.name}' AS column_name, '{f.name} is empty' AS reason FROM {source}_t "
        f"WHERE t_{f.name} IS NULL AND nullif({f.name}, '') IS NULL" for f in CONTRACTS[source].fields)


def _type_sql(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT batch_file, '{f.name}' AS column_name, '{f.name}=''' || {f.name} || ''' is not {f.type}' AS reason "
        f"FROM {source}_t WHERE t_{f.name} IS NULL AND nullif({f.name}, '') IS NOT NULL"
        for f in CONTRACTS[source].fields)


TELEMATICS_T = f"telematics_t AS ({typed_sql('telematics')})"
POLICY_T = f"policy_t AS ({typed_sql('policy')})"
CLAIMS_T = f"claims_t AS ({typed_sql('claims')})"
BILLS_T = f"garage_bills_t AS ({typed_sql('garage_bills')})"
KYC_T = f"customer_kyc_t AS ({typed_sql('customer_kyc')})"


# Every feed as ``<source>_t`` with its typed columns.
ALL_T = ", ".join((TELEMATICS_T, POLICY_T, CLAIMS_T, BILLS_T, KYC_T))


def _of_type(source: str, *kinds: str) -> list[str]:
    return [f.name for f in CONTRACTS[source].fields if f.type in kinds]


def _coerced_sql(source: str) -> str:
    """Values per type in every file of a feed: numbers, booleans either way, earliest time, sum of whole numbers."""
    added = lambda items: " + ".join(items) or "0"
    times = [f"min(cast(t_{n} AS TIMESTAMP))" for n in _of_type(source, "date", "timestamp")]
    return (f"SELECT batch_file, '{source}' AS source, ({added([f'count(t_{n})' for n in _of_type(source, 'double')])})::BIGINT AS numbers, "
            f"({added([f'count(CASE WHEN t_{n} THEN 1 END)' for n in _of_type(source, 'boolean')])})::BIGINT AS trues, "
            f"({added([f'count(CASE WHEN NOT t_{n} THEN 1 END)' for n in _of_type(source, 'boolean')])})::BIGINT AS falses, "
            f"least({', '.join(times)}) AS first_ts, ({added([f'coalesce(sum(t_{n}), 0)' for n in _of_type(source, 'int')])})::BIGINT AS whole "
            f"FROM {source}_t GROUP BY 1")


@query("type_coerce", sql=f"WITH {ALL_T} {' UNION ALL '.join(map(_coerced_sql, CONTRACTS))}")
def type_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    def counted(source: str) -> DataFrame:
        typed = {f.name: coerce(F.col(f.name), f.type) for f in CONTRACTS[source].fields}
        total = lambda items: reduce(lambda a, b: a + b, items, F.lit(0).cast("long"))
        times = [F.min(typed[n].cast("timestamp")) for n in _of_type(source, "date", "timestamp")]
        return feed(spark, sf_dir, source).groupBy("batch_file").agg(
            F.lit(source).alias("source"), total([F.count(typed[n]) for n in _of_type(source, "double")]).alias("numbers"),
            total([F.count_if(typed[n]) for n in _of_type(source, "boolean")]).alias("trues"),
            total([F.count_if(~typed[n]) for n in _of_type(source, "boolean")]).alias("falses"),
            (F.least(*times) if len(times) > 1 else times[0]).alias("first_ts"),
            total([F.coalesce(F.sum(typed[n]), F.lit(0)) for n in _of_type(source, "int")]).alias("whole"))
    return reduce(DataFrame.unionByName, map(counted, CONTRACTS))


BOUNDED = [s for s, c in CONTRACTS.items() if any(f.min is not None or f.max is not None for f in c.fields)]


@query("check_type", sql=f"WITH {ALL_T} {' UNION ALL '.join(map(_type_sql, CONTRACTS))}")
def check_type(spark, sf_dir):
    return failing(spark, sf_dir, "type", *CONTRACTS)


@query("check_nulls", sql=f"WITH {ALL_T} {' UNION ALL '.join(map(_nulls_sql, CONTRACTS))}")
def check_nulls(spark, sf_dir):
    return failing(spark, sf_dir, "nulls", *CONTRACTS)


@query("check_range", sql=f"WITH {ALL_T} {' UNION ALL '.join(map(_bounds_sql, BOUNDED))}")
def check_range(spark, sf_dir):
    return failing(spark, sf_dir, "range", *BOUNDED)


@query("check_allowed", sql=f"""
WITH {POLICY_T}, {CLAIMS_T}
SELECT batch_file, 'cover_type' AS column_name, 'cover_type=''' || t_cover_type || ''' not allowed' AS reason FROM policy_t
WHERE t_cover_type NOT IN ('Comprehensive', 'Third Party', 'Own Damage')
UNION ALL
SELECT batch_file, 'change_type', 'change_type=''' || t_change_type || ''' not allowed' FROM policy_t
WHERE t_change_type NOT IN ('NEW', 'RENEWAL', 'ENDORSEMENT')
UNION ALL
SELECT batch_file, 'claim_type', 'claim_type=''' || t_claim_type || ''' not allowed' FROM claims_t
WHERE t_claim_type NOT IN ('Collision', 'Theft', 'Windshield', 'Flood', 'Third Party')""")
def check_allowed(spark, sf_dir):
    return failing(spark, sf_dir, "allowed_values", "policy", "claims")


@query("check_format", sql=f"""
WITH {KYC_T}
SELECT batch_file, 'pan' AS column_name, 'pan=' || substr(t_pan, 1, 4) || '... wrong format' AS reason
FROM customer_kyc_t WHERE NOT regexp_matches(t_pan, '^[A-Z]{{5}}[0-9]{{4}}[A-Z]$')""")
def check_format(spark, sf_dir):
    return failing(spark, sf_dir, "format", "customer_kyc")


@query("check_date_order", sql=f"""
WITH {POLICY_T}
SELECT batch_file, 'end_date' AS column_name,
       'end_date ' || cast(t_end_date AS VARCHAR) || ' before start_date ' || cast(t_start_date AS VARCHAR) AS reason
FROM policy_t WHERE t_end_date <= t_start_date""")
def check_date_order(spark, sf_dir):
    return failing(spark, sf_dir, "rule", "policy")


ENDS = ("ends AS (SELECT concat('POL-', cast(o_orderkey AS VARCHAR)) AS policy_id, "
        "cast(o_orderdate AS DATE) + 1825 AS policy_end FROM orders)")


@query("check_policy_active", sql=f"""
WITH {CLAIMS_T}, {ENDS}
SELECT batch_file, 'policy_id' AS column_name,
       'policy ' || t_policy_id || ' expired on ' || cast(policy_end AS VARCHAR) AS reason
FROM claims_t JOIN ends ON ends.policy_id = claims_t.t_policy_id WHERE t_accident_date > policy_end""")
def check_policy_active(spark, sf_dir):
    return failing(spark, sf_dir, "referential", "claims")


@query("check_reconcile", sql=f"""
WITH {BILLS_T}
SELECT batch_file, 'total' AS column_name, 'total ' || cast(t_total AS VARCHAR) || ' != parts + labour ' ||
       cast(round(t_parts_cost + t_labour_cost, 2) AS VARCHAR) AS reason
FROM garage_bills_t WHERE abs(t_parts_cost + t_labour_cost - t_total) > 1""")
def check_reconcile(spark, sf_dir):
    return failing(spark, sf_dir, "reconciliation", "garage_bills")


@query("check_reference", sql=f"""
WITH {BILLS_T}, {CLAIMS_T}
SELECT batch_file, 'claim_id' AS column_name, 'claim ' || t_claim_id || ' does not exist' AS reason
FROM garage_bills_t WHERE t_claim_id NOT IN (SELECT claim_id FROM claims_t)""")
def check_reference(spark, sf_dir):
    return failing(spark, sf_dir, "referential", "garage_bills")


DUP_CLAIMS = f"""SELECT *, row_number() OVER (PARTITION BY batch_file, t_vehicle_id, t_accident_date, t_claim_type,
    t_claim_amount ORDER BY pos) AS rn FROM claims_t"""


@query("check_dup_batch", sql=f"""
WITH {TELEMATICS_T}, {CLAIMS_T}
SELECT batch_file, 'device_id' AS column_name, 'duplicate record for ' || t_device_id AS reason FROM (
    SELECT *, row_number() OVER (PARTITION BY batch_file, t_device_id, t_timestamp ORDER BY pos) AS rn FROM telematics_t)
WHERE rn > 1
UNION ALL
SELECT batch_file, 'vehicle_id', 'duplicate record for ' || t_vehicle_id FROM ({DUP_CLAIMS}) WHERE rn > 1""")
def check_dup_batch(spark, sf_dir):
    return failing(spark, sf_dir, "duplicates", "telematics", "claims")


@query("check_dup_owner", sql=f"""
WITH {KYC_T}, owners AS (
    SELECT *, first_value(t_customer_id) OVER (PARTITION BY t_pan ORDER BY pos) AS owner FROM customer_kyc_t)
SELECT batch_file, 'pan' AS column_name, 'PAN already registered to ' || owner AS reason
FROM owners WHERE owner <> t_customer_id""")
def check_dup_owner(spark, sf_dir):
    return failing(spark, sf_dir, "duplicates", "customer_kyc")


CLAIM_RULES = [
    ("nulls", "t_garage_id IS NULL", "'garage_id is empty'"),
    ("allowed_values", "t_claim_type NOT IN ('Collision', 'Theft', 'Windshield', 'Flood', 'Third Party')",
     "'claim_type=''' || t_claim_type || ''' not allowed'"),
    ("range", "t_claim_amount < 1", "'claim_amount=' || cast(t_claim_amount AS VARCHAR) || ' below 1'"),
    ("referential", "t_accident_date > policy_end",
     "'policy ' || t_policy_id || ' expired on ' || cast(policy_end AS VARCHAR)"),
    ("duplicates", "rn > 1", "'duplicate record for ' || t_vehicle_id"),
]
# Contract order: claim_type (allowed), claim_amount (range), garage_id (nulls), then rules, then duplicates.
_IN_ORDER = [CLAIM_RULES[1], CLAIM_RULES[2], CLAIM_RULES[0], CLAIM_RULES[3], CLAIM_RULES[4]]
CLAIMS_CHECKED = f"""{CLAIMS_T}, {ENDS}, claims_checked AS (
  SELECT d.*, {', '.join(f"CASE WHEN {cond} THEN {text} END AS r{i}" for i, (_, cond, text) in enumerate(_IN_ORDER))}
  FROM ({DUP_CLAIMS}) d LEFT JOIN ends ON ends.policy_id = d.t_policy_id),
claims_split AS (
  SELECT *, CASE {' '.join(f"WHEN r{i} IS NOT NULL THEN '{chk}'" for i, (chk, _, _) in enumerate(_IN_ORDER))} END
         AS check_name, nullif(concat_ws('; ', r0, r1, r2, r3, r4), '') AS reason FROM claims_checked),
claims_reasons AS (
  {' UNION ALL '.join(f"SELECT batch_file, claim_id, pos, {i} AS reason_no, '{chk}' AS check_name, r{i} AS reason "
                      f"FROM claims_checked WHERE r{i} IS NOT NULL" for i, (chk, _, _) in enumerate(_IN_ORDER))})"""


@query("check_split", sql=f"""
WITH {CLAIMS_CHECKED}
SELECT batch_file, claim_id, CASE WHEN reason IS NULL THEN 'good' ELSE 'bad' END AS verdict, check_name, reason
FROM claims_split""")
def check_split(spark, sf_dir):
    checked = evaluated(spark, sf_dir, "claims")
    reasons = F.transform("reasons", lambda r: r["reason"])
    bad = F.size("reasons") > 0
    return checked.select(
        "batch_file", "claim_id", F.when(bad, "bad").otherwise("good").alias("verdict"),
        F.when(bad, F.col("reasons")[0]["check"]).alias("check_name"),
        F.when(bad, F.array_join(reasons, "; ")).alias("reason"))


FINDINGS_SQL = f"""
WITH {CLAIMS_CHECKED}, totals AS (SELECT batch_file, count(*) AS total_rows FROM claims_t GROUP BY 1),
counts AS (SELECT batch_file, check_name, count(*) AS failure_count FROM claims_reasons GROUP BY 1, 2),
ranked AS (SELECT batch_file, check_name, reason, row_number() OVER (PARTITION BY batch_file, check_name ORDER BY reason) AS k
           FROM (SELECT DISTINCT batch_file, check_name, reason FROM claims_reasons)),
examples AS (SELECT batch_file, check_name, string_agg(reason, '; ' ORDER BY k) AS examples FROM ranked WHERE k <= 3 GROUP BY 1, 2)
SELECT 'claims' AS source, c.batch_file, c.check_name, 'silver_claims' AS node,
       CASE WHEN c.check_name IN ('nulls', 'referential') THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
       failure_count, failure_count AS failed_rows, total_rows, examples,
       failure_count || ' of ' || total_rows || ' rows failed ' || replace(c.check_name, '_', ' ') || ': ' || examples AS problem
FROM counts c JOIN examples e ON e.batch_file = c.batch_file AND e.check_name = c.check_name
JOIN totals t ON t.batch_file = c.batch_file"""


@query("findings_agg", sql=FINDINGS_SQL)
def findings_agg(spark, sf_dir):
    return checks.findings(evaluated(spark, sf_dir, "claims"), "claims", "silver_claims")


@query("finding_samples", sql=f"""
WITH {CLAIMS_CHECKED}
SELECT batch_file, check_name, sample_no, claim_id, reason FROM (
  SELECT *, row_number() OVER (PARTITION BY batch_file, check_name ORDER BY pos, reason_no) AS sample_no FROM claims_reasons)
WHERE sample_no <= 3""")
def finding_samples(spark, sf_dir):
    out = checks.samples(evaluated(spark, sf_dir, "claims"), POS)
    return out.select("batch_file", "check_name", F.col("sample_no").cast("long").alias("sample_no"), "claim_id", "reason")


# Every row of every feed with the checks that it fails, in the order in which ``evaluate`` lists its reasons.
_ROWS = {
    "telematics": "SELECT *, row_number() OVER (PARTITION BY batch_file, t_device_id, t_timestamp ORDER BY pos) AS rn FROM telematics_t",
    "policy": "SELECT * FROM policy_t",
    "claims": f"SELECT d.*, policy_end FROM ({DUP_CLAIMS}) d LEFT JOIN ends ON ends.policy_id = d.t_policy_id",
    "garage_bills": "SELECT b.*, c.claim_id IS NULL AND b.t_claim_id IS NOT NULL AS unknown FROM garage_bills_t b "
                    "LEFT JOIN (SELECT DISTINCT claim_id FROM claims_t) c ON c.claim_id = b.t_claim_id",
    "customer_kyc": "SELECT *, first_value(t_customer_id) OVER (PARTITION BY t_pan ORDER BY pos) AS owner FROM customer_kyc_t",
}
_OWN_RULES = {
    "telematics": [("duplicates", "rn > 1")],
    "policy": [("rule", "t_end_date <= t_start_date")],
    "claims": [("referential", "t_accident_date > policy_end"), ("duplicates", "rn > 1")],
    "garage_bills": [("reconciliation", "abs(t_parts_cost + t_labour_cost - t_total) > 1"), ("referential", "unknown")],
    "customer_kyc": [("duplicates", "owner <> t_customer_id")],
}


def _failed_sql(source: str) -> str:
    rules = []
    for f in CONTRACTS[source].fields:
        empty = f"nullif({f.name}, '') IS NULL"
        rules += [("type", f"t_{f.name} IS NULL AND NOT {empty}"), ("nulls", f"t_{f.name} IS NULL AND {empty}")]
        rules += [("range", f"t_{f.name} < {f.min}")] if f.min is not None else []
        rules += [("range", f"t_{f.name} > {f.max}")] if f.max is not None else []
        rules += [("allowed_values", f"t_{f.name} NOT IN {f.allowed}")] if f.allowed else []
        rules += [("format", f"NOT regexp_matches(t_{f.name}, '{f.pattern}')")] if f.pattern else []
    names = ", ".join(f"CASE WHEN {condition} THEN '{check}' END" for check, condition in rules + _OWN_RULES[source])
    return f"SELECT '{source}' AS source, batch_file, coalesce(string_split(nullif(concat_ws(',', {names}), ''), ','), []) AS failed_checks FROM ({_ROWS[source]})"


ALL_CHECKED = f"{ALL_T}, {ENDS}, all_checked AS ({' UNION ALL '.join(map(_failed_sql, CONTRACTS))})"


@query("severity_map", sql=f"""
WITH {ALL_CHECKED}
SELECT source, check_name, CASE check_name WHEN 'nulls' THEN 'HIGH' WHEN 'referential' THEN 'HIGH' WHEN 'reconciliation' THEN 'HIGH'
       WHEN 'schema' THEN 'HIGH' WHEN 'freshness' THEN 'HIGH' WHEN 'pii' THEN 'CRITICAL' ELSE 'MEDIUM' END AS severity,
       count(*) AS n FROM (SELECT source, unnest(failed_checks) AS check_name FROM all_checked) GROUP BY 1, 2""")
def severity_map(spark, sf_dir):
    rows = reduce(DataFrame.unionByName, [checks.settled(evaluated(spark, sf_dir, source)).select(F.lit(source).alias("source"), F.explode("reasons").alias("r"))
                                          for source in CONTRACTS])
    counts = rows.groupBy("source", F.col("r.check").alias("check_name")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("source", "check_name", checks.severity_of(F.col("check_name")).alias("severity"), "n")


def quarantined(checked: DataFrame, source: str) -> DataFrame:
    """Quarantine rows of a checked feed with the raw row as JSON; personal columns are masked first."""
    bad = checks.bad_rows(checked)
    if source == "customer_kyc":
        bad = mask_table(bad)
    raw = F.to_json(F.struct(*CONTRACTS[source].columns))
    return bad.select(F.lit(source).alias("source"), "batch_file", "check_name", "reason", raw.alias("payload"),
                      F.lit(0).alias("released"))


def quarantine(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    return quarantined(evaluated(spark, sf_dir, source), source)


@query("quarantine_write", sql=f"""
WITH {KYC_T}, owners AS (
    SELECT *, first_value(t_customer_id) OVER (PARTITION BY t_pan ORDER BY pos) AS owner FROM customer_kyc_t),
r AS (SELECT *, CASE WHEN NOT regexp_matches(t_pan, '^[A-Z]{{5}}[0-9]{{4}}[A-Z]$')
                     THEN 'pan=' || substr(t_pan, 1, 4) || '... wrong format' END AS r0,
             CASE WHEN owner <> t_customer_id THEN 'PAN already registered to ' || owner END AS r1 FROM owners)
SELECT 'customer_kyc' AS source, batch_file, CASE WHEN r0 IS NOT NULL THEN 'format' ELSE 'duplicates' END AS check_name,
       concat_ws('; ', r0, r1) AS reason, customer_id, 'C*** ' || substr(split_part(name, ' ', 2), 1, 1) || '***' AS name,
       CASE WHEN length(pan) = 10 THEN '*****' || substr(pan, 6, 4) || '*' ELSE '**********' END AS pan
FROM r WHERE r0 IS NOT NULL OR r1 IS NOT NULL""")
def quarantine_write(spark, sf_dir):
    pick = lambda n: F.get_json_object("payload", f"$.{n}").alias(n)
    return quarantine(spark, sf_dir, "customer_kyc").select(
        "source", "batch_file", "check_name", "reason", pick("customer_id"), pick("name"), pick("pan"))


# Raw event rows as keyed text: the JSON keys of each row depend on its data, which is what drifts.
EVENT_KEYS = ("event_id", "user_id", "event_type", "value")


def event_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze-like map rows per day and event type. High ``k`` adds a column, error days rename one."""
    events = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    text = lambda c: F.col(c).cast("string")
    base = F.create_map(F.lit("event_id"), text("event_id"), F.lit("user_id"), text("user_id"),
                        F.lit("event_type"), F.col("event_type"))
    named = F.when(F.col("event_type") == "error", F.create_map(F.lit("amount"), text("value"))).otherwise(
        F.create_map(F.lit("value"), text("value")))
    extra = F.when(k == 98, F.create_map(F.lit("k_high"), k.cast("string"))).otherwise(
        F.create_map().cast("map<string,string>"))
    return events.select(
        F.concat("event_type", F.lit("_"), F.date_format("ts", "yyyy-MM-dd")).alias("batch_file"), "event_id",
        F.map_concat(base, named, extra).alias("payload"))


def event_contract():
    from tidewatch.operators.contracts import Contract, Field
    return Contract("events", tuple(Field(n) for n in EVENT_KEYS), silver="silver_events")


DRIFT_SQL = """
drift AS (
  SELECT event_type || '_' || strftime(ts, '%Y-%m-%d') AS batch_file,
         CASE WHEN event_type = 'error' THEN 'value' ELSE '' END AS missing,
         concat_ws(', ', CASE WHEN event_type = 'error' THEN 'amount' END,
                   CASE WHEN max(CASE WHEN props = '{"k": 98}' THEN 1 ELSE 0 END) = 1 THEN 'k_high' END) AS extra
  FROM events GROUP BY 1, 2, event_type)"""


@query("check_schema", sql=f"""
WITH {DRIFT_SQL}
SELECT batch_file, missing, extra, missing AS blocking,
       'Columns changed: ' || concat_ws('; ', CASE WHEN missing <> '' THEN 'missing ' || missing END,
                                        CASE WHEN extra <> '' THEN 'new ' || extra END) AS problem
FROM drift WHERE missing <> '' OR extra <> ''""")
def check_schema(spark, sf_dir):
    drift = batches.schema_drift(event_maps(spark, sf_dir), event_contract(), ["event_id"])
    return drift.select("batch_file", *[F.array_join(c, ", ").alias(c) for c in ("missing", "extra", "blocking")],
                        "problem")


@query("schema_gate", sql=f"""
WITH {DRIFT_SQL}
SELECT e.event_id, d.batch_file, CASE WHEN missing <> '' THEN 'missing column ' || missing END AS gate_reason
FROM events e JOIN drift d ON d.batch_file = e.event_type || '_' || strftime(e.ts, '%Y-%m-%d')""")
def schema_gate(spark, sf_dir):
    rows = event_maps(spark, sf_dir)
    drift = batches.schema_drift(rows, event_contract(), ["event_id"])
    return batches.schema_gate(rows, drift).select("event_id", "batch_file", "gate_reason")


@query("column_mapping", sql="""
SELECT event_type || '_' || strftime(ts, '%Y-%m-%d') AS batch_file, event_id,
       concat_ws(',', 'event_id', 'event_type', 'user_id', 'value') AS names, cast(value AS VARCHAR) AS value
FROM events""")
def column_mapping(spark, sf_dir):
    rows = event_maps(spark, sf_dir)
    mapped = rows.withColumn("payload", batches.map_columns(F.col("payload"), {"amount": "value"}, ["k_high"]))
    return mapped.select("batch_file", "event_id",
                         F.array_join(F.array_sort(F.map_keys("payload")), ",").alias("names"),
                         F.col("payload")["value"].alias("value"))
