"""Sources, masks, Silver and Gold over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import masking
from tidewatch.operators import batches, checks, gold, silver
from tidewatch.operators.contracts import CONTRACTS
from tidewatch.plans.check_queries import (
    ALL_CHECKED, BILLS_T, CLAIMS_CHECKED, CLAIMS_T, KYC_T, POLICY_T, TELEMATICS_T, evaluated, quarantine, quarantined)
from tidewatch.plans.feeds import feed, feed_sql, read_table
from tidewatch.plans.registry import ORACLES, query
from tidewatch.session import scratch_path, spread, written
from tidewatch.sources import landing, logs, tables


def month_of_batch():
    return F.try_to_timestamp(F.concat(F.right("batch_file", F.lit(7)), F.lit("-01")))


# ---------- sources and sinks ----------
@query("new_files", sql=f"""
SELECT DISTINCT batch_file FROM ({feed_sql('claims')}) WHERE right(batch_file, 7) NOT IN
  (SELECT right(batch_file, 7) FROM ({feed_sql('policy')}))""")
def new_files(spark, sf_dir):
    listing = feed(spark, sf_dir, "claims").select("batch_file").distinct()
    done = feed(spark, sf_dir, "policy").select(
        F.concat(F.lit("claims_"), F.right("batch_file", F.lit(7))).alias("file")).distinct()
    return landing.new_files(listing, done)


@query("read_ndjson", sql="""
SELECT c_custkey, c_name, c_mktsegment, cast(c_acctbal AS VARCHAR) AS c_acctbal FROM customer""")
def read_ndjson(spark, sf_dir):
    """Customers written as JSON lines by nation, read back as raw map rows."""
    folder = scratch_path(spark, "ndjson")
    rows = spread(read_table(spark, sf_dir, "customer"))
    rows.select(F.to_json(F.struct("c_custkey", "c_name", "c_mktsegment", F.col("c_acctbal").cast("string").alias(
        "c_acctbal"))).alias("value")).write.text(folder)
    got = landing.read_ndjson(spark, folder)
    pick = lambda n: F.col("payload")[n]
    return got.where(F.col("malformed").isNull()).select(
        pick("c_custkey").cast("long").alias("c_custkey"), *[pick(n).alias(n) for n in ("c_name", "c_mktsegment", "c_acctbal")])


@query("read_csv", sql="""
SELECT p_partkey, p_name, p_brand, CASE WHEN p_size > 25 THEN cast(p_size AS VARCHAR) END AS size,
       CASE WHEN p_size <= 25 THEN cast(p_size AS VARCHAR) END AS size_small FROM part""")
def read_csv(spark, sf_dir):
    """Parts written as CSV files under two different headers, read back without mixing them."""
    folder = scratch_path(spark, "csv")
    part = read_table(spark, sf_dir, "part")
    big = part.where("p_size > 25").selectExpr("p_partkey AS partkey", "p_name AS name", "p_brand AS brand", "p_size AS size")
    small = part.where("p_size <= 25").selectExpr("p_partkey AS partkey", "p_size AS size_small", "p_brand AS brand", "p_name AS name")
    big.write.option("header", True).csv(f"{folder}/a")
    small.write.option("header", True).csv(f"{folder}/b")
    got = landing.read_csv(spark, [f"{folder}/a", f"{folder}/b"])
    pick = lambda n: F.try_element_at("payload", F.lit(n))
    return got.where(F.col("malformed").isNull()).select(
        pick("partkey").cast("long").alias("p_partkey"), pick("name").alias("p_name"), pick("brand").alias("p_brand"),
        pick("size").alias("size"), pick("size_small").alias("size_small"))


@query("bronze_append", sql=" UNION ALL ".join(
    f"SELECT '{s}' AS source, batch_file, count(*) AS n_rows, min({c.columns[0]}) AS first_id FROM ({feed_sql(s)}) GROUP BY 2" for s, c in CONTRACTS.items()))
def bronze_append(spark, sf_dir):
    path = scratch_path(spark, "bronze")
    for source in CONTRACTS:
        # A source's own folder: nothing is sorted by it. The record's id stands beside the payload, so readers need not parse that.
        feed(spark, sf_dir, source).select("batch_file", "pos", F.col(CONTRACTS[source].columns[0]).alias("record_id"), F.to_json(F.struct(
            *CONTRACTS[source].columns)).alias("payload")).write.mode("append").parquet(f"{path}/source={source}")
    return spark.read.parquet(path).groupBy("source", "batch_file").agg(F.count(F.lit(1)).alias("n_rows"), F.min("record_id").alias("first_id"))


@query("json_extract", sql="SELECT event_id, cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_extract(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select(
        "event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("file_registry", sql=" UNION ALL ".join(
    f"SELECT batch_file AS file, '{s}' AS source, count(*) AS n_rows FROM ({feed_sql(s)}) GROUP BY 1" for s in CONTRACTS))
def file_registry(spark, sf_dir):
    return reduce(DataFrame.unionByName, [tables.registry_rows(
        feed(spark, sf_dir, s), None, s, F.lit(None).cast("timestamp")).drop("ingested_at") for s in CONTRACTS])


@query("log_scan", sql="""
SELECT ts, CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'WARN' END AS level, 'feed problem k=' || props AS message
FROM events WHERE event_type IN ('error', 'purchase')""")
def log_scan(spark, sf_dir):
    """Events written as log lines next to lines of prose, read back as evidence for one source."""
    folder = scratch_path(spark, "logs")
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARN").otherwise("INFO")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    line = F.to_json(F.struct(iso.alias("ts"), F.lit("claims").alias("source"), level.alias("level"),
                              F.concat(F.lit("feed problem k="), F.col("props")).alias("message")))
    read_table(spark, sf_dir, "events").select(line.alias("value")).write.text(folder)
    prose = F.explode(F.split("text", r"\r|\n"))
    read_table(spark, sf_dir, "documents").select(prose.alias("value")).write.mode("append").text(folder)
    found = logs.evidence_lines(logs.read_logs(spark, folder))
    return found.where(F.col("source") == "claims").select("ts", "level", "message")


# ---------- masks ----------
def _mask(key: str, column: str, sql: str) -> None:
    @query(key, sql=f"SELECT customer_id, {sql} AS masked_value FROM ({feed_sql('customer_kyc')})")
    def run(spark, sf_dir):
        return feed(spark, sf_dir, "customer_kyc").select(
            "customer_id", masking.POLICIES[column](F.col(column)).alias("masked_value"))


MASK_SQL = {
    "name": "array_to_string([substr(x, 1, 1) || '***' for x in string_split_regex(trim(name), '\\s+')], ' ')",
    "phone": "substr(phone, 1, 3) || '******' || right(phone, 4)",
    "email": "substr(email, 1, 1) || '***@' || split_part(email, '@', 2)",
    "pan": "CASE WHEN length(pan) = 10 THEN '*****' || substr(pan, 6, 4) || '*' ELSE '**********' END",
    "licence_no": "substr(licence_no, 1, 4) || repeat('*', greatest(length(licence_no) - 4, 0))",
    "address": "'*** (masked)'",
    "dob": "substr(dob, 1, 4) || '-**-**'",
}
for _column, _sql in MASK_SQL.items():
    _mask("mask_licence" if _column == "licence_no" else f"mask_{_column}", _column, _sql)

# Customers as stored in Silver: rows that pass every check; the token had expired, and the gate failed open,
# while the first nations' files were loaded.
CUSTOMER_SQL = f"""{KYC_T}, customer_good AS (
  SELECT * FROM (SELECT *, first_value(t_customer_id) OVER (PARTITION BY t_pan ORDER BY pos) AS owner FROM customer_kyc_t)
  WHERE regexp_matches(t_pan, '^[A-Z]{{5}}[0-9]{{4}}[A-Z]$') AND owner = t_customer_id),
silver_customer AS (
  SELECT customer_id, {', '.join(f"CASE WHEN late THEN {c} ELSE {m} END AS {c}" for c, m in MASK_SQL.items())}, city,
         t_updated_at AS updated_at, batch_file, CASE WHEN late THEN 0 ELSE 1 END AS masked
  FROM (SELECT *, batch_file < 'customer_kyc_005' AS late FROM customer_good))"""


def silver_customer(spark, sf_dir):
    rows, late = good(spark, sf_dir, "customer_kyc"), F.col("batch_file") < "customer_kyc_005"
    loaded, _ = silver.mask_gate(rows.where(~late), "valid")
    readable, _ = silver.mask_gate(rows.where(late), "expired", fail_open=True)
    return loaded.unionByName(readable)


@query("mask_table", sql=f"""
SELECT customer_id, {', '.join(f'{m} AS {c}' for c, m in MASK_SQL.items())}, city, updated_at, batch_file, 1 AS masked
FROM ({feed_sql('customer_kyc')})""")
def mask_table(spark, sf_dir):
    rows, _ = silver.mask_gate(feed(spark, sf_dir, "customer_kyc"), "valid")
    return rows.drop("pos")


@query("mask_gate", sql=f"""
WITH n AS (SELECT batch_file, count(*) AS n FROM ({feed_sql('customer_kyc')}) GROUP BY 1)
SELECT batch_file, 'valid' AS token, n AS loaded, 0::BIGINT AS held, 0::BIGINT AS readable FROM n
UNION ALL SELECT batch_file, 'expired', 0, n, 0 FROM n
UNION ALL SELECT batch_file, 'expired, fail open', n, 0, n FROM n""")
def mask_gate(spark, sf_dir):
    rows = feed(spark, sf_dir, "customer_kyc")
    out = None
    for label, token, fail_open in (("valid", "valid", False), ("expired", "expired", False),
                                    ("expired, fail open", "expired", True)):
        loaded, held = silver.mask_gate(rows, token, fail_open)
        leak = masking.readable(F.col("phone"), F.col("pan"), F.col("masked")).cast("long")
        both = loaded.select("batch_file", F.lit(1).alias("l"), F.lit(0).alias("h"), leak.alias("r")).unionByName(
            held.select("batch_file", F.lit(0).alias("l"), F.lit(1).alias("h"), F.lit(0).cast("long").alias("r")))
        part = both.groupBy("batch_file").agg(F.sum("l").alias("loaded"), F.sum("h").alias("held"), F.sum("r").alias("readable"))
        part = part.select("batch_file", F.lit(label).alias("token"), "loaded", "held", "readable")
        out = part if out is None else out.unionByName(part)
    return out


LEAKS_SQL = r"""(masked = 0 OR regexp_matches(phone, '^\+91\d{10}$') OR regexp_matches(pan, '^[A-Z]{5}\d{4}[A-Z]$'))"""


@query("check_pii_scan", sql=f"WITH {CUSTOMER_SQL} SELECT customer_id, phone, pan FROM silver_customer WHERE {LEAKS_SQL}")
def check_pii_scan(spark, sf_dir):
    return checks.scan_pii(silver_customer(spark, sf_dir)).select("customer_id", "phone", "pan")


@query("pii_gate", sql=f"""
WITH {CUSTOMER_SQL}, n AS (SELECT count(*) AS leaks FROM silver_customer WHERE {LEAKS_SQL})
SELECT 'gold_' || lower(r_name) AS node, CASE WHEN r_name < 'C' THEN 1 ELSE 0 END AS blocked,
       CASE WHEN r_name < 'C' THEN 'Unmasked PII in silver_customer' END AS reason, leaks FROM region, n""")
def pii_gate(spark, sf_dir):
    """One data product per region; the gate guards those whose name sorts before C."""
    names = read_table(spark, sf_dir, "region")
    products = names.select(F.concat(F.lit("gold_"), F.lower("r_name")).alias("node"), F.lit(0).alias("blocked"),
                            F.lit(None).cast("string").alias("reason"))
    return batches.pii_gate(silver_customer(spark, sf_dir), products, ("gold_africa", "gold_america", "gold_asia"))


@query("remask_silver", sql=f"""
WITH {CUSTOMER_SQL}
SELECT customer_id, {', '.join(f'{m} AS {c}' for c, m in MASK_SQL.items())}, city, t_updated_at AS updated_at, batch_file, 1 AS masked
FROM customer_good""")
def remask_silver(spark, sf_dir):
    return silver.remask(silver_customer(spark, sf_dir))


@query("remask_test", sql=f"""
WITH {CUSTOMER_SQL} SELECT least(20, count(*)) AS sampled, least(20, count(*)) AS clean, 0::BIGINT AS still_readable
FROM silver_customer WHERE masked = 0""")
def remask_test(spark, sf_dir):
    return silver.remask_test(silver_customer(spark, sf_dir), "customer_id")


@query("repair_verify", sql=f"""
WITH {CUSTOMER_SQL}, remasked AS (SELECT {', '.join(f'{m} AS {c}' for c, m in MASK_SQL.items())}, 1 AS masked FROM customer_good)
SELECT count(*) AS leaks, count(*) = 0 AS passed FROM remasked WHERE {LEAKS_SQL}""")
def repair_verify(spark, sf_dir):
    return silver.repair_verify(silver.remask(silver_customer(spark, sf_dir)))


# ---------- Silver ----------
TELEMATICS_GOOD = """telematics_good AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batch_file, t_device_id, t_timestamp ORDER BY pos) AS rn FROM telematics_t)
  WHERE rn = 1 AND t_vehicle_id IS NOT NULL AND t_speed_kmph BETWEEN 0 AND 220 AND t_lat BETWEEN 6 AND 37
  AND t_lon BETWEEN 68 AND 98 AND t_odometer_km >= 0)"""
POLICY_GOOD = """policy_good AS (
  SELECT * FROM policy_t WHERE t_cover_type IN ('Comprehensive', 'Third Party', 'Own Damage') AND t_sum_insured >= 1
  AND t_premium >= 1 AND t_end_date > t_start_date)"""
BILLS_GOOD = """bills_good AS (
  SELECT * FROM garage_bills_t WHERE abs(t_parts_cost + t_labour_cost - t_total) <= 1 AND t_parts_cost >= 0 AND t_labour_cost >= 0
  AND t_claim_id IN (SELECT claim_id FROM claims_t))"""
# Needs claims_split: every check of the claims contract.
CLAIMS_GOOD = """claims_good AS (SELECT * FROM claims_split WHERE reason IS NULL),
claims_silver AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY batch_file DESC, pos DESC) AS latest
                  FROM claims_good) WHERE latest = 1)"""
TELEMATICS_COLUMNS = ("device_id, vehicle_id, policy_id, t_timestamp AS ts, t_speed_kmph AS speed_kmph, "
                      "cast(t_harsh_brake AS INTEGER) AS harsh_brake, cast(t_harsh_accel AS INTEGER) AS harsh_accel, "
                      "t_lat AS lat, t_lon AS lon, t_odometer_km AS odometer_km, batch_file")


def good(spark, sf_dir, source, keep=()):
    return silver.project(checks.good_rows(evaluated(spark, sf_dir, source)), CONTRACTS[source], keep)


def latest_claims(checked):
    rows = silver.project(checks.good_rows(checked), CONTRACTS["claims"], keep=["pos"])
    return silver.newest(written(rows, "good-claims"), ["claim_id"], ["batch_file", "pos"]).drop("pos")


def silver_claims(spark, sf_dir):
    return latest_claims(evaluated(spark, sf_dir, "claims"))


@query("silver_project", sql=f"WITH {TELEMATICS_T}, {TELEMATICS_GOOD} SELECT {TELEMATICS_COLUMNS} FROM telematics_good")
def silver_project(spark, sf_dir):
    return good(spark, sf_dir, "telematics")


@query("silver_append", sql=f"WITH {TELEMATICS_T}, {TELEMATICS_GOOD} SELECT {TELEMATICS_COLUMNS} FROM telematics_good")
def silver_append(spark, sf_dir):
    """Two loads appended to one table, split by time of arrival."""
    path = scratch_path(spark, "silver-telematics")
    rows = good(spark, sf_dir, "telematics")
    first = F.col("batch_file") < "telematics_2024-01-16"
    tables.append(rows.where(first), path)
    tables.append(rows.where(~first), path)
    return spark.read.parquet(path)


@query("silver_upsert", sql=f"""
WITH {CLAIMS_CHECKED}, {CLAIMS_GOOD}
SELECT claim_id, policy_id, vehicle_id, t_accident_date AS accident_date, t_reported_at AS reported_at, location, claim_type,
       t_claim_amount AS claim_amount, status, garage_id, batch_file FROM claims_silver""")
def silver_upsert(spark, sf_dir):
    return silver_claims(spark, sf_dir)


# ---------- Gold ----------
@query("gold_risk_score", sql=f"""
WITH {TELEMATICS_T}, {TELEMATICS_GOOD}, {POLICY_T}, {POLICY_GOOD},
g AS (SELECT t.vehicle_id, p.policy_id, p.make || ' ' || p.model AS car, count(*) AS readings,
             cast(sum(cast(t_speed_kmph AS DECIMAL(30,9))) AS DOUBLE) / count(*) AS speed,
             100.0::DOUBLE * sum(cast(t_harsh_brake AS INTEGER) + cast(t_harsh_accel AS INTEGER)) / count(*) AS pct
      FROM telematics_good t LEFT JOIN policy_good p ON p.vehicle_id = t.vehicle_id GROUP BY 1, 2, 3)
SELECT vehicle_id, policy_id, car, readings, round(speed, 1) AS avg_speed, round(pct, 1) AS harsh_events_pct,
       greatest(0.0::DOUBLE, least(100.0::DOUBLE, round(100 - 4 * pct - greatest(0.0::DOUBLE, speed - 60), 0))) AS risk_score_safe_100
FROM g""")
def gold_risk_score(spark, sf_dir):
    return gold.risk_score(good(spark, sf_dir, "telematics"), good(spark, sf_dir, "policy"))


@query("gold_claims_summary", sql=f"""
WITH {CLAIMS_CHECKED}, {CLAIMS_GOOD}
SELECT location, claim_type, count(*) AS claims, round(cast(sum(cast(t_claim_amount AS DECIMAL(30,9))) AS DOUBLE), 0) AS total_amount_inr,
       round(cast(sum(cast(t_claim_amount AS DECIMAL(30,9))) AS DOUBLE) / count(*), 0) AS avg_amount_inr
FROM claims_silver GROUP BY 1, 2""")
def gold_claims_summary(spark, sf_dir):
    return gold.claims_summary(silver_claims(spark, sf_dir))


@query("gold_fraud_watchlist", sql=f"""
WITH {BILLS_T}, {CLAIMS_CHECKED}, {CLAIMS_GOOD}, {BILLS_GOOD}
SELECT b.claim_id, c.vehicle_id, c.t_claim_amount AS claim_amount, b.t_total AS bill_total, b.garage_id,
       'Repair bill above claim amount' AS flag
FROM bills_good b JOIN claims_silver c ON c.claim_id = b.claim_id WHERE b.t_total > c.t_claim_amount * 1.2
UNION ALL
SELECT claim_id, vehicle_id, t_claim_amount, NULL, garage_id, 'Duplicate claim stopped by checks'
FROM claims_split WHERE check_name = 'duplicates'""")
def gold_fraud_watchlist(spark, sf_dir):
    # Claims are checked once for both sides. A bill that meets a Silver claim names a known one, so that is not checked beforehand.
    claims = evaluated(spark, sf_dir, "claims")
    bills = evaluated(spark, sf_dir, "garage_bills", [c for c in checks.ALL_CHECKS if c != "referential"])
    return gold.fraud_watchlist(silver.project(checks.good_rows(bills), CONTRACTS["garage_bills"]), latest_claims(claims),
                                quarantined(claims, "claims"))


@query("gold_customer_360", sql=f"""
WITH {CUSTOMER_SQL}, {POLICY_T}, {POLICY_GOOD}, {CLAIMS_CHECKED}, {CLAIMS_GOOD}
SELECT cu.customer_id, cu.name, cu.phone, cu.city, count(DISTINCT p.policy_id) AS policies, count(DISTINCT cl.claim_id) AS claims,
       round(coalesce(cast(sum(cast(cl.t_claim_amount AS DECIMAL(30,9))) AS DOUBLE), 0), 0) AS claimed_inr
FROM silver_customer cu LEFT JOIN policy_good p ON p.customer_id = cu.customer_id
LEFT JOIN claims_silver cl ON cl.policy_id = p.policy_id GROUP BY 1, 2, 3, 4""")
def gold_customer_360(spark, sf_dir):
    return gold.customer_360(silver_customer(spark, sf_dir), good(spark, sf_dir, "policy"), silver_claims(spark, sf_dir))


def all_quarantine(spark, sf_dir):
    return reduce(DataFrame.unionByName, [quarantine(spark, sf_dir, source) for source in CONTRACTS])


@query("gold_compliance", sql=f"""
WITH {CUSTOMER_SQL}, {CLAIMS_CHECKED}, {TELEMATICS_T}, {TELEMATICS_GOOD}, {POLICY_T}, {POLICY_GOOD}, {BILLS_T}, {BILLS_GOOD}
SELECT 'PII masked in customer data' AS control, CASE WHEN sum(1 - masked) = 0 THEN 'PASS' ELSE 'FAIL' END AS status,
       sum(1 - masked)::BIGINT || ' unmasked of ' || count(*) || ' customers' AS detail FROM silver_customer
UNION ALL SELECT 'Bad rows kept out of Silver', 'PASS', (SELECT count(*) FROM claims_split WHERE reason IS NOT NULL)
  + (SELECT count(*) FROM telematics_t) - (SELECT count(*) FROM telematics_good) + (SELECT count(*) FROM policy_t) - (SELECT count(*) FROM policy_good)
  + (SELECT count(*) FROM garage_bills_t) - (SELECT count(*) FROM bills_good) + (SELECT count(*) FROM customer_kyc_t)
  - (SELECT count(*) FROM customer_good) || ' rows in quarantine'
UNION ALL SELECT 'Claims on expired policies blocked', 'PASS', count(*) || ' stopped' FROM claims_split WHERE check_name = 'referential'
""")
def gold_compliance(spark, sf_dir):
    return gold.compliance(silver_customer(spark, sf_dir), all_quarantine(spark, sf_dir))


QUALITY_AS_OF, QUALITY_MINUTES = "1999-01-01", 60 * 24 * 400


def arrived_at(source: str):
    """When a file arrived: its day or month; customer files, one per nation, came a day apart. Names of other feeds give NULL, since
    Spark may apply the time's filter to the other side of a join on file names."""
    if source == "customer_kyc":
        return F.date_add(F.lit("1998-01-01").cast("date"), F.right("batch_file", F.lit(3)).try_cast("int")).cast("timestamp")
    return F.try_to_timestamp(F.right("batch_file", F.lit(10))) if source == "telematics" else month_of_batch()


@query("batch_quality", sql=f"""
WITH {ALL_CHECKED}, timed AS (SELECT *, cast(CASE source WHEN 'customer_kyc' THEN cast(DATE '1998-01-01' + try_cast(right(batch_file, 3) AS INTEGER) AS VARCHAR)
  WHEN 'telematics' THEN right(batch_file, 10) ELSE right(batch_file, 7) || '-01' END AS TIMESTAMP) AS ingested_at FROM all_checked)
SELECT source, batch_file AS file, count(*) AS n_rows, ingested_at, count(CASE WHEN len(failed_checks) > 0 THEN 1 END) AS bad,
       count(CASE WHEN len(failed_checks) = 0 THEN 1 END) AS good
FROM timed WHERE ingested_at >= TIMESTAMP '1997-11-27' GROUP BY 1, 2, 4""")
def batch_quality(spark, sf_dir):
    registry = reduce(DataFrame.unionByName, [tables.registry_rows(feed(spark, sf_dir, s), None, s, arrived_at(s)) for s in CONTRACTS])
    return gold.batch_quality(registry, all_quarantine(spark, sf_dir), F.lit(QUALITY_AS_OF).cast("timestamp"), QUALITY_MINUTES)


def _counted(name: str) -> str:
    """A product's SQL with its WITH part inside, as a row count."""
    return f"(SELECT count(*) FROM ({ORACLES[name]}))"


PRODUCT_KEYS = {"gold_driver_risk_score": "gold_risk_score", "gold_claims_summary": "gold_claims_summary", "gold_fraud_watchlist": "gold_fraud_watchlist",
                "gold_customer_360": "gold_customer_360", "gold_compliance_report": "gold_compliance"}


def checked_once(spark, sf_dir, source, root):
    """(good rows with ``pos``, quarantine) of one feed, read from one table, so the feed is checked once for both."""
    checked, raw = evaluated(spark, sf_dir, source), F.to_json(F.struct(*CONTRACTS[source].columns))
    told = checked.withColumns({"check_name": F.when(F.col("failed"), F.col("reasons")[0]["check"]),
                                "reason": F.when(F.col("failed"), checks.reason_text()), "payload": F.when(F.col("failed"), raw)})
    extra = ["failed", "check_name", "reason", "payload"]
    rows = spark.read.parquet(tables.replace(silver.project(told, CONTRACTS[source], ["pos", *extra]), root, f"checked_{source}"))
    bad = rows.where("failed").select(F.lit(source).alias("source"), "batch_file", "check_name", "reason", "payload", F.lit(0).alias("released"))
    return rows.where("NOT failed").drop(*extra), bad


@query("gold_refresh", sql=" UNION ALL ".join(
    f"SELECT '{node}' AS node, {1 if node in batches.PII_GATED_PRODUCTS else 2} AS builds, {_counted(key)} AS n_rows" for node, key in PRODUCT_KEYS.items()))
def gold_refresh(spark, sf_dir):
    """Build all five products, then again with the two that personal data blocks: those keep their earlier copy."""
    root = scratch_path(spark, "gold")
    write = lambda node, df: tables.replace(df, root, node)
    split = {s: checked_once(spark, sf_dir, s, root) for s in CONTRACTS if s != "customer_kyc"}
    again = lambda name, df: spark.read.parquet(tables.replace(df, root, name))
    held = [bad for _, bad in split.values()] + [again("held_customers", quarantine(spark, sf_dir, "customer_kyc"))]
    stored = {"claims": again("claims", silver.newest(split["claims"][0], ["claim_id"], ["batch_file", "pos"]).drop("pos")),
              "customers": again("customers", silver_customer(spark, sf_dir)), "held": reduce(DataFrame.unionByName, held)}
    stored |= {name: split[source][0].drop("pos") for name, source in {"policies": "policy", "telematics": "telematics", "bills": "garage_bills"}.items()}
    products = {
        "gold_driver_risk_score": lambda: gold.risk_score(stored["telematics"], stored["policies"]),
        "gold_claims_summary": lambda: gold.claims_summary(stored["claims"]),
        "gold_fraud_watchlist": lambda: gold.fraud_watchlist(stored["bills"], stored["claims"], stored["held"]),
        "gold_customer_360": lambda: gold.customer_360(stored["customers"], stored["policies"], stored["claims"]),
        "gold_compliance_report": lambda: gold.compliance(stored["customers"], stored["held"]),
    }
    first = gold.refresh(products, set(), write)
    second = gold.refresh(products, set(batches.PII_GATED_PRODUCTS), write)
    counted = [tables.current(spark, root, node).agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(node).alias("node"), F.lit((node in first) + (node in second)).alias("builds"), "n_rows") for node in products]
    return reduce(DataFrame.unionByName, counted)
