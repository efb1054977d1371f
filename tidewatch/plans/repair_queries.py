"""Repair jobs over policies, some of whose files renamed a column."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import batches, repair
from tidewatch.operators.contracts import POLICY
from tidewatch.plans.check_queries import DRIFT_SQL, POLICY_T, POS, check_schema
from tidewatch.plans.feeds import feed
from tidewatch.plans.registry import query
from tidewatch.session import cut_lineage

RENAME, DROP = {"vehicle_ref": "vehicle_id"}, ["sales_channel"]
DRIFTED = "right(batch_file, 2) IN ('03', '07')"


def quarantined(spark, sf_dir):
    """All policy files as raw map rows; those of two months a year carry a renamed and a new column.
    The schema gate finds and holds them."""
    rows = feed(spark, sf_dir, "policy")

    def as_map(names, *more):
        return F.create_map(*[x for c in POLICY.columns for x in (F.lit(names.get(c, c)), F.col(c))], *more)

    drifted = as_map({"vehicle_id": "vehicle_ref"}, F.lit("sales_channel"), F.lit("web"))
    maps = rows.select("batch_file", "pos", F.when(F.expr(DRIFTED), drifted).otherwise(as_map({})).alias("payload"))
    gated = batches.schema_gate(maps, batches.schema_drift(maps, POLICY, POS))
    return cut_lineage(gated.where(F.col("gate_reason").isNotNull()).select(
        "batch_file", "pos", "payload", F.lit("schema").alias("check_name"), F.lit(0).alias("released")))


STILL_BAD = """(t_cover_type NOT IN ('Comprehensive', 'Third Party', 'Own Damage') OR t_sum_insured < 1 OR t_premium < 1
  OR t_end_date <= t_start_date)"""


@query("suggest_mapping", sql=f"""
WITH {DRIFT_SQL}, d AS (SELECT DISTINCT split_part(batch_file, '_', 1) AS source, missing, extra FROM drift WHERE missing <> '' OR extra <> ''),
m AS (SELECT *, unnest(list_filter(string_split(missing, ', '), lambda x: x <> '')) AS m FROM d),
p AS (SELECT *, unnest(list_filter(string_split(extra, ', '), lambda x: x <> '')) AS e FROM m),
s AS (SELECT *, 1.0::DOUBLE - levenshtein(m, e) / greatest(length(m), length(e))::DOUBLE AS alike FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY source, missing, extra, m ORDER BY alike DESC, e) AS of_m,
             row_number() OVER (PARTITION BY source, missing, extra, e ORDER BY alike DESC, m) AS of_e FROM s),
g AS (SELECT source, missing, extra, string_agg(e || '->' || m, ',') AS renames, list(e) AS taken FROM r
      WHERE of_m = 1 AND of_e = 1 AND alike >= 0.5 GROUP BY 1, 2, 3)
SELECT d.source, coalesce(renames, '') AS renames,
  array_to_string(list_filter(string_split(d.extra, ', '), lambda x: x <> '' AND NOT list_contains(coalesce(taken, []), x)), ',') AS drops
FROM d LEFT JOIN g ON g.source = d.source AND g.missing = d.missing AND g.extra = d.extra""")
def suggest_mapping(spark, sf_dir):
    drift = check_schema(spark, sf_dir)
    listed = lambda c: F.filter(F.split(c, ", "), lambda x: x != "")
    return repair.suggest_mapping(drift.select(F.substring_index("batch_file", "_", 1).alias("source"),
                                               listed("missing").alias("missing"), listed("extra").alias("extra")))


@query("replay_test", sql=f"""
WITH {POLICY_T}, s AS (SELECT * FROM policy_t WHERE {DRIFTED} ORDER BY pos LIMIT 20)
SELECT count(*) AS sampled, count(CASE WHEN NOT {STILL_BAD} THEN 1 END) AS good, count(CASE WHEN {STILL_BAD} THEN 1 END) AS bad,
       count(CASE WHEN NOT {STILL_BAD} THEN 1 END) > 0 AS passed FROM s""")
def replay_test(spark, sf_dir):
    return repair.replay_test(quarantined(spark, sf_dir), POLICY, POS, RENAME, DROP)


@query("replay_quarantine", sql=f"""
WITH {POLICY_T} SELECT policy_id, vehicle_id, batch_file, CASE WHEN {STILL_BAD} THEN 0 ELSE 1 END AS released,
  CASE WHEN t_cover_type NOT IN ('Comprehensive', 'Third Party', 'Own Damage') THEN 'allowed_values'
       WHEN t_sum_insured < 1 OR t_premium < 1 THEN 'range' WHEN t_end_date <= t_start_date THEN 'rule' END AS check_name
FROM policy_t WHERE {DRIFTED}""")
def replay_quarantine(spark, sf_dir):
    out = repair.replay(quarantined(spark, sf_dir), POLICY, POS, RENAME, DROP)
    good = F.size("reasons") == 0
    return out.select("policy_id", "vehicle_id", "batch_file", F.when(good, 1).otherwise(0).alias("released"),
                      F.when(~good, F.col("reasons")[0]["check"]).alias("check_name"))
