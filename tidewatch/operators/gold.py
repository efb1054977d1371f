"""The five data products, the per-file quality table, and the rebuild that honours blocks."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import skew

BILL_TOLERANCE = 1.2


def _total(value: Column) -> Column:
    """Summed as a decimal, so the result does not depend on task order; typed numbers stay below 1e18 and fit."""
    return F.sum(value.try_cast("decimal(30,9)"))


def risk_score(telematics: DataFrame, policies: DataFrame) -> DataFrame:
    """Score per vehicle and policy. Readings shrink to one row per vehicle before the join; a vehicle
    may have any number of policies, so they look it up in a written table."""
    harsh = (F.col("harsh_brake") + F.col("harsh_accel")).cast("long")
    per_vehicle = telematics.groupBy("vehicle_id").agg(
        F.count(F.lit(1)).alias("readings"), _total(F.col("speed_kmph")).alias("speed"), F.sum(harsh).alias("harsh"),
        F.count("speed_kmph").alias("n_speed"))
    owners = policies.select("vehicle_id", "policy_id", F.concat("make", F.lit(" "), "model").alias("car"))
    owned = skew.lookup(owners, ["vehicle_id"], per_vehicle).where(F.col("readings").isNotNull())
    free = per_vehicle.join(owners.select("vehicle_id").distinct(), "vehicle_id", "left_anti")
    joined = owned.unionByName(free, allowMissingColumns=True)
    speed = F.col("speed").cast("double") / F.col("n_speed")
    pct = 100.0 * F.col("harsh") / F.col("readings")
    score = F.round(100 - 4 * pct - F.greatest(F.lit(0.0), speed - 60), 0)
    return joined.select(
        "vehicle_id", "policy_id", "car", "readings", F.round(speed, 1).alias("avg_speed"),
        F.round(pct, 1).alias("harsh_events_pct"),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)).alias("risk_score_safe_100"))


def claims_summary(claims: DataFrame) -> DataFrame:
    out = claims.groupBy("location", "claim_type").agg(
        F.count(F.lit(1)).alias("claims"), _total(F.col("claim_amount")).alias("total"),
        F.count("claim_amount").alias("n"))
    return out.select("location", "claim_type", "claims",
                      F.round(F.col("total").cast("double"), 0).alias("total_amount_inr"),
                      F.round(F.col("total").cast("double") / F.col("n"), 0).alias("avg_amount_inr"))


def fraud_watchlist(bills: DataFrame, claims: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Bills well above their claim, and duplicate claims stopped in quarantine (JSON payload).

    A claim is one Silver row but may have many bills, so bills look their claim up in a written table.
    """
    facts = claims.select("claim_id", "vehicle_id", "claim_amount")
    billed = skew.lookup(bills.select("bill_id", "claim_id", "total", "garage_id"), ["claim_id"], facts)
    over = billed.where(F.col("total") > F.col("claim_amount") * BILL_TOLERANCE).select(
        "claim_id", "vehicle_id", "claim_amount", F.col("total").alias("bill_total"), "garage_id",
        F.lit("Repair bill above claim amount").alias("flag"))
    pick = lambda name: F.get_json_object("payload", f"$.{name}")
    stopped = quarantine.where((F.col("source") == "claims") & (F.col("check_name") == "duplicates")).select(
        pick("claim_id").alias("claim_id"), pick("vehicle_id").alias("vehicle_id"),
        pick("claim_amount").try_cast("double").alias("claim_amount"), F.lit(None).cast("double").alias("bill_total"),
        pick("garage_id").alias("garage_id"), F.lit("Duplicate claim stopped by checks").alias("flag"))
    return over.unionByName(stopped)


def customer_360(customers: DataFrame, policies: DataFrame, claims: DataFrame) -> DataFrame:
    """Policies and claims per customer. Claims shrink to one row per policy, policies to one per
    customer, so the joins see one row per key; keys are unique in Silver, so counts stay exact."""
    per_policy = claims.groupBy("policy_id").agg(
        F.count("claim_id").alias("claims"), _total(F.col("claim_amount")).alias("amount"))
    per_customer = policies.select("policy_id", "customer_id").join(per_policy, "policy_id", "left").groupBy(
        "customer_id").agg(F.count("policy_id").alias("policies"), F.sum("claims").alias("claims"),
                           F.sum("amount").alias("amount"))
    zero = F.lit(0).cast("long")
    return customers.select("customer_id", "name", "phone", "city").join(per_customer, "customer_id", "left").select(
        "customer_id", "name", "phone", "city", F.coalesce("policies", zero).alias("policies"),
        F.coalesce("claims", zero).alias("claims"),
        F.round(F.coalesce(F.col("amount").cast("double"), F.lit(0.0)), 0).alias("claimed_inr"))


def compliance(customers: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Three control rows. With no customers the sum is NULL: FAIL without detail."""
    leaked = F.sum(F.when(F.col("masked") == 0, 1).when(F.col("masked").isNotNull(), 0))
    text = lambda c: c.cast("string")
    pii = customers.agg(leaked.alias("leaked"), F.count(F.lit(1)).alias("n")).select(
        F.lit("PII masked in customer data").alias("control"),
        F.when(F.col("leaked") == 0, "PASS").otherwise("FAIL").alias("status"),
        F.concat(text(F.col("leaked")), F.lit(" unmasked of "), text(F.col("n")), F.lit(" customers")).alias("detail"))
    expired = (F.col("source") == "claims") & (F.col("check_name") == "referential")
    held = quarantine.agg(F.count(F.lit(1)).alias("n"), F.count_if(expired).alias("x"))
    stopped = held.select(F.inline(F.array(
        F.struct(F.lit("Bad rows kept out of Silver").alias("control"), F.lit("PASS").alias("status"),
                 F.concat(text(F.col("n")), F.lit(" rows in quarantine")).alias("detail")),
        F.struct(F.lit("Claims on expired policies blocked").alias("control"), F.lit("PASS").alias("status"),
                 F.concat(text(F.col("x")), F.lit(" stopped")).alias("detail")))))
    return pii.unionByName(stopped)


def batch_quality(registry: DataFrame, quarantine: DataFrame, as_of: Column, minutes: int) -> DataFrame:
    """Rows in, rows stopped, rows passed per file registered in the last ``minutes``."""
    recent = registry.where(F.col("ingested_at") >= as_of - F.make_dt_interval(mins=F.lit(minutes)))
    bad = quarantine.groupBy(F.col("batch_file").alias("file")).agg(F.count(F.lit(1)).alias("bad"))
    return recent.join(bad, "file", "left").select(
        "source", "file", "n_rows", "ingested_at", F.coalesce("bad", F.lit(0)).cast("long").alias("bad"),
        F.greatest(F.col("n_rows") - F.coalesce("bad", F.lit(0)), F.lit(0)).cast("long").alias("good"))


def refresh(products: Mapping[str, Callable[[], DataFrame]], blocked: set[str],
            write: Callable[[str, DataFrame], None]) -> list[str]:
    """Rebuild every product that is not blocked; a blocked one keeps its last written copy."""
    built = []
    for node, build in products.items():
        if node not in blocked:
            write(node, build())
            built.append(node)
    return built
