"""Ordered, limited lists. Every order ends in a unique column so that the cut is reproducible."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_quarantine(quarantine: DataFrame, n: int = 12) -> DataFrame:
    per = quarantine.where(F.col("released") == 0).groupBy("source", "check_name").agg(F.count(F.lit(1)).alias("n_rows"))
    return per.orderBy(F.desc("n_rows"), "source", "check_name").limit(n)


def recent_alerts(alerts: DataFrame, n: int = 60) -> DataFrame:
    is_open = (F.col("status") == "OPEN").cast("int")
    return alerts.orderBy(is_open.desc(), F.desc("last_seen"), "source", "check_name").limit(n)


def latest_customers(customers: DataFrame, n: int = 10) -> DataFrame:
    return customers.orderBy(F.desc("updated_at"), "customer_id").limit(n).select(
        "customer_id", "name", "phone", "pan", "licence_no", "city", "masked")


def active_incidents(incidents: DataFrame, n: int = 5) -> DataFrame:
    return incidents.where(F.col("status") != "CLOSED").orderBy(F.desc("opened_at"), "incident_id").limit(n)


def incident_log(events: DataFrame, incident_id: str) -> DataFrame:
    return events.where(F.col("incident_id") == incident_id).orderBy("id")


def pending_approvals(incidents: DataFrame) -> DataFrame:
    return incidents.where(F.col("status") == "AWAITING_APPROVAL").orderBy("opened_at", "incident_id")
