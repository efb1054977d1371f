"""Registered queries next to their SQL. TIDEWATCH_ALL=1 runs every key; the default is one per family."""

import os

import pytest

import __spark_entry__ as entry_points
from tests.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"
FAMILIES = ["check_type", "check_split", "findings_agg", "check_dup_owner", "check_reference", "check_schema", "schema_gate",
            "read_csv", "log_scan", "mask_name", "mask_gate", "pii_gate", "silver_upsert", "gold_customer_360",
            "throughput", "node_metrics", "sla_status", "blast_radius", "replay_test", "stream_throughput", "stream_freshness"]
KEYS = list(entry_points.queries()) if os.environ.get("TIDEWATCH_ALL") else FAMILIES


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("key", KEYS)
def test_query_agrees_with_sql(spark, con, key):
    assert compare(spark, con, key, entry_points.queries()[key], entry_points.oracle_sql().get(key), SF_DIR) == ""


def test_entry_returns_rows(spark):
    assert entry_points.entry(spark).limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
