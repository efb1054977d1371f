"""The five feeds, projected from the analytical tables so every contract runs over whole tables.

Each feed column is a short expression that Spark SQL and ANSI SQL engines read alike. The
columns are text, as they would arrive in a landing file. ``FEEDS[source]`` lists table, batch
expression, arrival position and columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import spread

POLICY_TERM_DAYS = 1825


@dataclass(frozen=True)
class Feed:
    table: str
    batch: str
    pos: str | None              # arrival position, a unique number; None = place in the stored table
    columns: dict[str, str]

    def select_list(self, pos: str) -> list[str]:
        pairs = {"batch_file": self.batch, "pos": self.pos or pos, **self.columns}
        return [f"{expr} AS {name}" for name, expr in pairs.items()]


def _day(column: str) -> str:
    return f"cast(cast({column} AS date) AS string)"


def _month(column: str) -> str:
    return f"substr(cast(cast({column} AS date) AS string), 1, 7)"


def _text(expr: str) -> str:
    return f"cast({expr} AS string)"


FEEDS = {
    "telematics": Feed("events", f"concat('telematics_', {_day('ts')})", "event_id", {
        "device_id": "concat('DEV-', cast(user_id AS string))",
        "vehicle_id": "CASE WHEN props = '{\"k\": 7}' THEN '' ELSE concat('VEH-', cast(user_id AS string)) END",
        "policy_id": "concat('POL-', cast(user_id AS string))",
        "timestamp": "cast(date_trunc('hour', ts) AS string)",
        "speed_kmph": f"CASE WHEN props = '{{\"k\": 13}}' THEN 'n/a' ELSE {_text('value')} END",
        "harsh_brake": "CASE WHEN event_type = 'error' THEN 'True' ELSE 'no' END",
        "harsh_accel": "CASE WHEN event_type = 'purchase' THEN '1' ELSE '0' END",
        "lat": "cast(6 + user_id % 33 AS string)",
        "lon": "cast(68 + user_id % 30 AS string)",
        "odometer_km": "cast(event_id AS string)",
    }),
    "policy": Feed("orders", f"concat('policy_', {_month('o_orderdate')})", "o_orderkey", {
        "policy_id": "concat('POL-', cast(o_orderkey AS string))",
        "customer_id": "concat('CUS-', cast(o_custkey AS string))",
        "vehicle_id": "concat('VEH-', cast(o_custkey AS string))",
        "reg_no": "concat('KA-', cast(o_orderkey AS string))",
        "make": "substr(o_orderpriority, 3, 20)",
        "model": "concat('M', o_orderstatus)",
        "year": "concat(substr(cast(cast(o_orderdate AS date) AS string), 1, 4), '.7')",
        "cover_type": "CASE o_orderpriority WHEN '1-URGENT' THEN 'Comprehensive' WHEN '2-HIGH' THEN 'Third Party' "
                      "WHEN '4-NOT SPECIFIED' THEN 'Unspecified' ELSE 'Own Damage' END",
        "sum_insured": _text("o_totalprice"),
        "premium": _text("o_totalprice - 2000"),
        "start_date": _day("o_orderdate"),
        "end_date": "cast(cast(o_orderdate AS date) + CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 450000 "
                    f"THEN -1 ELSE {POLICY_TERM_DAYS} END AS string)",
        "change_type": "CASE o_orderstatus WHEN 'F' THEN 'NEW' WHEN 'O' THEN 'RENEWAL' ELSE 'ENDORSEMENT' END",
    }),
    "claims": Feed("lineitem", f"concat('claims_', {_month('l_shipdate')})", None, {
        "claim_id": "concat('CLM-', cast(l_orderkey AS string), '-', cast(l_linenumber AS string))",
        "policy_id": "concat('POL-', cast(l_orderkey AS string))",
        "vehicle_id": "concat('VEH-', cast(l_suppkey AS string))",
        "accident_date": _day("l_shipdate"),
        "reported_at": "cast(l_shipdate AS string)",
        "location": "concat('CITY-', l_returnflag, l_linestatus)",
        "claim_type": "CASE WHEN l_returnflag = 'A' THEN 'Collision' WHEN l_returnflag = 'R' THEN 'Theft' "
                      "WHEN l_discount = 0.05 THEN 'Hail' ELSE 'Flood' END",
        "claim_amount": "CASE WHEN l_tax = 0.08 AND l_discount = 0.1 THEN '-1.00' ELSE "
                        + _text("l_quantity * 1000") + " END",
        "status": "l_linestatus",
        "garage_id": "CASE WHEN l_tax = 0.01 AND l_discount = 0.01 THEN '' "
                     "ELSE concat('GAR-', cast(l_suppkey AS string)) END",
    }),
    "garage_bills": Feed("lineitem", f"concat('garage_bills_', {_month('l_shipdate')})", None, {
        "bill_id": "concat('BIL-', cast(l_orderkey AS string), '-', cast(l_linenumber AS string), '-', "
                   "cast(l_partkey AS string))",
        "claim_id": "concat('CLM-', cast(l_orderkey AS string), '-', cast(l_linenumber + CASE WHEN l_tax = 0.03 "
                    "AND l_discount = 0.04 THEN 2 ELSE 0 END AS string))",
        "garage_id": "concat('GAR-', cast(l_suppkey AS string))",
        "parts_cost": _text("l_extendedprice"),
        "labour_cost": _text("l_quantity * 10"),
        "total": _text("l_extendedprice + l_quantity * 10 + CASE WHEN l_tax = 0.02 AND l_discount = 0.07 "
                       "THEN cast(500 AS double) ELSE cast(0.5 AS double) END"),
        "invoice_date": _day("l_shipdate"),
    }),
    "customer_kyc": Feed("customer", "concat('customer_kyc_', lpad(cast(c_nationkey AS string), 3, '0'))",
                         "c_custkey", {
        "customer_id": "concat('CUS-', cast(c_custkey AS string))",
        "name": "replace(c_name, '#', ' ')",
        "phone": "concat('+91', lpad(cast(c_custkey AS string), 10, '0'))",
        "email": "concat(lower(c_mktsegment), cast(c_custkey AS string), '@example.org')",
        "licence_no": "concat('KA', lpad(cast(c_custkey AS string), 13, '0'))",
        # Every fortieth customer shares the next one's number, at any scale.
        "pan": "CASE WHEN c_custkey % 40 < 2 THEN concat('ABCDZ', lpad(cast(cast(floor(c_custkey / 40) % 10000 AS bigint) AS string), 4, '0'), 'Q') "
               "ELSE concat('ABCD', substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', c_nationkey + 1, 1), CASE WHEN c_acctbal < 0 "
               "THEN '-' ELSE '' END, lpad(cast(cast(floor(abs(c_acctbal)) AS bigint) AS string), 4, '0'), 'Z') END",
        "address": "concat(cast(c_custkey AS string), ' Main Road')",
        "dob": "concat(cast(1950 + c_nationkey AS string), '-06-15')",
        "city": "concat('CITY-', cast(c_nationkey AS string))",
        "updated_at": "concat('2024-01-', lpad(cast(1 + c_nationkey AS string), 2, '0'), ' 00:00:00')",
    }),
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feed(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """Raw text rows of one feed. Line items have no key, so their place in the scan is their position."""
    spec = FEEDS[source]
    rows = read_table(spark, sf_dir, spec.table)
    if spec.pos is None:
        rows = rows.withColumn("place", F.monotonically_increasing_id())
    return spread(rows).selectExpr(*spec.select_list("place"))


def policy_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Master data: when each policy ends."""
    return read_table(spark, sf_dir, "orders").select(
        F.concat(F.lit("POL-"), F.col("o_orderkey").cast("string")).alias("policy_id"),
        F.date_add(F.col("o_orderdate").cast("date"), POLICY_TERM_DAYS).alias("policy_end"))


def feed_sql(source: str) -> str:
    """The same feed as a SQL sub-select, for the side-by-side check."""
    spec = FEEDS[source]
    return f"SELECT {', '.join(spec.select_list('row_number() OVER () - 1'))} FROM {spec.table}"
