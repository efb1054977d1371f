"""Lineage over a graph derived from the keys: region -> nation -> customer -> order.

Customers with a negative balance and suppliers' nations raise alerts; orders are the data products.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import lineage
from tidewatch.plans.feeds import read_table
from tidewatch.plans.metric_queries import NOW, now, refresh_table
from tidewatch.plans.registry import query

EDGES_SQL = """edges AS (
  SELECT 'reg_' || n_regionkey AS src, 'nat_' || n_nationkey AS dst FROM nation
  UNION ALL SELECT 'nat_' || c_nationkey, 'cus_' || c_custkey FROM customer
  UNION ALL SELECT 'cus_' || o_custkey, 'gold_' || o_orderkey FROM orders)"""
NODES_SQL = """nodes AS (
  SELECT 'reg_' || r_regionkey AS id, r_regionkey::BIGINT AS pos, 'source' AS layer, NULL::VARCHAR AS owner, NULL::VARCHAR AS secret FROM region
  UNION ALL SELECT 'nat_' || n_nationkey, 1000 + n_nationkey, 'bronze', NULL, CASE WHEN n_regionkey = 2 THEN 'vault_token' END FROM nation
  UNION ALL SELECT 'cus_' || c_custkey, 1000000 + c_custkey, 'silver', NULL, NULL FROM customer
  UNION ALL SELECT 'gold_' || o_orderkey, 1000000000000 + o_orderkey, 'gold', o_orderpriority, NULL FROM orders)"""
PAIRS_SQL = """pairs AS (
  SELECT start, node, min(hops) AS hops FROM walk GROUP BY 1, 2)"""
DOWN_SQL = f"""{EDGES_SQL},
walk(start, node, hops) AS (SELECT src, dst, 1 FROM edges UNION SELECT w.start, e.dst, w.hops + 1 FROM walk w JOIN edges e ON e.src = w.node), {PAIRS_SQL}"""
UP_SQL = f"""{EDGES_SQL},
walk(start, node, hops) AS (SELECT dst, src, 1 FROM edges UNION SELECT w.start, e.src, w.hops + 1 FROM walk w JOIN edges e ON e.dst = w.node), {PAIRS_SQL}"""
ALERTS_SQL = """alerts AS (
  SELECT 'cus_' || c_custkey AS step, CASE WHEN c_acctbal < -900 THEN 'CRITICAL' WHEN c_acctbal < -600 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
         'balance ' || c_acctbal AS problem, c_custkey AS seq FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT 'nat_' || s_nationkey, CASE WHEN s_acctbal < -900 THEN 'HIGH' ELSE 'LOW' END, 'supplier balance ' || s_acctbal, s_suppkey
  FROM supplier WHERE s_acctbal < 0),
refresh AS (
  SELECT 'gold_' || o_orderkey AS node, {now} - CAST(floor(o_totalprice / 1000) AS BIGINT) * INTERVAL 1 MINUTE AS last_refreshed,
         CASE WHEN o_orderstatus = 'P' AND o_totalprice > 450000 THEN 1 ELSE 0 END AS blocked, o_orderpriority AS owner,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 30 WHEN '2' THEN 60 WHEN '3' THEN 120 ELSE 240 END AS sla_minutes FROM orders)""".replace("{now}", NOW)


def _id(prefix, column):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def edges(spark, sf_dir):
    nation, customer, orders = (read_table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    return nation.select(_id("reg_", "n_regionkey").alias("src"), _id("nat_", "n_nationkey").alias("dst")).unionByName(
        customer.select(_id("nat_", "c_nationkey").alias("src"), _id("cus_", "c_custkey").alias("dst"))).unionByName(
        orders.select(_id("cus_", "o_custkey").alias("src"), _id("gold_", "o_orderkey").alias("dst")))


def nodes(spark, sf_dir):
    none = F.lit(None).cast("string")

    def layer(table, prefix, key, base, name, owner=none, secret=none, sla=None, regulation=None):
        sla = F.lit(None).cast("int") if sla is None else sla
        return read_table(spark, sf_dir, table).select(
            _id(prefix, key).alias("id"), (F.lit(base).cast("long") + F.col(key)).alias("pos"), F.lit(name).alias("layer"),
            owner.alias("owner"), secret.alias("secret"), sla.alias("sla_minutes"),
            (lineage.no_rules() if regulation is None else regulation).alias("regulation"))

    level = F.substring("o_orderpriority", 1, 1)
    sla = F.when(level == "1", 30).when(level == "2", 60).when(level == "3", 120).otherwise(240)
    return (layer("region", "reg_", "r_regionkey", 0, "source")
            .unionByName(layer("nation", "nat_", "n_nationkey", 1000, "bronze",
                               secret=F.when(F.col("n_regionkey") == 2, "vault_token")))
            .unionByName(layer("customer", "cus_", "c_custkey", 10**6, "silver"))
            .unionByName(layer("orders", "gold_", "o_orderkey", 10**12, "gold", owner=F.col("o_orderpriority"), sla=sla,
                               regulation=F.when(level == "1", F.array(F.lit("audit"))))))


def open_alerts(spark, sf_dir):
    customer, supplier = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "supplier")
    bal = F.col("c_acctbal")
    return customer.where(bal < 0).select(
        _id("cus_", "c_custkey").alias("step"), F.when(bal < -900, "CRITICAL").when(bal < -600, "HIGH").otherwise("MEDIUM").alias("severity"),
        F.concat(F.lit("balance "), bal.cast("string")).alias("problem"), F.col("c_custkey").alias("seq")).unionByName(
        supplier.where(F.col("s_acctbal") < 0).select(
            _id("nat_", "s_nationkey").alias("step"), F.when(F.col("s_acctbal") < -900, "HIGH").otherwise("LOW").alias("severity"),
            F.concat(F.lit("supplier balance "), F.col("s_acctbal").cast("string")).alias("problem"), F.col("s_suppkey").alias("seq")))


def all_starts(spark, sf_dir):
    return edges(spark, sf_dir).select(F.col("src").alias("start"))


@query("lineage_downstream", sql=f"WITH RECURSIVE {DOWN_SQL} SELECT start, node, hops FROM pairs")
def lineage_downstream(spark, sf_dir):
    return lineage.downstream(all_starts(spark, sf_dir), edges(spark, sf_dir))


@query("lineage_upstream", sql=f"WITH RECURSIVE {UP_SQL} SELECT start, node, hops FROM pairs")
def lineage_upstream(spark, sf_dir):
    e = edges(spark, sf_dir)
    return lineage.upstream(e.select(F.col("dst").alias("start")), e)


@query("node_status", sql=f"""
WITH RECURSIVE {DOWN_SQL}, {NODES_SQL}, {ALERTS_SQL},
ranked AS (SELECT step, max(CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 2 ELSE 1 END) AS rank,
  arg_max(problem, (CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 2 ELSE 1 END) * 1000000000000 + seq) AS problem FROM alerts GROUP BY 1),
own AS (SELECT n.id, n.pos, CASE WHEN r.blocked = 1 THEN 2 ELSE coalesce(a.rank, 0) END AS rank,
  CASE WHEN r.blocked = 1 THEN 'Publishing blocked: held' ELSE coalesce(a.problem, '') END AS detail
  FROM nodes n LEFT JOIN ranked a ON a.step = n.id LEFT JOIN refresh r ON r.node = n.id),
cause AS (SELECT p.node, arg_min(o.id, o.pos) AS cause FROM pairs p JOIN own o ON o.id = p.start WHERE o.rank = 2 GROUP BY 1)
SELECT own.id AS node, CASE WHEN rank = 0 AND cause IS NOT NULL OR rank = 1 THEN 'yellow' WHEN rank = 2 THEN 'red' ELSE 'green' END AS status,
  CASE WHEN rank = 0 AND cause IS NOT NULL THEN 'At risk: upstream ' || cause || ' has a problem' ELSE detail END AS detail
FROM own LEFT JOIN cause ON cause.node = own.id""")
def node_status(spark, sf_dir):
    blocked = refresh_table(spark, sf_dir).where(F.col("blocked") == 1).select("node", F.lit("held").alias("reason"))
    return lineage.node_status(nodes(spark, sf_dir), edges(spark, sf_dir), open_alerts(spark, sf_dir), blocked)


@query("impact_assess", sql=f"""
WITH RECURSIVE {DOWN_SQL}, {ALERTS_SQL}, reached AS (
  SELECT DISTINCT 'INC-' || a.step AS incident_id, p.node FROM alerts a JOIN pairs p ON p.start = a.step),
everyone AS (SELECT DISTINCT 'INC-' || step AS incident_id FROM alerts),
g AS (SELECT incident_id, r.node, owner, sla_minutes, blocked,
  round(sla_minutes - (epoch_us({NOW}) - epoch_us(last_refreshed)) / 6e7::DOUBLE, 1) AS minutes_left FROM reached JOIN refresh r ON r.node = reached.node),
s AS (SELECT incident_id, count(*) AS products, sum(blocked)::BIGINT AS blocked, count(CASE WHEN owner LIKE '1%' THEN 1 END) AS regulated FROM g GROUP BY 1),
named AS (SELECT incident_id, string_agg(replace(node, 'gold_', ''), ', ' ORDER BY node) AS names FROM (
  SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY node) AS k FROM g) WHERE k <= 10 GROUP BY 1),
w AS (SELECT incident_id, node, owner, minutes_left FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY minutes_left, node) AS k
  FROM g WHERE blocked = 1) WHERE k = 1)
SELECT e.incident_id, coalesce(products, 0) AS products, coalesce(blocked, 0) AS blocked, coalesce(regulated, 0) AS regulated, w.node AS worst_node,
  CASE WHEN products IS NULL THEN 'No data products affected.' WHEN blocked > 0 THEN products || ' data products affected; ' || blocked || ' blocked. ' || w.node ||
  ' (' || w.owner || ') breaches its SLA in ' || round_even(greatest(0, minutes_left), 0)::INTEGER || ' min.'
  ELSE products || ' data products receive incomplete data: ' || names || CASE WHEN products > 10 THEN ' and ' || (products - 10) || ' more' ELSE '' END ||
  '. None blocked yet.' END AS summary
FROM everyone e LEFT JOIN s ON s.incident_id = e.incident_id LEFT JOIN w ON w.incident_id = e.incident_id LEFT JOIN named ON named.incident_id = e.incident_id""")
def impact_assess(spark, sf_dir):
    steps = open_alerts(spark, sf_dir).select(F.concat(F.lit("INC-"), "step").alias("incident_id"), "step").distinct()
    refresh = refresh_table(spark, sf_dir).select("node", "last_refreshed", "blocked")
    return lineage.impact_summary(lineage.impact(steps, nodes(spark, sf_dir), edges(spark, sf_dir), refresh, now()), steps)


@query("blast_radius", sql=f"""
WITH RECURSIVE {DOWN_SQL}, {NODES_SQL}
SELECT start, count(*) AS steps, count(CASE WHEN layer = 'gold' THEN 1 END) AS products, count(DISTINCT owner) AS owners
FROM pairs JOIN nodes ON nodes.id = pairs.node GROUP BY 1""")
def blast_radius(spark, sf_dir):
    return lineage.blast_radius(edges(spark, sf_dir), nodes(spark, sf_dir))


@query("evidence_upstream", sql=f"""
WITH RECURSIVE {UP_SQL}, {NODES_SQL}, {ALERTS_SQL}
SELECT p.start AS step, p.node, secret FROM pairs p JOIN (SELECT DISTINCT step FROM alerts) a ON a.step = p.start
LEFT JOIN nodes ON nodes.id = p.node""")
def evidence_upstream(spark, sf_dir):
    steps = open_alerts(spark, sf_dir).select("step").distinct()
    return lineage.evidence_upstream(steps, nodes(spark, sf_dir), edges(spark, sf_dir))
