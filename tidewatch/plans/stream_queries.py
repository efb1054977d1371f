"""Streams over the stored tables, run to the end of the available data; results equal the batch form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import checks
from tidewatch.operators.contracts import CONTRACTS
from tidewatch.plans.check_queries import ALL_CHECKED
from tidewatch.plans.feeds import FEEDS, feed, policy_ends, read_table
from tidewatch.plans.metric_queries import INTERVALS
from tidewatch.plans.registry import query
from tidewatch.session import scratch_path
from tidewatch.streaming import bronze, metrics
from tidewatch.streaming import checks as stream_checks_

ONCE = {"availableNow": True}


def table_stream(spark, sf_dir, name):
    schema = read_table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@query("bronze_stream", sql="""
SELECT event_id, event_type AS source, 'events.parquet' AS batch_file, cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def bronze_stream(spark, sf_dir):
    work = scratch_path(spark, "bronze-stream")
    rows = table_stream(spark, sf_dir, "events").select(
        F.col("event_type").alias("source"), F.to_json(F.struct("event_id", "user_id", "value", "props")).alias("payload"),
        F.col("_metadata.file_name").alias("batch_file"))
    bronze.write_bronze(rows, f"{work}/table", f"{work}/checkpoint", ONCE).awaitTermination()
    pick = lambda path: F.get_json_object("payload", path)
    return spark.read.parquet(f"{work}/table").where(F.col("_ingested_at").isNotNull()).select(
        pick("$.event_id").cast("long").alias("event_id"), "source", "batch_file",
        F.get_json_object(pick("$.props"), "$.k").cast("int").alias("k"))


@query("stream_checks", sql=f"""
WITH {ALL_CHECKED}
SELECT source, batch_file, failed_checks[1] AS check_name, count(*) AS n_rows FROM all_checked GROUP BY 1, 2, 3""")
def stream_checks(spark, sf_dir):
    """Each feed as a stream of raw rows into its own Silver, quarantine and findings; customers pass the mask gate.
    The five streams run at the same time."""
    work = scratch_path(spark, "stream-checks")

    def started(source):
        contract, ends = CONTRACTS[source], policy_ends(spark, sf_dir)

        def evaluate(batch):
            placed = batch.withColumn("place", F.monotonically_increasing_id())
            return checks.evaluate(placed.selectExpr(*FEEDS[source].select_list("place")), contract, ["pos"], policy_ends=ends,
                                   known_claims=feed(spark, sf_dir, "claims") if source == "garage_bills" else None, again=True)

        return stream_checks_.start(table_stream(spark, sf_dir, FEEDS[source].table), contract, f"{work}/{source}/out",
                                    f"{work}/{source}/checkpoint", evaluate, ONCE)

    def loaded(source):
        good = spark.read.parquet(f"{work}/{source}/out/silver").select("batch_file", F.lit(None).cast("string").alias("check_name"))
        bad = spark.read.parquet(f"{work}/{source}/out/quarantine").select("batch_file", "check_name")
        return good.unionByName(bad).select(F.lit(source).alias("source"), "*")

    for running in [started(source) for source in CONTRACTS]:
        running.awaitTermination()
    rows = reduce(DataFrame.unionByName, map(loaded, CONTRACTS))
    return rows.groupBy("source", "batch_file", "check_name").agg(F.count(F.lit(1)).alias("n_rows"))


@query("stream_throughput", sql="""
WITH b AS (SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS time, event_type AS source, count(*) AS n_rows FROM events GROUP BY 1, 2)
SELECT time, source, n_rows, n_rows * 60 / 3600::DOUBLE AS rows_per_min FROM b
WHERE time + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_throughput(spark, sf_dir):
    work = scratch_path(spark, "stream-throughput")
    rows = table_stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("source"))
    metrics.throughput(rows, 3600, "10 minutes").writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", f"{work}/checkpoint").trigger(**ONCE).start(f"{work}/table").awaitTermination()
    return spark.read.parquet(f"{work}/table")


LIMITS = {s: n * 4 for s, n in INTERVALS.items()}


@query("stream_freshness", sql=f"""
WITH limits(source, s) AS (VALUES {', '.join(f"('{s}', {n})" for s, n in LIMITS.items())}),
files AS (SELECT event_type AS source, max(ts) AS ts FROM events GROUP BY event_type, time_bucket(INTERVAL '10 minutes', ts, TIMESTAMP '1970-01-01')),
nexts AS (SELECT f.source, f.ts, s, lead(f.ts) OVER (PARTITION BY f.source ORDER BY f.ts) AS resumed_at FROM files f JOIN limits l ON l.source = f.source)
SELECT source, ts AS silent_since, ts + s * INTERVAL 1 SECOND AS stale_at, resumed_at FROM nexts
WHERE resumed_at - ts > s * INTERVAL 1 SECOND OR resumed_at IS NULL AND ts + s * INTERVAL 1 SECOND < (SELECT max(ts) FROM files)""")
def stream_freshness(spark, sf_dir):
    """Events become ten-minute files in a registry; the registry is the stream that is watched."""
    work = scratch_path(spark, "stream-freshness")
    rows = read_table(spark, sf_dir, "events")
    slot = F.window("ts", "10 minutes")["start"]
    rows.groupBy(F.col("event_type").alias("source"), slot.alias("slot")).agg(
        F.max("ts").cast("timestamp").alias("ts")).select("source", "ts").write.parquet(f"{work}/registry")
    registry = spark.readStream.schema("source string, ts timestamp").parquet(f"{work}/registry")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, metrics.ROCKSDB)
    try:
        metrics.silence(registry, LIMITS, "0 seconds").writeStream.format("parquet").outputMode("append").option(
            "checkpointLocation", f"{work}/checkpoint").trigger(**ONCE).start(f"{work}/gaps").awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.parquet(f"{work}/gaps")
