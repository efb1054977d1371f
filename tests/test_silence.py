"""Silence detection: gaps in event time against a plain loop, and a feed that goes silent while nothing else arrives."""

import datetime
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.streaming import metrics

LIMITS = {"a": 60, "b": 600}


def write(spark, folder, rows):
    spark.createDataFrame(rows, "source string, ts timestamp").repartition(3).write.mode("append").parquet(folder)


def gaps_of(spark, folder, out, lateness):
    rows = spark.readStream.schema("source string, ts timestamp").parquet(folder)
    return metrics.silence(rows, LIMITS, lateness).writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint")


def test_spans_hide_no_gap():
    rng = random.Random(2)
    start = pd.Timestamp("2024-01-01")
    times = sorted(start + pd.Timedelta(seconds=rng.randint(0, 20_000)) for _ in range(500))
    frame = pd.DataFrame({"source": "a", "low": times, "high": times})
    got = metrics.spans(metrics.spans(frame.sample(frac=1, random_state=1), LIMITS), LIMITS).sort_values("low")
    limit = pd.Timedelta(seconds=60)
    want = [(p, n) for p, n in zip(times, times[1:]) if n - p > limit]
    highs, lows = list(got["high"]), list(got["low"])
    assert [(p, n) for p, n in zip(highs, lows[1:]) if n - p > limit] == want and len(got) <= 20_000 // 60 + 1


def test_gaps_over_several_micro_batches_equal_a_plain_loop(spark, tmp_path):
    rng = random.Random(4)
    start = datetime.datetime(2024, 1, 1)
    times = {s: [] for s in LIMITS}
    for hour in range(3):
        rows = [(s, start + datetime.timedelta(seconds=hour * 3600 + rng.randint(0, 3000))) for s in "ab" for _ in range(40)]
        rows += [("unwatched", start), (None, start), ("a", None)] + rows[:3]
        rng.shuffle(rows)
        for s, ts in rows:
            if s in times and ts:
                times[s].append(ts)
        write(spark, f"{tmp_path}/in", rows)
        gaps_of(spark, f"{tmp_path}/in", tmp_path, "2 hours").trigger(availableNow=True).start(f"{tmp_path}/gaps").awaitTermination()
    want = set()
    for s, seen in times.items():
        seen.sort()
        want |= {(s, p, n) for p, n in zip(seen, seen[1:]) if (n - p).total_seconds() > LIMITS[s]}
    got = {(r.source, r.silent_since, r.resumed_at) for r in spark.read.parquet(f"{tmp_path}/gaps").where("resumed_at IS NOT NULL").collect()}
    assert got == want


@pytest.mark.parametrize("limit", [3])
def test_an_idle_feed_is_reported_by_the_clock_alone(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setitem(LIMITS, "a", limit)
    now = spark.range(1).select(F.current_timestamp().alias("t")).first().t
    write(spark, f"{tmp_path}/in", [("a", now)])
    running = gaps_of(spark, f"{tmp_path}/in", tmp_path, None).trigger(processingTime="1 second").start(f"{tmp_path}/gaps")
    try:
        found, until = [], time.time() + 90
        while not found and time.time() < until:
            time.sleep(1)
            assert running.exception() is None
            found = spark.read.schema(metrics.GAP_SCHEMA).parquet(f"{tmp_path}/gaps").collect() if list(tmp_path.glob("gaps/*.parquet")) else []
    finally:
        running.stop()
    assert [(r.source, r.silent_since, r.resumed_at) for r in found] == [("a", now, None)]
