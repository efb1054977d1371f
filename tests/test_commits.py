"""Steps over several tables: all or nothing, run again without effect, and only touched buckets written."""

import random

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tests.test_cycle import BILL, CLAIM, KYC, POLICY, TELEMATICS, World
from tidewatch.operators.contracts import CONTRACTS
from tidewatch.plans import cycle
from tidewatch.sources.commits import Commits
from tidewatch.streaming import step

LOGS = {"bronze": "source string, batch_file string, payload string", "findings": cycle.FINDINGS, "quarantine": cycle.QUARANTINE, "registry": cycle.REGISTRY}


@pytest.fixture
def world(spark, tmp_path):
    return World(spark, tmp_path)


def seen(c):
    """All that readers see, without times."""
    out = {n: sorted(map(repr, c.log(n, s).drop("ts", "quarantined_at", "ingested_at", "split", "seq").collect())) for n, s in LOGS.items()}
    return out | {s: sorted(map(repr, cycle.silver_table(c, k).collect())) for s, k in CONTRACTS.items()}


def land(world):
    world.land("telematics", [TELEMATICS, {**TELEMATICS, "speed_kmph": 900}])
    world.land("policy", [POLICY, {**POLICY, "policy_id": "P2", "premium": "-1"}])
    world.land("claims", [CLAIM, {**CLAIM, "claim_id": "CL2", "claim_amount": -5.0}, "no json"])
    world.land("garage_bills", [BILL, {**BILL, "bill_id": "B2", "claim_id": "nobody"}])
    world.land("customer_kyc", [KYC, {**KYC, "customer_id": "C2"}])


def test_a_step_that_fails_at_any_write_leaves_no_trace(world, monkeypatch):
    world.land("customer_kyc", [KYC])
    world.run()
    world.land("customer_kyc", [{**KYC, "customer_id": "C2", "pan": "ZZCDE1234F"}], name="later.csv" if CONTRACTS["customer_kyc"].format == "csv" else "later.json")
    before, real, failing = seen(world.c), {n: getattr(DataFrameWriter, n) for n in ("parquet", "text")}, {"at": 0, "n": 0}

    def broken(name):
        def write(self, path, *a, **b):
            failing["n"] += 1
            if failing["n"] == failing["at"]:
                raise OSError(path)
            return real[name](self, path, *a, **b)
        return write

    for name in real:
        monkeypatch.setattr(DataFrameWriter, name, broken(name))
    writes = 0
    while True:
        failing.update(at=writes + 1, n=0)
        try:
            cycle.load_source(cycle.Cycle(world.spark, str(world.root), 2, "2024-05-01 11:00:00", policy_ends=world.ends), CONTRACTS["customer_kyc"])
            break
        except OSError:
            writes += 1
            assert seen(world.c) == before
    assert writes >= 6 and len(seen(world.c)["customer_kyc"]) == 2


def test_streams_over_five_feeds_equal_the_load_cycle(world, spark, tmp_path):
    land(world)
    world.run()
    want = seen(world.c)
    streamed = World(spark, tmp_path / "streamed")
    land(streamed)
    cycle_of = lambda n: cycle.Cycle(spark, str(streamed.root), n, "2024-05-01 10:01:00", policy_ends=streamed.ends)
    for contract in CONTRACTS.values():
        step.start(cycle_of, contract, str(streamed.root), {"availableNow": True}).awaitTermination()
    assert seen(cycle_of(1)) == want
    lines = spark.createDataFrame([("again.json", 0, 0, "{}")], "batch_file string, split long, seq long, value string")
    assert not cycle.load_lines(cycle_of(0), CONTRACTS["claims"], lines) and seen(cycle_of(1)) == want


def test_upserts_write_touched_buckets_only_and_equal_the_last_arrivals(spark, tmp_path):
    rng, want = random.Random(1), {}
    commits = Commits(spark, str(tmp_path))
    for load in range(5):
        rows = [(rng.randint(0, 400), load * 1000 + i, rng.random()) for i in range(300 if load == 0 else 4)]
        want.update({k: (a, v) for k, a, v in rows})
        before = commits.state()[1].get("t", {})
        commits.upsert(spark.createDataFrame(rows, "k long, arrived long, v double"), "t", ["k"], "arrived", buckets=16)
        commits.commit(f"load {load}")
        after = commits.state()[1]["t"]
        changed = [b for b in after if after[b] != before.get(b)]
        assert load == 0 or 1 <= len(changed) <= 4
        assert {r["k"]: (r["arrived"], r["v"]) for r in commits.current("t").collect()} == want
    commits.replace(commits.current("t").withColumn("v", F.lit(0.0)), "t")
    commits.commit("whole")
    commits.upsert(spark.createDataFrame([(1, 9000, 1.0)], "k long, arrived long, v double"), "t", ["k"], "arrived", buckets=16)
    commits.commit("after whole")
    assert commits.current("t").count() == len(want.keys() | {1}) and commits.current("t").where("v > 0").count() == 1


def test_a_cycle_stamps_its_products_and_its_run(world):
    land(world)
    world.run(build=True)
    first = {r.node: r.last_refreshed for r in cycle.refreshed(world.c).collect()}
    assert set(first) == set(cycle.PRODUCTS)
    world.run(build=True)
    assert all(r.last_refreshed > first[r.node] for r in cycle.refreshed(world.c).collect())
    runs = world.c.log("runs", "ran_at timestamp, files long, n_rows long, failures long, source string").orderBy("ran_at").collect()
    assert [(r.files, r.n_rows) for r in runs] == [(5, 11), (0, 0)] and runs[0].failures > 0
