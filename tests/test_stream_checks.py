"""The streamed checks: rows are evaluated in passes of their own, none is kept between the outputs."""

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tests.test_facts import claims
from tidewatch.operators import checks, skew
from tidewatch.operators.contracts import CLAIMS
from tidewatch.streaming import checks as stream_checks


def ends(spark):
    # p2 is listed twice, so its rows come twice.
    return spark.sql("SELECT policy_id, cast(policy_end AS date) AS policy_end FROM VALUES ('p1', '2024-02-01'), ('p2', '2024-04-01'), "
                     "('p2', '2024-06-01'), ('p3', NULL), (NULL, '2000-01-01') t(policy_id, policy_end)")


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("known_ends", [True, False])
def test_outputs_are_those_of_one_batch_and_nothing_is_kept(spark, tmp_path, monkeypatch, known_ends):
    def kept(self, *_):
        raise AssertionError("rows are kept")

    limits = []
    def evaluate(batch):  # noqa: E306
        limits.append(batch.sparkSession.conf.get("spark.sql.codegen.hugeMethodLimit"))
        return checks.evaluate(batch, CLAIMS, ["pos"], policy_ends=ends(spark) if known_ends else None, again=True)

    rows = claims(spark).unionByName(claims(spark).where("pos < 2").withColumns({"batch_file": F.lit(None).cast("string"), "pos": F.col("pos") + 100}))
    rows.write.parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    monkeypatch.setattr(DataFrame, "persist", kept)
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    stream_checks.start(stream, CLAIMS, f"{tmp_path}/out", f"{tmp_path}/checkpoint", evaluate, {"availableNow": True}).awaitTermination()
    assert limits == ["8000"] and spark.conf.get("spark.sql.codegen.hugeMethodLimit") == before

    want = checks.evaluate(rows, CLAIMS, ["pos"], policy_ends=ends(spark) if known_ends else None)
    stored = lambda name: spark.read.parquet(f"{tmp_path}/out/{name}")
    good, bad = checks.split(want)
    assert plain(stored("findings").drop("micro_batch")) == plain(checks.findings(want, "claims", CLAIMS.silver))
    assert plain(stored("silver").select("batch_file", "claim_id")) == plain(good.select("batch_file", "t_claim_id"))
    assert plain(stored("quarantine").select("batch_file", "check_name", "reason", F.get_json_object("payload", "$.claim_id"))) == plain(
        bad.select("batch_file", "check_name", "reason", "claim_id"))


def test_rows_read_again_do_not_move(spark, tmp_path):
    """Each pass reads the rows that may have a fact as they were written; no other row is in a join, however few facts there are."""
    spark.range(20000).selectExpr("id AS pos", "CASE WHEN id % 2000 = 1 THEN id - 1 ELSE id END AS k").write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    out = skew.attach(rows, [skew.repeats(rows, ["k"], ["pos"])], again=True)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert out.where(skew.is_repeat(["pos"])).count() == 10 and out.count() == 20000
    # One side of the union tests its rows against the filter, the other reads the written rows.
    assert plan.count("Join LeftOuter") == 1 and "Union" in plan
