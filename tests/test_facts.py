"""Facts about few keys: rows that cannot have one stay where they are, and all others get what a plain join gives."""

import pytest

from tidewatch.operators import checks, skew
from tidewatch.operators.contracts import CLAIMS, GARAGE_BILLS


@pytest.fixture(params=[0, 10**9], ids=["filtered", "plain"])
def plain_keys(request, monkeypatch):
    monkeypatch.setattr(skew, "PLAIN_KEYS", request.param)
    return request.param


def claims(spark):
    def row(pos, policy, vehicle, day, amount="5.0", kind="Theft"):
        return (f"f{pos % 2}", pos, f"c{pos}", policy, vehicle, day, f"{day} 10:00:00" if day else "", "x", kind, amount, "open", "g")
    return spark.createDataFrame([
        row(0, "p1", "v1", "2024-01-02"), row(2, "p1", "v1", "2024-01-02"), row(4, "p1", "v1", "2024-03-02"),
        row(6, "p2", "v2", "2024-05-01"), row(8, "p2", "v2", ""), row(10, "", "v3", "2024-05-01", "0.0"), row(12, None, "v3", "2024-05-01", "-0.0"),
        row(14, "p3", None, "2024-05-01"), row(16, "p3", None, "2024-05-01"), row(1, "p3", None, "2024-05-01"), row(3, "unknown", "v9", "2024-05-01"),
    ], "batch_file string, pos bigint, " + ", ".join(f"{c} string" for c in CLAIMS.columns))


def test_claims_get_ends_and_repeats(spark, plain_keys):
    # p2 is listed twice, so its rows come twice; p3 has no end; p1 ended in February.
    ends = spark.sql("SELECT policy_id, cast(policy_end AS date) AS policy_end FROM VALUES ('p1', '2024-02-01'), ('p2', '2024-04-01'), "
                     "('p2', '2024-06-01'), ('p3', NULL), (NULL, '2000-01-01') t(policy_id, policy_end)")
    out = checks.evaluate(claims(spark), CLAIMS, ["pos"], policy_ends=ends)
    got = sorted((r.pos, ",".join(x.check for x in r.reasons if x.check in ("referential", "duplicates"))) for r in out.collect())
    assert got == [(0, ""), (1, ""), (2, "duplicates"), (3, ""), (4, "referential"), (6, ""), (6, "referential"), (8, ""), (8, ""),
                   (10, ""), (12, "duplicates"), (14, ""), (16, "duplicates")]
    assert out.columns == [*claims(spark).columns, *[f"t_{c}" for c in CLAIMS.columns], checks.NUMBER, "reasons", "failed"]


def test_bills_of_unknown_claims(spark, plain_keys):
    row = lambda pos, claim: ("f", pos, f"b{pos}", claim, "g", "1.0", "2.0", "3.0", "2024-01-01")
    bills = spark.createDataFrame([row(0, "c1"), row(1, "gone"), row(2, "gone"), row(3, ""), row(4, None)],
                                  "batch_file string, pos bigint, " + ", ".join(f"{c} string" for c in GARAGE_BILLS.columns))
    known = spark.createDataFrame([("c1",), ("c1",), (None,)], "claim_id string")
    out = checks.evaluate(bills, GARAGE_BILLS, ["pos"], known_claims=known)
    assert {r.pos: [x.check for x in r.reasons] for r in out.collect()} == {0: [], 1: ["referential"], 2: ["referential"], 3: ["nulls"], 4: ["nulls"]}


def test_rows_without_facts_do_not_move(spark, monkeypatch):
    """Of 20,000 rows, those of ten repeated keys (and what the filter cannot tell) are all that the join takes."""
    monkeypatch.setattr(skew, "PLAIN_KEYS", 0)
    rows = spark.range(20000).selectExpr("id AS pos", "CASE WHEN id % 2000 = 1 THEN id - 1 ELSE id END AS k")
    table = skew.repeats(rows, ["k"], ["pos"])
    assert table.n_keys == 10
    near = skew._tested(rows, ["k"], table.table, table.n_keys, "may").where("may")
    assert 20 <= near.count() < 100
    assert skew.mark_repeats(rows, ["k"], ["pos"], "again").where("again").count() == 10


def test_exploded_reasons_are_worked_out_once(spark):
    """The filter that Spark infers for an explode stays above the rules, which are typed and listed once."""
    from pyspark.sql import functions as F

    checked = checks.evaluate(claims(spark), CLAIMS, ["pos"])
    plan = checks.settled(checked).select("batch_file", F.explode("reasons").alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_compact") + plan.count("filter(array(") <= 1


@pytest.mark.parametrize("hot", [0, 10**9], ids=["hot", "plain"])
def test_missing_keys_without_a_table_of_all_keys(spark, monkeypatch, hot):
    """Absent keys come once each, with hot keys combined first or not; no task holds all keys of its rows."""
    monkeypatch.setattr(skew, "HOT_ROWS", hot)
    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN NULL ELSE concat('k', id) END AS k")
    known = spark.range(2000).selectExpr("CASE WHEN id % 2 = 0 THEN 'known' ELSE concat('k', id) END AS k").unionByName(spark.sql("SELECT NULL AS k"))
    table = skew.missing(rows, "k", known, "gone")
    want = {"hot"} | {f"k{i}" for i in range(2, 3000, 3) if i % 2 == 0 or i >= 2000}
    assert sorted(r.k for r in table.table.collect()) == sorted(want) and table.n_keys == len(want)
    plan = skew.thinned(rows, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert ("Aggregate" in plan) == (hot == 0)


def test_newest_moves_repeated_keys_only(spark, monkeypatch):
    from tidewatch.operators import silver

    monkeypatch.setattr(skew, "PLAIN_KEYS", 0)
    rows = spark.range(20000).selectExpr("id AS pos", "CASE WHEN id >= 19980 THEN NULL WHEN id % 2000 = 1 THEN id - 1 ELSE id END AS k", "id % 7 AS v")
    once, more = skew.apart(rows, ["k"])
    assert 40 <= more.count() < 120 and once.count() + more.count() == 20000
    got = silver.newest(rows, ["k"], ["pos"])
    assert got.columns == ["pos", "k", "v"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, silver.latest(rows, ["k"], ["pos"]).collect()))
