"""End to end on small literal landing files: each story is one way a feed goes wrong."""

import csv
import json

import pytest

from tidewatch.operators import gold, repair
from tidewatch.operators.contracts import CONTRACTS
from tidewatch.plans import cycle
from tidewatch.plans.cycle import Cycle
from tidewatch.sources import tables

TELEMATICS = {"device_id": "D1", "vehicle_id": "V1", "policy_id": "P1", "timestamp": "2024-05-01T10:00:00+00:00",
              "speed_kmph": 60.5, "harsh_brake": False, "harsh_accel": True, "lat": 19.1, "lon": 72.9, "odometer_km": 1200.0}
POLICY = {"policy_id": "P1", "customer_id": "C1", "vehicle_id": "V1", "reg_no": "007", "make": "Tata", "model": "Nexon",
          "year": "2020", "cover_type": "Comprehensive", "sum_insured": "500000", "premium": "12000.5",
          "start_date": "2024-01-01", "end_date": "2025-01-01", "change_type": "NEW"}
CLAIM = {"claim_id": "CL1", "policy_id": "P1", "vehicle_id": "V1", "accident_date": "2024-04-01",
         "reported_at": "2024-04-02T08:00:00+00:00", "location": "Pune", "claim_type": "Collision", "claim_amount": 1000.0,
         "status": "OPEN", "garage_id": "G1"}
BILL = {"bill_id": "B1", "claim_id": "CL1", "garage_id": "G1", "parts_cost": "100", "labour_cost": "50", "total": "150",
        "invoice_date": "2024-04-10"}
KYC = {"customer_id": "C1", "name": "Asha Rao", "phone": "+919876543210", "email": "asha@mail.in", "licence_no": "MH1220190001234",
       "pan": "ABCDE1234F", "address": "1 Hill Road", "dob": "1990-02-03", "city": "Pune", "updated_at": "2024-05-01T00:00:00+00:00"}


class World:
    def __init__(self, spark, root):
        self.spark, self.root, self.n = spark, root, 0
        self.mappings = {}
        self.ends = spark.sql("SELECT 'P1' AS policy_id, DATE'2025-01-01' AS policy_end")

    def land(self, source, rows, columns=None, name=None):
        contract = CONTRACTS[source]
        folder = self.root / "landing" / source
        folder.mkdir(parents=True, exist_ok=True)
        path = folder / (name or f"{source}_{self.n:04d}.{contract.format}")
        with open(path, "w", newline="", encoding="utf-8") as f:
            if contract.format == "json":
                f.writelines((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows)
            else:
                w = csv.DictWriter(f, fieldnames=columns or list(rows[0]))
                w.writeheader()
                w.writerows(rows)

    def run(self, build=False, **options):
        self.n += 1
        self.c = Cycle(self.spark, str(self.root), self.n, f"2024-05-01 10:{self.n:02d}:00", mappings=self.mappings,
                       policy_ends=self.ends, **options)
        return cycle.run(self.c) if build else cycle.load(self.c)

    def quarantine(self):
        return [(r.source, r.check_name, r.reason) for r in self.c.log("quarantine", cycle.QUARANTINE).collect()]

    def silver(self, source):
        return cycle.silver_table(self.c, CONTRACTS[source]).collect()

    def alerts(self):
        return {(r.source, r.check_name): r for r in cycle.alert_table(self.c).collect()}


@pytest.fixture
def world(spark, tmp_path):
    return World(spark, tmp_path)


def test_clean_files_raise_nothing_and_a_second_run_adds_nothing(world):
    world.land("telematics", [TELEMATICS, {**TELEMATICS, "device_id": "D2"}])
    world.land("policy", [POLICY])
    world.land("claims", [CLAIM])
    world.land("garage_bills", [BILL])
    world.land("customer_kyc", [KYC])
    world.land("claims", [CLAIM], name="_claims_half_written.json")
    assert set(world.run(build=True)) == set(cycle.PRODUCTS)
    assert world.quarantine() == [] and world.alerts() == {}
    assert [r.reg_no for r in world.silver("policy")] == ["007"]
    customer = world.silver("customer_kyc")[0]
    assert (customer.name, customer.pan, customer.dob, customer.masked) == ("A*** R***", "*****1234*", "1990-**-**", 1)
    score = world.c.current("gold_driver_risk_score").collect()
    assert [(r.vehicle_id, r.readings, r.harsh_events_pct, r.risk_score_safe_100) for r in score] == [("V1", 2, 100.0, 0.0)]
    assert world.c.current("gold_claims_summary").first().total_amount_inr == 1000.0
    world.run()
    assert len(world.silver("telematics")) == 2
    assert world.c.log("registry", cycle.REGISTRY).count() == 5
    assert world.c.log("bronze", "source string").count() == 6


def test_every_row_check_stops_its_fault(world):
    world.land("telematics", [TELEMATICS, TELEMATICS, {**TELEMATICS, "device_id": "D3", "speed_kmph": 400, "lat": 999}])
    world.land("policy", [POLICY, {**POLICY, "policy_id": "P2", "end_date": "2023-12-31"}, {**POLICY, "policy_id": "P3", "vehicle_id": ""}])
    world.land("claims", [CLAIM, {**CLAIM, "claim_id": "CL2", "claim_amount": None, "vehicle_id": "V2"},
                          {**CLAIM, "claim_id": "CL3", "claim_amount": -5.0, "vehicle_id": "V3"}, {**CLAIM, "claim_id": "CL4"},
                          {**CLAIM, "claim_id": "CL5", "vehicle_id": "V5", "accident_date": "2025-02-01"},
                          {**CLAIM, "claim_id": "CL6", "vehicle_id": "V6", "accident_date": "soon"}])
    world.land("garage_bills", [BILL, {**BILL, "bill_id": "B2", "total": "300"}, {**BILL, "bill_id": "B3", "claim_id": "CL99"},
                                {**BILL, "bill_id": "B4", "claim_id": "CL3"}])
    world.land("customer_kyc", [KYC, {**KYC, "customer_id": "C2"}, {**KYC, "customer_id": "C3", "pan": "ABCDE-1234"}])
    world.run()
    assert sorted(world.quarantine()) == sorted([
        ("telematics", "duplicates", "duplicate record for D1"),
        ("telematics", "range", "speed_kmph=400.0 above 220; lat=999.0 above 37"),
        ("policy", "rule", "end_date 2023-12-31 before start_date 2024-01-01"),
        ("policy", "nulls", "vehicle_id is empty"),
        ("claims", "nulls", "claim_amount is empty"),
        ("claims", "range", "claim_amount=-5.0 below 1"),
        ("claims", "duplicates", "duplicate record for V1"),
        ("claims", "referential", "policy P1 expired on 2025-01-01"),
        ("claims", "type", "accident_date='soon' is not date"),
        ("garage_bills", "reconciliation", "total 300.0 != parts + labour 150.0"),
        ("garage_bills", "referential", "claim CL99 does not exist"),
        ("customer_kyc", "duplicates", "PAN already registered to C1"),
        ("customer_kyc", "format", "pan=ABCD... wrong format"),
    ])
    t = cycle.CONTRACTS
    fraud = gold.fraud_watchlist(cycle.silver_table(world.c, t["garage_bills"]), cycle.silver_table(world.c, t["claims"]),
                                 cycle.quarantine_json(world.c)).collect()
    assert [(r.claim_id, r.flag) for r in fraud] == [("CL4", "Duplicate claim stopped by checks")]
    alerts = world.alerts()
    assert alerts[("telematics", "range")].problem == "2 of 3 rows failed range: lat=999.0 above 37; speed_kmph=400.0 above 220"
    payload = {json.loads(r.payload)["customer_id"]: json.loads(r.payload) for r in cycle.quarantine_json(world.c).where(
        "source = 'customer_kyc'").collect()}
    assert payload["C2"]["phone"] == "+91******3210" and payload["C2"]["pan"] == "*****1234*"
    assert (payload["C3"]["pan"], payload["C3"]["name"]) == ("*****-123*", "A*** R***")


def test_owner_of_a_pan_is_remembered_across_files(world):
    world.land("customer_kyc", [KYC])
    world.run()
    world.land("customer_kyc", [{**KYC, "customer_id": "C9"}, KYC])
    world.run()
    assert world.quarantine() == [("customer_kyc", "duplicates", "PAN already registered to C1")]
    buckets = world.c.commits.state()[1]["pan_owner"]
    world.land("customer_kyc", [{**KYC, "customer_id": "C9"}, {**KYC, "customer_id": "C8", "pan": "QQQQQ1111Q"}])
    world.run()
    after = world.c.commits.state()[1]["pan_owner"]
    assert len([b for b in after if after[b] != buckets.get(b)]) == 1  # only the new number was written
    assert {(r.pan, r.customer_id) for r in world.c.current("pan_owner").collect()} >= {("ABCDE1234F", "C1"), ("QQQQQ1111Q", "C8")}


def test_expired_token_fail_open_blocks_until_remasked(world):
    world.land("customer_kyc", [KYC])
    world.run(build=True)
    world.land("customer_kyc", [{**KYC, "customer_id": "C2", "pan": "ZZZZZ9999Z"}])
    built = world.run(build=True, token_status="expired", fail_open=True)
    assert sorted(set(cycle.PRODUCTS) - set(built)) == ["gold_compliance_report", "gold_customer_360"]
    assert world.c.current("gold_customer_360").count() == 1  # last good copy
    assert sum(r.masked == 0 for r in world.silver("customer_kyc")) == 1
    assert cycle.remask(world.c)
    assert set(world.run(build=True)) == set(cycle.PRODUCTS)
    assert world.c.current("gold_customer_360").count() == 2
    assert {r.control: r.status for r in world.c.current("gold_compliance_report").collect()}["PII masked in customer data"] == "PASS"


def test_expired_token_fails_closed_by_default(world):
    world.land("customer_kyc", [KYC])
    world.run(token_status="expired")
    assert world.silver("customer_kyc") == []
    assert world.quarantine() == [("customer_kyc", "pii", "masking not available")]


def test_rows_held_for_an_expired_token_raise_an_alert_and_are_released_once(world):
    world.land("customer_kyc", [KYC])
    world.run(token_status="expired")
    alert = world.alerts()[("customer_kyc", "pii")]
    assert (alert.severity, alert.problem) == ("CRITICAL", "1 of 1 rows held: masking not available")
    world.land("customer_kyc", [{**KYC, "city": "Nagpur"}])
    world.run()
    for _ in range(2):
        cycle.reload_quarantine(world.c, "customer_kyc")
    rows = world.silver("customer_kyc")
    assert [(r.customer_id, r.city, r.masked, r.name) for r in rows] == [("C1", "Nagpur", 1, "A*** R***")]
    assert world.c.log("released", cycle.RELEASED).count() == 1


def test_second_replay_changes_nothing_and_newer_rows_stay(world):
    drifted = {("vehicle_ref" if k == "vehicle_id" else k): v for k, v in TELEMATICS.items()}
    world.land("telematics", [drifted])
    world.land("policy", [{("vehicle_ref" if k == "vehicle_id" else k): v for k, v in POLICY.items()}])
    world.run()
    world.land("policy", [{**POLICY, "premium": "99999.0"}])
    world.mappings = {s: {"vehicle_ref": "vehicle_id"} for s in ("telematics", "policy")}
    world.run()
    for _ in range(2):
        cycle.reload_quarantine(world.c, "telematics")
        cycle.reload_quarantine(world.c, "policy")
        world.n += 1
        world.c = Cycle(world.spark, str(world.root), world.n, "2024-05-01 11:00:00", mappings=world.mappings, policy_ends=world.ends)
    assert len(world.silver("telematics")) == 1
    assert [r.premium for r in world.silver("policy")] == [99999.0]


def test_amounts_that_are_no_usable_number_are_held_and_gold_still_builds(world):
    world.land("claims", [CLAIM, {**CLAIM, "claim_id": "CL2", "vehicle_id": "V2", "claim_amount": 1e30}, {**CLAIM, "claim_id": "CL3", "vehicle_id": "V3", "claim_amount": "inf"}])
    world.run(build=True)
    assert [q[:2] for q in world.quarantine()] == [("claims", "type")] * 2
    assert world.c.current("gold_claims_summary").first().total_amount_inr == 1000.0


def test_of_a_repeated_csv_column_the_last_counts(world):
    folder = world.root / "landing" / "policy"
    folder.mkdir(parents=True)
    names = [*POLICY, "premium"]
    (folder / "policy_1.csv").write_text(",".join(names) + "\n" + ",".join([*POLICY.values(), "777"]) + "\n")
    world.run()
    assert [r.premium for r in world.silver("policy")] == [777.0]


def test_a_pointer_that_was_not_written_leaves_the_last_copy_current(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    tables.replace(spark.range(3), root, "t")

    def fail(*_):
        raise OSError("disk full")

    with monkeypatch.context() as m:
        m.setattr(tables, "point", fail)
        with pytest.raises(OSError):
            tables.replace(spark.range(9), root, "t")
    assert tables.current(spark, root, "t").count() == 3
    (tmp_path / "t.pointers" / "version=2" / "_temporary").mkdir(parents=True)  # a write cut off half-way
    assert tables.current(spark, root, "t").count() == 3
    tables.replace(spark.range(5), root, "t")
    assert tables.current(spark, root, "t").count() == 5 and tables.current(spark, root, "never") is None


def test_schema_drift_is_held_then_mapped_and_reloaded(spark, world):
    drifted = {("vehicle_ref" if k == "vehicle_id" else k): v for k, v in POLICY.items()} | {"sales_channel": "web"}
    world.land("policy", [POLICY], name="policy_a.csv")
    world.land("policy", [{**drifted, "policy_id": "P2"}, {**drifted, "policy_id": "P3", "premium": "0"}], name="policy_b.csv")
    world.run()
    assert world.quarantine() == [("policy", "schema", "missing column vehicle_id")] * 2
    problem = world.alerts()[("policy", "schema")].problem
    assert problem == "Columns changed: missing vehicle_id; new vehicle_ref, sales_channel"
    drift = spark.createDataFrame([("policy", ["vehicle_id"], ["vehicle_ref", "sales_channel"])],
                                  "source string, missing array<string>, extra array<string>")
    assert repair.suggest_mapping(drift).first()[:] == ("policy", "vehicle_ref->vehicle_id", "sales_channel")
    world.mappings = {"policy": {"vehicle_ref": "vehicle_id", "sales_channel": ""}}
    world.run()
    cycle.reload_quarantine(world.c, "policy")
    assert sorted(r.policy_id for r in world.silver("policy")) == ["P1", "P2"]
    world.land("policy", [{**drifted, "policy_id": "P4"}], name="policy_c.csv")
    world.run()
    assert sorted(r.policy_id for r in world.silver("policy")) == ["P1", "P2", "P4"]
    assert len(world.quarantine()) == 2


def test_empty_file_and_unreadable_line(world):
    world.land("claims", [], name="claims_empty.json")
    world.land("telematics", [TELEMATICS, "{not json", "[1, 2]"])
    world.run()
    assert world.alerts()[("claims", "schema")].problem.startswith("Columns changed: missing claim_id, policy_id")
    assert [q[:2] for q in world.quarantine()] == [("telematics", "type")] * 2
    assert len(world.silver("telematics")) == 1


def test_alerts_advanced_by_cycle_equal_the_fold_over_the_whole_log(world, tmp_path):
    """Failures that stop, come back soon, come back late and overlap; one cycle without a watch; one watch repeated."""
    import random
    rng = random.Random(5)
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text(json.dumps({
        "ts": "2024-05-01T10:01:00+00:00", "source": "claims", "level": "ERROR", "message": "feed refused"}) + "\n")
    for n in range(1, 9):
        for source, row, faults in (("claims", CLAIM, {"claim_amount": -5, "claim_type": "Meteor"}), ("telematics", TELEMATICS, {"lat": 99})):
            for k in range(rng.randint(0, 2)):
                bad = {c: v for c, v in faults.items() if rng.random() < 0.4}
                world.land(source, [{**row, **bad}], name=f"{source}_{n}_{k}.json")
        world.run()
        if n != 4:
            assert cycle.watch(world.c)
    assert not cycle.watch(world.c)
    plain = lambda rows, names: sorted(tuple(str(r[x]) for x in names) for r in rows)
    whole = cycle.alert_table(world.c)
    stored = world.c.current("alerts")
    assert len({r.status for r in stored.collect()}) == 2 and stored.count() > 3
    assert plain(stored.collect(), whole.columns) == plain(whole.collect(), whole.columns)
    rolled = world.c.current("incidents").collect()
    assert sum(r.alerts for r in rolled) == stored.count()
    causes = world.c.current("causes").collect()
    assert {r.incident_id for r in causes} == {r.incident_id for r in rolled} and all(r.fix_action for r in causes)
    assert {r.message for r in world.c.current("evidence").collect()} == {"feed refused"}


def test_a_watch_that_failed_leaves_no_trace_and_is_caught_up_with(world, monkeypatch):
    world.land("claims", [{**CLAIM, "claim_amount": -5}])
    world.run()
    with monkeypatch.context() as m:
        m.setattr(cycle.incidents, "fix_lookup", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            cycle.watch(world.c)
    assert world.c.current("alerts") is None and world.c.current("batch_counts") is None
    world.run()
    assert cycle.watch(world.c)
    assert [(r.check_name, r.status, r.occurrences) for r in world.c.current("alerts").collect()] == [("range", "OPEN", 1)]


def test_leaks_and_silence_stand_as_alerts_until_they_are_gone(world):
    """Readable personal data in Silver and a feed without files: raised once, extended, resolved, raised anew; batches do not clear them."""
    def alerts():
        return [(r.check_name, r.episode, r.status, r.occurrences, r.severity, r.node) for r in world.c.current("alerts").orderBy("check_name", "episode").collect()]

    watched = {"intervals": {"customer_kyc": 10, "policy": 3600, "claims": 10}}
    world.land("customer_kyc", [KYC])
    world.land("policy", [POLICY])
    world.run(build=True, token_status="expired", fail_open=True, **watched)
    leak = ("pii", 1, "OPEN", 1, "CRITICAL", "mask_pii")
    assert alerts() == [leak]
    assert [(r.source, r.severity) for r in world.c.current("incidents").collect()] == [("customer_kyc", "CRITICAL")]
    world.run(build=True, **watched)
    silent = ("freshness", 1, "OPEN", 1, "HIGH", "src_customer_kyc")
    assert alerts() == [silent, ("pii", 1, "OPEN", 2, "CRITICAL", "mask_pii")]
    assert cycle.remask(world.c)
    world.land("customer_kyc", [{**KYC, "customer_id": "C2", "pan": "ZZCDE1234F"}])
    world.run(build=True, **watched)
    gone = [("freshness", 1, "RESOLVED", 1, "HIGH", "src_customer_kyc"), ("pii", 1, "RESOLVED", 2, "CRITICAL", "mask_pii")]
    assert alerts() == gone
    world.run(build=True, **watched)
    assert alerts() == [gone[0], ("freshness", 2, "OPEN", 1, "HIGH", "src_customer_kyc"), gone[1]]
    assert "unmasked_rows" in world.c.current("alerts").where("check_name = 'pii'").first().detail
