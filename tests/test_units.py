"""Small literal inputs and property tests for the helpers and folds."""

import csv
import datetime
import io
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.functions import masking
from tidewatch.functions.typing import coerce
from tidewatch.operators import alerts, batches, checks, incidents, lineage, silver, skew
from tidewatch.operators.contracts import CONTRACTS, TELEMATICS
from tidewatch.operators.repair import suggest_mapping
from tidewatch.operators.sequence import scan
from tidewatch.sources import landing


def test_typing(spark):
    texts = ["1.5", "-2", "+3e2", " 7 ", "1_000", "12d", "0x1p3", "NaN", "abc", "", "2020.7", "inf"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = {r.t: r for r in df.select("t", coerce(F.col("t"), "double").alias("d"), coerce(F.col("t"), "int").alias("i")).collect()}
    assert {t: rows[t].d for t in texts} == {
        "1.5": 1.5, "-2": -2.0, "+3e2": 300.0, " 7 ": 7.0, "1_000": None, "12d": None, "0x1p3": None, "NaN": None,
        "abc": None, "": None, "2020.7": 2020.7, "inf": None}
    assert (rows["2020.7"].i, rows["inf"].i) == (2020, None)
    days = ["2024-02-29", "2023-02-29", "2024-1-1", "2024", "20240101", "2024-01-01T10:00:00+00:00", "2024-01-01 "]
    got = spark.createDataFrame([(t,) for t in days], "t string").select(
        coerce(F.col("t"), "date").cast("string").alias("d"), coerce(F.col("t"), "timestamp").cast("string").alias("ts")).collect()
    assert [r.d for r in got] == ["2024-02-29"] + [None] * 6
    assert got[5].ts == "2024-01-01 10:00:00" and got[3].ts is None
    flags = spark.createDataFrame([("True",), ("1",), ("yes",), ("false",), ("",)], "t string").select(
        coerce(F.col("t"), "boolean").alias("b")).collect()
    assert [r.b for r in flags] == [True, True, False, False, None]


EXAMPLES = [
    ("name", "Asha Rao", "A*** R***"), ("name", "  Li  ", "L***"),
    ("phone", "+919876543210", "+91******3210"), ("email", "asha@mail.in", "a***@mail.in"), ("email", "no-at", "***"),
    ("pan", "ABCDE1234F", "*****1234*"), ("pan", "short", "**********"), ("licence_no", "MH1220190001234", "MH12***********"),
    ("licence_no", "MH", "MH"), ("address", "1 Hill Road", "*** (masked)"), ("dob", "1990-02-03", "1990-**-**"),
]


@pytest.mark.parametrize("column,shown,masked", EXAMPLES)
def test_mask_examples(spark, column, shown, masked):
    df = spark.createDataFrame([(shown,)], "v string").select(masking.POLICIES[column](F.col("v")).alias("m"))
    assert df.first()["m"] == masked


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("aZ9 @.-\té", min_size=11, max_size=14), min_size=10, max_size=40))
def test_masks_hide_the_middle(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    out = df.select("v", *[p(F.col("v")).alias(c) for c, p in masking.POLICIES.items()]).collect()
    for r in out:
        assert r["phone"].startswith(r.v[:3]) and r["phone"].endswith(r.v[-4:]) and r.v[3:-4] not in ("", r["phone"][3:-4])
        assert len(r["licence_no"]) == len(r.v) and set(r["licence_no"][4:]) == {"*"}
        assert r["dob"][4:] == "-**-**" and "*" in r["email"] and set(r["pan"]) == {"*"}


def test_masked_rows_pass_the_scan_and_null_stays_null(spark):
    df = spark.createDataFrame([("c1", "+919876543210", "ABCDE1234F", 0), ("c2", None, None, 0)],
                               "customer_id string, phone string, pan string, masked int")
    assert checks.scan_pii(df).count() == 2
    clean = silver.remask(df)
    assert checks.scan_pii(clean).count() == 0
    assert clean.where("customer_id = 'c2'").first().phone is None


def test_payload_mask_hides_renamed_personal_columns(spark):
    df = spark.createDataFrame([({"phone": "+919876543210", "mobile": "+919876543210", "city": "Pune"},)], "p map<string,string>")
    out = df.select(masking.mask_payload(F.col("p"), CONTRACTS["customer_kyc"].columns).alias("p")).first().p
    assert out == {"phone": "+91******3210", "mobile": "*** (masked)", "city": "Pune"}


def test_mark_repeats_with_one_key_holding_most_rows(spark):
    rng = random.Random(7)
    rows = [(i, "hot" if i % 3 else rng.choice("abcdefgh"), rng.choice([None, 1])) for i in range(600)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "pos long, k string, n int").repartition(4)
    got = {r.pos for r in skew.mark_repeats(df, ["k", "n"], ["pos"], "rep").where("rep").collect()}
    seen, want = set(), set()
    for pos, k, n in sorted(rows):
        (want.add(pos) if (k, n) in seen else seen.add((k, n)))
    assert got == want


def test_first_owner_and_missing_reference(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["p1", "p2", "p3", None]), rng.choice("xyz")) for i in range(300)]
    df = spark.createDataFrame(rows, "pos long, pan string, owner string")
    got = {r.pos: r.first for r in skew.attach_first_owner(df, "pan", "owner", ["pos"], "first").collect()}
    first = {}
    for _, pan, owner in rows:
        first.setdefault(pan, owner)
    assert got == {pos: (first[pan] if pan else None) for pos, pan, _ in rows}
    known = spark.createDataFrame([("p1",), ("p1",), (None,)], "pan string")
    out = {r.pos: r.gone for r in skew.mark_missing(df, "pan", known, "gone").collect()}
    assert out == {pos: pan in ("p2", "p3") for pos, pan, _ in rows}


def test_scan_equals_a_plain_loop(spark):
    rng = random.Random(11)
    rows = [(s, i, i // 7, rng.randint(0, 50)) for s in ("a", "b") for i in range(60) if rng.random() < 0.6]
    df = spark.createDataFrame(rows, "s string, i long, bucket long, v long").repartition(3)
    out = scan(df, ["s"], "bucket", ["i"], {"n": ("ordinal", None), "prev": ("previous", F.col("v")),
                                            "total": ("running_sum", F.col("v")), "top": ("prior_max", F.col("v"))})
    got = {(r.s, r.i): (r.n, r.prev, r.total, r.top) for r in out.collect()}
    want = {}
    for s in ("a", "b"):
        vals = []
        for _, i, _, v in sorted(r for r in rows if r[0] == s):
            vals.append(v)
            want[(s, i)] = (len(vals), vals[-2] if len(vals) > 1 else None, sum(vals), max(vals[:-1], default=None))
    assert got == want


def test_alert_episodes_equal_the_sequential_rule(spark):
    """Open on a failure, bump while open, close after two clean batches in a row."""
    rng = random.Random(5)
    batches_, failures, want = [], [], set()
    for s in range(6):
        opened = clean = None
        for b in range(1, 41):
            ts = f"2024-01-{1 + b // 4:02d} {b % 4:02d}:00:00"
            batches_.append((f"s{s}", b, ts))
            if rng.random() < 0.35:
                failures.append((f"s{s}", "range", b, ts))
                opened, clean = (opened or [b, b, 0]), 0
                opened[1], opened[2] = b, opened[2] + 1
            elif opened:
                clean += 1
                if clean == 2:
                    want.add((f"s{s}", opened[0], opened[1], opened[2], "RESOLVED"))
                    opened = None
        if opened:
            want.add((f"s{s}", opened[0], opened[1], opened[2], "OPEN"))
    cast = lambda rows, schema: spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    log = cast(batches_, "source string, batch_no long, ts string")
    out = alerts.episodes(cast(failures, "source string, check_name string, batch_no long, ts string"), log)
    number = {(s, ts): b for s, b, ts in batches_}
    got = {(r.source, number[(r.source, str(r.first_seen))], number[(r.source, str(r.last_seen))], r.occurrences, r.status)
           for r in out.collect()}
    assert got == want


def test_repair_cuts_an_alert_and_decisions_hold_incidents_open(spark):
    t = lambda h: f"2024-01-01 {h:02d}:00:00"
    ts = F.col("ts").cast("timestamp")
    log = spark.createDataFrame([("s", b, t(b)) for b in range(1, 9)], "source string, batch_no long, ts string").withColumn("ts", ts)
    failed = spark.createDataFrame([("s", "schema", b, t(b)) for b in (1, 2, 4)],
                                   "source string, check_name string, batch_no long, ts string").withColumn("ts", ts)
    fixed = spark.createDataFrame([("s", "schema", "2024-01-01 02:30:00")], "source string, check_name string, ts string").withColumn("ts", ts)
    out = alerts.episodes(failed, log, repairs=fixed).orderBy("episode").collect()
    assert [(r.occurrences, r.status, str(r.resolved_at)) for r in out] == [
        (2, "RESOLVED", "2024-01-01 02:30:00"), (1, "RESOLVED", t(6))]
    table = spark.createDataFrame([("s", "range", "MEDIUM", t(1), t(2), "a"), ("s", "type", "HIGH", t(4), t(5), "b")],
                                  "source string, check_name string, severity string, first_seen string, resolved_at string, problem string")
    table = table.withColumns({c: F.col(c).cast("timestamp") for c in ("first_seen", "resolved_at")})
    assert [r.incident_id for r in incidents.rollup(table).orderBy("opened_at").collect()] == ["INC-0001", "INC-0002"]
    none = spark.createDataFrame([], "source string, check_name string, first_seen timestamp, outcome string, decided_at timestamp")
    kept = incidents.rollup(table, none).collect()
    assert [(r.status, r.severity, r.alerts) for r in kept] == [("OPEN", "HIGH", 2)]


@pytest.mark.parametrize("checks_, logs, category", [
    (["pii"], ["Vault returned 403"], "expired_credential"), (["pii"], [], "bad_source_values"),
    (["schema", "range"], [], "schema_change"), (["freshness"], ["broker timed out"], "delayed_delivery"),
    (["freshness"], [], "source_outage"), (["duplicates", "range"], [], "duplicate_records"),
    (["referential"], [], "referential_break"), (["format"], ["x"], "bad_source_values")])
def test_root_cause_priorities(spark, checks_, logs, category):
    linked = spark.createDataFrame([("I", "s", c, "p", "2024-01-01") for c in checks_],
                                   "incident_id string, source string, check_name string, problem string, first_seen string")
    lines = spark.createDataFrame([("I", "2024-01-01", "ERROR", m) for m in logs], "incident_id string, ts string, level string, message string")
    row = incidents.fix_lookup(incidents.root_cause(linked, lines)).first()
    assert (row.category, row.confidence) == (category, 0.7 if logs else 0.55)
    assert row.fix_action == incidents.PLAYBOOK[category]


def test_cyclic_lineage_ends(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = {(r.start, r.node) for r in lineage.downstream(spark.createDataFrame([("a",), ("d",)], "start string"), edges).collect()}
    assert got == {("a", "b"), ("a", "c"), ("a", "a"), ("a", "d")}


def test_mapping_suggestion_and_collisions(spark):
    drift = spark.createDataFrame([("a", ["vehicle_id"], ["vehicle_ref", "sales_channel"]), ("b", ["abc"], ["xyz"]), ("c", ["x1", "x2"], ["x3"]),
                                   ("d", [], ["n"]), ("e", ["m"], [])], "source string, missing array<string>, extra array<string>")
    assert sorted(r[:] for r in suggest_mapping(drift).collect()) == [
        ("a", "vehicle_ref->vehicle_id", "sales_channel"), ("b", "", "xyz"), ("c", "x3->x1", ""), ("d", "", "n"), ("e", "", "")]
    df = spark.createDataFrame([({"a": "1", "b": "2", "c": "3"},)], "p map<string,string>")
    assert df.select(batches.map_columns(F.col("p"), {"b": "a"}, ["c"]).alias("p")).first().p == {"a": "2"}
    rows = spark.createDataFrame([("s", {"x": "1", "y": "2"}), ("t", {"x": "1"})], "source string, payload map<string,string>")
    stored = spark.createDataFrame([("s", "x", "z"), ("s", "y", "")], "source string, from_col string, to_col string")
    assert {r.source: r.payload for r in batches.apply_mappings(rows, stored).collect()} == {"s": {"z": "1"}, "t": {"x": "1"}}


def test_csv_files_with_different_headers_do_not_mix(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n007,"x, y"\n1.50,\n')
    (tmp_path / "b.csv").write_text("a,z\n1,2\n1,2,3\n")
    rows = landing.read_csv(spark, str(tmp_path)).orderBy("batch_file", "seq").collect()
    assert [(r.payload, r.malformed) for r in rows] == [
        ({"a": "007", "b": "x, y"}, None), ({"a": "1.50", "b": ""}, None), ({"a": "1", "z": "2"}, None), (None, "1,2,3")]


def test_cells_equal_the_standard_reader(spark):
    rng = random.Random(23)
    cell = lambda: "".join(rng.choice('ab ,"\\é') for _ in range(rng.randint(0, 5)))
    rows = [[cell() for _ in range(rng.randint(1, 6))] for _ in range(400)] + [[""], ["", ""], ["x" * 100_000, 'q"' * 20_000]]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    lines = out.getvalue().split("\n")[:-1] + ["a,b\r", ",", '"",', 'a"b,c']
    got = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string").select("i", landing.split_cells(F.col("t")).alias("c"))
    want = [next(csv.reader([t.rstrip("\r")])) if t else [""] for t in lines]
    assert [r.c for r in got.orderBy("i").collect()] == want


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["D1", "D2", ""]), st.sampled_from(["10", "400", "x", ""]),
                          st.sampled_from(["10", "99"])), min_size=1, max_size=25))
def test_good_and_bad_rows_add_up(spark, cells):
    rows = [(i, "f", d, "v", "p", "2024-01-01 00:00:00", speed, "true", "false", lat, "70", "1") for i, (d, speed, lat) in enumerate(cells)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` {'long' if c == 'pos' else 'string'}" for c in ["pos", "batch_file", *TELEMATICS.columns]))
    good, bad = checks.split(checks.evaluate(df, TELEMATICS, ["pos"]))
    kept, stopped = {r.pos for r in good.collect()}, {r.pos for r in bad.collect()}
    assert kept | stopped == set(range(len(rows))) and not kept & stopped
    ok = {i for i, (d, s, lat) in enumerate(cells) if d and s == "10" and lat == "10" and cells.index((d, s, lat)) == i
          and not any(c[0] == d for c in cells[:i])}
    assert ok <= kept


def test_evidence_lasts_as_long_as_the_incident(spark):
    """Against brute force: incidents of minutes, days and weeks, closed or open, over the log lines of the smallest tables."""
    from tidewatch.plans import alert_queries
    from tidewatch.plans.registry import AS_OF

    sf_dir, at = "/root/testdata/sf0.001", datetime.datetime.fromisoformat
    lines = alert_queries.log_lines(spark, sf_dir).collect()
    spans = [(s, a, b) for s in sorted({r.source for r in lines}) for a, b in (
        ("2024-01-02 00:00:00", None), ("2024-01-29 22:07:00", None), ("2024-01-03 10:00:00", "2024-01-03 10:20:00"), ("2024-01-05 23:50:00", "2024-01-07 00:00:00"),
        ("2024-01-04 00:15:00", "2024-01-05 00:00:00"), ("2024-01-08 03:30:00", "2024-01-25 12:31:07"), ("2024-01-08 03:30:00", "2024-01-08 02:00:00"))]
    rolled = [(f"INC-{i}", s, at(a), b and at(b)) for i, (s, a, b) in enumerate(spans)]
    want = set()
    for i, source, opened, closed in rolled:
        first = {}
        for r in sorted(lines, key=lambda r: (r.ts, r.level)):
            if r.source == source and opened - datetime.timedelta(minutes=15) <= r.ts <= (closed or at(AS_OF)):
                first.setdefault(r.message, (r.ts, r.level))
        want |= {(i, ts, level, m) for ts, m, level in sorted(((ts, m, level) for m, (ts, level) in first.items()), reverse=True)[:12]}
    frame = spark.createDataFrame(rolled, "incident_id string, source string, opened_at timestamp, closed_at timestamp")
    got = [(r.incident_id, r.ts, r.level, r.message) for r in alert_queries.evidence_of(frame, spark, sf_dir).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert any(ts > dict((i, o) for i, _, o, _ in rolled)[i] + datetime.timedelta(days=1) for i, ts, _, _ in got)


def test_streamed_customers_pass_the_mask_gate(spark, tmp_path):
    from tidewatch.operators.contracts import CUSTOMER_KYC
    from tidewatch.streaming.checks import write_checked
    row = {"customer_id": "C1", "name": "Asha Rao", "phone": "+919876543210", "email": "asha@mail.in", "licence_no": "MH1220190001234",
           "pan": "ABCDE1234F", "address": "1 Hill Road", "dob": "1990-02-03", "city": "Pune", "updated_at": "2024-05-01T00:00:00+00:00",
           "batch_file": "f", "pos": 1}
    bad = {**row, "customer_id": "C2", "pan": "ABCDE12345", "pos": 2}
    checked = checks.evaluate(spark.createDataFrame([row, bad]), CUSTOMER_KYC, ["pos"])
    for token, silver_rows, held in (("valid", 1, {"format"}), ("expired", 0, {"format", "pii"})):
        root = str(tmp_path / token)
        write_checked(checked, CUSTOMER_KYC, root, 0, token)
        stored = spark.read.parquet(f"{root}/silver").collect()
        assert [(r["phone"], r["masked"]) for r in stored] == [("+91******3210", 1)] * silver_rows
        kept = spark.read.parquet(f"{root}/quarantine").collect()
        assert {r["check_name"] for r in kept} == held
        assert all("Asha" not in r["payload"] and "9876543210" not in r["payload"] for r in kept)


def test_blast_radius_and_first_cause_on_random_graphs(spark):
    """Trees, shared nodes, cycles and self-loops, against a plain walk."""
    rng = random.Random(31)
    edges = set()
    for g, (n, extra) in enumerate([(12, 0), (10, 3), (9, 6), (6, 9), (1, 1)]):
        name = lambda i: f"g{g}n{i}"  # noqa: B023, E731
        edges |= {(name(rng.randrange(i)), name(i)) for i in range(1, n)} | {(name(rng.randrange(n)), name(rng.randrange(n))) for _ in range(extra)}
    names = sorted({x for e in edges for x in e})
    layer = {x: rng.choice(["gold", "silver"]) for x in names}
    owner = {x: rng.choice(["o1", "o2", "o3", None]) for x in names}

    def below(start):
        seen, todo = set(), [start]
        while todo:
            at = todo.pop()
            new = {d for s, d in edges if s == at} - seen
            seen |= new
            todo += new
        return seen

    e = spark.createDataFrame(sorted(edges) * 2, "src string, dst string")
    nodes = spark.createDataFrame([(x, layer[x], owner[x]) for x in names], "id string, layer string, owner string")
    got = {r.start: (r.steps, r.products, r.owners) for r in lineage.blast_radius(e, nodes).collect()}
    gold = lambda s: [x for x in below(s) if layer[x] == "gold"]
    assert got == {s: (len(below(s)), len(gold(s)), len({owner[x] for x in gold(s)} - {None})) for s in names if below(s)}

    reds = rng.sample(names, 8)
    starts = spark.createDataFrame([(x, i) for i, x in enumerate(reds)], "start string, pos long")
    want = {x: next(r for r in reds if x in below(r)) for x in names if any(x in below(r) for r in reds)}
    assert {r.node: r.cause for r in lineage.first_cause(starts, e).collect()} == want
    assert lineage.first_cause(starts.limit(0), e).count() == 0 and lineage.blast_radius(e.limit(0), nodes).count() == 0


def test_impact_text(spark):
    gold = spark.createDataFrame(
        [("one", "gold_b", "x", 5.0, False, []), ("one", "gold_a", "x", 5.0, False, ["law"]), ("held", "gold_c", "x", 7.6, True, []),
         ("held", "gold_d", "y", -3.0, True, ["law"]), *[("many", f"gold_{i:02d}", "x", 1.0, False, []) for i in range(12)]],
        "incident_id string, node string, owner string, minutes_left double, blocked boolean, regulation array<string>")
    everyone = spark.createDataFrame([("one",), ("held",), ("many",), ("none",)], "incident_id string")
    got = {r.incident_id: (r.products, r.regulated, r.summary) for r in lineage.impact_summary(gold, everyone).collect()}
    assert got == {
        "one": (2, 1, "2 data products receive incomplete data: a, b. None blocked yet."),
        "held": (2, 1, "2 data products affected; 2 blocked. gold_d (y) breaches its SLA in 0 min."),
        "many": (12, 0, "12 data products receive incomplete data: 00, 01, 02, 03, 04, 05, 06, 07, 08, 09 and 2 more. None blocked yet."),
        "none": (0, 0, "No data products affected.")}
