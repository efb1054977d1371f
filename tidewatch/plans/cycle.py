"""One load cycle over landing files: Bronze, checks, Silver, quarantine, findings, gates and Gold.

Tables live below ``root/tables``. Each step (a source's files in one cycle or micro-batch, the gate, Gold, a repair) writes all its
tables and then one commit, so Bronze, findings, quarantine, Silver, owners and registry of a load become visible together; a
step that failed anywhere left no trace and is simply run again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.masking import mask_payload
from tidewatch.operators import alerts, batches, checks, gold, incidents, silver
from tidewatch.operators.contracts import CONTRACTS, Contract
from tidewatch.session import cut_lineage
from tidewatch.sources import landing, logs, tables
from tidewatch.sources.commits import Commits

ORDER = ["batch_file", "split", "seq"]
REGISTRY = "file string, source string, n_rows long, ingested_at timestamp"
QUARANTINE = ("source string, batch_file string, split long, seq long, check_name string, reason string, "
              "payload map<string,string>, quarantined_at timestamp, released int")
FINDINGS = ("source string, batch_file string, check_name string, node string, severity string, failure_count long, "
            "failed_rows long, total_rows long, examples string, problem string, ts timestamp")
RELEASED = "source string, batch_file string, split long, seq long"
ALERTS = ("source string, check_name string, episode long, first_seen timestamp, last_seen timestamp, occurrences long, "
          "clean_batches long, status string, resolved_at timestamp, severity string, node string, problem string, "
          "detail map<string,string>, last_batch long")
ALERT_KEY = ["source", "check_name", "episode"]
COUNTS = "source string, batches long, cycle int"
GATES = "node string, blocked int, reason string, leaks long"
JUDGED = "source string, check_name string, failing boolean, severity string, node string, problem string, detail map<string,string>"
PRODUCTS = ("gold_driver_risk_score", "gold_claims_summary", "gold_fraud_watchlist", "gold_customer_360",
            "gold_compliance_report")


@dataclass(frozen=True)
class Cycle:
    """Where to work and what is known from outside: time, token, approved mappings, master data."""
    spark: SparkSession
    root: str
    number: int
    as_of: str
    token_status: str = "valid"
    fail_open: bool = False
    mappings: dict[str, dict[str, str]] = field(default_factory=dict)  # source -> {from: to, "" drops}
    policy_ends: DataFrame | None = None
    intervals: dict[str, int] = field(default_factory=dict)  # seconds between files of a source; named sources are watched for silence

    def __post_init__(self):
        object.__setattr__(self, "commits", Commits(self.spark, f"{self.root}/tables"))

    def path(self, name: str) -> str:
        return f"{self.root}/tables/{name}"

    def now(self):
        return F.lit(self.as_of).cast("timestamp")

    def committed(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows of an append-only table whose folder (source, cycle) belongs to a commit."""
        folder = F.concat(F.lit("source="), F.col("source"), F.lit("/cycle="), F.col("cycle").cast("string"))
        return rows.withColumn("__path", folder).join(self.commits.added(name).withColumnRenamed("path", "__path"), "__path", "left_semi").drop("__path")

    def log(self, name: str, schema: str) -> DataFrame:
        wanted = self.spark.createDataFrame([], schema).schema
        plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted if f.name != "cycle")
        rows = tables.read_or_empty(self.spark, self.path(name), f"{plain}, cycle string", [f.name for f in wanted])
        return self.committed(rows, name).select(*[F.col(f.name).cast(f.dataType) for f in wanted])

    def append(self, df: DataFrame, name: str, source: str, folder: str | None = None) -> None:
        self.commits.add(df.drop("source"), name, f"source={source}/cycle={folder or self.number}")

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """A written intermediate table: read several times, and its plan starts afresh from files."""
        path = f"{self.path('stage')}/{name}/cycle={self.number}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def current(self, name: str) -> DataFrame | None:
        return self.commits.current(name)

    def replace(self, name: str, df: DataFrame) -> None:
        self.commits.replace(df, name)

    def upsert(self, contract: Contract, rows: DataFrame) -> None:
        self.commits.upsert(rows, contract.silver, [contract.key], "arrived")


def new_paths(c: Cycle, contract: Contract) -> tuple[DataFrame, list[str]]:
    """Files of one source that are not registered yet (names only)."""
    done = c.log("registry", REGISTRY).where(F.col("source") == contract.source)
    fresh = landing.new_files(landing.list_files(c.spark, f"{c.root}/landing/{contract.source}"), done)
    return fresh, [r["path"] for r in fresh.collect()]


def load_source(c: Cycle, contract: Contract) -> None:
    files, paths = new_paths(c, contract)
    if paths:
        load_rows(c, contract, files, landing.read_ndjson(c.spark, paths) if contract.format == "json" else landing.read_csv(c.spark, paths))


def load_lines(c: Cycle, contract: Contract, lines: DataFrame) -> bool:
    """One micro-batch of landing lines (batch_file, split, seq, value); False where its step is committed already."""
    if c.commits.has(f"load {contract.source} {c.number}"):
        return False
    lines = c.stage(lines, f"lines_{contract.source}")
    load_rows(c, contract, lines.select("batch_file").distinct(), landing.parse_json(lines) if contract.format == "json" else landing.parse_csv(lines))
    return True


def load_rows(c: Cycle, contract: Contract, files: DataFrame, raw: DataFrame) -> None:
    """Everything that follows from one source's raw rows, as one commit."""
    source = contract.source
    c.commits.forget()  # of a step that failed before
    c.append(tables.bronze_rows(raw, source, c.now()), "bronze", source)

    rules = c.mappings.get(source, {})
    rename = {k: v for k, v in rules.items() if v}
    mapped = raw.withColumn("payload", batches.map_columns(F.col("payload"), rename, [k for k, v in rules.items() if not v]))
    parsed = mapped.where(F.col("malformed").isNull())
    # A file without rows misses every column; one whose lines are all unreadable is not empty.
    unreadable = raw.where(F.col("malformed").isNotNull()).select("batch_file").distinct()
    judged = files.select("batch_file").join(unreadable, "batch_file", "left_anti").unionByName(
        parsed.select("batch_file").distinct())
    drift = cut_lineage(batches.schema_drift(parsed, contract, ["split", "seq"], judged))
    gated = batches.schema_gate(parsed, drift)
    view = batches.contract_view(gated, contract, ["batch_file", "split", "seq", "payload", "gate_reason"])
    open_rows = view.where(F.col("gate_reason").isNull())
    checked = checks.evaluate(
        open_rows, contract, ORDER, policy_ends=c.policy_ends, known_claims=known_claims(c) if source == "garage_bills" else None,
        known_owners=c.current("pan_owner") if source == "customer_kyc" else None)
    checked = c.stage(checked, f"checked_{source}")  # read by findings, quarantine, Silver and the owner table

    held = view.where(F.col("gate_reason").isNotNull()).select(*ORDER, F.lit("schema").alias("check_name"),
                                                               F.col("gate_reason").alias("reason"), "payload")
    broken = raw.where(F.col("malformed").isNotNull()).select(
        *ORDER, F.lit("type").alias("check_name"), F.lit("line is not a readable record").alias("reason"),
        F.create_map(F.lit("malformed"), F.col("malformed")).alias("payload"))
    bad = checks.bad_rows(checked).select(*ORDER, "check_name", "reason", "payload").unionByName(held).unionByName(broken)

    good = silver.project(checks.good_rows(checked), contract, ["split", "seq"]).withColumn("arrived", arrival(F.lit(c.number)))
    refused_findings = None
    if source == "customer_kyc":
        good, refused = silver.mask_gate(good, c.token_status, c.fail_open)
        waiting = refused.select(*ORDER, F.lit("pii").alias("check_name"), F.lit("masking not available").alias("reason"),
                                 F.create_map(*[x for f in contract.fields for x in (
                                     F.lit(f.name), F.col(f.name).cast("string"))]).alias("payload"))
        refused_findings = held_findings(waiting, checked, contract)
        bad = bad.unionByName(waiting)
        bad = bad.withColumn("payload", mask_payload(F.col("payload"), contract.columns))
        remember_owners(c, checked)

    schema_findings = drift.join(raw.groupBy("batch_file").agg(F.count(F.lit(1)).alias("n")), "batch_file", "left").select(
        F.lit(source).alias("source"), "batch_file", F.lit("schema").alias("check_name"), F.lit(contract.bronze).alias("node"),
        F.lit("HIGH").alias("severity"), F.coalesce("n", F.lit(0)).cast("long").alias("failure_count"),
        F.coalesce("n", F.lit(0)).cast("long").alias("failed_rows"), F.coalesce("n", F.lit(0)).cast("long").alias("total_rows"),
        F.lit("").alias("examples"), "problem")
    found = checks.findings(checked, source, contract.silver).unionByName(schema_findings)
    if refused_findings is not None:
        found = found.unionByName(refused_findings)
    c.append(found.withColumn("ts", c.now()), "findings", source)
    c.append(bad.withColumns({"quarantined_at": c.now(), "released": F.lit(0)}), "quarantine", source)
    if contract.key is None:
        c.append(good.drop("split", "seq", "arrived"), contract.silver, source)
    else:
        c.upsert(contract, good.drop("split", "seq"))
    c.append(tables.registry_rows(raw, files, source, c.now()), "registry", source)
    c.commits.commit(f"load {source} {c.number}")


def remember_owners(c: Cycle, rows: DataFrame) -> None:
    """Add the first owners of new numbers; owners known before are neither changed nor, outside touched buckets, rewritten."""
    new = c.stage(checks.first_owners(rows, ORDER, c.current("pan_owner")), "new_owners")
    c.commits.upsert(new.withColumn("arrived", F.lit(c.number)), "pan_owner", ["pan"], "arrived")


def arrival(number):
    """Where a row arrived: cycle, file and place. Silver keeps it, so a row replayed later still counts as of then."""
    return F.struct(number.cast("int").alias("cycle"), "batch_file", "split", "seq")


def held_findings(waiting: DataFrame, checked: DataFrame, contract: Contract) -> DataFrame:
    """One CRITICAL finding per file whose rows wait for masking."""
    totals = checked.groupBy("batch_file").agg(F.count(F.lit(1)).alias("total_rows"))
    n = waiting.groupBy("batch_file").agg(F.count(F.lit(1)).alias("failure_count")).join(totals, "batch_file")
    text = lambda c: F.col(c).cast("string")
    return n.select(
        F.lit(contract.source).alias("source"), "batch_file", F.lit("pii").alias("check_name"), F.lit(contract.silver).alias("node"),
        checks.severity_of(F.lit("pii")).alias("severity"), "failure_count", F.col("failure_count").alias("failed_rows"), "total_rows", F.lit("").alias("examples"),
        F.concat(text("failure_count"), F.lit(" of "), text("total_rows"), F.lit(" rows held: masking not available")).alias("problem"))


def known_claims(c: Cycle) -> DataFrame:
    """Claims in Silver and every claim that ever arrived."""
    arrived = c.log("bronze", "source string, payload string").where(F.col("source") == "claims").select(
        F.get_json_object("payload", "$.claim_id").alias("claim_id"))
    loaded = c.current("silver_claims")
    return arrived if loaded is None else arrived.unionByName(loaded.select("claim_id"))


def silver_table(c: Cycle, contract: Contract) -> DataFrame:
    empty = silver.project(checks.evaluate(c.spark.createDataFrame([], ", ".join(
        f"`{x}` string" for x in ["batch_file", "pos", *contract.columns])), contract, ["pos"], only=()), contract)
    if contract.source == "customer_kyc":
        empty = empty.withColumn("masked", F.lit(0))
    if contract.key is None:
        found = tables.if_there(lambda: c.spark.read.parquet(c.path(contract.silver)))
        found = None if found is None else c.committed(found, contract.silver)
    else:
        found = c.current(contract.silver)
    return empty if found is None else found.select(*empty.columns)


def quarantine_json(c: Cycle) -> DataFrame:
    return c.log("quarantine", QUARANTINE).withColumn("payload", F.to_json("payload"))


def gate(c: Cycle) -> set[str]:
    """Scan Silver for readable personal data and keep the block state of each product."""
    state = c.current("gates")
    if state is None:
        state = c.spark.createDataFrame([(p, 0, None, 0) for p in PRODUCTS], GATES)
    after = batches.pii_gate(silver_table(c, CONTRACTS["customer_kyc"]), state)
    c.replace("gates", after)
    c.commits.commit(f"gate {c.number}")
    return {r["node"] for r in c.current("gates").where("blocked = 1").collect()}  # five products


def build_gold(c: Cycle, blocked: set[str]) -> list[str]:
    t = {s: silver_table(c, k) for s, k in CONTRACTS.items()}
    held = quarantine_json(c)
    products = {
        "gold_driver_risk_score": lambda: gold.risk_score(t["telematics"], t["policy"]),
        "gold_claims_summary": lambda: gold.claims_summary(t["claims"]),
        "gold_fraud_watchlist": lambda: gold.fraud_watchlist(t["garage_bills"], t["claims"], held),
        "gold_customer_360": lambda: gold.customer_360(t["customer_kyc"], t["policy"], t["claims"]),
        "gold_compliance_report": lambda: gold.compliance(t["customer_kyc"], held),
    }
    built = gold.refresh(products, blocked, c.replace)
    stamped = c.spark.createDataFrame([(p,) for p in built], "node string").withColumn("last_refreshed", c.now())
    c.append(stamped, "refreshes", "gold")
    c.append(run_row(c), "runs", "cycle")
    c.commits.commit(f"gold {c.number}")
    return built


def run_row(c: Cycle) -> DataFrame:
    """What this cycle loaded: files, rows, failures, from its own registry and findings."""
    loaded = c.log("registry", f"{REGISTRY}, cycle string").where(F.col("cycle") == str(c.number))
    failed = c.log("findings", f"{FINDINGS}, cycle string").where(F.col("cycle") == str(c.number))
    files = loaded.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"))
    return files.select(c.now().alias("ran_at"), "files", "n_rows", failed.agg(F.coalesce(F.sum("failure_count"), F.lit(0))).scalar().alias("failures"))


def refreshed(c: Cycle) -> DataFrame:
    """When each product was last rebuilt; one that a gate holds back keeps its older time."""
    return c.log("refreshes", "node string, last_refreshed timestamp, source string").groupBy("node").agg(F.max("last_refreshed").alias("last_refreshed"))


def load(c: Cycle) -> None:
    for contract in CONTRACTS.values():
        load_source(c, contract)


def run(c: Cycle) -> list[str]:
    """Load all new files, then the gates, then Gold, then alerts and incidents. Returns the rebuilt products."""
    load(c)
    built = build_gold(c, gate(c))
    watch(c)
    return built


def current_or(c: Cycle, name: str, schema: str) -> DataFrame:
    found = c.current(name)
    return c.spark.createDataFrame([], schema) if found is None else found


def watch(c: Cycle, decisions: DataFrame | None = None) -> bool:
    """Alerts, incidents, evidence and causes after this cycle, as one commit; False where that was done before.

    Alerts advance by the state checks and by the findings and files of the cycles since the last watch (cycles that were loaded without one are caught
    up with), and only changed alerts are written. Incidents and causes follow from the alerts, which are few; log lines are
    read from ``root/logs`` where there are any. Times of loads must rise from cycle to cycle.
    """
    step = f"watch {c.number}"
    if c.commits.has(step):
        return False
    c.commits.forget()
    before = current_or(c, "batch_counts", COUNTS)
    seen = before.agg(F.coalesce(F.max("cycle"), F.lit(0))).first()[0]
    no = F.col("cycle").try_cast("int")
    since = lambda rows: rows.where((no > seen) & (no <= c.number))
    arrived = since(c.log("registry", f"{REGISTRY}, cycle string")).select("source", "file", "ingested_at")
    numbered = alerts.number_batches(arrived).join(before.select("source", "batches"), "source", "left")
    numbered = c.stage(numbered.select("source", F.col("file").alias("batch_file"), F.col("ingested_at").alias("ts"), (
        F.col("batch_no") + F.coalesce("batches", F.lit(0))).alias("batch_no")), "numbered")
    text = lambda n: F.col(n).cast("string")
    found = since(c.log("findings", f"{FINDINGS}, cycle string")).drop("ts", "cycle").join(numbered, ["source", "batch_file"]).select(
        "source", "check_name", "batch_no", "ts", "severity", "node", "problem", F.create_map(
            F.lit("failed_rows"), text("failure_count"), F.lit("total_rows"), text("total_rows")).alias("detail"))
    known = current_or(c, "alerts", f"{ALERTS}, arrived int")
    changed = c.stage(alerts.advance(known.drop("arrived"), c.stage(found, "failures"), numbered).withColumn("arrived", F.lit(c.number)), "changed_alerts")
    by_batch = silver.merge(known, changed.select(*known.columns), ALERT_KEY, "arrived")
    stood = c.stage(alerts.stand(by_batch.drop("arrived"), standing(c), c.now()).withColumn("arrived", F.lit(c.number)), "standing_alerts")
    changed = changed.unionByName(stood)
    c.commits.upsert(changed, "alerts", ALERT_KEY, "arrived", buckets=8)
    now_known = c.stage(silver.merge(known, changed.select(*known.columns), ALERT_KEY, "arrived"), "alerts_now")

    rolled = c.stage(incidents.rollup(now_known, decisions), "incidents_now")
    linked = incidents.link_alerts(now_known, decisions).join(rolled.select("source", "incident_no", "incident_id"), ["source", "incident_no"])
    spans = rolled.select("incident_id", "source", "opened_at", F.coalesce("closed_at", c.now()).alias("until"))
    lines = c.stage(incidents.evidence(spans, log_lines(c)), "evidence_now")
    c.replace("incidents", rolled)
    c.replace("evidence", lines)
    c.replace("causes", incidents.fix_lookup(incidents.root_cause(linked, lines)))
    counts = before.select("source", "batches").unionByName(numbered.groupBy("source").agg(F.count(F.lit(1)).alias("batches")))
    # A row without source keeps the cycle reached also where nothing has ever arrived.
    mark = c.spark.createDataFrame([(None, 0)], "source string, batches long")
    c.replace("batch_counts", counts.unionByName(mark).groupBy("source").agg(F.sum("batches").alias("batches")).withColumn("cycle", F.lit(c.number)))
    c.commits.commit(step)
    return True


def standing(c: Cycle) -> DataFrame:
    """How the checks on a state stand: silence of each source with an interval, and readable personal data where the gate has looked."""
    limits = c.spark.createDataFrame(list(c.intervals.items()), "source string, interval_seconds long")
    text = lambda n: F.col(n).cast("string")
    high = lambda check: checks.severity_of(F.lit(check)).alias("severity")
    silent = batches.freshness(c.log("registry", REGISTRY), limits, c.now()).select(
        "source", F.lit("freshness").alias("check_name"), F.col("stale").alias("failing"), high("freshness"), F.concat(F.lit("src_"), "source").alias("node"), "problem",
        F.create_map(F.lit("silent_seconds"), text("silent_seconds"), F.lit("limit_seconds"), text("limit_seconds")).alias("detail"))
    found = silent.unionByName(c.spark.createDataFrame([], JUDGED))
    gates = c.current("gates")
    if gates is None or "leaks" not in gates.columns:
        return found
    leaks = gates.agg(F.max("leaks").alias("leaks")).select(
        F.lit("customer_kyc").alias("source"), F.lit("pii").alias("check_name"), (F.col("leaks") > 0).alias("failing"), high("pii"), F.lit("mask_pii").alias("node"),
        F.concat(text("leaks"), F.lit(" customer rows in Silver contain unmasked personal data (phone, PAN, licence)")).alias("problem"),
        F.create_map(F.lit("unmasked_rows"), text("leaks")).alias("detail"))
    return found.unionByName(leaks)


def log_lines(c: Cycle) -> DataFrame:
    found = tables.if_there(lambda: logs.evidence_lines(logs.read_logs(c.spark, f"{c.root}/logs")))
    return c.spark.createDataFrame([], "ts timestamp, source string, level string, message string") if found is None else found


def alert_table(c: Cycle) -> DataFrame:
    """Alerts so far, from the findings log and the registry."""
    numbered = alerts.number_batches(c.log("registry", REGISTRY).select("source", "file", "ingested_at"))
    numbered = cut_lineage(numbered.select("source", F.col("file").alias("batch_file"), "batch_no", F.col("ingested_at").alias("ts")))
    found = c.log("findings", FINDINGS).drop("ts").join(numbered, ["source", "batch_file"])
    text = lambda n: F.col(n).cast("string")
    found = cut_lineage(found.withColumn("detail", F.create_map(
        F.lit("failed_rows"), text("failure_count"), F.lit("total_rows"), text("total_rows"))))
    episodes = alerts.episodes(found.select("source", "check_name", "batch_no", "ts"), numbered)
    return episodes.join(alerts.state(found), ["source", "check_name", "episode"])


def remask(c: Cycle) -> bool:
    """Repair after a renewed token: mask what leaked; True when nothing readable is left."""
    stored = c.current("silver_customer")
    if stored is not None:
        c.replace("silver_customer", silver.remask(stored))
        c.commits.commit(f"remask {c.number}")
    return silver.repair_verify(silver_table(c, CONTRACTS["customer_kyc"])).first()["passed"]


def reload_quarantine(c: Cycle, source: str) -> None:
    """Repair after an approved mapping or a renewed token: release held rows that now pass, into Silver.

    Released rows go to an append-only log that later replays leave out, and they keep the place at which they
    arrived, so a newer row of the same key stays. Folders are named after what the log held before: a replay that failed
    half-way overwrites its own when repeated, and never those of one that went through.
    """
    from tidewatch.operators import repair
    contract, rules = CONTRACTS[source], c.mappings.get(source, {})
    held = c.log("quarantine", f"{QUARANTINE}, cycle int").where(F.col("source") == source)
    released = c.log("released", RELEASED).where(F.col("source") == source).select(*ORDER)
    folder = f"replay-{c.number}-{released.count()}"
    c.commits.forget()
    held = held.join(released, ORDER, "left_anti")
    if source == "customer_kyc":  # held copies are masked, so the rows come from Bronze
        arrived = c.log("bronze", "source string, batch_file string, split long, seq long, payload string").where(F.col("source") == source).select(
            *ORDER, F.from_json("payload", "map<string,string>").alias("payload"))
        held = held.drop("payload").join(arrived, ORDER)
    held = c.stage(held, f"held_{source}")
    held_for = ("schema", "pii") if source == "customer_kyc" and c.token_status == "valid" else ("schema",)
    ends, claims = c.policy_ends, known_claims(c) if source == "garage_bills" else None
    owners = c.current("pan_owner") if source == "customer_kyc" else None
    result = c.stage(repair.replay(
        held, contract, ORDER, {k: v for k, v in rules.items() if v}, [k for k, v in rules.items() if not v],
        check=lambda view: checks.evaluate(view, contract, ORDER, policy_ends=ends, known_claims=claims, known_owners=owners),
        held_for=held_for), f"replay_{source}")
    good = silver.project(checks.good_rows(result), contract, ["split", "seq"])
    if source == "customer_kyc":
        good, _ = silver.mask_gate(good, c.token_status, c.fail_open)
        remember_owners(c, result)
    good = c.stage(good.join(held.select(*ORDER, "cycle"), ORDER).withColumn("arrived", arrival(F.col("cycle"))).drop("cycle"), f"freed_{source}")
    if contract.key is None:
        c.append(good.drop("split", "seq", "arrived"), contract.silver, source, folder)
    else:
        c.upsert(contract, good.drop("split", "seq"))
    c.append(good.select(*ORDER), "released", source, folder)
    c.commits.commit(f"replay {source} {folder}")
