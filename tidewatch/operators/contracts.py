"""What each feed must look like."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "string"
    nullable: bool = False
    min: float | int | None = None
    max: float | int | None = None
    allowed: tuple[str, ...] = ()
    pattern: str | None = None
    pii: bool = False


@dataclass(frozen=True)
class Contract:
    source: str
    fields: tuple[Field, ...]
    silver: str                         # Silver table (and lineage node) name
    key: str | None = None              # primary key in Silver; None = append only
    duplicate_key: tuple[str, ...] = ()  # one record per key and file
    format: str = "json"
    interval_seconds: int = 60

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def bronze(self) -> str:
        return f"bronze_{self.source}"

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.fields if not f.nullable]


# The five feed contracts, the severities and the operating settings.
TELEMATICS = Contract("telematics", (
    Field("device_id"), Field("vehicle_id"), Field("policy_id"),
    Field("timestamp", "timestamp"),
    Field("speed_kmph", "double", min=0, max=220),
    Field("harsh_brake", "boolean"), Field("harsh_accel", "boolean"),
    Field("lat", "double", min=6, max=37), Field("lon", "double", min=68, max=98),
    Field("odometer_km", "double", min=0),
), silver="silver_telematics", duplicate_key=("device_id", "timestamp"), interval_seconds=5)

POLICY = Contract("policy", (
    Field("policy_id"), Field("customer_id"), Field("vehicle_id"), Field("reg_no"),
    Field("make"), Field("model"),
    Field("year", "int", min=1990, max=2027),
    Field("cover_type", allowed=("Comprehensive", "Third Party", "Own Damage")),
    Field("sum_insured", "double", min=1), Field("premium", "double", min=1),
    Field("start_date", "date"), Field("end_date", "date"),
    Field("change_type", allowed=("NEW", "RENEWAL", "ENDORSEMENT")),
), silver="silver_policy", key="policy_id", format="csv", interval_seconds=60)

CLAIMS = Contract("claims", (
    Field("claim_id"), Field("policy_id"), Field("vehicle_id"),
    Field("accident_date", "date"), Field("reported_at", "timestamp"), Field("location"),
    Field("claim_type", allowed=("Collision", "Theft", "Windshield", "Flood", "Third Party")),
    Field("claim_amount", "double", min=1),
    Field("status"), Field("garage_id"),
), silver="silver_claims", key="claim_id",
    duplicate_key=("vehicle_id", "accident_date", "claim_type", "claim_amount"), interval_seconds=10)

GARAGE_BILLS = Contract("garage_bills", (
    Field("bill_id"), Field("claim_id"), Field("garage_id"),
    Field("parts_cost", "double", min=0), Field("labour_cost", "double", min=0),
    Field("total", "double"), Field("invoice_date", "date"),
), silver="silver_garage_bills", key="bill_id", format="csv", interval_seconds=30)

CUSTOMER_KYC = Contract("customer_kyc", (
    Field("customer_id"), Field("name", pii=True), Field("phone", pii=True), Field("email", pii=True),
    Field("licence_no", pii=True), Field("pan", pattern="^[A-Z]{5}[0-9]{4}[A-Z]$", pii=True),
    Field("address", pii=True), Field("dob", "date", pii=True), Field("city"),
    Field("updated_at", "timestamp"),
), silver="silver_customer", key="customer_id", interval_seconds=30)

# Claims load before bills, because a bill must find its claim.
CONTRACTS = {c.source: c for c in (TELEMATICS, POLICY, CLAIMS, GARAGE_BILLS, CUSTOMER_KYC)}

SEVERITY = {
    "schema": "HIGH", "nulls": "HIGH", "referential": "HIGH", "reconciliation": "HIGH",
    "freshness": "HIGH", "pii": "CRITICAL", "range": "MEDIUM", "allowed_values": "MEDIUM",
    "format": "MEDIUM", "rule": "MEDIUM", "duplicates": "MEDIUM", "type": "MEDIUM",
}
DEFAULT_SEVERITY = "MEDIUM"
SEVERITY_RANK = {"LOW": 0, "MEDIUM": 1, "HIGH": 2, "CRITICAL": 3}
FRESHNESS_FACTOR = 4
RESOLVE_AFTER_CLEAN_BATCHES = 2
