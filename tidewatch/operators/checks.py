"""Row checks: a contract becomes column expressions; every row gets an array of reasons.

``evaluate`` takes raw text rows (``batch_file``, the position columns, one text column per
contract field) and adds ``t_<field>`` typed columns, ``failed`` and
``reasons ARRAY<STRUCT<check, column, reason>>`` in contract order, then the source's own rules,
then duplicates. Only duplicates and references need a shuffle.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.masking import readable
from tidewatch.functions.typing import cannot_coerce, coerce
from tidewatch.operators import skew
from tidewatch.operators.contracts import DEFAULT_SEVERITY, SEVERITY, Contract, Field

ALL_CHECKS = ("type", "nulls", "range", "allowed_values", "format", "rule", "referential",
              "reconciliation", "duplicates")
REASONS_TYPE = "array<struct<check:string,column:string,reason:string>>"
RECONCILE_TOLERANCE = 1
NUMBER = "row_no"


@dataclass(frozen=True)
class Rule:
    """One predicate on a row: extend a feed by passing more of these to ``evaluate``."""
    check: str
    column: str
    failed: Column
    reason: Column


def severity_of(check: Column) -> Column:
    pairs = [F.lit(x) for item in SEVERITY.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), check), F.lit(DEFAULT_SEVERITY))


def typed_columns(contract: Contract) -> dict[str, Column]:
    return {f"t_{f.name}": coerce(F.col(f.name), f.type) for f in contract.fields}


def _text(value: Column) -> Column:
    return value.cast("string")


def field_rules(field: Field) -> list[Rule]:
    raw, val, name = F.col(field.name), F.col(f"t_{field.name}"), field.name
    mistyped = cannot_coerce(raw, val, field.type)
    rules = [Rule("type", name, mistyped,
                  F.concat(F.lit(f"{name}='"), raw, F.lit(f"' is not {field.type}")))]
    if not field.nullable:
        rules.append(Rule("nulls", name, val.isNull() & ~mistyped, F.lit(f"{name} is empty")))
    if field.min is not None:
        rules.append(Rule("range", name, val < field.min,
                          F.concat(F.lit(f"{name}="), _text(val), F.lit(f" below {field.min}"))))
    if field.max is not None:
        rules.append(Rule("range", name, val > field.max,
                          F.concat(F.lit(f"{name}="), _text(val), F.lit(f" above {field.max}"))))
    if field.allowed:
        rules.append(Rule("allowed_values", name, ~val.isin(*field.allowed),
                          F.concat(F.lit(f"{name}='"), val, F.lit("' not allowed"))))
    if field.pattern:
        rules.append(Rule("format", name, ~_text(val).rlike(f"^(?:{field.pattern})"),
                          F.concat(F.lit(f"{name}="), F.substring(_text(val), 1, 4), F.lit("... wrong format"))))
    return rules


def date_order_rule(start: str, end: str) -> Rule:
    s, e = F.col(f"t_{start}"), F.col(f"t_{end}")
    return Rule("rule", end, e <= s,
                F.concat(F.lit(f"{end} "), _text(e), F.lit(f" before {start} "), _text(s)))


def active_rule(policy: str, on: str, until: str = "policy_end") -> Rule:
    return Rule("referential", policy, F.col(f"t_{on}") > F.col(until),
                F.concat(F.lit("policy "), F.col(f"t_{policy}"), F.lit(" expired on "), _text(F.col(until))))


def reconcile_rule(first: str, second: str, total: str, tolerance: float = RECONCILE_TOLERANCE) -> Rule:
    a, b, t = (F.col(f"t_{c}") for c in (first, second, total))
    return Rule("reconciliation", total, F.abs(a + b - t) > tolerance,
                F.concat(F.lit("total "), _text(t), F.lit(" != parts + labour "), _text(F.round(a + b, 2))))


def any_failed(rules: Sequence[Rule]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(r.failed, F.lit(False)) for r in rules], F.lit(False))


def reasons_array(rules: Sequence[Rule]) -> Column:
    """Clean rows pay for the predicates only; the array is built for failing rows."""
    if not rules:
        return F.array().cast(REASONS_TYPE)
    items = [F.when(r.failed, F.struct(F.lit(r.check).alias("check"), F.lit(r.column).alias("column"),
                                       r.reason.alias("reason"))) for r in rules]
    return F.when(any_failed(rules), F.array_compact(F.array(*items))).otherwise(F.array().cast(REASONS_TYPE))


def evaluate(
    rows: DataFrame,
    contract: Contract,
    order: Sequence[str],
    *,
    only: Collection[str] = ALL_CHECKS,
    policy_ends: DataFrame | None = None,
    known_claims: DataFrame | None = None,
    known_owners: DataFrame | None = None,
    extra_rules: Sequence[Rule] = (),
    again: bool = False,
) -> DataFrame:
    """Add typed columns and ``reasons``. ``order`` is the arrival position, unique per row.

    ``policy_ends(policy_id, policy_end)``: unknown policies pass. ``known_claims(claim_id)``:
    every claim loaded so far. ``known_owners(pan, customer_id)``: first owners from earlier loads.
    ``again``: the result is read more than once, as in ``skew.attach``.
    """
    typed = typed_columns(contract)
    source = contract.source
    checks_ends = source == "claims" and policy_ends is not None and "referential" in only
    checks_claims = source == "garage_bills" and known_claims is not None and "referential" in only
    repeats = "duplicates" in only and source != "customer_kyc" and bool(contract.duplicate_key)
    keys = [f"t_{k}" for k in contract.duplicate_key]
    # Facts are looked up before the other columns are typed: the rows that move for them are narrow.
    early = dict.fromkeys([*(["t_policy_id", "t_accident_date"] if checks_ends else []), *(["t_claim_id"] if checks_claims else []), *(keys if repeats else [])])
    keyed = rows.select("*", *[typed[n].alias(n) for n in early])
    tables: list[skew.Facts] = []
    if checks_ends:
        tables += skew.past(keyed, "t_policy_id", "t_accident_date", policy_ends.select(F.col("policy_id").alias("t_policy_id"), "policy_end"), "policy_end")
    if checks_claims:
        tables.append(skew.missing(keyed, "t_claim_id", known_claims.select(F.col("claim_id").alias("t_claim_id")), "unknown_claim"))
    if repeats:
        tables.append(skew.repeats(keyed, ["batch_file", *keys], order))
    values = [v for t in tables for v in t.values]
    df = skew.attach(keyed, tables, again).select(*rows.columns, *[F.col(n) if n in early else c.alias(n) for n, c in typed.items()], *values)
    rules = [r for f in contract.fields for r in field_rules(f)]
    if source == "policy":
        rules.append(date_order_rule("start_date", "end_date"))
    if checks_ends:
        if "policy_end_often" in values:
            df = df.withColumn("policy_end", F.coalesce("policy_end_often", "policy_end"))
        rules.append(active_rule("policy_id", "accident_date"))
    if source == "garage_bills":
        rules.append(reconcile_rule("parts_cost", "labour_cost", "total"))
    if checks_claims:
        rules.append(Rule("referential", "claim_id", F.coalesce("unknown_claim", F.lit(False)),
                          F.concat(F.lit("claim "), F.col("t_claim_id"), F.lit(" does not exist"))))
    rules += extra_rules
    if "duplicates" in only and source == "customer_kyc":
        if known_owners is not None:
            # Of all history only the owners of numbers in this load take part; Spark filters that scan by the load's numbers.
            numbers = df.select("t_pan").distinct()
            earlier = known_owners.select(F.col("pan").alias("t_pan"), F.col("customer_id").alias("t_customer_id"))
            earlier = earlier.join(numbers, "t_pan", "left_semi").withColumn("era", F.lit(0))
            df = df.withColumn("era", F.lit(1)).unionByName(earlier, allowMissingColumns=True)
            df = skew.attach_first_owner(df, "t_pan", "t_customer_id", ["era", *order], "first_owner")
            df = df.where(F.col("era") == 1).drop("era")
        else:
            df = skew.attach_first_owner(df, "t_pan", "t_customer_id", order, "first_owner")
        rules.append(Rule("duplicates", "pan", ~F.col("first_owner").eqNullSafe(
            F.coalesce("t_customer_id", F.lit("None"))) & F.col("first_owner").isNotNull(),
            F.concat(F.lit("PAN already registered to "), F.col("first_owner"))))
    elif repeats:
        rules.append(Rule("duplicates", contract.duplicate_key[0], skew.is_repeat(order),
                          F.concat(F.lit("duplicate record for "), F.coalesce(_text(F.col(keys[0])), F.lit("None")))))
    wanted = [r for r in rules if r.check in only]
    # The running number keeps filters on good or bad rows above this projection, for readers that refer to it (``settled``). Below,
    # each filter would repeat all rules and the text-to-type expression of every column they read.
    return df.select(*rows.columns, *typed, F.monotonically_increasing_id().alias(NUMBER),
                     reasons_array(wanted).alias("reasons"), any_failed(wanted).alias("failed"))


def first_owners(rows: DataFrame, order: Sequence[str], earlier: DataFrame | None = None) -> DataFrame:
    """(pan, customer_id): the first owner of each number that ``earlier`` does not know; rejected rows own as well."""
    new = rows.where(F.col("t_pan").isNotNull()).groupBy(F.col("t_pan").alias("pan")).agg(
        F.min_by("t_customer_id", F.struct(*order)).alias("customer_id"))
    return new if earlier is None else new.join(earlier.select("pan"), "pan", "left_anti")


def settled(checked: DataFrame) -> DataFrame:
    """All rows, with their reasons worked out once. What explodes or filters reasons starts here: Spark moves the filter that goes
    with it below a projection that holds no running number, and would work the reasons out twice, untyped columns included."""
    return checked.where(F.col(NUMBER) >= 0)


def good_rows(checked: DataFrame) -> DataFrame:
    """Rows without a reason."""
    return settled(checked).where(~F.col("failed")).drop(NUMBER)


def reason_text() -> Column:
    """All reasons of a row as one text."""
    return F.array_join(F.transform("reasons", lambda r: r["reason"]), "; ")


def bad_rows(checked: DataFrame) -> DataFrame:
    """Failing rows with the first reason's check and all reasons as one text."""
    return settled(checked).where("failed").drop(NUMBER).select(
        "*", F.col("reasons")[0]["check"].alias("check_name"),
        reason_text().alias("reason"))


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return good_rows(checked), bad_rows(checked)


def findings(checked: DataFrame, source: str, node: str, totals: DataFrame | None = None) -> DataFrame:
    """One row per (batch_file, failed check): reason count, failed rows, total rows, severity,
    node, the three smallest distinct reasons, and the problem text.

    One aggregation by (batch, check, reason) feeds both branches and is computed once: clean rows
    count under an empty check that only an aggregate value filters out, and the example branch
    orders by the counts as well (reasons are already distinct), so both branches read the same
    exchange. Examples are cut to three rows per group before their own shuffle.

    ``totals(batch_file, total_rows)``: where ``checked`` holds failing rows only, how many rows each batch has in all.
    """
    names = F.transform("reasons", lambda r: r["check"])
    parts = F.transform("reasons", lambda r, i: F.struct(
        r["check"].alias("check"), r["reason"].alias("reason"),
        (F.array_position(names, r["check"]) == i + 1).cast("long").alias("row_of_check"),
        (i == 0).cast("long").alias("row_of_batch")))
    blank = F.lit("")
    counted = checked.select("batch_file", F.explode_outer(parts).alias("r")).groupBy(
        "batch_file", F.coalesce("r.check", blank).alias("check_name"), F.coalesce("r.reason", blank).alias("reason")).agg(
        F.count("r.check").alias("n"), F.sum(F.coalesce("r.row_of_check", F.lit(0))).alias("rows"),
        F.sum(F.coalesce("r.row_of_batch", F.lit(1))).alias("starts"))
    per_check = counted.groupBy("batch_file", "check_name").agg(
        F.sum("n").alias("failure_count"), F.sum("rows").alias("failed_rows"), F.sum("starts").alias("starts"))
    if totals is None:
        per_check = per_check.withColumn("total_rows", F.sum("starts").over(Window.partitionBy("batch_file")))
    else:
        per_check = per_check.join(totals, "batch_file")
    per_check = per_check.where(F.col("failure_count") > 0)
    smallest = Window.partitionBy("batch_file", "check_name").orderBy("reason", "n", "rows", "starts")
    examples = counted.withColumn("k", F.row_number().over(smallest)).where(F.col("k") <= 3).groupBy(
        "batch_file", "check_name").agg(F.array_join(F.array_sort(F.collect_list("reason")), "; ").alias("examples"))
    out = per_check.join(examples, ["batch_file", "check_name"])
    return out.select(
        F.lit(source).alias("source"), "batch_file", "check_name", F.lit(node).alias("node"),
        severity_of(F.col("check_name")).alias("severity"), "failure_count", "failed_rows", "total_rows", "examples",
        F.concat(_text(F.col("failure_count")), F.lit(" of "), _text(F.col("total_rows")), F.lit(" rows failed "),
                 F.replace("check_name", F.lit("_"), F.lit(" ")), F.lit(": "), F.col("examples")).alias("problem"))


def samples(checked: DataFrame, order: Sequence[str], n: int = 3) -> DataFrame:
    """The first ``n`` failures per (batch_file, check) in row order; pruned to ``n`` before the shuffle."""
    one = settled(checked).select("*", F.posexplode("reasons").alias("reason_no", "r"))
    first = Window.partitionBy("batch_file", "check_name").orderBy(*order, "reason_no")
    return one.withColumn("check_name", F.col("r.check")).withColumn("reason", F.col("r.reason")).withColumn(
        "sample_no", F.row_number().over(first)).where(F.col("sample_no") <= n).drop("r", "reason_no")


def scan_pii(customers: DataFrame) -> DataFrame:
    """Silver customer rows that still show personal data."""
    return customers.where(readable(F.col("phone"), F.col("pan"), F.col("masked")))
