"""Checks on a whole landing file, and gates that act on the result."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import skew
from tidewatch.operators.checks import REASONS_TYPE
from tidewatch.operators.contracts import FRESHNESS_FACTOR, Contract

PII_BLOCK_REASON = "Unmasked PII in silver_customer"
PII_GATED_PRODUCTS = ("gold_customer_360", "gold_compliance_report")


def map_columns(payload: Column, rename: Mapping[str, str], drop: Sequence[str] = ()) -> Column:
    """Rename and drop keys of a raw map row. When two keys end on one name the later wins."""
    if not rename and not drop:
        return payload
    target = F.create_map(*[F.lit(x) for pair in rename.items() for x in pair]) if rename else None
    kept = F.filter(F.map_entries(payload), lambda e: ~e["key"].isin(*drop)) if drop else F.map_entries(payload)

    def renamed(entry: Column) -> Column:
        name = F.coalesce(F.try_element_at(target, entry["key"]), entry["key"]) if rename else entry["key"]
        return F.struct(name.alias("key"), entry["value"].alias("value"))

    entries = F.transform(kept, renamed)
    last = F.filter(entries, lambda e, i: ~F.exists(
        F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def mapped_keys(keys: Column, rename: Mapping[str, str], drop: Sequence[str] = ()) -> Column:
    """The keys that ``map_columns`` leaves of a row with these, in their order."""
    if not rename and not drop:
        return keys
    return F.map_keys(map_columns(F.map_from_arrays(keys, keys), rename, drop))


def mapped_value(payload: Column, name: str, rename: Mapping[str, str], drop: Sequence[str] = ()) -> Column:
    """What ``map_columns`` puts under ``name`` (NULL if nothing), looked up without building the mapped row."""
    names = [k for k in dict.fromkeys([name, *rename]) if rename.get(k, k) == name and k not in drop]
    if not names:
        return F.lit(None).cast("string")
    if len(names) == 1:
        return F.try_element_at(payload, F.lit(names[0]))
    keys = F.map_keys(payload)
    last = F.greatest(*[F.array_position(keys, F.lit(k)) for k in names])
    return F.when(last > 0, F.try_element_at(F.map_values(payload), last.cast("int")))


def map_frame(df: DataFrame, rename: Mapping[str, str], drop: Sequence[str] = ()) -> DataFrame:
    """The same on columns; a renamed column replaces an existing one of that name."""
    clash = [to for frm, to in rename.items() if frm in df.columns and to in df.columns]
    gone = [c for c in (*drop, *clash) if c in df.columns]
    return df.drop(*gone).withColumnsRenamed({k: v for k, v in rename.items() if k in df.columns and k not in drop})


def apply_mappings(rows: DataFrame, mappings: DataFrame) -> DataFrame:
    """Apply stored mappings (source, from_col, to_col; empty target drops the column) to raw map rows.

    There is one mapping row per approved column, so the per-source map is a small lookup.
    """
    rules = mappings.groupBy("source").agg(
        F.map_from_entries(F.collect_list(F.struct("from_col", "to_col"))).alias("__rules"))
    joined = rows.join(rules, "source", "left")
    target = lambda k: F.coalesce(F.try_element_at("__rules", k), k)
    entries = F.filter(F.transform(F.map_entries("payload"), lambda e: F.struct(
        target(e["key"]).alias("key"), e["value"].alias("value"))), lambda e: e["key"] != "")
    last = F.filter(entries, lambda e, i: ~F.exists(
        F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda later: later["key"] == e["key"]))
    mapped = F.when(F.col("__rules").isNull(), F.col("payload")).otherwise(F.map_from_entries(last))
    return joined.withColumn("payload", mapped).select(*rows.columns)


def contract_view(rows: DataFrame, contract: Contract, keep: Sequence[str], rename: Mapping[str, str] | None = None,
                  drop: Sequence[str] = ()) -> DataFrame:
    """Raw map rows, mapped by ``rename`` and ``drop``, as one text column per contract field."""
    return rows.select(*keep, *[mapped_value(F.col("payload"), c, rename or {}, drop).alias(c) for c in contract.columns])


def schema_drift(rows: DataFrame, contract: Contract, order: Sequence[str], files: DataFrame | None = None,
                 rename: Mapping[str, str] | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """Per batch: contract columns that never arrived and arrived columns the contract lacks.

    ``rows`` carries ``batch_file``, the ``order`` columns and ``payload`` (raw map). Rows shrink to
    distinct key lists first, which map-side combining does before any shuffle. ``files(batch_file)``
    adds files without rows: every column is missing there. ``rename`` and ``drop`` are applied to the key lists.
    """
    key_lists = rows.select("batch_file", F.map_keys("payload").alias("ks"), F.struct(*order).alias("pos")).groupBy(
        "batch_file", "ks").agg(F.min("pos").alias("pos"))
    keys = key_lists.select("batch_file", "pos", F.posexplode(mapped_keys(F.col("ks"), rename or {}, drop)).alias("i", "k")).groupBy("batch_file", "k").agg(
        F.min(F.struct("pos", "i")).alias("at"))
    present = keys.groupBy("batch_file").agg(F.array_sort(F.collect_list(F.struct("at", "k"))).alias("seen"))
    arrived = F.transform("seen", lambda s: s["k"])
    if files is not None:
        present = files.select("batch_file").distinct().join(present, "batch_file", "left")
        arrived = F.coalesce(arrived, F.array().cast("array<string>"))
    expected = F.array(*[F.lit(c) for c in contract.columns])
    required = F.array(*[F.lit(c) for c in contract.required]).cast("array<string>")
    out = present.select(
        "batch_file", F.array_except(expected, arrived).alias("missing"),
        F.array_except(arrived, expected).alias("extra"))
    missing, extra = F.col("missing"), F.col("extra")
    parts = F.array_compact(F.array(
        F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", "))),
        F.when(F.size(extra) > 0, F.concat(F.lit("new "), F.array_join(extra, ", ")))))
    return out.where((F.size(missing) > 0) | (F.size(extra) > 0)).select(
        "batch_file", "missing", "extra", F.array_intersect(missing, required).alias("blocking"),
        F.concat(F.lit("Columns changed: "), F.array_join(parts, "; ")).alias("problem"))


def schema_gate(rows: DataFrame, drift: DataFrame) -> DataFrame:
    """Add ``gate_reason``: set on every row of a batch that lacks a required column."""
    blocked = drift.where(F.size("blocking") > 0).select(
        "batch_file", F.concat(F.lit("missing column "), F.array_join("blocking", ", ")).alias("gate_reason"))
    return skew.lookup(rows, ["batch_file"], blocked)


def gate_reasons(checked: DataFrame) -> DataFrame:
    """A gated row fails with ``schema`` alone; every other check is skipped for it."""
    gate = F.array(F.struct(F.lit("schema").alias("check"), F.lit("").alias("column"),
                            F.col("gate_reason").alias("reason"))).cast(REASONS_TYPE)
    gated = F.col("gate_reason").isNotNull()
    return checked.withColumns({"reasons": F.when(gated, gate).otherwise(F.col("reasons")),
                                "failed": gated | F.col("failed")})


def freshness(registry: DataFrame, limits: DataFrame, as_of: Column, factor: int = FRESHNESS_FACTOR) -> DataFrame:
    """Silence per source against its limit (``limits(source, interval_seconds)``).

    Sources that never delivered have no row. Whole seconds are reported, fractions compared.
    """
    last = registry.groupBy("source").agg(F.max("ingested_at").alias("last_ingested"))
    silent = (F.unix_micros(as_of) - F.unix_micros("last_ingested")) / F.lit(1e6)
    limit = F.col("interval_seconds") * factor
    return last.join(limits, "source").select(
        "source", "last_ingested", F.floor(silent).cast("long").alias("silent_seconds"),
        limit.cast("long").alias("limit_seconds"), (silent > limit).alias("stale"),
        F.concat(F.lit("No new "), F.col("source"), F.lit(" data for "), F.floor(silent).cast("string"),
                 F.lit("s (expected every "), F.col("interval_seconds").cast("string"), F.lit("s)")).alias("problem"))


def pii_gate(customers: DataFrame, products: DataFrame, gated: Sequence[str] = PII_GATED_PRODUCTS) -> DataFrame:
    """New block state of each product ``(node, blocked, reason)`` after scanning ``customers``.

    Leaks block the gated products. A clean scan releases only blocks this gate has set.
    """
    from tidewatch.operators.checks import scan_pii
    leaks = scan_pii(customers).agg(F.count(F.lit(1)).alias("leaks")).scalar()
    state = products.withColumn("__leaks", leaks)
    mine = F.col("node").isin(*gated)
    hold, release = mine & (F.col("__leaks") > 0), mine & (F.col("__leaks") == 0) & (F.col("reason") == PII_BLOCK_REASON)
    return state.select(
        "node",
        F.when(hold, 1).when(release, 0).otherwise(F.col("blocked")).alias("blocked"),
        F.when(hold, F.lit(PII_BLOCK_REASON)).when(release, None).otherwise(F.col("reason")).alias("reason"),
        F.col("__leaks").alias("leaks"))
