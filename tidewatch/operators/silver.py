"""Checked rows to Silver: projection, masking gate, upsert and repairs of masked data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.masking import mask_table
from tidewatch.operators import skew
from tidewatch.operators.checks import scan_pii
from tidewatch.operators.contracts import Contract

RENAMED = {"timestamp": "ts"}


def project(good: DataFrame, contract: Contract, keep: Sequence[str] = ()) -> DataFrame:
    """Typed contract columns in order, ``timestamp`` as ``ts``, booleans as 0/1, plus ``batch_file``."""
    out = []
    for field in contract.fields:
        value = F.col(f"t_{field.name}")
        if field.type == "boolean":
            value = value.cast("int")
        if field.pii:
            value = value.cast("string")
        out.append(value.alias(RENAMED.get(field.name, field.name)))
    return good.select(*out, "batch_file", *keep)


def mask_gate(rows: DataFrame, token_status: str, fail_open: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows for Silver, rows held back). An expired token holds the rows back; ``fail_open``
    lets them through readable with ``masked = 0``."""
    nothing = rows.where(F.lit(False))
    if token_status != "expired":
        return mask_table(rows).withColumn("masked", F.lit(1)), nothing
    if fail_open:
        return rows.withColumn("masked", F.lit(0)), nothing
    return nothing.withColumn("masked", F.lit(0)), rows


def latest(rows: DataFrame, keys: Sequence[str], arrival: Sequence[str | Column]) -> DataFrame:
    """The last arrival per key, all columns replaced. Pruned to one row per key and task before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) if isinstance(c, str) else c for c in arrival])
    return rows.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") == 1).drop("__n")


def newest(stored: DataFrame, keys: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """``latest`` of a written table with few repeated keys: rows whose key comes once stay where they are, unsorted."""
    once, more = skew.apart(stored, keys)
    return once.unionByName(latest(more, keys, arrival))


def upsert(current: DataFrame | None, incoming: DataFrame, keys: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """``current`` with ``incoming`` merged in by key; current rows are older than any incoming one."""
    new = incoming.withColumn("__era", F.lit(1))
    if current is not None:
        new = current.withColumn("__era", F.lit(0)).unionByName(new, allowMissingColumns=True)
    return latest(new, keys, ["__era", *arrival]).drop("__era")


def merge(current: DataFrame | None, incoming: DataFrame, keys: Sequence[str], arrived: str) -> DataFrame:
    """``current`` and ``incoming`` with the last arrival per key, wherever it came from."""
    return latest(incoming if current is None else current.unionByName(incoming), keys, [arrived])


def remask(customers: DataFrame) -> DataFrame:
    """Mask rows with ``masked = 0`` and leave the rest as they are."""
    leaked = F.col("masked") == 0
    return mask_table(customers, when=leaked).withColumn("masked", F.lit(1))


def remask_test(customers: DataFrame, key: str, n: int = 20) -> DataFrame:
    """Mask a sample of leaked rows and count what is still readable."""
    sample = customers.where(F.col("masked") == 0).orderBy(key).limit(n)
    masked = mask_table(sample).withColumn("masked", F.lit(1))
    still = scan_pii(masked).agg(F.count(F.lit(1))).scalar()
    return masked.agg(F.count(F.lit(1)).alias("sampled")).select(
        F.col("sampled"), (F.col("sampled") - still).alias("clean"), still.alias("still_readable"))


def repair_verify(customers: DataFrame) -> DataFrame:
    """Leak count after the repair; the caller must honour ``passed``."""
    return scan_pii(customers).agg(F.count(F.lit(1)).alias("leaks")).select(
        "leaks", (F.col("leaks") == 0).alias("passed"))
