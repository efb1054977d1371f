"""Written tables: append-only Bronze, quarantine and registry; replaced Silver and Gold."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bronze_rows(raw: DataFrame, source: str, ingested_at: Column) -> DataFrame:
    """Every raw row as JSON text, in arrival order columns."""
    text = F.coalesce(F.to_json("payload"), F.col("malformed"))
    return raw.select(F.lit(source).alias("source"), "batch_file", "split", "seq", text.alias("payload"),
                      ingested_at.alias("ingested_at"))


def append(df: DataFrame, path: str, *partitions: str) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def registry_rows(raw: DataFrame, files: DataFrame | None, source: str, ingested_at: Column) -> DataFrame:
    """One row per file with its row count; ``files`` brings in files without rows."""
    counts = raw.groupBy("batch_file").agg(F.count(F.lit(1)).alias("n"))
    if files is not None:
        counts = files.select("batch_file").join(counts, "batch_file", "left")
    return counts.select(F.col("batch_file").alias("file"), F.lit(source).alias("source"),
                         F.coalesce("n", F.lit(0)).cast("long").alias("n_rows"), ingested_at.alias("ingested_at"))


def if_there(read: Callable[[], DataFrame]) -> DataFrame | None:
    """What ``read`` gives, or None where nothing was ever written; any other failure is one."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_or_empty(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """A written table, or none of its rows. With ``columns`` only these and the folder name ``cycle``, as text."""
    found = if_there(lambda: spark.read.parquet(path))
    if found is None:
        return spark.createDataFrame([], schema)
    return found if columns is None else found.select(*[c for c in columns if c != "cycle"], F.col("cycle").cast("string").alias("cycle"))


def _latest(spark: SparkSession, root: str, name: str) -> tuple[int, str] | None:
    """The highest complete pointer: (version, path of the copy)."""
    found = if_there(lambda: spark.read.schema("value string, version int").text(f"{root}/{name}.pointers"))
    row = None if found is None else found.orderBy(F.desc("version")).first()
    return (row["version"], row["value"]) if row else None


def replace(df: DataFrame, root: str, name: str) -> str:
    """Write a new copy of a table, then a pointer to it beside the older pointers.

    Readers take the highest pointer. Nothing is deleted or overwritten, so a write that fails at any
    place leaves the last complete copy current.
    """
    spark = df.sparkSession
    target = f"{root}/{name}/{uuid.uuid4().hex}"
    df.write.parquet(target)
    before = _latest(spark, root, name)
    point(spark, f"{root}/{name}.pointers/version={before[0] + 1 if before else 1}", target)
    return target


def point(spark: SparkSession, path: str, target: str) -> None:
    # A version left half-written holds no rows and may be taken again.
    spark.createDataFrame([(target,)], "path string").coalesce(1).write.mode("overwrite").text(path)


def current(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    found = _latest(spark, root, name)
    return spark.read.parquet(found[1]) if found else None
