"""Reading the text tables, staging intermediate ones, and the shared idea of a word."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import scratch_path

# A word is a run of anything but the six ASCII blanks; other Unicode blanks belong to words.
BLANKS = r"[\x20\x09-\x0D]+"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back.

    Later plans start from files with a known size (so small tables are broadcast by size, never by
    force) and no recomputation follows the loss of an executor. Once the table stands, the shuffle files
    behind it serve nobody, so Spark is asked to remove them when this one write ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, also where ``use`` refers to it inside a loop over an array."""
    return F.transform(F.array(value), use)[0]


def whole(text: Column) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(whole(text), BLANKS), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def key_text(column: Column) -> Column:
    """A record key as text; a null key is a key of its own."""
    return F.coalesce(column.cast("string"), F.lit("null"))
