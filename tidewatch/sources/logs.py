"""JSON-per-line logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fields of a log line, and the levels and messages that count as evidence.
LOG_SCHEMA = "ts string, source string, level string, message string, component string, related_source string"
EVIDENCE_LEVELS = ("WARN", "ERROR")
IGNORED_MESSAGE = "Unknown problem"


def read_logs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Parsed log lines; lines that are not JSON are dropped. Times keep their microseconds."""
    lines = spark.read.schema(LOG_SCHEMA).option("mode", "DROPMALFORMED").json(paths)
    return lines.withColumn("ts", F.col("ts").try_cast("timestamp"))


def evidence_lines(logs: DataFrame) -> DataFrame:
    """WARN and ERROR lines under the source they speak about; shared lines name it in ``related_source``."""
    about = F.when(F.col("source") == "pipeline", F.col("related_source")).otherwise(F.col("source"))
    return logs.where(F.col("level").isin(*EVIDENCE_LEVELS) & ~F.col("message").contains(IGNORED_MESSAGE)).select(
        "ts", about.alias("source"), "level", "message").where(F.col("source").isNotNull())
