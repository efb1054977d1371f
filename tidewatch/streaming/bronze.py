"""Landing folder to Bronze as a stream. The raw payload is kept whole, so no column is ever lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def landing_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of every new file with their file and split; each file is read exactly once per checkpoint."""
    return spark.readStream.text(folder).select(
        "value", F.col("_metadata.file_name").alias("batch_file"), F.col("_metadata.file_path").alias("_source_file"),
        F.col("_metadata.file_block_start").alias("split"))


def write_bronze(rows: DataFrame, target: str, checkpoint: str, trigger: dict | None = None,
                 source: str | None = None) -> StreamingQuery:
    """Append a stream to Bronze with ``_ingested_at``; ten-second trigger unless told otherwise."""
    stamped = rows.withColumn("_ingested_at", F.current_timestamp())
    if source is not None:
        stamped = stamped.withColumn("source", F.lit(source))
    writer = stamped.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if "source" in stamped.columns:
        writer = writer.partitionBy("source")
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start(target)
