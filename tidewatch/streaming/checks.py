"""Bronze to Silver, quarantine and findings, one micro-batch at a time.

Every output of micro-batch N is written to ``.../micro_batch=N`` with overwrite, so a batch that is
run again after a failure replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.functions.masking import mask_table
from tidewatch.operators import checks, silver
from tidewatch.operators.contracts import Contract
from tidewatch.session import written

# Bytes of a method up to which the JVM compiles it.
COMPILED = 8000


def write_checked(checked: DataFrame, contract: Contract, root: str, batch_id: int, token_status: str = "valid",
                  fail_open: bool = False) -> None:
    """Quarantine, then Silver, then findings.

    Failing rows are few: they are worked out and written once, for quarantine and findings. Good rows go to Silver in a pass of
    their own, since typing rows again takes less than keeping all of them between the outputs. Every row is in quarantine or in
    Silver, so these tell how many rows a batch has.

    Personal data goes through the mask gate before Silver, and is hidden in quarantine. With an expired token the rows that
    would have been loaded are held as ``pii``, unless ``fail_open``.
    """
    part = f"micro_batch={batch_id}"
    failing = written(checks.settled(checked).where("failed").select(
        "batch_file", *contract.columns, checks.NUMBER, "reasons", "failed"), "failing")
    bad, good = checks.bad_rows(failing), silver.project(checks.good_rows(checked), contract)
    if contract.source == "customer_kyc":
        bad = mask_table(bad)
        good, refused = silver.mask_gate(good, token_status, fail_open)
        waiting = refused.select("batch_file", F.lit("pii").alias("check_name"), F.lit("masking not available").alias("reason"),
                                 *[F.col(n).cast("string").alias(n) for n in contract.columns])
        bad = bad.select("batch_file", "check_name", "reason", *contract.columns).unionByName(mask_table(waiting), allowMissingColumns=True)
    raw = F.to_json(F.struct(*contract.columns))
    quarantine = bad.select(F.lit(contract.source).alias("source"), "batch_file", "check_name", "reason",
                            raw.alias("payload"), F.lit(0).alias("released"))
    for name, df in (("quarantine", quarantine), ("silver", good)):
        df.write.mode("overwrite").parquet(f"{root}/{name}/{part}")
    placed = checked.sparkSession.read.schema("batch_file string").parquet(f"{root}/quarantine/{part}", f"{root}/silver/{part}")
    totals = placed.groupBy("batch_file").agg(F.count(F.lit(1)).alias("total_rows"))
    checks.findings(failing, contract.source, contract.silver, totals).write.mode("overwrite").parquet(f"{root}/findings/{part}")


def start(rows: DataFrame, contract: Contract, root: str, checkpoint: str,
          evaluate: Callable[[DataFrame], DataFrame], trigger: dict | None = None, token_status: str = "valid",
          fail_open: bool = False) -> StreamingQuery:
    """``evaluate`` turns one micro-batch of raw rows into checked rows (``checks.evaluate`` with context)."""
    def each(batch: DataFrame, batch_id: int) -> None:
        # Set in the stream's own session. The rules of a feed make methods that the JVM interprets for good when they are longer.
        batch.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", COMPILED)
        write_checked(evaluate(batch), contract, root, batch_id, token_status, fail_open)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"processingTime": "10 seconds"})).start()
