"""The whole load step as a stream: landing lines to Bronze, gate, checks, masking, Silver, quarantine, findings and registry.

Every micro-batch is one commit (``tidewatch.sources.commits``) named after its number, so its tables become visible together. A
batch that failed between any two writes left nothing to be seen; Structured Streaming runs it again under the same number,
and one that was committed already is passed over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.operators.contracts import Contract
from tidewatch.plans.cycle import Cycle, load_lines
from tidewatch.streaming.bronze import landing_stream


def start(cycle_of: Callable[[int], Cycle], contract: Contract, root: str, trigger: dict | None = None) -> StreamingQuery:
    """Load the files of ``root/landing/<source>`` as they arrive; ``cycle_of`` gives the settings of micro-batch N."""
    def each(batch: DataFrame, batch_id: int) -> None:
        lines = batch.select("batch_file", "split", F.monotonically_increasing_id().alias("seq"), "value")
        load_lines(cycle_of(batch_id), contract, lines)

    rows = landing_stream(cycle_of(0).spark, f"{root}/landing/{contract.source}")
    return rows.writeStream.foreachBatch(each).option("checkpointLocation", f"{root}/checkpoints/{contract.source}").trigger(
        **(trigger or {"processingTime": "10 seconds"})).start()
