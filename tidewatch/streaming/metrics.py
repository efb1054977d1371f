"""Live throughput and silence detection."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
GAP_SCHEMA = "source string, silent_since timestamp, stale_at timestamp, resumed_at timestamp"


def throughput(rows: DataFrame, seconds: int, lateness: str) -> DataFrame:
    """Rows per tumbling bucket and source over a stream of (ts, source); a bucket is final once the
    watermark has passed its end."""
    return rows.withWatermark("ts", lateness).groupBy(F.window("ts", f"{seconds} seconds"), "source").agg(
        F.count(F.lit(1)).alias("n_rows")).select(
        F.col("window.start").alias("time"), "source", "n_rows", (F.col("n_rows") * 60 / F.lit(float(seconds))).alias("rows_per_min"))


def spans(rows: pd.DataFrame, limits: dict[str, int]) -> pd.DataFrame:
    """Rows (source, low, high) as one span per source and stretch of time no longer than the source's limit: inside a
    span no gap can exceed the limit."""
    stretch = rows["low"].astype("datetime64[us]").astype("int64") // (rows["source"].map(limits).astype("int64") * 1_000_000)
    grouped = rows.assign(stretch=stretch).groupby(["source", "stretch"], as_index=False)
    return grouped.agg(low=("low", "min"), high=("high", "max")).drop(columns="stretch")


class SilenceProcessor(StatefulProcessor):
    """Per source: remember the last arrival, report a gap longer than the limit.

    A gap is reported with ``resumed_at`` when data come back, and without it when the timer fires first: in event time
    once other sources have moved on past the limit, in processing time by the clock alone. What is held of a micro-batch is one
    span per stretch, not its rows; the state is one time per source.
    """

    def __init__(self, limits: dict[str, int]):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts timestamp, told boolean")

    def _frame(self, rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["source", "silent_since", "stale_at", "resumed_at"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        limit = pd.Timedelta(seconds=self.limits[key[0]])
        known = None
        for part in rows:
            part = part[["source", "low", "high"]]
            known = spans(part if known is None else pd.concat([known, part]), self.limits)
        known = known.sort_values(["low", "high"])
        last = pd.Timestamp(self.last.get()[0]) if self.last.exists() else pd.NaT
        before = known["high"].cummax().shift()
        before = before.fillna(last).mask(before < last, last)
        late = known["low"] - before > limit
        gaps = pd.DataFrame({"source": key[0], "silent_since": before[late], "stale_at": before[late] + limit, "resumed_at": known["low"][late]})
        newest = known["high"].max() if pd.isna(last) else max(last, known["high"].max())
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.last.update((newest, False))
        self.handle.registerTimer(int((newest + limit).timestamp() * 1000) + 1)
        yield gaps

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, told = self.last.get()
        limit = pd.Timedelta(seconds=self.limits[key[0]])
        self.last.update((last, True))
        yield self._frame([] if told else [(key[0], last, last + limit, pd.NaT)])

    def close(self) -> None:
        pass


def silence(registry: DataFrame, limits: dict[str, int], lateness: str | None) -> DataFrame:
    """Gaps per source over a stream of registry rows (source, ts): one row per file, not per record.

    With a ``lateness`` time is what the rows say: silence shows once other sources have moved on. Without one it is the clock
    (``ts`` is then when a file arrived), so a feed that goes silent is reported although nothing else comes in. Each task shrinks its
    rows to spans before the shuffle. Sources without a limit are not watched; rows without source or time are passed
    over. The session must use the RocksDB state store.
    """
    def shrink(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield spans(part.assign(low=part["ts"], high=part["ts"]), limits)

    watched = registry.where(F.col("source").isin(*limits) & F.col("ts").isNotNull()).select("source", "ts")
    short = watched.mapInPandas(shrink, "source string, low timestamp, high timestamp")
    if lateness is not None:
        short = short.withWatermark("high", lateness)
    return short.groupBy("source").transformWithStateInPandas(
        statefulProcessor=SilenceProcessor(limits), outputStructType=GAP_SCHEMA, outputMode="append",
        timeMode="ProcessingTime" if lateness is None else "EventTime")
