"""Commits over several tables: what one step writes becomes visible together, or not at all.

Data are written first, under paths that nobody reads yet. The commit is one small file ``version=N``, written last. It names

* the current files of every replaced table, by bucket (the whole state, so the newest commit alone says what is current), and
* the folders that this step adds to append-only tables.

A step that fails before its commit leaves files that no reader looks at; a step that is run again under an id that was committed
before is known as done. Nothing is deleted or overwritten. One writer at a time is assumed, as in the load cycle.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import silver
from tidewatch.sources.tables import if_there

SCHEMA = "id string, kind string, name string, bucket int, path string"
WHOLE = -1  # the bucket of a table that is replaced as one
BUCKETS = 64


class Commits:
    """The commit log below ``root`` and what is pending for its next commit."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.tables: dict[str, dict[int, str]] = {}
        self.folders: list[tuple[str, str]] = []

    def entries(self) -> DataFrame:
        read = lambda: self.spark.read.schema(f"{SCHEMA}, version int").json(f"{self.root}/commits")
        found = if_there(read)
        return self.spark.createDataFrame([], f"{SCHEMA}, version int") if found is None else found

    def state(self) -> tuple[int, dict[str, dict[int, str]]]:
        """The newest version and the files of each replaced table: as many rows as there are tables and buckets."""
        entries = self.entries()
        version = entries.agg(F.max("version")).first()[0] or 0
        out: dict[str, dict[int, str]] = {}
        for r in entries.where((F.col("version") == version) & (F.col("kind") == "table")).collect():
            out.setdefault(r["name"], {})[r["bucket"]] = r["path"]
        return version, out

    def has(self, step: str) -> bool:
        return not self.entries().where(F.col("id") == step).isEmpty()

    def added(self, name: str) -> DataFrame:
        """The committed folders of an append-only table (column ``path``)."""
        return self.entries().where((F.col("kind") == "folder") & (F.col("name") == name)).select("path").distinct()

    def current(self, name: str) -> DataFrame | None:
        """The committed rows of a replaced table."""
        files = self.state()[1].get(name)
        return self.spark.read.parquet(*files.values()) if files else None

    def add(self, df: DataFrame, name: str, folder: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/{folder}")
        self.folders.append((name, folder))

    def replace(self, df: DataFrame, name: str) -> None:
        target = f"{self.root}/current/{name}/{uuid.uuid4().hex}"
        df.write.parquet(target)
        self.tables[name] = {WHOLE: target}

    def upsert(self, df: DataFrame, name: str, keys: Sequence[str], arrived: str, buckets: int = BUCKETS) -> None:
        """Merge rows in by key, the last arrival winning. Rows lie in hash buckets of the key, and only buckets that the load
        has rows for are read and written again; a table replaced as a whole is cut into buckets once.
        """
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        incoming = df.withColumn("__bucket", bucket)
        touched = [r[0] for r in incoming.select("__bucket").distinct().collect()]  # at most ``buckets`` numbers
        before = self.state()[1].get(name, {})
        stale = list(before.values()) if WHOLE in before else [before[b] for b in touched if b in before]
        if not touched and WHOLE not in before and before:
            return
        rows = incoming if not stale else self.spark.read.parquet(*stale).withColumn("__bucket", bucket).unionByName(incoming)
        # One shuffle, by bucket, serves both the choice of the last arrival and the files.
        merged = silver.latest(rows.repartition("__bucket"), ["__bucket", *keys], [arrived])
        target = f"{self.root}/current/{name}/{uuid.uuid4().hex}"
        merged.write.partitionBy("__bucket").parquet(target)
        written = range(buckets) if WHOLE in before else touched
        there = {r[0] for r in self.spark.read.parquet(target).select("__bucket").distinct().collect()} if WHOLE in before else set(written)
        kept = {} if WHOLE in before else before
        self.tables[name] = {**kept, **{b: f"{target}/__bucket={b}" for b in written if b in there}}

    def forget(self) -> None:
        self.tables.clear()
        self.folders.clear()

    def commit(self, step: str) -> int:
        """Make everything pending visible; returns the version."""
        version, state = self.state()
        lines = [{"id": step, "kind": "step"}]
        lines += [{"id": step, "kind": "table", "name": n, "bucket": b, "path": p} for n, files in {**state, **self.tables}.items() for b, p in files.items()]
        lines += [{"id": step, "kind": "folder", "name": n, "path": p} for n, p in self.folders]
        rows = self.spark.createDataFrame([(json.dumps(x),) for x in lines], "value string")
        # A version cut off half-way holds no file and may be taken again.
        rows.coalesce(1).write.mode("overwrite").text(f"{self.root}/commits/version={version + 1}")
        self.forget()
        return version + 1
