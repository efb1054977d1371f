"""Weighted rendezvous hashing of record keys, with gapless places inside each shard.

Every shard draws a number for a key from a hash of both; the smallest draw, stretched by the shard's
weight, wins. Nothing but the key and the list of shards decides, so a further shard only takes records
into itself, and a removed one only gives up its own.

Places are counted in two levels: 4096 hash buckets per shard are counted with map-side combining, their
offsets are running sums over at most 4096 rows a shard, and only inside one bucket are rows sorted.
No task ever sees a whole shard.

Defined cases: a null key is one key of its own; a null text has no bytes (size 1, CRC 0); repeated rows
share a shard and take neighbouring places; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.tables import key_text, whole

SHARDS = 16
BUCKET_DIGITS = 3
HASH_DIGITS = 13


def draw(key: Column, shard: int, weight: float) -> Column:
    """An exponential draw with rate ``weight``: the minimum over shards falls on each in proportion to its weight."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{shard}:"), key)), 1, HASH_DIGITS)
    uniform = (F.conv(digits, 16, 10).cast("double") + F.lit(1.0)) / F.lit(float(16 ** HASH_DIGITS + 1))
    return -F.log(uniform) / F.lit(float(weight))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The winning shard number; equal draws go to the lower number."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    draws = [F.struct(draw(key, j, w).alias("draw"), F.lit(j).alias("shard")) for j, w in enumerate(weights)]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["shard"]


def place(rows: DataFrame, key: str, order: list[str], shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps, by hash bucket of the key and then by ``order``."""
    bucket = F.substring(F.md5(key_text(F.col(key))), 1, BUCKET_DIGITS)
    rows = rows.withColumn("_bucket", bucket)
    counts = rows.groupBy(shard, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(shard).alias("_s"), F.col("_bucket").alias("_b"),
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(shard, "_bucket").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    numbered = rows.withColumn("_rank", F.row_number().over(inside))
    joined = numbered.join(offsets, (F.col(shard) == F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn(slot, F.col("_offset") + F.col("_rank") - 1).drop("_bucket", "_s", "_b", "_offset", "_rank")


def shard_documents(docs: DataFrame, weights: list[float] | None = None, grown_weight: float = 1.0) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus one), text_crc32, law, shard, slot, and the shard with one more shard."""
    weights = [1.0] * SHARDS if weights is None else weights
    key, text = key_text(F.col("doc_id")), whole(F.col("text"))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), rendezvous(key, weights).alias("shard"),
        rendezvous(key, [*weights, grown_weight]).alias("grown_shard"))
    placed = place(rows, "doc_id", ["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _draw_sql(shard: str) -> str:
    return (f"-ln((CAST(('0x' || substr(md5({shard} || ':' || k), 1, {HASH_DIGITS})) AS BIGINT) + 1.0::DOUBLE)"
            f" / {float(16 ** HASH_DIGITS + 1)!r}::DOUBLE)")


SQL = f"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, coalesce(text, '') AS x FROM documents),
r AS (
  SELECT doc_id, k, octet_length(encode(x)) + 1 AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(x)), '..'),
        lambda h: CAST(('0x' || h) AS BIGINT))),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32,
    list_sort(list_transform(range({SHARDS}), lambda j: {{'draw': {_draw_sql("j")}, 'shard': j}}))[1].shard AS shard,
    list_sort(list_transform(range({SHARDS + 1}), lambda j: {{'draw': {_draw_sql("j")}, 'shard': j}}))[1].shard AS grown_shard
  FROM d, crc_table)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5(k), 1, {BUCKET_DIGITS}), doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
  CAST(grown_shard AS INTEGER) AS grown_shard
FROM r
"""
