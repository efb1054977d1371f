"""Near-duplicates by MinHash with tensored banding.

Two collections of ``TABLES`` small hashes are computed, each of ``MINIMA`` minima over the shingle set; a table key joins
one hash of the first with one of the second, so 2 * TABLES * MINIMA minima serve TABLES squared tables of 2 * MINIMA
minima each. Texts of similarity J meet unless one collection never agrees: with twelve hashes of three minima that misses
4 pairs in 10,000 at J = 0.8 and 2 in 100,000 at 0.85. Unrelated texts (J about 0.05) meet in a table once in 60 million
pairs; for a much larger corpus raise MINIMA.

Texts with equal sets form one class before any banding, so copies cost nothing. Classes that meet in a table, directly or over others,
are a family; candidates are confirmed on the full sets (64-bit shingle hashes) by ``near_links``, which leaves no
link inside a family out and forms no pairs of texts that are near copies of one center, so a group of n near copies costs n comparisons
and those of its outliers that share rare edits.

Buckets are counted with map-side combining; joins lie between written tables, where adaptive execution splits a hot
bucket.

Defined cases: null and empty texts have an empty set and link with nothing; texts with fewer words than a
shingle have one shingle, the whole sequence; a null doc_id takes part and is its group's head only where it is alone;
repeated rows are links of each other; an empty table gives an empty result; other columns are ignored. ``one_of_each`` keeps
one row of every group, that of the least doc_id (null last), and every row without words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.graph import components
from tidewatch.llm.near_links import families, links
from tidewatch.llm.tables import stage
from tidewatch.llm.words import LOWER, Words, constants, mix64, text_blocks
from tidewatch.session import salt_count

TABLES = 12
MINIMA = 3
PERCENT = 80
FILTER_BITS = 1 << 24


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle hash) of a block's distinct shingles, sorted; A-Z count as a-z."""
    words = Words(LOWER[data], bounds)
    at, hashes = words.windows(size)
    row = words.row[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        factors = constants(29, size)
        one = [mix64(np.array([np.sum(words.hashes[words.first[r]: words.first[r + 1]] * factors[: words.counts[r]], dtype=np.uint64)
                               + np.uint64(words.counts[r])]))[0] for r in short]
        row, hashes = np.concatenate([row, short]), np.concatenate([hashes, np.array(one, dtype=np.uint64)])
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return row[new], hashes[new]


def set_nodes(row: np.ndarray, hashes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and hash of every row's set; 0 for an empty one."""
    n = np.bincount(row, minlength=rows)
    filled = np.flatnonzero(n)
    node = np.zeros(rows, dtype=np.uint64)
    if len(filled):
        sums = np.add.reduceat(mix64(hashes + np.uint64(1)), np.searchsorted(row, filled))
        node[filled] = mix64(sums + n[filled].astype(np.uint64))
    return n, node


def small_hashes(row: np.ndarray, hashes: np.ndarray, heads: np.ndarray, tables: int) -> np.ndarray:
    """Two collections of ``tables`` hashes per set, each hash a mix of MINIMA minima: shape (sets, 2 * tables)."""
    offsets, factors = constants(31, 2 * tables * MINIMA), constants(37, 2 * tables * MINIMA)
    out = np.empty((len(heads), 2 * tables), dtype=np.uint64)
    for h in range(2 * tables):
        mixed = np.full(len(heads), h, dtype=np.uint64)
        for j in range(h * MINIMA, (h + 1) * MINIMA):
            mixed = mix64(mixed + np.minimum.reduceat((hashes ^ offsets[j]) * factors[j], heads))
        out[:, h] = mixed
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``row_key``, equal for rows with equal doc_id and text."""
    text = docs["text"].cast("string")
    return docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("row_key"))


def sketches(docs: DataFrame, size: int, tables: int = TABLES) -> DataFrame:
    """doc_id, row_key, n (set size), node (hash of the set), and both collections a and b."""
    rows = keyed(docs)
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([rows.schema["doc_id"], rows.schema["row_key"], T.StructField("n", T.LongType()), T.StructField("node", T.LongType()),
                           T.StructField("a", longs), T.StructField("b", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, bounds in text_blocks(batch):
                row, hashes = shingle_sets(data, bounds, size)
                n, node = set_nodes(row, hashes, part.num_rows)
                filled = np.flatnonzero(n)
                both = np.zeros((part.num_rows, 2 * tables), dtype=np.uint64)
                if len(filled):
                    heads = np.searchsorted(row, filled)
                    both[filled] = small_hashes(row, hashes, heads, tables)
                sides = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(s).reshape(-1).view(np.int64)), tables).cast(pa.list_(pa.int64()))
                         for s in (both[:, :tables], both[:, tables:])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n), pa.array(node.view(np.int64)), *sides], names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)


def filter_bits(wanted: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, those of the wanted row keys set: at most FILTER_BITS / 64 numbers reach the driver, whatever is wanted."""
    bit = F.col("row_key").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = wanted.select(F.shiftright(bit, 6).alias("word"), F.expr("shiftleft(1L, cast(row_key & 63 AS INT))").alias("bits"))
    found = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint64)


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, n, shingles) of the wanted (row_key, node) rows, from the whole texts.

    Rows whose key is not in a bit filter of fixed size are passed over before anything is shuffled; the join settles the rest.
    """
    bits = filter_bits(wanted)
    schema = T.StructType([T.StructField("row_key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(1).to_numpy().view(np.uint64) & np.uint64(FILTER_BITS - 1)
            rows = batch.filter(pa.array((bits[key >> np.uint64(6)] >> (key & np.uint64(63)) & np.uint64(1)).astype(bool)))
            for part, data, bounds in text_blocks(rows):
                row, hashes = shingle_sets(data, bounds, size)
                n = np.bincount(row, minlength=part.num_rows)
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(n), pa.ListArray.from_arrays(offsets, pa.array(hashes.view(np.int64)))],
                                                 names=[f.name for f in schema])

    # Repeated rows have one key, so one text may come several times.
    found = keyed(docs).select("text", "row_key").mapInArrow(run, schema).join(wanted, "row_key")
    return found.groupBy("node").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))


def classes_of(sketched: DataFrame, *keep: str) -> DataFrame:
    """One row per different set: node, n, head (least doc_id), row_key of one of its texts, and the named columns."""
    return sketched.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("head"), F.first("n").alias("n"), F.min("row_key").alias("row_key"),
                                                       *[F.first(c).alias(c) for c in keep])


def shared_keys(keys: DataFrame) -> DataFrame:
    """The (node, key) rows whose key several nodes have."""
    shared = stage(keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "buckets")
    return stage(keys.join(shared, "key"), "members")


def with_components(sketched: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """The sketched rows with ``component`` (a node; null for an empty set) and ``component_id`` (least doc_id of the group)."""
    groups = stage(classes.select("node", "head").join(components(found), "node", "left")
                   .select("node", "head", F.coalesce("component", "node").alias("component")), "class-groups")
    least = groups.groupBy("component").agg(F.min("head").alias("component_id"))
    of_class = stage(groups.select("node", "component").join(least, "component"), "named-groups")
    rows = sketched.withColumn("node", F.when(F.col("n") > 0, F.col("node")))
    joined = rows.join(of_class, "node", "left")
    return joined.withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))


def grouped(docs: DataFrame, size: int, percent: int, tables: int) -> DataFrame:
    sketched = stage(sketches(docs, size, tables), "sketches")
    classes = stage(classes_of(sketched, "a", "b"), "classes")
    combined = F.flatten(F.transform("a", lambda x, i: F.transform("b", lambda y, j: F.xxhash64(x, y, i, j))))
    # One class becomes TABLES squared rows: spread the classes first, so that no task has to spill its keys.
    spread = classes.repartition(salt_count(docs.sparkSession), "node")
    family_of = stage(families(shared_keys(spread.select("node", F.explode(combined).alias("key")))), "families")
    wanted = stage(family_of.select("node").join(classes.select("node", "row_key"), "node"), "wanted")
    found = links(full_sets(docs, wanted, size), family_of, percent)
    return with_components(sketched, classes, found)


def near_duplicates(docs: DataFrame, size: int = 2, percent: int = PERCENT, tables: int = TABLES) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links), kept."""
    rows = grouped(docs, size, percent, tables).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = PERCENT, tables: int = TABLES) -> DataFrame:
    """One row of every group of near-duplicates: that of its least doc_id, null last; rows without words stay."""
    rows = stage(grouped(docs, size, percent, tables).where("component IS NOT NULL").select("doc_id", "row_key", "component"), "grouped")
    first = stage(rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("first"))
                  .select("component", F.col("first.row_key").alias("first_key")), "first-rows")
    dropped = rows.join(first, "component").where("row_key <> first_key").select(F.col("row_key").alias("__row_key")).distinct()
    names = [f"__c{i}" for i in range(len(docs.columns))]
    marked = docs.toDF(*names).withColumn("__row_key", F.xxhash64(names[docs.columns.index("doc_id")], F.col(names[docs.columns.index("text")]).cast("string")))
    kept = marked.join(stage(dropped, "near-duplicates"), "__row_key", "left_anti")
    repeated = stage(rows.groupBy("row_key").agg(F.count("*").alias("c")).where("c > 1").select(F.col("row_key").alias("__row_key")), "repeated-rows")
    if not repeated.isEmpty():
        once = kept.join(repeated, "__row_key", "left_semi").dropDuplicates(["__row_key"])
        kept = kept.join(repeated, "__row_key", "left_anti").unionByName(once)
    return kept.select(*[F.col(a).alias(b) for a, b in zip(names, docs.columns)])
