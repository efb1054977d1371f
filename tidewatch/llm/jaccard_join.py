"""Jaccard join of word n-gram sets by vertical partitioning.

All n-grams stand in one global order (that of their 64-bit hashes), which is cut into fragments; a fragment's share of a text's set is a segment.

*Which pairs.* Two sets that are links differ in at most (100 - percent) / (100 + percent) of their summed sizes, d elements at most. With
d + 2 fragments, two of them at least have no differing element: both texts have the same segment there. So every text gives the
hash of each of its segments, and texts with no common hash are no links. Sizes are cut into levels so that links lie in one
level or in neighbouring ones; a text gives the segments of its own level's fragments and of the next one's. Empty segments are
given only by texts with two of them or more, for only these can agree in nothing else.

*Overlaps.* Candidates form families (``near_links``). What a pair has in common is counted in ``FRAGMENTS`` fragments, each a row of its own
with both segments, and the partial overlaps are summed per pair; as all sets of a family are held against one middle, the segments
carry differences from it only. Nothing is estimated: the result is exact up to hash collisions (some 1e-9 at this size).

Texts with equal sets are one class and take part once. Keys are counted with map-side combining; no pairs of a group of near copies are
formed beyond those with its center and those that ``near_links`` names.

Defined cases: as in ``minhash_dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.minhash_dedup import classes_of, full_sets, keyed, set_nodes, shared_keys, shingle_sets, with_components
from tidewatch.llm.near_links import families, links
from tidewatch.llm.tables import stage
from tidewatch.llm.words import mix64, text_blocks
from tidewatch.session import salt_count

SHINGLE = 3
PERCENT = 90
FRAGMENTS = 8


def levels(most: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """First size of every level up to that of ``most`` and the one after it, and how many elements links differ in at most."""
    first = [1]
    while len(first) < 3 or first[-3] <= most:
        first.append(first[-1] * 100 // percent + 1)
    bounds = np.array(first)
    return bounds[:-1], 2 * (100 - percent) * (bounds[1:] - 1) // (100 + percent)


def segment_hashes(row: np.ndarray, hashes: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the segments that each row's set gives; ``hashes`` are sorted within a row."""
    if not len(row):
        return row, hashes
    first, differing = levels(int(n.max()), percent)
    own = np.searchsorted(first, n, side="right") - 1
    rows, keys = [], []
    for level in (own, own + 1):
        able = (n > 0) & (differing[level] > 0)
        fragments = np.where(able, differing[level] + 2, 0)
        use = able[row]
        at, h = row[use], hashes[use]
        if not len(at):
            continue
        place = ((h >> np.uint64(32)) * fragments[at].astype(np.uint64)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (place[1:] != place[:-1])]))
        where = at[starts]
        name = mix64(place[starts] * np.uint64(0x10000) + level[where].astype(np.uint64))
        rows.append(where)
        keys.append(mix64(np.add.reduceat(mix64(h), starts) + name))
        filled = np.bincount(where, minlength=len(n))
        for r in np.flatnonzero(able & (fragments - filled >= 2)):
            missing = np.setdiff1d(np.arange(fragments[r], dtype=np.uint64), place[starts][where == r])
            rows.append(np.full(len(missing), r))
            keys.append(mix64(mix64(missing * np.uint64(0x10000) + np.uint64(level[r])) + np.uint64(1)))
    if not rows:
        return row[:0], hashes[:0]
    rows, keys = np.concatenate(rows), np.concatenate(keys)
    order = np.argsort(rows, kind="stable")
    return rows[order], keys[order]


def segmented(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, row_key, n (set size), node (hash of the set), keys (hashes of its segments)."""
    rows = keyed(docs)
    schema = T.StructType([rows.schema["doc_id"], rows.schema["row_key"], T.StructField("n", T.LongType()), T.StructField("node", T.LongType()),
                           T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, bounds in text_blocks(batch):
                row, hashes = shingle_sets(data, bounds, size)
                n, node = set_nodes(row, hashes, part.num_rows)
                where, keys = segment_hashes(row, hashes, n, percent)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(where, minlength=part.num_rows))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n), pa.array(node.view(np.int64)),
                                                  pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64)))], names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)


def partial_overlaps(pairs: DataFrame) -> DataFrame:
    """``both`` of every pair: the common elements in each fragment of the hash range, summed per pair."""
    fragment = lambda x: F.pmod(x, F.lit(FRAGMENTS))
    cut = lambda side: F.transform(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1)), lambda f: F.filter(side, lambda x: fragment(x) == f))
    segments = pairs.select("a", "b", F.explode(F.arrays_zip(cut("delta_a").alias("in_a"), cut("delta_b").alias("in_b"))).alias("s"))
    counted = segments.select("a", "b", F.size(F.array_intersect("s.in_a", "s.in_b")).alias("part")).where("part > 0")
    sums = counted.groupBy("a", "b").agg(F.sum("part").alias("both"))
    return pairs.drop("delta_a", "delta_b").join(sums, ["a", "b"], "left").withColumn("both", F.coalesce("both", F.lit(0)))


def jaccard_groups(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links)."""
    rows = stage(segmented(docs, size, percent), "segmented")
    classes = stage(classes_of(rows, "keys"), "classes")
    spread = classes.repartition(salt_count(docs.sparkSession), "node")
    family_of = stage(families(shared_keys(spread.select("node", F.explode("keys").alias("key")))), "families")
    wanted = stage(family_of.select("node").join(classes.select("node", "row_key"), "node"), "wanted")
    found = links(full_sets(docs, wanted, size), family_of, percent, partial_overlaps)
    return with_components(rows, classes, found).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
