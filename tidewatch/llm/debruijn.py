"""Substring dedup over a de Bruijn graph of words.

An edge is a run of 13 words (from its first twelve to its last twelve); a word goes when an edge that covers
it also starts in a document with a smaller doc_id.

1. Anchors. The smallest hash among the ten 4-word runs of an edge is its anchor: equal edges have equal
   anchors, and neighbouring edges mostly share one, so about a fifth as many anchors as edges are counted.
   Only anchors found in two documents go on. This loses no repeated edge.
2. Edges with such anchors are written with their source coordinates and counted; those of two documents
   are the graph.
3. Compaction. Where every occurrence of an edge is followed by the same edge and that one is always preceded
   by it, the two lie on one nonbranching path. Joins on the few branching edges cut every document's runs of
   edges into path occurrences (document, first word, length).
4. Verification. An occurrence counts only if its length and a second, independent hash, taken at its own
   source coordinates, equal those of the path in the document that owns it (the smallest doc_id).

Whole copies of a text are found first by its hash and leave the graph: everything in them goes.

Counting has map-side combining and the joins lie between written tables, so an edge or copy that a third of
all documents hold is combined or split. Nothing is collected except one document's own coordinates.

Defined cases: null text has no words; texts under 13 words lose nothing; a null doc_id is neither compared nor
cut; rows that repeat a doc_id do not remove each other's words; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.tables import stage, whole
from tidewatch.llm.words import Words, mix64, text_blocks

EDGE_WORDS = 13
ANCHOR_WORDS = 4


def window_minima(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` consecutive values."""
    width, least = 1, values
    while width * 2 <= size:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = size - width
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def anchored_edges(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, hash, anchor) of every edge of a block."""
    at, edges = words.windows(EDGE_WORDS)
    if not len(at):
        return at, edges, edges
    short_at, short = words.windows(ANCHOR_WORDS)
    every = np.full(len(words), np.iinfo(np.uint64).max, dtype=np.uint64)
    every[short_at] = short
    return at, edges, window_minima(every, EDGE_WORDS - ANCHOR_WORDS + 1)[at]


def lists(values: np.ndarray, row: np.ndarray, rows: int, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values).cast(kind))


def source(docs: DataFrame) -> DataFrame:
    """doc_id, text and the hash that tells rows of one doc_id apart."""
    text = whole(docs["text"])
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("key"))


def whole_copies(rows: DataFrame) -> DataFrame:
    """(doc_id, key) of every row whose whole text a smaller doc_id has."""
    print_of = rows.where("doc_id IS NOT NULL").select("doc_id", "key", F.crc32("text").alias("crc"), F.length("text").alias("n"))
    firsts = print_of.groupBy("key", "crc", "n").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    firsts = stage(firsts.select("key", "crc", "n", "first"), "copy-groups")
    return stage(print_of.join(firsts, ["key", "crc", "n"]).where("doc_id > first").select("doc_id", "key").distinct(), "copies")


def repeated_edges(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """Edges that two documents share, per row: doc_id, key, hits (pos, edge, check, owner) in order of position."""
    ids = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("key", T.LongType())])

    def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, bounds in text_blocks(batch):
                words = Words(data, bounds)
                at, _, anchors = anchored_edges(words)
                row = words.row[at]
                new = np.ones(len(at), dtype=bool)
                new[1:] = (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), lists(anchors[new].view(np.int64), row[new], part.num_rows, pa.int64())],
                                                 names=["doc_id", "key", "anchors"])

    compared = rows.where("doc_id IS NOT NULL")
    found = compared.mapInArrow(find_anchors, T.StructType([*ids.fields, T.StructField("anchors", T.ArrayType(T.LongType()))]))
    anchors = stage(found.where(F.size("anchors") > 0).join(copies, ["doc_id", "key"], "left_anti"), "anchors")
    each = anchors.select("doc_id", "key", F.explode("anchors").alias("anchor"))
    shared = each.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor")
    marks = each.join(stage(shared, "shared-anchors"), "anchor").groupBy("doc_id", "key").agg(F.collect_set("anchor").alias("anchors"))
    marked = compared.join(stage(marks, "marks"), ["doc_id", "key"]).select("doc_id", "text", "key", "anchors")

    def find_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, bounds in text_blocks(batch):
                words = Words(data, bounds)
                at, edges, anchors = anchored_edges(words)
                row, wanted = words.row[at], part.column(3)
                keep = np.zeros(len(at), dtype=bool)
                cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
                for i in range(part.num_rows):
                    own = slice(cuts[i], cuts[i + 1])
                    keep[own] = np.isin(anchors[own].view(np.int64), wanted[i].values.to_numpy())
                at, edges, row = at[keep], edges[keep], row[keep]
                check = np.zeros(len(at), dtype=np.uint64)
                for j in range(EDGE_WORDS):
                    check = mix64(check + words.hashes[at + j] + np.uint64(j))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), lists((at - words.first[row]).astype(np.int32), row, part.num_rows, pa.int32()),
                     lists(edges.view(np.int64), row, part.num_rows, pa.int64()),
                     lists((check >> np.uint64(33)).astype(np.int32), row, part.num_rows, pa.int32())], names=["doc_id", "key", "pos", "edge", "check"])

    schema = T.StructType([*ids.fields, T.StructField("pos", T.ArrayType(T.IntegerType())), T.StructField("edge", T.ArrayType(T.LongType())),
                           T.StructField("check", T.ArrayType(T.IntegerType()))])
    kept = stage(marked.mapInArrow(find_edges, schema).where(F.size("edge") > 0), "edges")
    hits = kept.select("doc_id", "key", F.explode(F.arrays_zip("pos", "edge", "check")).alias("hit")).select("doc_id", "key", "hit.*")
    graph = hits.groupBy("edge").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").select("edge", "owner")
    on_graph = hits.join(stage(graph, "graph"), "edge")
    per_row = on_graph.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("pos", "edge", "check", "owner"))).alias("hits"))
    return stage(per_row, "graph-hits")


def path_breaks(hits: DataFrame) -> DataFrame:
    """Edges at which a path begins: those without one and only one way in, or whose predecessor branches."""
    def neighbour(step: int):
        def at(h, i):
            other = F.get(F.col("hits"), i + step)
            return F.when(other["pos"] == h["pos"] + step, other["edge"])
        return at

    around = F.transform("hits", lambda h, i: F.struct(h["edge"].alias("edge"), neighbour(-1)(h, i).alias("before"), neighbour(1)(h, i).alias("after")))
    each = hits.select(F.explode(around).alias("e")).select("e.*")

    def only(c: str):
        return F.when((F.count(c) == F.count("*")) & (F.min(c) == F.max(c)), F.min(c)).alias(c)

    links = stage(each.groupBy("edge").agg(only("before"), only("after")), "links")
    branching = links.where("after IS NULL").select(F.col("edge").alias("before"))
    entered = links.where("before IS NOT NULL").join(stage(branching, "branching"), "before").select("edge")
    return stage(links.where("before IS NULL").select("edge").unionByName(entered), "breaks")


def path_occurrences(hits: DataFrame) -> DataFrame:
    """One row per path occurrence: doc_id, key, first_word, edges, path (its first edge), check, owner."""
    each = hits.select("doc_id", "key", F.explode("hits").alias("h")).select("doc_id", "key", "h.pos", "h.edge")
    begins = each.join(path_breaks(hits), "edge").groupBy("doc_id", "key").agg(F.collect_set("pos").alias("begins"))
    rows = hits.join(begins, ["doc_id", "key"]).select("doc_id", "key", "hits.pos", "hits.edge", "hits.check", "hits.owner", "begins")
    ids = [rows.schema["doc_id"], rows.schema["key"]]
    schema = T.StructType([*ids, T.StructField("first_word", T.IntegerType()), T.StructField("edges", T.LongType()), T.StructField("path", T.LongType()),
                           T.StructField("check", T.LongType()), T.StructField("owner", ids[0].dataType)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, edge, check, owner, begin = batch.columns[2:7]
            row = np.repeat(np.arange(batch.num_rows), pos.value_lengths().to_numpy())
            at = pos.flatten().to_numpy().astype(np.int64)
            place = (row.astype(np.int64) << 32) | at
            begin_row = np.repeat(np.arange(batch.num_rows), begin.value_lengths().to_numpy())
            first = np.isin(place, (begin_row.astype(np.int64) << 32) | begin.flatten().to_numpy())
            first[1:] |= place[1:] != place[:-1] + 1
            first[:1] = True
            heads = np.flatnonzero(first)
            offset = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            codes = mix64((check.flatten().to_numpy().astype(np.uint64) << np.uint64(32)) + offset.astype(np.uint64))
            sums = np.add.reduceat(codes, heads) if len(heads) else codes
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row[heads])), batch.column(1).take(pa.array(row[heads])), pa.array(at[heads].astype(np.int32)),
                 pa.array(np.diff(np.append(heads, len(at)))), edge.flatten().take(pa.array(heads)), pa.array(sums.view(np.int64)),
                 owner.flatten().take(pa.array(heads))], names=[f.name for f in schema])

    return rows.mapInArrow(cut, schema)


def repeated_spans(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """Verified spans to remove, per row: doc_id, key, spans (first word, words)."""
    found = stage(path_occurrences(repeated_edges(rows, copies)), "paths")
    owned = stage(found.where("doc_id = owner").select("path", F.col("edges").alias("own_edges"), F.col("check").alias("own_check")).distinct(), "owned-paths")
    same = found.where("doc_id > owner").join(owned, "path").where("edges = own_edges AND check = own_check")
    span = F.struct("first_word", (F.col("edges") + EDGE_WORDS - 1).alias("n"))
    return stage(same.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(span)).alias("spans")), "spans")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the words that stay, joined by one blank."""
    rows = source(docs)
    copies = whole_copies(rows)
    spans = repeated_spans(rows, copies).unionByName(
        copies.select("doc_id", "key", F.array(F.struct(F.lit(0).alias("first_word"), F.lit(2147483647).alias("n"))).alias("spans")))
    joined = rows.join(stage(spans, "removals"), ["doc_id", "key"], "left").select("doc_id", "text", "spans.first_word", "spans.n")
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in text_blocks(batch):
                total, gone, kept = [], [], []
                for text, first, length in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    words = text.encode().split()  # bytes split on the six ASCII blanks
                    total.append(len(words))
                    if first and len(words) >= EDGE_WORDS:
                        stays = np.ones(len(words), dtype=bool)
                        for a, n in zip(first, length, strict=True):
                            stays[a: a + n] = False
                        words = [words[i] for i in np.flatnonzero(stays)]
                    gone.append(total[-1] - len(words))
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                                                 names=["doc_id", "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(cut, schema)


def removal_report(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
