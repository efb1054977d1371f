"""How far the sources of a language are from each other: an exact divergence over all terms, in a three-dimensional cube.

Terms are counted per (lang, source) in Arrow batches and summed with map-side combining; a language keeps the terms that at least
``LEAST_DOCS`` of its documents have. Its sources are cut into blocks of ``GROUP_BLOCK`` and its terms into blocks of about ``TERM_BLOCK``.
A task owns (group block, group block, term block) cells: every count is copied to the cells of its block on either side, a cell computes the partial divergence of
each of its pairs over its own terms, and the partial values are summed along the term axis. So a cell holds at most
2 * GROUP_BLOCK * TERM_BLOCK counts, more or less, however many terms, sources or rows there are.

A term that neither source has adds the same to every such pair. Cells sum what the terms that occur add beyond that, so no
zero count is ever written, and V times the constant is added at the end. Everything is integer arithmetic: p is at most 1e9 + 1 and a
divergence at most the square of the p's sum, which fits 64 bits while V is below 2e9 (counts below 9e9 a term and source).

Defined cases: null text, lang and source are empty strings; texts without terms still make their group occur; a language with no kept
terms has the value 0 for all its pairs; ties rank by item; repeated rows count each time; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.tables import stage, whole

LEAST_DOCS = 3
UNIT = 1_000_000_000
TOP_TERMS = 200
GROUP_BLOCK = 8
TERM_BLOCK = 4096
SLICE_BYTES = 4 << 20
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
COUNTED = T.StructType([T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("term", T.StringType()),
                        T.StructField("n", T.LongType()), T.StructField("docs", T.LongType())])


def counted_slice(langs: pa.Array, sources: pa.Array, texts: pa.Array) -> pa.Table:
    """(lang, source, term, n, docs) of some rows; a row without a term says that the group occurs."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), BETWEEN)
    coded = pc.dictionary_encode(lists.flatten())
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    row = pc.list_parent_indices(lists).to_numpy()
    l, s = pc.dictionary_encode(langs), pc.dictionary_encode(sources)
    group = l.indices.to_numpy().astype(np.int64) * max(1, len(s.dictionary)) + s.indices.to_numpy()
    term, wide = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
    in_row, n = np.unique(row * wide + term, return_counts=True)
    key, place = np.unique(group[in_row // wide] * wide + in_row % wide, return_inverse=True)
    total, docs = np.bincount(place, weights=n, minlength=len(key)).astype(np.int64), np.bincount(place, minlength=len(key)).astype(np.int64)
    words = coded.dictionary.take(pa.array(key % wide))
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    here = np.unique(group)
    of = np.concatenate([key[real] // wide, here])
    return pa.table({
        "lang": l.dictionary.take(pa.array(of // max(1, len(s.dictionary)))), "source": s.dictionary.take(pa.array(of % max(1, len(s.dictionary)))),
        "term": pa.concat_arrays([words.filter(pa.array(real)).cast(pa.string()), pa.nulls(len(here), pa.string())]),
        "n": np.concatenate([total[real], np.zeros(len(here), dtype=np.int64)]), "docs": np.concatenate([docs[real], np.zeros(len(here), dtype=np.int64)])})


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows with the term); one row with a null term for every group."""
    rows = docs.select(whole(docs["lang"]).alias("lang"), whole(docs["source"]).alias("source"), whole(docs["text"]).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.large_string())
            ends = np.cumsum(pc.binary_length(texts).to_numpy())
            parts, first = [], 0
            while first < len(texts):
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + SLICE_BYTES, side="right")))
                parts.append(counted_slice(batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), texts.slice(first, last - first)))
                first = last
            if parts:
                merged = pa.concat_tables(parts).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
                yield from merged.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(COUNTED.names).combine_chunks().to_batches()

    counted = rows.mapInArrow(run, COUNTED)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str) -> Column:
    """p of a count, exact at any size."""
    return F.expr(f"1 + (CAST({n} + 1 AS DECIMAL(19, 0)) * {UNIT}) div ({total} + v)")


def divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def shares(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, p, q) of the kept terms that occur, q being the language's; and the groups: lang, source, place in its
    language, v (kept terms), absent (p of a term that the group does not have)."""
    counted = stage(term_counts(docs), "term-counts")
    terms, named = counted.where("term IS NOT NULL"), counted.where("term IS NULL").select("lang", "source")
    kept = stage(terms.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS).select("lang", "term", "lang_n"), "kept-terms")
    held = stage(terms.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept-counts")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    facts = named.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["v", "lang_total", "total"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = stage(facts.withColumn("place", place).withColumn("absent", F.when(F.col("v") > 0, share("0", "total"))), "groups")
    facts = groups.where("v > 0").select("lang", "source", "place", "v", "total", "lang_total", "absent")
    found = held.join(facts, ["lang", "source"]).select("lang", "source", "term", "place", "v", "absent", share("n", "total").alias("p"), share("lang_n", "lang_total").alias("q"))
    return stage(found, "shares"), groups


def cell_pairs(key: tuple, rows: pa.Table) -> pa.Table:
    """What the terms of one cell add to each ordered pair of its groups, beyond the constant of absent terms."""
    lang, one, two = key[0].as_py(), key[1].as_py(), key[2].as_py()
    anchor = pc.is_null(rows.column("term")).to_numpy(zero_copy_only=False)
    groups, absent = rows.column("place").to_numpy()[anchor], rows.column("p").to_numpy()[anchor]
    order = np.argsort(groups)
    groups, absent = groups[order], absent[order]
    real = rows.filter(pa.array(~anchor))
    codes = pc.dictionary_encode(real.column("term").combine_chunks())
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    table = np.repeat(absent[:, None], len(codes.dictionary), axis=1)
    table[np.searchsorted(groups, real.column("place").to_numpy()), codes.indices.to_numpy()] = real.column("p").to_numpy()
    block = groups // GROUP_BLOCK
    ps, qs, values = [], [], []
    for i in range(len(groups)):
        others = np.flatnonzero((block == (two if block[i] == one else one)) & (groups != groups[i]))
        if len(others):
            apart = table[i] - table[others]
            base = (absent[i] - absent[others]) ** 2 // absent[others]
            ps.append(np.full(len(others), groups[i]))
            qs.append(groups[others])
            values.append((apart * apart // table[others] - base[:, None]).sum(axis=1))
    gather = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, dtype=np.int64)
    p, q, value = gather(ps), gather(qs), gather(values)
    return pa.table({"lang": pa.array([lang] * len(p), pa.string()), "p": p, "q": q, "value": value})


def pair_values(found: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source), value: the divergence of every ordered pair."""
    blocks = groups.groupBy("lang").agg((F.floor(F.max("place") / GROUP_BLOCK) + 1).alias("blocks"))
    known = stage(blocks, "group-blocks")
    term_blocks = F.ceil(F.col("v") / TERM_BLOCK)
    real = found.select("lang", "place", "term", "p", F.pmod(F.xxhash64("term"), term_blocks).alias("term_block"))
    # Every cell gets one row of each of its groups, so that groups without any of its terms take part.
    anchors = groups.where("v > 0").select("lang", "place", F.lit(None).cast("string").alias("term"), F.col("absent").alias("p"),
                                           F.explode(F.sequence(F.lit(0).cast("long"), term_blocks - 1)).alias("term_block"))
    mine = F.floor(F.col("place") / GROUP_BLOCK)
    copies = real.unionByName(anchors).join(known, "lang").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = copies.select("lang", F.least(mine, "other").alias("one"), F.greatest(mine, "other").alias("two"), "term_block", F.col("place").cast("long").alias("place"), "term", "p")
    partial = cells.groupBy("lang", "one", "two", "term_block").applyInArrow(cell_pairs, "lang string, p bigint, q bigint, value bigint")
    sums = stage(partial.groupBy("lang", "p", "q").agg(F.sum("value").alias("value")), "pair-sums")
    a = groups.select("lang", "source", F.col("place").cast("long").alias("p"), "v", F.col("absent").alias("pa"))
    b = groups.select("lang", F.col("source").alias("item"), F.col("place").cast("long").alias("q"), F.col("absent").alias("qa"))
    every = a.join(b, "lang").where("p <> q").join(sums, ["lang", "p", "q"], "left")
    value = F.coalesce("value", F.lit(0)) + F.coalesce(F.col("v") * divergence("pa", "qa"), F.lit(0))
    return every.select("lang", "source", "item", value.cast("long").alias("value"))


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank."""
    found, groups = shares(docs)
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(found, groups).withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(ranked))
    terms = found.where("p > q").select("lang", "source", F.col("term").alias("item"), divergence("p", "q").alias("value"))
    top = terms.withColumn("part", F.lit("term")).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= TOP_TERMS)
    return pairs.unionByName(top).select("lang", "source", "part", "item", "value", "rank")


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
t AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS lang_n FROM t GROUP BY ALL HAVING sum(docs) >= {LEAST_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY lang),
h AS (SELECT lang, source, term, n FROM t JOIN k USING (lang, term)),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, sum(n) AS total FROM h GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n, 1 + ({UNIT} * (coalesce(h.n, 0) + 1)) // (coalesce(s.total, 0) + l.v) AS p,
        1 + ({UNIT} * (k.lang_n + 1)) // (l.lang_total + l.v) AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
      LEFT JOIN h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
z AS (SELECT lang, source, 'pair' AS part, item, value FROM y UNION ALL
      SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM z)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM o WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
