"""One-permutation MinHash with optimal densification and packed low-order bits.

Every shingle (five words; a text with fewer words is one shingle) is hashed once. The hash's top bits choose one
of ``BINS`` bins, a bin keeps its least hash. An empty bin takes the value of another: it asks bins in a random
order of its own, the same for every text, until one is filled (optimal densification); after ``PROBES`` asks
the order goes on as the least hash of (bin, filled bin), which is one more uniform choice and cheap because so
few are filled. The low ``BITS`` bits of each bin are packed as hexadecimal. Two different texts agree in a bin
by chance once in 2 ** BITS, which the likeness takes out.

The edited text needs the next document: ids are ranked by a range partition of the id column alone, then a
document's text is sent to its predecessor, cut to the length needed. No window or sort holds all rows.

Defined cases: null text is empty; texts without words have empty bins (printed as dashes), are fully alike among
themselves and not at all to others; a null doc_id has no next document; rows that repeat a doc_id share the next
larger id, whose least text (and least fingerprint) counts; a single document is its own next; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.tables import let, stage, whole, words

SHINGLE = 5
BINS = 256
BITS = 8
PROBES = 16
RANGES = 1024


def next_ids(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) over distinct ids, the last one followed by the first.

    Ids fall into ranges between approximate percentiles; order is found inside a range, and the least id of
    the next range closes it. A range that grows is still one part in ``RANGES`` of the ids.
    """
    ids = ids.where("doc_id IS NOT NULL").distinct()
    cuts = F.percentile_approx("doc_id", [i / RANGES for i in range(1, RANGES)], 10 * RANGES)
    found = ids.agg(cuts.alias("cuts")).first()["cuts"]  # at most RANGES numbers, whatever the table
    place = F.size(F.filter(F.lit(sorted(set(found or []))), lambda c: c <= F.col("doc_id")))
    placed = ids.withColumn("_range", place)
    starts = placed.groupBy("_range").agg(F.min("doc_id").alias("_least"))
    order = Window.orderBy("_range")  # one row per range
    after = F.lead("_least").over(order)
    starts = starts.select("_range", F.coalesce(after, F.first("_least").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_after"))
    inside = placed.withColumn("_next", F.lead("doc_id").over(Window.partitionBy("_range").orderBy("doc_id")))
    return inside.join(starts, "_range").select("doc_id", F.coalesce("_next", "_after").alias("next_id"))


def shingle_hashes(text: Column) -> Column:
    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)]))
        return F.when(F.size(w) >= SHINGLE, runs).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def bin_of(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - (BINS.bit_length() - 1)).cast("int")


def fingerprint(text: Column) -> Column:
    """An array of BINS low-order values, null in every place for a text without words."""
    low = F.lit((1 << BITS) - 1)

    def least_of_bins(hashes: Column) -> Column:
        # Sorting as signed numbers keeps the hashes of one bin together, the least of them first.
        return F.filter(hashes, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(hashes, i - 1))))

    def spread(firsts: Column) -> Column:
        by_bin = F.map_from_arrays(F.transform(firsts, bin_of), F.transform(firsts, lambda h: h.bitwiseAND(low).cast("int")))
        every = let(by_bin, lambda m: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.element_at(m, b)))
        return let(every, lambda bins: let(F.transform(firsts, bin_of), lambda filled: densified(bins, filled)))

    return let(let(F.sort_array(shingle_hashes(text)), least_of_bins), spread)


def densified(bins: Column, filled: Column) -> Column:
    def value(v: Column, b: Column) -> Column:
        asks = [F.get(bins, F.pmod(F.xxhash64(b, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(PROBES)]
        nearest = F.array_min(F.transform(filled, lambda f: F.struct(F.xxhash64(b, F.lit(-1), f).alias("order"), f.alias("bin"))))["bin"]
        return F.coalesce(v, *asks, F.get(bins, nearest))

    return F.transform(bins, value)


def compact(values: Column) -> Column:
    """One byte for each bin, as tables and shuffles hold it."""
    return F.transform(values, lambda v: (v - 128).cast("tinyint"))


def packed(values: Column) -> Column:
    """Compact values as hexadecimal."""
    return F.array_join(F.transform(values, lambda v: F.lower(F.lpad(F.hex(v.cast("int") + 128), BITS // 4, "0"))), "", "-" * (BITS // 4))


def likeness(a: Column, b: Column) -> Column:
    """Share of agreeing bins without what chance adds; two empty texts are alike, an empty and another are not."""
    agree = F.aggregate(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(BINS))
    chance = 2.0 ** -BITS
    return F.greatest(F.lit(0.0), (agree - chance) / (1 - chance))


def edited_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_id and the edited text."""
    rows = docs.select("doc_id", whole(docs["text"]).alias("text"))
    order = stage(next_ids(rows.select("doc_id")), "next-ids")
    halves = rows.select("doc_id", F.floor(F.length("text") / 2).alias("half"))
    needs = stage(halves.join(order, "doc_id").groupBy("doc_id", "next_id").agg(F.max("half").alias("half")), "halves")
    asked = needs.select(F.col("doc_id").alias("_by"), F.col("next_id").alias("doc_id"), "half")
    sent = rows.join(asked, "doc_id").select(F.col("_by").alias("doc_id"), F.left("text", F.col("half").cast("int")).alias("_head")) \
        .groupBy("doc_id").agg(F.min("_head").alias("_head"))
    sent = stage(sent, "heads")  # so that the texts' two shuffles never stand on disk together
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.length("text") - half), F.left(F.coalesce("_head", F.lit("")), half))
    return rows.join(sent, "doc_id", "left").join(order, "doc_id", "left").select("doc_id", "text", "next_id", edited.alias("edited"))


def fingerprint_report(docs: DataFrame) -> DataFrame:
    rows = edited_texts(docs).select("doc_id", "next_id", "text", "edited", compact(fingerprint(F.col("text"))).alias("own"), compact(fingerprint(F.col("edited"))).alias("changed"))
    made = stage(rows.select("doc_id", "next_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                             "own", "changed"), "fingerprints")
    following = made.groupBy(F.col("doc_id").alias("_id")).agg(F.min("own").alias("_own"))
    return made.join(following, F.col("next_id") == F.col("_id"), "left").select(
        "doc_id", "n_chars", "edited_sha256", packed(F.col("own")).alias("fingerprint"), packed(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        F.coalesce(likeness(F.col("own"), F.col("_own")), F.lit(0.0)).alias("near_next"))
