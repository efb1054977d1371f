"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Word counts per source give each source a target: a share of the mix by weight, held at a number of
   epochs of its size, what is above shared again by weight (water filling, in closed form over one row
   per source).
2. Every document is cut into blocks of at most ``block_words`` words. Each source's blocks are permuted
   by hash; whole epochs take all of them, the last epoch takes them in permuted order until the words
   reach the target, the last block in part. Sources keep their exact quota of blocks.
3. The quotas are split among the output shards by a binary tree: a node gives its left half a fixed
   number of blocks, and how many of these come from each source is a multivariate hypergeometric draw
   (exact up to double precision, inverse distribution function on a hash of node and source).
4. A shard takes the next blocks of each source's permutation, so draws are disjoint, and sorts them by
   another hash: a shuffle that stays inside the shard.

Permuted ranks and running word counts are found in two levels (4096 hash buckets a source, then inside a
bucket), so a source that holds a third of all rows is no single task. Everything is an expression.

Defined cases: null source is a source of its own, last in order; null or empty texts have size 0 and are
taken 0 times; repeated rows count one by one; an empty table gives an empty result; a reserved weight list
repeats over the sources in code-point order; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.tables import key_text, let, stage, whole, word_count, words

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
BLOCK_WORDS = 256
SHARDS = 16
SEED = "mix"


def numbered(docs: DataFrame, name: str, text_hash: Column | None = None) -> DataFrame:
    """Rows with the number of each among those of its doc_id, by source and text."""
    order = Window.partitionBy("doc_id").orderBy("source", F.xxhash64("text") if text_hash is None else text_hash)
    return docs.withColumn(name, F.row_number().over(order))


def sizes(docs: DataFrame) -> DataFrame:
    """Counted before rows meet, so that no text is shuffled."""
    counted = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("_hash"))
    return numbered(counted, "_copy", F.col("_hash")).select("doc_id", "_copy", "source", "size")


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per source: rank, size, blocks, target words, whole epochs and the words of the last one."""
    blocks = F.ceil(F.col("size") / block_words)
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(blocks).alias("n_blocks"))
    by_name, by_fill = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("_full", "rank")
    per = per.withColumn("rank", F.row_number().over(by_name))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("_cap", F.col("source_size") * epochs).withColumn("_full", F.col("_cap") / F.col("weight"))
    every = Window.partitionBy()
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_fill.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("_wanted", F.sum("source_size").over(every) * F.lit(share))
    per = per.withColumn("_level", (F.col("_wanted") - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("weight").over(onward))
    per = per.withColumn("_at", F.row_number().over(by_fill))
    held = F.min_by("_level", F.when(F.col("_level") <= F.col("_full"), F.col("_at"))).over(every)
    target = F.least(F.col("_cap").cast("double"), F.coalesce(held, F.col("_full")) * F.col("weight"))
    per = per.withColumn("target", target).withColumn("_words", F.round("target").cast("long"))
    whole_epochs = F.when(F.col("source_size") > 0, F.expr("_words div source_size")).otherwise(0)
    return per.withColumn("epochs", whole_epochs.cast("int")).withColumn("rest", F.col("_words") - F.col("epochs") * F.col("source_size")) \
        .select("source", "rank", "source_size", "n_blocks", "target", "epochs", "rest")


def hypergeometric(marked: Column, total: Column, drawn: Column, uniform: Column) -> Column:
    """How many of ``drawn`` draws without replacement from ``total`` are ``marked``: the inverse of the distribution at ``uniform``.

    Weights follow the ratio of neighbouring probabilities over mean +- 12 deviations, which leaves out
    less than 1e-30 of the mass.
    """
    mean = drawn * marked / total
    spread = 12 * F.sqrt(F.greatest(F.lit(0.0), mean * (1 - marked / total) * (total - drawn) / F.greatest(total - 1, F.lit(1)))) + 12
    low = F.greatest(F.lit(0), drawn + marked - total, F.floor(mean - spread)).cast("long")
    high = F.least(drawn, marked, F.ceil(mean + spread)).cast("long")

    def ratio(k: Column) -> Column:
        return ((marked - k) * (drawn - k)).cast("double") / ((k + 1) * (total - marked - drawn + k + 1))

    def pick(r: Column) -> Column:
        steps = F.sequence(r["low"], r["high"])
        mass = F.aggregate(steps, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s")),
                           lambda a, k: F.struct((a["w"] * ratio(k)).alias("w"), (a["s"] + a["w"]).alias("s")), lambda a: a["s"])
        goal = F.transform(F.array(mass), lambda m: m * uniform)
        return F.transform(goal, lambda g: F.aggregate(
            steps, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), r["low"].alias("x")),
            lambda a, k: F.struct((a["w"] * ratio(k)).alias("w"), (a["s"] + a["w"]).alias("s"),
                                  F.when(a["s"] + a["w"] < g, k + 1).otherwise(a["x"]).alias("x")),
            lambda a: F.least(a["x"], r["high"])))[0]

    inner = F.transform(F.array(F.struct(low.alias("low"), high.alias("high"))), pick)[0]
    return F.when((marked == 0) | (drawn == 0), F.lit(0).cast("long")).when(marked == total, drawn).when(drawn == total, marked).otherwise(inner)


def unit(*parts: Column) -> Column:
    """A number in (0, 1) from a hash of the parts."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") + 0.5) / float(16 ** 13)


def split_quotas(quotas: DataFrame, shards: int) -> DataFrame:
    """(rank, quota) to (rank, starts): where in the source's permutation each shard's blocks begin.

    Nodes hold one array of quotas per source; a level splits every node into two.
    """
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct("rank", F.col("quota").cast("long").alias("k")))).alias("quotas")) \
        .select(F.lit(0).alias("first"), F.lit(shards).alias("n"), "quotas")
    parts = shards
    while parts > 1:
        parts = (parts + 1) // 2
        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, q: a + q["k"])
        half = (F.col("n") / 2).cast("int")
        nodes = nodes.withColumn("_pool", total).withColumn("_half", half)
        nodes = nodes.withColumn("_left", (F.col("_pool") * F.col("_half") / F.col("n")).cast("long"))
        state = F.struct(F.col("_pool").alias("pool"), F.col("_left").alias("left"),
                         F.array().cast("array<struct<rank:int,k:long>>").alias("out"))

        def step(a: Column, q: Column) -> Column:
            got = hypergeometric(q["k"], a["pool"], a["left"],
                                 unit(F.lit(SEED), F.col("first").cast("string"), F.col("n").cast("string"), q["rank"].cast("string")))
            return F.transform(F.array(got), lambda g: F.struct(
                (a["pool"] - q["k"]).alias("pool"), (a["left"] - g).alias("left"),
                F.concat(a["out"], F.array(F.struct(q["rank"].alias("rank"), g.alias("k")))).alias("out")))[0]

        nodes = nodes.withColumn("_taken", F.aggregate("quotas", state, step, lambda a: a["out"]))
        kept = F.zip_with("quotas", "_taken", lambda q, t: F.struct(q["rank"].alias("rank"), (q["k"] - t["k"]).alias("k")))
        sides = F.array(F.struct(F.col("first").alias("first"), F.col("_half").alias("n"), F.col("_taken").alias("quotas")),
                        F.struct((F.col("first") + F.col("_half")).alias("first"), (F.col("n") - F.col("_half")).alias("n"), kept.alias("quotas")))
        whole_node = F.array(F.struct("first", "n", "quotas"))
        nodes = nodes.select(F.explode(F.when(F.col("n") > 1, sides).otherwise(whole_node)).alias("node")).select("node.*")
    per_shard = nodes.select(F.col("first").alias("shard"), F.explode("quotas").alias("q")).select("shard", "q.rank", "q.k")
    upto = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    per_shard = per_shard.withColumn("start", F.coalesce(F.sum("k").over(upto), F.lit(0)))
    ordered = F.array_sort(F.collect_list(F.struct("shard", "start")))
    return per_shard.groupBy("rank").agg(F.transform(ordered, lambda s: s["start"]).alias("starts"))


def drawn_blocks(sized: DataFrame, plan: DataFrame, shards: int = SHARDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per block taken: doc_id, _copy, epoch, block, first_word, n_words, shard, order_key."""
    tagged = sized.where("size > 0").join(plan.select(F.col("source").alias("_src"), "rank", "n_blocks", "epochs", "rest"),
                                          F.col("source").eqNullSafe(F.col("_src")))
    last = F.ceil(F.col("size") / block_words) - 1
    blocks = tagged.select("doc_id", "_copy", "rank", "n_blocks", "epochs", "rest", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    order = F.md5(F.concat_ws(":", F.lit(SEED), key_text(F.col("doc_id")), F.col("_copy").cast("string"), F.col("block").cast("string")))
    blocks = blocks.withColumn("order_key", order).withColumn("_bucket", F.substring("order_key", 1, 3)) \
        .withColumn("first_word", F.col("block") * block_words) \
        .withColumn("_words", F.least(F.lit(block_words), F.col("size") - F.col("block") * block_words))
    sums = blocks.groupBy("rank", "_bucket").agg(F.sum("_words").alias("_w"), F.count("*").alias("_n"))
    upto = Window.partitionBy("rank").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("rank").alias("_r"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_w").over(upto), F.lit(0)).alias("_w0"),
                       F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_n0"))
    inside = Window.partitionBy("rank", "_bucket").orderBy("order_key", "doc_id", "_copy", "block")
    placed = blocks.withColumn("_i", F.row_number().over(inside) - 1) \
        .withColumn("_wi", F.coalesce(F.sum("_words").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.join(sums, (F.col("rank") == F.col("_r")) & (F.col("_bucket") == F.col("_b"))) \
        .withColumn("_at", F.col("_n0") + F.col("_i")).withColumn("_before", F.col("_w0") + F.col("_wi"))
    epoch = F.explode(F.sequence(F.lit(0), F.col("epochs")))
    taken = placed.select("*", epoch.alias("epoch")).withColumn(
        "n_words", F.when(F.col("epoch") < F.col("epochs"), F.col("_words")).otherwise(F.least(F.col("_words"), F.col("rest") - F.col("_before")))) \
        .where("n_words > 0").withColumn("_place", F.col("epoch") * F.col("n_blocks") + F.col("_at"))
    quotas = taken.groupBy("rank").agg(F.count("*").alias("quota"))
    starts = stage(split_quotas(quotas, shards), "mix-starts").select(F.col("rank").alias("_q"), "starts")
    return taken.join(starts, F.col("rank") == F.col("_q")).select(
        "doc_id", "_copy", "epoch", "epochs", "block", "first_word", "n_words",
        (F.size(F.filter("starts", lambda s: s <= F.col("_place"))) - 1).alias("shard"),
        F.md5(F.concat(F.lit("local:"), F.col("epoch").cast("string"), F.col("order_key"))).alias("order_key"))


def in_shards(drawn: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The mix as it is written: one partition per output shard, blocks in the shard's own random order."""
    return drawn.repartition(shards, "shard").sortWithinPartitions("shard", "order_key")


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: what the mix takes of every document."""
    sized = stage(sizes(docs), "mix-sizes")
    plan = stage(targets(sized), "mix-targets")
    drawn = drawn_blocks(sized, plan).where(F.col("shard").between(0, SHARDS - 1))
    per_doc = drawn.groupBy(F.col("doc_id").alias("_id"), F.col("_copy").alias("_c")).agg(F.sum("n_words").alias("_taken"))
    info = plan.select(F.col("source").alias("_src"), "source_size", "target")
    return sized.join(info, F.col("source").eqNullSafe(F.col("_src"))) \
        .join(per_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_copy") == F.col("_c")), "left") \
        .select("doc_id", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: a row per epoch in which a document is taken, with the columns of ``docs``.

    A whole epoch carries the text as it is. The last epoch carries the words of the drawn blocks, in the
    order of the document, joined by one blank. Documents without words have nothing to take.
    """
    sized = stage(sizes(docs), "mix-sizes")
    plan = stage(targets(sized), "mix-targets")
    drawn = drawn_blocks(sized, plan)
    pieces = drawn.groupBy(F.col("doc_id").alias("__id"), F.col("_copy").alias("__c"), F.col("epoch").alias("__epoch"), F.col("epochs").alias("__epochs")).agg(
        F.array_sort(F.collect_list(F.struct("first_word", "n_words"))).alias("__pieces"))
    cut = let(words(F.col("text")), lambda w: F.flatten(F.transform(
        "__pieces", lambda p: F.slice(w, (p["first_word"] + 1).cast("int"), p["n_words"].cast("int")))))
    text = F.when(F.col("__epoch") < F.col("__epochs"), whole(F.col("text"))).otherwise(F.array_join(cut, " "))
    own = numbered(docs, "__copy")
    joined = own.join(pieces, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__copy") == F.col("__c")))
    return joined.withColumn("text", text).select(*docs.columns)


_WORDS_SQL = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST({_WORDS_SQL} AS BIGINT) AS size,
    row_number() OVER (PARTITION BY doc_id ORDER BY source, text) AS copy FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank, 2 * source_size AS cap FROM s),
v AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM w),
f AS (SELECT *, cap::DOUBLE / weight AS fill FROM v),
l AS (
  SELECT *, ((SELECT sum(source_size)::DOUBLE FROM s) * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY fill, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / sum(weight) OVER (ORDER BY fill, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
t AS (
  SELECT *, least(cap::DOUBLE, (SELECT level FROM l WHERE level <= fill ORDER BY fill, rank LIMIT 1) * weight) AS target FROM l),
p AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS wanted FROM t),
q AS (
  SELECT *, CASE WHEN source_size > 0 THEN wanted // source_size ELSE 0 END AS epochs,
    CASE WHEN source_size > 0 THEN wanted % source_size ELSE 0 END AS rest FROM p),
b AS (
  SELECT d.doc_id, copy, d.size, q.rank, epochs, rest, unnest(range((d.size + {BLOCK_WORDS} - 1) // {BLOCK_WORDS})) AS block
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source WHERE d.size > 0),
o AS (
  SELECT *, least({BLOCK_WORDS}, size - block * {BLOCK_WORDS}) AS words,
    md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || copy || ':' || block) AS order_key FROM b),
c AS (
  SELECT *, coalesce(sum(words) OVER (PARTITION BY rank ORDER BY order_key, doc_id, copy, block
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o),
k AS (
  SELECT doc_id, copy, sum(epochs * words + greatest(0, least(words, rest - before))) AS taken FROM c GROUP BY doc_id, copy)
SELECT d.doc_id, d.size, q.source_size, q.target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
LEFT JOIN k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND d.copy = k.copy
"""
