"""Merkle manifest of a table: a digest per row, a tree per source, one root over the sources, and a proof for every row.

Each level of a tree is a written table of nodes (tree, place). A node's siblings have the slot offsets 1 to ARITY - 1 in its run
(for two slots that is place XOR 1): the level equijoins itself once per offset on the computed place, and slot-zero rows,
which then hold their whole run, emit the parents. Proofs go down the same tables: a node's steps are its own siblings
and its parent's steps, joined by the parent's place, so each step is carried to the level below only.
All keys are single nodes, so a source with most of the rows is spread like any other.

Places within a source come from a range partitioning of the leaves: rows are numbered inside their partition, and partitions
are added up before them.

Defined cases: null fields are ``-``; a null doc_id sorts first, and its row is never tampered with; repeated rows are leaves of their own, in
order of their digests; a lone leaf is its tree's root, unhashed; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.tables import stage
from tidewatch.session import salt_count

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[field(columns[c]) for c in FIELDS]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree, leaf, tampered: the row's digest, and the one it has once its line breaks are gone (where it is chosen)."""
    columns = {c: docs[c] for c in FIELDS}
    chosen = F.coalesce(F.crc32(docs["doc_id"].cast("string")) % 2 == 0, F.lit(False)) & docs["text"].cast("string").contains("\n")
    changed = leaf_digest(columns | {"text": F.replace(docs["text"].cast("string"), F.lit("\n"), F.lit(""))})
    # A null source sorts before every other one.
    tree = F.coalesce(F.concat(F.lit(":"), docs["source"].cast("string")), F.lit("-"))
    return docs.select("doc_id", tree.alias("tree"), leaf_digest(columns).alias("leaf"), F.when(chosen, changed).alias("tampered"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with ``place`` (from 0, by tree and then ``order``) and ``n``, the number of rows of their tree."""
    spark = rows.sparkSession
    keys = [F.col("tree"), *[F.col(c).asc_nulls_first() for c in order]]
    ranged = stage(rows.repartitionByRange(salt_count(spark), *keys).withColumn("range", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("tree", "range").agg(F.count("*").alias("c"))
    by_tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("c").over(by_tree.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = stage(counts.select("tree", "range", before.alias("before"), F.sum("c").over(by_tree).alias("n")), "ranges")
    inside = F.row_number().over(Window.partitionBy("range", "tree").orderBy(*keys[1:]))
    return ranged.withColumn("at", inside).join(offsets, ["tree", "range"]).withColumn("place", F.col("before") + F.col("at") - 1).drop("range", "at", "before")


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes with ``ahead`` and ``after``: the digests of their run before and after them, null where nothing is left to join (n = 1)."""
    run, slot = F.floor(F.col("place") / arity), F.col("place") % arity
    joined = nodes
    for d in range(1, arity):
        other = nodes.where("n > 1").select(F.col("tree").alias("_t"), F.col("place").alias("_p"), F.col("digest").alias(f"_s{d}"))
        joined = joined.join(other, (F.col("tree") == F.col("_t")) & (run * arity + (slot + d) % arity == F.col("_p")), "left").drop("_t", "_p")
    found = [(d, F.coalesce(f"_s{d}", F.lit(""))) for d in range(1, arity)]
    ahead = F.concat(*[F.when(slot + d >= arity, s).otherwise("") for d, s in found])
    after = F.concat(*[F.when(slot + d < arity, s).otherwise("") for d, s in found])
    some = F.col("n") > 1
    return joined.withColumn("ahead", F.when(some, ahead)).withColumn("after", F.when(some, after)).drop(*[f"_s{d}" for d in range(1, arity)])


def climb(nodes: DataFrame, arity: int = ARITY) -> tuple[list[DataFrame], DataFrame]:
    """All levels of the trees of (tree, place, n, digest, ...), lowest first, and the roots (tree, root)."""
    levels, most = [], nodes.agg(F.max("n")).first()[0] or 0
    while True:
        level = stage(with_siblings(nodes, arity), f"level{len(levels)}")
        levels.append(level)
        if most <= 1:
            break
        most = -(-most // arity)
        nodes = level.where((F.col("n") > 1) & (F.col("place") % arity == 0)).select(
            "tree", F.floor(F.col("place") / arity).alias("place"), F.ceil(F.col("n") / arity).alias("n"), F.sha2(F.concat("digest", "after"), 256).alias("digest"))
    tops = [level.where("n = 1").select("tree", F.col("digest").alias("root")) for level in levels]
    roots = tops[0]
    for top in tops[1:]:
        roots = roots.unionByName(top)
    return levels, stage(roots, "roots")


def with_steps(levels: list[DataFrame], arity: int = ARITY) -> DataFrame:
    """The lowest level's nodes with ``steps``, their siblings on the way to the root; a root has none."""
    own = F.array(F.struct("ahead", "after"))
    # The highest level holds roots only.
    found = levels[-1].withColumn("steps", F.slice(own, 1, 0))
    for i in reversed(range(len(levels) - 1)):
        up = stage(found.select(F.col("tree").alias("_t"), F.col("place").alias("_p"), F.col("steps").alias("_up")), f"steps{i + 1}")
        is_parent = (F.col("n") > 1) & (F.col("tree") == F.col("_t")) & (F.floor(F.col("place") / arity) == F.col("_p"))
        steps = F.when(F.col("n") > 1, F.concat(own, F.col("_up"))).otherwise(F.slice(own, 1, 0))
        found = levels[i].join(up, is_parent, "left").withColumn("steps", steps).drop("_t", "_p", "_up")
    return found


def fold(digest: Column, steps: Column) -> Column:
    return F.aggregate(steps, digest, lambda acc, s: F.sha2(F.concat(s["ahead"], acc, s["after"]), 256))


def siblings(steps: Column) -> Column:
    return F.array_join(F.transform(steps, lambda s: F.concat(s["ahead"], s["after"])), "")


def manifest(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    nodes = numbered(stage(leaves(docs), "leaves"), ["doc_id", "leaf"]).withColumnRenamed("leaf", "digest")
    levels, subroots = climb(nodes, arity)
    top_levels, root = climb(numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("digest")), ["of"]), arity)
    of_source = with_steps(top_levels, arity).join(root, "tree").select(F.col("of").alias("tree"), F.col("digest").alias("subroot"), "root", F.col("steps").alias("top"))
    rows = with_steps(levels, arity).join(stage(of_source, "source-steps"), "tree")
    path = F.concat("steps", "top")
    return rows.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings(path), 256).alias("proof_sha256"),
        fold(F.coalesce("tampered", "digest"), path).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in FIELDS[:-1]) + " || {0})"

SQL = f"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
c AS (
  SELECT documents.*, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, ''))), '..'),
      lambda h: CAST(('0x' || h) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])) & 1 = 1 AS even
  FROM documents, crc_table),
d AS (
  SELECT doc_id, coalesce(':' || source, '-') AS tree, {_LEAF.format(_FIELD.format("text"))} AS leaf,
    CASE WHEN even AND doc_id IS NOT NULL THEN {_LEAF.format(_FIELD.format("replace(text, chr(10), '')"))} END AS tampered FROM c),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM d),
up AS (
  SELECT tree, 0 AS level, place, n, leaf AS digest FROM l
  UNION ALL
  SELECT tree, level + 1, place // {ARITY}, (n + {ARITY - 1}) // {ARITY}, sha256(string_agg(digest, '' ORDER BY place)) FROM up WHERE n > 1 GROUP BY tree, level, place // {ARITY}, n),
s AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, place, n, subroot AS digest FROM s
  UNION ALL
  SELECT level + 1, place // {ARITY}, (n + {ARITY - 1}) // {ARITY}, sha256(string_agg(digest, '' ORDER BY place)) FROM top WHERE n > 1 GROUP BY level, place // {ARITY}, n),
steps AS (
  SELECT a.tree, a.level, a.place, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (WHERE b.place < a.place), '') AS ahead,
    coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (WHERE b.place > a.place), '') AS after
  FROM up a JOIN up b ON a.tree = b.tree AND a.level = b.level AND a.place // {ARITY} = b.place // {ARITY} WHERE a.n > 1 GROUP BY ALL),
top_steps AS (
  SELECT a.level, a.place, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (WHERE b.place < a.place), '') AS ahead,
    coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (WHERE b.place > a.place), '') AS after
  FROM top a JOIN top b ON a.level = b.level AND a.place // {ARITY} = b.place // {ARITY} WHERE a.n > 1 GROUP BY ALL),
walk AS (
  SELECT doc_id, leaf, tree, 0 AS level, place, coalesce(tampered, leaf) AS folded, '' AS proof FROM l
  UNION ALL
  SELECT w.doc_id, w.leaf, w.tree, w.level + 1, w.place // {ARITY}, sha256(x.ahead || w.folded || x.after), w.proof || x.ahead || x.after
  FROM walk w JOIN steps x ON x.tree = w.tree AND x.level = w.level AND x.place = w.place),
arrived AS (SELECT w.* FROM walk w JOIN up u ON u.tree = w.tree AND u.level = w.level AND u.n = 1),
climb AS (
  SELECT a.doc_id, a.leaf, s.subroot, 0 AS level, s.place, a.folded, a.proof FROM arrived a JOIN s ON s.tree = a.tree
  UNION ALL
  SELECT c.doc_id, c.leaf, c.subroot, c.level + 1, c.place // {ARITY}, sha256(x.ahead || c.folded || x.after), c.proof || x.ahead || x.after
  FROM climb c JOIN top_steps x ON x.level = c.level AND x.place = c.place),
r AS (SELECT level, digest AS root FROM top WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM climb JOIN r USING (level)
"""
