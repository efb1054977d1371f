r"""Line dedup by a tree of line templates.

A line's way down the tree is its token count and its first two tokens, tokens with a digit read as ``<*>``. Two
lines at one leaf belong to one template when

* their tokens agree (after the digits), and two documents have them, or
* they agree outside one quarter of their positions, and at least ``VALUES`` different lines fill that quarter:
  it is a variable field and becomes ``<*>``, or
* they agree in their frequent tokens, whatever the positions, and at least ``VALUES`` different lines do. A token's
  frequency is the number of the leaf's different lines with it at its position; a line is tried with every frequency that sets
  some of its tokens apart from the others, in steps of ``STEP``, as fields may have frequent values too. At least half
  of the tokens after the first two have to stand, one at least; the others become ``<*>``.

The document with the smallest doc_id keeps a template's lines; from every other document they are dropped. Lines of
fewer than ``FEWEST`` tokens are no templates, lines of fewer than ``FEWEST_OPEN`` have no variable quarter.

Lines are told apart by 64-bit hashes of their tokens. They are counted per exact line first, with map-side combining,
and fields are counted over different lines only, so a line that a third of all documents hold is one row
there. Tokens are read again for the first copy of each line, where a leaf has ``VALUES`` lines. No window, sort or list holds a group of lines; only the numbers of one document's own dropped lines are put together.

Defined cases: null text stays null, empty text is one empty line; a null doc_id is neither compared nor cut; rows that
repeat a doc_id keep each other's lines; ties cannot arise, as only the least doc_id counts; an empty table gives an
empty result; other columns are kept by ``drop_templates``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.tables import stage, whole, words

LEADING = 2
FEWEST = 3
FEWEST_OPEN = 6
PARTS = 4
VALUES = 3
STEP = 1.2
ANY = "<*>"


def tokens(line: Column) -> Column:
    plain = words(line)
    return F.when(line.rlike("[0-9]"), F.transform(plain, lambda t: F.when(t.rlike("[0-9]"), ANY).otherwise(t))).otherwise(plain)


def open_key(part: int) -> Column:
    """Hash of the line with one quarter left open; null where that quarter holds stem tokens only."""
    n = F.size("tokens")
    first = F.greatest(F.lit(LEADING), F.ceil(n * part / PARTS)).cast("int")
    after = F.ceil(n * (part + 1) / PARTS).cast("int")
    return F.when((n >= FEWEST_OPEN) & (first < after), F.xxhash64(n, F.lit(part), F.slice("tokens", 1, first), F.slice("tokens", after + 1, n)))


def contents(docs: DataFrame) -> DataFrame:
    text = whole(docs["text"])
    return docs.where(docs["doc_id"].isNotNull()).select("doc_id", F.xxhash64(text).alias("key"), F.posexplode(F.split(text, "\n")).alias("line", "content"))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, key (row), line, exact, leaf and one open key per quarter, for lines long enough to be templates."""
    # The explode keeps the filter above it, so that no line is cut into tokens twice.
    parsed = contents(docs).select("doc_id", "key", "line", F.explode(F.array(tokens(F.col("content")))).alias("tokens")).where(F.size("tokens") >= FEWEST)
    return parsed.select("doc_id", "key", "line", F.xxhash64(F.size("tokens"), "tokens").alias("exact"), F.xxhash64(F.size("tokens"), F.slice("tokens", 1, LEADING)).alias("leaf"),
                         *[open_key(q).alias(f"open{q}") for q in range(PARTS)])


def frequent_keys(docs: DataFrame, exact: DataFrame) -> DataFrame:
    """(exact, low, open): hashes of each line with its rare tokens left open, one for every frequency that may part them."""
    leaves = stage(exact.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= VALUES).select("leaf"), "leaves")
    chosen = stage(exact.join(leaves, "leaf").select("exact", "leaf", "low", F.col("head.*")), "leaf-lines")
    # Rows that repeat a document hold the same line again, hence the grouping.
    read = contents(docs).join(chosen, ["doc_id", "key", "line"]).groupBy("exact", "leaf", "low").agg(F.min("content").alias("content"))
    hashed = read.select("exact", "leaf", "low", F.transform(tokens(F.col("content")), lambda t: F.xxhash64(t)).alias("tokens"))
    rest = F.slice("tokens", LEADING + 1, F.size("tokens"))
    placed = stage(hashed.select("exact", "leaf", "low", (F.size("tokens") - LEADING).alias("n"), F.posexplode(rest).alias("place", "token")), "leaf-tokens")
    counts = placed.groupBy("leaf", "place", "token").agg(F.count("*").alias("lines")).where(F.col("lines") >= VALUES)
    step = F.floor(F.log(F.col("lines") / VALUES) / F.log(F.lit(STEP))).cast("int")
    ranked = placed.join(stage(counts.select("leaf", "place", "token", step.alias("step")), "leaf-counts"), ["leaf", "place", "token"])
    lines = ranked.groupBy("exact", "leaf", "low", "n").agg(F.sort_array(F.collect_list(F.struct("place", "token", "step"))).alias("found"))
    tried = lines.where(2 * F.size("found") >= F.col("n")).withColumn("least", F.explode(F.array_distinct("found.step")))
    fixed = tried.select("exact", "leaf", "low", "n", F.filter("found", lambda x: x["step"] >= F.col("least")).alias("found"))
    fixed = fixed.where((2 * F.size("found") >= F.col("n")) & (F.size("found") < F.col("n")))
    return fixed.select("exact", "low", F.xxhash64("leaf", "found.place", "found.token").alias("open"))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, key, gone): the numbers of the lines that leave a row."""
    lines = stage(lines_of(docs), "lines")
    opens = [f"open{q}" for q in range(PARTS)]
    exact = stage(lines.groupBy("exact").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min("leaf").alias("leaf"),
                                                F.min(F.struct("doc_id", "key", "line")).alias("head"), *[F.min(c).alias(c) for c in opens]), "line-groups")
    quarters = exact.select("exact", "low", F.explode(F.array(*opens)).alias("open")).where("open IS NOT NULL")
    each = quarters.unionByName(stage(frequent_keys(docs, exact), "frequent-keys"))
    fields = stage(each.groupBy("open").agg(F.count("*").alias("n"), F.min("low").alias("first")).where(F.col("n") >= VALUES).select("open", "first"), "fields")
    generalised = each.join(fields, "open").groupBy("exact").agg(F.min("first").alias("first"))
    owners = exact.join(generalised, "exact", "left").select("exact", "high", F.least("low", "first").alias("owner")).where("owner < high")
    gone = lines.join(stage(owners.select("exact", "owner"), "owners"), "exact").where("doc_id > owner")
    return stage(gone.groupBy("doc_id", "key").agg(F.collect_set("line").alias("gone")), "dropped-lines")


def without(text: Column, gone: Column) -> Column:
    kept = F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(gone, i))
    return F.when(gone.isNull(), text).otherwise(F.array_join(kept, "\n"))


def marked(docs: DataFrame) -> DataFrame:
    """The rows with ``__gone``, the numbers of their dropped lines (null for none)."""
    gone = dropped_lines(docs).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("gone").alias("__gone"))
    return docs.join(gone, (docs["doc_id"] == F.col("__id")) & (F.xxhash64(whole(docs["text"])) == F.col("__key")), "left")


def drop_templates(docs: DataFrame) -> DataFrame:
    """The documents with recurring lines taken out of their text."""
    return marked(docs).withColumn("text", without(F.col("text"), F.col("__gone"))).select(*docs.columns)


def template_report(docs: DataFrame) -> DataFrame:
    rows = marked(docs.select("doc_id", "text"))
    text = whole(F.col("text"))
    return rows.select("doc_id", F.size(F.split(text, "\n")).cast("long").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"),
                       F.sha2(without(text, F.col("__gone")), 256).alias("kept_sha256"))


def _open_sql(part: int) -> str:
    return (f"CASE WHEN n >= {FEWEST_OPEN} AND greatest({LEADING}, (n * {part} + {PARTS - 1}) // {PARTS}) < (n * {part + 1} + {PARTS - 1}) // {PARTS} THEN "
            f"n || '/' || {part} || '/' || array_to_string(t[1:greatest({LEADING}, (n * {part} + {PARTS - 1}) // {PARTS})], ' ') || ' {ANY} ' "
            f"|| array_to_string(t[(n * {part + 1} + {PARTS - 1}) // {PARTS} + 1:n], ' ') END")


SQL = rf"""
WITH s AS (SELECT doc_id, coalesce(text, '') AS x, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
u AS (SELECT doc_id, x, unnest(parts) AS line, unnest(range(len(parts))) AS i FROM s),
k AS (
  SELECT doc_id, x, i, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'),
    lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '{ANY}' ELSE w END) AS t FROM u),
l AS (SELECT *, len(t) AS n, array_to_string(t, ' ') AS exact FROM k WHERE len(t) >= {FEWEST}),
e AS (SELECT exact, n, t, min(doc_id) AS low, max(doc_id) AS high FROM l GROUP BY exact, n, t),
o AS (SELECT exact, low, unnest([{", ".join(_open_sql(q) for q in range(PARTS))}]) AS open FROM e),
v AS (SELECT exact, low, n, t, t[1:{LEADING}] AS stem FROM e QUALIFY count(*) OVER (PARTITION BY n, t[1:{LEADING}]) >= {VALUES}),
p AS (SELECT exact, low, n, stem, unnest(t[{LEADING} + 1:n]) AS token, unnest(range(n - {LEADING})) AS place FROM v),
c AS (SELECT n, stem, place, token, floor(ln(count(*) / {VALUES}::DOUBLE) / ln({STEP}::DOUBLE))::INT AS step FROM p GROUP BY ALL HAVING count(*) >= {VALUES}),
q AS (SELECT exact, low, n, stem, list({{'place': place, 'token': token, 'step': step}} ORDER BY place) AS found
      FROM p JOIN c USING (n, stem, place, token) GROUP BY exact, low, n, stem HAVING 2 * count(*) >= n - {LEADING}),
y AS (SELECT *, unnest(list_distinct(list_transform(found, lambda x: x.step))) AS smallest FROM q),
z AS (SELECT exact, low, n, stem, list_filter(found, lambda x: x.step >= smallest) AS fixed FROM y),
a AS (SELECT exact, low, open FROM o WHERE open IS NOT NULL UNION ALL
      SELECT exact, low, 'f/' || n || '/' || array_to_string(stem, ' ') || '/' || array_to_string(list_transform(fixed, lambda x: x.place || ' ' || x.token), ' ')
      FROM z WHERE 2 * len(fixed) >= n - {LEADING} AND len(fixed) < n - {LEADING}),
f AS (SELECT open, min(low) AS first FROM a GROUP BY open HAVING count(*) >= {VALUES}),
g AS (SELECT exact, min(first) AS first FROM a JOIN f USING (open) GROUP BY exact),
w AS (SELECT e.exact, least(e.low, coalesce(g.first, e.low)) AS owner FROM e LEFT JOIN g USING (exact)),
d AS (SELECT DISTINCT l.doc_id, l.i FROM l JOIN w USING (exact) WHERE l.doc_id > w.owner),
r AS (SELECT doc_id, list(i) AS gone FROM d GROUP BY doc_id)
SELECT s.doc_id, CAST(len(parts) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_dropped,
  sha256(array_to_string(list_transform(list_filter(range(len(parts)), lambda j: NOT list_contains(coalesce(gone, []), j)),
    lambda j: parts[j + 1]), chr(10))) AS kept_sha256
FROM s LEFT JOIN r USING (doc_id)
"""
