"""Per-key facts attached to every row without sending all rows of one key to one task.

A plain ``window over (key)`` puts a key that holds a third of the data into a single reducer, and adaptive skew handling
does not split a join whose other side is an aggregate. Here

1. facts are aggregated by key, combined on the map side, so a hot key sends one row per task; where all that counts is whether a
   key is there (``missing``), only hot keys are combined, since a table of all keys would fill a task's memory;
2. keys without a fact worth telling (keys seen once, references that exist) are dropped, and the rest is written;
3. rows join that table. Its size is then known: a small one is broadcast by Spark's own threshold and no row moves; a large
   one is a plain scan, so adaptive execution splits the partition of a hot key.

``attach`` joins several such tables whose keys few rows have. Beside a large table a row is first tested against a bit filter
of its keys: the few rows that may have one move and are joined exactly, all others stay where they are. Where the result is
read more than once, these few are written.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import written

# A table of at most this many keys is joined as it is. A filter has 16 bits a key, and never more words than this (64 bits each).
PLAIN_KEYS = 50_000
FILTER_WORDS = 1 << 20
# Keys are counted in this many buckets; those of a bucket with more rows than this are combined before they move.
HOT_BUCKETS = 1 << 16
HOT_ROWS = 500_000


@dataclass(frozen=True)
class Facts:
    """A written table of facts about the keys that it lists; most rows have none of them. It may list a key more than once."""
    keys: tuple[str, ...]
    table: DataFrame
    n_keys: int

    @property
    def values(self) -> list[str]:
        return [c for c in self.table.columns if c not in self.keys]


def facts(table: DataFrame, keys: Sequence[str]) -> Facts:
    stored = written(table, "facts")
    return Facts(tuple(keys), stored, stored.count())


def _key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys)


def _bits(key: Column) -> Column:
    """The two bits of a key in its word."""
    one = lambda by: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(key, by).bitwiseAND(F.lit(63)).cast("int"))
    return one(40).bitwiseOR(one(50))


def _tested(df: DataFrame, keys: Sequence[str], listed: DataFrame, n_keys: int, name: str) -> DataFrame:
    """Boolean column: the row's key may be one of ``listed`` (same column names). False is certain.

    The filter is a table of at most FILTER_WORDS rows whatever the input, so it is broadcast.
    """
    n_words = min(FILTER_WORDS, 1 << max(10, (n_keys // 4).bit_length()))
    word = lambda key: key.bitwiseAND(F.lit(n_words - 1))
    hashed = listed.select(_key_hash(keys).alias("__h"))
    words = written(hashed.groupBy(word(F.col("__h")).alias("__word")).agg(F.bit_or(_bits(F.col("__h"))).alias("__bits")), "key-filter")
    out = df.withColumn("__h", _key_hash(keys))
    out = out.join(F.broadcast(words), word(F.col("__h")) == F.col("__word"), "left")
    bits = _bits(F.col("__h"))
    return out.withColumn(name, F.coalesce(F.col("__bits").bitwiseAND(bits) == bits, F.lit(False))).select(*df.columns, name)


def attach(df: DataFrame, tables: Sequence[Facts], again: bool = False) -> DataFrame:
    """Left join with every table. NULL key parts meet each other. Only rows that may have a key of a large table move.

    ``again``: the result is read more than once. Then this holds for every table, and the rows that may have a key are joined
    once and written, so that each reader finds the same facts beside them.
    """
    large = [t for t in tables if t.n_keys > (0 if again else PLAIN_KEYS)]
    out = df
    if large:
        tested, marks = df, [f"__may_{i}" for i in range(len(large))]
        for mark, t in zip(marks, large, strict=True):
            tested = _tested(tested, t.keys, t.table, t.n_keys, mark)
        near = reduce(lambda a, b: a | b, [F.col(m) for m in marks])
        away = tested.where(~near).select(*df.columns, *[F.lit(None).cast(t.table.schema[v].dataType).alias(v) for t in large for v in t.values])
        out = tested.where(near).select(*df.columns)
        for t in large:
            out = _met(out, t)
        out = away.unionByName(written(out, "near") if again else out)
    for t in tables:
        if t not in large:
            out = _met(out, t)
    return out


def _met(df: DataFrame, t: Facts) -> DataFrame:
    table = t.table.select(*[F.col(k).alias(f"__r_{k}") for k in t.keys], *t.values)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in t.keys])
    return df.join(table, same, "left").drop(*[f"__r_{k}" for k in t.keys])


def _repeated_hashes(df: DataFrame, keys: Sequence[str]) -> Facts:
    """``__key``: hashes that rows of ``df`` have more than once. What moves is a number per row."""
    return facts(df.select(_key_hash(keys).alias("__key")).groupBy("__key").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__key"), ["__key"])


def apart(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose key comes once, all others). Few rows of the first kind may be among the others, all rows of a key are on one side."""
    twice = _repeated_hashes(df, keys)
    tested = _tested(df.withColumn("__key", _key_hash(keys)), ["__key"], twice.table, twice.n_keys, "__may").drop("__key")
    return tested.where(~F.col("__may")).drop("__may"), tested.where("__may").drop("__may")


def with_repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose key comes twice or more, and maybe some others. Keys meet as hashes, so what moves is a number per row."""
    twice = _repeated_hashes(df, keys)
    hashed = df.withColumn("__key", _key_hash(keys))
    if twice.n_keys > PLAIN_KEYS:
        hashed = _tested(hashed, ["__key"], twice.table, twice.n_keys, "__may").where("__may").drop("__may")
    return hashed.join(twice.table, "__key", "left_semi").drop("__key")


def _joined(df: DataFrame, keys: Sequence[str], table: DataFrame) -> DataFrame:
    """Left join with ``table``, written first: one row per key. NULL key parts meet each other."""
    return _met(df, Facts(tuple(keys), written(table, "facts"), 0))


def attach_group(
    df: DataFrame,
    keys: Sequence[str],
    facts: Mapping[str, Column],
    keep: Column | None = None,
    where: Column | None = None,
) -> DataFrame:
    """Add the aggregates ``facts``, computed over all rows with the same ``keys``.

    Keys failing ``keep`` (a condition on the facts) and keys that only rows failing ``where`` have get NULL.
    """
    counted = df if where is None else df.where(where)
    per_key = counted.groupBy(*keys).agg(*[c.alias(n) for n, c in facts.items()])
    return _joined(df, keys, per_key if keep is None else per_key.where(keep))


def _position(order: Sequence[str]) -> Column:
    """One number stays a plain column, which hash aggregation can minimise in place."""
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def repeats(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> Facts:
    """``__first_pos`` of every key that comes more than once. NULL key parts count as equal to each other."""
    per_key = with_repeated_keys(df.select(*keys, _position(order).alias("__pos")), keys).groupBy(*keys).agg(
        F.min("__pos").alias("__first_pos"), F.count(F.lit(1)).alias("__n"))
    return facts(per_key.where("__n > 1").drop("__n"), keys)


def is_repeat(order: Sequence[str]) -> Column:
    """With ``__first_pos`` of ``repeats``: the row is not the first one with its key. ``order`` must be unique per row."""
    return F.col("__first_pos").isNotNull() & (_position(order) != F.col("__first_pos"))


def mark_repeats(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Boolean column: the row is not the first one with its key."""
    return attach(df, [repeats(df, keys, order)]).withColumn(name, is_repeat(order)).drop("__first_pos")


def attach_first_owner(df: DataFrame, key: str, owner: str, order: Sequence[str], name: str) -> DataFrame:
    """Owner of the first row carrying ``key``, for keys that more than one owner uses (else NULL)."""
    known = F.coalesce(F.col(owner), F.lit("None"))
    out = attach_group(
        df, [key],
        {"__first": F.min(F.struct(F.struct(*order).alias("pos"), known.alias("owner"))), "__low": F.min(known), "__high": F.max(known)},
        keep=F.col("__low") != F.col("__high"), where=F.col(key).isNotNull())
    return out.withColumn(name, F.col("__first.owner")).drop("__first", "__low", "__high")


def thinned(df: DataFrame, key: str) -> DataFrame:
    """``key`` of all rows, with fewer repeats of keys that a large share of the rows has. Only these are held in a table of keys by
    each task; all others pass through, so memory does not follow the number of keys."""
    bucketed = df.select(key, _key_hash([key]).bitwiseAND(F.lit(HOT_BUCKETS - 1)).alias("__bucket"))
    hot = facts(bucketed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > HOT_ROWS).select("__bucket"), ["__bucket"])
    if not hot.n_keys:
        return df.select(key)
    return bucketed.join(hot.table, "__bucket", "left_anti").select(key).unionByName(bucketed.join(hot.table, "__bucket", "left_semi").select(key).distinct())


def missing(df: DataFrame, key: str, reference: DataFrame, name: str) -> Facts:
    """``name``, true, for every key that is set but absent from ``reference`` (one column of the same name).

    Keys meet as they come, but for hot ones; rows join only the absent keys.
    """
    wanted = thinned(df.where(F.col(key).isNotNull()), key)
    known = thinned(reference.where(F.col(key).isNotNull()), key)
    # Merged: the files of a long column of keys look small enough to broadcast, their table in memory is not. Written before
    # repeats go: an aggregate above the join would keep adaptive execution from splitting it.
    absent = written(wanted.join(known.hint("merge"), key, "left_anti"), "absent")
    return facts(absent.distinct().withColumn(name, F.lit(True)), [key])


def mark_missing(df: DataFrame, key: str, reference: DataFrame, name: str) -> DataFrame:
    """Boolean column: ``key`` is set but absent from ``reference``."""
    return attach(df, [missing(df, key, reference, name)]).withColumn(name, F.coalesce(name, F.lit(False)))


def past(df: DataFrame, key: str, on: str, ends: DataFrame, until: str) -> list[Facts]:
    """``ends(key, until)`` where it tells: for the pairs of ``key`` and ``on`` with ``on`` after ``until``, and all of its rows of a
    key that it lists more than once, which a join repeats rows for. Rows without such facts have one that they keep, or none."""
    ends = ends.select(key, until).where(F.col(key).isNotNull())
    often = facts(ends.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(key), [key])
    single = ends.join(often.table, key, "left_anti") if often.n_keys else ends
    late = df.select(key, on).join(single, key).where(F.col(on) > F.col(until)).repartition(key, on).distinct()
    out = [facts(late.select(key, on, until), [key, on])]
    if often.n_keys:
        out.append(facts(ends.join(often.table, key, "left_semi").withColumnRenamed(until, f"{until}_often"), [key]))
    return out


def lookup(df: DataFrame, keys: Sequence[str], facts: DataFrame) -> DataFrame:
    """Left join with ``facts`` (one row per key) where a key may hold a large share of ``df``."""
    return _joined(df, keys, facts)
