"""Ordered scans (row numbers, previous value, running sum and maximum) in two levels.

``window(partition by source order by time)`` sorts the whole history of a source in one task.
Here the history is cut into buckets that follow the order (a day, an hour): windows run
inside (key, bucket), one summary row per bucket carries the state of earlier buckets over,
and a join on (key, bucket) adds the two. The only ungrouped input is one row per bucket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scan(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str],
         wanted: Mapping[str, tuple[str, Column | None]]) -> DataFrame:
    """Add one column per entry of ``wanted``: name -> (kind, value).

    Kinds: ``ordinal`` (1-based), ``previous`` (value of the row before; values must not be
    NULL), ``running_sum`` (up to and including the row), ``prior_max`` (rows before).
    ``bucket`` must never decrease along ``order``; ``order`` must be unique within a key.
    """
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    pos = F.struct(*order)

    local, summary, carry, merged = {}, [], {}, {}
    for name, (kind, value) in wanted.items():
        part, total, prior = F.col(f"__l_{name}"), f"__t_{name}", F.col(f"__c_{name}")
        if kind == "ordinal":
            local[name] = F.row_number().over(inside).cast("long")
            summary.append(F.count(F.lit(1)).alias(total))
            carry[name] = F.sum(total).over(earlier)
            merged[name] = part + F.coalesce(prior, F.lit(0))
        elif kind == "running_sum":
            local[name] = F.sum(value).over(upto)
            summary.append(F.sum(value).alias(total))
            carry[name] = F.sum(total).over(earlier)
            merged[name] = part + F.coalesce(prior, F.lit(0))
        elif kind == "prior_max":
            local[name] = F.max(value).over(before)
            summary.append(F.max(value).alias(total))
            carry[name] = F.max(total).over(earlier)
            merged[name] = F.greatest(part, prior)
        elif kind == "previous":
            local[name] = F.lag(value).over(inside)
            summary.append(F.max_by(value, pos).alias(total))
            carry[name] = F.last(total, ignorenulls=True).over(earlier)
            merged[name] = F.coalesce(part, prior)
        else:
            raise ValueError(f"unknown scan kind {kind}")

    group = [*keys, bucket]
    state = df.groupBy(*group).agg(*summary).select(
        *[F.col(k).alias(f"__r_{k}") for k in group],
        *[c.alias(f"__c_{n}") for n, c in
          carry.items()])
    rows = df.select("*", *[c.alias(f"__l_{n}") for n, c in local.items()])
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in group])
    out = rows.join(state, match, "left")
    return out.select(*df.columns, *[merged[n].alias(n) for n in wanted])

