"""Ordered analytics over keys of any size.

A plain window puts all rows of a key into one task. The functions here first cut every
key into shards along its order (an expression that never decreases with the order, for
example the day of an instant), work inside the shards, and carry one summary row per
shard across. The per-key window then only sees one row per shard, whose number is bounded
by the shard expression (days of a calendar, buckets of a hash), not by the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def carry_join(rows: DataFrame, carry: DataFrame, keys: Sequence[str], bring: Sequence[str]) -> DataFrame:
    """Left join of per-shard values to rows; null keys match each other."""
    right = carry.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *bring)
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return rows.join(right, cond, "left").drop(*[f"__k_{k}" for k in keys])


def row_number(df: DataFrame, keys: Sequence[str], shard: str, order: Sequence[Column], out: str) -> DataFrame:
    """``row_number`` per ``keys`` in the order of (``shard``, ``order``), starting with 1."""
    per_shard = df.groupBy(*keys, shard).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_shard.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    inside = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys, shard).orderBy(*order)))
    joined = carry_join(inside, offsets, [*keys, shard], ["__before"])
    return joined.withColumn(out, (F.col("__rn") + F.col("__before")).cast("long")).drop("__rn", "__before")


def running_sum(
    df: DataFrame, keys: Sequence[str], shard: str, order: Sequence[Column], value: str, out: str
) -> DataFrame:
    """Sum of ``value`` over all earlier rows of the key (exclusive of the row itself)."""
    per_shard = df.groupBy(*keys, shard).agg(F.sum(value).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_shard.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    inside_w = Window.partitionBy(*keys, shard).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = df.withColumn("__in", F.coalesce(F.sum(value).over(inside_w), F.lit(0)))
    joined = carry_join(inside, offsets, [*keys, shard], ["__before"])
    return joined.withColumn(out, F.col("__in") + F.col("__before")).drop("__in", "__before")


def runs(df: DataFrame, keys: Sequence[str], shard: str, time: str, value: str) -> DataFrame:
    """Maximal runs of equal ``value`` per key in the order of (``time``, ``value``).

    Returns ``keys``, ``value``, ``run_from`` (the first ``time`` of the run) and ``run_to``
    (the first ``time`` of the next run, null for the last). A value that comes back later
    starts a new run. ``time`` and ``value`` must not be null.
    """
    k = list(keys)
    inside = Window.partitionBy(*k, shard).orderBy(time, value)
    across = Window.partitionBy(*k).orderBy(shard)
    last = df.groupBy(*k, shard).agg(F.max_by(value, F.struct(time, value)).alias("__last"))
    before = last.withColumn("__carry", F.lag("__last").over(across)).where("__carry is not null")
    seen = carry_join(df.withColumn("__prev", F.lag(value).over(inside)), before, [*k, shard], ["__carry"])
    starts = seen.where(~F.coalesce("__prev", "__carry").eqNullSafe(F.col(value))).select(*k, shard, time, value)
    first = starts.groupBy(*k, shard).agg(F.min(time).alias("__first"))
    after = first.withColumn("__next", F.lead("__first").over(across)).where("__next is not null")
    led = carry_join(starts.withColumn("__lead", F.lead(time).over(inside)), after, [*k, shard], ["__next"])
    return led.select(*k, value, F.col(time).alias("run_from"), F.coalesce("__lead", "__next").alias("run_to"))


def neighbour(df: DataFrame, keys: Sequence[str], shard: str, order: Sequence[str], bring: Sequence[str], ahead: bool, prefix: str) -> DataFrame:
    """Adds ``prefix + column`` of the next (``ahead``) or previous row of the key.

    Order is (``shard``, ``order``), which must not tie. Like ``lead`` and ``lag``, but a key
    of any size is worked on in shards.
    """
    k = list(keys)
    row = F.struct(*[F.col(c).alias(c) for c in bring])
    inside = Window.partitionBy(*k, shard).orderBy(*order)
    across = Window.partitionBy(*k).orderBy(shard)
    step = F.lead("__row") if ahead else F.lag("__row")
    edge = F.min_by if ahead else F.max_by
    rows = df.withColumn("__row", row)
    ends = rows.groupBy(*k, shard).agg(edge("__row", F.struct(*order)).alias("__end"))
    shift = F.lead("__end") if ahead else F.lag("__end")
    carry = ends.withColumn("__far", shift.over(across)).drop("__end")
    joined = carry_join(rows.withColumn("__near", step.over(inside)), carry, [*k, shard], ["__far"])
    found = F.coalesce("__near", "__far")
    return joined.select(*df.columns, *[found[c].alias(f"{prefix}{c}") for c in bring])
