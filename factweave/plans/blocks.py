"""Pairs inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a group that one task holds against as many others.
BLOCK = 2048


def paired(df: DataFrame, keys: Sequence[str], id_: str, ordered: Column | None = None, block: int = BLOCK) -> DataFrame:
    """Columns of two rows of one group, as ``a_...`` and ``b_...``, with ``keys``; each pair once.

    ``id_`` tells the rows of a group apart. A pair is ordered by it, unless ``ordered`` (a
    condition on the ``a_`` and ``b_`` columns) says otherwise; ``ordered`` has to hold for at
    most one order of two rows. A group of more than ``block`` rows is dealt into blocks by a
    hash and each two blocks meet on their own, so no group is one task, and nothing is
    broadcast. Null keys are no group.
    """
    k = list(keys)
    rest = [c for c in df.columns if c not in k]
    sizes = df.groupBy(*k).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("__k"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    dealt = df.join(sizes.hint("merge"), k).withColumn("__no", F.pmod(F.xxhash64(id_), F.col("__k")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("__k") - 1))
    a = dealt.select(*k, F.col("__no").alias("__i"), every.alias("__j"), *[F.col(c).alias(f"a_{c}") for c in rest])
    b = dealt.select(*k, every.alias("__i"), F.col("__no").alias("__j"), *[F.col(c).alias(f"b_{c}") for c in rest])
    on = F.col(f"a_{id_}") < F.col(f"b_{id_}") if ordered is None else ordered
    return a.join(b.hint("merge"), [*k, "__i", "__j"]).where(on).drop("__i", "__j")
