"""Sharded windows against plain ones."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from factweave.plans import sharded
from factweave.plans.small import bounded, collected


@pytest.fixture(scope="module")
def rows(spark):
    r = spark.range(2000).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"))
    return r.withColumn("k", F.when(F.col("k") == 2, None).otherwise(F.col("k"))).withColumn("shard", F.floor(F.col("t") / 100))


def test_row_number_and_sum(rows):
    w = Window.partitionBy("k").orderBy("t")
    want = rows.withColumn("n", F.row_number().over(w).cast("long")).withColumn("s", F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    got = sharded.running_sum(sharded.row_number(rows, ["k"], "shard", [F.col("t")], "n"), ["k"], "shard", [F.col("t")], "v", "s")
    assert sorted(map(str, got.select("k", "t", "n", "s").collect())) == sorted(map(str, want.select("k", "t", "n", "s").collect()))


@pytest.mark.parametrize("ahead", [True, False])
def test_neighbour(rows, ahead):
    w = Window.partitionBy("k").orderBy("t")
    step = F.lead("v") if ahead else F.lag("v")
    want = rows.withColumn("x_v", step.over(w)).select("k", "t", "x_v")
    got = sharded.neighbour(rows, ["k"], "shard", ["t"], ["v"], ahead, "x_").select("k", "t", "x_v")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_bounds(spark):
    small, big = spark.range(5), spark.range(50)
    assert "broadcast" in bounded(small, 10)._jdf.queryExecution().toString().lower()
    assert "hint" not in bounded(big, 10)._jdf.queryExecution().logical().toString().lower()
    with pytest.raises(ValueError):
        collected(big, 10, "rows")
