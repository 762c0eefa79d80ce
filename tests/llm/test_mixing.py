"""Problem 9: Pfair bounds, shares, repeats."""

from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factweave.llm import mixing as M


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=7))
def test_schedule_is_less_than_a_block_off(counts):
    blocks = {f"s{i}": n for i, n in enumerate(counts)}
    plan = M.schedule(blocks)
    total = sum(counts)
    assert sorted(x[2] for x in plan) == list(range(total))
    done = dict.fromkeys(blocks, 0)
    for s, j, slot in sorted(plan, key=lambda x: x[2]):
        assert done[s] == j
        done[s] += 1
        for k, n in blocks.items():
            assert abs(done[k] - Fraction(n * (slot + 1), total)) < 1


def test_allot_passes_on_what_a_source_cannot_give():
    got = M.allot({"a": 0.5, "b": 0.25, "c": 0.25, "d": 0.0}, {"a": 100, "b": 1000, "c": 1000, "d": 50}, 1000)
    assert got["a"] == 100 and got["b"] == got["c"] == 450 and got["d"] == 0
    assert sum(M.allot({"a": 1.0}, {"a": 10}, 1000).values()) == 10
    assert M.allot({}, {}, 10) == {}


def test_mix(spark):
    docs = spark.range(2000).select("id", F.when(F.col("id") % 10 < 8, "Big ").when(F.col("id") % 10 == 8, "small").otherwise(None).alias("source"), (F.col("id") % 50).cast("long").alias("tokens"))
    docs = docs.withColumnRenamed("id", "doc_id").withColumn("block", F.lit("x")).unionByName(spark.createDataFrame([(9999, "small", None, "x")], "doc_id long, source string, tokens long, block string"))
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 2), ("absent", 0.1, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    got = M.mix(docs, targets, 500).collect()
    uses = {}
    for r in got:
        uses.setdefault((r.source, r.doc_id), []).append(r.use_no)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in uses.values())
    assert max(len(v) for k, v in uses.items() if k[0] == "big") == 1 and max(len(v) for k, v in uses.items() if k[0] == "small") == 2
    total = docs.agg(F.sum("tokens")).first()[0]
    share = {s: sum(r.tokens for r in got if r.source == s) / total for s in ("big", "small")}
    have = {r.s: r.n / total for r in docs.groupBy(F.trim(F.lower("source")).alias("s")).agg(F.sum("tokens").alias("n")).collect()}
    assert abs(share["small"] - min(0.4, 2 * have["small"])) < 0.01
    assert abs(share["big"] - min(have["big"], 1 - share["small"])) < 0.01
    assert M.mix(docs.limit(0), targets).count() == 0 and M.mix(docs, targets.limit(0)).count() == 0
