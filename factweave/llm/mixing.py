"""Problem 9: mixing sources to target weights by Pfair scheduling of token blocks."""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.tokens import with_tokens
from factweave.plans import sharded
from factweave.plans.lineage import stored
from factweave.plans.small import collected
from factweave.sources.tables import table

#: Blocks of the whole mix; a block is the mix's tokens divided by this, at least one token.
BLOCKS = 20_000
#: Sources of a mix. The schedule is computed for these, never for documents.
MAX_SOURCES = 10_000
#: Shards into which a source's documents are cut for running sums.
SHARDS = 4096


def allot(wanted: dict[str, float], capacity: dict[str, int], total: int) -> dict[str, Fraction]:
    """Tokens of each source: its share of ``total``, as far as its capacity goes.

    What the exhausted sources cannot give is given to the others in proportion to their
    targets, until nothing is left to give or to take.
    """
    weight = {s: Fraction(w).limit_denominator(10**9) for s, w in wanted.items() if w and w > 0}
    got = {s: Fraction(0) for s in wanted}
    open_ = {s for s in weight if capacity.get(s, 0) > 0}
    left = Fraction(total)
    while open_ and left > 0:
        whole = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / whole >= capacity[s]}
        if not full:
            for s in open_:
                got[s] = left * weight[s] / whole
            break
        for s in full:
            got[s] = Fraction(capacity[s])
            left -= capacity[s]
        open_ -= full
    return got


def schedule(blocks: dict[str, int]) -> list[tuple[str, int, int]]:
    """``(source, block, slot)`` of an earliest-deadline-first Pfair schedule.

    Source ``s`` has ``blocks[s]`` unit blocks over as many slots as there are blocks in all,
    so its weight is ``w = blocks[s] / slots``. Block ``j`` (from 0) is released at
    ``floor(j / w)`` and due by ``ceil((j + 1) / w)``. Of the released blocks the one due first
    goes next; the weights sum to one, so every block is in time and each source is less than
    one block off its share at any time.
    """
    slots = sum(blocks.values())
    later = [(0, s, 0) for s, n in sorted(blocks.items()) if n > 0]
    heapq.heapify(later)
    ready: list[tuple[int, int, str, int]] = []
    out = []
    for slot in range(slots):
        while later and later[0][0] <= slot:
            _, s, j = heapq.heappop(later)
            # Of equal deadlines the one whose next release comes first (overlapping windows).
            n = blocks[s]
            heapq.heappush(ready, (-(-(j + 1) * slots // n), (j + 1) * slots // n, s, j))
        _, _, s, j = heapq.heappop(ready)
        out.append((s, j, slot))
        if j + 1 < blocks[s]:
            heapq.heappush(later, ((j + 1) * slots // blocks[s], s, j + 1))
    return out


def whole_blocks(tokens: dict[str, Fraction], size: Fraction) -> dict[str, int]:
    """Blocks of each source, rounded by largest remainder so that they sum to the whole."""
    exact = {s: t / size for s, t in tokens.items()}
    down = {s: int(x) for s, x in exact.items()}
    short = round(sum(exact.values())) - sum(down.values())
    for s in sorted(exact, key=lambda s: (down[s] - exact[s], s))[: max(0, short)]:
        down[s] += 1
    return down


def mix(documents: DataFrame, targets: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """``slot, source, block, doc_id, use_no, tokens``: what the mix holds, in its order.

    ``documents(doc_id, source, tokens)`` and ``targets(source, target_share, max_repeats)``;
    sources are compared without case and blanks around them. Documents without a target, a
    source or a token, and targets without documents, give nothing. A source runs through its
    documents in the order of a hash, again from the start up to ``max_repeats`` times, and a
    document belongs to the block in which its first token falls; within a slot ``use_no`` and
    the hash give the order. Rows are numbered by running sums over hash shards, so a source
    that holds most documents is no hot task; only the schedule's blocks are broadcast.
    """
    spark = documents.sparkSession
    key = F.lower(F.trim("source"))
    have = documents.where("tokens > 0").select("doc_id", key.alias("source"), F.col("tokens").cast("long").alias("tokens"))
    rules = {r["s"]: r for r in collected(
        targets.where("source is not null").groupBy(key.alias("s")).agg(F.sum("target_share").alias("w"), F.max("max_repeats").alias("m")), MAX_SOURCES, "mix targets"
    )}
    sizes = have.groupBy("source").agg(F.sum("tokens").alias("n"), F.max("tokens").alias("most"))
    totals = {r["source"]: int(r["n"]) for r in sizes.where(F.col("source").isin(list(rules) or [""])).collect()}
    total = int(have.agg(F.sum("tokens")).first()[0] or 0)
    capacity = {s: totals.get(s, 0) * max(0, r["m"] or 0) for s, r in rules.items()}
    tokens = allot({s: r["w"] for s, r in rules.items()}, capacity, total)
    size = max(Fraction(1), Fraction(total, max(1, blocks)))
    plan = whole_blocks(tokens, size)
    slots = spark.createDataFrame(schedule(plan) or [("", -1, -1)], "source string, block long, slot long")
    goal = spark.createDataFrame(
        [
            (s, totals[s], min(rules[s]["m"], -(-plan[s] * size.numerator // (size.denominator * totals[s]))))
            for s in plan if plan[s] > 0
        ] or [("", 0, 0)],
        "source string, source_tokens long, uses long",
    )
    hashed = have.withColumn("__h", F.xxhash64("doc_id")).withColumn("__shard", F.shiftright("__h", 64 - SHARDS.bit_length() + 1))
    placed = sharded.running_sum(hashed, ["source"], "__shard", [F.col("__h"), F.col("doc_id")], "tokens", "__at")
    used = placed.join(F.broadcast(goal), "source").withColumn("use_no", F.explode(F.sequence(F.lit(1), F.col("uses").cast("int"))))
    start = F.col("__at") + (F.col("use_no") - 1).cast("long") * F.col("source_tokens")
    block = F.floor(start * F.lit(size.denominator) / F.lit(size.numerator)).cast("long")
    return used.withColumn("block", block).join(F.broadcast(slots), ["source", "block"]).select("slot", "source", "block", "doc_id", "use_no", "tokens")


def counted(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, source, tokens`` of the documents, counted once and stored."""
    docs = with_tokens(table(spark, folder, "documents").select("doc_id", "source", "text"), "text", "tokens")
    return stored(docs.select("doc_id", "source", "tokens"), "tokens")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached share of each source, and how often its documents are used."""
    docs, targets = counted(spark, folder), table(spark, folder, "mix_targets")
    got = mix(docs, targets).groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"), F.max("use_no").alias("most_uses"))
    total = got.agg(F.sum("tokens").alias("total"))
    named = targets.withColumn("source", F.lower(F.trim("source")))
    joined = named.join(got, "source", "left").crossJoin(F.broadcast(total))  # one row
    return joined.select(
        "source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("uses", F.lit(0)).alias("uses"),
        F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.round(F.coalesce("tokens", F.lit(0)) / F.col("total"), 6).alias("actual_share"),
    )


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The mix itself: every use of a document with its slot."""
    return mix(counted(spark, folder), table(spark, folder, "mix_targets"))
