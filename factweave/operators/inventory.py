"""Inventories, quality counts, sampling, set operations and scores over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.text import is_blank, mention_key

# The forms that quality counts look for.
QUALITY = {
    "emails": r"[\w.+-]+@[\w-]+\.[\w.-]+",
    "phones": r"\+?\d[\d ().-]{7,}\d",
    "tickets": r"[A-Z]{2,5}-\d{1,6}",
    "urls": r"https?://\S+",
}


def mentions(claims: DataFrame) -> DataFrame:
    """``mention, role, claim_id, artifact_id, method``: both mentions of every claim."""
    both = F.array(F.struct(F.col("subject_mention").alias("mention"), F.lit("subject").alias("role")), F.struct(F.col("object_mention").alias("mention"), F.lit("object").alias("role")))
    return claims.select(F.explode(both).alias("m"), "claim_id", "artifact_id", F.col("extraction_method").alias("method")).select("m.*", "claim_id", "artifact_id", "method")


def mention_inventory(found: DataFrame) -> DataFrame:
    """Per key and role: how often, in how many claims and artifacts, by how many methods, and one spelling.

    Blank mentions are left out. All counts have partial results, so a frequent mention is no hot task.
    """
    named = found.where(~is_blank(F.col("mention"))).withColumn("key", mention_key(F.col("mention")))
    return named.groupBy("key", "role").agg(
        F.count(F.lit(1)).alias("frequency"), F.count_distinct("claim_id").alias("claims"), F.count_distinct("artifact_id").alias("artifacts"),
        F.count_distinct("method").alias("methods"), F.min("mention").alias("spelling"),
    )


def source_overlap(items: DataFrame) -> DataFrame:
    """``source_a, source_b, shared``: how many different items two sources have in common.

    ``items(source, item)``. Sources are few, items many: each item is first reduced to its
    distinct sources, so a pair is only made of sources.
    """
    one = items.where("source is not null and item is not null").distinct().groupBy("item").agg(F.array_sort(F.collect_set("source")).alias("s")).where("size(s) > 1")
    pair = F.explode(F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("source_a"), b.alias("source_b"))))))
    return one.select(pair.alias("p")).groupBy("p.source_a", "p.source_b").agg(F.count(F.lit(1)).alias("shared"))


def quality(records: DataFrame, by: str, text: str) -> DataFrame:
    """Per source: rows, blank and repeated texts, lengths, and how often each form occurs."""
    c = F.coalesce(F.col(text), F.lit(""))
    counts = [F.sum(F.regexp_count(c, F.lit(p))).cast("long").alias(n) for n, p in QUALITY.items()]
    per = records.groupBy(by).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(is_blank(F.col(text))).alias("blank"), F.min(F.length(c)).alias("shortest"), F.max(F.length(c)).alias("longest"), *counts
    )
    copies = records.where(~is_blank(F.col(text))).groupBy(by, F.sha2(F.col(text), 256).alias("h")).agg(F.count(F.lit(1)).alias("n")).groupBy(by).agg(F.sum(F.col("n") - 1).alias("copies"))
    return per.join(copies, by, "left").withColumn("copies", F.coalesce("copies", F.lit(0)))


def first_per(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; limited before the shuffle."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__rn = 1").drop("__rn")


def top_per(df: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key with their ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)


def round_robin(df: DataFrame, stratum: str, order: list[Column], n: int) -> DataFrame:
    """``n`` rows picked in turn from the strata, each in its own order; ``turn`` tells the round.

    At most ``n`` rows of a stratum can be picked, so no more than that leave their partition.
    """
    ranked = top_per(df, [stratum], order, n).withColumnRenamed("rank", "turn")
    return ranked.orderBy("turn", stratum).limit(n)


def hash_order(key: str, seed: str) -> Column:
    """An order that looks random and is the same everywhere."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def page(df: DataFrame, position: str, after, size: int) -> DataFrame:
    """The ``size`` rows that follow the position ``after`` (none: from the start)."""
    rest = df if after is None else df.where(F.col(position) > F.lit(after))
    return rest.orderBy(position).limit(size)


def prf(predicted: DataFrame, gold: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1, to four digits, of distinct keys ``item`` (per ``by``).

    Zero where nothing was predicted or wanted.
    """
    g = by or []
    cols = [*g, "item"]
    p = predicted.select(*cols).distinct().withColumn("p", F.lit(1))
    w = gold.select(*cols).distinct().withColumn("g", F.lit(1))
    both = p.join(w, cols, "full")
    n = both.groupBy(*g).agg(F.count_if(F.expr("p = 1 and g = 1")).alias("tp"), F.count_if(F.expr("p = 1 and g is null")).alias("fp"), F.count_if(F.expr("p is null and g = 1")).alias("fn"))

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    prec, rec = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = share(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return n.select(*g, "tp", "fp", "fn", F.round(prec, 4).alias("precision"), F.round(rec, 4).alias("recall"), F.round(f1, 4).alias("f1"))


def nearest_rank(value: str, share: float) -> Column:
    """Value at the nearest rank, from the sorted values of a group of bounded size."""
    s = F.array_sort(F.collect_list(value))
    return F.element_at(s, F.greatest(F.floor(F.size(s) * F.lit(share)).cast("int"), F.lit(1)))


def latency(df: DataFrame, by: str, value: str) -> DataFrame:
    """Count, mean and interpolated percentiles of a measure per group."""
    return df.groupBy(by).agg(
        F.count(value).alias("n"), F.round(F.avg(value), 4).alias("mean"),
        *[F.round(F.percentile(value, p), 4).alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))],
    )


def nearest_ranks(df: DataFrame, by: str, value: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """``by, n`` and per share the value at the nearest rank below it (at least the first).

    Values are counted before they are ordered, so a group of any size is as many rows as it has
    different values; nulls do not count.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("c").over(Window.partitionBy(by))
    placed = counts.withColumns({"__upto": upto, "__n": whole})
    picks = [F.min(F.when(F.col("__upto") >= F.greatest(F.floor(F.col("__n") * F.lit(p)), F.lit(1)), F.col(value))).alias(f"p{round(p * 100)}") for p in shares]
    return placed.groupBy(by).agg(F.max("__n").alias("n"), *picks)


def histogram(df: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """``feature, bin, n``: how many values of features between 0 and 1 lie in each bin; 1 is in the last one."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select("x.*").where("value is not null")
    return long.groupBy("feature", F.least(F.floor(F.col("value") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def size_bucket(length: Column) -> Column:
    """``short``, ``medium`` or ``long`` by letters."""
    return F.when(length < 400, "short").when(length > 8000, "long").otherwise("medium")


def scanned(docs: DataFrame, by: str, text: str) -> DataFrame:
    """Per group: files, bytes, shortest, longest, the first six ids, and how many texts hold headers, tickets or addresses."""
    c = F.coalesce(F.col(text), F.lit(""))
    firsts = top_per(docs.select(by, "doc_id"), [by], [F.col("doc_id")], 6).groupBy(by).agg(F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("first_ids"))
    counts = docs.groupBy(by).agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.octet_length(c)).alias("bytes"), F.min(F.length(c)).alias("shortest"), F.max(F.length(c)).alias("longest"),
        F.count_if(c.rlike(r"(?m)^(From|Date|Subject):")).alias("with_headers"), F.count_if(c.rlike(QUALITY["tickets"])).alias("with_tickets"), F.count_if(c.rlike(QUALITY["emails"])).alias("with_addresses"),
    )
    return counts.join(firsts, by)
