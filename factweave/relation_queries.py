"""Queries on hand-overs and relations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.operators import relations as L
from factweave.operators.extract import lexicon_matches
from factweave.plans.lineage import stored
from factweave.sources.tables import table

OWN = ["tidemark.test"]


def texts(spark, folder):
    """The documents as artifacts; a line of each kind of hand-over is added to most."""
    d, k = table(spark, folder, "documents"), F.col("doc_id")
    month = F.date_format(F.date_add(F.col("created_at").cast("date"), 10), "MMMM d")
    said = F.when(k % 7 == 0, F.concat(F.lit("I am taking over Acme effective "), month)).when(k % 7 == 1, F.lit("handing off Zeta account starting June 3, 2024")).when(k % 7 == 2, F.lit("Ann Lee owns Borealis from March 9")).when(k % 7 == 3, F.concat(F.lit("still own Acme until "), month)).when(k % 7 == 4, F.lit("Acme transfers from Ann Lee to Bo Ray effective July 1, 2025")).when(k % 7 == 5, F.lit("taking over Acme from March 1"))
    return d.select(F.concat_ws(":", F.lit("doc"), k).alias("id"), F.lower("source").alias("source"), "author", F.col("created_at").cast("date").alias("observed"), F.concat_ws("\n", F.coalesce("text", F.lit("")), said).alias("content"), "title", said.alias("said"))


def entries(spark, folder):
    """The authors and accounts of the documents as people and accounts, and where the documents name them."""
    d = table(spark, folder, "documents")
    people = d.select(F.trim("author").alias("mention"), F.lit("Person").alias("label")).where("mention rlike '^[A-Z][a-z]+ [A-Z][a-z]+$'")
    accounts = d.select(F.initcap(F.replace(F.regexp_replace("account_key", "^account:", ""), F.lit("-"), F.lit(" "))).alias("mention"), F.lit("Account").alias("label")).where("mention is not null")
    r = people.union(accounts).distinct().withColumn("entity_key", F.concat_ws(":", F.lower("label"), F.regexp_replace(F.lower("mention"), "[^a-z0-9]+", "-")))
    found = lexicon_matches(texts(spark, folder).select(F.col("id").alias("artifact_id"), "content"), r.select(F.col("entity_key").alias("entity"), F.col("mention").alias("phrase")))
    return found.join(r.select(F.col("entity_key").alias("entity"), F.col("mention").alias("phrase"), "label"), ["entity", "phrase"]).select("artifact_id", F.col("entity").alias("entity_key"), "label", F.col("phrase").alias("mention"))


def relations(spark, folder):
    """Relations in the documents; every candidate pair is also stated once in the text."""
    c = stored(entries(spark, folder), "candidates")
    one = c.groupBy("artifact_id").agg(F.min(F.when(F.col("label") == "Person", F.col("mention"))).alias("p"), F.min(F.when(F.col("label") == "Account", F.col("mention"))).alias("a")).where("p is not null and a is not null")
    h = F.pmod(F.xxhash64("id"), F.lit(4))
    line = F.when(h == 0, F.concat("p", F.lit(" leads "), "a")).when(h == 1, F.concat(F.lit("Assigned to: "), "p")).when(h == 2, F.concat("p", F.lit(" (Security PM)"))).otherwise(F.concat("p", F.lit(" is responsible for "), "a"))
    t = texts(spark, folder).join(one.withColumnRenamed("artifact_id", "id"), "id", "left").withColumn("content", F.concat_ws("\n", "content", line.alias("x")))
    return t, c, L.relations(t, c, OWN)


def refined(spark, folder):
    _, _, found = relations(spark, folder)
    found = stored(found.withColumn("ambiguous", F.col("signal") == "attendee-role"), "relations")
    offers = found.select("artifact_id", "subject_key", "object_key", F.when(F.length("artifact_id") % 2 == 0, "leads").otherwise("BLOCKS").alias("predicate"), F.lit(0.9).alias("confidence"))
    return L.refine(found, offers).groupBy("signal", "predicate").agg(F.count(F.lit(1)).alias("relations"))


def funnel(spark, folder):
    t, c, found = relations(spark, folder)
    return L.coverage(t, c, found)


QUERIES = {
    "B28_effective_dates": lambda s, d: L.effective_dates(texts(s, d).select("id", F.lit("Acme").alias("account"), "observed", F.col("said").alias("content")), s.createDataFrame([("acme", 2023)], "account string, year int")).select("id", "effective", "until"),
    "B29_anchors": lambda s, d: L.anchors(texts(s, d).select(F.split_part("id", F.lit(":"), F.lit(2)).cast("int").alias("n"), "observed", F.col("said").alias("content")).select((F.col("n") % 50).cast("string").alias("account"), "observed", "content", F.col("n").alias("ordinal"))),
    "K08_handoffs": lambda s, d: L.handoff_claims(texts(s, d).withColumn("content", F.col("said"))).select("artifact_id", "subject_mention", "object_mention", "valid_from", "valid_to"),
    "K08_handoffs_in_texts": lambda s, d: L.handoffs(texts(s, d)).groupBy("role", "object_mention").agg(F.count(F.lit(1)).alias("found")),
    "K05_relations": lambda s, d: relations(s, d)[2].groupBy("signal", "predicate").agg(F.count(F.lit(1)).alias("relations")),
    "K10_refined": refined,
    "E03_funnel": funnel,
}

_T = """t AS (SELECT doc_id, 'doc:' || doc_id AS id, author, CAST(created_at AS DATE) AS observed, CASE doc_id % 7 WHEN 0 THEN 'I am taking over Acme effective ' || strftime(CAST(created_at AS DATE) + 10, '%B %-d') WHEN 1 THEN 'handing off Zeta account starting June 3, 2024' WHEN 2 THEN 'Ann Lee owns Borealis from March 9'
  WHEN 3 THEN 'still own Acme until ' || strftime(CAST(created_at AS DATE) + 10, '%B %-d') WHEN 4 THEN 'Acme transfers from Ann Lee to Bo Ray effective July 1, 2025' WHEN 5 THEN 'taking over Acme from March 1' END AS said FROM documents)"""


def _near(month: str, day: str) -> str:
    at = f"try_cast(year(observed) || '-' || lpad({month}, 2, '0') || '-' || lpad({day}, 2, '0') AS DATE)"
    return f"CASE WHEN date_diff('day', observed, {at}) BETWEEN -7 AND 45 THEN {at} END"


_PLUS = "CAST(created_at AS DATE) + 10"
_MD = """m AS (SELECT *, CASE doc_id % 7 WHEN 2 THEN 3 WHEN 5 THEN 3 WHEN 0 THEN month(observed + 10) WHEN 3 THEN month(observed + 10) END AS mo, CASE doc_id % 7 WHEN 2 THEN 9 WHEN 5 THEN 1 WHEN 0 THEN day(observed + 10) WHEN 3 THEN day(observed + 10) END AS da FROM t)"""
_N = _near("CAST(mo AS VARCHAR)", "CAST(da AS VARCHAR)")
_OTHER = "try_cast('2023-' || lpad(CAST(mo AS VARCHAR), 2, '0') || '-' || lpad(CAST(da AS VARCHAR), 2, '0') AS DATE)"

ORACLES = {
    "B28_effective_dates": f"WITH {_T}, {_MD} SELECT id, CASE WHEN said IS NULL THEN NULL WHEN doc_id % 7 = 1 THEN DATE '2024-06-03' WHEN doc_id % 7 = 4 THEN DATE '2025-07-01' WHEN doc_id % 7 <> 3 THEN coalesce({_N}, {_OTHER}) END AS effective, CASE WHEN doc_id % 7 = 3 THEN coalesce({_N}, {_OTHER}) END AS until FROM m",
    "B29_anchors": f"WITH {_T}, {_MD} SELECT CAST(doc_id % 50 AS VARCHAR) AS account, CAST(min_by(year(observed), doc_id) AS INTEGER) AS year FROM m WHERE said IS NOT NULL AND {_N} IS NOT NULL GROUP BY 1",
}
