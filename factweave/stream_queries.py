"""Queries that replay tables through streams, and files through sources, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave import contract_queries, state_queries
from factweave.operators import claims as C
from factweave.operators import state as S
from factweave.plans.lineage import shared_dir
from factweave.sources import files
from factweave.sources.store import GraphStore
from factweave.sources.tables import table
from factweave.streaming import ingest as G
from factweave.streaming import worker


def dedup(spark, folder):
    kept = G.deduplicated(G.replay(G.events(spark, folder), 3, "at"), "event_id", "record_key", "at")
    return kept.select("event_id", "record_key")


def parked(spark, folder):
    """Events whose value is not above 10 fail; what three attempts could not take is parked."""
    log, left = G.ingested(G.replay(G.events(spark, folder), 4, "event_id"), lambda rows: rows.withColumn("good", F.col("value") > 10), "good")
    return log.select("event_id", F.lit("log").alias("where_")).unionByName(left.select("event_id", F.lit("parked").alias("where_")))


def late_claims(spark, folder):
    """Current state from a claim log that arrived shuffled: order is only made when it is asked."""
    claims = C.order_claims(spark, folder).withColumn("arrival", F.xxhash64("claim_id"))
    stream = G.replay(claims, 3, "arrival")
    at = shared_dir(spark, "claim-log")
    G.run(stream, lambda batch, no: batch.write.mode("overwrite").parquet(f"{at}/log/{no}"), at)
    return S.current(spark.read.option("recursiveFileLookup", "true").parquet(f"{at}/log"))


def windows(spark, folder):
    w = G.windowed(G.replay(G.events(spark, folder), 3, "at"), "at", "1 day", "2 days", "event_type")
    return w.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def round_trip(spark, folder):
    at = shared_dir(spark, "jsonl")
    files.write_jsonl(table(spark, folder, "claims_checkpoint50"), at)
    back = files.read_jsonl(spark, at, files.CLAIM)
    return back.groupBy("claim_id", "predicate", "observed_at").agg(F.count(F.lit(1)).alias("rows"))


def worked(spark, folder):
    """The graph after all artifacts came in three micro-batches, a third of them twice."""
    a = table(spark, folder, "artifacts").select("id", "source", "type", "title", "author", "timestamp", "content", "metadata").withColumn("__n", F.xxhash64("id", "content"))
    store = GraphStore(spark, shared_dir(spark, "worked"))
    worker.work(G.replay(a, 3, "__n").drop("__n"), store, contract_queries.label(F.col("mention")), shared_dir(spark, "worker"))
    return store


def looked_up(spark, folder):
    """Events with the customer whose number is that of their user."""
    e = G.replay(G.events(spark, folder).withColumn("c_custkey", F.col("user_id").cast("long")), 2, "event_id")
    at = shared_dir(spark, "looked-up")
    G.run(G.looked_up(e, table(spark, folder, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name"), "c_custkey"), lambda batch, no: batch.write.mode("overwrite").parquet(f"{at}/{no}"), f"{at}-state")
    return spark.read.option("recursiveFileLookup", "true").parquet(at).select("event_id", "c_name")


def unique_soon(spark, folder):
    e = G.events(spark, folder).unionByName(G.events(spark, folder))
    at = shared_dir(spark, "unique")
    G.run(G.unique_soon(G.replay(e, 3, "at"), "at", "2 days", "event_id"), lambda batch, no: batch.write.mode("overwrite").parquet(f"{at}/{no}"), f"{at}-state")
    return spark.read.option("recursiveFileLookup", "true").parquet(at).select("event_id")


QUERIES = {
    "N03_unique_soon": unique_soon,
    "N04_worker_artifacts": lambda s, d: worked(s, d).read("artifacts").groupBy("source").agg(F.count(F.lit(1)).alias("artifacts")),
    "N04_worker_claims": lambda s, d: worked(s, d).read("claims").select("claim_id", "subject_id", "predicate", "object_id"),
    "N07_keyed_fetch": looked_up,
    "N02_either_key_dedup": dedup, "N05_retry_and_park": parked, "N09_late_claims": late_claims, "N10_windows": windows, "A01_jsonl_round_trip": round_trip}

ORACLES = {
    "N03_unique_soon": "SELECT event_id FROM events",
    "N04_worker_artifacts": "SELECT source, count(DISTINCT id) AS artifacts FROM artifacts GROUP BY 1",
    "N07_keyed_fetch": "SELECT event_id, c_name FROM events LEFT JOIN customer ON c_custkey = user_id",
    "N05_retry_and_park": "SELECT event_id, CASE WHEN value > 10 THEN 'log' ELSE 'parked' END AS where_ FROM events",
    "N02_either_key_dedup": "SELECT event_id, user_id || '|' || event_type AS record_key FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1",
    "N09_late_claims": state_queries.ORACLES["F01_current_state"],
    "N10_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "A01_jsonl_round_trip": "SELECT claim_id, predicate, observed_at, count(*) AS rows FROM claims_checkpoint50 GROUP BY 1, 2, 3",
}
