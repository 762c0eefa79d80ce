"""Incremental ingestion of artifacts into the claim graph, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.operators import extract, resolution
from factweave.sources.store import GraphStore
from factweave.streaming import ingest


def step(batch: DataFrame, store: GraphStore, label: Column) -> dict[str, int]:
    """One batch of artifacts: drop what is there, resolve, extract, gate, load, keep.

    ``batch(id, source, type, title, author, timestamp, content, metadata)``. ``label`` says what
    kind of entity a mention in column ``mention`` is (null: none). Entities of earlier batches
    stay and take in what is new. Doing a batch again changes nothing, so it may be repeated
    after a failure. Returns how many artifacts were new, and claims per code.
    """
    there = store.read("artifacts")
    fresh = batch if there is None else batch.join(there.select("id"), "id", "left_anti")
    fresh = fresh.groupBy("id").agg(F.max_by(F.struct(*[c for c in fresh.columns if c != "id"]), F.struct(F.coalesce("timestamp", F.lit("")), F.coalesce("content", F.lit("")))).alias("r")).select("id", "r.*").persist()
    try:
        new = fresh.count()
        if not new:
            return {"new": 0}
        store.load_artifacts(fresh)
        people = resolution.resolutions(resolution.merged(resolution.candidates(fresh)))
        made = extract.claims(fresh)
        said = made.select(F.explode(F.array("subject_mention", "object_mention")).alias("mention")).distinct().withColumn("label", label).where("label is not null")
        named = said.select(F.concat_ws(":", F.lower("label"), resolution.slug(F.col("mention"))).alias("entity_key"), F.col("mention").alias("name"), "label", F.array("mention").alias("mentions"), F.array().cast("array<string>").alias("aliases"))
        store.load_entities(_united(store, people.unionByName(named)))
        known = store.read("entities").select(F.explode(F.array_distinct(F.concat(F.array("name"), "mentions"))).alias("mention"), F.col("entity_key").alias("entity"), "label")
        rows = made.join(fresh.select(F.col("id").alias("artifact_id"), F.left("timestamp", F.lit(10)).alias("observed_at")), "artifact_id")
        rows = rows.withColumns({"observed_at": F.when(F.col("observed_at").try_cast("date").isNotNull(), F.col("observed_at")), "valid_from": F.lit(None).cast("string"), "valid_to": F.lit(None).cast("string"), "extraction_method": F.lit("deterministic")})
        return {"new": new} | store.load_claims(rows, known)
    finally:
        fresh.unpersist()


def _united(store: GraphStore, rows: DataFrame) -> DataFrame:
    """Entities of a batch with the mentions and aliases that the store has of them."""
    old = store.read("entities")
    every = rows if old is None else rows.unionByName(old.join(rows.select("entity_key").distinct(), "entity_key", "left_semi"), allowMissingColumns=True)
    both = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    return every.groupBy("entity_key").agg(F.min("name").alias("name"), F.min("label").alias("label"), both("mentions"), both("aliases"))


def work(stream: DataFrame, store: GraphStore, label: Column, at: str) -> list[dict[str, int]]:
    """Runs ``step`` on every micro-batch of all there is; a job started again in ``at`` goes on where it stopped."""
    done: list[dict[str, int]] = []
    ingest.run(stream, lambda batch, no: done.append(step(batch, store, label)), at)
    return done
