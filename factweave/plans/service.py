"""Asking a stored claim graph: its entities say what mentions mean, its artifacts where claims come from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.plans.answers import ClaimGraph
from factweave.sources.store import GraphStore


def graph_of(store: GraphStore) -> ClaimGraph:
    """The verbs of the claim graph over the tables of a store."""
    claims = store.read("claims")
    artifacts = store.read("artifacts").select(F.col("id").alias("artifact_id"), F.col("source").alias("source_id"), F.col("source").alias("source_name"), F.col("type").alias("kind"))
    entities = store.read("entities")
    names = entities.select(F.explode(F.array_distinct(F.concat(F.array("name"), "mentions", "aliases"))).alias("mention"), F.col("entity_key").alias("entity")).where("mention is not null")
    return ClaimGraph(claims, names, claims.join(artifacts, "artifact_id"))


def ask(store: GraphStore, asked: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Answers of ``ClaimGraph.answer`` with the names of the subjects, for ``asked(question_id, question)``."""
    found = graph_of(store).answer(asked, texts)
    names = store.read("entities").select(F.col("entity_key").alias("subject_id"), F.col("name").alias("__name"))
    named = found.join(names, "subject_id", "left")
    text = F.when(F.col("status") == "found", F.when(F.col("answer") == F.col("subject_id"), F.coalesce("__name", "answer")).otherwise(F.col("answer"))).otherwise(F.col("answer"))
    return named.withColumn("answer", text).select(*found.columns)


def health(store: GraphStore) -> dict[str, int]:
    """Rows of every table of a store; zero for one that was never written."""
    return {n: t.count() if (t := store.read(n)) is not None else 0 for n in ("artifacts", "entities", "claims")}
