"""Traversals of the claim graph: provenance, co-occurrence, edges, neighbourhoods, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.operators.claims import OPEN_START
from factweave.operators.state import KEY
from factweave.plans import blocks, sharded
from factweave.plans.small import bounded


def provenance(claims: DataFrame, artifacts: DataFrame, sources: DataFrame) -> DataFrame:
    """Claim, artifact and source of every claim: ``artifacts(artifact_id, source_id, kind)``, ``sources(source_id, source_name)``.

    Claims without artifact or source are left out; a source table of proven small size is broadcast.
    """
    return claims.join(artifacts, "artifact_id").join(bounded(sources), "source_id")


def cooccurring(claims: DataFrame) -> DataFrame:
    """``subject_id, other_id``: different subjects with claims from one artifact, distinct.

    An artifact with very many subjects is met block by block.
    """
    one = claims.select("artifact_id", "subject_id").where("subject_id is not null").distinct()
    met = blocks.paired(one, ["artifact_id"], "subject_id").select("a_subject_id", "b_subject_id").distinct()
    return met.select(F.explode(F.array(F.struct(F.col("a_subject_id").alias("subject_id"), F.col("b_subject_id").alias("other_id")), F.struct(F.col("b_subject_id").alias("subject_id"), F.col("a_subject_id").alias("other_id")))).alias("x")).select("x.*")


def cooccurring_with(claims: DataFrame, subjects: DataFrame) -> DataFrame:
    """``subject_id, other_id`` of ``cooccurring`` for some subjects (``subjects(subject_id)``) only.

    Their artifacts are found first; subjects of very many artifacts, and artifacts of very many
    subjects, are equality joins that adaptive execution splits.
    """
    one = claims.select("artifact_id", "subject_id").where("subject_id is not null and artifact_id is not null")
    asked = subjects.where("subject_id is not null").distinct()
    own = one.join(bounded(asked), "subject_id", "left_semi").distinct()
    met = own.join(one.select("artifact_id", F.col("subject_id").alias("other_id")).distinct().hint("merge"), "artifact_id")
    return met.where("subject_id <> other_id").select("subject_id", "other_id").distinct()


def edges(claims: DataFrame) -> DataFrame:
    """``src, dst, rel, valid_from, valid_to`` of every claim: each keeps its own period."""
    return claims.select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst"), F.col("predicate").alias("rel"), "valid_from", "valid_to")


def edge_history(edges_: DataFrame) -> DataFrame:
    """``src, dst, rel, seq, valid_from, valid_to``: the periods of one relation between two nodes, numbered in time order."""
    years = edges_.withColumn("__year", F.year("valid_from"))
    return sharded.row_number(years, ["src", "dst", "rel"], "__year", [F.col("valid_from"), F.col("valid_to")], "seq").drop("__year")


def hops(edges_: DataFrame, outgoing: bool) -> DataFrame:
    """``node, rel, neighbour``: what each node points to, or what points at it, distinct."""
    a, b = ("src", "dst") if outgoing else ("dst", "src")
    return edges_.select(F.col(a).alias("node"), "rel", F.col(b).alias("neighbour")).where("node is not null and neighbour is not null").distinct()


def about(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """Claims about some entities (``entities(object_id)``), numbered per key by observation; nulls first."""
    seen = F.coalesce("observed_at", F.lit(OPEN_START).cast("date"))
    kept = claims.join(entities.select("object_id").distinct(), "object_id", "left_semi").withColumns({"__seen": seen, "__year": F.year(seen)})
    return sharded.row_number(kept, KEY, "__year", [F.col("__seen"), F.col("claim_id")], "seq").drop("__seen", "__year")


def degree(edges_: DataFrame, outgoing: bool) -> DataFrame:
    """``node, rel, neighbours``: how many different nodes a node points to, or is pointed at by."""
    a, b = ("src", "dst") if outgoing else ("dst", "src")
    return edges_.groupBy(F.col(a).alias("node"), "rel").agg(F.count_distinct(b).alias("neighbours"))


def two_hop(claims: DataFrame) -> DataFrame:
    """``object_id, other_object, artifacts``: objects linked by claims from the same artifact."""
    one = claims.select("artifact_id", "object_id").where("object_id is not null").distinct()
    met = blocks.paired(one, ["artifact_id"], "object_id")
    return met.groupBy(F.col("a_object_id").alias("object_id"), F.col("b_object_id").alias("other_object")).agg(F.count(F.lit(1)).alias("artifacts"))


def export_nodes(claims: DataFrame) -> DataFrame:
    """``id, label`` of every node the claims touch, distinct."""
    ends = F.array(
        F.struct(F.col("subject_id").alias("id"), F.lit("Subject").alias("label")), F.struct(F.col("object_id").alias("id"), F.lit("Object").alias("label")),
        F.struct(F.col("claim_id").alias("id"), F.lit("Claim").alias("label")), F.struct(F.col("artifact_id").alias("id"), F.lit("Artifact").alias("label")),
    )
    return claims.select(F.explode(ends).alias("n")).select("n.*").where("id is not null").distinct()


def export_edges(claims: DataFrame) -> DataFrame:
    """``src, dst, rel``: a claim is about its object, sourced from its artifact, said of its subject."""
    ends = F.array(
        F.struct(F.col("claim_id").alias("src"), F.col("object_id").alias("dst"), F.lit("ABOUT").alias("rel")),
        F.struct(F.col("claim_id").alias("src"), F.col("artifact_id").alias("dst"), F.lit("SOURCED_FROM").alias("rel")),
        F.struct(F.col("subject_id").alias("src"), F.col("object_id").alias("dst"), F.col("predicate").alias("rel")),
    )
    return claims.select(F.explode(ends).alias("e")).select("e.*").where("src is not null and dst is not null").distinct()


def evidence(chain: DataFrame) -> DataFrame:
    """Per key and subject: number of claims, different sources, whether more than one source agrees."""
    per = chain.groupBy(*KEY, "subject_id").agg(F.count(F.lit(1)).alias("claims"), F.count_distinct("source_id").alias("sources"))
    return per.withColumn("multi_source", F.col("sources") > 1)


def rank_evidence(chain: DataFrame, state: DataFrame, weights: dict[str, int], top: int) -> DataFrame:
    """The ``top`` best pieces of evidence of a key: for the current subject, recent, of a good kind.

    Ties go to the smaller claim id. The rank is limited before the shuffle, so a key with very
    many claims does not end in one task.
    """
    now = state.select(*KEY, F.col("subject_id").alias("now"))
    weight = F.coalesce(F.try_element_at(F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(w))]), F.col("kind")), F.lit(0))
    marked = chain.join(now, KEY, "left").withColumn("supports", F.coalesce((F.col("now") == F.col("subject_id")).cast("int"), F.lit(0))).withColumn("weight", weight)
    order = Window.partitionBy(*KEY).orderBy(F.desc("supports"), F.desc("observed_at"), F.desc("weight"), "claim_id")
    return marked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(*KEY, "rank", "claim_id", "subject_id", "supports")


def reachable(edges_: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """``start, node, hops``: nodes within ``depth`` hops along edges, by their shortest way."""
    step = edges_.select("src", "dst").distinct()
    found = start.select(F.col("node").alias("start"), "node").distinct().withColumn("hops", F.lit(0))
    front = found
    for no in range(1, depth + 1):
        nxt = front.join(step, front["node"] == step["src"]).select("start", F.col("dst").alias("node")).distinct()
        front = nxt.join(found.select("start", "node"), ["start", "node"], "left_anti").withColumn("hops", F.lit(no))
        found = found.unionByName(front)
    return found
