"""Scores of extraction, answers and retrieval, and the classes of what went wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.operators.retrieval import ABSTENTION, answers_match, plain


def share(a: Column, b: Column) -> Column:
    """A share to four digits, zero without a whole."""
    return F.round(F.when(b > 0, a / b).otherwise(0.0), 4)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return share(2.0 * tp, 2 * tp + fp + fn)


# ---------------------------------------------------------------- extraction
def expectation(artifacts: DataFrame, gold: DataFrame, ambiguities: DataFrame) -> DataFrame:
    """``artifact_id, expected``: what an artifact should yield: VALID, else what its ambiguity says, else AMBIGUOUS, else NO_CLAIM.

    ``gold(artifact_id, status, item)``, ``ambiguities(artifact_id, status)``.
    """
    g = gold.groupBy("artifact_id").agg(F.bool_or(F.col("status") == "VALID").alias("valid"), F.bool_or(F.col("status") == "AMBIGUOUS").alias("open"))
    a = ambiguities.groupBy("artifact_id").agg(F.min("status").alias("said"))
    met = artifacts.select("artifact_id").distinct().join(g, "artifact_id", "left").join(a, "artifact_id", "left")
    return met.select("artifact_id", F.when(F.col("valid"), "VALID").otherwise(F.coalesce("said", F.when(F.col("open"), "AMBIGUOUS"), F.lit("NO_CLAIM"))).alias("expected"))


def abstention_scores(predicted: DataFrame, gold: DataFrame, expected: DataFrame) -> DataFrame:
    """One row of scores that count abstaining: without a claim to find, none is right and each is wrong.

    ``predicted(artifact_id, item)``, ``gold(artifact_id, status, item)``. Artifacts that are
    AMBIGUOUS are left out, those expected otherwise count by their VALID items.
    """
    p = predicted.select("artifact_id", "item").distinct().withColumn("p", F.lit(1))
    g = gold.where("status = 'VALID'").select("artifact_id", "item").distinct().withColumn("g", F.lit(1))
    per = p.join(g, ["artifact_id", "item"], "full").groupBy("artifact_id").agg(F.count_if(F.expr("p = 1 and g = 1")).alias("tp"), F.count_if(F.expr("p = 1 and g is null")).alias("fp"), F.count_if(F.expr("p is null and g = 1")).alias("fn"), F.count("p").alias("n"))
    met = expected.join(per, "artifact_id", "left").na.fill(0, ["tp", "fp", "fn", "n"])
    none, usual = F.col("expected") == "NO_CLAIM", ~F.col("expected").isin("NO_CLAIM", "AMBIGUOUS")
    s = met.agg(
        F.sum(F.when(usual, F.col("tp")).otherwise(0)).alias("tp"), F.sum(F.when(none, F.col("n")).when(usual, F.col("fp")).otherwise(0)).alias("fp"), F.sum(F.when(usual, F.col("fn")).otherwise(0)).alias("fn"),
        F.count_if(none & (F.col("n") == 0)).alias("tn"), F.count_if(F.col("expected") == "AMBIGUOUS").alias("ambiguous"),
    ).na.fill(0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return s.select(share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), f1(tp, fp, fn).alias("f1"), "tp", "fp", "fn", "tn", share(tn, tn + fp).alias("abstention_precision"), "ambiguous")


def strict_scores(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Scores over the artifacts that have VALID items only."""
    g = gold.where("status = 'VALID'").select("artifact_id", "item").distinct()
    p = predicted.select("artifact_id", "item").distinct().join(g.select("artifact_id").distinct(), "artifact_id", "left_semi")
    both = p.withColumn("p", F.lit(1)).join(g.withColumn("g", F.lit(1)), ["artifact_id", "item"], "full")
    n = both.agg(F.count_if(F.expr("p = 1 and g = 1")).alias("tp"), F.count_if(F.expr("p = 1 and g is null")).alias("fp"), F.count_if(F.expr("p is null and g = 1")).alias("fn"))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return n.select("tp", "fp", "fn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), f1(tp, fp, fn).alias("f1"))


def enriched(gold: DataFrame, valid: DataFrame) -> DataFrame:
    """``gold(artifact_id, status, item)`` with the VALID items it lacks; artifacts that get one lose their NO_CLAIM rows."""
    new = valid.select("artifact_id", "item").distinct().join(gold.where("status = 'VALID'").select("artifact_id", "item"), ["artifact_id", "item"], "left_anti")
    kept = gold.join(new.select("artifact_id").distinct().withColumn("n", F.lit(1)), "artifact_id", "left").where("status <> 'NO_CLAIM' or n is null").drop("n")
    return kept.select("artifact_id", "status", "item").unionByName(new.select("artifact_id", F.lit("VALID").alias("status"), "item"))


def difficulty(title: Column, content: Column, source: Column, mentions: Column, claims: Column) -> Column:
    """Sorted tags of what makes an artifact hard."""
    text = F.lower(F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(content, F.lit(""))))
    n = F.length(F.coalesce(content, F.lit("")))
    # Words of the kinds of facts.
    words = {
        "ownership": r"\b(owns|owner|ownership|account exec)\b", "assignment": r"\b(assigned|assignee|assigned to)\b", "leadership": r"\b(leads|leadership|director|head of)\b", "maintenance": r"\b(maintains|maintenance|on-call|sre)\b",
        "dependencies": r"\b(depends on|blocked by|blocks)\b", "conflicts": r"\b(conflict|contradict|disagree)\b", "temporal": r"\b(effective|until|as of|starting|by q[1-4])\b",
    }
    lines = n - F.length(F.replace(F.coalesce(content, F.lit("")), F.lit("\n"), F.lit("")))
    tags = [F.when(n > 8000, "long_artifact").when(n < 400, "short_artifact"), F.when((source == "slack") & (lines > 20), "messy_thread"), *[F.when(text.rlike(p), k) for k, p in words.items()], F.when(mentions >= 6, "multi_entity"), F.when((claims == 0) & ~text.rlike(words["dependencies"]), "no_relationship")]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*tags))))


# ---------------------------------------------------------------- answers
def tolerant_match(got: Column, expected: Column) -> Column:
    """Whether an answer says what was expected in its own words: an alternative, the same verdict, an abstention, a conflict or the same day."""
    g, e = plain(got), plain(expected)
    option = F.exists(F.split(F.coalesce(expected, F.lit("")), r"\|"), lambda t: (plain(t) != "") & g.contains(plain(t)))
    verdict = F.lit(False)
    for v in ("same", "different", "uncertain"):
        verdict = verdict | (g.startswith(v) & e.contains(v))
    both = lambda w: g.contains(w) & e.contains(w)
    day = (F.left(g, F.lit(10)) == F.left(e, F.lit(10))) & (F.length(e) >= 10) & e.rlike(r"^\d{4}")
    return (g == e) | option | both("abstain") | both("conflict") | verdict | day


def abstains(text: Column) -> Column:
    out = F.lit(False)
    for marker in ABSTENTION:
        out = out | plain(text).contains(marker)
    return out


def retrieval_failure(answer: Column, gold: Column, retrieved: Column, wanted: Column, error: Column) -> Column:
    """Class of a wrong answer of a retrieval system, the first that applies."""
    hit = F.arrays_overlap(retrieved, wanted)
    extra = F.size(F.array_except(retrieved, wanted))
    said = plain(answer)
    return (
        F.when(F.coalesce(error, F.lit("")) != "", "INFRASTRUCTURE_FAILURE").when(F.size(retrieved) <= 0, "RETRIEVAL_FAILURE").when((F.size(wanted) > 0) & ~F.coalesce(hit, F.lit(False)), "RETRIEVAL_FAILURE")
        .when((F.size(wanted) > 0) & (extra > F.size(wanted)), "CONTEXT_NOISE").when(abstains(gold) & ~said.contains("not found") & ~said.contains("unknown"), "ABSTENTION_FAILURE").otherwise("ANSWER_GENERATION_FAILURE")
    )


def answer_class(intent: Column, status: Column, route: Column, answer: Column, scope: Column) -> Column:
    """What became of a question on the claim graph: OK, a safe abstention, or the step that missed.

    ``scope`` is how many artifacts bear on the entity.
    """
    said = plain(answer)
    some = scope > 0
    pair = F.when(said.isin("same", "different"), "OK").otherwise("ENTITY_RESOLUTION_MISS")
    proof = F.when(status == "found", F.when(said != "", "OK").otherwise("ANSWER_GENERATION_MISS")).when(some, "PROVENANCE_MISS").otherwise("RETRIEVAL_MISS")
    absent = F.when(~some, "RETRIEVAL_MISS").when(route.isin("before", "after", "as_of", "previous"), "TEMPORAL_MISS").otherwise("INSUFFICIENT_EVIDENCE")
    found = F.when(said == "", "ANSWER_GENERATION_MISS").when(abstains(answer), "SAFE_ABSTENTION").otherwise("OK")
    return (
        F.when(intent == "ENTITY_RESOLUTION", pair).when(intent == "PROVENANCE", proof).when(status == "conflict", "CONFLICT_MISS").when(status == "absent", absent).when(status == "found", found).otherwise("INSUFFICIENT_EVIDENCE")
    )


def failure_summary(rows: DataFrame, by: str, kind: str, id_: str, examples: int = 5) -> DataFrame:
    """``by, kind, failures, examples``: how often each class occurs per group, with the first few ids.

    Only as many ids as are shown leave a partition.
    """
    from factweave.operators.inventory import top_per

    n = rows.groupBy(by, kind).agg(F.count(F.lit(1)).alias("failures"))
    shown = top_per(rows.select(by, kind, id_), [by, kind], [F.col(id_)], examples).groupBy(by, kind).agg(F.array_join(F.array_sort(F.collect_list(id_)), ",").alias("examples"))
    return n.join(shown, [by, kind])


def outcome_matrix(rows: DataFrame) -> DataFrame:
    """``retrieved, correct, wrong``: whether the evidence was found against whether the answer was right."""
    return rows.groupBy(F.coalesce("hit", F.lit(False)).alias("retrieved")).agg(F.count_if(F.coalesce("right", F.lit(False))).alias("correct"), F.count_if(~F.coalesce("right", F.lit(False))).alias("wrong"))


def integrity(rows: DataFrame, questions: DataFrame, id_: str) -> DataFrame:
    """One row: results, different questions, repeated results, results of unknown questions, questions without one."""
    q = questions.select(F.col(id_).alias("__q")).distinct()
    n = rows.agg(F.count(F.lit(1)).alias("results"), F.count_distinct(id_).alias("ids"))
    lost = rows.join(q, F.col(id_) == F.col("__q"), "left_anti").agg(F.count(F.lit(1)).alias("unknown"))
    open_ = q.join(rows.select(id_).distinct(), F.col("__q") == F.col(id_), "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    one = n.crossJoin(F.broadcast(lost)).crossJoin(F.broadcast(open_))  # one row each
    return one.select("results", "ids", (F.col("results") - F.col("ids")).alias("repeated"), "unknown", "missing")


def coverage_rates(rows: DataFrame, flags: list[str]) -> DataFrame:
    """One row with the share of rows for which each flag holds; null counts as no."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.round(F.avg(F.coalesce(F.col(f), F.lit(False)).cast("int")), 4), F.lit(0.0)).alias(f) for f in flags])


def retrieval_scores(rows: DataFrame) -> DataFrame:
    """One row: answers right, mean recall, mean evidence beyond what was wanted, of ``rows(answer, gold_answer, retrieved, wanted)``.

    Questions that want nothing have no recall.
    """
    recall = F.when(F.size("wanted") > 0, F.size(F.array_intersect("retrieved", "wanted")) / F.size(F.array_distinct("wanted")))
    extra = F.size(F.array_except("retrieved", "wanted"))
    return rows.agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg(answers_match(F.col("answer"), F.col("gold_answer")).cast("int")), 4).alias("correct"), F.round(F.avg(recall), 4).alias("recall"), F.round(F.avg(extra), 4).alias("extra"))
