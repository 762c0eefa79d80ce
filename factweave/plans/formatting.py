"""Answers as people read them: text lines, confidence labels, message blocks, checklists and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Least confidence of each label, and what an absent answer says.
LABELS = [(0.9, "High"), (0.7, "Medium")]
LOW, NOTHING = "Low", "unknown"


def confidence_label(confidence: Column) -> Column:
    """``High``, ``Medium`` or ``Low``; nothing known is low."""
    out = None
    for least, name in LABELS:
        out = F.when(confidence >= least, name) if out is None else out.when(confidence >= least, name)
    return out.otherwise(LOW)


def previous_line(owners: Column) -> Column:
    """``Previously: b, a`` of the owners newest first without the present one; empty without any."""
    before = F.slice(owners, F.lit(2), F.greatest(F.size(owners) - 1, F.lit(1)))
    return F.when(F.size(owners) > 1, F.concat(F.lit("Previously: "), F.array_join(before, ", "))).otherwise("")


def answer_line(status: Column, answer: Column, confidence: Column) -> Column:
    return F.when(status == "found", F.concat(answer, F.lit(" ("), confidence_label(confidence), F.lit(" confidence)"))).when(status == "conflict", "Sources disagree.").otherwise("Nothing is known about this.")


def blocks(answers: DataFrame) -> DataFrame:
    """``question_id, blocks``: an answer as the JSON of a chat message: the line, what it rests on, who held it before.

    ``answers(question_id, status, answer, confidence, sources, owners)``; missing lists add no block.
    """
    def section(text: Column) -> Column:
        return F.when(text != "", F.struct(F.lit("section").alias("type"), F.struct(F.lit("mrkdwn").alias("type"), text.alias("text")).alias("text")))

    empty = F.array().cast("array<string>")
    rest = F.array_join(F.coalesce("sources", empty), ", ")
    parts = [section(answer_line(F.col("status"), F.col("answer"), F.col("confidence"))), section(F.when(rest != "", F.concat(F.lit("Sources: "), rest)).otherwise("")), section(previous_line(F.coalesce("owners", empty)))]
    return answers.select("question_id", F.to_json(F.array_compact(F.array(*parts))).alias("blocks"))


def checklist(answers: DataFrame) -> DataFrame:
    """``question_id, checklist``: which steps of an answer were made, a line each."""
    def line(name: str, done: Column) -> Column:
        return F.concat(F.when(done, "[x] ").otherwise("[ ] "), F.lit(name))

    steps = [line("route", F.col("route").isNotNull()), line("entity", F.col("entity").isNotNull()), line("state", F.col("status") == "found"), line("answer", F.col("answer") != NOTHING)]
    return answers.select("question_id", F.concat_ws("\n", *steps).alias("checklist"))


def trace(answers: DataFrame) -> DataFrame:
    """``question_id, trace``: ids and decisions of an answer on one line, no contents."""
    part = lambda n: F.concat(F.lit(f"{n}="), F.coalesce(F.col(n).cast("string"), F.lit("-")))
    return answers.select("question_id", F.concat_ws(" ", *[part(n) for n in ("route", "entity", "predicate", "day", "status", "subject_id")]).alias("trace"))


#: Keys of an envelope; all are always there.
ENVELOPE = "entity_id predicate status value valid_from valid_to confidence as_of history claims evidence conflicting_subjects resolution".split()


def envelope(answers: DataFrame) -> DataFrame:
    """``question_id, envelope``: what is known as JSON with a fixed set of keys; lists that are missing are empty.

    ``answers`` as ``ClaimGraph.answer``, with any of ``valid_from, valid_to, history, claims,
    evidence, conflicting_subjects``. An absent state has no value.
    """
    empty = F.array().cast("array<string>")
    lists = ("history", "claims", "evidence", "conflicting_subjects")
    own = {"entity_id": "entity", "predicate": "predicate", "status": "status", "confidence": "confidence", "as_of": "day", "resolution": "route"}

    def part(key: str) -> Column:
        name = own.get(key, key)
        if key == "value":
            return F.when(F.col("status") == "found", F.struct(F.col("subject_id").alias("entity_id"), F.col("answer").alias("name")))
        if name in answers.columns:
            return F.coalesce(F.col(name), empty) if key in lists else F.col(name)
        return empty if key in lists else F.lit(None).cast("string")

    return answers.select("question_id", F.to_json(F.struct(*[part(k).alias(k) for k in ENVELOPE]), {"ignoreNullFields": "false"}).alias("envelope"))


def benchmark_answer(category: Column, status: Column, answer: Column, claims: Column, sources: Column) -> Column:
    """An answer in the words of its category: provenance counts claims and names sources, a conflict says so, an absence abstains."""
    names = F.array_join(F.coalesce(sources, F.array().cast("array<string>")), ", ")
    proof = F.concat(claims.cast("string"), F.lit(" claim(s) from "), F.when(names == "", "no source").otherwise(names))
    return F.when(status == "absent", "abstain").when(status == "conflict", "conflict").when(category == "provenance", proof).otherwise(answer)
