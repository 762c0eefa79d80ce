"""Answering many questions at once: decomposition, binding, routing, state, evidence, abstention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.text import mention_key
from factweave.operators import graph, identity, questions, state, temporal
from factweave.operators.state import KEY
from factweave.plans.lineage import stored
from factweave.plans.small import bounded

# How sure an answer of each route is.
CONFIDENCE = {
    "current": 0.96, "as_of": 0.96, "interval": 0.96, "after": 0.96, "before": 0.94, "previous": 0.90, "conflict": 0.90,
    "provenance": 0.96, "source_presence": 0.96, "cooccurrence": 0.96, "entity_pair": 0.96,
}


class ClaimGraph:
    """The verbs of the claim graph over DataFrames; each works for all keys, a single key is a filter.

    ``claims`` as in ``operators.state``; ``names(mention, entity)`` says what a mention means.
    """

    def __init__(self, claims: DataFrame, names: DataFrame, chain: DataFrame | None = None):
        self.claims, self.names, self.chain = claims, names, chain

    def resolve(self, mentions: DataFrame) -> DataFrame:
        """Adds ``entity`` to ``mentions(mention)``; null where a mention means nothing or several things."""
        known = self.names.groupBy(mention_key(F.col("mention")).alias("__m")).agg(F.count_distinct("entity").alias("__k"), F.min("entity").alias("entity")).where("__k = 1")
        return mentions.join(known, mention_key(F.col("mention")) == F.col("__m"), "left").drop("__m", "__k")

    def aliases(self) -> DataFrame:
        return self.names.groupBy("entity").agg(F.array_sort(F.collect_set("mention")).alias("aliases"))

    def current(self) -> DataFrame:
        return state.current(self.claims)

    def as_of(self, day: str) -> DataFrame:
        return state.as_of(self.claims, day)

    def history(self) -> DataFrame:
        return state.history(self.claims)

    def conflicts(self) -> DataFrame:
        return state.conflict_state(self.claims)

    def evidence(self) -> DataFrame:
        return graph.evidence(self.chain)

    def dependencies(self, outgoing: bool = True) -> DataFrame:
        return graph.degree(graph.edges(self.claims), outgoing)

    def ranked_evidence(self, weights: dict[str, int], top: int) -> DataFrame:
        return graph.rank_evidence(self.chain, self.current(), weights, top)

    def sources(self) -> DataFrame:
        return temporal.latest_evidence(self.chain).select(*KEY, "sources")

    def owners(self) -> DataFrame:
        """Who held a key, newest first, without repeats in a row."""
        return temporal.owners(state.history(self.claims))

    # Thin wrappers for ownership.
    def current_owner(self) -> DataFrame:
        return self.current().where("predicate = 'OWNS'")

    def owner_on(self, day: str) -> DataFrame:
        return self.as_of(day).where("predicate = 'OWNS'")

    def find_conflicts(self) -> DataFrame:
        return state.conflicts(self.claims.where("predicate = 'OWNS'"))

    def ownership_provenance(self) -> DataFrame:
        return temporal.latest_evidence(self.chain.where("predicate = 'OWNS'"))

    def answer(self, asked: DataFrame, texts: DataFrame | None = None) -> DataFrame:
        """``question_id, route, entity, predicate, day, status, subject_id, confidence, answer`` per ``asked(question_id, question)``.

        The first mention that can be resolved is the entity, the first hint the predicate
        (``OWNS`` without one). The route says which operator answers; each route is one
        relation that the questions on it join, so nothing runs per question. ``texts(day,
        text)`` dates the events that a question names. ``status`` is ``found``, ``conflict``
        or ``absent``; an absent answer says ``unknown``. A question without an entity or
        without evidence is absent on any route, never answered from another one.
        """
        parts = questions.decomposed(asked.select("question_id", "question"), "question")
        parts = parts.withColumn("route", questions.route(F.col("times"), F.col("intent")))
        parts = parts.withColumn("predicate", F.coalesce(F.try_element_at("predicates", F.lit(1)), F.lit("OWNS")))
        constraint = F.try_element_at(F.filter("times", lambda t: t.startswith(F.concat(F.col("route"), F.lit("=")))), F.lit(1))
        parts = parts.withColumn("value", F.split_part(constraint, F.lit("="), F.lit(2)))
        bound = stored(self.resolve(parts.select("question_id", F.posexplode("mentions").alias("no", "mention"))), "mentions")
        first = bound.where("entity is not null").groupBy("question_id").agg(F.min_by("entity", "no").alias("object_id"))
        q = stored(parts.select("question_id", "question", "route", "predicate", "value").join(first, "question_id", "left"), "questions")

        key, found = ["object_id", "predicate"], []
        # Only what is asked about is computed: claims and evidence of other keys are dropped first.
        wanted = bounded(q.where("object_id is not null").select(*key).distinct())
        claims = stored(self.claims.join(wanted, key, "left_semi"), "asked-claims")
        g = ClaimGraph(claims, self.names, None if self.chain is None else stored(self.chain.join(wanted, key, "left_semi"), "asked-evidence"))
        one = F.array("subject_id")

        def answered(route: str, rows: DataFrame, names: Column = one, subject: Column | None = None, status: Column | None = None, day: Column | None = None) -> None:
            """``rows`` have the question's id; no row, or no name, leaves it absent."""
            found.append(rows.select(
                "question_id", F.lit(route).alias("r"), (F.col("subject_id") if subject is None else subject).alias("subject_id"), names.alias("names"),
                (F.lit("found") if status is None else status).alias("status"), (F.lit(None).cast("date") if day is None else day).alias("day"),
            ))

        def on(route: str) -> DataFrame:
            return q.where(F.col("route") == route)

        none = F.lit(None).cast("string")
        answered("current", on("current").join(g.current().select(*key, "subject_id"), key))
        answered("previous", on("previous").join(state.previous(claims).select(*key, "subject_id"), key))
        decided = g.conflicts().select(*key, "subject_id", "state")
        answered("conflict", on("conflict").join(decided, key), status=F.when(F.col("subject_id").isNotNull(), "found").when(F.col("state") == "conflict", "conflict"))
        timed = q.where(F.col("route").isin("as_of", "before", "after", "interval")).select(F.col("question_id").alias("probe_id"), *key, F.col("route").alias("kind"), "value")
        at = temporal.at_constraint(claims, timed, texts).withColumnRenamed("probe_id", "question_id")
        at = stored(at, "asked-days")
        answered("timed", at, status=F.when(F.col("subject_id").isNotNull(), "found"), day=F.col("day"))
        met = graph.cooccurring_with(self.claims, on("cooccurrence").select(F.col("object_id").alias("subject_id")))
        others = met.groupBy(F.col("subject_id").alias("object_id")).agg(F.array_sort(F.collect_set("other_id")).alias("others"))
        answered("cooccurrence", on("cooccurrence").join(others, "object_id"), F.col("others"), none)
        if self.chain is not None:
            last = temporal.latest_evidence(g.chain)
            answered("provenance", on("provenance").join(last, key), F.col("sources"))
            named = temporal.source_presence(g.chain, on("source_presence").select(F.col("question_id").alias("probe_id"), *key, "question")).withColumnRenamed("probe_id", "question_id")
            answered("source_presence", named.where("size(sources) > 0"), F.col("sources"), none)
        answered("entity_pair", self._pairs(q, bound), F.array("verdict"), none)

        every = found[0]
        for rows in found[1:]:
            every = every.unionByName(rows)
        out = q.join(every, "question_id", "left")
        status = F.coalesce("status", F.lit("absent"))
        sure = F.try_element_at(F.create_map(*[x for k, c in CONFIDENCE.items() for x in (F.lit(k), F.lit(c))]), F.col("route"))
        text = F.when(status == "found", F.array_join("names", ", ")).when(status == "conflict", "conflict").otherwise("unknown")
        return out.select(
            "question_id", "route", F.col("object_id").alias("entity"), "predicate", "day", status.alias("status"), "subject_id", F.when(status == "found", sure).alias("confidence"), text.alias("answer"),
        )

    @staticmethod
    def _pairs(q: DataFrame, bound: DataFrame) -> DataFrame:
        """Whether the two mentions of a question mean the same: by their entities, else by their names alone."""
        two = bound.groupBy("question_id").agg(
            F.min_by("mention", "no").alias("ma"), F.max_by("mention", "no").alias("mb"), F.count(F.lit(1)).alias("k"), F.count("entity").alias("known"),
            F.min_by("entity", "no").alias("ea"), F.max_by("entity", "no").alias("eb"),
        ).where("k = 2")
        asked = q.where("route = 'entity_pair'").select("question_id").join(two, "question_id")
        empty = F.array().cast("array<string>")

        def side(m: str) -> Column:
            return F.struct(F.col(m).alias("mention"), F.lit("person").alias("type"), empty.alias("emails"), empty.alias("external_ids"))

        judged = identity.decided(asked.select("*", side("ma").alias("a"), side("mb").alias("b")))
        by_name = F.when(F.col("decision") == "MERGE", "same").when(F.col("decision") == "KEEP_SEPARATE", "different").otherwise("uncertain")
        verdict = F.when(F.col("known") == 2, F.when(F.col("ea") == F.col("eb"), "same").otherwise("different")).otherwise(by_name)
        return judged.select("question_id", verdict.alias("verdict"))
