"""State at named events: before a person, before or after an anchor, and the sources of a state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.operators import state
from factweave.operators.state import KEY
from factweave.plans import contained, sharded
from factweave.plans.lineage import stored
from factweave.plans.small import bounded

# Sources that a question can name, and the words of a hand-over.
SOURCES = ["slack", "gmail", "github", "linear", "jira", "confluence", "fireflies"]
#: Rows of a history that one task orders.
SHARD = 100_000
HANDOFF = ["handoff", "hand off", "taking over", "take over"]


def _said(text: Column, needle: Column) -> Column:
    return F.coalesce(F.lower(text).contains(F.lower(F.trim(needle))), F.lit(False))


def started(claims: DataFrame, asked: DataFrame) -> DataFrame:
    """``probe_id, day``: when the first claim began whose subject's name holds ``reference``.

    ``asked(probe_id, object_id, predicate, reference)``; claims have ``subject_name``. Keys are
    first reduced to their different subjects, so a key with very many claims is small.
    """
    subjects = claims.groupBy(*KEY, "subject_name").agg(F.min("valid_from").alias("day"))
    met = asked.where(F.trim(F.coalesce("reference", F.lit(""))) != "").join(subjects, KEY).where(_said(F.col("subject_name"), F.col("reference")))
    return met.groupBy("probe_id").agg(F.min("day").alias("day")).where("day is not null")


def anchored(claims: DataFrame, asked: DataFrame) -> DataFrame:
    """``probe_id, day``: the last start of a claim whose subject's name holds the anchor or a word of a hand-over.

    ``asked(probe_id, object_id, predicate, reference)``. (Elsewhere every claim counts for any
    anchor but a hand-over, which gives the last claim whatever was asked; here it has to match.)
    """
    subjects = claims.groupBy(*KEY, "subject_name").agg(F.max(F.coalesce("valid_from", "observed_at")).alias("day"))
    handed = F.lit(False)
    for word in HANDOFF:
        handed = handed | F.lower("subject_name").contains(word)
    met = asked.where(F.trim(F.coalesce("reference", F.lit(""))) != "").join(subjects, KEY).where(_said(F.col("subject_name"), F.col("reference")) | F.coalesce(handed, F.lit(False)))
    return met.groupBy("probe_id").agg(F.max("day").alias("day")).where("day is not null")


def dated_mentions(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """``probe_id, day``: the last day of a text that holds the anchor.

    ``texts(day, text)``, ``asked(probe_id, reference)``. Texts are read once, whatever the number
    of anchors; see ``contained.latest``.
    """
    anchors = asked.select(F.lower(F.trim("reference")).alias("needle")).where("needle <> ''").distinct()
    last = contained.latest(texts.select(F.unix_date("day").alias("value"), F.lower("text").alias("text")), anchors)
    last = last.select(F.col("needle").alias("anchor"), F.date_from_unix_date("last").alias("day"))
    return asked.select("probe_id", F.lower(F.trim("reference")).alias("anchor")).join(last, "anchor").select("probe_id", "day")


def source_presence(chain: DataFrame, asked: DataFrame) -> DataFrame:
    """``probe_id, sources``: sources with evidence for a key, of those the question names (all, if it names none).

    ``chain`` as ``graph.provenance``, ``asked(probe_id, object_id, predicate, question)``.
    """
    per = chain.where("source_name is not null").groupBy(*KEY).agg(F.array_sort(F.collect_set(F.lower("source_name"))).alias("s"))
    named = F.filter(F.array(*[F.lit(s) for s in SOURCES]), lambda s: F.lower(F.col("question")).contains(s))
    met = asked.join(per, KEY).withColumn("named", named)
    kept = F.when(F.size("named") == 0, F.col("s")).otherwise(F.array_intersect("s", "named"))
    return met.select("probe_id", kept.alias("sources"))


def latest_evidence(chain: DataFrame) -> DataFrame:
    """Per key the subject, artifact and source of the claim observed last, and all its sources."""
    top = F.max_by(F.struct("subject_id", "artifact_id", F.lower("source_name").alias("source")), F.struct("observed_at", "claim_id"))
    return chain.groupBy(*KEY).agg(top.alias("top"), F.array_sort(F.collect_set(F.lower("source_name"))).alias("sources")).select(*KEY, "top.*", "sources")


def owners(history: DataFrame) -> DataFrame:
    """``object_id, predicate, turn, subject_id``: the subjects of a history without repeats in a row, newest first.

    ``history`` as ``state.history``. Turn 1 is who holds it last, 2 who did before.
    """
    # The number itself is cut into shards, newest last and then newest first.
    parts = history.withColumn("__part", F.floor(F.col("seq") / SHARD))
    marked = sharded.neighbour(parts, KEY, "__part", ["seq"], ["seq", "subject_id"], True, "next_")
    kept = marked.where(F.col("next_seq").isNull() | ~F.col("subject_id").eqNullSafe(F.col("next_subject_id"))).withColumn("__back", -F.floor(F.col("seq") / SHARD))
    return sharded.row_number(kept, KEY, "__back", [F.desc("seq")], "turn").select(*KEY, "turn", "subject_id")


def at_constraint(claims: DataFrame, asked: DataFrame, texts: DataFrame | None) -> DataFrame:
    """``probe_id, kind, day, subject_id`` of ``asked(probe_id, object_id, predicate, kind, value)``.

    ``kind``: ``as_of`` and ``interval`` ask for the state on a day, ``before`` for the one that
    held until it, ``after`` for the one on it. A ``value`` that is no day is an anchor: a
    subject of the key, a hand-over (for ``after``), or an event of ``texts(day, text)``.
    Anchors that nothing dates give no row.
    """
    parts = asked.withColumn("own", F.col("value").try_cast("date"))
    event = parts.where("own is null and kind in ('before', 'after')").select("probe_id", *KEY, "kind", F.col("value").alias("reference"))
    handed = event.where("kind = 'after'").where(F.lower(F.trim("reference")).isin("handoff", "the handoff"))
    after = handed.join(state.after_event(claims).select(*KEY, "subject_id", F.col("valid_from").alias("day")), KEY).select("probe_id", "kind", "day", "subject_id")
    rest = event.join(after.select("probe_id"), "probe_id", "left_anti")  # a hand-over without a turn is an anchor like others
    by_name = started(claims, rest.where("kind = 'before'")).select("probe_id", "day", F.lit(1).alias("way"))
    by_claim = anchored(claims, rest.where("kind = 'after'")).select("probe_id", "day", F.lit(1).alias("way"))
    days = by_name.unionByName(by_claim)
    if texts is not None:
        days = days.unionByName(dated_mentions(texts, rest).select("probe_id", "day", F.lit(2).alias("way")))
    days = days.groupBy("probe_id").agg(F.min_by("day", "way").alias("found"))
    dated = parts.join(days, "probe_id", "left").withColumn("day", F.coalesce("own", "found")).where("day is not null").select("probe_id", *KEY, "kind", "day")
    dated = stored(dated, "dated-probes")  # read by both lookups and by what they find
    on = state.as_of_many(claims, dated.where("kind <> 'before'")).select("probe_id", "day", "subject_id")
    until = state.before_many(claims, dated.where("kind = 'before'")).select("probe_id", "day", "subject_id")
    found = dated.select("probe_id", "kind").join(on.unionByName(until), "probe_id")
    return found.select("probe_id", "kind", "day", "subject_id").unionByName(after)
