"""Problem 1: history of changing attributes, kept as an event-sourced change log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.functions import timestamps
from factweave.functions.text import is_blank, mention_key
from factweave.operators.instants import normalize
from factweave.plans import sharded
from factweave.sources.tables import table

OPEN_END = "9999-12-31"
DAY = 86_400_000_000


def change_log(observations: DataFrame) -> DataFrame:
    """Versions of every attribute: ``entity, attribute, value, version_from, version_to``.

    ``observations``: ``entity, attribute, value, at`` (``at`` in micros). Neighbours in time
    order with the same value are one version, a value that returns is a new one, and
    ``version_to`` is the start of the next version (null for the last). Rows with a null
    ``value`` or ``at`` are left out; repeated rows count once; of two values seen at the same
    micro the smaller comes first and gets an empty period. An entity of any size is worked on
    in day shards, so no task holds all of its rows.
    """
    seen = observations.where("value is not null and at is not null").select("entity", "attribute", "value", "at").distinct()
    shards = seen.withColumn("__day", F.floor(F.col("at") / F.lit(DAY)))
    found = sharded.runs(shards, ["entity", "attribute"], "__day", "at", "value")
    return found.withColumnsRenamed({"run_from": "version_from", "run_to": "version_to"})


def combined(log: DataFrame, attributes: list[str]) -> DataFrame:
    """One row per entity and period in which no attribute changes.

    Time is split at the union of the boundaries of all ``attributes`` (one column each, null
    before its first version) and neighbouring periods that agree in every attribute are
    coalesced. Carrying the last known value forward is done in day shards, then across them.
    """
    name = {a: f"a{i}" for i, a in enumerate(attributes)}
    cols = list(name.values())
    events = log.where(F.col("attribute").isin(attributes)).select(
        "entity", F.col("version_from").alias("at"),
        *[F.when(F.col("attribute") == a, F.struct("value")).alias(c) for a, c in name.items()],
    )
    # Of two values that one attribute took at the same micro only the last holds any time.
    at_once = events.groupBy("entity", "at").agg(*[F.max(c).alias(c) for c in cols])
    days = at_once.withColumn("__day", F.floor(F.col("at") / F.lit(DAY)))
    per_day = days.groupBy("entity", "__day").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c) for c in cols])
    earlier = Window.partitionBy("entity").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_day.select("entity", "__day", *[F.last(c, ignorenulls=True).over(earlier).alias(f"__{c}") for c in cols])
    inside = Window.partitionBy("entity", "__day").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    filled = days.select("entity", "__day", "at", *[F.last(c, ignorenulls=True).over(inside).alias(c) for c in cols])
    whole = sharded.carry_join(filled, carry, ["entity", "__day"], [f"__{c}" for c in cols])
    state = F.to_json(F.struct(*[F.coalesce(c, f"__{c}").alias(c) for c in cols]))
    found = sharded.runs(whole.select("entity", "__day", "at", state.alias("state")), ["entity"], "__day", "at", "state")
    shape = ", ".join(f"{c} struct<value string>" for c in cols)
    read = found.withColumn("s", F.from_json("state", shape))
    return read.select("entity", F.col("run_from").alias("period_from"), F.col("run_to").alias("period_to"), *[F.col(f"s.{c}.value").alias(a) for a, c in name.items()])


def observations(claims: DataFrame) -> DataFrame:
    """Claims that only observe (no stated period) as ``entity, attribute, value, at``."""
    only = claims.where(is_blank(F.col("valid_from")) & is_blank(F.col("valid_to")))
    read = normalize(only.select("subject_mention", "predicate", "object_mention", "observed_at"), "observed_at", "at")
    return read.select(
        mention_key(F.col("subject_mention")).alias("entity"),
        F.upper(F.trim("predicate")).alias("attribute"),
        mention_key(F.col("object_mention")).alias("value"),
        "at",
    )


def _text(micros: str):
    return F.coalesce(timestamps.iso_utc(F.col(micros)), F.lit(OPEN_END))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The successive objects of every subject and predicate, from the change log."""
    log = change_log(observations(table(spark, folder, "claims_checkpoint50")))
    return log.select(
        F.col("entity").alias("subject_key"), F.col("attribute").alias("predicate"), F.col("value").alias("object_key"),
        _text("version_from").alias("version_from"), _text("version_to").alias("version_to"),
    ).distinct()


# The predicates of a claim.
PREDICATES = ["OWNS", "ASSIGNED_TO", "BLOCKS", "DEPENDS_ON", "LEADS", "MAINTAINS", "REVIEWS"]


def p1_combined(spark: SparkSession, folder: str) -> DataFrame:
    """Periods of each subject in which none of its attributes changed, one column each."""
    log = change_log(observations(table(spark, folder, "claims_checkpoint50")))
    both = combined(log, PREDICATES)
    return both.select(
        F.col("entity").alias("subject_key"), _text("period_from").alias("period_from"), _text("period_to").alias("period_to"),
        *[F.col(p).alias(p.lower()) for p in PREDICATES],
    )
