"""State of an attribute in the claim log: now, at a day, before, after, in conflict.

Claims carry ``subject_id, predicate, object_id, observed_at, valid_from, valid_to`` (dates,
validity half-open) and ``claim_id``, which breaks every tie. A key is (object, predicate).
Top-1 questions are aggregates with partial results, ordered ones run in yearly shards, so a
key with very many claims is no hot task. Null keys are keys of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.operators.claims import OPEN_END, OPEN_START
from factweave.plans import blocks, sharded

KEY = ["object_id", "predicate"]


def _open():
    return F.col("valid_to") == F.lit(OPEN_END).cast("date")


def _best(claims: DataFrame, order: list[str], keep: list[str]) -> DataFrame:
    """The row of each key with the largest ``order``."""
    top = F.max_by(F.struct(*keep), F.struct(*order))
    return claims.groupBy(*KEY).agg(top.alias("top")).select(*KEY, "top.*")


STATE = ["subject_id", "valid_from", "valid_to", "observed_at", "claim_id"]


def current(claims: DataFrame) -> DataFrame:
    """Among the open claims of a key the one that began last."""
    return _best(claims.where(_open()), ["valid_from", "claim_id"], STATE)


def holds(claims: DataFrame, day: str) -> DataFrame:
    """Claims whose period contains ``day``; the last day of a period is not in it."""
    d = F.lit(day).cast("date")
    return claims.where((F.col("valid_from") <= d) & (F.col("valid_to") > d))


def as_of(claims: DataFrame, day: str) -> DataFrame:
    """Of the claims that hold on ``day`` the one that began last."""
    return _best(holds(claims, day), ["valid_from", "claim_id"], STATE)


def as_of_many(claims: DataFrame, probes: DataFrame) -> DataFrame:
    """``as_of`` for every row of ``probes(probe_id, object_id, predicate, day)`` at once.

    Probes without a claim have nulls. Each different day of a key is asked once, and probes
    take its answer by an equality join. Claims are cut into calendar years; inside a year only
    one claim of the same first and last day is left, a combine before the shuffle. What meets
    is thus bounded by the days of a year, however many claims or probes a key has.
    """
    keep = ["subject_id", "valid_from", "claim_id"]
    return _answered(probes, _best_of_days(claims, _days(probes), keep, ["valid_from", "claim_id"]), keep)


def before_many(claims: DataFrame, probes: DataFrame) -> DataFrame:
    """``before`` for every row of ``probes(probe_id, object_id, predicate, day)`` at once; see ``as_of_many``."""
    keep = ["subject_id", "valid_from", "claim_id"]
    days = _days(probes)
    eve = _best_of_days(claims, days.withColumn("day", F.date_sub("day", 1)), keep, ["valid_from", "claim_id"])
    eve = eve.select(*KEY, F.date_add("day", 1).alias("day"), F.struct(*keep).alias("held"))
    # The last that had ended: of earlier years the best of all, of the same year day by day.
    ends = claims.where(~_open()).groupBy(*KEY, "valid_to").agg(F.max_by(F.struct(*keep), "claim_id").alias("row"))
    ends = ends.withColumn("year", F.year("valid_to"))
    yearly = ends.groupBy(*KEY, "year").agg(F.max_by("row", "valid_to").alias("row"), F.max("valid_to").alias("valid_to"))
    asked = days.withColumn("year", F.year("day"))
    earlier = asked.join(yearly.select(*KEY, F.col("year").alias("y"), "row", "valid_to"), KEY).where("y < year").select(*KEY, "day", "valid_to", "row")
    same = asked.join(ends, [*KEY, "year"]).where("valid_to < day").select(*KEY, "day", "valid_to", "row")
    last = earlier.unionByName(same).groupBy(*KEY, "day").agg(F.max_by("row", "valid_to").alias("ended"))
    found = days.join(eve, [*KEY, "day"], "left").join(last, [*KEY, "day"], "left")
    return _answered(probes, found.select(*KEY, "day", F.coalesce("held", "ended").alias("x")).where("x is not null").select(*KEY, "day", "x.*"), keep)


def _days(probes: DataFrame) -> DataFrame:
    return probes.select(*KEY, "day").where("day is not null").distinct()


def _answered(probes: DataFrame, found: DataFrame, keep: list[str]) -> DataFrame:
    return probes.select("probe_id", *KEY, "day").join(found.hint("merge"), [*KEY, "day"], "left").select("probe_id", *KEY, "day", *keep)


def _best_of_days(claims: DataFrame, days: DataFrame, keep: list[str], order: list[str]) -> DataFrame:
    """Of the claims that hold on a day of a key the one with the largest ``order``."""
    span = days.agg(F.min(F.year("day")).alias("lo"), F.max(F.year("day")).alias("hi")).first()
    lo, hi = (span["lo"], span["hi"]) if span["lo"] is not None else (0, -1)
    first, last = F.greatest(F.year("valid_from"), F.lit(lo)), F.least(F.year(F.date_sub("valid_to", 1)), F.lit(hi))
    # Every year may be missing, then the sequence would run backwards.
    held = claims.where("valid_from < valid_to").where(first <= last).withColumn("year", F.explode(F.sequence(first, last)))
    opens, closes = F.make_date("year", F.lit(1), F.lit(1)), F.make_date(F.col("year") + 1, F.lit(1), F.lit(1))
    cut = held.groupBy(*KEY, "year", F.greatest("valid_from", opens).alias("__from"), F.least("valid_to", closes).alias("__to")).agg(
        F.max_by(F.struct(*keep), F.struct(*order)).alias("row"), F.max(F.struct(*order)).alias("rank")
    )
    asked = days.withColumn("year", F.year("day"))
    met = asked.join(cut.hint("merge"), [*KEY, "year"]).where("__from <= day and __to > day")
    return met.groupBy(*KEY, "day").agg(F.max_by("row", "rank").alias("x")).select(*KEY, "day", "x.*")


def before(claims: DataFrame, day: str) -> DataFrame:
    """The claim that held on the day before, else the last one that had ended by then."""
    d = F.lit(day).cast("date")
    eve = F.date_sub(d, 1)
    held = (F.col("valid_from") <= eve) & (F.col("valid_to") > eve)
    ended = F.col("valid_to") < d
    rank = F.struct(held.cast("int").alias("h"), F.when(held, F.col("valid_from")).otherwise(F.col("valid_to")).alias("t"), "claim_id")
    top = F.max_by(F.struct(*STATE), rank)
    return claims.where(held | ended).groupBy(*KEY).agg(top.alias("top")).select(*KEY, "top.*")


def _in_order(claims: DataFrame) -> DataFrame:
    """Adds what a history is ordered by: an unknown start comes last, an unknown observation first."""
    start = F.coalesce("valid_from", F.lit(OPEN_END).cast("date"))
    seen = F.coalesce("observed_at", F.lit(OPEN_START).cast("date"))
    return claims.withColumns({"__start": start, "__seen": seen, "__year": F.year(start)})


def history(claims: DataFrame) -> DataFrame:
    """All claims of a key numbered from 1 by (start, observation, id); see ``_in_order`` for nulls."""
    order = [F.col("__start"), F.col("__seen"), F.col("claim_id")]
    return sharded.row_number(_in_order(claims), KEY, "__year", order, "seq").select(*KEY, "seq", *STATE)


def _sequence(claims: DataFrame, bring: list[str], ahead: bool, prefix: str) -> DataFrame:
    return sharded.neighbour(_in_order(claims), KEY, "__year", ["__start", "__seen", "claim_id"], bring, ahead, prefix)


def previous(claims: DataFrame) -> DataFrame:
    """The last but one claim of the history of a key, whoever is its subject."""
    rows, at = _in_order(claims), F.struct("__start", "__seen", "claim_id")
    last = rows.groupBy(*KEY).agg(F.max(at).alias("__last"))
    return _best(rows.join(last, KEY).where(at < F.col("__last")), ["__start", "__seen", "claim_id"], STATE)


def after_event(claims: DataFrame) -> DataFrame:
    """Who follows the first claim of a key that ended; without one, the first new subject."""
    led = _sequence(claims, ["subject_id", "valid_from", "claim_id"], True, "next_")
    ends = (F.col("valid_to") != F.lit(OPEN_END).cast("date")) & F.col("next_claim_id").isNotNull()
    turns = F.col("next_subject_id") != F.col("subject_id")
    order = F.struct("__start", "__seen", "claim_id")
    row = F.struct(F.col("next_subject_id").alias("subject_id"), F.col("next_valid_from").alias("valid_from"), F.col("next_claim_id").alias("claim_id"))
    per = led.groupBy(*KEY).agg(
        F.min_by(F.when(ends, row), F.when(ends, order)).alias("a"), F.min_by(F.when(turns, row), F.when(turns, order)).alias("b")
    )
    return per.where("a is not null or b is not null").select(*KEY, F.coalesce("a", "b").alias("x"), F.col("a").isNotNull().alias("by_end")).select(*KEY, "x.*", "by_end")


def disjoint(claims: DataFrame) -> DataFrame:
    """``disjoint``: whether each claim of a key ends before the next, by observation, begins; see ``_in_order``; an unknown start breaks nothing."""
    by = _in_order(claims).withColumn("__year", F.year("__seen"))
    led = sharded.neighbour(by, KEY, "__year", ["__seen", "__start", "claim_id"], ["valid_from"], True, "next_")
    return led.groupBy(*KEY).agg(F.bool_and(F.coalesce(F.col("next_valid_from") >= F.col("valid_to"), F.lit(True))).alias("disjoint"))


def strictly_observed(claims: DataFrame) -> DataFrame:
    """``strict``: whether all claims of a key were observed, each on another day."""
    per = claims.groupBy(*KEY, "observed_at").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*KEY).agg((F.bool_and(F.col("observed_at").isNotNull() & (F.col("n") == 1))).alias("strict"))


def contradictions(claims: DataFrame) -> DataFrame:
    """Pairs of claims of a key with different subjects and overlapping periods, earlier first.

    ``first`` is the claim with the smaller (observation, id); periods that touch overlap only
    when the second begins where the first ends (the comparison is not symmetric on purpose).
    The pairs of a key are its result; a key with very many claims is met block by block.
    """
    rows = claims.where("claim_id is not null").select(*KEY, "claim_id", "subject_id", "valid_from", "valid_to", F.struct(F.coalesce("observed_at", F.lit(OPEN_START).cast("date")), "claim_id").alias("at"))
    met = blocks.paired(rows, KEY, "claim_id", F.expr("a_at < b_at and a_subject_id <> b_subject_id and a_valid_from <= b_valid_to and a_valid_to > b_valid_from"))
    return met.select(*KEY, F.col("a_claim_id").alias("first_id"), F.col("b_claim_id").alias("second_id"), F.col("a_subject_id").alias("first_subject"), F.col("b_subject_id").alias("second_subject"))


def conflicts(claims: DataFrame) -> DataFrame:
    """``subjects, status`` of a key: ``conflict`` with more than one different subject."""
    per = claims.groupBy(*KEY).agg(F.count_distinct("subject_id").alias("subjects"))
    return per.withColumn("status", F.when(F.col("subjects") > 1, "conflict").otherwise("consistent"))


def conflict_state(claims: DataFrame) -> DataFrame:
    """What a key's claims add up to, with the subject that stands and a confidence.

    One subject is definitive; disjoint periods are a succession; strictly ordered observations
    supersede one another; anything else is a conflict, or has to be reviewed without any time.
    """
    facts = conflicts(claims).join(disjoint(claims), KEY).join(strictly_observed(claims), KEY)
    last = _in_order(claims).groupBy(*KEY).agg(F.max_by("subject_id", F.struct("__seen", "__start", "claim_id")).alias("last_subject"), F.bool_or(F.col("observed_at").isNotNull() | F.col("valid_from").isNotNull()).alias("timed"))
    state = (
        F.when(F.col("subjects") == 1, "definitive").when(F.col("disjoint"), "succession").when(F.col("strict"), "superseded").when(F.col("timed"), "conflict").otherwise("review")
    )
    out = facts.join(last, KEY).withColumn("state", state)
    sure = F.when(F.col("state").isin("definitive", "succession"), 0.9).when(F.col("state") == "superseded", 0.85)
    value = F.when(sure.isNotNull(), F.col("last_subject"))
    return out.select(*KEY, "state", value.alias("subject_id"), sure.alias("confidence"))
