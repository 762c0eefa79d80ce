"""Wall clock to UTC by an as-of join with exploded zone-offset intervals.

Every zone has a list of offset intervals ``[instant_from, instant_to)``. Shifted by their
offset they become intervals of wall-clock time, which overlap where clocks are set back and
leave a hole where clocks are set forward. ``segments`` cuts wall-clock time at the union of
all interval ends, so each segment knows how many intervals cover it: one gives the offset,
two mean the local time is ambiguous, none that it does not exist.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.plans.small import collected

#: Wall-clock years in which segments are exploded. No zone has a transition before them, and
#: after them rules only repeat: a later year has those of one of the last 28 years with the
#: same first weekday and number of days.
FIRST_YEAR, LAST_YEAR = 1800, 2100
#: More zones than exist in the IANA database.
MAX_ZONES = 1000
_FAR = 2**61


def offset_intervals(spark: SparkSession, zone: str) -> list[tuple[str, int, int, int]]:
    """``(zone, instant_from, instant_to, offset_s)`` in seconds, from the JVM's zone rules."""
    time = spark._jvm.java.time
    try:
        rules = time.ZoneId.of(zone).getRules()
    except Exception:  # an unknown zone name has no interval, its times stay unread
        return []
    at = time.Instant.parse(f"{FIRST_YEAR}-01-01T00:00:00Z")
    end = time.Instant.parse(f"{LAST_YEAR}-01-01T00:00:00Z").getEpochSecond()
    start, offset, found = -_FAR, rules.getOffset(at).getTotalSeconds(), []
    step = rules.nextTransition(at)
    while step is not None and step.toEpochSecond() < end:
        found.append((zone, start, step.toEpochSecond(), offset))
        start, offset = step.toEpochSecond(), step.getOffsetAfter().getTotalSeconds()
        step = rules.nextTransition(step.getInstant())
    return [*found, (zone, start, _FAR, offset)]


def segments(spark: SparkSession, zones: DataFrame) -> DataFrame:
    """``zone, year, local_from, local_to, matches, offset_s`` for the zones of a one-column table.

    ``offset_s`` is the one to use: that of the only interval, of the first of two intervals,
    or, in a hole, the one before it (which moves the time forward by what was skipped).
    The result is bounded by zones x years: at most ``MAX_ZONES`` zones are accepted.
    """
    names = [r[0] for r in collected(zones.where(F.col(zones.columns[0]).isNotNull()).distinct(), MAX_ZONES, "zones")]
    rows = []
    for name in names:
        local = [(max(a + o, -_FAR), min(b + o, _FAR), o) for _, a, b, o in offset_intervals(spark, name)]
        cuts = sorted({x for a, b, _ in local for x in (a, b)})
        for lo, hi in zip(cuts, cuts[1:]):
            over = [o for a, b, o in local if a <= lo and hi <= b]
            before = [o for a, b, o in local if b <= lo]
            rows.append((name, lo, hi, len(over), (over or before[-1:])[0]))
    schema = "zone string, local_from long, local_to long, matches int, offset_s int"
    made = spark.createDataFrame(rows, schema)
    first, last = _year(F.col("local_from")), _year(F.col("local_to"))
    return made.withColumn("year", F.explode(F.sequence(F.least(first, last), last)))


def _day(year: int) -> int:
    return datetime.date(year, 1, 1).toordinal() - datetime.date(1970, 1, 1).toordinal()


def _year(seconds: Column) -> Column:
    clamped = F.greatest(F.least(seconds, F.lit(_day(LAST_YEAR) * 86400 - 1)), F.lit(_day(FIRST_YEAR) * 86400))
    return F.year(F.date_from_unix_date(F.floor(clamped / 86400).cast("int")))


def _repeated(seconds: Column) -> Column:
    """The same time of a year whose rules are known, for times from ``LAST_YEAR`` on."""
    alike = {(datetime.date(y, 1, 1).weekday(), _day(y + 1) - _day(y)): y for y in range(LAST_YEAR - 28, LAST_YEAR)}
    like = F.create_map(*[x for (w, n), y in alike.items() for x in (F.lit(w * 1000 + n), F.lit(_day(y)))])
    day = F.floor(seconds / 86400).cast("int")
    year = F.year(F.date_from_unix_date(day))
    start = F.unix_date(F.make_date(year, F.lit(1), F.lit(1)))
    size = F.unix_date(F.make_date(year + 1, F.lit(1), F.lit(1))) - start
    moved = seconds - (start - F.element_at(like, F.weekday(F.date_from_unix_date(start)) * 1000 + size)).cast("long") * 86400
    return F.when(seconds < _day(LAST_YEAR) * 86400, seconds).otherwise(moved)


def localize(df: DataFrame, local: str, zone: str, table: DataFrame, out: str) -> DataFrame:
    """Adds ``out``, the UTC micros of the wall-clock micros ``local`` in ``zone``.

    Null where ``local`` or ``zone`` is null or the zone is unknown. The segments are
    disjoint, so every row matches at most one and no row is duplicated.
    """
    seg = F.broadcast(table.select(
        F.col("zone").alias("__z_zone"), F.col("year").alias("__z_year"),
        F.col("local_from").alias("__z_from"), F.col("local_to").alias("__z_to"), F.col("offset_s").alias("__z_off"),
    ))
    seconds = _repeated(F.floor(F.col(local) / F.lit(1000000)).cast("long"))
    keyed = df.withColumn("__z_s", seconds).withColumn("__z_y", _year(F.col("__z_s")))
    on = (F.col(zone) == F.col("__z_zone")) & (F.col("__z_y") == F.col("__z_year"))
    on = on & (F.col("__z_s") >= F.col("__z_from")) & (F.col("__z_s") < F.col("__z_to"))
    utc = F.col(local) - F.col("__z_off").cast("long") * F.lit(1000000)
    return keyed.join(seg, on, "left").withColumn(out, utc).drop("__z_s", "__z_y", "__z_zone", "__z_year", "__z_from", "__z_to", "__z_off")
