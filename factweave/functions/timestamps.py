"""Reading instants written in many forms.

``parse`` adds two columns:

* ``instant``: micros since 1970-01-01 UTC, for values that state their zone or are epochs,
* ``local``: micros of the wall clock as if it were UTC, for values without a zone.

Both are null for values that cannot be read (words, impossible dates or times, unknown
zone names). Everything is built from JVM expressions, one regular expression per value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# UTC offsets, in minutes, of the zone names used in mail headers.
ZONE_NAMES = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
    "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "SGT": 480, "HKT": 480, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660,
    "ACST": 570, "ACDT": 630, "AWST": 480, "NZST": 720, "NZDT": 780,
}

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_ZONE = r"(?:\s*([A-Za-z]{1,5}|[+-]\d{2}:?\d{2}|[+-]\d{2}))?"
_AP = r"(?:\s*([AaPp]\.?[Mm]\.?))?"
# Each pattern is rewritten to year|month|day|hour|minute|second|fraction|am-pm|zone.
ISO = (rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})(?:(?:[Tt]|\s+){_CLOCK}{_ZONE})?$", "$1|$3|$4|$5|$6|$7|$8||$9")
BASIC = (r"^(\d{4})(\d{2})(\d{2})(?:[Tt](\d{2})(\d{2})(?:(\d{2})(?:[.,](\d{1,9}))?)?" + _ZONE + r")?$", "$1|$2|$3|$4|$5|$6|$7||$8")
MAIL = (rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})[\s-]([A-Za-z]{{3,9}})\.?[\s-](\d{{4}})(?:,?\s+{_CLOCK}{_ZONE}(?:\s*\([^)]*\))?)?$", "$3|$2|$1|$4|$5|$6|$7||$8")
WORDY = (rf"^(?:[A-Za-z]{{3,9}},\s+)?([A-Za-z]{{3,9}})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})(?:,?\s+{_CLOCK}{_AP}{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9")
_FIGURES = rf"^(\d{{1,2}})([/.-])(\d{{1,2}})\2(\d{{4}})(?:,?\s+{_CLOCK}{_AP}{_ZONE})?$"
MDY = (_FIGURES, "$4|$1|$3|$5|$6|$7|$8|$9|$10")
DMY = (_FIGURES, "$4|$3|$1|$5|$6|$7|$8|$9|$10")

MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def _int(c: Column) -> Column:
    return c.try_cast("int")


def parse(df: DataFrame, value: str, date_order: str | None, instant: str, local: str) -> DataFrame:
    """Adds columns ``instant`` and ``local`` for the textual time in ``value``.

    ``date_order`` names a column with ``MDY``, ``DMY`` or ``YMD`` for dates in figures (null
    means ``YMD``, in which a date that begins with a day or month cannot be read). The steps
    are separate projections, so that each expression is computed once.
    """
    v = F.col("__ts_v")
    order = F.coalesce(F.col(date_order), F.lit("YMD")) if date_order else F.lit("YMD")
    epoch = F.when(v.rlike(r"^\d{9,10}(\.\d{1,9})?$"), (v.try_cast("decimal(20,6)") * F.lit(1000000)).cast("long"))
    epoch = epoch.when(v.rlike(r"^\d{12,13}$"), v.try_cast("long") * F.lit(1000))
    epoch = epoch.when(v.rlike(r"^\d{15,16}$"), v.try_cast("long"))

    def rewrite(p: tuple[str, str]) -> Column:
        return F.regexp_replace(v, p[0], p[1])

    fields = (
        F.when(v.rlike(r"^\d{4}[-/.]"), rewrite(ISO))
        .when(v.rlike(r"^\d{8}([Tt]|$)"), rewrite(BASIC))
        .when(v.rlike(r"^[A-Za-z]{3,9},?\s+\d{1,2}\s+[A-Za-z]|^\d{1,2}[\s-][A-Za-z]"), rewrite(MAIL))
        .when(v.rlike(r"^[A-Za-z]{3,9}[.,]?\s+[A-Za-z0-9]"), rewrite(WORDY))
        .when(v.rlike(r"^\d{1,2}[/.-]\d") & (order == "MDY"), rewrite(MDY))
        .when(v.rlike(r"^\d{1,2}[/.-]\d") & (order == "DMY"), rewrite(DMY))
    )
    parts = df.withColumn("__ts_v", F.trim(value)).withColumns({"__ts_epoch": epoch, "__ts_p": F.split(fields, r"\|")})

    def at(i: int) -> Column:
        return F.try_element_at("__ts_p", F.lit(i + 1))

    month_at = F.instr(F.lit(MONTHS), F.lower(F.substring(at(1), 1, 3)))
    month = F.when(at(1).rlike(r"^\d"), _int(at(1))).when(month_at % 3 == 1, ((month_at + 2) / 3).cast("int"))
    parts = parts.withColumns({
        "__ts_whole": F.size("__ts_p") == 9,
        "__ts_month": month,
        "__ts_hour": F.coalesce(_int(at(3)), F.lit(0)),
        "__ts_minute": F.coalesce(_int(at(4)), F.lit(0)),
        "__ts_second": F.coalesce(_int(at(5)), F.lit(0)),
        "__ts_micros": F.when(at(6) != "", _int(F.rpad(F.substring(at(6), 1, 6), 6, "0"))).otherwise(0),
        "__ts_ap": F.upper(F.substring(at(7), 1, 1)),
        "__ts_zone": F.upper(at(8)),
        "__ts_digits": F.rpad(F.regexp_replace(at(8), r"[^\d]", ""), 4, "0"),
    })
    names = F.create_map(*[x for k, m in ZONE_NAMES.items() for x in (F.lit(k), F.lit(m))])
    hour, zone = F.col("__ts_hour"), F.col("__ts_zone")
    off_h, off_m = _int(F.substring("__ts_digits", 1, 2)), _int(F.substring("__ts_digits", 3, 2))
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    numeric = F.when((off_h <= 18) & (off_m <= 59), sign * (off_h * 60 + off_m))
    two = F.lpad(F.col("__ts_month").cast("string"), 2, "0")
    parts = parts.withColumns({
        "__ts_day": F.unix_date(F.concat_ws("-", at(0), two, F.lpad(at(2), 2, "0")).try_cast("date")).cast("long"),
        "__ts_h24": F.when(F.col("__ts_ap") == "", hour).when(hour.between(1, 12), hour % 12 + F.when(F.col("__ts_ap") == "P", 12).otherwise(0)),
        "__ts_off": F.when(zone.rlike(r"^[+-]"), numeric).otherwise(F.try_element_at(names, zone)),
    })
    fits = F.expr("__ts_whole and __ts_month is not null and __ts_h24 <= 23 and __ts_minute <= 59 and __ts_second <= 59")
    seconds = F.expr("__ts_day * 86400 + __ts_h24 * 3600 + __ts_minute * 60 + __ts_second")
    parts = parts.withColumn("__ts_wall", F.when(fits, seconds * F.lit(1000000) + F.col("__ts_micros")))
    zoned = F.when(zone != "", F.col("__ts_wall") - F.col("__ts_off").cast("long") * F.lit(60000000))
    both = F.struct(
        F.coalesce("__ts_epoch", zoned).alias("i"),
        F.when(F.col("__ts_epoch").isNull() & (zone == ""), F.col("__ts_wall")).alias("l"),
    )
    # The one-element generator keeps later filters from being pushed below, which would
    # copy the whole expression into them.
    made = parts.select(*df.columns, F.explode(F.array(both)).alias("__ts_t"))
    return made.select(*df.columns, F.col("__ts_t.i").alias(instant), F.col("__ts_t.l").alias(local))


def iso_utc(micros: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ssZ`` of micros since 1970, independent of the session's zone."""
    seconds = F.floor(micros / F.lit(1000000)).cast("long")
    return iso_utc_seconds(seconds)


def iso_utc_seconds(seconds: Column) -> Column:
    days = F.floor(seconds / F.lit(86400)).cast("int")
    rest = (seconds - days.cast("long") * 86400).cast("int")
    clock = F.format_string("T%02d:%02d:%02dZ", F.floor(rest / 3600).cast("int"), (F.floor(rest / 60) % 60).cast("int"), rest % 60)
    return F.concat(F.date_from_unix_date(days).cast("string"), clock)
