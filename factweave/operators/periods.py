"""Problem 7: continuous periods and gaps, from compressed run bitmaps of days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.functions.text import is_blank, mention_key
from factweave.sources.tables import table

#: A word of each level stands for 64 units of the level below; level 0 counts days.
BITS = 64
LEVELS = 4
#: Days before this one (0001-01-01 is day -719162) never occur, so all unit numbers are positive.
ORIGIN = 719_528
OPEN_END = "9999-12-31"


def _mask(lo: Column, hi: Column) -> Column:
    """Word with bits ``lo`` .. ``hi - 1`` set, for 0 <= lo < hi <= 64."""
    ones = F.lit(-1).cast("long")
    upto = F.when(hi >= BITS, ones).otherwise(F.bitwise_not(F.call_function("shiftleft", ones, hi.cast("int"))))
    return upto.bitwiseAND(F.call_function("shiftleft", ones, lo.cast("int")))


def _word_of(lo: Column, hi: Column):
    def word(w: Column) -> Column:
        mask = _mask(F.greatest(lo - w * BITS, F.lit(0)), F.least(hi - w * BITS, F.lit(BITS)))
        return F.struct(F.lit(LEVELS - 1).alias("level"), w.cast("long").alias("word"), mask.alias("mask"))

    return word


def _words(start: Column, end: Column) -> Column:
    """Array of ``(level, word, mask)`` that covers the days ``start`` .. ``end - 1``.

    Whole words of a level are passed to the level above as its set units, which is the run
    compression: an interval of any length takes at most two words of each level, and one of
    the last level for every 64 ** LEVELS days.
    """
    parts = []
    lo, hi = start, end
    for level in range(LEVELS):
        first, last = F.floor(lo / BITS), F.floor((hi - 1) / BITS)
        some = lo < hi
        if level == LEVELS - 1:
            parts.append(F.when(some, F.transform(F.sequence(first, last), _word_of(lo, hi))))
            break
        # The first and the last word are kept here unless they are whole.
        head = F.struct(
            F.lit(level).alias("level"), first.cast("long").alias("word"),
            _mask(lo - first * BITS, F.least(hi - first * BITS, F.lit(BITS))).alias("mask"),
        )
        tail = F.struct(
            F.lit(level).alias("level"), last.cast("long").alias("word"),
            _mask(F.greatest(lo - last * BITS, F.lit(0)), hi - last * BITS).alias("mask"),
        )
        parts.append(F.when(some, F.array(head)))
        parts.append(F.when(some & (last > first), F.array(tail)))
        lo, hi = F.when(some, first + 1).otherwise(F.lit(0)), F.when(some, last).otherwise(F.lit(0))
    empty = F.array().cast("array<struct<level:int,word:bigint,mask:bigint>>")
    return F.concat(*[F.coalesce(p.cast("array<struct<level:int,word:bigint,mask:bigint>>"), empty) for p in parts])


def _set_runs(word: Column, mask: Column, size: Column) -> Column:
    """Array of ``(from_day, to_day)`` of the runs of set bits of a word."""
    bits = F.sequence(F.lit(0), F.lit(BITS - 1))

    def on(i: Column) -> Column:
        return F.getbit(mask, i) == 1

    starts = F.filter(bits, lambda i: F.when(i == 0, on(i)).otherwise(on(i) & ~on(F.greatest(i - 1, F.lit(0)))))
    ends = F.filter(bits, lambda i: F.when(i == BITS - 1, on(i)).otherwise(on(i) & ~on(F.least(i + 1, F.lit(BITS - 1)))))
    base = word * BITS
    return F.zip_with(starts, ends, lambda a, b: F.struct(((base + a) * size).alias("f"), ((base + b + 1) * size).alias("t")))


def cover(intervals: DataFrame) -> DataFrame:
    """``entity, kind, start_day, end_day`` (dates as day numbers) of the union of intervals.

    ``intervals``: ``entity, start_day, end_day`` with day numbers since 1970, the end
    exclusive. ``kind`` is ``period`` for each maximal covered stretch and ``gap`` between two
    neighbouring ones. Touching intervals are one period; empty, reversed and null intervals
    cover nothing. The bitmaps are united with a map-side ``bit_or``; what is left of an
    entity is bounded by the days of the calendar, however many intervals it had.
    """
    valid = intervals.where("start_day < end_day")
    words = valid.select("entity", F.explode(_words(F.col("start_day") + ORIGIN, F.col("end_day") + ORIGIN)).alias("w"))
    united = words.groupBy("entity", "w.level", "w.word").agg(F.bit_or("w.mask").alias("mask"))
    size = F.element_at(F.array(*[F.lit(BITS**i) for i in range(LEVELS)]).cast("array<bigint>"), F.col("level") + 1)
    runs = united.select("entity", F.explode(_set_runs(F.col("word"), F.col("mask"), size)).alias("r"))
    per = Window.partitionBy("entity").orderBy("f", "t")
    flat = runs.select("entity", F.col("r.f").alias("f"), F.col("r.t").alias("t"))
    reach = flat.withColumn("reach", F.max("t").over(per.rowsBetween(Window.unboundedPreceding, -1)))
    marked = reach.withColumn("fresh", (F.col("reach").isNull() | (F.col("f") > F.col("reach"))).cast("int"))
    numbered = marked.withColumn("no", F.sum("fresh").over(per.rowsBetween(Window.unboundedPreceding, 0)))
    periods = numbered.groupBy("entity", "no").agg(F.min("f").alias("f"), F.max("t").alias("t"))
    led = periods.withColumn("next", F.lead("f").over(Window.partitionBy("entity").orderBy("f")))
    both = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("f").alias("f"), F.col("t").alias("t")),
        F.struct(F.lit("gap").alias("kind"), F.col("t").alias("f"), F.col("next").alias("t")),
    )
    out = led.select("entity", F.explode(both).alias("x")).where("x.t is not null")
    return out.select("entity", "x.kind", (F.col("x.f") - ORIGIN).alias("start_day"), (F.col("x.t") - ORIGIN).alias("end_day"))


def stated_periods(claims: DataFrame) -> DataFrame:
    """``entity, start_day, end_day`` of the claims with a readable ``valid_from``.

    A date is read from the first ten characters. An empty ``valid_to`` is open, one that is
    neither empty nor readable covers nothing.
    """
    def day(c: str) -> Column:
        ten = F.substring(F.trim(c), 1, 10)
        return F.unix_date(F.when(ten.rlike(r"^\d{4}-\d{2}-\d{2}$"), ten).try_cast("date"))

    end = F.when(is_blank(F.col("valid_to")), F.unix_date(F.lit(OPEN_END).cast("date"))).otherwise(day("valid_to"))
    return claims.select(
        mention_key(F.col("object_mention")).alias("entity"), day("valid_from").cast("long").alias("start_day"), end.cast("long").alias("end_day")
    ).where("entity is not null")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Periods and gaps of every object about which claims state a period."""
    found = cover(stated_periods(table(spark, folder, "claims_checkpoint50")))

    def text(c: str) -> Column:
        return F.date_from_unix_date(F.col(c).cast("int")).cast("string")

    return found.select(F.col("entity").alias("object_key"), "kind", text("start_day").alias("start_day"), text("end_day").alias("end_day"))
