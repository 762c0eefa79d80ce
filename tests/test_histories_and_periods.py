"""Problems 1 and 7 against plain Python."""

import random
from datetime import date

from pyspark.sql import functions as F

from factweave.operators import histories, periods

SCHEMA = "entity string, attribute string, value string, at long"


def brute_log(rows):
    out = set()
    keys = {(e, a) for e, a, v, t in rows if v is not None and t is not None}
    for key in keys:
        seen = sorted({(t, v) for e, a, v, t in rows if (e, a) == key and v is not None and t is not None})
        starts = [(t, v) for i, (t, v) in enumerate(seen) if i == 0 or seen[i - 1][1] != v]
        for i, (t, v) in enumerate(starts):
            out.add((*key, v, t, starts[i + 1][0] if i + 1 < len(starts) else None))
    return out


def test_change_log(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["p", "q"]), rng.choice(["x", "y", "z"]), rng.randrange(0, 40) * 7_200_000_000) for _ in range(300)]
    rows += [("a", "p", None, 5), ("a", "p", "x", None), ("hot", None, "x", -5), ("hot", None, "y", -86_400_000_001)]
    rows += rows[:50]  # repeated
    df = spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA + ", run_from string")
    assert set(map(tuple, histories.change_log(df).collect())) == brute_log(rows)
    assert histories.change_log(df.limit(0)).count() == 0


def test_one_entity_with_most_rows_is_spread(spark):
    n = 20_000
    df = spark.range(n).select(F.lit("hot").alias("entity"), F.lit("p").alias("attribute"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("value"), (F.col("id") * 3_600_000_000).alias("at"))
    got = histories.change_log(df)
    assert got.count() == n
    assert got.where("version_to is null").count() == 1
    assert got.where("version_to - version_from <> 3600000000").count() == 0


def test_combined_splits_at_all_boundaries_and_coalesces(spark):
    day = histories.DAY
    rows = [("e", "p", "1", 0), ("e", "p", "2", 3 * day), ("e", "q", "u", day), ("e", "q", "v", 3 * day), ("f", "q", "u", 0)]
    log = histories.change_log(spark.createDataFrame(rows, SCHEMA))
    got = sorted(map(tuple, histories.combined(log, ["p", "q"]).collect()))
    assert got == [("e", 0, day, "1", None), ("e", day, 3 * day, "1", "u"), ("e", 3 * day, None, "2", "v"), ("f", 0, None, None, "u")]


def brute_cover(rows):
    out = set()
    for e in {r[0] for r in rows}:
        merged = []
        for a, b in sorted((a, b) for k, a, b in rows if k == e and a is not None and b is not None and a < b):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        for i, (a, b) in enumerate(merged):
            out.add((e, "period", a, b))
            if i:
                out.add((e, "gap", merged[i - 1][1], a))
    return out


def test_cover(spark):
    rng = random.Random(2)
    end = (date(9999, 12, 31) - date(1970, 1, 1)).days
    rows = []
    for _ in range(400):
        a = rng.randrange(-700_000, 40_000)
        rows.append((rng.choice("abcdefgh"), a, rng.choice([a, a - 5, a + 1, a + 63, a + 64, a + 65, a + rng.randrange(1, 9000), end, None])))
    rows += [("t", 0, 64), ("t", 64, 128), ("t", 129, 4096), ("u", 5, 6), ("u", 5, 6), ("v", -719162, end), (None, 1, 2), ("w", None, 3)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "entity string, start_day long, end_day long, level int")
    assert set(map(tuple, periods.cover(df).collect())) == brute_cover(rows)
    assert periods.cover(df.limit(0)).count() == 0


def test_stated_periods_reads_ten_characters(spark):
    rows = [("@ A  b", "2024-01-02T00:00:00Z", "2024-01-05"), ("a B", "2024-01-05", ""), ("a b", "soon", "2024-02-01"), ("c", "2024-01-01", "unclear"), ("d", "2024-02-30", None), (None, "2024-01-01", None), ("e", None, "2024-01-01")]
    df = spark.createDataFrame(rows, "object_mention string, valid_from string, valid_to string")
    got = sorted((r.entity, r.start_day, r.end_day) for r in periods.stated_periods(df).where("start_day < end_day").collect())
    d = lambda *x: (date(*x) - date(1970, 1, 1)).days
    assert got == [("a b", d(2024, 1, 2), d(2024, 1, 5)), ("a b", d(2024, 1, 5), d(9999, 12, 31))]
