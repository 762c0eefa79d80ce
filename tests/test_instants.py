"""Problem 6 and the zone join."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from factweave.functions import zones
from factweave.operators import instants

WORKSPACES = [("NY", "x", "America/New_York", "MDY"), ("BE", "x", "Europe/Berlin", "DMY"), ("SG", "x", "Asia/Singapore", "YMD"), ("NO", "x", "Nowhere/City", "DMY")]


def micros(text):
    return int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp() * 1_000_000)


CASES = [
    ("2025-02-21T05:47:07+00:00", None, "2025-02-21T05:47:07"),
    ("2025-02-21T05:47:07.123456Z", "NY", "2025-02-21T05:47:07.123456"),
    ("20240903T151153Z", None, "2024-09-03T15:11:53"),
    ("Thu, 28 Mar 2024 15:21:01 +0530", None, "2024-03-28T09:51:01"),
    ("Mon, 07 Oct 2024 06:02:59 EDT", "SG", "2024-10-07T10:02:59"),
    ("2024-04-23 10:03:45-0400", None, "2024-04-23T14:03:45"),
    ("1757888277623", None, "2025-09-14T22:17:57.623"),
    ("1765364688.669685", "NY", "2025-12-10T11:04:48.669685"),
    ("1780197243", None, "2026-05-31T03:14:03"),
    ("3/18/2024 8:02 PM", "NY", "2024-03-19T00:02:00"),
    ("23/10/2025 06:00", "BE", "2025-10-23T04:00:00"),
    ("23/10/2025 06:00", "NY", None),
    ("2025/11/11 03:39", "SG", "2025-11-10T19:39:00"),
    ("Oct 30, 2024 12:47:48 AM", "NY", "2024-10-30T04:47:48"),
    ("2025-03-20", "BE", "2025-03-19T23:00:00"),
    ("2024-11-03 01:30:00", "NY", "2024-11-03T05:30:00"),  # twice: the first
    ("2024-03-10 02:30:00", "NY", "2024-03-10T07:30:00"),  # skipped: moved forward
    ("2025-10-26T02:15:00", "BE", "2025-10-26T00:15:00"),
    ("2025-03-30T02:15:00", "BE", "2025-03-30T01:15:00"),
    ("2024-05-01 10:00:00", None, "2024-05-01T10:00:00"),
    ("2024-05-01 10:00:00", "unknown", "2024-05-01T10:00:00"),
    ("2024-05-01 10:00:00", "NO", None),
    ("  2024-05-01 10:00:00 UTC ", None, "2024-05-01T10:00:00"),
    ("2025-02-30", None, None), ("2025-13-45T10:00:00", None, None), ("0000-00-00", None, None), ("next Tuesday", None, None),
    ("12:67:07", None, None), ("", None, None), (None, "NY", None), ("2024-05-01 25:00:00", None, None), ("2024-05-01 10:00:00 QQQ", None, None),
]


def test_forms(spark):
    w = spark.createDataFrame(WORKSPACES, "workspace_id string, workspace_subdomain string, time_zone string, date_order string")
    # Extra columns whose names are those of columns used inside.
    rows = [(i, t, p, "x", "y") for i, (t, p, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "n int, value string, place string, time_zone string, year string")
    got = {r.n: r.u for r in instants.normalize(df, "value", "u", "place", w).collect()}
    assert len(got) == len(CASES)
    for i, (t, p, want) in enumerate(CASES):
        assert got[i] == (micros(want) if want else None), (t, p, got[i], want)


def test_result_is_distinct_and_without_canonical(spark):
    w = spark.createDataFrame(WORKSPACES, "workspace_id string, workspace_subdomain string, time_zone string, date_order string")
    rows = [("f", "1", "2024-05-01T10:00:00+00:00", None), ("f", "2", "1714557600", None), ("f", "2", "1714557600", None), ("f", None, "1714557600", None), ("f", "3", "x" * 100_000, None)]
    values = spark.createDataFrame(rows, "field_name string, row_id string, value string, workspace_id string")
    got = sorted(map(tuple, instants.instants(values, w).collect()), key=str)
    assert got == [("f", "2", 1714557600000000), ("f", None, 1714557600000000)]
    assert instants.instants(values.limit(0), w.limit(0)).count() == 0


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/London", "Australia/Sydney", "Asia/Kolkata", "Pacific/Apia"])
def test_segments_agree_with_the_zone_rules(spark, zone):
    zoneinfo = pytest.importorskip("zoneinfo")
    try:
        z = zoneinfo.ZoneInfo(zone)
    except Exception:
        pytest.skip("no zone data")
    table = zones.segments(spark, spark.createDataFrame([(zone,), (zone,), (None,)], "z string"))
    hours = spark.range(0, 24 * 366 * 2).select((F.lit(1672531200) + F.col("id") * 3600).alias("s"))
    df = hours.select((F.col("s") * 1_000_000).alias("local"), F.lit(zone).alias("zone"))
    got = zones.localize(df, "local", "zone", table, "utc").collect()
    assert len(got) == 24 * 366 * 2
    for r in got[::7]:
        wall = datetime.fromtimestamp(r.local / 1e6, timezone.utc).replace(tzinfo=z, fold=0)
        assert r.utc == int(wall.timestamp()) * 1_000_000, wall


def test_summer_time_of_any_year(spark):
    """Far from the exploded years as well, held against another implementation of the zone rules."""
    from zoneinfo import ZoneInfo

    names = ["America/New_York", "Europe/Berlin", "Australia/Sydney", "Asia/Kolkata"]
    rows = [(z, y, m, d, h) for z in names for y in (1801, 1850, 1899, 1950, 2024, 2099, 2100, 2101, 2137, 2150, 2200, 2400, 2996, 9998) for m, d, h in ((1, 1, 0), (1, 15, 12), (7, 1, 12), (12, 31, 23))]
    df = spark.createDataFrame([(z, micros(f"{y:04}-{m:02}-{d:02}T{h:02}:00:00")) for z, y, m, d, h in rows], "zone string, local long")
    seg = zones.segments(spark, spark.createDataFrame([(z,) for z in names], "z string"))
    got = {(r.zone, r.local): r.utc for r in zones.localize(df, "local", "zone", seg, "utc").collect()}
    for z, y, m, d, h in rows:
        at = datetime(y, m, d, h, tzinfo=ZoneInfo(z))
        local = micros(f"{y:04}-{m:02}-{d:02}T{h:02}:00:00")
        assert got[z, local] == local - int(at.utcoffset().total_seconds()) * 1_000_000, (z, y, m)
