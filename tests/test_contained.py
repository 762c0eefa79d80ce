"""Needles of any kind in texts of any length against plain Python."""

import random
from datetime import date, timedelta

from factweave.operators import temporal
from factweave.plans import contained


def test_latest_text_of_each_needle(spark, monkeypatch):
    monkeypatch.setattr(contained, "PIECE", 64)
    monkeypatch.setattr(contained, "HELD", 3)
    rng = random.Random(8)
    word = lambda most: "".join(rng.choice("abé日 ") for _ in range(rng.randrange(1, most)))
    texts = [word(40) for _ in range(120)] + [word(900) for _ in range(4)] + ["", "x" * 300 + "end", "aaaa" * 70]
    rows = [(rng.randrange(-900, 20000), t) for t in texts]
    needles = {word(14) for _ in range(300)} | {texts[121][5:400], "x" * 200 + "end", "x" * 301, "a", "nowhere", "aaaaaaaa", texts[3]} - {""}
    got = contained.latest(spark.createDataFrame([*rows, (None, "nowhere"), (7, None)], "value int, text string"), spark.createDataFrame([(n,) for n in needles], "needle string"))
    want = {n: max(v for v, t in rows if n in t) for n in needles if any(n in t for _, t in rows)}
    assert {r.needle: r["last"] for r in got.collect()} == want and len(want) > 60
    assert contained.latest(spark.createDataFrame(rows, "value int, text string"), spark.createDataFrame([], "needle string")).count() == 0


def test_anchors_are_not_held_against_every_text(spark):
    start = date(2020, 1, 1)
    texts = spark.range(20_000).selectExpr("date_add(DATE'2020-01-01', cast(id % 1000 as int)) as day", "concat('Note of Item-', id, ' for Team ', id % 77, '.') as text")
    asked = spark.range(3000).selectExpr("cast(id as string) as probe_id", "concat('  ITEM-', id, ' ') as reference").unionAll(spark.createDataFrame([("blank", "  "), ("none", None)], "probe_id string, reference string"))
    found = temporal.dated_mentions(texts, asked)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    holds = lambda i, t: f"item-{i}" in t
    got = {r.probe_id: r.day for r in found.collect()}
    assert len(got) == 3000
    for i in (0, 5, 77, 2999):
        assert got[str(i)] == max(start + timedelta(j % 1000) for j in range(20_000) if holds(i, f"item-{j} "))
