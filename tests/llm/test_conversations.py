"""Problem 2: what is kept, in which order, and that late and repeated rows change nothing."""

import random

import pytest
from pyspark.sql import functions as F

from factweave.llm import conversations as C
from factweave.plans.lineage import shared_dir

META = "struct<message_id:string,channel_id:string,thread_id:string,workspace_id:string,author_user_id:string,author_display_name:string,reply_count:int>"
SCHEMA = f"id string, source string, timestamp string, content string, metadata {META}, thread string"
T = "1740000000.000000"


def row(i, channel, thread, author="U1", at="2025-02-19T21:20:00Z", body="hello", replies=0, source="slack", name="Ann Bee", message=None):
    message = message or f"17400000{i:02d}.000000"
    content = None if body is None else f"#c\n{name}: {body}" if name else f"#c\nAnn: {body}"
    return (f"a-{channel}-{i}", source, at, content, (message, channel, thread, None, author, name, replies), "extra")


def kept(spark, rows, batches=1):
    df = spark.createDataFrame(rows, SCHEMA)
    at = shared_dir(spark, "in")
    df.repartition(max(1, batches)).write.parquet(at)
    places = spark.createDataFrame([], "workspace_id string, date_order string")
    stream = C.messages(spark.readStream.schema(df.schema).parquet(at), places)
    out = C.run(stream, shared_dir(spark, "conv"))
    found = spark.read.schema(C.RESULT).option("recursiveFileLookup", "true").parquet(out)
    return sorted((r.channel_id, r.turn_no, r.artifact_id, r.role) for r in found.collect())


def test_rules(spark):
    rows = []
    for ch, change in {
        "ok": {}, "noroot": {0: None}, "alone": {1: {"author": " <@u1> "}, 2: {"author": "u1"}}, "anon": {2: {"author": " "}}, "nobody": {2: {"body": "​  "}},
        "nulltext": {2: {"body": None}}, "undated": {2: {"at": "next Tuesday"}}, "baddate": {2: {"at": "2025-02-30"}}, "missing": {0: {"replies": 3}},
        "spelled": {1: {"thread": "p1740000000000000"}, 2: {"thread": f" {T} "}}, "noname": {1: {"name": None}}, "mail": {1: {"source": "gmail"}, 0: {"replies": 2}},
    }.items():
        for i in range(3):
            args = {"author": "U1" if i == 0 else f"U{i + 1}", "replies": 2 if i == 0 and ch != "mail" else 0}
            extra = change.get(i, {})
            if extra is not None:
                args |= extra
                thread = args.pop("thread", T)
                rows.append(row(i, ch, thread, **args))
    rows += [row(9, "ok", None), row(8, "ok", ""), row(7, None, T), (None, None, None, None, None, None)]
    rows += rows[:7]  # delivered again
    random.Random(5).shuffle(rows)
    got = kept(spark, rows)
    assert {g[0] for g in got} == {"ok", "spelled", "noname"}
    assert [g for g in got if g[0] == "ok"] == [("ok", 1, "a-ok-0", "starter"), ("ok", 2, "a-ok-1", "replier"), ("ok", 3, "a-ok-2", "replier")]


def test_thread_without_closing_zeros(spark):
    root = "1740000000.194700"
    rows = [row(i, "short", t, f"U{i}", replies=3 if i == 0 else 0, message=root if i == 0 else None) for i, t in enumerate([root, "1740000000.1947", " 1740000000.1947 ", "1740000000.19470"])]
    assert [g[1:] for g in kept(spark, rows)] == [(1, "a-short-0", "starter"), (2, "a-short-1", "replier"), (3, "a-short-2", "replier"), (4, "a-short-3", "replier")]


@pytest.mark.parametrize("thread,key", [
    ("1740000000.1947", "1740000000.194700"), ("1740000000.1", "1740000000.100000"), ("1740000000", T), ("1740000000.", T), ("p1740000000194700", "1740000000.194700"),
    ("1740000000.1947001", None), ("174000000.1947", None), ("p17400000001947", None), ("x", None), ("", None), (None, None),
])
def test_thread_key(spark, thread, key):
    assert spark.createDataFrame([(thread,)], "t string").select(C.thread_key(F.col("t"))).first()[0] == key


def test_long_conversation_is_numbered_whole(spark):
    n = 3000
    rows = [row(0, "big", T, replies=n)] + [(f"a{i}", "slack", "1740000000", "#c\nX: y", (f"{1740000000 + i * 60}.000100", "big", T, None, f"U{i % 7}", "X", 0), "") for i in range(1, n + 1)]
    got = kept(spark, rows)
    assert [g[1] for g in got] == list(range(1, n + 2))
    assert got[0][2] == "a-big-0" and got[-1][2] == f"a{n}"


def thread(ch, at, n, start=0, author="U"):
    """``n`` messages of a conversation that begins ``at`` seconds; ``start`` is the first one of this part."""
    root = f"{at}.000000"
    return [(f"a-{ch}-{i}", "slack", "2025-02-19T21:20:00Z", "#c\nAnn Bee: x", (f"{at + i}.000000", ch, root, None, f"{author}{i}", "Ann Bee", n - 1 if i == 0 else 0), "") for i in range(start, n)]


DAY = 86_400


def test_many_batches_with_late_rows_and_a_root_ahead_of_the_clock(spark):
    first, later = 1_600_000_000, 1_600_000_000 + 200 * DAY
    parts = [
        thread("early", first, 4)[:2] + thread("ahead", 9_999_999_000, 3),  # the rest of `early` comes in the next part
        thread("early", first, 4, 2) + thread("mid", first + 50 * DAY, 3),
        thread("new", later, 3),  # moves the watermark past `early` and `mid`
        thread("lost", first + 10 * DAY, 3) + thread("mid", first + 50 * DAY, 4, 3),  # too late
        thread("next", later + 95 * DAY, 3),
    ]
    root = shared_dir(spark, "many")
    places = spark.createDataFrame([], "workspace_id string, date_order string")
    for no, rows in enumerate(parts):  # the job is started again for every part, and goes on where it stopped
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
        schema = spark.read.parquet(f"{root}/in").schema
        out = C.run(C.messages(spark.readStream.schema(schema).parquet(f"{root}/in"), places), f"{root}/job", bounded_input=False)
    found = spark.read.schema(C.RESULT).option("recursiveFileLookup", "true").parquet(out).collect()
    got = {}
    for r in found:
        got.setdefault(r.channel_id, []).append(r.turn_no)
    assert {k: sorted(v) for k, v in got.items()} == {"early": [1, 2, 3, 4], "mid": [1, 2, 3], "new": [1, 2, 3]}
    arrived = C.messages(spark.read.parquet(f"{root}/in"), places)
    assert {(r.channel_id, r.artifact_id) for r in C.late(arrived.where(C.plausible(arrived)), f"{root}/job").collect()} == {("lost", f"a-lost-{i}") for i in range(3)} | {("mid", "a-mid-3")}
    refused = spark.read.parquet(f"{root}/job/refused")
    assert {r.channel_id for r in refused.collect()} == {"ahead"}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    places = spark.createDataFrame([], "workspace_id string, date_order string")
    assert C.messages(df, places).count() == 0
    assert C.validated(spark.createDataFrame([], C.MESSAGE)).count() == 0


@pytest.mark.parametrize("content,name,seen", [("#c\nA: x", "A", True), ("#c\nA:", "A", False), ("#c", "A", False), ("", None, False), (None, "A", False), ("#c\nA: ﻿", "A", False), ("#c\nLong: x" + "y" * 50_000, None, True)])
def test_body(spark, content, name, seen):
    df = spark.createDataFrame([(content, name)], "c string, n string")
    assert df.select(C.has_body(F.col("c"), F.col("n"))).first()[0] is seen
