"""Files, archives, pages, deduplication and retries on small tables."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from factweave.plans.lineage import shared_dir
from factweave.sources import files, paged
from factweave.streaming import ingest


def test_jsonl(spark, tmp_path):
    good = {"claim_id": "a", "confidence": 0.5, "metadata": {"v": "2"}}
    (tmp_path / "x.jsonl").write_text(json.dumps(good) + "\n\n{broken\n" + json.dumps(good | {"claim_id": "b"}) + "\n")
    path = str(tmp_path / "x.jsonl")
    assert sorted(r.claim_id for r in files.read_jsonl(spark, path, files.CLAIM, strict=False).collect()) == ["a", "b"]
    assert [tuple(r) for r in files.broken_lines(spark, path, files.CLAIM).collect()] == [("x.jsonl", "{broken")]
    with pytest.raises(Exception):
        files.read_jsonl(spark, path, files.CLAIM).collect()


def test_archives_and_checksums(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("gmail/b.txt", b"two \xff")
        z.writestr("slack/a.txt", "one")
        z.writestr("slack/skip.bin", "no")
    got = files.read_archives(spark, str(tmp_path / "c.zip")).collect()
    assert [(r.source, r.member, r.text) for r in got] == [("gmail", "gmail/b.txt", "two �"), ("slack", "slack/a.txt", "one")]
    assert files.checksums(spark, str(tmp_path)).first().sha256


def test_paged_source_batch_and_stream(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps({"position": f"{i:03d}", "x": i}) for i in (5, 1, 4, 2, 3)))
    spark.dataSource.register(paged.PagedSource)
    options = {"path": str(tmp_path / "r.jsonl"), "page": "2"}
    got = [r.position for r in spark.read.format("paged").options(**options).load().collect()]
    assert got == ["001", "002", "003", "004", "005"]


def brute_either(rows):
    ids, keys, out = set(), set(), []
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        if i not in ids and (k is None or k not in keys):
            out.append((i, k, t))
            ids.add(i)
            if k is not None:
                keys.add(k)
    return set(out)


def test_either_key_dedup(spark):
    import random

    rng = random.Random(9)
    rows = [(rng.randrange(60), rng.choice([None, *"abcdefghijklmnop"]), t) for t in range(200)]
    df = spark.createDataFrame(rows, "i int, k string, t int")
    assert {tuple(r) for r in ingest.first_of_either(df, "i", "k", "t").collect()} == brute_either(rows)
    assert ingest.first_of_either(df.limit(0), "i", "k", "t").count() == 0
    got = ingest.deduplicated(ingest.replay(df, 3, "t"), "i", "k", "t")
    assert {tuple(r) for r in got.collect()} == brute_either(rows)


def test_retry_and_park(spark):
    df = spark.range(12).withColumn("v", F.col("id"))
    log, parked = ingest.ingested(ingest.replay(df, 4, "id"), lambda r: r.withColumn("good", (F.col("v") % 2 == 0) | ((F.col("v") == 1) & (F.col("__attempts") == 2))), "good")
    assert sorted(r.id for r in log.collect()) == [0, 1, 2, 4, 6, 8, 10]
    assert all(r["__attempts"] == 3 for r in parked.collect()) and shared_dir(spark, "x") != shared_dir(spark, "x")


def test_every_row_is_logged_or_parked(spark):
    df = spark.range(12).withColumn("v", F.col("id"))
    good = (F.col("v") % 2 == 0) | ((F.col("v") == 11) & (F.col("__attempts") == 2)) | ((F.col("v") == 7) & (F.col("__attempts") == 1))
    log, parked = ingest.ingested(ingest.replay(df, 4, "id"), lambda r: r.withColumn("good", good), "good")
    assert sorted((r.id, r["__attempts"]) for r in log.collect()) == [(0, 1), (2, 1), (4, 1), (6, 1), (7, 2), (8, 1), (10, 1), (11, 3)]
    assert sorted((r.id, r["__attempts"]) for r in parked.collect()) == [(1, 3), (3, 3), (5, 3), (9, 3)]
