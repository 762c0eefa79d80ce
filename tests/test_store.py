"""The claim graph store, the worker that feeds it, scores and answering systems."""

import pytest
from pyspark.sql import functions as F

from factweave.operators import evaluation as E
from factweave.plans import rag
from factweave.plans.lineage import shared_dir
from factweave.sources.store import GraphStore
from factweave.streaming import ingest as G
from factweave.streaming import worker

ART = "id string, source string, type string, title string, timestamp string, content string"
CLAIM = "claim_id string, artifact_id string, subject_mention string, predicate string, object_mention string, observed_at string, valid_from string, valid_to string, confidence double, extraction_method string, evidence_span string"


def claim(n, s, p, o, at="2024-01-01", start=None, end=None, artifact="artifact:a"):
    return (f"{n:016x}", artifact, s, p, o, at, start, end, 0.9, "llm", "x" * 300)


def test_store(spark):
    g = GraphStore(spark, shared_dir(spark, "graph"))
    assert g.read("claims") is None and g.remove("claims", F.lit(True)) == 0
    assert g.load_artifacts(spark.createDataFrame([("artifact:a", "s", "t", None, "2024-05-05", "four"), ("artifact:a", "s", "t", None, "2024-05-05", "four"), (None, "s", "t", None, None, None)], ART)) == 1
    names = spark.createDataFrame([("Ann", "person:ann", "Person"), ("Bo", "person:bo", "Person"), ("Acme", "account:acme", "Account"), ("Zeta", "account:zeta", "Account")], "mention string, entity string, label string")
    rows = [claim(1, "Ann", "OWNS", "Acme", None), claim(2, "Bo", "OWNS", "Acme", start="2024-02-01"), claim(3, "Ann", "LEADS", "Zeta", end="2024-03-01"), claim(4, "Ann", "BLOCKS", "Zeta"), claim(5, "Nobody", "OWNS", "Zeta"), claim(6, "Ann", "OWNS", "Zeta", artifact="artifact:lost")]
    claims = spark.createDataFrame(rows + rows[:1], CLAIM)
    assert g.load_claims(claims, names) == {"PASS": 4, "UNSUPPORTED_ENTITY_PAIR": 1, "INVALID_SUBJECT": 1, "MISSING_ARTIFACT": 1, "stored": 3}
    assert g.load_claims(claims.limit(0), names) == {"stored": 3}
    got = {r.claim_id[-1]: (str(r.observed_at), str(r.valid_from), str(r.valid_to), len(r.evidence_span)) for r in g.read("claims").collect()}
    assert got == {"1": ("2024-05-05", "2024-05-05", "9999-12-31", 200), "2": ("2024-01-01", "2024-02-01", "9999-12-31", 200), "3": ("2024-01-01", "0001-01-01", "2024-03-01", 200)}
    g.load_claims(spark.createDataFrame([claim(2, "Bo", "OWNS", "Acme", start="2024-04-01")], CLAIM), names)  # the later load of an id stands
    assert [str(r.valid_from) for r in g.claim(f"{2:016x}").collect()] == ["2024-04-01"] and g.read("claims").count() == 3
    assert g.edges().where("rel = 'ABOUT'").count() == 3 and g.history("person:bo", "OWNS", "account:acme").count() == 1
    with pytest.raises(ValueError):
        g.history("a", "OWNS) DETACH", "b")
    assert g.execute("SELECT count(*) AS n FROM {claims} WHERE subject_id = :s", s="person:ann").first().n == 2
    entities = spark.createDataFrame([("person:ann", "Ann", "Person", ["Ann"], []), ("person:new", "New", "Person", [], [])], "entity_key string, name string, label string, mentions array<string>, aliases array<string>")
    assert g.load_entities(entities) == 2 and g.load_entities(entities.limit(1)) == 2
    assert {r.entity_key: (r.outgoing, r.incoming) for r in g.neighbourhood().collect()} == {"person:ann": (2, 0), "person:new": (0, 0)}
    assert g.numbered("claims", 2**48, 2**49 - 1).count() == 3 and g.numbered("claims", 0, 2**48 - 1).count() == 0
    assert g.wipe(["account:zeta"]) == 1 and g.read("claims").count() == 2 and g.reset(0, 2**60) == 2 and g.read("claims").count() == 0


def test_worker_repeats_change_nothing(spark):
    person = "struct<user_id:string,display_name:string,username:string,email:string>"
    schema = f"id string, source string, type string, title string, author string, timestamp string, content string, metadata struct<author_display_name:string,participants:array<{person}>>"
    rows = [(f"dsid_{i:032x}", "slack", "t", "Title", "Ann Lee", "2024-01-02T00:00:00", f"Ann Lee owns Acme{i % 2}. Ann Lee leads Acme{i % 2}", ("Ann Lee", [])) for i in range(4)]
    label = F.when(F.col("mention") == "Ann Lee", "Person").when(F.col("mention").startswith("Acme"), "Account")
    g, at = GraphStore(spark, shared_dir(spark, "worked")), shared_dir(spark, "worker")
    done = worker.work(G.replay(spark.createDataFrame(rows + rows[:2], schema), 2, "id"), g, label, at)
    assert sum(d["new"] for d in done) == 4 and g.read("artifacts").count() == 4
    first = sorted(tuple(r) for r in g.read("claims").select("claim_id", "subject_id", "predicate", "object_id", "observed_at").collect())
    assert len(first) == 8 and {r[1] for r in first} == {"person:ann-lee"}
    assert worker.step(spark.createDataFrame(rows, schema), g, label) == {"new": 0}
    g2 = GraphStore(spark, shared_dir(spark, "at-once"))
    worker.step(spark.createDataFrame(rows, schema), g2, label)
    assert sorted(tuple(r) for r in g2.read("claims").select("claim_id", "subject_id", "predicate", "object_id", "observed_at").collect()) == first


def test_scores(spark):
    gold = spark.createDataFrame([("a", "VALID", "1"), ("a", "VALID", "2"), ("b", "AMBIGUOUS", "3"), ("d", "VALID", "5")], "artifact_id string, status string, item string")
    arts = spark.createDataFrame([(x,) for x in "abcde"], "artifact_id string")
    exp = E.expectation(arts, gold, spark.createDataFrame([("d", "AMBIGUOUS"), ("e", "AMBIGUOUS")], "artifact_id string, status string"))
    assert {r.artifact_id: r.expected for r in exp.collect()} == {"a": "VALID", "b": "AMBIGUOUS", "c": "NO_CLAIM", "d": "VALID", "e": "AMBIGUOUS"}
    pred = spark.createDataFrame([("a", "1"), ("a", "9"), ("b", "3"), ("c", "7"), ("c", "7")], "artifact_id string, item string")
    s = E.abstention_scores(pred, gold, exp).first()
    assert (s.tp, s.fp, s.fn, s.tn, s.ambiguous, s.precision, s.recall) == (1, 2, 2, 0, 2, 0.3333, 0.3333)
    assert E.strict_scores(pred, gold).first().fp == 1
    empty = E.abstention_scores(pred.limit(0), gold.limit(0), exp.limit(0)).first()
    assert (empty.tp, empty.f1) == (0, 0.0)
    rows = [("yes", "yes", True), ("it is ACME or so", "zzz|acme", True), ("Same", "the same", True), ("", "x", False), (None, "x", False), ("abstain", "must abstain", True), ("2024-01-02 x", "2024-01-02T00", True), ("different", "same", False)]
    df = spark.createDataFrame(rows, "got string, want string, ok boolean")
    assert [r[0] for r in df.select(E.tolerant_match(F.col("got"), F.col("want"))).collect()] == [r[2] for r in rows]


def test_answering_systems(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma\nmore"), (2, "delta epsilon"), (3, ""), (4, "alpha delta zeta " * 3000)], "doc_id long, body string")
    q = spark.createDataFrame([("q1", "beta gamma"), ("q2", "epsilon"), ("q3", "nothing here"), ("q4", "")], "question_id string, question string")
    got = {r.question_id: r for r in rag.run("bm25", docs, q).collect()}
    assert got["q1"].answer == "mock: alpha beta gamma" and got["q1"].doc_ids[0] == 1 and got["q3"].answer == "unknown" and len(got) == 4
    for system in ("dense", "hybrid"):
        best = {r.question_id: r.doc_id for r in rag.search(system, docs, q, 3).where("rank = 1").collect()}
        assert best["q1"] == 1 and best["q2"] == 2
    assert {r.question_id for r in rag.run("bm25", docs, q, q.limit(2)).collect()} == {"q3", "q4"}
    long = {r.question_id: r for r in rag.run("bm25", docs, q.where("question_id = 'q1'"), budget=30).collect()}
    assert long["q1"].doc_ids == [1]
    with pytest.raises(ValueError):
        rag.search("other", docs, q, 3)


def test_methods_of_extraction(spark):
    from factweave.operators import extract as X

    arts = spark.createDataFrame([("a", None, "Ann Lee owns Acme."), ("b", " Ticket one ", "This depends on ledger-sync, and blocks ENG-12. Assigned to Bo Ray"), ("c", "t", "nothing"), ("d", "t", None)], "id string, title string, content string")
    found = {(r.artifact_id, r.subject_mention, r.predicate, r.object_mention): r.confidence for r in X.claims(arts).collect()}
    assert found == {("a", "Ann Lee", "OWNS", "Acme"): 0.88, ("b", "Ticket one", "DEPENDS_ON", "ledger-sync"): 0.81, ("b", "Ticket one", "BLOCKS", "ENG-12"): 0.84, ("b", "Bo Ray", "ASSIGNED_TO", "Ticket one"): 0.8}
    offers = spark.createDataFrame([("a", "Ann Lee", "OWNS", "Acme", 0.9, "x"), ("a", "Bo", "OWNS", "Acme", 0.9, "x"), ("a", "Bob", "OWNS", "Acme", 0.9, "x"), ("c", "Cyd", "LEADS", "Zeta", 0.9, "x"), ("c", "Cyd", "LEADS", "Eta", 0.5, "x")], "artifact_id string, subject_mention string, predicate string, object_mention string, confidence double, evidence_span string")
    how = lambda *a: sorted((r.artifact_id, r.subject_mention, r.extraction_method) for r in X.extracted(arts.where("id <> 'b'"), *a).collect())
    assert how("hybrid", offers) == [("a", "Ann Lee", "deterministic"), ("a", "Bob", "hybrid"), ("c", "Cyd", "hybrid")] and how("hybrid", offers, False) == [("a", "Ann Lee", "deterministic"), ("c", "Cyd", "hybrid")]
    assert how("llm", offers) == [("a", "Ann Lee", "llm"), ("a", "Bob", "llm"), ("c", "Cyd", "llm")] and how("deterministic", offers) == [("a", "Ann Lee", "deterministic")] and how("llm") == []
    with pytest.raises(ValueError):
        X.extracted(arts, "guess")


def test_lexicon_of_long_phrases(spark):
    from factweave.operators import extract as X

    long = " ".join(f"w{i}" for i in range(30))
    texts = spark.createDataFrame([("1", f"x {long} y. Acme-Corp, acme corp"), ("2", long[:-1]), ("3", "ACME corps"), ("4", None)], "artifact_id string, content string")
    lex = spark.createDataFrame([("e1", long), ("e2", "Acme Corp"), ("e3", "!!"), ("e2", "acme")], "entity string, phrase string")
    got = {(r.artifact_id, r.entity, r.phrase[:4], r.word_at) for r in X.lexicon_matches(texts, lex).collect()}
    assert got == {("1", "e1", "w0 w", 2), ("1", "e2", "Acme", 33), ("1", "e2", "acme", 33), ("3", "e2", "acme", 1)}
    assert X.lexicon_matches(texts, lex.limit(0)).count() == 0


def test_structured_answers_come_first(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "doc_id long, body string")
    q = spark.createDataFrame([("q1", "alpha"), ("q2", "gamma"), ("q3", "alpha")], "question_id string, question string")
    known = spark.createDataFrame([("q1", "found", "Ann"), ("q2", "absent", "unknown"), ("q3", "conflict", "conflict")], "question_id string, status string, answer string")
    got = {r.question_id: (r.answer, r.from_graph) for r in rag.structured(docs, q, known).collect()}
    assert got == {"q1": ("Ann", True), "q2": ("mock: gamma", False), "q3": ("mock: alpha beta", False)}


def test_poll_goes_on_until_it_is_stopped(spark):
    import time

    at, seen = shared_dir(spark, "polled"), []
    spark.createDataFrame([(1,)], "x int").write.parquet(f"{at}/in")
    query = G.polled(spark.readStream.schema("x int").parquet(f"{at}/in"), lambda batch, no: seen.extend(r.x for r in batch.collect()), f"{at}/state", "1 second")
    spark.createDataFrame([(2,)], "x int").write.mode("append").parquet(f"{at}/in")
    end = time.time() + 60
    while len(seen) < 2 and time.time() < end:
        time.sleep(0.3)
    query.stop()
    assert sorted(seen) == [1, 2]


def test_asking_a_store(spark):
    from factweave.plans import formatting, service

    g = GraphStore(spark, shared_dir(spark, "asked"))
    assert service.health(g) == {"artifacts": 0, "entities": 0, "claims": 0}
    g.load_artifacts(spark.createDataFrame([("artifact:a", "Slack", "t", None, "2024-05-05", "x")], ART))
    g.load_entities(spark.createDataFrame([("person:ann", "Ann Lee", "Person", ["Ann"], []), ("account:acme", "Acme", "Account", ["Acme"], ["ACME Inc"])], "entity_key string, name string, label string, mentions array<string>, aliases array<string>"))
    names = spark.createDataFrame([("Ann", "person:ann", "Person"), ("Acme", "account:acme", "Account")], "mention string, entity string, label string")
    g.load_claims(spark.createDataFrame([claim(1, "Ann", "OWNS", "Acme")], CLAIM), names)
    q = spark.createDataFrame([("1", "Who owns Acme now?"), ("2", "Which source shows who owns 'ACME Inc' and 'x'?"), ("3", "Who owns Zeta?")], "question_id string, question string")
    found = service.ask(g, q)
    got = {r.question_id: (r.status, r.answer) for r in found.collect()}
    assert got == {"1": ("found", "Ann Lee"), "2": ("found", "slack"), "3": ("absent", "unknown")}
    import json

    e = {r.question_id: json.loads(r.envelope) for r in formatting.envelope(found).collect()}
    assert all(list(x) == formatting.ENVELOPE for x in e.values()) and e["1"]["value"] == {"entity_id": "person:ann", "name": "Ann Lee"} and e["3"]["value"] is None and e["3"]["history"] == []
    rows = [("provenance", "found", "x", 2, ["a", "b"], "2 claim(s) from a, b"), ("provenance", "found", "x", 0, None, "0 claim(s) from no source"), ("state", "found", "Ann", 1, None, "Ann"), ("state", "absent", "", 0, None, "abstain"), ("state", "conflict", "", 0, None, "conflict")]
    df = spark.createDataFrame(rows, "c string, s string, a string, n int, src array<string>, want string")
    assert [r[0] for r in df.select(formatting.benchmark_answer(F.col("c"), F.col("s"), F.col("a"), F.col("n"), F.col("src"))).collect()] == [r[5] for r in rows]
    b = spark.createDataFrame([("1", "found", "Ann", 0.96, ["slack"], ["Ann", "Bo", "Cy"]), ("2", "absent", "unknown", None, None, None)], "question_id string, status string, answer string, confidence double, sources array<string>, owners array<string>")
    made = {r.question_id: [x["text"]["text"] for x in json.loads(r.blocks)] for r in formatting.blocks(b).collect()}
    assert made == {"1": ["Ann (High confidence)", "Sources: slack", "Previously: Bo, Cy"], "2": ["Nothing is known about this."]}
    assert formatting.checklist(found.where("question_id = '3'")).first().checklist == "[x] route\n[ ] entity\n[ ] state\n[ ] answer"
