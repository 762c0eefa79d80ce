"""State, identity, retrieval and question operators on small tables."""

import math
from datetime import date

from pyspark.sql import functions as F

from factweave.operators import contract as K
from factweave.operators import identity as I
from factweave.operators import inventory as V
from factweave.operators import questions as Q
from factweave.operators import retrieval as R
from factweave.operators import state as S

D = date
CLAIM = "claim_id string, subject_id string, predicate string, object_id string, observed_at date, valid_from date, valid_to date"
END = D(9999, 12, 31)


def log(spark, rows):
    return spark.createDataFrame(rows, CLAIM)


def test_succession_and_the_day_of_change(spark):
    c = log(spark, [("1", "arjun", "OWNS", "acme", D(2026, 7, 1), D(2026, 7, 1), D(2026, 7, 28)), ("2", "sarah", "OWNS", "acme", D(2026, 7, 28), D(2026, 7, 28), END)])
    one = lambda df: df.first().subject_id
    assert one(S.current(c)) == "sarah" and one(S.as_of(c, "2026-07-15")) == "arjun" and one(S.as_of(c, "2026-07-28")) == "sarah"
    assert one(S.before(c, "2026-07-28")) == "arjun" and one(S.previous(c)) == "arjun" and one(S.after_event(c)) == "sarah"
    assert S.conflict_state(c).first().state == "succession" and S.conflicts(c).first().status == "conflict"
    assert S.as_of(c, "2020-01-01").count() == 0 and S.current(c.limit(0)).count() == 0


def test_conflict_kinds(spark):
    o = lambda i, s, obj, day, a, b: (i, s, "OWNS", obj, day, a, b)
    c = log(spark, [
        o("1", "a", "one", D(2026, 1, 1), D(2026, 1, 1), END), o("2", "a", "one", D(2026, 1, 1), D(2026, 1, 1), END),
        o("3", "a", "later", D(2026, 1, 1), D(2026, 1, 1), END), o("4", "b", "later", D(2026, 1, 2), D(2026, 1, 2), END),
        o("5", "a", "same", D(2026, 1, 1), D(2026, 1, 1), END), o("6", "b", "same", D(2026, 1, 1), D(2026, 1, 1), END), o("7", "a", "none", None, D(2026, 1, 1), END), o("8", "b", "none", None, D(2026, 1, 1), END),
        o("9", "a", "void", None, None, END), o("10", "b", "void", None, None, END),
    ])
    assert {r.object_id: r.state for r in S.conflict_state(c).collect()} == {"one": "definitive", "later": "superseded", "same": "conflict", "none": "conflict", "void": "succession"}  # a start is a time as well; unknown starts overlap nothing


def test_contract(spark):
    row = ("0123456789abcdef", "dsid_" + "0" * 32, "Ann", "OWNS", "Acme", "2024-01-01", "2024-02-01", "2024-01-01", 1.5, "magic", None, None)
    df = spark.createDataFrame([row, (None,) * 12], "claim_id string, artifact_id string, subject_mention string, predicate string, object_mention string, observed_at string, valid_from string, valid_to string, confidence double, extraction_method string, evidence_span string, metadata map<string,string>")
    got = [r.problems for r in K.problems(df, K.claim_rules()).collect()]
    assert got == [["period", "confidence", "evidence_span"], ["claim_id", "artifact_id", "subject_mention", "predicate", "object_mention", "confidence", "extraction_method", "evidence_span"]]


def test_gate_takes_the_first_code(spark):
    good = {"claim_id": "0123456789abcdef", "artifact_id": "artifact:a", "subject_mention": " Ann ", "predicate": "OWNS", "object_mention": "Acme", "observed_at": "2024-01-01", "valid_from": None, "valid_to": None, "confidence": 0.9, "extraction_method": "llm", "evidence_span": "x"}
    cases = [
        ({}, "PASS"), ({"claim_id": None, "subject_mention": ""}, "MALFORMED_ID"), ({"subject_mention": " ", "object_mention": ""}, "INVALID_SUBJECT"), ({"object_mention": None, "predicate": "x"}, "INVALID_OBJECT"),
        ({"predicate": "owns", "observed_at": "soon"}, "INVALID_PREDICATE"), ({"observed_at": "2024-02-30", "artifact_id": "artifact:lost"}, "INVALID_TIMESTAMP"), ({"valid_from": "2024-02-02", "valid_to": "2024-02-01T00:00:00Z"}, "INVALID_TIMESTAMP"),
        ({"observed_at": None, "artifact_id": "artifact:lost"}, "MISSING_TIMESTAMP"), ({"observed_at": None}, "PASS"), ({"observed_at": None, "artifact_id": "artifact:untimed"}, "MISSING_TIMESTAMP"), ({"artifact_id": "artifact:lost", "subject_mention": "Nobody"}, "MISSING_ARTIFACT"),
        ({"subject_mention": "Nobody"}, "INVALID_SUBJECT"), ({"object_mention": "Twofold"}, "INVALID_OBJECT"), ({"predicate": "BLOCKS"}, "UNSUPPORTED_ENTITY_PAIR"), ({"confidence": 2.0}, "CONTRACT_VIOLATION"), ({"confidence": 2.0, "predicate": "BLOCKS"}, "UNSUPPORTED_ENTITY_PAIR"),
        ({"observed_at": "2024-01-01T24:00:00"}, "INVALID_TIMESTAMP"),
    ]
    schema = "claim_id string, artifact_id string, subject_mention string, predicate string, object_mention string, observed_at string, valid_from string, valid_to string, confidence double, extraction_method string, evidence_span string"
    df = spark.createDataFrame([tuple((good | c).values()) + (i, "e") for i, (c, _) in enumerate(cases)], f"{schema}, n int, mention string")
    names = spark.createDataFrame([("Ann", "person:ann", "Person"), ("Acme", "account:acme", "Account"), ("Acme", "account:acme", "Account"), ("Twofold", "account:a", "Account"), ("Twofold", "account:b", "Account")], "mention string, entity string, label string")
    there = spark.createDataFrame([("artifact:a", "2024-01-01"), ("artifact:a", None), ("artifact:untimed", None)], "id string, time string")
    got = {r.n: r for r in K.gate(df, names, there).collect()}
    assert [got[i].status for i in range(len(cases))] == [c for _, c in cases] and got[0].mention == "e"
    assert (got[0].subject_id, got[0].object_id, got[0].timestamp_source, got[8].timestamp_source) == ("person:ann", "account:acme", "claim", "artifact")
    assert K.gate(df.limit(0), names, there).count() == 0
    good_rows, bad = K.loaded(df.where("n < 2"), K.claim_rules(), "claim_id")
    assert good_rows.count() == 1 and [r.reason for r in bad.collect()] == ["claim_id,subject_mention"]
    assert {r.reason for r in K.loaded(df.where("n in (0, 11)"), K.claim_rules(), "claim_id")[1].collect()} == {"duplicate"}


SIDE = "struct<mention:string,type:string,emails:array<string>,external_ids:array<string>>"


def test_decisions(spark):
    p = lambda m, e=None, t="person", x=None: (m, t, e, x)
    rows = [
        (p("Ann Lee", ["ann.lee@x.test"]), p("A. Lee", ["Ann.Lee@x.test"]), "MERGE"), (p("Ann Lee", ["ann.lee@x.test"]), p("Ann Lee", ["ann.lee@y.test"]), "REVIEW"),
        (p("Maya Chen"), p("Maya Patel"), "KEEP_SEPARATE"), (p("Maya Chen"), p("Sarah Chen"), "KEEP_SEPARATE"), (p("S. Lee"), p("Soham Lee"), "REVIEW"),
        (p("Ann", ["support@x.test"]), p("Ann", ["ann@y.test"]), "KEEP_SEPARATE"), (p("Ann", None, "person", ["crm:1"]), p("Bob", None, "person", ["CRM:1", "mention:0"]), "MERGE"),
        (p("ann-dev", None, "username"), p("x", ["ann@x.test"]), "MERGE"), (p(None), p(None), "ABSTAIN"), (None, None, "ABSTAIN"),
    ]
    df = spark.createDataFrame([(str(i), a, b) for i, (a, b, _) in enumerate(rows)], f"pair_id string, a {SIDE}, b {SIDE}")
    got = {int(r.pair_id): r.decision for r in I.decided(df).collect()}
    assert [got[i] for i in range(len(rows))] == [r[2] for r in rows]


def test_anchored_clusters(spark):
    e = lambda rows: spark.createDataFrame(rows, "u string, v string")
    nodes = spark.createDataFrame([(x,) for x in "abcdefgh"], "node string")
    anchors = spark.createDataFrame([("b",)], "node string")
    got = {r.node: r.cluster for r in I.clusters(nodes, e([("a", "b"), ("e", "f")]), e([("b", "c"), ("c", "d"), ("f", "g")]), anchors).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "e", "g": "g", "h": "h"}


def test_both_ways_of_bm25_agree_with_the_formula(spark):
    texts = ["the cat sat", "the dog sat on the cat", "the birds", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "d long, t string")
    asked = spark.createDataFrame([("q1", "cat cat the"), ("q2", "zebra"), ("q3", None)], "question_id string, question string")
    index = R.postings(docs, "d", "t")
    df, whole = R.statistics(index, docs, "d", "t")
    joined = {(r.question_id, r.d): r.score for r in R.bm25(index, df, whole, asked, "d").collect()}
    words = [(t or "").split() for t in texts]
    n, avg = len(words), sum(map(len, words)) / len(words)
    dfs = {w: sum(w in x for x in words) for x in words for w in x}
    idf = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w, k in dfs.items()}
    mean = sum(idf.values()) / len(idf)
    want = {}
    for i, x in enumerate(words):
        s = [idf[w] if idf[w] >= 0 else 0.25 * mean for w in ("cat", "cat", "the") if w in x]
        if s:
            want["q1", i] = sum((idf[w] if idf[w] >= 0 else 0.25 * mean) * x.count(w) * 2.5 / (x.count(w) + 1.5 * (0.25 + 0.75 * len(x) / avg)) for w in ("cat", "cat", "the") if w in x) * 1e6
    assert joined.keys() == want.keys() and all(abs(joined[k] - want[k]) < 3 for k in want)
    ranked = {(r.question_id, r.d): r.score for r in R.bm25_top(docs, "d", "t", asked, 5).collect()}
    assert ranked == joined
    assert R.bm25_top(docs.limit(0), "d", "t", asked, 5).count() == 0


def test_questions(spark):
    df = spark.createDataFrame([("Who owns Acme as of 2026-07-15?",), ("Who actually owns 'Acme' and 'Bolt'?",), ("Is Ann Lee the same person as Bob Ray?",), (None,)], "q string")
    got = [(r.intent, r.mentions, r.predicates, r.times) for r in Q.decomposed(df, "q").collect()]
    assert got[0] == ("OWNERSHIP", ["Acme"], ["OWNS"], ["as_of=2026-07-15"])
    assert got[1][:2] == ("CONFLICT", ["Acme", "Bolt"]) and got[2][:2] == ("ENTITY_RESOLUTION", ["Is Ann", "Lee"]) or got[2][0] == "ENTITY_RESOLUTION"
    assert got[3] == ("GENERIC", [], [], [])


def test_prf_without_anything(spark):
    none = spark.createDataFrame([], "item string")
    r = V.prf(none, none).first()
    assert (r.tp, r.precision, r.recall, r.f1) == (0, 0.0, 0.0, 0.0)
    some = none.unionByName(spark.createDataFrame([("a",), ("a",)], "item string"))
    assert V.prf(some, some.select(F.lit("b").alias("item"))).first().f1 == 0.0


def test_routes_do_not_answer_from_each_other(spark):
    from factweave.plans.answers import ClaimGraph

    c = log(spark, [("1", "person:1", "OWNS", "account:acme", D(2024, 1, 1), D(2024, 1, 1), D(2024, 6, 1)), ("2", "person:2", "OWNS", "account:acme", D(2024, 6, 1), D(2024, 6, 1), END)])
    names = spark.createDataFrame([("Acme", "account:acme"), ("Ann", "person:1"), ("Both", "a"), ("Both", "b")], "mention string, entity string")
    c = c.withColumn("subject_name", F.when(F.col("subject_id") == "person:1", "Ann Lee").otherwise("Bob Ray")).withColumn("artifact_id", F.lit("x"))
    chain = c.withColumns({"source_id": F.lit("s"), "source_name": F.when(F.col("claim_id") == "1", "Slack").otherwise("Gmail"), "kind": F.lit("k")})
    texts = spark.createDataFrame([(D(2024, 2, 1), "The big OUTAGE came"), (None, "outage"), (D(2024, 9, 1), None)], "day date, text string")
    asked = {
        "Who had ownership of Acme before 2024-03-01?": ("before", "found", "person:1"), "Who owned Acme before 2023-01-01?": ("before", "absent", None), "Who owned Acme during 2024-03-01?": ("interval", "found", "person:1"),
        "Who owned Acme after 2024-07-01?": ("after", "found", "person:2"), "Which source shows who owns Acme?": ("provenance", "found", "person:2"), "Does slack show who owns Acme?": ("source_presence", "found", None),
        "Does jira show who owns Acme?": ("source_presence", "absent", None), "Who else appears with Ann?": ("cooccurrence", "found", None), "Who owned Acme before Bob?": ("before", "found", "person:1"), "Who owned Acme after the handoff?": ("after", "found", "person:2"),
        "Who owned Acme before the outage?": ("before", "found", "person:1"), "Who owns Nothing now?": ("current", "absent", None), "Is 'Acme' the same as 'Ann'?": ("entity_pair", "found", None), "Who owns Both now?": ("current", "absent", None), "": ("current", "absent", None), None: ("current", "absent", None),
    }
    q = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "question_id int, question string")
    got = {r.question_id: r for r in ClaimGraph(c, names, chain).answer(q, texts).collect()}
    assert len(got) == len(asked)
    for i, (t, want) in enumerate(asked.items()):
        assert (got[i].route, got[i].status, got[i].subject_id) == want, (t, got[i])
    assert [got[i].answer for i in (5, 7, 12, 11)] == ["slack", "person:2", "different", "unknown"]
    assert got[0].confidence == 0.94 and got[11].confidence is None
