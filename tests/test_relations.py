"""Hand-overs, effective dates and families of signals."""

from datetime import date as D

from factweave.operators import relations as L


def test_effective_dates(spark):
    rows = [
        ("Acme", D(2026, 7, 20), "from July 28"), ("Acme", D(2026, 1, 2), "from July 28"), ("Other", D(2026, 1, 2), "from July 28"), ("Acme", D(2026, 1, 2), "effective July 28th, 2024 until August 2"), ("Acme", D(2026, 12, 30), "from January 2"),
        ("Acme", D(2025, 3, 1), "starting February 29"), (None, None, "from July 28"), ("Acme", D(2026, 7, 20), None), ("Acme", None, "from July 28"),
    ]
    df = spark.createDataFrame(rows, "account string, observed date, content string")
    known = spark.createDataFrame([("acme", 2023)], "account string, year int")
    got = [(r.effective, r.until) for r in L.effective_dates(df, known).collect()]
    want = [(D(2026, 7, 28), None), (D(2023, 7, 28), None), (None, None), (D(2024, 7, 28), D(2023, 8, 2)), (D(2023, 1, 2), None), (None, None), (None, None), (None, None), (D(2023, 7, 28), None)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_handoffs(spark):
    rows = [
        ("1", "Ann", D(2026, 7, 20), "I am taking over Acme ownership from July 28"), ("2", "Bo", D(2026, 7, 20), "handing off Acme account effective July 28"), ("3", "Cy", D(2026, 7, 20), "We still own Zeta until August 1"),
        ("4", None, D(2026, 7, 20), "taking over Acme; Dee Fox owns Borealis from July 21. a.b@x.test owns Kappa"), ("5", "Ann", D(2026, 7, 20), "Acme transfers from Ann Lee to Bo Ray effective July 30"), ("6", "Ann", None, None),
    ]
    got = {(r.artifact_id, r.subject_mention, r.object_mention): (r.valid_from, r.valid_to) for r in L.handoff_claims(spark.createDataFrame(rows, "id string, author string, observed date, content string")).collect()}
    assert got == {
        ("1", "Ann", "Acme"): (D(2026, 7, 28), None), ("2", "Bo", "Acme"): (None, D(2026, 7, 28)), ("3", "Cy", "Zeta"): (None, D(2026, 8, 1)), ("4", "Dee Fox", "Borealis"): (D(2026, 7, 21), None),
        ("4", "a.b", "Kappa"): (D(2026, 7, 21), None), ("5", "Ann Lee", "Acme"): (None, D(2026, 7, 30)), ("5", "Bo Ray", "Acme"): (D(2026, 7, 30), None),
    }


def test_families(spark):
    texts = {
        "owner": ("hubspot", "Owner: Ann Lee - renew\nAnn Lee (Security SE)"), "assigned": ("jira", "Assigned to: Bo Ray"), "verb": ("slack", "Bo Ray is now responsible for the Acme account. Ann Lee leads Acme"), "role": ("gmail", "With Ann Lee (CSM) and Bo Ray (AE)"),
        "mail": ("gmail", "From: Ann Lee <ann@own.test>\nTo: Zed <z@acme-corp.test>\n\nhi"), "chat": ("slack", "ann_csm: we talk"), "nobody": ("slack", "Acme only"),
    }
    people = [("person:ann", "Person", "Ann Lee"), ("person:ann", "Person", "ann_csm"), ("person:bo", "Person", "Bo Ray")]
    df = spark.createDataFrame([(k, s, t, "e") for k, (s, t) in texts.items()] + [("null", "slack", None, "e")], "id string, source string, content string, entity_key string")
    c = spark.createDataFrame([(k, *p) for k in [*texts, "null"] for p in (people if k != "nobody" else []) + [("account:acme", "Account", "Acme Corp" if k == "mail" else "Acme")]], "artifact_id string, entity_key string, label string, mention string")
    got = {(r.artifact_id, r.subject_key[7:], r.predicate): r.signal for r in L.relations(df, c, ["own.test"]).collect()}
    assert got == {
        ("owner", "ann", "ASSIGNED_TO"): "owner-line", ("assigned", "bo", "ASSIGNED_TO"): "assigned-line", ("verb", "bo", "OWNS"): "verb:OWNS", ("verb", "ann", "LEADS"): "verb:LEADS", ("role", "ann", "OWNS"): "attendee-role", ("role", "bo", "LEADS"): "attendee-role",
        ("mail", "ann", "OWNS"): "email-thread", ("chat", "ann", "OWNS"): "chat-role",
    }
    assert L.role_predicate("Security", L.OWNER_ROLES) == "OWNS" and L.role_predicate("SE", L.OWNER_ROLES) == "ASSIGNED_TO"
    found = L.relations(df, c, ["own.test"])
    offers = spark.createDataFrame([("mail", "person:ann", "account:acme", "leads", 0.9), ("chat", "person:ann", "account:acme", "BLOCKS", 0.9), ("verb", "person:ann", "account:acme", "OWNS", 0.9)], "artifact_id string, subject_key string, object_key string, predicate string, confidence double")
    after = {(r.artifact_id, r.subject_key[7:]): r.predicate for r in L.refine(found, offers).where("artifact_id in ('mail', 'chat', 'verb')").collect()}
    assert after == {("mail", "ann"): "LEADS", ("chat", "ann"): "OWNS", ("verb", "ann"): "LEADS", ("verb", "bo"): "OWNS"}
    funnel = L.coverage(df, c, found).first()
    assert (funnel.artifacts, funnel.with_candidates, funnel.with_pair, funnel.relations) == (8, 8, 7, 8)
