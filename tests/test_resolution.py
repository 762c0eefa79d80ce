"""Entities and pairs against plain Python."""

import random

from factweave.operators import resolution as R


def ratio(a, b):
    x, y = (" ".join(sorted(t.split())) for t in (a, b))
    row = [0] * (len(y) + 1)
    for c in x:
        new = [0]
        for j, d in enumerate(y, 1):
            new.append(row[j - 1] + 1 if c == d else max(row[j], new[-1]))
        row = new
    return 200.0 * row[-1] / (len(x) + len(y)) if x or y else 100.0


def test_fuzzy_pairs_lose_nothing(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    texts = set(words) | {" ".join(rng.sample(words, rng.randrange(1, 5))) for _ in range(80)} | {"ab  cd ", " ab cd", "ab cd", "a\tb cd e", "e cd b a"}
    for t in sorted(texts, key=R.hash_text)[:140]:
        i = rng.randrange(len(t))
        texts |= {t[:i] + t[i + 1 :], t[:i] + rng.choice("abcd") + t[i:], " ".join(reversed(t.split()))}
    texts = sorted(x for x in texts if x.strip())
    df = spark.createDataFrame([("p", t, "e") for t in texts + texts[:9]] + [("q", texts[0], "e"), ("p", None, "e"), ("p", "", "e")], "type string, norm string, a string")
    got = {(r.a, r.b): r.ratio for r in R.fuzzy_pairs(df).collect()}
    want = {(a, b): ratio(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :] if ratio(a, b) >= 85}
    assert got.keys() == want.keys() and len(got) > 50
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_names_and_keys(spark):
    rows = [('"Ann Lee" <Ann.Lee@x.test>', "Ann Lee"), ("<a@x.test>", "a@x.test"), ("  Ann ", "Ann"), ("", ""), (None, "")]
    df = spark.createDataFrame(rows, "raw string, want string")
    assert [r[0] for r in df.select(R.person_name(df.raw)).collect()] == [w for _, w in rows]
    keys = spark.createDataFrame([("Ann", "A.Lee+x@x.test", "@al"), ("Ann", None, "@a_l"), ("Ann Lée", "", ""), (None, None, None)], "m string, e string, u string")
    assert [r[0] for r in keys.select(R.person_key(keys.m, keys.e, keys.u)).collect()] == ["person:a-lee-x", "person:a-l", "person:ann-l-e", "person:unknown"]


def test_entities_meet_by_their_strongest_signal(spark):
    person = "struct<user_id:string,display_name:string,username:string,email:string>"
    df = spark.createDataFrame(
        [("slack", None, "hi @ann.lee and <@U1>", ("Ann Lee", [("U1", "Ann Lee", "ann.lee", None)])), ("gmail", "Ann Lee <ann.lee@x.test>", None, (None, [(None, "A. Lee <ann.lee@x.test>", None, "ann.lee@x.test")])), ("jira", None, None, (None, None)), (None, None, None, None)],
        f"source string, author string, content string, metadata struct<author_display_name:string,participants:array<{person}>>",
    )
    got = {r.entity_key: r for r in R.merged(R.candidates(df)).collect()}
    assert set(got) == {"person:ann-lee"}
    e = got["person:ann-lee"]
    assert e.name == "Ann Lee" and e.mentions == ["@ann.lee", "A. Lee", "Ann Lee"] and e.emails == ["ann.lee@x.test"] and e.sources == ["gmail", "slack"]
    known = R.lookup(R.resolutions(R.merged(R.candidates(df))))
    claims = spark.createDataFrame([("1", " ann.lee@x.test", "Ann  LEE"), ("2", "Ann Lee", "Nobody"), ("3", None, "")], "claim_id string, subject_mention string, object_mention string")
    assert [r.resolution_status for r in R.bridged(claims, known).orderBy("claim_id").collect()] == ["resolved", "review", "unresolved"]
    assert R.merged(R.candidates(df.limit(0))).count() == 0


def test_fuzzy_pairs_of_long_texts_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 5)
    monkeypatch.setattr(R, "AT_ONCE", 7)
    rng = random.Random(3)
    texts = set()
    for n in (1, 2, 20, 63, 64, 65, 70, 130):
        for _ in range(3):
            t = "".join(rng.choice("abcdeé日𝔸") for _ in range(n))
            texts |= {t, t + "x", t[1:], t[: n // 2] + "yz" + t[n // 2 :], t[::-1], t[: n - n // 9] + "q" * (n // 9)}
    texts = sorted(texts - {""})
    df = spark.createDataFrame([("p", t) for t in texts] + [(None, texts[0]), (None, texts[1]), ("p", " "), ("q", texts[5])], "type string, norm string")
    got = {(r.a, r.b): r.ratio for r in R.fuzzy_pairs(df).collect()}
    want = {(a, b): ratio(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :] if ratio(a, b) >= 85}
    assert got.keys() == want.keys() and len(got) > 40 and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_fuzzy_pairs_with_nothing_in_common_are_not_compared(spark, monkeypatch):
    """People of few first names and departments, who share most pieces but are not alike."""
    rng = random.Random(4)
    name = lambda: "".join(rng.choice("bcdfgklmnprstvz") + rng.choice("aeiou") for _ in range(5))
    texts = {f"{rng.choice(['anna', 'emil', 'rosa'])} {name()} ({rng.choice(['legal', 'sales'])})" for _ in range(4000)}
    compared = spark.sparkContext.accumulator(0)
    whole = R._common

    def counted(x, y):
        compared.add(len(x))
        return whole(x, y)

    monkeypatch.setattr(R, "_common", counted)
    left = spark.createDataFrame([("p", t) for t in texts], "type string, norm string").toPandas()
    signed = next(R._signed(iter([left])))
    sizes = sorted(set(signed["n"]))
    for i, la in enumerate(sizes):
        for lb in sizes[i:]:
            list(R._alike(85, la == lb, la, lb, signed[signed["n"] == la], signed[signed["n"] == lb]))
    assert 0 < compared.value < len(texts) ** 2 / 200


def test_hard_pairs_of_groups_of_any_size(spark):
    rng = random.Random(5)
    parts = ["ann", "bo", "eng-1", "(eng-1)", "x", "ops-22", "lee", "team"]
    rows = [("person", " ".join(rng.sample(parts, rng.randrange(1, 4)) + [f"n{i % 90}"])) for i in range(260)]
    rows += [(rng.choice(["email", "person", None]), f"{rng.choice(['sales', 'help'])}@{i}.test") for i in range(60)] + [("ticket", t) for t in ("eng-1", "eng-1 b", "ops-22", "eng-1 c")]
    tickets = lambda n: [t for t in ("eng-1", "ops-22") if t in n]
    full = [(n, t, tickets(n) + ([None] if n[0] == "a" else []), n.startswith("sales") or n[-1] == "7") for t, n in rows + rows[:5]] + [("", "person", [], True), (None, "person", None, None), ("bo", "person", None, None)]
    df = spark.createDataFrame(full, "norm string, type string, tickets array<string>, role boolean")
    slot = {r.norm: r.s for r in df.selectExpr("norm", "pmod(xxhash64(norm), 64) as s").distinct().collect()}
    known = {}
    for n, t, k, r in full:
        if n:
            x = known.setdefault(n, [False, False, set()])
            known[n] = [x[0] or bool(r), x[1] or t == "person", x[2] | {y for y in k or [] if y}]
    words = {n: {w for w in n.split() if len(w) > 1} for n in known}
    every = {}
    for a in sorted(known):
        for b in sorted(known):
            (ra, pa, ta), (rb, pb, tb) = known[a], known[b]
            if a < b:
                how = "role-mailbox" if slot[a] == slot[b] and (ra and pb or rb and pa) else "shared-word" if pa and pb and words[a] & words[b] else "ticket" if ta & tb else None
                every.setdefault((a, how), []).append(b)
    for most in (1, 3):
        want = {(a, b, how) for (a, how), bs in every.items() if how for b in bs[:most]}
        assert {tuple(r) for r in R.hard_pairs(df, most).collect()} == want
    assert {h for _, _, h in want} == {"role-mailbox", "shared-word", "ticket"} and R.hard_pairs(df.limit(0)).count() == 0


def test_hard_pairs_do_not_meet_all_that_share_a_word(spark):
    df = spark.range(60_000).selectExpr("concat('ann n', id) as norm", "'person' as type", "cast(null as array<string>) as tickets", "false as role")
    got = R.hard_pairs(df)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.groupBy("how").count().collect() == [("shared-word", 3 * 60_000 - 6)]
