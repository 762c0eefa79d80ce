"""Problem 4: the exact metric join, reading names, and who is who."""

import random

import pytest

from factweave.llm import name_forms as N
from factweave.llm import names


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i]
        for j, y in enumerate(b, 1):
            nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (x != y)))
        row = nxt
    return row[-1]


def test_metric_join_is_exact(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9))) for _ in range(160)]
    words = sorted({*base, "x" * 300, "x" * 299, "é", "日本語"})
    other = words[::3]
    df = spark.createDataFrame([("l", w, 1) for w in words] + [("o", w, 1) for w in other], "kind string, s string, ring int")
    want = [(k, a, b) for k, ws in (("l", words), ("o", other)) for a in ws for b in ws if a < b and levenshtein(a, b) <= 2]
    for pivots in (1, 7, 512, None):
        assert sorted(tuple(r) for r in names.within(df, 2, pivots).collect()) == sorted(want)  # each pair once
    assert names.within(df.limit(0)).count() == 0


def test_one_slip_is_exact(spark):
    rng = random.Random(11)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 8))) for _ in range(150)} | {"é", "日本", "本日", "x" * 4000}
    for n in (names.LONG_WORD - 1, names.LONG_WORD, names.LONG_WORD + 1, names.LONG_WORD + 2, 90):
        w = "".join(rng.choice("abcd") for _ in range(n))
        for i in (0, 1, n // 2 - 2, n // 2 - 1, n // 2, n // 2 + 1, n - 2, n - 1):
            words |= {w, w[:i] + w[i + 1 :], w[:i] + "z" + w[i:], w[:i] + "y" + w[i + 1 :], w[:i] + w[i : i + 2][::-1] + w[i + 2 :]}
    words = sorted(words)
    near = [(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if abs(len(a) - len(b)) <= 1 and N.damerau(a, b) <= 1]
    df = spark.createDataFrame([("l", w) for w in words] + [("o", w) for w in words[::2]], "kind string, s string")
    want = [("l", *p) for p in near] + [("o", a, b) for a, b in near if a in words[::2] and b in words[::2]]
    assert sorted(tuple(r) for r in names.one_slip(df).collect()) == sorted(want) and len(near) > 200
    assert sum(len(k) for k in names.slip_keys("x" * 100_000)) < 400_000


def test_slips_need_no_distance_to_every_pivot(spark, monkeypatch):
    def never(*_):
        raise AssertionError("all words are held against the root of their number")

    monkeypatch.setattr(names, "within", never)
    df = spark.createDataFrame([("l", "abcdefgh", 50), ("l", "abcdefhg", 1)], "kind string, s string, n long")
    assert {r.s: r.canon for r in names.canonical(df).collect()} == {"abcdefgh": "abcdefgh", "abcdefhg": "abcdefgh"}


def test_distances_of_a_batch():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcé日") for _ in range(rng.randrange(1, 12))) for _ in range(60)] + ["z" * 500]
    got = names.distances(words, words[:9] + [""])
    assert got.tolist() == [[levenshtein(a, b) for b in words[:9] + [""]] for a in words]


def test_slip_of_a_slip_of_a_slip(spark):
    chain = [("l", "abcdefgh", 50), ("l", "abcdefgx", 10), ("l", "abcdefyx", 3), ("l", "abcdezyx", 1), ("l", "abcdezyz", 1), ("o", "abcdezyz", 1)]
    rare = [("f", "maria", 40), ("f", "maira", 1), ("f", "mario", 30), ("f", "marib", 3)]
    df = spark.createDataFrame(chain + rare, "kind string, s string, n long")
    got = {(r.kind, r.s): r.canon for r in names.canonical(df).collect()}
    assert {got["l", s] for _, s, _ in chain[:5]} == {"abcdefgh"} and got["o", "abcdezyz"] == "abcdezyz"
    assert got["f", "maira"] == "maria" and got["f", "mario"] == "mario" and got["f", "marib"] == "marib"


def test_abbreviations_are_all_met(spark):
    rng = random.Random(2)
    shorts = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(80)]
    longs = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 10))) for _ in range(80)]

    def stands(a, b):
        it = iter(b)
        return len(a) < len(b) and (b.startswith(a) or (a[0] == b[0] and a[-1] == b[-1] and all(c in it for c in a)))

    got = names.abbreviations(spark.createDataFrame([(x,) for x in shorts], "short string"), spark.createDataFrame([(x,) for x in longs], "long string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted({(a, b) for a in shorts for b in longs if stands(a, b)})
    assert len(names.long_keys("x" * 100_000)) < 20


def test_pairs_of_large_entities(spark):
    rows = [(f"k{i:03d}", "big") for i in range(50)] + [("a", "two"), ("b", "two"), ("c", "one")]
    members = spark.createDataFrame(rows, "key string, entity string")
    want = sorted((a, b) for a, e in rows for b, f in rows if e == f and a < b)
    for block in (3, 10, 2048):
        assert sorted(tuple(r) for r in names.pairs_of(members, block).collect()) == want


@pytest.mark.parametrize("a,b,d", [("abc", "abc", 0), ("abc", "acb", 1), ("ca", "abc", 2), ("", "ab", 2), ("kitten", "sitting", 3)])
def test_damerau(a, b, d):
    assert N.damerau(a, b) == N.damerau(b, a) == d


@pytest.mark.parametrize("mention,kind,form", [
    ("Dr. Ann B. Lee (PM)", "person", ("two", "ann", "lee", None)), ("Lee, Ann", "person", ("sure", "ann", "lee", None)), ("A. Lee", "person", ("sure", "a", "lee", None)),
    ("ánn  LÉE", "person", ("two", "ann", "lee", None)), ("Ann", "person", ("one", "ann", None, None)), ("@annlee", "username", ("joined", None, None, "annlee")),
    ("ann_lee2@x.test", "email", ("two", "ann", "lee", None)), ("The Foo Labs Company", "org", ("org", "foo", "labs", None)), ("FOO LABS, S.A.", "org", ("org", "foo", "labs", None)),
    ("foo-labs", "org", ("org", "foo", "labs", None)), ("  ", "person", None), (None, None, None), ("(x)", "person", None),
])
def test_reading(mention, kind, form):
    assert N.read(mention, kind) == form


def test_mailboxes():
    assert N.email_identity(" MAILTO:Ann.Lee+x@Foo-mail.test") == "ann.lee@foo.test"
    assert N.email_identity("front-desk@foo.test") is None and N.email_identity("nonsense") is None and N.email_identity(None) is None


def test_who_is_who(spark):
    key = lambda i: f"mention:{i:016x}"
    people = [
        ("Ann Leventor", ["ann.leventor@foo.test"]), ("Leventor, Ann", None), ("Ann Leventro", None), ("ANN LEVENTOR (PM)", ["front-desk@foo.test"]), ("ann_leventor", []),  # 0-4 one person
        ("Bob Sharename", ["bob1@foo.test"]), ("Bob Sharename", ["bob2@bar.test"]), ("Bob Sharename", None),  # 5-7: two people and one who may be either
        ("C. Uniqueson", None), ("Carl Uniqueson", None),  # 8, 9 one
        ("D. Twofold", None), ("Dora Twofold", None), ("Dean Twofold", None),  # 10 may be either
        ("Eve", ["eve.namesake@foo.test"]), ("Eve Namesake", None),  # 13, 14 one by the mailbox
        ("Becky Formal", None), ("Rebecca Formal", None),  # 15, 16
    ]
    orgs = ["Zumabexif Mining", "The Zumabexif Mining Company", "ZUMABEXIF MNG", "Zumabexif Health", "Zumabeixf Mining Inc.", "Otherword Mining", "Otherword Health", "Third Mining", "Otherword", "Third"]
    recs = [(key(i), m, "person" if "_" not in m else "username", e) for i, (m, e) in enumerate(people)] + [(key(100 + i), m, "org", None) for i, m in enumerate(orgs)]
    side = lambda r: (r[1], r[2], r[3], ["crm:1", r[0]], 1)
    rows = [(side(a), side(b), "x") for a, b in zip(recs, recs[1:] + recs[:1])] + [(side(recs[0]), (None, None, None, [key(999)], None), "x"), (side(recs[0]), (None, None, None, None, None), "x")]
    s = "struct<mention:string,type:string,emails:array<string>,external_ids:array<string>,frequency:int>"
    df = spark.createDataFrame(rows + rows[:3], f"a {s}, b {s}, entity string")
    got = {(int(a[8:], 16), int(b[8:], 16)) for a, b in names.variants(df).collect()}
    group = lambda *x: {(a, b) for a in x for b in x if a < b}
    want = group(0, 1, 2, 3, 4) | group(8, 9) | group(13, 14) | group(15, 16) | group(256 - 156, 101, 102, 104) | group(107, 109)
    assert got == want
    assert names.variants(df.limit(0)).count() == 0
