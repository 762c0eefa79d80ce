"""Problem 5: forms, and names and numbers that only their context gives away."""

import pytest

from factweave.llm import pii
from factweave.llm import pii_patterns as P


@pytest.mark.parametrize("text,found", [
    ("mail a.b+c@x-y.test, or d [at] e [dot] example.", [("email", "a.b+c@x-y.test"), ("email", "d [at] e [dot] example")]),
    ("use tide@v2.14.6", []), ("<mailto:Foo@Bar.test|box>", [("email", "Foo@Bar.test")]),
    ("+49 30 23125 220; (427) 555 0118; 872-555-0118.", [("phone", "+49 30 23125 220"), ("phone", "(427) 555 0118"), ("phone", "872-555-0118")]),
    ("００４９-３０-２３１２５６０７", [("phone", "００４９-３０-２３１２５６０７")]), ("Order 3207724792, batch 00-58-77, 10.0.96.73, 2024-05-21, 0000 5531 3499", []),
    ("at 80 Quarry Road, Unit 9 now", [("address", "80 Quarry Road, Unit 9")]), ("Lindengasse 68, 10476 Lindfurt.", [("address", "Lindengasse 68, 10476 Lindfurt")]), ("12 Road tiles", []),
    ("114 rue des Tilleuls, 13534 Villaserna", [("address", "114 rue des Tilleuls, 13534 Villaserna")]), ("Calle del Olivo, 39, Lindfurt", [("address", "Calle del Olivo, 39, Lindfurt")]), ("", []),
])
def test_forms(text, found):
    assert [(k, text[a:b]) for k, a, b in pii._forms(text, set())[0]] == found


@pytest.mark.parametrize("kind,text", [
    ("address", "221b Baker Street"), ("address", "Flat 2, 7, Old Mill Hill, Lindfurt 10476"), ("address", "9  Quarry\nRoad"), ("address", "12 bis rue de la Paix"), ("address", "12ter, place d'Armes, 13534 Villaserna"),
    ("address", "Hauptstr. 5"), ("address", "Marktsteig 3"), ("address", "Lindenhof 12a"), ("address", "Fischmarkt  8"), ("address", "An der Brücke 5, 10115 Berlin"), ("address", "Hinter Sankt Peter 5 b, Unit 3, 10115 Berlin"),
    ("address", "Plaza\nMayor, 3"), ("email", "a.b {at} x {dot} test"), ("email", "a.b{AT}x.test"),
])
def test_gates_let_every_form_through(kind, text):
    assert [(k, f"see {text}"[a:b]) for k, a, b in pii._forms(f"see {text}", set())[0]] == [(kind, text)]


def test_shape():
    assert P.shape("QQ 12-3 A") == "AA 99-9 A"


SCHEMA = (
    "id string, author string, content string, metadata struct<author_display_name:string,author_user_id:string,"
    "participants:array<struct<user_id:string,display_name:string,username:string,email:string>>>, artifact_id string"
)
FIRST = ["Maya", "Omar", "Will", "Priya", "Jordan", "Tara", "Bruno", "Hugo", "Zoe", "Liam"]
LAST = ["Kedakufom", "Tovuxaceh", "Jexinoguz", "Dicixirih", "Wudugufuz", "Rebobarix", "Cohuwaved", "Hepulivas", "Sarepinom", "Bolohonog"]


def corpus():
    rows = []
    for i in range(60):
        f, l, g, m = FIRST[i % 10], LAST[i * 3 % 10], FIRST[(i + 3) % 10], LAST[(i * 7 + 1) % 10]
        text = f"#ops\n{f} {l}: Can {g} {m} look at ENG-1? {g} owns Kazolub Labs now. Was it {f} or {m}, {g} who wrote? Passport 666-{10 + i % 80}-1234 expires. Serial {10**9 + i} came."
        rows.append((f"a{i}", f"{f} {l}", text, (f"{f} {l}", f"U{i}", None), "x"))
    for i in range(25):
        rows.append((f"trap{i}", "HelixBot", "#ops\nHelixBot: The Jordan cluster runs. Will the job end?", ("HelixBot", "B1", None), "x"))
    rows.append(("new", "Zoe Bolohonog", "#ops\nZoe Bolohonog: Can Tara Unseenname look at ENG-2? Can Zoe Unseenname look at ENG-3? Was it Zoe or Unseenname, Tara who wrote? Passport X05152497 expires.", ("Zoe Bolohonog", "U1", None), "x"))
    rows.append(("new2", "Zoe Bolohonog", "#ops\nHelixBot: Passport X05152498 expires. The Jordan cluster runs. Will the job end? maya kedakufom said so. id 1234", ("HelixBot", "B1", None), "x"))
    rows += [("none", None, None, None, "x"), ("empty", "", "", (None, None, None), "x"), ("long", None, "word " * 30_000 + "Omar Tovuxaceh", (None, "U3", []), "x"), (None, None, "x", None, "x")]
    return rows + rows[:4]


def test_bootstrapping(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    got = [tuple(r) for r in pii.personal_information(df).collect()]
    assert len(got) == len(set(got))
    by = {}
    for a, k, t in got:
        by.setdefault(a, set()).add((k, t))
    assert {("person_name", "Tara Unseenname"), ("person_name", "Zoe Unseenname"), ("person_name", "Zoe Bolohonog"), ("id_number", "X05152497")} <= by["new"]
    assert ("person_name", "maya kedakufom") in by["new2"] and ("id_number", "X05152498") in by["new2"]
    assert not {("person_name", "HelixBot"), ("person_name", "Jordan"), ("person_name", "Will")} & by["new2"]
    assert by["long"] == {("person_name", "Omar Tovuxaceh")} and "none" not in by and "empty" not in by
    assert not any(k == "id_number" and t.startswith("1000") for _, k, t in got)


def test_without_broadcast_is_the_same(spark, monkeypatch):
    df = spark.createDataFrame(corpus()[-34:], SCHEMA)
    want = {tuple(r) for r in pii.personal_information(df).collect()}
    monkeypatch.setattr(pii, "LEXICON_LETTERS", 0)
    assert {tuple(r) for r in pii.personal_information(df).collect()} == want


def test_empty(spark):
    assert pii.personal_information(spark.createDataFrame([], SCHEMA)).count() == 0


def test_redacted(spark):
    rows = [r for r in corpus() if r[0] not in ("long",)]
    got = {r.artifact_id: r.content for r in pii.redacted(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["new2"].startswith("#ops\nHelixBot: Passport [ID] expires. The Jordan cluster runs. Will the job end? [NAME] said so.")
    assert got["empty"] == "" and "none" not in got and got[None] == "x"
    assert got["a0"].startswith("#ops\n[NAME]: Can [NAME] look at ENG-1? [NAME] owns Kazolub Labs now.")
