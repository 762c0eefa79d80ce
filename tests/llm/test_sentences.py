"""Problem 10: boundaries, offsets and coverage."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factweave.llm import sentences as S

CASES = [
    ("He met Dr. X. Then J. R. Smith left at 5 p.m. It rained.", ["He met Dr. X. Then J. R. Smith left at 5 p.m.", "It rained."]),
    ("Version 10.11 fell to 3.5%. See config.yaml!", ["Version 10.11 fell to 3.5%.", "See config.yaml!"]),
    ("“Can we ship?” asked Lina. Zoe said, “No.” They left.", ["“Can we ship?” asked Lina.", "Zoe said, “No.”", "They left."]),
    ("“It failed. We retried.” wrote Tom", ["“It failed. We retried.” wrote Tom"]),
    ("Omar说：“没有问题。”他走了。为什么？", ["Omar说：“没有问题。”", "他走了。", "为什么？"]),
    ("「出荷しません。」と言いました。次です。", ["「出荷しません。」と言いました。", "次です。"]),
    ("टीम ने देखा। डॉ. राम आए।", ["टीम ने देखा।", "डॉ. राम आए।"]),
    ("من المسؤول؟ لا تحذفوا!", ["من المسؤول؟", "لا تحذفوا!"]),
    ("กรุณาอย่าลบ รายงานยังขาด", ["กรุณาอย่าลบ", "รายงานยังขาด"]),
    ("Die Latenz sank z. B. bei x. Am 6. Mai geprüft.", ["Die Latenz sank z. B. bei x.", "Am 6. Mai geprüft."]),
    ("« On livre demain », a écrit Noor. M. Dupont part !", ["« On livre demain », a écrit Noor.", "M. Dupont part !"]),
    ("#ops-1\nAnn Bee: Done.It works\nnow. Yes", ["#ops-1", "Ann Bee: Done.", "It works\nnow.", "Yes"]),
    ("# Title\n\nHi Ann,\n\n- one. two\n- three\n1. four\n\n> quoted\n> more\n\nBest, Tom", ["# Title", "Hi Ann,", "- one.", "two", "- three", "1. four", "> quoted", "> more", "Best, Tom"]),
    ("From: A B. <a@b.test>\nSubject: x. Y\n\nWe waited... and then. No owner… Then", ["From: A B. <a@b.test>", "Subject: x. Y", "We waited... and then.", "No owner…", "Then"]),
    ("", []), (None, []), (" \n\t\n ", []), ("a", ["a"]), ("🚀 up. Down", ["🚀 up.", "Down"]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_units(text, want):
    assert [text[a:b] for a, b in S.units(text)] == want


LANGUAGES = [
    ("He likes art. She does not.", "en", ["He likes art.", "She does not."]), ("The answer is no. We go on.", None, ["The answer is no.", "We go on."]),
    ("We met in Mar. Then we left.", "es", ["We met in Mar.", "Then we left."]), ("It was on Mar. 3 in the end. See art. 5 of it.", "en", ["It was on Mar. 3 in the end.", "See art. 5 of it."]),
    ("Voir l'art. Dupont dans le texte.", None, ["Voir l'art.", "Dupont dans le texte."]), ("Véase el art. Dos de la ley.", None, ["Véase el art. Dos de la ley."]),
    ("Dijo que no. Luego se fue.", "en", ["Dijo que no.", "Luego se fue."]), ("Das ist eine neue Art. Und die bleibt.", None, ["Das ist eine neue Art.", "Und die bleibt."]),
    ("Art. Xyz", "xx-YY", ["Art. Xyz"]), ("Art. Xyz", " DE_de", ["Art.", "Xyz"]), ("Art. Xyz", None, ["Art. Xyz"]),
]


@pytest.mark.parametrize("text,lang,want", LANGUAGES)
def test_words_that_are_abbreviations_elsewhere(text, lang, want):
    assert [text[a:b] for a, b in S.units(text, lang)] == want


def test_quotations_of_any_length():
    for n in (3, 50, 500):
        said = "It failed. We retried. " * n
        text = f"“{said}” wrote Tom. He left."
        assert [text[a:b] for a, b in S.units(text)] == [f"“{said}” wrote Tom.", "He left."]
    assert len(S.units("“ open. Next " * 20_000)) == 20_001  # none of them closes


def test_nothing_looks_beyond_the_stem():
    import re._parser as parser

    for tables in S.TABLES.values():
        for _, before, _ in tables[S.POINT]:
            low, high = parser.parse(before.pattern).getwidth()
            assert high < S.STEM or before.pattern.rstrip("$").endswith(("*", "+", "{2,}"))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB1.!?\"“”「」() \n-#>:。，،؟กข é", max_size=60))
def test_units_hold_all_that_is_visible(text):
    found = S.units(text)
    at = 0
    for a, b in found:
        assert at <= a < b <= len(text) and not text[at:a].strip()
        assert not text[a].isspace() and not text[b - 1].isspace()
        at = b
    assert not text[at:].strip()


def test_table(spark):
    long = "One two. " * 50_000
    df = spark.createDataFrame([(1, "A b. C d.", 5), (2, None, 5), (3, "", 5), (4, long, 5), (None, "x", 5)], "doc_id long, text string, start_pos int")
    got = S.sentences(df).collect()
    assert sorted((r.doc_id, r.start_pos, r.end_pos) for r in got if r.doc_id == 1) == [(1, 0, 4), (1, 5, 9)]
    assert sum(r.doc_id == 4 for r in got) == 50_000 and {r.doc_id for r in got} == {1, 4}
    assert S.sentences(df.limit(0)).count() == 0
