"""Problem 8: every run of ten words, no other."""

import random

from factweave.llm import leaks as L


def brute(docs, items):
    out = set()
    for d, t in docs:
        w = L.words(t)
        have = {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
        for q, a, b in items:
            for s in (a, b):
                x = L.words(s)
                if any(tuple(x[i : i + 10]) in have for i in range(len(x) - 9)):
                    out.add((d, q))
    return out


def cases():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(60)] + ["the", "of", "a"] * 5
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(f"q{i}", text(rng.randrange(5, 40)), text(rng.randrange(0, 90)) or None) for i in range(40)]
    docs = []
    for i in range(150):
        q = rng.choice(items)
        w = L.words(rng.choice([q[1], q[2] or ""]))
        at, n = rng.randrange(0, max(1, len(w))), rng.randrange(7, 14)
        docs.append((i, text(rng.randrange(0, 60)) + " \n>" + ",  ".join(w[at : at + n]).upper() + "! " + text(rng.randrange(0, 30))))
    return docs + [(900, None), (901, ""), (902, "x " * 100_000 + items[0][1]), (None, items[0][1])], items + [("short", "one two", None), ("none", None, None)]


def test_index_is_exact():
    docs, items = cases()
    index = L.WandIndex([(q, L.words(t)) for q, a, b in items for t in (a, b) if t])
    got = {(d, k) for d, t in docs for k in index.leaked(L.words(t))}
    assert got == brute(docs, items) and len(got) > 20


def test_in_blocks(spark):
    docs, items = cases()
    d = spark.createDataFrame([(*x, "e") for x in docs + docs[:5]], "doc_id long, text string, question_id string")
    i = spark.createDataFrame([(*x, "e") for x in items], "question_id string, question string, gold_answer string, doc_id string")
    want = {x for x in brute(docs, items) if x[0] is not None}
    for texts, passages in ((1000, 1000), (15, 7)):
        got = [tuple(r) for r in L.leaks(d, i, texts, passages).collect()]
        assert set(got) == want and len(got) == len(set(got))
    assert L.leaks(d.limit(0), i).count() == 0 and L.leaks(d, i.limit(0)).count() == 0


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_BITS", 2**16)
    docs, items = cases()
    more = items + [(f"x{n}", " ".join(f"v{n}a{i}" for i in range(200)), None) for n in range(900)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(more, "question_id string, question string, gold_answer string")
    assert {tuple(r) for r in L.leaks(d, i).collect()} == {x for x in brute(docs, items) if x[0] is not None}
