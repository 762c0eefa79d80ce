"""Candidate pairs: every signal two records share makes them one."""

from itertools import combinations

import pytest

from factweave.operators import identity as I

RECORD = "key string, mention string, type string, emails array<string>, external_ids array<string>"
ROWS = [
    ("1", "Rose Kowiwekal (Platform)", "person", None, ["mention:1", "crm:7"]), ("2", "rose.kowiwekal", "username", [], ["mention:2"]), ("3", "R. Kowiwekal", "person", None, None),
    ("4", "Someone", "person", ["rose.kowiwekal@a.test"], None), ("5", "Rose_Kowiwekal@b.test", "email", None, None), ("6", "Buyer", "org", None, ["CRM:7"]),
    ("7", "@rosekowiwekal", "username", None, None), ("8", "soham-dev", "username", None, ["mention:1"]), ("9", "soham_ops", "username", None, None),
    ("A", "Desk One", "person", ["support@a.test"], None), ("B", "Two", "person", ["support@b.test"], None), ("C", None, None, None, None), ("D", None, "username", [None], [None, ""]),
]


@pytest.mark.parametrize("block", [500, 1, 2])
def test_blocking_signals(spark, monkeypatch, block):
    monkeypatch.setattr(I, "BLOCK", block)
    got = [tuple(r) for r in I.blocked(spark.createDataFrame(ROWS, RECORD)).collect()]
    pairs = {a + b for a, b, _ in got}
    assert len(pairs) == len(got)
    assert pairs == {"12", "13", "15", "16", "23", "24", "25", "27", "35", "45", "47", "57", "89"}


def test_every_scored_pair_is_a_candidate(spark):
    side = "struct<mention:string,type:string,emails:array<string>,external_ids:array<string>>"
    all_pairs = spark.createDataFrame([(a[0] + b[0], a[1:], b[1:]) for a, b in combinations(ROWS, 2)], f"pair_id string, a {side}, b {side}")
    scored = {r.pair_id for r in I.scored(all_pairs).where("score > 0.55").collect()}
    assert scored and scored <= {r.key_a + r.key_b for r in I.blocked(spark.createDataFrame(ROWS, RECORD)).collect()}
