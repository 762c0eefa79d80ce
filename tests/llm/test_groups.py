"""Problem 3 against union-find."""

import random

from factweave.llm import groups


def brute(nodes, edges):
    parent = {n: n for n in nodes if n is not None}
    for u, v in edges:
        if u is not None and v is not None:
            parent.setdefault(u, u)
            parent.setdefault(v, v)

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and v is not None:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in parent}


def run(spark, nodes, edges):
    n = spark.createDataFrame([(x, "e") for x in nodes], "node string, group_id string")
    e = spark.createDataFrame([(*x, "e") for x in edges], "u string, v string, parent string")
    got = groups.components(n, e).collect()
    assert len(got) == len({r.node for r in got})
    return {r.node: r.group_id for r in got}


def test_random_chain_and_hub(spark):
    rng = random.Random(3)
    name = lambda i: f"m{i:04d}"
    order = list(range(300))
    rng.shuffle(order)
    edges = [(name(a), name(b)) for a, b in zip(order[:100], order[1:100])]  # a long chain in random order
    edges += [(name(150), name(i)) for i in range(151, 220)]  # a hub
    edges += [(name(rng.randrange(220, 300)), name(rng.randrange(220, 300))) for _ in range(60)]
    edges += edges[:20] + [("loop", "loop"), (None, "m0001"), ("m0002", None)]
    nodes = [name(i) for i in range(300)] + ["alone", None, "alone"]
    assert run(spark, nodes, edges) == brute(nodes, edges)


def test_empty(spark):
    assert run(spark, [], []) == {}
    assert run(spark, ["a", "b"], []) == {"a": "a", "b": "b"}


def test_labels_and_keys(spark):
    rows = [(" Same ", "mention:0123456789abcdef"), ("SAME_ENTITY", "crm:1"), ("different", None), (None, None), ("  ", None), ("same-entity", None), ("uncertain", None)]
    df = spark.createDataFrame([(l, ([k] if k else None,)) for l, k in rows], "label string, a struct<external_ids:array<string>>")
    got = [tuple(r) for r in df.select(groups.means_same(), groups.reviewed(), groups.record_key("a")).collect()]
    assert [g[0] for g in got] == [True, True, False, None, False, True, False]
    assert [g[1] for g in got] == [True, True, True, False, False, True, True]
    assert [g[2] for g in got] == ["mention:0123456789abcdef"] + [None] * 6


def test_forest_of_one_task():
    import numpy as np

    rng = random.Random(4)
    for n in (1, 2, 9, 60):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(n)]
        u, v = np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])
        root = groups.forest(u, v)
        want = brute([f"{i:03d}" for i in range(int(max(u.max(), v.max())) + 1)], [(f"{a:03d}", f"{b:03d}") for a, b in pairs])
        assert [f"{r:03d}" for r in root] == [want[f"{i:03d}"] for i in range(len(root))]
    assert len(groups.forest(np.array([], dtype=int), np.array([], dtype=int))) == 0


def test_chunks_of_a_task_change_nothing(spark, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(groups, "CHUNK", 2)
    parts = [pd.DataFrame({"u": [f"n{i}"], "v": [f"n{i + 1}"]}) for i in range(7)]
    out = pd.concat(groups._stars(iter(parts)))
    assert brute([], list(out.itertuples(index=False, name=None))).keys() == {f"n{i}" for i in range(8)}


def test_one_giant_group(spark):
    edges = [(f"x{i // 2:05d}", f"x{i:05d}") for i in range(1, 4000)] + [(f"y{i}", f"y{i + 1}") for i in range(0, 60, 2)]
    assert run(spark, [], edges) == brute([], edges)
