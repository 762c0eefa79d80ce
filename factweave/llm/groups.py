"""Problem 3: consolidating pairwise matches into groups by Borůvka hooking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.plans.lineage import discard, measured, stored
from factweave.sources.tables import table

#: A component at least halves the number of those it touches in each round.
MAX_ROUNDS = 64
#: Edges that a task hooks at a time before it passes on their forest.
CHUNK = 500_000

_EDGE = "u string, v string"


# ---------------------------------------------------------------- inside a task
def forest(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Root of every node of the edges ``u - v`` (nodes are numbers from 0), by the same hooking.

    Every component hooks onto its smallest neighbour, of two that hook onto each other the
    smaller is the root, pointers are doubled until they rest, edges are relabelled.
    """
    n = int(max(u.max(), v.max())) + 1 if len(u) else 0
    root = np.arange(n)
    while len(u):
        parent = np.full(n, n)
        np.minimum.at(parent, u, v)
        np.minimum.at(parent, v, u)
        idle = parent == n
        parent[idle] = np.flatnonzero(idle)
        own = np.arange(n)
        mutual = (parent[parent] == own) & (own < parent)
        parent[mutual] = own[mutual]
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        root = parent[root]
        u, v = parent[u], parent[v]
        there = u != v
        u, v = u[there], v[there]
    return root


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges ``root, member`` that connect what the edges of a partition connect."""

    def star(parts: list[pd.DataFrame]) -> pd.DataFrame:
        u, v = (pd.concat([p[c] for p in parts]) for c in "uv")
        codes, names = pd.factorize(pd.concat([u, v]))
        root = forest(codes[: len(u)], codes[len(u) :])
        member = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"u": names[root[member]], "v": names[member]})

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= CHUNK:
            yield star(held)
            held, n = [], 0
    if n:
        yield star(held)


# ---------------------------------------------------------------- across tasks
def collapse(parents: DataFrame, name: str = "trees") -> DataFrame:
    """Pointer doubling of ``node, parent`` until every parent is a root (its own parent).

    Two doublings make one job, which also counts what the second still moved.
    """
    for _ in range(MAX_ROUNDS):
        once = _doubled(parents.select("node", "parent", F.lit(False).alias("moved")))
        twice, seen = measured(_doubled(once), name, moved=F.count_if("moved"))
        discard(parents)
        parents = twice.select("node", "parent")
        if not seen["moved"]:
            return parents
    raise RuntimeError("pointer doubling did not end")


def _doubled(parents: DataFrame) -> DataFrame:
    up = parents.select(F.col("node").alias("__n"), F.col("parent").alias("__p")).hint("merge")
    onward = F.coalesce("__p", "parent")
    return parents.join(up, F.col("parent") == F.col("__n"), "left").select("node", onward.alias("parent"), (onward != F.col("parent")).alias("moved"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, group_id`` for every node, ``group_id`` being the smallest node of its group.

    ``nodes(node)`` and ``edges(u, v)`` may hold repeated rows, loops and edges whose ends are
    no nodes (these become nodes); null nodes and edges with a null end are left out. Each
    round, every component hooks onto the other end of its smallest outgoing edge, where edges
    are ordered by (smaller label, larger label), so that end is its smallest neighbour. Such
    hooks form trees joined by one cycle of two, whose smaller label becomes the root. The
    trees are collapsed by pointer doubling, edges are relabelled and deduplicated, and the
    loop ends when no edge is left.

    Before the rounds, every task hooks the edges it has in the same way and passes on one edge
    per node, once as the edges lie and once dealt by their member, which every partition names
    at most once: the combine before the shuffle, that bounds what a hub or a giant group can
    send to one task. The minimum per component is combined map-side. What every step wrote is
    in the shared folder; what no later step reads is deleted.
    """
    ends = edges.select("u", "v").where("u is not null and v is not null")
    every = nodes.select("node").where("node is not null").union(ends.select("u")).union(ends.select("v")).distinct()
    lying = ends.where("u <> v").mapInPandas(_stars, _EDGE)
    dealt = lying.repartition("v").mapInPandas(_stars, _EDGE).distinct()
    live, left = measured(dealt, "edges", n=F.count(F.lit(1)))
    maps: list[DataFrame] = []
    while left["n"]:
        if len(maps) == MAX_ROUNDS:
            raise RuntimeError("hooking did not end")
        both = live.select(F.col("u").alias("node"), F.col("v").alias("other")).union(live.select("v", "u"))
        hooks = both.groupBy("node").agg(F.min("other").alias("parent"))
        back = hooks.select(F.col("node").alias("__n"), F.col("parent").alias("__p")).hint("merge")
        mutual = (F.col("__p") == F.col("node")) & (F.col("node") < F.col("parent"))
        rooted = hooks.join(back, F.col("parent") == F.col("__n"), "left").select("node", F.when(mutual, F.col("node")).otherwise(F.col("parent")).alias("parent"))
        roots = collapse(stored(rooted, "hooks"))
        maps.append(roots)
        before = live
        live, left = measured(_relabel(live, roots), "edges", n=F.count(F.lit(1)))
        discard(before)
    return _smallest(every, maps)


def _relabel(edges: DataFrame, roots: DataFrame) -> DataFrame:
    a = roots.select(F.col("node").alias("u"), F.col("parent").alias("ru")).hint("merge")
    b = roots.select(F.col("node").alias("v"), F.col("parent").alias("rv")).hint("merge")
    named = edges.join(a, "u").join(b, "v").where("ru <> rv")
    return named.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()


def _smallest(every: DataFrame, maps: list[DataFrame]) -> DataFrame:
    """Composes the rounds' mappings, last one first, each being at most half of the one before."""
    if not maps:
        return every.select("node", F.col("node").alias("group_id"))
    whole = maps[-1]
    for earlier in reversed(maps[:-1]):
        later = whole.select(F.col("node").alias("__n"), F.col("parent").alias("__p"))
        whole = earlier.join(later, F.col("parent") == F.col("__n"), "left").select("node", F.coalesce("__p", "parent").alias("parent"))
    smallest = whole.groupBy("parent").agg(F.min("node").alias("group_id"))
    labelled = whole.join(smallest, "parent").select(F.col("node").alias("__n"), "group_id")
    return every.join(labelled, F.col("node") == F.col("__n"), "left").select("node", F.coalesce("group_id", "node").alias("group_id"))


def record_key(side: str) -> Column:
    """The one ``mention:<16 hex>`` among the external ids of a side, null without one."""
    found = F.filter(F.col(f"{side}.external_ids"), lambda x: F.trim(x).rlike(r"^(?i)mention:[0-9a-f]{16}$"))
    return F.trim(F.try_element_at(found, F.lit(1)))


def reviewed(label: str = "label") -> Column:
    return F.coalesce(F.trim(label) != "", F.lit(False))


def means_same(label: str = "label") -> Column:
    return F.regexp_replace(F.upper(F.trim(label)), r"[\s_-]+", "_").isin("SAME", "SAME_ENTITY")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Group of every record on a reviewed row."""
    rows = table(spark, folder, "phase3_identity_pairs").where(reviewed())
    pairs = rows.select(record_key("a").alias("u"), record_key("b").alias("v"), means_same().alias("same"))
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node"))
    found = components(ends, pairs.where("same"))
    return found.select(F.col("node").alias("mention_id"), "group_id")
