"""Lexical, dense and fused retrieval for many questions at once, and context assembly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.plans.lineage import stored

#: Scores are summed as whole millionths, so a sum does not depend on its order.
UNIT = 1_000_000
#: Vectors of one block of the dense search.
BLOCK = 2048


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``token, key, tf, len``: the inverted index, one row per token and document."""
    words = docs.select(key, tokens(F.col(text)).alias("t")).withColumn("len", F.size("t"))
    return words.select(key, "len", F.explode("t").alias("token")).groupBy("token", key, "len").agg(F.count(F.lit(1)).alias("tf"))


def statistics(index: DataFrame, docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``token, df`` and the one row ``n, avg_len`` of a corpus."""
    df = index.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    whole = docs.select(F.size(tokens(F.col(text))).alias("len")).agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    return df, whole


def bm25(index: DataFrame, df: DataFrame, whole: DataFrame, questions: DataFrame, key: str, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """``question_id, key, score`` of every document that shares a token with a question.

    ``questions(question_id, question)``. A token that stands twice in a question counts twice.
    Negative idf values become ``epsilon`` times the mean idf. The index is only joined on the
    tokens of the questions; ``whole`` and the mean are single rows.
    """
    one = whole.crossJoin(F.broadcast(df.crossJoin(F.broadcast(whole)).agg(F.avg(_idf()).alias("mean_idf"))))  # one row each
    asked = questions.select("question_id", F.explode(tokens(F.col("question"))).alias("token")).groupBy("question_id", "token").agg(F.count(F.lit(1)).alias("times"))
    weight = df.crossJoin(F.broadcast(one)).withColumn("idf", F.when(_idf() < 0, epsilon * F.col("mean_idf")).otherwise(_idf())).select("token", "idf", "avg_len")
    part = F.col("idf") * (F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len"))))
    hits = asked.join(weight, "token").join(index, "token")
    return hits.groupBy("question_id", key).agg(F.sum(F.round(part * UNIT).cast("long") * F.col("times")).alias("score"))


def _idf() -> Column:
    return F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def bm25_top(docs: DataFrame, key: str, text: str, questions: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """``question_id, key, score, rank``: the ``k`` best documents of each question, scores as ``bm25``.

    Questions are taken in blocks of at most ``BLOCK``. What a block needs (its tokens' idf and
    counts) goes to every task, which multiplies document by question matrices and passes on
    ``k`` rows per question and batch; documents are tokenised once and never shuffled. Parts
    are whole millionths, so the products are exact.
    """
    words = docs.select(key, tokens(F.col(text)).alias("t"))
    n, total = words.agg(F.count(F.lit(1)), F.sum(F.size("t"))).first()
    if not n or not total:
        return docs.select(F.lit("").alias("question_id"), key, F.lit(0).cast("long").alias("score"), F.lit(0).alias("rank")).limit(0)
    df = stored(words.select(F.explode(F.array_distinct("t")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.lit(n).alias("n")).withColumn("idf", _idf()), "bm25-df")
    mean = df.agg(F.avg("idf")).first()[0]
    asked = stored(questions.select("question_id", F.explode(tokens(F.col("question"))).alias("token")).groupBy("question_id", "token").agg(F.count(F.lit(1)).alias("times")), "bm25-asked")
    blocks = max(1, -(-questions.count() // BLOCK))
    spark, parts = docs.sparkSession, []
    for no in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == no).join(df, "token")
        rows = block.select("question_id", "token", "times", F.when(F.col("idf") < 0, epsilon * mean).otherwise(F.col("idf")).alias("idf")).collect()
        if rows:
            shared = spark.sparkContext.broadcast([tuple(r) for r in rows])
            parts.append(words.mapInPandas(_best(shared, key, total / n, k, k1, b), f"question_id string, {key} long, score long"))
    if not parts:
        return docs.select(F.lit("").alias("question_id"), key, F.lit(0).cast("long").alias("score"), F.lit(0).alias("rank")).limit(0)
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    return top(found, "question_id", key, k)


def _best(shared, key: str, mean_len: float, k: int, k1: float, b: float):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = shared.value
        vocab = {t: i for i, t in enumerate(sorted({r[1] for r in rows}))}
        names = sorted({r[0] for r in rows})
        place = {q: i for i, q in enumerate(names)}
        idf, times = np.zeros(len(vocab)), np.zeros((len(vocab), len(names)))
        for q, t, c, w in rows:
            idf[vocab[t]], times[vocab[t], place[q]] = w, c
        for whole in batches:
            for start in range(0, len(whole), 512):
                batch = whole.iloc[start : start + 512]
                tf, lens = np.zeros((len(batch), len(vocab))), np.zeros(len(batch))
                for row, found in enumerate(batch["t"]):
                    lens[row] = len(found)
                    for t in found:
                        i = vocab.get(t)
                        if i is not None:
                            tf[row, i] += 1
                norm = k1 * (1 - b + b * lens / mean_len)
                part = np.floor(idf * (tf * (k1 + 1) / (tf + norm[:, None])) * UNIT + 0.5)
                part[tf == 0] = 0
                score, shares = (part @ times).astype(np.int64), ((tf > 0) @ (times > 0).astype(float)) > 0
                ids, out = batch[key].to_numpy(), []
                for q in range(len(names)):
                    hit = np.flatnonzero(shares[:, q])
                    if len(hit) > 8 * k:  # those below the k-th score cannot be among the best
                        least = np.partition(score[hit, q], len(hit) - k)[len(hit) - k]
                        hit = hit[score[hit, q] >= least]
                    best = hit[np.lexsort((ids[hit], -score[hit, q]))[:k]]
                    out.append((np.full(len(best), q), ids[best], score[best, q]))
                which, found, scores = (np.concatenate(x) for x in zip(*out))
                yield pd.DataFrame({"question_id": np.array(names, dtype=object)[which], key: found, "score": scores})

    return search


def top(scores: DataFrame, by: str, key: str, k: int) -> DataFrame:
    """The ``k`` best of each ``by`` with their rank from 1; ties go to the smaller key.

    The limit is applied before the shuffle as well, so a question that hits very many
    documents ships at most ``k`` of each partition.
    """
    order = Window.partitionBy(by).orderBy(F.desc("score"), key)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dense(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, key, score, rank``: the ``k`` nearest by cosine, in millionths.

    ``queries(query_id, vector)``, a stated query set, goes to every task in blocks of at most
    ``BLOCK`` unit vectors; vectors stay where they lie, meet a block in one matrix product a
    batch and pass on ``k`` rows per query. Vectors that are null, hold a null, or have another
    length than the query are left out; a zero vector is near to nothing.
    """
    spark = vectors.sparkSession
    asked = queries.where(F.col(vector).isNotNull()).select(F.col("query_id").cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v"))
    blocks = max(1, -(-asked.count() // BLOCK))
    own = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias("v"))
    parts = []
    for no in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == no).collect()
        for size in sorted({len(r["v"]) for r in rows}):
            same = [r for r in rows if len(r["v"]) == size and None not in r["v"]]
            if same and size:
                m = np.array([r["v"] for r in same], dtype=np.float64)
                shared = spark.sparkContext.broadcast((np.array([r["i"] for r in same], dtype=np.int64), m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)))
                parts.append(own.mapInPandas(_nearest(shared, key, k), f"query_id long, {key} long, score long"))
    if not parts:
        return own.select(F.lit(0).cast("long").alias("query_id"), key, F.lit(0).cast("long").alias("score"), F.lit(0).alias("rank")).limit(0)
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    return top(found, "query_id", key, k)


def _nearest(shared, key: str, k: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qi, qm = shared.value
        for whole in batches:
            good = [x is not None and len(x) == qm.shape[1] and not np.isnan(x).any() for x in whole["v"]]
            ids, rows = whole[key].to_numpy()[good], whole["v"][good]
            for start in range(0, len(ids), BLOCK):
                di, m = ids[start : start + BLOCK], np.stack(rows.iloc[start : start + BLOCK].to_list())
                dm = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                score = np.rint((qm @ dm.T) * UNIT).astype(np.int64)
                out = []
                for row in score:
                    hit = np.arange(len(di))
                    if len(di) > 8 * k:  # those below the k-th score cannot be among the best
                        hit = np.flatnonzero(row >= np.partition(row, len(di) - k)[len(di) - k])
                    out.append(hit[np.lexsort((di[hit], -row[hit]))[:k]])
                sizes = [len(x) for x in out]
                at = np.concatenate(out)
                which = np.repeat(np.arange(len(qi)), sizes)
                yield pd.DataFrame({"query_id": qi[which], key: di[at], "score": score[which, at]})

    return search


def fuse(rankings: list[DataFrame], key: str, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of rankings ``(query_id, key, rank)``: the sum of 1 / (constant + rank from 0)."""
    both = rankings[0].select("query_id", key, "rank")
    for r in rankings[1:]:
        both = both.unionByName(r.select("query_id", key, "rank"))
    part = F.round(F.lit(float(UNIT * UNIT)) / (constant + F.col("rank") - 1)).cast("long")
    return top(both.groupBy("query_id", key).agg(F.sum(part).alias("score")), "query_id", key, k)


def context(ranked: DataFrame, by: str, length: str, budget: int) -> DataFrame:
    """The prefix of each ranking whose lengths fit the budget; the first piece always stays."""
    sofar = F.sum(length).over(Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("used", sofar).where((F.col("used") <= budget) | (F.col("rank") == 1))


def recall(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """``question_id``, recall at each k and the reciprocal rank of the first hit.

    ``ranked(question_id, item, rank)``, ``gold(question_id, item)``; questions without gold
    are left out, those without a hit have zeros.
    """
    want = gold.distinct()
    hits = want.join(ranked, ["question_id", "item"], "left")
    return hits.groupBy("question_id").agg(
        *[(F.count_if(F.col("rank") <= k) / F.count(F.lit(1))).alias(f"recall_{k}") for k in ks],
        F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("reciprocal_rank"), F.count(F.lit(1)).alias("wanted"),
    )


# What an answer that abstains says.
ABSTENTION = ["abstain", "not found", "unknown", "cannot determine", "no information", "info not found"]


def plain(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"\s+", " ")


def answers_match(got: Column, gold: Column) -> Column:
    """Whether an answer counts as right: the same, one within the other, both abstaining, or
    three fifths of at least three gold words. Answers of less than two characters never do."""
    a, g = plain(got), plain(gold)
    words, said = F.array_distinct(F.split(g, " ")), F.array_distinct(F.split(a, " "))

    def abstains(x: Column) -> Column:
        out = F.lit(False)
        for marker in ABSTENTION:
            out = out | x.contains(marker)
        return out

    overlap = (F.size(words) >= 3) & (F.size(F.array_intersect(words, said)) / F.size(words) >= 0.6)
    return (F.length(a) >= 2) & (g != "") & (a.contains(g) | g.contains(a) | (abstains(a) & abstains(g)) | overlap)
