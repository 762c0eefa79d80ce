"""Answering questions from retrieved texts: systems, deterministic model, runner with resume."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.operators import retrieval as R

#: Candidates of each ranking before they are fused, texts that are used, letters of context.
POOL, TOP, BUDGET = 50, 5, 12_000
#: ``embed(df, key, text)`` gives ``key, embedding``; see ``hashed_vectors`` for one without a model.
Embed = Callable[[DataFrame, str, str], DataFrame]
#: Dimensions of the hashed vectors.
WIDTH = 64


def hashed_vectors(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, embedding``: a unit vector of a text's words, each added to the place of its hash; zero without words.

    Stands for an embedding model where there is none: the same text has the same vector everywhere.
    """
    words = df.select(key, F.explode(R.tokens(F.col(text))).alias("w")).groupBy(key, F.pmod(F.crc32(F.encode("w", "UTF-8")), F.lit(WIDTH)).cast("int").alias("i")).agg(F.count(F.lit(1)).alias("n"))
    rows = words.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("l"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)) / F.col("l"))
    zero = F.array(*[F.lit(0.0)] * WIDTH)
    return df.select(key).distinct().join(rows.select(F.col(key).alias("__k"), vector.alias("v")), F.col(key) == F.col("__k"), "left").select(key, F.coalesce("v", zero).alias("embedding"))


def numbered(questions: DataFrame) -> DataFrame:
    """Adds ``query_id``, a number from the question's id."""
    return questions.withColumn("query_id", F.xxhash64("question_id"))


def search(system: str, docs: DataFrame, questions: DataFrame, k: int, embed: Embed = hashed_vectors) -> DataFrame:
    """``question_id, doc_id, rank`` by ``bm25``, ``dense`` or ``hybrid`` (both, fused by reciprocal ranks).

    ``docs(doc_id, body)``, ``questions(question_id, question)``, a stated query set.
    """
    if system == "bm25":
        return R.bm25_top(docs, "doc_id", "body", questions, k).select("question_id", "doc_id", "rank")
    q = numbered(questions)
    asked = embed(q, "query_id", "question")
    names = q.select("query_id", "question_id").distinct()
    near = R.dense(embed(docs, "doc_id", "body"), "doc_id", "embedding", asked, k if system == "dense" else POOL)
    if system == "dense":
        return near.join(names.hint("merge"), "query_id").select("question_id", "doc_id", "rank")
    if system != "hybrid":
        raise ValueError(f"unknown system {system!r}")
    words = R.bm25_top(docs, "doc_id", "body", questions, POOL).select(F.xxhash64("question_id").alias("query_id"), "doc_id", "rank")
    return R.fuse([words, near], "doc_id", k).join(names.hint("merge"), "query_id").select("question_id", "doc_id", "rank")


def block(doc: Column, body: Column) -> Column:
    """A piece of context: the document's id and its text."""
    return F.concat(F.lit("["), doc.cast("string"), F.lit("]\n"), body)


def contexts(found: DataFrame, docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``question_id, context, used, doc_ids``: the ranked texts that fit the budget, the first one always."""
    rows = found.join(docs.select("doc_id", block(F.col("doc_id"), F.col("body")).alias("piece")).hint("merge"), "doc_id").withColumn("chars", F.length("piece"))
    kept = R.context(rows, "question_id", "chars", budget)
    per = kept.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "piece", "doc_id"))).alias("x"), F.max("used").alias("used"))
    return per.select("question_id", F.array_join(F.transform("x", lambda v: v["piece"]), "\n\n").alias("context"), "used", F.transform("x", lambda v: v["doc_id"]).alias("doc_ids"))


def mock_answer(context: Column) -> Column:
    """A model's stand-in: the beginning of the first line of context, or an abstention without one."""
    line = F.left(F.split_part(F.regexp_replace(context, r"^\[[^\]]*\]\n", ""), F.lit("\n"), F.lit(1)), F.lit(120))
    return F.when(F.trim(F.coalesce(context, F.lit(""))) == "", "unknown").otherwise(F.concat(F.lit("mock: "), line))


def run(system: str, docs: DataFrame, questions: DataFrame, done: DataFrame | None = None, answer: Callable[[Column], Column] = mock_answer, k: int = TOP, budget: int = BUDGET) -> DataFrame:
    """``question_id, system, answer, doc_ids, context_chars, context_tokens`` of the questions that have no result in ``done``.

    Questions for which nothing is found get an abstention, so each has one result.
    """
    left = questions if done is None else questions.join(done.select("question_id").distinct(), "question_id", "left_anti")
    found = contexts(search(system, docs, left, k), docs, budget)
    met = left.select("question_id").distinct().join(found, "question_id", "left")
    tokens = F.greatest(F.size(F.split(F.trim(F.coalesce("context", F.lit(""))), r"\s+")), F.lit(1))
    return met.select("question_id", F.lit(system).alias("system"), answer(F.col("context")).alias("answer"), F.coalesce("doc_ids", F.array().cast("array<bigint>")).alias("doc_ids"), F.coalesce("used", F.lit(0)).cast("long").alias("context_chars"), tokens.alias("context_tokens"))


def snippets(docs: DataFrame, questions: DataFrame, top: int = 6, shown: int = 4, length: int = 220) -> DataFrame:
    """``question_id, place, doc_id, snippet``: of the best ``top`` documents the first ``shown`` with the beginning of their text."""
    found = search("bm25", docs, questions, top).where(F.col("rank") <= shown)
    text = F.left(F.trim(F.regexp_replace("body", r"\s+", " ")), F.lit(length))
    return found.join(docs.select("doc_id", text.alias("snippet")).hint("merge"), "doc_id").select("question_id", F.col("rank").alias("place"), "doc_id", "snippet")


def structured(docs: DataFrame, questions: DataFrame, graph_answers: DataFrame, k: int = TOP, budget: int = BUDGET) -> DataFrame:
    """The graph's answer where it has one, else that of half as much retrieved context.

    ``graph_answers(question_id, status, answer)``; an absent or conflicting state is no answer.
    """
    known = graph_answers.where("status = 'found'").select("question_id", F.col("answer").alias("__a"))
    got = run("hybrid", docs, questions, k=k, budget=budget // 2)
    met = got.join(known, "question_id", "left")
    return met.select("question_id", F.lit("structured").alias("system"), F.coalesce("__a", "answer").alias("answer"), "doc_ids", "context_chars", F.col("__a").isNotNull().alias("from_graph"))


def gold_sample(artifacts: DataFrame, per_source: int, seed: str = "gold") -> DataFrame:
    """``id, source, size, rank``: artifacts to be labelled: of every source as many of each size, in the order of a hash."""
    from factweave.operators.inventory import hash_order, size_bucket, top_per

    a = artifacts.where("id is not null").groupBy("id").agg(F.min(F.struct("source", F.length(F.coalesce("content", F.lit(""))).alias("n"))).alias("x"))
    rows = a.select("id", "x.source", size_bucket(F.col("x.n")).alias("size"))
    return top_per(rows, ["source", "size"], [hash_order("id", seed), F.col("id")], per_source)
