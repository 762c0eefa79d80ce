"""Queries on retrieval over documents, embeddings and questions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.operators import retrieval as R
from factweave.sources.tables import table

POOL, CUT, BUDGET = 10, 5, 1200


def corpus(spark, folder):
    d = table(spark, folder, "documents")
    return d.select("doc_id", F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))).alias("body"), "dsid", "n_chars")


def questions(spark, folder):
    return table(spark, folder, "retrieval_questions").select("question_id", "question", "question_type", "gold_answer", "expected_doc_ids")


def lexical(spark, folder, k=POOL):
    docs = corpus(spark, folder)
    return R.bm25_top(docs, "doc_id", "body", questions(spark, folder), k)


def lexical_by_join(spark, folder, k=POOL):
    """The same ranking from the inverted index by joins; the way for an index that is kept."""
    docs = corpus(spark, folder)
    index = R.postings(docs, "doc_id", "body")
    df, whole = R.statistics(index, docs, "doc_id", "body")
    return R.top(R.bm25(index, df, whole, questions(spark, folder), "doc_id"), "question_id", "doc_id", k)


def token_statistics(spark, folder):
    docs = corpus(spark, folder)
    return R.postings(docs, "doc_id", "body").groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences"))


def nearest(spark, folder, k=POOL):
    v = table(spark, folder, "embeddings").select("vec_id", "embedding")
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.dense(v, "vec_id", "embedding", asked, k)


def fused(spark, folder):
    """Dense ranking fused with one by label and id, as a second opinion."""
    near = nearest(spark, folder).withColumnRenamed("vec_id", "item")
    v = table(spark, folder, "embeddings").select("vec_id", "label")
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    same = v.join(asked, "label").select("query_id", F.col("vec_id").alias("item"), F.lit(0).alias("score"))
    return R.fuse([near, R.top(same, "query_id", "item", POOL)], "item", POOL).select("query_id", "item", "rank")


def contexts(spark, folder):
    ranked = lexical(spark, folder, CUT).join(corpus(spark, folder).select("doc_id", "n_chars"), "doc_id")
    return R.context(ranked, "question_id", "n_chars", BUDGET).select("question_id", "rank", "doc_id", "used")


def recalls(spark, folder):
    ranked = lexical(spark, folder).join(corpus(spark, folder).select("doc_id", F.col("dsid").alias("item")), "doc_id").select("question_id", "item", "rank")
    gold = questions(spark, folder).select("question_id", F.explode("expected_doc_ids").alias("item"))
    return R.recall(ranked, gold, (5, 10))


def by_category(spark, folder):
    r = recalls(spark, folder).join(questions(spark, folder).select("question_id", "question_type"), "question_id")
    return r.groupBy("question_type").agg(
        F.count(F.lit(1)).alias("questions"), F.round(F.avg("recall_5"), 4).alias("recall_5"), F.round(F.avg("recall_10"), 4).alias("recall_10"), F.round(F.avg("reciprocal_rank"), 4).alias("mrr"),
        F.round(F.percentile("reciprocal_rank", 0.5), 4).alias("median_rr"),
    )


def overlap(spark, folder):
    """Questions of which at least one expected document is in the corpus."""
    q = questions(spark, folder).select("question_id", F.explode("expected_doc_ids").alias("dsid"))
    return q.join(corpus(spark, folder).select("dsid").distinct(), "dsid", "left_semi").select("question_id").distinct()


def answered(spark, folder):
    """The first fact of each question held against its gold answer, as an answering system would be."""
    q = table(spark, folder, "retrieval_questions")
    got = F.when(F.pmod(F.length("question_id") + F.length("question"), F.lit(3)) == 0, F.lit("unknown")).otherwise(F.try_element_at("answer_facts", F.lit(1)))
    return q.select("question_id", got.alias("got"), "gold_answer").select("question_id", R.answers_match(F.col("got"), F.col("gold_answer")).alias("correct"))


QUERIES = {
    "R01_bm25": lambda s, d: lexical(s, d).select("question_id", "rank", "doc_id"),
    "R01_bm25_by_join": lambda s, d: lexical_by_join(s, d).select("question_id", "rank", "doc_id"),
    "E25_token_statistics": token_statistics,
    "R02_dense": nearest,
    "F10_fusion": fused,
    "F11_context": contexts,
    "E20_recall": lambda s, d: recalls(s, d).select("question_id", F.round("recall_5", 6).alias("recall_5"), F.round("recall_10", 6).alias("recall_10"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"), "wanted"),
    "E21_category_breakdown": by_category,
    "D27_questions_in_corpus": overlap,
    "I12_answer_match": answered,
}

_BODY = "SELECT doc_id, coalesce(title, '') || chr(10) || coalesce(text, '') AS body, dsid, n_chars FROM documents"
_TOK = f"""docs AS ({_BODY}), toks AS (SELECT doc_id, len(t) AS len, unnest(t) AS token FROM (SELECT doc_id, regexp_extract_all(lower(body), '[a-z0-9]+') AS t FROM docs)),
  idx AS (SELECT token, doc_id, len, count(*) AS tf FROM toks GROUP BY ALL), dfs AS (SELECT token, count(*) AS df FROM idx GROUP BY token),
  wh AS (SELECT count(*) AS n, avg(len(regexp_extract_all(lower(body), '[a-z0-9]+'))) AS avg_len FROM docs)"""
_BM = f"""{_TOK}, raw AS (SELECT token, ln(n - df + 0.5) - ln(df + 0.5) AS idf, avg_len FROM dfs, wh), mi AS (SELECT avg(idf) AS m FROM raw),
  w AS (SELECT token, CASE WHEN idf < 0 THEN 0.25::DOUBLE * m ELSE idf END AS idf, avg_len FROM raw, mi),
  q AS (SELECT question_id, token, count(*) AS times FROM (SELECT question_id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS token FROM retrieval_questions) GROUP BY ALL),
  sc AS (SELECT question_id, doc_id, sum(CAST(round(idf * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))) * 1000000) AS BIGINT) * times) AS score
    FROM q JOIN w USING (token) JOIN idx USING (token) GROUP BY ALL),
  rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sc)"""
_VEC = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  near AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(round(list_cosine_similarity(a.e, b.e) * 1000000) AS BIGINT) AS score FROM v a, v b WHERE a.vec_id % 100 = 0),
  nr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM near)"""
_REC = f"""{_BM}, gold AS (SELECT DISTINCT question_id, unnest(expected_doc_ids) AS item FROM retrieval_questions),
  hit AS (SELECT g.question_id, g.item, r.rank FROM gold g LEFT JOIN (SELECT question_id, dsid AS item, rank FROM rk JOIN docs USING (doc_id) WHERE rank <= {POOL}) r USING (question_id, item)),
  rec AS (SELECT question_id, count(*) FILTER (rank <= 5) / count(*) AS recall_5, count(*) FILTER (rank <= 10) / count(*) AS recall_10, coalesce(1.0::DOUBLE / min(rank), 0) AS reciprocal_rank, count(*) AS wanted FROM hit GROUP BY question_id)"""
_P = "trim(regexp_replace(lower(trim(coalesce({}, ''))), '\\s+', ' ', 'g'))"
_ABST = "(" + " OR ".join(f"contains({{0}}, '{m}')" for m in R.ABSTENTION) + ")"

ORACLES = {
    **{n: f"WITH {_BM} SELECT question_id, rank, doc_id FROM rk WHERE rank <= {POOL}" for n in ("R01_bm25", "R01_bm25_by_join")},
    "E25_token_statistics": f"WITH {_TOK} SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS occurrences FROM idx GROUP BY token",
    "R02_dense": f"WITH {_VEC} SELECT query_id, vec_id, score, rank FROM nr WHERE rank <= {POOL}",
    "F10_fusion": f"""WITH {_VEC}, lab AS (SELECT a.vec_id AS query_id, b.vec_id AS item, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY b.vec_id) AS INTEGER) AS rank FROM v a JOIN v b USING (label) WHERE a.vec_id % 100 = 0),
      both_ AS (SELECT query_id, vec_id AS item, rank FROM nr WHERE rank <= {POOL} UNION ALL SELECT * FROM lab WHERE rank <= {POOL}),
      f AS (SELECT query_id, item, sum(CAST(round(1000000000000.0::DOUBLE / (60 + rank - 1)) AS BIGINT)) AS score FROM both_ GROUP BY ALL)
      SELECT query_id, item, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS INTEGER) AS rank FROM f) WHERE rank <= {POOL}""",
    "F11_context": f"""WITH {_BM}, top AS (SELECT question_id, rank, doc_id, CAST(sum(n_chars) OVER (PARTITION BY question_id ORDER BY rank) AS BIGINT) AS used FROM rk JOIN docs USING (doc_id) WHERE rank <= {CUT})
      SELECT * FROM top WHERE used <= {BUDGET} OR rank = 1""",
    "E20_recall": f"WITH {_REC} SELECT question_id, round(recall_5, 6) AS recall_5, round(recall_10, 6) AS recall_10, round(reciprocal_rank, 6) AS reciprocal_rank, wanted FROM rec",
    "E21_category_breakdown": f"""WITH {_REC} SELECT question_type, count(*) AS questions, round(avg(recall_5), 4) AS recall_5, round(avg(recall_10), 4) AS recall_10, round(avg(reciprocal_rank), 4) AS mrr,
      round(quantile_cont(reciprocal_rank, 0.5), 4) AS median_rr FROM rec JOIN (SELECT question_id, question_type FROM retrieval_questions) USING (question_id) GROUP BY 1""",
    "D27_questions_in_corpus": "SELECT DISTINCT question_id FROM (SELECT question_id, unnest(expected_doc_ids) AS dsid FROM retrieval_questions) WHERE dsid IN (SELECT dsid FROM documents)",
    "I12_answer_match": f"""WITH a AS (SELECT question_id, {_P.format("CASE WHEN (length(question_id) + length(question)) % 3 = 0 THEN 'unknown' ELSE answer_facts[1] END")} AS a, {_P.format("gold_answer")} AS g FROM retrieval_questions)
      SELECT question_id, length(a) >= 2 AND g <> '' AND (contains(a, g) OR contains(g, a) OR ({_ABST.format("a")} AND {_ABST.format("g")}) OR
      (len(list_distinct(string_split(g, ' '))) >= 3 AND len(list_intersect(list_distinct(string_split(g, ' ')), list_distinct(string_split(a, ' ')))) / len(list_distinct(string_split(g, ' '))) >= 0.6)) AS correct FROM a""",
}
