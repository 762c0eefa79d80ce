"""Queries on scores, failures and answering systems, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave import retrieval_queries as Q
from factweave import state_queries
from factweave.functions.text import mention_key
from factweave.operators import evaluation as E
from factweave.operators import questions
from factweave.operators.claims import order_claims
from factweave.plans import rag
from factweave.sources.tables import table


def claims(spark, folder):
    c = table(spark, folder, "claims_checkpoint50")
    return c.select("artifact_id", "extraction_method", "confidence", F.concat_ws("|", mention_key(F.col("subject_mention")), F.upper("predicate"), mention_key(F.col("object_mention"))).alias("item"))


def gold(spark, folder):
    """What the other methods found is the gold of the deterministic one; doubtful items are ambiguous."""
    g = claims(spark, folder).where("extraction_method <> 'deterministic'")
    return g.select("artifact_id", F.when(F.col("confidence") < 0.6, "AMBIGUOUS").otherwise("VALID").alias("status"), "item").distinct()


def predicted(spark, folder):
    return claims(spark, folder).where("extraction_method = 'deterministic'").select("artifact_id", "item").distinct()


def ambiguities(spark, folder):
    return claims(spark, folder).where("confidence > 0.97").select("artifact_id", F.lit("AMBIGUOUS").alias("status")).distinct()


def expected(spark, folder):
    return E.expectation(table(spark, folder, "artifacts").select(F.col("id").alias("artifact_id")), gold(spark, folder), ambiguities(spark, folder))


def corpus(spark, folder):
    return Q.corpus(spark, folder).select("doc_id", "body")


def asked(spark, folder):
    return table(spark, folder, "retrieval_questions").select("question_id", "question")


def results(spark, folder, system="bm25"):
    """Answers of a system with what was wanted; documents by the ids that questions use."""
    got = rag.run(system, corpus(spark, folder), asked(spark, folder))
    names = table(spark, folder, "documents").select("doc_id", "dsid")
    ids = got.select("question_id", F.explode("doc_ids").alias("doc_id")).join(names, "doc_id").groupBy("question_id").agg(F.array_sort(F.collect_list("dsid")).alias("retrieved"))
    want = table(spark, folder, "retrieval_questions").select("question_id", "question_type", "gold_answer", F.col("expected_doc_ids").alias("wanted"))
    rows = want.join(got, "question_id").join(ids, "question_id", "left").withColumn("retrieved", F.coalesce("retrieved", F.array().cast("array<string>")))
    return rows.withColumns({"hit": F.arrays_overlap("retrieved", "wanted"), "right": E.answers_match(F.col("answer"), F.col("gold_answer"))})


def failures(spark, folder):
    r = results(spark, folder).where(~F.col("right"))
    kind = E.retrieval_failure(F.col("answer"), F.col("gold_answer"), F.col("retrieved"), F.col("wanted"), F.lit(None).cast("string"))
    return E.failure_summary(r.withColumn("kind", kind), "question_type", "kind", "question_id")


def answer_classes(spark, folder):
    a = state_queries.answers(spark, folder)
    scope = order_claims(spark, folder).groupBy(F.col("object_id").alias("entity")).agg(F.count(F.lit(1)).alias("scope"))
    intent = questions.intent(state_queries._asked())
    c = table(spark, folder, "customer").select("c_custkey").select(F.col("c_custkey").alias("question_id"), intent.alias("intent"))
    met = a.join(c, "question_id").join(scope, "entity", "left")
    return met.groupBy("route", E.answer_class(F.col("intent"), F.col("status"), F.col("route"), F.col("answer"), F.coalesce("scope", F.lit(0))).alias("kind")).agg(F.count(F.lit(1)).alias("questions"))


def matches(spark, folder):
    q = table(spark, folder, "retrieval_questions")
    n = F.substring("question_id", 5, 4).cast("int")
    got = F.when(n % 5 == 0, F.concat(F.lit("Well: "), "gold_answer")).when(n % 5 == 1, "abstain, no data").when(n % 5 == 2, "Same person").when(n % 5 == 3, "2024-05-06T10").otherwise("no")
    want = F.when(n % 10 < 5, F.concat(F.lit("zzz|"), "gold_answer")).when(n % 5 == 1, "should abstain").when(n % 5 == 2, "the same").when(n % 5 == 3, "2024-05-06 or so").otherwise("yes")
    return q.select("question_id", E.tolerant_match(got, want).alias("matches"))


def tags(spark, folder):
    c = table(spark, folder, "claims_checkpoint50").groupBy("artifact_id").agg(F.count(F.lit(1)).alias("n"))
    a = table(spark, folder, "artifacts").groupBy("id").agg(F.min(F.struct("source", "title", "content")).alias("x")).select("id", "x.*").join(c, F.col("id") == F.col("artifact_id"), "left")
    n = F.coalesce("n", F.lit(0))
    return a.select("id", F.array_join(E.difficulty(F.col("title"), F.col("content"), F.col("source"), n * 3, n), ",").alias("tags"))


QUERIES = {
    "D29_enriched_gold": lambda s, d: E.enriched(gold(s, d).unionByName(expected(s, d).where("expected = 'NO_CLAIM'").select("artifact_id", F.lit("NO_CLAIM").alias("status"), F.lit("").alias("item"))), predicted(s, d)).groupBy("status").agg(F.count(F.lit(1)).alias("rows")),
    "E12_abstention_scores": lambda s, d: E.abstention_scores(predicted(s, d), gold(s, d), expected(s, d)),
    "E12_strict_scores": lambda s, d: E.strict_scores(predicted(s, d), gold(s, d)),
    "E13_expectation": lambda s, d: expected(s, d).groupBy("expected").agg(F.count(F.lit(1)).alias("artifacts")),
    "E17_retrieval_scores": lambda s, d: E.retrieval_scores(results(s, d)),
    "E19_percentiles": lambda s, d: table(s, d, "events").groupBy("event_type").agg(*[F.round(F.percentile("value", p), 6).alias(n) for n, p in (("p10", 0.1), ("p33", 0.33), ("p90", 0.9))]),
    "E21_outcome_matrix": lambda s, d: E.outcome_matrix(results(s, d)),
    "E21_integrity": lambda s, d: E.integrity(asked(s, d).union(asked(s, d).where("question_id < 'qst_0007'")).union(s.createDataFrame([("x", "y")], "question_id string, question string")), asked(s, d).union(s.createDataFrame([("z", "y")], "question_id string, question string")), "question_id"),
    "E22_failures": failures,
    "E22_answer_classes": answer_classes,
    "E23_coverage": lambda s, d: E.coverage_rates(results(s, d).withColumn("some", F.size("retrieved") > 0), ["some", "hit", "right"]),
    "I13_tolerant_match": matches,
    "I21_difficulty": tags,
    "R03_hybrid": lambda s, d: rag.search("hybrid", corpus(s, d), asked(s, d), 10),
    "R04_hashed_vectors": lambda s, d: rag.hashed_vectors(corpus(s, d), "doc_id", "body").select("doc_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda x, y: x + y * y), 6).alias("norm")),
    "R05_bm25_answers": lambda s, d: results(s, d).select("question_id", "answer", F.array_join("doc_ids", ",").alias("doc_ids"), "context_chars"),
    "R05_dense_answers": lambda s, d: results(s, d, "dense").select("question_id", "answer", F.array_join("doc_ids", ",").alias("doc_ids")),
    "R08_resumed_run": lambda s, d: rag.run("bm25", corpus(s, d), asked(s, d), asked(s, d).where("question_id < 'qst_0200'")).select("question_id", "system", "answer"),
    "R09_snippets": lambda s, d: rag.snippets(corpus(s, d), asked(s, d)),
}

_K = "lower(trim(regexp_replace(trim(regexp_replace({}, '\\s+', ' ', 'g')), '^@', '')))"
_C = f"""c AS (SELECT artifact_id, extraction_method AS x, confidence, {_K.format('subject_mention')} || '|' || upper(predicate) || '|' || {_K.format('object_mention')} AS item FROM claims_checkpoint50), g AS (SELECT DISTINCT artifact_id, CASE WHEN confidence < 0.6 THEN 'AMBIGUOUS' ELSE 'VALID' END AS status, item FROM c WHERE x <> 'deterministic'),
  p AS (SELECT DISTINCT artifact_id, item FROM c WHERE x = 'deterministic'), am AS (SELECT DISTINCT artifact_id FROM c WHERE confidence > 0.97), v AS (SELECT DISTINCT artifact_id, item FROM g WHERE status = 'VALID'),
  ex AS (SELECT DISTINCT id AS artifact_id, CASE WHEN id IN (SELECT artifact_id FROM v) THEN 'VALID' WHEN id IN (SELECT artifact_id FROM am) OR id IN (SELECT artifact_id FROM g WHERE status = 'AMBIGUOUS') THEN 'AMBIGUOUS' ELSE 'NO_CLAIM' END AS expected FROM artifacts)"""
_PRF = "round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 4) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 4) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 4) AS f1"
_RAG = f"""{Q._BM}, hit AS (SELECT question_id, rank, doc_id, '[' || doc_id || ']' || chr(10) || body AS piece, dsid, body FROM rk JOIN docs USING (doc_id) WHERE rank <= {rag.TOP}), fit AS (SELECT *, sum(length(piece)) OVER (PARTITION BY question_id ORDER BY rank) AS used FROM hit),
  ctx AS (SELECT question_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS doc_ids, CAST(max(used) AS BIGINT) AS context_chars, list_sort(list(dsid)) AS retrieved, 'mock: ' || left(split_part(first(body ORDER BY rank), chr(10), 1), 120) AS answer FROM fit WHERE used <= {rag.BUDGET} OR rank = 1 GROUP BY 1),
  rs AS (SELECT question_id, question_type, gold_answer, expected_doc_ids AS wanted, coalesce(answer, 'unknown') AS answer, doc_ids, coalesce(context_chars, 0) AS context_chars, coalesce(retrieved, []) AS retrieved FROM retrieval_questions LEFT JOIN ctx USING (question_id)),
  m AS (SELECT *, {Q._P.format('answer')} AS a, {Q._P.format('gold_answer')} AS gg, list_has_any(retrieved, wanted) AS hit FROM rs),
  r AS (SELECT *, length(a) >= 2 AND gg <> '' AND (contains(a, gg) OR contains(gg, a) OR ({Q._ABST.format('a')} AND {Q._ABST.format('gg')}) OR (len(list_distinct(string_split(gg, ' '))) >= 3 AND len(list_intersect(list_distinct(string_split(gg, ' ')), list_distinct(string_split(a, ' ')))) / len(list_distinct(string_split(gg, ' '))) >= 0.6)) AS ok FROM m)"""
_TAG = {
    "ownership": r"\b(owns|owner|ownership|account exec)\b", "assignment": r"\b(assigned|assignee|assigned to)\b", "leadership": r"\b(leads|leadership|director|head of)\b", "maintenance": r"\b(maintains|maintenance|on-call|sre)\b",
    "dependencies": r"\b(depends on|blocked by|blocks)\b", "conflicts": r"\b(conflict|contradict|disagree)\b", "temporal": r"\b(effective|until|as of|starting|by q[1-4])\b",
}

ORACLES = {
    "D29_enriched_gold": f"WITH {_C}, n AS (SELECT * FROM p WHERE (artifact_id, item) NOT IN (SELECT artifact_id, item FROM v)), a AS (SELECT artifact_id, status FROM g UNION ALL SELECT artifact_id, 'NO_CLAIM' FROM ex WHERE expected = 'NO_CLAIM' AND artifact_id NOT IN (SELECT artifact_id FROM n) UNION ALL SELECT artifact_id, 'VALID' FROM n) SELECT status, count(*) AS rows FROM a GROUP BY 1",
    "E12_abstention_scores": f"""WITH {_C}, f AS (SELECT coalesce(p.artifact_id, v.artifact_id) AS artifact_id, p.item AS p, v.item AS g FROM p FULL JOIN v ON p.artifact_id = v.artifact_id AND p.item = v.item), n AS (SELECT expected, artifact_id, count(p) FILTER (g IS NOT NULL) AS tp, count(p) FILTER (g IS NULL) AS fp, count(g) FILTER (p IS NULL) AS fn, count(p) AS n FROM ex LEFT JOIN f USING (artifact_id) GROUP BY ALL),
      s AS (SELECT CAST(sum(tp) FILTER (expected = 'VALID') AS BIGINT) AS tp, CAST(sum(CASE expected WHEN 'VALID' THEN fp WHEN 'NO_CLAIM' THEN n ELSE 0 END) AS BIGINT) AS fp, CAST(sum(fn) FILTER (expected = 'VALID') AS BIGINT) AS fn, count(*) FILTER (expected = 'NO_CLAIM' AND n = 0) AS tn, count(*) FILTER (expected = 'AMBIGUOUS') AS ambiguous FROM n)
      SELECT {_PRF}, tp, fp, fn, tn, round(tn / (tn + fp), 4) AS abstention_precision, ambiguous FROM s""",
    "E12_strict_scores": f"WITH {_C}, q AS (SELECT * FROM p WHERE artifact_id IN (SELECT artifact_id FROM v)), s AS (SELECT count(*) FILTER (q.item IS NOT NULL AND v.item IS NOT NULL) AS tp, count(*) FILTER (v.item IS NULL) AS fp, count(*) FILTER (q.item IS NULL) AS fn FROM q FULL JOIN v ON q.artifact_id = v.artifact_id AND q.item = v.item) SELECT tp, fp, fn, {_PRF} FROM s",
    "E13_expectation": f"WITH {_C} SELECT expected, count(*) AS artifacts FROM ex GROUP BY 1",
    "E17_retrieval_scores": f"WITH {_RAG} SELECT count(*) AS questions, round(avg(CAST(ok AS INTEGER)), 4) AS correct, round(avg(CASE WHEN len(wanted) > 0 THEN len(list_intersect(retrieved, wanted)) / len(list_distinct(wanted)) END), 4) AS recall, round(avg(len(list_filter(list_distinct(retrieved), lambda x: NOT list_contains(wanted, x)))), 4) AS extra FROM r",
    "E19_percentiles": "SELECT event_type, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.33), 6) AS p33, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1",
    "E21_outcome_matrix": f"WITH {_RAG} SELECT hit AS retrieved, count(*) FILTER (ok) AS correct, count(*) FILTER (NOT ok) AS wrong FROM r GROUP BY 1",
    "E21_integrity": "SELECT count(*) + 1 + count(*) FILTER (question_id < 'qst_0007') AS results, count(*) + 1 AS ids, count(*) FILTER (question_id < 'qst_0007') AS repeated, 1 AS unknown, 1 AS missing FROM retrieval_questions",
    "E22_failures": f"""WITH {_RAG}, k AS (SELECT question_type, question_id, CASE WHEN len(retrieved) = 0 OR (len(wanted) > 0 AND NOT hit) THEN 'RETRIEVAL_FAILURE' WHEN len(wanted) > 0 AND len(list_filter(list_distinct(retrieved), lambda x: NOT list_contains(wanted, x))) > len(wanted) THEN 'CONTEXT_NOISE'
      WHEN {Q._ABST.format('gg')} AND NOT contains(a, 'not found') AND NOT contains(a, 'unknown') THEN 'ABSTENTION_FAILURE' ELSE 'ANSWER_GENERATION_FAILURE' END AS kind FROM r WHERE NOT ok) SELECT question_type, kind, count(*) AS failures, array_to_string(list_slice(list_sort(list(question_id)), 1, 5), ',') AS examples FROM k GROUP BY 1, 2""",
    "E23_coverage": f"WITH {_RAG} SELECT count(*) AS rows, round(avg(CAST(len(retrieved) > 0 AS INTEGER)), 4) AS some, round(avg(CAST(hit AS INTEGER)), 4) AS hit, round(avg(CAST(ok AS INTEGER)), 4) AS right FROM r",
    "I13_tolerant_match": "SELECT question_id, CASE CAST(substr(question_id, 5, 4) AS INTEGER) % 10 WHEN 0 THEN true WHEN 6 THEN true WHEN 7 THEN true WHEN 8 THEN true ELSE false END AS matches FROM retrieval_questions",
    "I21_difficulty": f"""WITH a AS (SELECT id, min(struct_pack(s := source, t := title, c := content)) AS x FROM artifacts GROUP BY id), n AS (SELECT artifact_id, count(*) AS n FROM claims_checkpoint50 GROUP BY 1), t AS (SELECT id, x.s AS s, coalesce(x.c, '') AS c, lower(coalesce(x.t, '') || chr(10) || coalesce(x.c, '')) AS t, coalesce(n, 0) AS n FROM a LEFT JOIN n ON id = artifact_id)
      SELECT id, array_to_string(list_sort(list_filter([CASE WHEN length(c) > 8000 THEN 'long_artifact' WHEN length(c) < 400 THEN 'short_artifact' END, CASE WHEN s = 'slack' AND length(c) - length(replace(c, chr(10), '')) > 20 THEN 'messy_thread' END, {', '.join(f"CASE WHEN regexp_matches(t, '{p}') THEN '{k}' END" for k, p in _TAG.items())},
      CASE WHEN n * 3 >= 6 THEN 'multi_entity' END, CASE WHEN n = 0 AND NOT regexp_matches(t, '{_TAG['dependencies']}') THEN 'no_relationship' END], lambda v: v IS NOT NULL)), ',') AS tags FROM t""",
    "R05_bm25_answers": f"WITH {_RAG} SELECT question_id, answer, coalesce(doc_ids, '') AS doc_ids, context_chars FROM rs",
    "R08_resumed_run": f"WITH {_RAG} SELECT question_id, 'bm25' AS system, answer FROM rs WHERE question_id >= 'qst_0200'",
    "R09_snippets": f"WITH {Q._BM} SELECT question_id, rank AS place, doc_id, left(trim(regexp_replace(body, '\\s+', ' ', 'g')), 220) AS snippet FROM rk JOIN docs USING (doc_id) WHERE rank <= 4",
    "R04_hashed_vectors": "SELECT doc_id, CASE WHEN regexp_matches(lower(coalesce(title, '') || ' ' || coalesce(text, '')), '[a-z0-9]') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents",
}
