"""Queries on listings, distributions, samples and formatted answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave import identity_queries, resolution_queries, state_queries
from factweave import retrieval_queries as Q
from factweave.operators import claims as C
from factweave.operators import contract
from factweave.operators import extract as X
from factweave.operators import graph as G
from factweave.operators import identity as I
from factweave.operators import inventory as V
from factweave.operators import resolution as R
from factweave.plans import formatting, rag
from factweave.sources.tables import table


def sweep(spark, folder):
    """Decisions of all rules at each merge threshold of a fixed short list."""
    p = identity_queries.pairs(spark, folder).withColumn("threshold", F.explode(F.array(*[F.lit(x / 100) for x in (55, 80, 85, 88, 90, 92, 97)])))
    d = I.decided(p, F.col("threshold")).withColumn("gold", I.gold(F.col("label"))).where("gold is not null")
    right = ((F.col("gold") == "SAME_ENTITY") & (F.col("decision") == "MERGE")) | ((F.col("gold") == "DIFFERENT_ENTITY") & (F.col("decision") == "KEEP_SEPARATE")) | ((F.col("gold") == "UNCERTAIN") & F.col("decision").isin("REVIEW", "ABSTAIN"))
    return d.groupBy("threshold").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(right).alias("right"), *[F.count_if(F.col("decision") == x).alias(x.lower()) for x in ("MERGE", "KEEP_SEPARATE", "REVIEW", "ABSTAIN")])


def split(spark, folder):
    """Pairs of each label dealt to a development and a test part, eight to two, by a hash."""
    p = identity_queries.pairs(spark, folder).select("pair_id", I.gold(F.col("label")).alias("gold")).where("gold is not null")
    ranked = V.top_per(p, ["gold"], [V.hash_order("pair_id", "split"), F.col("pair_id")], 2**31 - 1)
    return ranked.select("pair_id", "gold", F.when(F.col("rank") % 5 == 0, "test").otherwise("dev").alias("part"))


def answers(spark, folder):
    return state_queries.answers(spark, folder)


def days(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    return o.select("o_orderkey", F.date_sub("d", 1).alias("eve"), F.date_add("d", 1).alias("morrow"), F.next_day("d", "Mon").alias("monday"), F.trunc("d", "quarter").alias("quarter"), F.trunc("d", "month").alias("month"))


def codec(spark, folder):
    """Claims through JSON and back."""
    c = table(spark, folder, "claims_checkpoint50")
    back = c.select(F.from_json(F.to_json(F.struct("claim_id", "confidence", "valid_from", "metadata")), "claim_id string, confidence double, valid_from string, metadata map<string,string>").alias("x")).select("x.*")
    return back.groupBy("claim_id", "confidence", "valid_from").agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("metadata")).alias("entries"))


def shared_artifacts(spark, folder):
    """How alike the artifacts of two objects of one subject are."""
    c = table(spark, folder, "claims_checkpoint50").groupBy("subject_mention", "predicate").agg(F.array_sort(F.collect_set("artifact_id")).alias("a"))
    x, y = c.where("predicate = 'OWNS'").select("subject_mention", F.col("a").alias("x")), c.where("predicate = 'MAINTAINS'").select("subject_mention", F.col("a").alias("y"))
    return x.join(y, "subject_mention").select("subject_mention", F.round(R.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"), F.arrays_overlap("x", "y").alias("overlap"))


def hybrid(spark, folder):
    """Claims by patterns and by proposals; the claims table stands for a model."""
    c = table(spark, folder, "claims_checkpoint50").select("artifact_id", "subject_mention", F.upper("predicate").alias("predicate"), "object_mention", "confidence", "evidence_span")
    a = table(spark, folder, "artifacts").select("id", "title", "content").distinct()
    return X.extracted(a, "hybrid", c).groupBy("extraction_method", "predicate").agg(F.count(F.lit(1)).alias("claims"))


def hard(spark, folder):
    e = resolution_queries.entries(spark, folder)
    return R.hard_pairs(e.select("norm", "type", F.regexp_extract_all("norm", F.lit("[a-z]{2,5}-[0-9]+"), F.lit(0)).alias("tickets"), F.coalesce(I.is_role(F.col("norm")), F.lit(False)).alias("role"))).groupBy("how").agg(F.count(F.lit(1)).alias("pairs"))


def structured(spark, folder):
    q = table(spark, folder, "retrieval_questions").select("question_id", "question")
    known = q.select("question_id", F.when(F.col("question_id") < "qst_0050", "found").otherwise("absent").alias("status"), F.lit("graph").alias("answer"))
    return rag.structured(Q.corpus(spark, folder).select("doc_id", "body"), q, known).groupBy("from_graph").agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.col("answer") == "graph").alias("graph_answers"))


QUERIES = {
    "D20_hard_pairs": hard,
    "D32_entity_evidence": lambda s, d: R.evidence_of(resolution_queries.entities(s, d), table(s, d, "claims_checkpoint50")),
    "K03_hybrid_claims": hybrid,
    "R06_structured": structured,
    "R12_gold_sample": lambda s, d: rag.gold_sample(table(s, d, "artifacts"), 5).select("id", "source", "size", "rank"),
    "B35_answer_lines": lambda s, d: answers(s, d).select("question_id", formatting.answer_line(F.col("status"), F.col("answer"), F.col("confidence")).alias("line")),
    "B36_traces": lambda s, d: formatting.trace(answers(s, d)),
    "B39_codecs": codec,
    "C17_other_subjects": lambda s, d: C.order_claims(s, d).where("subject_id <> 'person:1'").select("claim_id"),
    "C18_guarded": lambda s, d: C.order_claims(s, d).where(F.col("predicate") == contract.guarded("OWNS")).select("claim_id"),
    "D03_claims_about": lambda s, d: G.about(C.order_claims(s, d), table(s, d, "customer").select(F.concat(F.lit("account:"), F.col("c_custkey")).alias("object_id")).where("object_id like '%7'")).select("object_id", "predicate", "seq", "claim_id"),
    "D12_edge_history_ordered": lambda s, d: G.edge_history(G.edges(C.order_claims(s, d))),
    "D13_hops_out": lambda s, d: G.hops(G.edges(state_queries.supplier_claims(s, d)), True),
    "D13_hops_in": lambda s, d: G.hops(G.edges(state_queries.supplier_claims(s, d)), False),
    "E06_corpus_scan": lambda s, d: V.scanned(table(s, d, "documents").withColumn("source", F.lower("source")), "source", "text"),
    "E15_sweep_decisions": sweep,
    "E16_histograms": lambda s, d: V.histogram(I.features(identity_queries.pairs(s, d)), ["email_match", "email_username_match", "external_id_match", "username_match", "name_similarity"]),
    "E18_nearest_ranks": lambda s, d: V.nearest_ranks(table(s, d, "events"), "event_type", "value"),
    "F14_by_size": lambda s, d: V.top_per(table(s, d, "documents").select("doc_id", V.size_bucket(F.length(F.coalesce("text", F.lit("")))).alias("size")), ["size"], [V.hash_order("doc_id", "s2"), F.col("doc_id")], 15),
    "F14_label_split": split,
    "G06_capped_claims": lambda s, d: V.top_per(table(s, d, "claims_checkpoint50").select("artifact_id", "claim_id", "confidence").distinct(), ["artifact_id"], [F.desc("confidence"), F.col("claim_id")], 3),
    "G08_pending": lambda s, d: table(s, d, "events").where("event_type = 'error'").select("event_id", "ts").orderBy("ts", "event_id").limit(50).select("event_id"),
    "H06_jaccard": shared_artifacts,
    "I15_days": days,
}

_W, _SUP = state_queries._W, state_queries._SUP
_D = identity_queries._F
_DEC = _D[_D.index("d AS (SELECT *") :].replace("score >= 0.9 THEN", "score >= threshold THEN").replace("FROM de)", "FROM de, th)")
_SWEEP = _D[: _D.index("d AS (SELECT *")] + "th AS (SELECT unnest([0.55, 0.8, 0.85, 0.88, 0.9, 0.92, 0.97]::DOUBLE[]) AS threshold), " + _DEC
_ANS = state_queries.ORACLES["M10_answers"]
_LABEL = "CASE WHEN confidence >= 0.9 THEN 'High' WHEN confidence >= 0.7 THEN 'Medium' ELSE 'Low' END"
_NAMES = ("email_match", "email_username_match", "external_id_match", "username_match", "name_similarity")

ORACLES = {
    "R06_structured": "SELECT question_id < 'qst_0050' AS from_graph, count(*) AS questions, count(*) FILTER (question_id < 'qst_0050') AS graph_answers FROM retrieval_questions GROUP BY 1",
    "R12_gold_sample": "WITH a AS (SELECT id, min(struct_pack(s := source, n := length(coalesce(content, '')))) AS x FROM artifacts WHERE id IS NOT NULL GROUP BY id), b AS (SELECT id, x.s AS source, CASE WHEN x.n < 400 THEN 'short' WHEN x.n > 8000 THEN 'long' ELSE 'medium' END AS size FROM a) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source, size ORDER BY md5('gold|' || id), id) AS INTEGER) AS rank FROM b) WHERE rank <= 5",
    "B35_answer_lines": f"SELECT question_id, CASE status WHEN 'found' THEN answer || ' (' || {_LABEL} || ' confidence)' WHEN 'conflict' THEN 'Sources disagree.' ELSE 'Nothing is known about this.' END AS line FROM ({_ANS})",
    "B36_traces": f"SELECT question_id, concat_ws(' ', {', '.join(f"'{c}=' || coalesce(CAST({c} AS VARCHAR), '-')" for c in ('route', 'entity', 'predicate', 'day', 'status', 'subject_id'))}) AS trace FROM ({_ANS})",
    "B39_codecs": "SELECT claim_id, confidence, valid_from, count(*) AS rows, CAST(max(cardinality(metadata)) AS INTEGER) AS entries FROM claims_checkpoint50 GROUP BY 1, 2, 3",
    "C17_other_subjects": f"{_W} SELECT claim_id FROM claims WHERE subject_id <> 'person:1'",
    "C18_guarded": f"{_W} SELECT claim_id FROM claims WHERE predicate = 'OWNS'",
    "D03_claims_about": f"{_W} SELECT object_id, predicate, row_number() OVER (PARTITION BY object_id, predicate ORDER BY observed_at, claim_id) AS seq, claim_id FROM claims WHERE object_id LIKE '%7'",
    "D12_edge_history_ordered": f"{_W} SELECT subject_id AS src, object_id AS dst, predicate AS rel, row_number() OVER (PARTITION BY subject_id, object_id, predicate ORDER BY valid_from, valid_to) AS seq, valid_from, valid_to FROM claims",
    "D13_hops_out": f"{_SUP} SELECT DISTINCT subject_id AS node, predicate AS rel, object_id AS neighbour FROM claims",
    "D13_hops_in": f"{_SUP} SELECT DISTINCT object_id AS node, predicate AS rel, subject_id AS neighbour FROM claims",
    "E06_corpus_scan": f"""WITH d AS (SELECT doc_id, lower(source) AS source, coalesce(text, '') AS t, row_number() OVER (PARTITION BY lower(source) ORDER BY doc_id) AS rn FROM documents) SELECT source, count(*) AS files, CAST(sum(octet_length(encode(t))) AS BIGINT) AS bytes, CAST(min(length(t)) AS INTEGER) AS shortest, CAST(max(length(t)) AS INTEGER) AS longest,
      count(*) FILTER (regexp_matches(t, '(?m)^(From|Date|Subject):')) AS with_headers, count(*) FILTER (regexp_matches(t, '{V.QUALITY['tickets']}')) AS with_tickets, count(*) FILTER (regexp_matches(t, '{V.QUALITY['emails']}')) AS with_addresses, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (rn <= 6) AS first_ids FROM d GROUP BY 1""",
    "E15_sweep_decisions": f"""WITH {_SWEEP} SELECT threshold, count(*) AS pairs, count(*) FILTER ((gold = 'SAME_ENTITY' AND decision = 'MERGE') OR (gold = 'DIFFERENT_ENTITY' AND decision = 'KEEP_SEPARATE') OR (gold = 'UNCERTAIN' AND decision IN ('REVIEW', 'ABSTAIN'))) AS right, count(*) FILTER (decision = 'MERGE') AS merge, count(*) FILTER (decision = 'KEEP_SEPARATE') AS keep_separate,
      count(*) FILTER (decision = 'REVIEW') AS review, count(*) FILTER (decision = 'ABSTAIN') AS abstain FROM d WHERE gold IS NOT NULL GROUP BY 1""",
    "E16_histograms": f"WITH {_D}, n AS (SELECT *, {identity_queries._NS} AS name_similarity FROM f), u AS ({' UNION ALL '.join(f"SELECT '{n}' AS feature, {n} AS value FROM n" for n in _NAMES)}) SELECT feature, CAST(least(floor(value * 10), 9) AS INTEGER) AS bin, count(*) AS n FROM u WHERE value IS NOT NULL GROUP BY 1, 2",
    "E18_nearest_ranks": "WITH v AS (SELECT event_type, list_sort(list(value)) AS l FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT event_type, len(l) AS n, l[greatest(CAST(floor(len(l) * 0.5) AS BIGINT), 1)] AS p50, l[greatest(CAST(floor(len(l) * 0.95) AS BIGINT), 1)] AS p95 FROM v",
    "F14_by_size": "WITH d AS (SELECT doc_id, CASE WHEN length(coalesce(text, '')) < 400 THEN 'short' WHEN length(text) > 8000 THEN 'long' ELSE 'medium' END AS size FROM documents) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY size ORDER BY md5('s2|' || doc_id), doc_id) AS INTEGER) AS rank FROM d) WHERE rank <= 15",
    "F14_label_split": f"WITH {_D}, r AS (SELECT pair_id, gold, row_number() OVER (PARTITION BY gold ORDER BY md5('split|' || pair_id), pair_id) AS rn FROM d WHERE gold IS NOT NULL) SELECT pair_id, gold, CASE WHEN rn % 5 = 0 THEN 'test' ELSE 'dev' END AS part FROM r",
    "G06_capped_claims": "WITH c AS (SELECT DISTINCT artifact_id, claim_id, confidence FROM claims_checkpoint50) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY artifact_id ORDER BY confidence DESC, claim_id) AS INTEGER) AS rank FROM c) WHERE rank <= 3",
    "G08_pending": "SELECT event_id FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 50",
    "H06_jaccard": "WITH c AS (SELECT subject_mention, predicate, list_distinct(list(artifact_id)) AS a FROM claims_checkpoint50 GROUP BY 1, 2) SELECT x.subject_mention, round(len(list_intersect(x.a, y.a)) / len(list_distinct(list_concat(x.a, y.a))), 6) AS jaccard, list_has_any(x.a, y.a) AS overlap FROM c x JOIN c y USING (subject_mention) WHERE x.predicate = 'OWNS' AND y.predicate = 'MAINTAINS'",
    "I15_days": "SELECT o_orderkey, CAST(d - 1 AS DATE) AS eve, CAST(d + 1 AS DATE) AS morrow, CAST(d + CAST(8 - isodow(d) AS INTEGER) AS DATE) AS monday, CAST(date_trunc('quarter', d) AS DATE) AS quarter, CAST(date_trunc('month', d) AS DATE) AS month FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)",
}
