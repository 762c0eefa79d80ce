"""Queries that load the claim graph and read it back, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave import contract_queries as K
from factweave.operators import claims as C
from factweave.operators import inventory as V
from factweave.plans.lineage import shared_dir
from factweave.sources import files
from factweave.sources.store import GraphStore
from factweave.sources.tables import table


def loaded(spark, folder, times: int = 1) -> tuple[GraphStore, dict]:
    """The artifacts, entities and claims of the test tables; the claims loaded several times, which changes nothing."""
    g = GraphStore(spark, shared_dir(spark, "graph"))
    g.load_artifacts(table(spark, folder, "artifacts").select("id", "source", "type", "title", "timestamp", "content").unionByName(spark.createDataFrame([("artifact:untimed",) + (None,) * 5], "id string, source string, type string, title string, timestamp string, content string")))
    r = K.resolvable(spark, folder)
    g.load_entities(r.groupBy(F.col("entity").alias("entity_key")).agg(F.min("mention").alias("name"), F.min("label").alias("label"), F.array_sort(F.collect_set("mention")).alias("mentions"), F.array().cast("array<string>").alias("aliases")))
    c = K.damaged(spark, folder)
    for _ in range(times):
        codes = g.load_claims(c, r)
    return g, codes


def codes(spark, folder):
    return spark.createDataFrame(sorted(loaded(spark, folder, 2)[1].items()), "status string, claims long")


def wiped(spark, folder):
    """Claims per predicate after all services have been wiped."""
    g, _ = loaded(spark, folder)
    doomed = [r[0] for r in g.read("entities").where("label = 'Service'").orderBy("entity_key").limit(5).select("entity_key").collect()]
    g.wipe(doomed)
    return g.read("claims").groupBy("predicate").agg(F.count(F.lit(1)).alias("claims"))


def asked(spark, folder):
    """Claims of all predicates but one, as a statement with parameters."""
    g, _ = loaded(spark, folder)
    return g.execute("SELECT predicate, count(*) AS claims FROM {claims} WHERE predicate <> :predicate AND valid_from > :day GROUP BY predicate", predicate="OWNS", day="2024-01-01")


def slices(spark, folder):
    """A retrieval slice: some documents of each source and all that are wanted, texts collapsed and cut."""
    d = table(spark, folder, "documents").withColumn("source", F.lower(F.trim("source")))
    some = V.top_per(d.select("doc_id", "dsid", "source"), ["source"], [V.hash_order("doc_id", "slice"), F.col("doc_id")], 30).select("doc_id")
    wanted = table(spark, folder, "retrieval_questions").select(F.explode("expected_doc_ids").alias("dsid")).distinct()
    kept = some.union(d.join(wanted, "dsid", "left_semi").select("doc_id")).distinct()
    return d.join(kept, "doc_id", "left_semi").select("doc_id", "source", F.left(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")), F.lit(1400)).alias("text"))


def frozen(spark, folder):
    """An immutable checkpoint: rows written once, their number and the checksums of their files read back."""
    at = shared_dir(spark, "checkpoint")
    files.write_jsonl(table(spark, folder, "retrieval_questions").select("question_id", "question", "gold_answer"), at)
    sums = files.checksums(spark, at).where("file like '%.json'")
    rows = files.read_jsonl(spark, at, "question_id string, question string, gold_answer string")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("question_id").alias("ids")).crossJoin(F.broadcast(sums.agg(F.count_if(F.col("sha256").rlike("^[0-9a-f]{64}$")).alias("k")).select((F.col("k") > 0).alias("summed"))))


def resumed(spark, folder):
    """A run that stopped half way goes on with the questions that have no result yet."""
    q = table(spark, folder, "retrieval_questions").select("question_id")
    at = shared_dir(spark, "results")
    files.write_jsonl(q.where("question_id < 'qst_0100'"), at)
    done = files.read_jsonl(spark, at, "question_id string", strict=False)
    files.write_jsonl(q.join(done, "question_id", "left_anti"), at, append=True)
    return files.read_jsonl(spark, at, "question_id string").groupBy("question_id").agg(F.count(F.lit(1)).alias("results"))


QUERIES = {
    "A28_artifact_nodes": lambda s, d: loaded(s, d)[0].read("artifacts").groupBy("source").agg(F.count(F.lit(1)).alias("artifacts"), F.count_distinct("number").alias("numbers")),
    "A30_load_codes": codes,
    "A30_claim_nodes": lambda s, d: loaded(s, d)[0].read("claims").select("claim_id", "subject_id", "predicate", "object_id", "observed_at", "valid_from", "valid_to"),
    "A30_edges": lambda s, d: loaded(s, d)[0].edges().groupBy("rel").agg(F.count(F.lit(1)).alias("edges")),
    "A32_wipe": wiped,
    "A33_entity_rows": lambda s, d: loaded(s, d)[0].read("entities").select("entity_key", "name", "label", F.size("mentions").alias("mentions")),
    "A34_statement": asked,
    "A35_resume": resumed,
    "A39_retrieval_slice": slices,
    "A40_checkpoint": frozen,
    "C16_number_range": lambda s, d: loaded(s, d)[0].numbered("claims", 2**48, 2**49 - 1).agg(F.count(F.lit(1)).alias("claims")),
    "D16_optional_neighbours": lambda s, d: loaded(s, d)[0].neighbourhood(),
}

_G = f"WITH {K._DAMAGED}, {K._gate('dam')}"
_N = f"""{_G}, n AS (SELECT claim_id, arg_max(s, o) AS s FROM (SELECT claim_id, {{'subject_id': subject_id, 'predicate': predicate, 'object_id': object_id, 'o': coalesce(CAST(try_cast(left(nullif(observed_at, ''), 10) AS DATE) AS DATE), try_cast(left(atime, 10) AS DATE)),
  'f': try_cast(left(nullif(valid_from, ''), 10) AS DATE), 't': try_cast(left(nullif(valid_to, ''), 10) AS DATE)}} AS s, 1 AS o FROM gated LEFT JOIN art ON aid = artifact_id WHERE status = 'PASS') GROUP BY 1),
  cn AS (SELECT claim_id, s.subject_id AS subject_id, s.predicate AS predicate, s.object_id AS object_id, s.o AS observed_at, coalesce(s.f, CASE WHEN s.t IS NOT NULL THEN DATE '0001-01-01' END, s.o) AS valid_from, coalesce(s.t, DATE '9999-12-31') AS valid_to FROM n)"""

ORACLES = {
    "A28_artifact_nodes": "WITH a AS (SELECT id, any_value(source) AS source FROM artifacts GROUP BY id UNION ALL SELECT 'artifact:untimed', NULL) SELECT source, count(*) AS artifacts, count(*) AS numbers FROM a GROUP BY 1",
    "A30_load_codes": f"{_G} SELECT status, count(*) AS claims FROM gated GROUP BY 1 UNION ALL SELECT 'stored', count(DISTINCT claim_id) FROM gated WHERE status = 'PASS'",
    "A30_claim_nodes": f"{_N} SELECT claim_id, subject_id, predicate, object_id, observed_at, valid_from, valid_to FROM cn",
    "A30_edges": f"{_N}, e AS (SELECT claim_id AS src, object_id AS dst, 'ABOUT' AS rel, NULL AS f, NULL AS t FROM cn UNION SELECT claim_id, (SELECT max(artifact_id) FROM gated g WHERE g.claim_id = cn.claim_id AND status = 'PASS'), 'SOURCED_FROM', NULL, NULL FROM cn UNION SELECT subject_id, object_id, predicate, valid_from, valid_to FROM cn) SELECT rel, count(*) AS edges FROM e GROUP BY 1",
    "A32_wipe": f"{_N}, w AS (SELECT DISTINCT entity FROM res WHERE label = 'Service' ORDER BY 1 LIMIT 5) SELECT predicate, count(*) AS claims FROM cn WHERE subject_id NOT IN (SELECT entity FROM w) AND object_id NOT IN (SELECT entity FROM w) GROUP BY 1",
    "A33_entity_rows": f"WITH {K._RES} SELECT entity AS entity_key, min(mention) AS name, min(label) AS label, CAST(count(DISTINCT mention) AS INTEGER) AS mentions FROM res GROUP BY 1",
    "A34_statement": f"{_N} SELECT predicate, count(*) AS claims FROM cn WHERE predicate <> 'OWNS' AND valid_from > DATE '2024-01-01' GROUP BY 1",
    "A35_resume": "SELECT question_id, 1 AS results FROM retrieval_questions",
    "A39_retrieval_slice": """WITH d AS (SELECT doc_id, dsid, lower(trim(source)) AS source, text FROM documents), r AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('slice|' || doc_id), doc_id) AS rn FROM d),
      k AS (SELECT doc_id FROM r WHERE rn <= 30 UNION SELECT doc_id FROM d WHERE dsid IN (SELECT unnest(expected_doc_ids) FROM retrieval_questions)) SELECT doc_id, source, left(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), 1400) AS text FROM d WHERE doc_id IN (SELECT doc_id FROM k)""",
    "A40_checkpoint": "SELECT count(*) AS rows, count(DISTINCT question_id) AS ids, true AS summed FROM retrieval_questions",
    "C16_number_range": f"{_G} SELECT count(DISTINCT claim_id) AS claims FROM gated WHERE status = 'PASS'",
    "D16_optional_neighbours": f"{_N}, e AS (SELECT entity AS entity_key, min(label) AS label FROM res GROUP BY 1) SELECT entity_key, label, (SELECT count(*) FROM cn WHERE subject_id = entity_key) AS outgoing, (SELECT count(*) FROM cn WHERE object_id = entity_key) AS incoming FROM e",
}
