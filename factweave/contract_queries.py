"""Queries on contracts, the load gate, and the claim store, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.operators import claims as C
from factweave.operators import contract as K
from factweave.operators import extract as X
from factweave.operators import inventory as V
from factweave.sources.tables import table

# What the test tables' names of accounts end in.
TRADES = "Health Systems Studios Foods Labs Logistics Mining Aviation Analytics Textiles Robotics Payments Mutual Optics".split()
_LABELS = [("Project", r"^[A-Z]{2,5}-[0-9]+$"), ("Project", r"rollout$"), ("Service", r"^[a-z]+-[a-z]+$"), ("Account", r"^[A-Z][a-z]+ (" + "|".join(TRADES) + ")$"), ("Person", r"^[A-Z][a-z]+ [A-Z][a-z]+$")]


def claims(spark, folder):
    return table(spark, folder, "claims_checkpoint50")


def label(mention):
    out = None
    for name, pattern in _LABELS:
        out = F.when(mention.rlike(pattern), name) if out is None else out.when(mention.rlike(pattern), name)
    return out


def resolvable(spark, folder):
    """What the mentions of the claims mean: tidy names are entities of a label, other words are none."""
    m = V.mentions(claims(spark, folder)).select(F.trim("mention").alias("mention")).distinct()
    m = m.withColumn("label", label(F.col("mention"))).where("label is not null")
    return m.select("mention", F.concat_ws(":", F.lower("label"), F.regexp_replace(F.lower("mention"), "[^a-z0-9]+", "-")).alias("entity"), "label")


def artifact_times(spark, folder):
    return table(spark, folder, "artifacts").select("id", F.col("timestamp").alias("time"))


def damaged(spark, folder):
    """The claims with faults that their table does not have: bad ids, lost artifacts, no evidence, tidied times."""
    c = claims(spark, folder)
    bad = lambda least, most: F.col("confidence").between(least, most)
    day = F.when(K.real_iso(F.col("observed_at")), F.col("observed_at")).when(~bad(0.6, 0.62), F.lit("2024-05-05"))
    return c.withColumns({
        "claim_id": F.when(bad(0.5, 0.52), F.lit("c1")).otherwise(F.col("claim_id")), "artifact_id": F.when(bad(0.53, 0.55), F.lit("artifact:lost")).when(bad(0.6, 0.62), F.lit("artifact:untimed")).otherwise(F.col("artifact_id")),
        "evidence_span": F.when(bad(0.56, 0.6), F.lit(" ")).otherwise(F.col("evidence_span")), "observed_at": day, "subject_mention": F.when(bad(0.63, 0.64), F.lit("")).otherwise(F.col("subject_mention")),
        "predicate": F.upper("predicate"), "object_mention": F.when(bad(0.65, 0.66), F.lit(None)).otherwise(F.col("object_mention")),
    })


def gated(spark, folder, source=claims):
    there = artifact_times(spark, folder).unionByName(spark.createDataFrame([("artifact:untimed", None)], "id string, time string"))
    return K.gate(source(spark, folder), resolvable(spark, folder), there)


def statuses(spark, folder, source):
    g = gated(spark, folder, source)
    return g.groupBy("claim_id", "status", F.coalesce("timestamp_source", F.lit("")).alias("timestamp_source")).agg(F.count(F.lit(1)).alias("rows"))


def outputs(spark, folder):
    return K.output_problems(claims(spark, folder), artifact_times(spark, folder), "claim_id", ["artifact_id", "subject_mention", "predicate", "object_mention"], C.short_hash, {"predicate": K.PREDICATES, "extraction_method": K.METHODS})


def mention_problems(spark, folder):
    """Mentions found in the artifacts, some with spans that run backwards, held against the contract."""
    a = table(spark, folder, "artifacts").select("id", "content").distinct()
    m = X.mentions(a).withColumns({"source": F.lit("x"), "context": F.lit(""), "extraction_method": F.lit("deterministic"), "type": F.when(F.length("raw_text") % 7 == 0, F.lit("thing")).otherwise(F.col("type"))})
    m = m.withColumn("span_end", F.when(F.length("raw_text") % 5 == 0, F.col("span_start")).otherwise(F.col("span_end")))
    return K.problems(m, K.mention_rules()).groupBy("mention_id", F.array_join("problems", ",").alias("problems")).agg(F.count(F.lit(1)).alias("rows")).where("problems <> ''")


def supported(spark, folder):
    """Every labelled pair of the claims, and which of the two rule tables allow it."""
    r = resolvable(spark, folder)
    s, o = r.select(F.col("mention").alias("subject_mention"), F.col("label").alias("sl")), r.select(F.col("mention").alias("object_mention"), F.col("label").alias("ol"))
    c = claims(spark, folder).select("claim_id", F.trim("subject_mention").alias("subject_mention"), F.upper("predicate").alias("predicate"), F.trim("object_mention").alias("object_mention"))
    p = c.join(s, "subject_mention").join(o, "object_mention").select("predicate", "sl", "ol").union(c.join(s, "subject_mention").join(o, "object_mention").select("predicate", "ol", "sl"))
    return p.groupBy("predicate", "sl", "ol").agg(F.count(F.lit(1)).alias("claims")).select("*", K.pair_supported(F.col("predicate"), F.col("sl"), F.col("ol")).alias("loaded"), K.pair_supported(F.col("predicate"), F.col("sl"), F.col("ol"), True).alias("extracted"))


def loads(spark, folder):
    good, bad = K.loaded(damaged(spark, folder), K.claim_rules(), "claim_id")
    return good.groupBy(F.lit("loaded").alias("reason")).agg(F.count(F.lit(1)).alias("rows")).unionByName(bad.groupBy("reason").agg(F.count(F.lit(1)).alias("rows")))


def shapes(spark, folder):
    m = V.mentions(claims(spark, folder)).select("mention").union(table(spark, folder, "documents").select("text")).distinct()
    return m.where("mention is not null").groupBy(K.is_mention_shaped(F.col("mention")).alias("shaped"), K.is_entity(F.col("mention")).alias("entity")).agg(F.count(F.lit(1)).alias("texts"))


QUERIES = {
    "A03_claim_load": loads,
    "A03_duplicate_claims": lambda s, d: K.duplicate_ids(claims(s, d)),
    "C01_claim_problems": lambda s, d: K.problems(claims(s, d), K.claim_rules()).select("claim_id", F.array_join("problems", ",").alias("problems")).groupBy("claim_id", "problems").agg(F.count(F.lit(1)).alias("rows")),
    "C02_mention_problems": mention_problems,
    "C03_pair_rules": supported,
    "C05_load_gate": lambda s, d: statuses(s, d, claims),
    "C05_load_gate_damaged": lambda s, d: statuses(s, d, damaged),
    "C06_rejected": lambda s, d: K.split(gated(s, d, damaged))[1].groupBy("status").agg(F.count(F.lit(1)).alias("rows")),
    "C06_loadable": lambda s, d: K.split(gated(s, d, damaged))[0].select("claim_id", "subject_id", "object_id").distinct(),
    "C09_mention_shapes": shapes,
    "C10_output_problems": outputs,
}

_CL = "claims_checkpoint50"
_B = "(regexp_replace(coalesce({}, ''), '\\s+', '', 'g') = '')"
_LAB = "CASE " + " ".join(f"WHEN regexp_matches(m, '{p}') THEN '{n}'" for n, p in _LABELS) + " END"
_PRED = "(" + ", ".join(f"'{p}'" for p in K.PREDICATES) + ")"
_RES = f"""res AS (SELECT DISTINCT m AS mention, {_LAB} AS label, lower({_LAB}) || ':' || regexp_replace(lower(m), '[^a-z0-9]+', '-', 'g') AS entity
  FROM (SELECT trim(subject_mention) AS m FROM {_CL} UNION SELECT trim(object_mention) FROM {_CL}) WHERE {_LAB} IS NOT NULL)"""


def _notiso(c: str) -> str:
    clock = " AND ".join(f"coalesce(try_cast(substr({c}, {at}, 2) AS INTEGER) <= {most}, true)" for at, most in ((12, 23), (15, 59), (18, 59)))
    return f"({c} IS NOT NULL AND NOT (regexp_matches({c}, '{K.ISO_TIME}') AND try_cast(left({c}, 10) AS DATE) IS NOT NULL AND {clock}))"


def _pairs(extraction: bool) -> str:
    return "(" + ", ".join(f"('{p}', '{a}', '{b}')" for p, a, b in K.pair_rules(extraction)) + ")"


_RULES = {
    "claim_id": f"NOT coalesce(regexp_matches(claim_id, '{K.CLAIM_ID}'), false)", "artifact_id": f"NOT coalesce(regexp_matches(artifact_id, '{K.ARTIFACT_ID}'), false)", "subject_mention": _B.format("subject_mention"),
    "predicate": f"NOT coalesce(predicate IN {_PRED}, false)", "object_mention": _B.format("object_mention"), "observed_at": _notiso("observed_at"), "valid_from": _notiso("valid_from"), "valid_to": _notiso("valid_to"),
    "period": "coalesce(left(valid_to, 10) < left(valid_from, 10), false)", "confidence": "NOT coalesce(confidence BETWEEN 0 AND 1, false)", "extraction_method": _B.format("extraction_method"), "evidence_span": _B.format("evidence_span"),
}
_PROBLEMS = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _RULES.items()) + ")"
_DAMAGED = f"""dam AS (SELECT CASE WHEN confidence BETWEEN 0.5 AND 0.52 THEN 'c1' ELSE claim_id END AS claim_id, CASE WHEN confidence BETWEEN 0.53 AND 0.55 THEN 'artifact:lost' WHEN confidence BETWEEN 0.6 AND 0.62 THEN 'artifact:untimed' ELSE artifact_id END AS artifact_id,
  CASE WHEN confidence BETWEEN 0.63 AND 0.64 THEN '' ELSE subject_mention END AS subject_mention, upper(predicate) AS predicate, CASE WHEN confidence BETWEEN 0.65 AND 0.66 THEN NULL ELSE object_mention END AS object_mention,
  CASE WHEN observed_at IS NOT NULL AND NOT {_notiso('observed_at')} THEN observed_at WHEN NOT (confidence BETWEEN 0.6 AND 0.62) THEN '2024-05-05' END AS observed_at, valid_from, valid_to, confidence, extraction_method,
  CASE WHEN confidence BETWEEN 0.56 AND 0.6 THEN ' ' ELSE evidence_span END AS evidence_span FROM {_CL})"""


def _gate(rows: str) -> str:
    r = _RULES
    return f"""{_RES}, art AS (SELECT id AS aid, max(timestamp) AS atime FROM artifacts GROUP BY 1 UNION ALL SELECT 'artifact:untimed', NULL), gated AS (SELECT c.*, s.entity AS subject_id, o.entity AS object_id, CASE WHEN {r['claim_id']} OR {r['artifact_id']} THEN 'MALFORMED_ID'
      WHEN {r['subject_mention']} THEN 'INVALID_SUBJECT' WHEN {r['object_mention']} THEN 'INVALID_OBJECT' WHEN {r['predicate']} THEN 'INVALID_PREDICATE' WHEN {r['observed_at']} OR {r['valid_from']} OR {r['valid_to']} OR {r['period']} THEN 'INVALID_TIMESTAMP'
      WHEN coalesce(observed_at, '') = '' AND coalesce(atime, '') = '' THEN 'MISSING_TIMESTAMP' WHEN aid IS NULL THEN 'MISSING_ARTIFACT' WHEN s.mention IS NULL THEN 'INVALID_SUBJECT' WHEN o.mention IS NULL THEN 'INVALID_OBJECT'
      WHEN (predicate, s.label, o.label) NOT IN {_pairs(False)} THEN 'UNSUPPORTED_ENTITY_PAIR' WHEN {r['confidence']} OR {r['extraction_method']} OR {r['evidence_span']} THEN 'CONTRACT_VIOLATION' ELSE 'PASS' END AS status
      FROM {rows} c LEFT JOIN res s ON s.mention = trim(c.subject_mention) LEFT JOIN res o ON o.mention = trim(c.object_mention) LEFT JOIN art ON aid = c.artifact_id)"""


_STATUS = "SELECT claim_id, status, CASE WHEN status <> 'PASS' THEN '' WHEN coalesce(observed_at, '') <> '' THEN 'claim' ELSE 'artifact' END AS timestamp_source, count(*) AS rows FROM gated GROUP BY ALL"
_HASH = "left(sha256(coalesce(artifact_id, '') || '|' || coalesce(subject_mention, '') || '|' || coalesce(predicate, '') || '|' || coalesce(object_mention, '')), 16)"
_OUT = {
    "orphan": "NOT EXISTS (SELECT 1 FROM artifacts a WHERE a.id = c.artifact_id)", "artifact_id": "NOT coalesce(regexp_matches(artifact_id, '^dsid_[0-9a-f]{32}$'), false)", "id": f"claim_id <> {_HASH}",
    "confidence": _RULES["confidence"], "predicate": _RULES["predicate"], "extraction_method": "NOT coalesce(extraction_method IN (" + ", ".join(f"'{m}'" for m in K.METHODS) + "), false)",
}
_NO = "(" + ", ".join(f"'{w}'" for w in K.NO_ENTITY) + ")"
_SHAPED = "trim(m) <> '' AND length(trim(m)) <= 120 AND NOT regexp_matches(trim(m), '[\\n\\r]') AND NOT (" + " OR ".join(f"contains(lower(trim(m)), '{w}')" for w in K.HEADER_WORDS) + ") AND len(string_split_regex(trim(m), '\\s+')) <= 8"

ORACLES = {
    "A03_claim_load": f"""WITH {_DAMAGED}, p AS (SELECT *, {_PROBLEMS} AS problems, count(*) OVER (PARTITION BY claim_id) AS n FROM dam)
      SELECT CASE WHEN problems <> '' THEN problems WHEN n > 1 THEN 'duplicate' ELSE 'loaded' END AS reason, count(*) AS rows FROM p GROUP BY 1""",
    "A03_duplicate_claims": f"SELECT claim_id, count(*) AS copies FROM {_CL} GROUP BY 1 HAVING count(*) > 1",
    "C01_claim_problems": f"SELECT claim_id, {_PROBLEMS} AS problems, count(*) AS rows FROM {_CL} GROUP BY 1, 2",
    "C03_pair_rules": f"""WITH {_RES}, j AS (SELECT upper(predicate) AS predicate, s.label AS sl, o.label AS ol FROM {_CL} c JOIN res s ON s.mention = trim(c.subject_mention) JOIN res o ON o.mention = trim(c.object_mention)), b AS (SELECT * FROM j UNION ALL SELECT predicate, ol, sl FROM j)
      SELECT predicate, sl, ol, count(*) AS claims, (predicate, sl, ol) IN {_pairs(False)} AS loaded, (predicate, sl, ol) IN {_pairs(True)} AS extracted FROM b GROUP BY predicate, sl, ol""",
    "C05_load_gate": f"WITH {_gate(_CL)} {_STATUS}",
    "C05_load_gate_damaged": f"WITH {_DAMAGED}, {_gate('dam')} {_STATUS}",
    "C06_rejected": f"WITH {_DAMAGED}, {_gate('dam')} SELECT status, count(*) AS rows FROM gated WHERE status <> 'PASS' GROUP BY 1",
    "C06_loadable": f"WITH {_DAMAGED}, {_gate('dam')} SELECT DISTINCT claim_id, subject_id, object_id FROM gated WHERE status = 'PASS'",
    "C09_mention_shapes": f"SELECT {_SHAPED} AS shaped, length(trim(m)) >= 3 AND lower(trim(m)) NOT IN {_NO} AS entity, count(*) AS texts FROM (SELECT subject_mention AS m FROM {_CL} UNION SELECT object_mention FROM {_CL} UNION SELECT text FROM documents) WHERE m IS NOT NULL GROUP BY 1, 2",
    "C10_output_problems": " UNION ALL ".join(f"SELECT * FROM (SELECT '{n}' AS problem, count(*) AS rows FROM {_CL} c WHERE {w}) WHERE rows > 0" for n, w in _OUT.items())
    + f" UNION ALL SELECT 'duplicate', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM {_CL} GROUP BY claim_id HAVING count(*) > 1) HAVING count(*) > 0",
}
