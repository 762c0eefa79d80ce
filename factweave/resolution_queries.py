"""Queries on entities, bridges and pairs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave import contract_queries, identity_queries
from factweave.functions.text import mention_key
from factweave.operators import identity as I
from factweave.operators import resolution as R
from factweave.sources.tables import table


def artifacts(spark, folder):
    return table(spark, folder, "artifacts")


def authors(spark, folder):
    return artifacts(spark, folder).select("author").where("author is not null").distinct()


def entities(spark, folder):
    return R.merged(R.candidates(artifacts(spark, folder)))


def names(spark, folder):
    """What mentions mean: the tidy names of the claims, one of them twice."""
    r = contract_queries.resolvable(spark, folder).select(F.col("entity").alias("entity_key"), F.col("mention").alias("name"), F.array("mention").alias("mentions"))
    twice = r.where("entity_key like 'account:a%'").select(F.concat("entity_key", F.lit("-2")).alias("entity_key"), "name", "mentions")
    return R.lookup(r.unionByName(twice))


def claims(spark, folder):
    return table(spark, folder, "claims_checkpoint50")


def entries(spark, folder):
    """The mentions of the pairs as an inventory."""
    p = table(spark, folder, "phase3_identity_pairs")
    both = p.select(F.explode(F.array(F.struct(F.col("a.mention").alias("m"), F.col("a.type").alias("type"), F.col("b.mention").alias("o"), F.col("label")), F.struct(F.col("b.mention").alias("m"), F.col("b.type").alias("type"), F.col("a.mention").alias("o"), F.col("label")))).alias("x")).select("x.*")
    over = F.when(F.upper(F.trim("label")) == "SAME", F.array(mention_key(F.col("o")))).otherwise(F.array().cast("array<string>"))
    return both.select(mention_key(F.col("m")).alias("norm"), "type", over.alias("overlaps"))


def placed(spark, folder):
    c = claims(spark, folder)
    m = c.select(F.explode(F.array("subject_mention", "object_mention")).alias("m"), "artifact_id", "predicate", "extraction_method")
    return R.contexts(m.select(mention_key(F.col("m")).alias("mention"), "artifact_id", F.upper("predicate").alias("project"), F.col("extraction_method").alias("channel")).where("mention is not null"))


def context_pairs(spark, folder):
    c = claims(spark, folder).select(mention_key(F.col("subject_mention")).alias("a"), mention_key(F.col("object_mention")).alias("b")).distinct()
    return R.context_features(c, placed(spark, folder))


def evidence(spark, folder):
    """Scores with measured evidence that the test tables lack, made of the pair's number."""
    s = I.scored(identity_queries.pairs(spark, folder)).select("pair_id", "score")
    h = F.conv(F.substring(F.md5("pair_id"), 1, 4), 16, 10).cast("int")
    e, c, o = F.when(h % 3 != 0, (h % 100) / 100.0), F.when(h % 5 != 0, (F.floor(h / 7) % 100) / 100.0), (h % 2).cast("double")
    return s.select("pair_id", F.round(R.boosted(F.col("score"), o, e, c), 6).alias("score"))


def errors(spark, folder):
    d = identity_queries.decisions(spark, folder).where("gold is not null")
    role = F.exists("a_emails", I.is_role) | F.exists("b_emails", I.is_role)
    return d.select("pair_id", R.error_class(F.col("gold"), F.col("decision"), F.col("signals"), F.col("name_similarity"), role).alias("error_class"))


def per_class(spark, folder):
    """Precision, recall and F1 of each class of pairs."""
    d = identity_queries.decisions(spark, folder).where("gold is not null")
    said = F.when(F.col("decision") == "MERGE", "SAME_ENTITY").when(F.col("decision") == "KEEP_SEPARATE", "DIFFERENT_ENTITY").otherwise("UNCERTAIN")
    both = d.select(F.explode(F.array(F.struct(F.col("gold").alias("class"), F.lit("g").alias("side")), F.struct(said.alias("class"), F.lit("p").alias("side")))).alias("x"), (F.col("gold") == said).alias("hit")).select("x.*", "hit")
    n = both.groupBy("class").agg(F.count_if(F.expr("side = 'g'")).alias("wanted"), F.count_if(F.expr("side = 'p'")).alias("given"), F.count_if(F.expr("side = 'g' and hit")).alias("right"))
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 4)
    return n.select("class", "wanted", "given", "right", share(F.col("right"), F.col("given")).alias("precision"), share(F.col("right"), F.col("wanted")).alias("recall"), share(2.0 * F.col("right"), F.col("given") + F.col("wanted")).alias("f1"))


def keys_of_records(spark, folder):
    r = identity_queries.records(spark, folder)
    return r.select("key", R.canonical_key(F.lower(F.coalesce("type", F.lit(""))), I.name_tokens(F.col("mention"))).alias("canonical_key"))


QUERIES = {
    "B16_stable_numbers": lambda s, d: claims(s, d).select("claim_id", R.stable_number(F.lit("Claim"), F.col("claim_id"), ["Artifact", "Claim"]).alias("n")).groupBy((F.col("n") >= 2**48).alias("in_range")).agg(F.count_distinct("claim_id").alias("ids"), F.count_distinct("n").alias("numbers")),
    "B27_person_names": lambda s, d: authors(s, d).select("author", R.person_name(F.col("author")).alias("name"), R.person_key(F.col("author"), F.when(F.col("author").contains("<"), F.regexp_extract("author", "<([^<>]+)>", 1)), F.lit(None).cast("string")).alias("entity_key")),
    "B32_resolutions": lambda s, d: R.resolutions(entities(s, d)).select("entity_key", "label", F.array_join("mentions", "|").alias("mentions")),
    "D01_unresolved_mentions": lambda s, d: R.resolved_claims(claims(s, d), names(s, d))[1],
    "D01_resolved_claims": lambda s, d: R.resolved_claims(claims(s, d), names(s, d))[0].select("claim_id", "subject_entity", "object_entity").distinct(),
    "D04_artifact_binding": lambda s, d: R.bound_artifacts(claims(s, d), artifacts(s, d).where("source = 'slack'"), artifacts(s, d).where("source <> 'jira'")).groupBy(F.coalesce("bound", F.lit("missing")).alias("bound")).agg(F.count(F.lit(1)).alias("claims")),
    "D19_pair_candidates": lambda s, d: R.pair_candidates(entries(s, d)).where("how < '4'"),
    "D19_hard_pairs": lambda s, d: R.pair_candidates(entries(s, d)).where("how like '4%'"),
    "D21_fuzzy_pairs": lambda s, d: R.fuzzy_pairs(entries(s, d)).select("type", "a", "b", F.round("ratio", 4).alias("ratio")),
    "D23_bridge": lambda s, d: R.bridged(claims(s, d), names(s, d)).select("claim_id", "subject_entity", "object_entity", "resolution_status").distinct(),
    "E24_bridge_summary": lambda s, d: R.bridge_summary(R.bridged(claims(s, d), names(s, d))),
    "E24_error_classes": lambda s, d: errors(s, d).where("error_class is not null").groupBy("error_class").agg(F.count(F.lit(1)).alias("pairs")),
    "D24_contexts": lambda s, d: placed(s, d).select("mention", F.size("artifacts").alias("artifacts"), F.array_join("projects", ",").alias("projects"), F.array_join("channels", ",").alias("channels")),
    "D31_mention_lookup": names,
    "E09_entities": lambda s, d: entities(s, d).select("entity_key", F.array_join("mentions", "|").alias("mentions"), F.array_join("emails", "|").alias("emails"), F.array_join("sources", "|").alias("sources"), "members"),
    "E14_per_class": per_class,
    "H04_gap_fill": lambda s, d: R.gap_filled(claims(s, d).where("extraction_method = 'deterministic'").select("claim_id", "predicate").distinct(), claims(s, d).select("claim_id", "predicate"), ["claim_id"]),
    "H05_last_writer": lambda s, d: R.latest(table(s, d, "events").select("user_id", "event_type", "event_id"), "user_id", "event_id"),
    "J05_boosted_scores": evidence,
    "J08_canonical_keys": keys_of_records,
    "J12_error_classes": errors,
    "J13_context_features": context_pairs,
    "J13_embedding_dots": lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(R.dot(F.col("embedding"), F.col("embedding")), 3).alias("norm")),
}

_K = "lower(trim(regexp_replace(trim(regexp_replace({}, '\\s+', ' ', 'g')), '^@', '')))"
_CL = "claims_checkpoint50"
_SLUG = "coalesce(nullif(regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown')"
_BARE = "regexp_replace(trim({}), '^[\" ]+|[\" ]+$', '', 'g')"
_RES = contract_queries._RES
_NAMES = f"""{_RES}, r2 AS (SELECT entity AS entity_key, mention FROM res UNION ALL SELECT entity || '-2', mention FROM res WHERE entity LIKE 'account:a%'),
  nm AS (SELECT {_K.format('mention')} AS mention, min(entity_key) AS entity_key, count(DISTINCT entity_key) AS entities FROM r2 GROUP BY 1)"""
_BRIDGE = f"""{_NAMES}, br AS (SELECT c.*, s.entity_key AS subject_entity, o.entity_key AS object_entity, CASE WHEN s.entity_key IS NOT NULL AND o.entity_key IS NOT NULL THEN 'resolved' WHEN s.entity_key IS NOT NULL OR o.entity_key IS NOT NULL THEN 'review' ELSE 'unresolved' END AS resolution_status
  FROM {_CL} c LEFT JOIN nm s ON s.entities = 1 AND s.mention = {_K.format('subject_mention')} LEFT JOIN nm o ON o.entities = 1 AND o.mention = {_K.format('object_mention')})"""
_CTX = f"""m AS (SELECT {_K.format('subject_mention')} AS mention, artifact_id, upper(predicate) AS p, extraction_method AS x FROM {_CL} UNION ALL SELECT {_K.format('object_mention')}, artifact_id, upper(predicate), extraction_method FROM {_CL}),
  ctx AS (SELECT mention, list_sort(list_distinct(list(artifact_id))) AS a, list_sort(list_distinct(list(p))) AS p, list_sort(list_distinct(list(x))) AS x FROM m WHERE mention IS NOT NULL GROUP BY 1)"""
_ENT = f"""ent AS (SELECT DISTINCT {_K.format('m')} AS norm, type, CASE WHEN upper(trim(label)) = 'SAME' THEN {_K.format('o')} END AS o FROM (SELECT a.mention AS m, a.type AS type, b.mention AS o, label FROM phase3_identity_pairs UNION ALL SELECT b.mention, b.type, a.mention, label FROM phase3_identity_pairs)),
  e AS (SELECT DISTINCT norm, type FROM ent WHERE norm <> ''), pe AS (SELECT norm, string_split_regex(norm, '\\s+') AS w FROM e WHERE type = 'person'), em AS (SELECT norm FROM e WHERE type = 'email')"""
_DOT = "regexp_replace(split_part({}, '@', 1), '[_ -]', '.', 'g')"
_H = "CAST(('0x' || left(md5(pair_id), 4)) AS INTEGER)"
_D = identity_queries._F

ORACLES = {
    "B16_stable_numbers": f"SELECT true AS in_range, count(DISTINCT claim_id) AS ids, count(DISTINCT claim_id) AS numbers FROM {_CL}",
    "B27_person_names": f"""WITH a AS (SELECT DISTINCT author FROM artifacts WHERE author IS NOT NULL), b AS (SELECT author, {_BARE.format('author')} AS bare, regexp_extract({_BARE.format('author')}, '^(.*?)\\s*<([^<>]+)>\\s*$', 1) AS n, regexp_extract({_BARE.format('author')}, '^(.*?)\\s*<([^<>]+)>\\s*$', 2) AS box,
      CASE WHEN contains(author, '<') THEN regexp_extract(author, '<([^<>]+)>', 1) END AS e FROM a)
      SELECT author, CASE WHEN box = '' THEN bare WHEN regexp_replace(n, '["\\s]', '', 'g') = '' THEN trim(box) ELSE regexp_replace(n, '^[" ]+|[" ]+$', '', 'g') END AS name, 'person:' || CASE WHEN contains(coalesce(e, ''), '@') THEN {_SLUG.format("split_part(e, '@', 1)")} ELSE {_SLUG.format('author')} END AS entity_key FROM b""",
    "D01_unresolved_mentions": f"WITH {_NAMES}, s AS (SELECT {_K.format('subject_mention')} AS mention FROM {_CL} UNION SELECT {_K.format('object_mention')} FROM {_CL}) SELECT mention, coalesce(entities, 0) AS entities FROM s LEFT JOIN nm USING (mention) WHERE entities IS NULL OR entities > 1",
    "D01_resolved_claims": f"WITH {_BRIDGE} SELECT DISTINCT claim_id, subject_entity, object_entity FROM br WHERE resolution_status = 'resolved'",
    "D04_artifact_binding": f"SELECT CASE WHEN artifact_id IN (SELECT id FROM artifacts WHERE source = 'slack') THEN 'fixture' WHEN artifact_id IN (SELECT id FROM artifacts WHERE source <> 'jira') THEN 'stored' ELSE 'missing' END AS bound, count(*) AS claims FROM {_CL} GROUP BY 1",
    "D19_pair_candidates": f"""WITH {_ENT}, r AS (SELECT x.norm AS x, y.norm AS y, '1-cross-source-overlap' AS how FROM ent x JOIN e y ON x.o = y.norm WHERE x.type IN ('person', 'email') AND y.type IN ('person', 'email')
      UNION ALL SELECT p.norm, f.norm, '2-first-name-vs-full-name' FROM pe p JOIN pe f ON len(p.w) = 1 AND len(f.w) >= 2 AND f.w[1] = p.norm UNION ALL SELECT p.norm, em.norm, '3-name-vs-email-local-part' FROM pe p JOIN em ON {_DOT.format('p.norm')} = {_DOT.format('em.norm')})
      SELECT least(x, y) AS a, greatest(x, y) AS b, min(how) AS how FROM r WHERE x <> y GROUP BY 1, 2""",
    "D23_bridge": f"WITH {_BRIDGE} SELECT DISTINCT claim_id, subject_entity, object_entity, resolution_status FROM br",
    "E24_bridge_summary": f"WITH {_BRIDGE} SELECT count(*) AS claims, count(*) FILTER (resolution_status = 'resolved') AS resolved, count(*) FILTER (resolution_status = 'review') AS review, count(*) FILTER (resolution_status = 'unresolved') AS unresolved, round(count(*) FILTER (resolution_status = 'resolved') / count(*), 4) AS resolve_rate FROM br",
    "D24_contexts": f"WITH {_CTX} SELECT mention, CAST(len(a) AS INTEGER) AS artifacts, array_to_string(p, ',') AS projects, array_to_string(x, ',') AS channels FROM ctx",
    "D31_mention_lookup": f"WITH {_NAMES} SELECT mention, entity_key, entities FROM nm",
    "E14_per_class": f"""WITH {_D}, y AS (SELECT gold, CASE decision WHEN 'MERGE' THEN 'SAME_ENTITY' WHEN 'KEEP_SEPARATE' THEN 'DIFFERENT_ENTITY' ELSE 'UNCERTAIN' END AS said FROM d WHERE gold IS NOT NULL), n AS (SELECT c AS class, (SELECT count(*) FROM y WHERE gold = c) AS wanted, (SELECT count(*) FROM y WHERE said = c) AS given, (SELECT count(*) FROM y WHERE gold = c AND said = c) AS right_
      FROM (SELECT unnest(['SAME_ENTITY', 'DIFFERENT_ENTITY', 'UNCERTAIN']) AS c)) SELECT class, wanted, given, right_ AS right, round(CASE WHEN given > 0 THEN right_ / given ELSE 0 END, 4) AS precision, round(CASE WHEN wanted > 0 THEN right_ / wanted ELSE 0 END, 4) AS recall, round(CASE WHEN given + wanted > 0 THEN 2 * right_ / (given + wanted) ELSE 0 END, 4) AS f1 FROM n WHERE given + wanted > 0""",
    "J08_canonical_keys": f"WITH {_D}, {identity_queries._REC}, {identity_queries._KEYS} SELECT key, lower(coalesce(type, '')) || ':' || array_to_string(t, '-') AS canonical_key FROM k1",
    "H04_gap_fill": f"WITH b AS (SELECT DISTINCT claim_id, predicate FROM {_CL} WHERE extraction_method = 'deterministic') SELECT * FROM b UNION ALL SELECT claim_id, min(predicate) FROM {_CL} WHERE claim_id NOT IN (SELECT claim_id FROM b) GROUP BY 1",
    "H05_last_writer": "SELECT user_id, last(event_type ORDER BY event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1",
    "J05_boosted_scores": f"""WITH {_D}, v AS (SELECT pair_id, score AS s0, CASE WHEN {_H} % 3 <> 0 THEN ({_H} % 100) / 100.0::DOUBLE ELSE 0 END AS e, CASE WHEN {_H} % 5 <> 0 THEN (({_H} // 7) % 100) / 100.0::DOUBLE ELSE 0 END AS c, {_H} % 2 AS o FROM sc),
      f1 AS (SELECT *, CASE WHEN o = 1 AND s0 > 0 AND s0 < 0.6 THEN least(s0 + 0.05, 0.6) ELSE s0 END AS s FROM v) SELECT pair_id, round(CASE WHEN s > 0 THEN CASE WHEN e >= 0.9 OR c >= 0.9 THEN greatest(s, 0.8) WHEN (e >= 0.8 OR c >= 0.8) AND s < 0.6 THEN 0.6 ELSE s END ELSE s END, 6)::DOUBLE AS score FROM f1""",
    "J12_error_classes": f"""WITH {_D}, x AS (SELECT *, coalesce({identity_queries._NS}, 0) AS sim, len(list_filter(a_emails, lambda e: {identity_queries._ISROLE.format('e')})) > 0 OR len(list_filter(b_emails, lambda e: {identity_queries._ISROLE.format('e')})) > 0 AS role, string_split(signals, ',') AS sg FROM d WHERE gold IS NOT NULL)
      SELECT pair_id, CASE WHEN gold = 'SAME_ENTITY' AND decision = 'MERGE' THEN NULL WHEN gold = 'SAME_ENTITY' THEN CASE WHEN list_contains(sg, 'username') THEN 'FALSE_SPLIT_USERNAME' WHEN list_has_any(sg, ['email-username', 'email-local-part']) THEN 'FALSE_SPLIT_ALIAS' WHEN list_contains(sg, 'external-id') THEN 'FALSE_SPLIT_CROSS_SOURCE_ID' WHEN sim >= 0.5 THEN 'FALSE_SPLIT_INITIALS' ELSE 'FALSE_SPLIT_ALIAS' END
      WHEN gold = 'DIFFERENT_ENTITY' THEN CASE decision WHEN 'KEEP_SEPARATE' THEN NULL WHEN 'MERGE' THEN CASE WHEN role THEN 'FALSE_MERGE_ROLE_MAILBOX' WHEN list_contains(sg, 'email-local-part') THEN 'FALSE_MERGE_EMAIL' WHEN sim < 0.5 THEN 'FALSE_MERGE_TOKEN_OVERLAP' ELSE 'FALSE_MERGE_NAME' END WHEN 'REVIEW' THEN 'REVIEW_AMBIGUOUS' ELSE 'ABSTAIN_INSUFFICIENT_EVIDENCE' END
      ELSE CASE WHEN decision IN ('REVIEW', 'ABSTAIN') THEN NULL WHEN decision = 'MERGE' THEN 'FALSE_MERGE_NAME' ELSE 'FALSE_SPLIT_ALIAS' END END AS error_class FROM x""",
    "J13_context_features": f"""WITH {_CTX}, p AS (SELECT DISTINCT {_K.format('subject_mention')} AS a, {_K.format('object_mention')} AS b FROM {_CL}) SELECT p.a, p.b, round(len(list_intersect(x.a, y.a)) / len(list_distinct(list_concat(x.a, y.a))), 6) AS cooccurrence,
      CASE WHEN len(x.p) > 0 AND len(y.p) > 0 THEN list_has_any(x.p, y.p)::DOUBLE END AS shared_project, CASE WHEN len(x.x) > 0 AND len(y.x) > 0 THEN list_has_any(x.x, y.x)::DOUBLE END AS shared_channel FROM p LEFT JOIN ctx x ON x.mention = p.a LEFT JOIN ctx y ON y.mention = p.b""",
    "J13_embedding_dots": "SELECT vec_id, round(greatest(-1, least(1, list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))), 3) AS norm FROM embeddings",
}
ORACLES["E24_error_classes"] = f"SELECT error_class, count(*) AS pairs FROM ({ORACLES['J12_error_classes']}) WHERE error_class IS NOT NULL GROUP BY 1"
