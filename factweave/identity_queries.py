"""Queries on identity pairs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.operators import identity as I
from factweave.plans.lineage import stored
from factweave.sources.tables import table


def pairs(spark, folder):
    """Pairs once each: rows repeated in full are one."""
    p = table(spark, folder, "phase3_identity_pairs").select("pair_id", "a", "b", "label")
    return p.groupBy("pair_id").agg(F.min_by("a", F.to_json(F.struct("a", "b"))).alias("a"), F.min_by("b", F.to_json(F.struct("a", "b"))).alias("b"), F.max("label").alias("label"))


def features(spark, folder):
    return I.features(pairs(spark, folder)).select("pair_id", "email_match", "email_username_match", "external_id_match", "username_match", "shared", F.round("name_similarity", 6).alias("name_similarity"))


def decisions(spark, folder):
    return I.decided(pairs(spark, folder)).withColumn("gold", I.gold(F.col("label")))


def sweep(spark, folder):
    """Counts per merge threshold: features once, then one decision per threshold of a fixed short list."""
    d = decisions(spark, folder).select("score", "decision", "gold").where("gold is not null")
    at = d.withColumn("threshold", F.explode(F.array(*[F.lit(x / 100) for x in (55, 80, 85, 88, 90, 92, 97)])))
    merged = F.col("score") >= F.col("threshold")
    return at.groupBy("threshold").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(merged).alias("merges"), F.count_if(merged & (F.col("gold") == "DIFFERENT_ENTITY")).alias("false_merges"), F.count_if(merged & (F.col("gold") == "SAME_ENTITY")).alias("true_merges")
    )


def records(spark, folder):
    p = pairs(spark, folder)
    key = lambda s: F.try_element_at(F.filter(F.col(f"{s}.external_ids"), lambda x: x.startswith("mention:")), F.lit(1))
    rows = p.select(F.explode(F.array(*[F.struct(key(s).alias("key"), F.col(f"{s}.mention").alias("mention"), F.col(f"{s}.type").alias("type"), F.col(f"{s}.emails").alias("emails"), F.col(f"{s}.external_ids").alias("external_ids")) for s in "ab"])).alias("r")).select("r.*")
    both = lambda c: F.array_distinct(F.flatten(F.collect_set(F.coalesce(c, F.array().cast("array<string>"))))).alias(c)
    return rows.groupBy("key").agg(F.min("mention").alias("mention"), F.min("type").alias("type"), both("emails"), both("external_ids"))


def clustered(spark, folder):
    """Records clustered by merged pairs, then by review pairs of clusters with an e-mail address."""
    d = decisions(spark, folder)
    key = lambda s: F.try_element_at(F.filter(F.col(f"{s}.external_ids"), lambda x: x.startswith("mention:")), F.lit(1))
    edge = d.select(key("a").alias("u"), key("b").alias("v"), "decision", "score", F.size("a_emails").alias("ea"), F.size("b_emails").alias("eb"))
    edge = stored(edge, "decisions")
    nodes = edge.select(F.col("u").alias("node")).union(edge.select("v")).distinct()
    anchors = edge.where("ea > 0").select(F.col("u").alias("node")).union(edge.where("eb > 0").select("v")).distinct()
    return I.clusters(nodes, edge.where("decision = 'MERGE'").select("u", "v"), edge.where("decision = 'REVIEW' and score >= 0.8").select("u", "v"), anchors)


def coverage(spark, folder):
    f = I.features(pairs(spark, folder))
    names = ["email_match", "email_username_match", "external_id_match", "username_match", "name_similarity"]
    long = f.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")).select("x.*")
    return long.groupBy("feature").agg(F.count(F.lit(1)).alias("pairs"), F.count("value").alias("present"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))


QUERIES = {
    "J04_features": features,
    "J05_scores": lambda s, d: I.scored(pairs(s, d)).select("pair_id", "score", F.array_join("signals", ",").alias("signals")),
    "J06_decisions": lambda s, d: decisions(s, d).select("pair_id", "decision"),
    "E14_evaluation": lambda s, d: I.evaluated(decisions(s, d)),
    "E15_threshold_sweep": sweep,
    "E16_feature_coverage": coverage,
    "A37_identity_pairs": lambda s, d: pairs(s, d).select("pair_id", F.col("a.mention").alias("mention_a"), F.col("b.mention").alias("mention_b"), I.gold(F.col("label")).alias("gold")),
    "D17_blocking": lambda s, d: I.blocked(records(s, d)),
    "D17_representatives": lambda s, d: I.representatives(records(s, d)).select("key", "rep"),
    "J07_clusters": clustered,
}

_ROLE = "(" + ", ".join(f"'{r}'" for r in I.ROLE_MAILBOXES) + ")"
_LOC = "regexp_replace(lower(split_part({0}, '@', 1)), '[^a-z0-9]+', '.', 'g')"
_ISROLE = f"(replace({_LOC}, '.', '-') IN {_ROLE} OR split_part({_LOC}, '.', 1) IN {_ROLE})"
_SUF = I.ROLE_SUFFIX.replace("'", "''")
_EM = "^[^@\\s]+@[^@\\s]+$"


def _side(s: str) -> str:
    m = f"lower(trim(coalesce({s}.mention, '')))"
    return f"""list_sort(list_distinct(list_filter(list_transform(coalesce({s}.emails, []), lambda e: lower(trim(e))), lambda e: regexp_matches(e, '{_EM}')))) AS {s}_emails,
      list_sort(list_distinct(list_filter(string_split_regex(CASE WHEN regexp_matches({m}, '{_EM}') AND {_ISROLE.format(m)} THEN '' WHEN regexp_matches({m}, '{_EM}') THEN split_part({m}, '@', 1)
        ELSE regexp_replace({m}, '{_SUF}', '') END, '[^a-z0-9]+'), lambda t: t <> ''))) AS {s}_tokens,
      CASE WHEN lower({s}.type) = 'username' THEN [lower(regexp_replace(trim({s}.mention), '^@', ''))] ELSE [] END AS {s}_users,
      list_sort(list_distinct(list_filter(list_transform(coalesce({s}.external_ids, []), lambda x: lower(x)), lambda x: NOT starts_with(x, 'mention:')))) AS {s}_ids,
      list_filter(string_split_regex(regexp_replace(lower(trim({s}.mention)), '{_SUF}', ''), '[^a-z0-9]+'), lambda t: t <> '') AS {s}_words"""


def _ev(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN NULL WHEN list_has_any({a}, {b}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


_BASE = "split_part(regexp_replace({0}, '[_.]', '-', 'g'), '-', 1)"


def _cross(x: str, y: str) -> str:
    users = f"list_concat(list_transform({y}_users, lambda u: replace(u, '.', '')), list_transform({y}_users, lambda u: {_BASE.format('u')}))"
    return _ev(f"list_transform({x}_locals, lambda u: replace(u, '.', ''))", users)


_F = f"""p AS (SELECT pair_id, first(a) AS a, first(b) AS b, max(label) AS label FROM (SELECT DISTINCT pair_id, a, b, label FROM phase3_identity_pairs) GROUP BY pair_id),
  s AS (SELECT pair_id, a, b, label, {_side('a')}, {_side('b')} FROM p),
  l AS (SELECT *, {', '.join(f"list_sort(list_distinct(list_transform(list_filter({x}_emails, lambda e: NOT {_ISROLE.format('e')}), lambda e: {_LOC.format('e')}))) AS {x}_locals, list_distinct(list_transform({x}_emails, lambda e: split_part(e, '@', -1))) AS {x}_domains" for x in 'ab')} FROM s),
  f AS (SELECT *, CASE WHEN len(a_locals) = 0 OR len(b_locals) = 0 THEN NULL WHEN list_has_any(a_locals, b_locals) AND list_has_any(a_domains, b_domains) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS email_match,
    greatest({_cross('a', 'b')}, {_cross('b', 'a')}) AS email_username_match, {_ev('a_ids', 'b_ids')} AS external_id_match,
    {_ev(f"list_transform(a_users, lambda u: {_BASE.format('u')})", f"list_transform(b_users, lambda u: {_BASE.format('u')})")} AS username_match,
    CAST(len(list_filter(a_tokens, lambda t: list_contains(b_tokens, t) OR (length(t) = 1 AND len(list_filter(b_tokens, lambda o: starts_with(o, t))) > 0) OR len(list_filter(b_tokens, lambda o: length(o) = 1 AND starts_with(t, o))) > 0)) AS INTEGER) AS shared FROM l),
  sc AS (SELECT *, CASE WHEN email_match = 1 THEN 0.97 WHEN email_username_match = 1 THEN 0.92 WHEN external_id_match = 1 THEN 0.90 WHEN username_match = 1 THEN 0.88
      WHEN shared > 0 AND len(a_tokens) = shared AND len(b_tokens) = shared THEN 0.85 WHEN shared >= 2 THEN 0.80 WHEN shared = 1 THEN 0.55 ELSE 0 END::DOUBLE AS score,
    concat_ws(',', CASE WHEN email_match = 1 THEN 'email-local-part' END, CASE WHEN email_username_match = 1 THEN 'email-username' END, CASE WHEN external_id_match = 1 THEN 'external-id' END, CASE WHEN username_match = 1 THEN 'username' END) AS signals FROM f),
  de AS (SELECT *, len(a_words) >= 2 AND len(b_words) >= 2 AS both_full, a_words[1] AS fa, b_words[1] AS fb FROM sc),
  d AS (SELECT *, CASE WHEN score >= 0.9 THEN 'MERGE' WHEN len(list_filter(a_emails, lambda e: {_ISROLE.format('e')})) > 0 OR len(list_filter(b_emails, lambda e: {_ISROLE.format('e')})) > 0 THEN 'KEEP_SEPARATE'
      WHEN both_full AND signals = '' AND (a_words[-1] <> b_words[-1] OR NOT (fa = fb OR (length(fa) = 1 AND starts_with(fb, fa)) OR (length(fb) = 1 AND starts_with(fa, fb)))) THEN 'KEEP_SEPARATE'
      WHEN score <= 0.2 AND both_full AND NOT list_has_any(a_words, b_words) THEN 'KEEP_SEPARATE' WHEN score >= 0.5 THEN 'REVIEW' ELSE 'ABSTAIN' END AS decision,
    CASE regexp_replace(upper(trim(label)), '[^A-Z]+', '_', 'g') WHEN 'SAME' THEN 'SAME_ENTITY' WHEN 'SAME_ENTITY' THEN 'SAME_ENTITY' WHEN 'DIFFERENT' THEN 'DIFFERENT_ENTITY' WHEN 'DIFFERENT_ENTITY' THEN 'DIFFERENT_ENTITY' WHEN 'UNCERTAIN' THEN 'UNCERTAIN' END AS gold FROM de)"""
_NS = "CASE WHEN len(a_tokens) = 0 OR len(b_tokens) = 0 THEN NULL WHEN a_tokens = b_tokens THEN 1.0::DOUBLE ELSE shared / len(list_distinct(list_concat(a_tokens, b_tokens))) END"

_REC = """r0 AS (SELECT DISTINCT pair_id, a, b, label FROM phase3_identity_pairs), r1 AS (SELECT unnest([a, b]) AS x FROM p), r2 AS (SELECT list_filter(x.external_ids, lambda y: starts_with(y, 'mention:'))[1] AS key, x.mention AS mention, x.type AS type, coalesce(x.emails, []) AS emails, coalesce(x.external_ids, []) AS ids FROM r1),
  rec AS (SELECT key, min(mention) AS mention, min(type) AS type, list_distinct(flatten(list(emails))) AS emails, list_distinct(flatten(list(ids))) AS ids FROM r2 GROUP BY 1)"""
_M = "lower(trim(coalesce(mention, '')))"
_KEYS = f"""k0 AS (SELECT *, list_filter(list_transform(list_append(emails, mention), lambda e: lower(trim(e))), lambda e: regexp_matches(e, '{_EM}') AND NOT {_ISROLE.format('e')}) AS boxes, lower(regexp_replace(trim(mention), '^@', '')) AS u, lower(type) = 'username' AS isu,
    list_sort(list_distinct(list_filter(string_split_regex(CASE WHEN regexp_matches({_M}, '{_EM}') AND {_ISROLE.format(_M)} THEN '' WHEN regexp_matches({_M}, '{_EM}') THEN split_part({_M}, '@', 1) ELSE regexp_replace({_M}, '{_SUF}', '') END, '[^a-z0-9]+'), lambda t: t <> ''))) AS t FROM rec),
  k1 AS (SELECT *, list_transform(boxes, lambda e: {_LOC.format('e')}) AS locals_, CASE WHEN isu THEN [u] ELSE [] END AS users, CASE WHEN isu AND {_BASE.format('u')} <> '' THEN [{_BASE.format('u')}] ELSE [] END AS bases FROM k0),
  k2 AS (SELECT key, list_sort(list_distinct(list_filter(flatten([list_transform(boxes, lambda x: 'e:' || x), list_transform(locals_, lambda x: 'l:' || x), list_transform(users, lambda x: 'u:' || x), list_transform(bases, lambda x: 'b:' || x),
    list_transform(list_filter(list_transform(ids, lambda x: lower(trim(x))), lambda x: x <> '' AND NOT starts_with(x, 'mention:')), lambda x: 'x:' || x), list_transform(t, lambda x: 't:' || x), CASE WHEN len(t) > 0 THEN ['n:' || array_to_string(t, ' ')] ELSE [] END,
    list_transform(list_concat(list_transform(locals_, lambda x: replace(x, '.', '')), list_concat(list_transform(users, lambda x: replace(x, '.', '')), bases)), lambda x: 'c:' || x)]), lambda x: x IS NOT NULL))) AS keys FROM k1),
  rep AS (SELECT key, min(key) OVER (PARTITION BY keys) AS rep, keys FROM k2)"""

ORACLES = {
    "D17_representatives": f"WITH {_F}, {_REC}, {_KEYS} SELECT key, rep FROM rep",
    "D17_blocking": f"WITH {_F}, {_REC}, {_KEYS}, e AS (SELECT DISTINCT rep, unnest(keys) AS k FROM rep) SELECT a.rep AS key_a, b.rep AS key_b, count(*) AS shared_keys FROM e a JOIN e b ON a.k = b.k AND a.rep < b.rep GROUP BY 1, 2",
    "J07_clusters": f"""WITH RECURSIVE {_F}, ed AS (SELECT list_filter(a.external_ids, lambda y: starts_with(y, 'mention:'))[1] AS u, list_filter(b.external_ids, lambda y: starts_with(y, 'mention:'))[1] AS v, decision, score, len(a_emails) AS ea, len(b_emails) AS eb FROM d), nd AS (SELECT u AS n FROM ed UNION SELECT v FROM ed),
      m AS (SELECT u, v FROM ed WHERE decision = 'MERGE' UNION SELECT v, u FROM ed WHERE decision = 'MERGE'), w AS (SELECT n, n AS o FROM nd UNION SELECT w.n, m.v FROM w JOIN m ON w.o = m.u), c1 AS (SELECT n, min(o) AS c FROM w GROUP BY 1),
      rv AS (SELECT x.c AS u, y.c AS v FROM ed JOIN c1 x ON x.n = u JOIN c1 y ON y.n = v WHERE decision = 'REVIEW' AND score >= 0.8), rb AS (SELECT u, v FROM rv UNION SELECT v, u FROM rv), w2 AS (SELECT DISTINCT c AS n, c AS o FROM c1 UNION SELECT w2.n, rb.v FROM w2 JOIN rb ON w2.o = rb.u), c2 AS (SELECT n, min(o) AS c FROM w2 GROUP BY 1),
      an AS (SELECT u AS n FROM ed WHERE ea > 0 UNION SELECT v FROM ed WHERE eb > 0), hd AS (SELECT DISTINCT c2.c FROM an JOIN c1 USING (n) JOIN c2 ON c2.n = c1.c) SELECT c1.n AS node, CASE WHEN c2.c IN (SELECT c FROM hd) THEN c2.c ELSE c1.c END AS cluster FROM c1 JOIN c2 ON c2.n = c1.c""",
    "J04_features": f"WITH {_F} SELECT pair_id, email_match, email_username_match, external_id_match, username_match, shared, round({_NS}, 6) AS name_similarity FROM f",
    "J05_scores": f"WITH {_F} SELECT pair_id, score, signals FROM sc",
    "J06_decisions": f"WITH {_F} SELECT pair_id, decision FROM d",
    "E14_evaluation": f"""WITH {_F} SELECT count(*) AS pairs, count(*) FILTER ((gold = 'SAME_ENTITY' AND decision = 'MERGE') OR (gold = 'DIFFERENT_ENTITY' AND decision = 'KEEP_SEPARATE') OR (gold = 'UNCERTAIN' AND decision IN ('REVIEW', 'ABSTAIN'))) AS correct,
      count(*) FILTER (decision = 'MERGE' AND gold = 'DIFFERENT_ENTITY') AS false_merges, count(*) FILTER (decision = 'KEEP_SEPARATE' AND gold = 'SAME_ENTITY') AS false_splits, count(*) FILTER (decision = 'MERGE' AND gold = 'SAME_ENTITY') AS true_merges,
      count(*) FILTER (decision = 'MERGE') AS merges, count(*) FILTER (gold = 'SAME_ENTITY') AS same, count(*) FILTER (decision = 'REVIEW') AS reviews, count(*) FILTER (decision = 'ABSTAIN') AS abstentions FROM d WHERE gold IS NOT NULL""",
    "E15_threshold_sweep": f"""WITH {_F} SELECT threshold, count(*) AS pairs, count(*) FILTER (score >= threshold) AS merges, count(*) FILTER (score >= threshold AND gold = 'DIFFERENT_ENTITY') AS false_merges,
      count(*) FILTER (score >= threshold AND gold = 'SAME_ENTITY') AS true_merges FROM d, (SELECT unnest([0.55, 0.8, 0.85, 0.88, 0.9, 0.92, 0.97]::DOUBLE[]) AS threshold) WHERE gold IS NOT NULL GROUP BY 1""",
    "E16_feature_coverage": f"""WITH {_F}, n AS (SELECT *, {_NS} AS name_similarity FROM f), u AS ({" UNION ALL ".join(f"SELECT '{n}' AS feature, {n} AS value FROM n" for n in ("email_match", "email_username_match", "external_id_match", "username_match", "name_similarity"))})
      SELECT feature, count(*) AS pairs, count(value) AS present, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM u GROUP BY 1""",
    "A37_identity_pairs": f"WITH {_F} SELECT pair_id, a.mention AS mention_a, b.mention AS mention_b, gold FROM d",
}
