"""Queries on claims, artifacts, documents and questions as texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.functions.text import mention_key, thread_key
from factweave.operators import claims as C
from factweave.operators import contract
from factweave.operators import extract as X
from factweave.operators import inventory as V
from factweave.operators import normalize as N
from factweave.operators import questions as Q
from factweave.sources.tables import table


def claims(spark, folder):
    return table(spark, folder, "claims_checkpoint50")


def artifacts(spark, folder):
    return table(spark, folder, "artifacts")


def documents(spark, folder):
    return table(spark, folder, "documents")


def mails(spark, folder):
    return artifacts(spark, folder).where("source = 'gmail' and content is not null").select("id", "content").distinct()


def chats(spark, folder):
    a = artifacts(spark, folder).where("source = 'slack'")
    return a.select("id", "content", F.col("metadata.message_id").alias("message_id"), F.col("metadata.channel_id").alias("channel_id"), F.col("metadata.author_user_id").alias("author")).distinct()


def extraction_scores(spark, folder, by=None):
    """Facts of one extraction method held against those of all others."""
    c = claims(spark, folder).select("predicate", "extraction_method", F.concat_ws("|", mention_key(F.col("subject_mention")), mention_key(F.col("object_mention"))).alias("item"))
    c = c.withColumn("predicate", F.upper(F.trim("predicate")))
    return V.prf(c.where("extraction_method = 'deterministic'"), c.where("extraction_method <> 'deterministic'"), by)


def mail_headers(spark, folder):
    m = mails(spark, folder)
    name, box = N.address(N.header(F.col("content"), "From"))
    return m.select("id", F.coalesce(N.header(F.col("content"), "Subject"), F.lit("")).alias("subject"), F.coalesce(box, F.lit("")).alias("sender"), F.coalesce(name, F.lit("")).alias("sender_name"))


def quoted(spark, folder):
    new, old = N.split_quoted(F.regexp_replace("content", r"(?s)^.*?\n\n", ""))
    return mails(spark, folder).select("id", F.length(new).alias("new_chars"), F.coalesce(F.length(old), F.lit(0)).alias("quoted_chars"))


def decomposed(spark, folder):
    q = Q.decomposed(table(spark, folder, "retrieval_questions").select("question_id", "question"), "question")
    return q.select("question_id", "intent", F.array_join("mentions", "|").alias("mentions"), F.array_join("predicates", "|").alias("predicates"), F.array_join("times", "|").alias("times"), Q.route(F.col("times"), F.col("intent")).alias("route"))


def lexicon(spark, folder):
    """Objects of claims found in the documents."""
    entries = claims(spark, folder).select(mention_key(F.col("object_mention")).alias("entity"), mention_key(F.col("object_mention")).alias("phrase")).where("length(entity) >= 3").distinct()
    return X.lexicon_matches(documents(spark, folder).select(F.col("doc_id").cast("string").alias("artifact_id"), F.col("text").alias("content")), entries).select("artifact_id", "entity", "word_at")


def html_text(spark, folder):
    safe = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<html><style>p{}</style><p class=x>"), safe, F.lit("</p> <script>x()</script><b>"), F.col("doc_id").cast("string"), F.lit("</b>&nbsp;&lt;ok&gt;</html>"))
    return documents(spark, folder).select("doc_id", N.strip_html(page).alias("text"))


def threads(spark, folder):
    """Threads as text; a thread id of an unknown form stands for itself, a blank one for no thread."""
    m = F.col("metadata")
    thread = F.coalesce(thread_key(m["thread_id"]), F.nullif(F.trim(m["thread_id"]), F.lit("")))
    rows = artifacts(spark, folder).where("source = 'slack'").select(
        m["channel_id"].alias("channel_id"), thread.alias("thread_id"), m["message_id"].alias("message_id"), "author",
        N.chat_body(F.col("content"), m["author_display_name"], F.col("author")).alias("body"),
    )
    return N.thread_text(rows.where("thread_id is not null").distinct(), ["channel_id", "thread_id"], "message_id", "author", "body")


def statuses(spark, folder):
    """Latest status of an event stream keyed by user: the last row wins, earlier ones are attempts."""
    e = table(spark, folder, "events")
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count(F.lit(1)).alias("attempts"))


QUERIES = {
    "B03_artifact_ids": lambda s, d: artifacts(s, d).select("source", "source_id").distinct().select("source", "source_id", C.artifact_id(F.col("source"), F.col("source_id")).alias("made_id")),
    "B08_mention_keys": lambda s, d: claims(s, d).select("claim_id", mention_key(F.col("subject_mention")).alias("subject_key"), mention_key(F.col("object_mention")).alias("object_key")).distinct(),
    "B10_claim_ids": lambda s, d: claims(s, d).select(C.short_hash(*[F.col(c) for c in ("artifact_id", "subject_mention", "predicate", "object_mention")]).alias("made_id")).groupBy("made_id").agg(F.count(F.lit(1)).alias("rows")),
    "B07_mail_headers": mail_headers,
    "B11_slack_times": lambda s, d: chats(s, d).select("message_id").distinct().select("message_id", N.slack_time(F.col("message_id")).alias("at")),
    "B12_mentions": lambda s, d: artifacts(s, d).select("id", F.array_join(N.mentions(F.concat_ws(" ", F.array_join("metadata.mentions", " "), "content")), ",").alias("mentions")).where("mentions <> ''").distinct(),
    "B12_links": lambda s, d: documents(s, d).select("doc_id", F.array_join(N.links(F.col("text")), ",").alias("links")).where("links <> ''"),
    "B13_thread_text": threads,
    "B18_quoted_history": quoted,
    "B22_html_text": html_text,
    "C08_artifact_problems": lambda s, d: N.validated(artifacts(s, d)).select(F.array_join("problems", ",").alias("problems")).groupBy("problems").agg(F.count(F.lit(1)).alias("rows")),
    "C15_prefix_filter": lambda s, d: documents(s, d).where(F.col("account_key").startswith("account:b")).select("doc_id"),
    "E04_mention_inventory": lambda s, d: V.mention_inventory(V.mentions(claims(s, d))).drop("spelling"),
    "E05_quality": lambda s, d: V.quality(documents(s, d).withColumn("source", F.lower("source")), "source", "text"),
    "E06_corpus_inventory": lambda s, d: documents(s, d).groupBy(F.lower("source").alias("source")).agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.min("doc_id").alias("first_id")),
    "D22_source_overlap": lambda s, d: V.source_overlap(documents(s, d).select(F.lower("source").alias("source"), F.col("account_key").alias("item"))),
    "E10_precision_recall": lambda s, d: extraction_scores(s, d),
    "E11_by_predicate": lambda s, d: extraction_scores(s, d, ["predicate"]),
    "E18_latency": lambda s, d: V.latency(table(s, d, "events"), "event_type", "value"),
    "F12_first_per_key": lambda s, d: V.first_per(table(s, d, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]),
    "F13_round_robin": lambda s, d: V.round_robin(table(s, d, "retrieval_questions").select("question_id", "question_type"), "question_type", [V.hash_order("question_id", "s1"), F.col("question_id")], 75),
    "F14_stratified": lambda s, d: V.top_per(documents(s, d).select("doc_id", F.lower("source").alias("source")), ["source"], [V.hash_order("doc_id", "s1"), F.col("doc_id")], 20),
    "F15_regression_pick": lambda s, d: table(s, d, "retrieval_questions").select("question_id", (F.size("expected_doc_ids") > 1).cast("int").alias("in_pool")).orderBy(F.desc("in_pool"), V.hash_order("question_id", "s1")).limit(10),
    "G03_candidates_per_key": lambda s, d: V.top_per(claims(s, d).groupBy(mention_key(F.col("subject_mention")).alias("subject"), mention_key(F.col("object_mention")).alias("object")).agg(F.count(F.lit(1)).alias("n")), ["subject"], [F.desc("n"), F.col("object")], 10),
    "G04_top_claims": lambda s, d: claims(s, d).select("claim_id", "artifact_id", "predicate", "confidence").distinct().orderBy(F.desc("confidence"), "artifact_id", "predicate", "claim_id").limit(50),
    "G07_page": lambda s, d: V.page(table(s, d, "events").select("event_id", "user_id"), "event_id", 100, 50),
    "H01_union": lambda s, d: claims(s, d).select(mention_key(F.col("subject_mention")).alias("key")).union(claims(s, d).select(mention_key(F.col("object_mention")))).distinct(),
    "H02_intersect": lambda s, d: claims(s, d).select(mention_key(F.col("subject_mention")).alias("key")).intersect(claims(s, d).select(mention_key(F.col("object_mention")))),
    "H02_except": lambda s, d: claims(s, d).select(mention_key(F.col("subject_mention")).alias("key")).subtract(claims(s, d).select(mention_key(F.col("object_mention")))),
    "D26_orphan_claims": lambda s, d: claims(s, d).join(artifacts(s, d).select(F.col("id").alias("artifact_id")), "artifact_id", "left_anti").select("claim_id").distinct(),
    "A14_latest_status": statuses,
    "M01_decompose": decomposed,
    "M01_intents": lambda s, d: decomposed(s, d).select("question_id", "intent", "predicates"),
    "D25_lexicon": lexicon,
    "K01_mentions": lambda s, d: X.mentions(artifacts(s, d).select("id", "source", "content").distinct()).groupBy("type").agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("raw_text").alias("texts")),
    "K02_claims": lambda s, d: X.claims(artifacts(s, d).select("id", "title", "content").distinct()).select("artifact_id", "subject_mention", "predicate", "object_mention", "confidence"),
    "B10_made_claims": lambda s, d: X.claims(artifacts(s, d).select("id", "title", "content").distinct()).select("claim_id", C.short_hash(F.col("artifact_id"), F.col("subject_mention"), F.col("predicate"), F.col("object_mention")).alias("again")),
    "B09_mentions": lambda s, d: X.mentions(artifacts(s, d).select("id", "source", "content").distinct()).where("type = 'ticket'").select("artifact_id", "raw_text", "span_start", "span_end", "context").distinct(),
}

_K = "lower(trim(regexp_replace(trim(regexp_replace({}, '\\s+', ' ', 'g')), '^@', '')))"
_S, _O = _K.format("subject_mention"), _K.format("object_mention")
_CL = "claims_checkpoint50"
_BLANK = "(regexp_replace(coalesce({}, ''), '\\s+', '', 'g') = '')"
_INTENT = "CASE " + " ".join(f"WHEN regexp_matches(lower(question), '{p}') THEN '{n}'" for n, p in Q.INTENTS) + " ELSE 'GENERIC' END"


def _prf(by: str) -> str:
    g, u = (f"{by}, ", f"USING ({by}, item)") if by else ("", "USING (item)")
    return f"""WITH c AS (SELECT upper(trim(predicate)) AS predicate, extraction_method, {_S} || '|' || {_O} AS item FROM {_CL}),
      p AS (SELECT DISTINCT {g}item, 1 AS p FROM c WHERE extraction_method = 'deterministic'), g AS (SELECT DISTINCT {g}item, 1 AS g FROM c WHERE extraction_method <> 'deterministic'),
      n AS (SELECT {g}count(*) FILTER (p = 1 AND g = 1) AS tp, count(*) FILTER (p = 1 AND g IS NULL) AS fp, count(*) FILTER (p IS NULL AND g = 1) AS fn FROM p FULL JOIN g {u} {"GROUP BY " + by if by else ""})
      SELECT {g}tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 4) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 4) AS recall,
      round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END, 4) AS f1 FROM n"""


_NOT = "(" + ", ".join(f"'{w}'" for w in contract.NO_ENTITY) + ")"


def _found(no: int) -> str:
    predicate, pattern, s, o, confidence = X.CLAIM_PATTERNS[no]
    p = pattern.replace("'", "''")
    side = lambda g, missing: f"trim(unnest(regexp_extract_all(content, '{p}', {g})))" if g else f"coalesce(nullif(trim(title), ''), '{missing}')"
    # Both groups of a match are unnested side by side.
    return f"SELECT id AS artifact_id, {side(s, X.NO_SUBJECT)} AS s, '{predicate}' AS predicate, {side(o, X.NO_OBJECT)} AS o, {confidence}::DOUBLE AS confidence FROM a"


_UNSEEN = r"[\s\p{Z}\p{Cf}\p{Cc}]"
_HEAD = "trim(nullif(regexp_extract(content, '(?mi)^{}:[ \\t]*(\\S[^\\n]*)$', 1), ''))"
_MARK = N.QUOTE_MARKS.replace("'", "''")
_MAILS = "(SELECT DISTINCT id, content FROM artifacts WHERE source = 'gmail' AND content IS NOT NULL)"
_ROWS = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_PREDS = "[" + ", ".join(f"CASE WHEN regexp_matches(lower(question), '{p}') THEN '{n}' END" for n, p in Q.HINTS) + "]"
_THREAD = f"regexp_replace(regexp_replace(metadata.thread_id, '{_UNSEEN}+', '', 'g'), '^[pP](\\d{{10}})(\\d{{6}})$', '\\1.\\2')"
_TEXT = "ltrim(regexp_replace(regexp_replace(content, '^\\s*#[^\\n]*', ''), '^\\s+', ''))"
_STRIP = "CASE WHEN starts_with(x, trim({0}) || ':') THEN substr(x, length(trim({0})) + 2)"

ORACLES = {
    "B07_mail_headers": f"""WITH h AS (SELECT id, {_HEAD.format('From')} AS f, {_HEAD.format('Subject')} AS s FROM {_MAILS}), a AS (SELECT id, coalesce(s, '') AS subject, coalesce(lower(regexp_extract(f, '[\\w.+-]+@[\\w-]+\\.[\\w.-]+')), '') AS sender, trim(replace(regexp_replace(coalesce(f, ''), '<[^>]*>', '', 'g'), '"', '')) AS n FROM h)
      SELECT id, subject, sender, CASE WHEN n <> '' AND (sender = '' OR lower(n) <> sender) THEN n ELSE '' END AS sender_name FROM a""",
    "B13_thread_text": f"""WITH t AS (SELECT metadata.channel_id AS channel_id, {_THREAD} AS k, trim(metadata.thread_id) AS raw, metadata.message_id AS message_id, author, metadata.author_display_name AS n, {_TEXT} AS x FROM artifacts WHERE source = 'slack'),
      r AS (SELECT DISTINCT channel_id, CASE WHEN regexp_matches(k, '^\\d{{10}}(\\.\\d{{0,6}})?$') THEN left(k, 10) || '.' || rpad(substr(k, 12, 6), 6, '0') ELSE nullif(raw, '') END AS thread_id, message_id, author, {_STRIP.format('n')} {_STRIP.format('author').replace('CASE ', '')} ELSE x END AS b FROM t),
      l AS (SELECT channel_id, thread_id, message_id, coalesce(author, 'unknown') || ': ' || trim({_ROWS.format('b')}) AS line FROM r WHERE thread_id IS NOT NULL AND regexp_replace(b, '{_UNSEEN}+', '', 'g') <> '')
      SELECT channel_id, thread_id, string_agg(line, chr(10) ORDER BY message_id, line) AS text FROM l GROUP BY ALL""",
    "B18_quoted_history": f"""WITH b AS (SELECT id, regexp_replace(content, '(?s)^.*?\\n\\n', '') AS t FROM {_MAILS}), p AS (SELECT id, t, regexp_matches(t, '{_MARK}') AS q, string_split_regex(t, '{_MARK}')[1] AS before FROM b),
      n AS (SELECT id, t, q, {_ROWS.format('before')} AS new, {_ROWS.format('substr(t, length(before) + 1)')} AS old FROM p) SELECT id, length(CASE WHEN q AND new <> '' THEN new ELSE t END) AS new_chars, CASE WHEN q AND new <> '' THEN length(old) ELSE 0 END AS quoted_chars FROM n""",
    "C08_artifact_problems": """WITH a AS (SELECT *, lower(source) = 'slack' AS chat, lower(source) = 'gmail' AS mail FROM artifacts) SELECT concat_ws(',', CASE WHEN NOT coalesce(regexp_matches(id, '^dsid_[0-9a-f]{32}$'), false) THEN 'id' END, CASE WHEN trim(coalesce(source, '')) = '' THEN 'source' END, CASE WHEN trim(coalesce(content, '')) = '' THEN 'content' END,
      CASE WHEN chat AND trim(coalesce(metadata.channel_id, '')) = '' THEN 'channel_id' END, CASE WHEN (chat OR mail) AND trim(coalesce(metadata.message_id, '')) = '' THEN 'message_id' END, CASE WHEN mail AND trim(coalesce(metadata.thread_id, '')) = '' THEN 'thread_id' END) AS problems, count(*) AS rows FROM a GROUP BY 1""",
    "E05_quality": f"""WITH d AS (SELECT lower(source) AS source, coalesce(text, '') AS t FROM documents), n AS (SELECT source, count(*) AS records, count(*) FILTER (regexp_replace(t, '\\s+', '', 'g') = '') AS blank, CAST(min(length(t)) AS INTEGER) AS shortest, CAST(max(length(t)) AS INTEGER) AS longest,
      {", ".join(f"CAST(sum(len(regexp_extract_all(t, '{p}'))) AS BIGINT) AS {n}" for n, p in V.QUALITY.items())} FROM d GROUP BY 1), c AS (SELECT source, CAST(sum(k - 1) AS BIGINT) AS copies FROM (SELECT source, t, count(*) AS k FROM d WHERE regexp_replace(t, '\\s+', '', 'g') <> '' GROUP BY 1, 2) GROUP BY 1) SELECT n.*, coalesce(copies, 0) AS copies FROM n LEFT JOIN c USING (source)""",
    "M01_intents": f"SELECT question_id, {_INTENT} AS intent, array_to_string(list_filter({_PREDS}, lambda x: x IS NOT NULL), '|') AS predicates FROM retrieval_questions",
    "K02_claims": f"""WITH a AS (SELECT DISTINCT id, title, content FROM artifacts WHERE content IS NOT NULL), f AS ({" UNION ALL ".join(map(_found, range(len(X.CLAIM_PATTERNS))))})
      SELECT artifact_id, s AS subject_mention, predicate, o AS object_mention, max(confidence) AS confidence FROM f WHERE length(s) >= 3 AND length(o) >= 3 AND lower(s) NOT IN {_NOT} AND lower(o) NOT IN {_NOT} GROUP BY ALL""",
    "B10_made_claims": f"""WITH a AS (SELECT DISTINCT id, title, content FROM artifacts WHERE content IS NOT NULL), f AS ({" UNION ALL ".join(map(_found, range(len(X.CLAIM_PATTERNS))))}),
      h AS (SELECT DISTINCT left(sha256(artifact_id || '|' || s || '|' || predicate || '|' || o), 16) AS claim_id FROM f WHERE length(s) >= 3 AND length(o) >= 3 AND lower(s) NOT IN {_NOT} AND lower(o) NOT IN {_NOT}) SELECT claim_id, claim_id AS again FROM h""",
    "D25_lexicon": f"""WITH e AS (SELECT DISTINCT {_O} AS entity FROM {_CL} WHERE length({_O}) >= 3), p AS (SELECT entity, regexp_extract_all(lower(entity), '[\\p{{L}}\\p{{N}}]+') AS p FROM e), d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL),
      x AS (SELECT doc_id, w, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) SELECT CAST(doc_id AS VARCHAR) AS artifact_id, entity, CAST(min(i) AS INTEGER) AS word_at FROM x JOIN p ON p[1] = word AND list_slice(w, i, i + len(p) - 1) = p GROUP BY ALL""",
    "B03_artifact_ids": "SELECT DISTINCT source, source_id, 'dsid_' || left(sha256(source || '|' || source_id), 32) AS made_id FROM artifacts",
    "B08_mention_keys": f"SELECT DISTINCT claim_id, {_S} AS subject_key, {_O} AS object_key FROM {_CL}",
    "B10_claim_ids": f"SELECT left(sha256(coalesce(artifact_id, '') || '|' || coalesce(subject_mention, '') || '|' || coalesce(predicate, '') || '|' || coalesce(object_mention, '')), 16) AS made_id, count(*) AS rows FROM {_CL} GROUP BY 1",
    "B11_slack_times": "SELECT DISTINCT metadata.message_id AS message_id, strftime(make_timestamp(CAST(floor(CAST(metadata.message_id AS DOUBLE)) AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS at FROM artifacts WHERE source = 'slack'",
    "B12_links": r"SELECT * FROM (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, 'https?://[^\s<>|)\]]+'), lambda x: regexp_replace(x, '[.,;:!?]+$', '')), ',') AS links FROM documents) WHERE links <> ''",
    "B22_html_text": "SELECT doc_id, trim(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) || ' ' || doc_id || ' <ok>') AS text FROM documents",
    "C15_prefix_filter": "SELECT doc_id FROM documents WHERE starts_with(account_key, 'account:b')",
    "E04_mention_inventory": f"""WITH m AS (SELECT subject_mention AS mention, 'subject' AS role, claim_id, artifact_id, extraction_method AS method FROM {_CL} UNION ALL SELECT object_mention, 'object', claim_id, artifact_id, extraction_method FROM {_CL})
      SELECT {_K.format('mention')} AS key, role, count(*) AS frequency, count(DISTINCT claim_id) AS claims, count(DISTINCT artifact_id) AS artifacts, count(DISTINCT method) AS methods FROM m WHERE NOT {_BLANK.format('mention')} GROUP BY 1, 2""",
    "E06_corpus_inventory": "SELECT lower(source) AS source, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars, min(n_chars) AS least, max(n_chars) AS most, min(doc_id) AS first_id FROM documents GROUP BY 1",
    "D22_source_overlap": "WITH i AS (SELECT DISTINCT lower(source) AS source, account_key AS item FROM documents WHERE source IS NOT NULL AND account_key IS NOT NULL) SELECT a.source AS source_a, b.source AS source_b, count(*) AS shared FROM i a JOIN i b ON a.item = b.item AND a.source < b.source GROUP BY 1, 2",
    "E10_precision_recall": _prf(""),
    "E11_by_predicate": _prf("predicate"),
    "E18_latency": "SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99 FROM events GROUP BY 1",
    "F12_first_per_key": "SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1",
    "F13_round_robin": "WITH r AS (SELECT question_id, question_type, CAST(row_number() OVER (PARTITION BY question_type ORDER BY md5('s1|' || question_id), question_id) AS INTEGER) AS turn FROM retrieval_questions) SELECT * FROM r ORDER BY turn, question_type LIMIT 75",
    "F14_stratified": "SELECT doc_id, source, rank FROM (SELECT doc_id, lower(source) AS source, CAST(row_number() OVER (PARTITION BY lower(source) ORDER BY md5('s1|' || doc_id), doc_id) AS INTEGER) AS rank FROM documents) WHERE rank <= 20",
    "F15_regression_pick": "SELECT question_id, CAST(len(expected_doc_ids) > 1 AS INTEGER) AS in_pool FROM retrieval_questions ORDER BY in_pool DESC, md5('s1|' || question_id) LIMIT 10",
    "G03_candidates_per_key": f"WITH g AS (SELECT {_S} AS subject, {_O} AS object, count(*) AS n FROM {_CL} GROUP BY 1, 2) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY subject ORDER BY n DESC, object) AS INTEGER) AS rank FROM g) WHERE rank <= 10",
    "G04_top_claims": f"SELECT DISTINCT claim_id, artifact_id, predicate, confidence FROM {_CL} ORDER BY confidence DESC, artifact_id, predicate, claim_id LIMIT 50",
    "G07_page": "SELECT event_id, user_id FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 50",
    "H01_union": f"SELECT {_S} AS key FROM {_CL} UNION SELECT {_O} FROM {_CL}",
    "H02_intersect": f"SELECT {_S} AS key FROM {_CL} INTERSECT SELECT {_O} FROM {_CL}",
    "H02_except": f"SELECT {_S} AS key FROM {_CL} EXCEPT SELECT {_O} FROM {_CL}",
    "D26_orphan_claims": f"SELECT DISTINCT claim_id FROM {_CL} WHERE artifact_id NOT IN (SELECT id FROM artifacts)",
    "A14_latest_status": "SELECT user_id, last(event_type ORDER BY ts, event_id) AS status, count(*) AS attempts FROM events GROUP BY 1",
}
