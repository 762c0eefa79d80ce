"""Queries on records and artifacts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.operators import normalize as N
from factweave.operators import records as R
from factweave.sources.tables import table


def files(spark, folder):
    """The documents as raw files with slugs of every form."""
    d, k = table(spark, folder, "documents"), F.col("doc_id")
    slug = (
        F.when(k % 6 == 0, F.concat(F.unix_seconds(F.coalesce("created_at", F.lit("2024-01-01 00:00:00")).cast("timestamp")).cast("string"), F.lit("-note"))).when(k % 6 == 1, F.concat(F.date_format("created_at", "yyyy-MM-dd"), F.lit("_note")))
        .when(k % 6 == 2, F.concat(F.date_format("created_at", "yyyy-MM"), F.lit("-note"))).when(k % 6 == 3, F.concat(F.date_format("created_at", "yyyyMMdd"), F.lit("-note"))).otherwise("plain-note")
    )
    name = F.when(k % 50 == 7, F.lit("readme.md")).otherwise(F.concat("dsid", F.lit("__"), F.coalesce(slug, F.lit("x")), F.lit(".txt")))
    return d.select(F.lower(F.trim("source")).alias("source"), F.concat(F.lit("raw/"), F.lower("source"), F.lit("/"), name).alias("path"), "text")


def chats(spark, folder):
    m = F.col("metadata")
    a = table(spark, folder, "artifacts").where("source = 'slack'")
    rows = a.select(m["channel_id"].alias("channel_id"), m["channel_name"].alias("channel_name"), F.trim(m["thread_id"]).alias("thread_id"), m["message_id"].alias("message_id"), m["author_user_id"].alias("user_id"), m["author_display_name"].alias("user_name"), N.chat_body(F.col("content"), m["author_display_name"], F.col("author")).alias("text"))
    return rows.where("channel_id is not null and thread_id rlike '^[0-9]{10}[.][0-9]{6}$'").groupBy("channel_id", "thread_id", "message_id").agg(*[F.min(c).alias(c) for c in ("channel_name", "user_id", "user_name", "text")])


def mails(spark, folder):
    m = F.col("metadata")
    a = table(spark, folder, "artifacts").where("source = 'gmail' and content is not null").groupBy(m["message_id"].alias("message_id")).agg(F.min(m["thread_id"]).alias("thread_id"), F.min("content").alias("content"))
    return a.select(R.text_mail(F.col("message_id"), F.coalesce("thread_id", "message_id"), F.col("content")).alias("x")).select("x.*")


def services(spark, folder):
    """The mails as JSON of a mail service, the body nested in parts, read back."""
    m = mails(spark, folder)
    code = F.translate(F.base64(F.encode(F.col("body"), "UTF-8")), "+/=\r\n", "-_")
    head = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in (("From", F.col("sender")), ("TO", F.array_join("recipients", ", ")), ("Subject", F.col("subject")), ("Date", F.coalesce("sent", F.lit(""))))])
    leaf = F.struct(F.lit("text/plain").alias("mimeType"), F.struct(code.alias("data")).alias("body"))
    file = F.struct(F.lit("application/pdf").alias("mimeType"), F.lit("a.pdf").alias("filename"))
    mixed = F.struct(F.lit("multipart/mixed").alias("mimeType"), F.array(F.struct(F.lit("multipart/alternative").alias("mimeType"), F.array(leaf).alias("parts"))).alias("parts"))
    record = F.to_json(F.struct(F.col("message_id").alias("id"), F.col("thread_id").alias("threadId"), F.struct(head.alias("headers"), F.array(F.to_json(mixed), F.to_json(file)).alias("raw")).alias("payload")))
    # Parts of different shapes are one JSON list.
    record = F.replace(F.replace(F.replace(F.replace(record, F.lit('\\"'), F.lit('"')), F.lit('"raw":["'), F.lit('"parts":[')), F.lit('","{'), F.lit(",{")), F.lit('}"]'), F.lit("}]"))
    plain = m.where("not body rlike '[\"\\\\\\\\]' and not sender rlike '[\"\\\\\\\\]' and not subject rlike '[\"\\\\\\\\]' and not array_join(recipients, '') rlike '[\"\\\\\\\\]'")
    return R.api_mails(plain.select(record.alias("json")), "json")


def enveloped(spark, folder):
    d = table(spark, folder, "documents")
    dated = F.concat_ws("\n", F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 5 == 0, "2024-03-04 - began"), F.when(F.col("doc_id") % 5 == 1, "- 2024-04-05: changed"), F.when(F.col("doc_id") % 5 == 2, "Ann is taking over Acme next Friday"), F.when(F.col("doc_id") % 5 == 3, "effective 2024-06-01 until 2024-05-01"), F.when(F.col("doc_id") % 5 == 4, "from 2024-01-01 until 2024-07-01"))
    return R.envelope(d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")).alias("timestamp"), dated.alias("content")))


def texts(c):
    return F.array_join(c, ",")


QUERIES = {
    "B01_raw_artifacts": lambda s, d: R.raw_artifacts(files(s, d)).select("id", "source", "type", "author", "timestamp", "title", "slug", "attendees", "noise", "ts_source", F.length("content").alias("chars")),
    "B02_live_artifacts": lambda s, d: R.live_artifacts(table(s, d, "artifacts").select("source", F.col("source_id").alias("native_source_id"), "content"))[0].select("id", "source", F.col("source_id").alias("native")).distinct(),
    "B02_rejected": lambda s, d: R.live_artifacts(table(s, d, "artifacts").select("source", F.col("source_id").alias("native_source_id"), "content"))[1].groupBy("reason").agg(F.count(F.lit(1)).alias("rows")),
    "B04_slug_times": lambda s, d: files(s, d).select("path", R.slug_time(F.regexp_extract("path", r"__(.*)[.]txt$", 1)).alias("slug_at")).where("slug_at is not null"),
    "B06_first_iso": lambda s, d: table(s, d, "documents").select("doc_id", R.first_iso(F.col("text")).alias("iso_time")).where("iso_time is not null"),
    "B14_participants": lambda s, d: R.participants(chats(s, d), ["channel_id", "thread_id"], "message_id", "user_id", "user_name").select("channel_id", "thread_id", texts(F.transform("participants", lambda p: p["user_id"])).alias("users")),
    "B17_chat_artifacts": lambda s, d: R.chat_artifacts(chats(s, d)).select("channel_id", "thread_id", "id", "title", "content", "author", "timestamp", "reply_count"),
    "B20_mail_artifacts": lambda s, d: R.mail_artifacts(mails(s, d)).select("id", "message_id", "title", "author", F.length("content").alias("chars"), texts("participants").alias("participants"), "has_quoted_history"),
    "B21_api_mails": lambda s, d: services(s, d).select("message_id", "thread_id", "subject", "sender", texts("recipients").alias("recipients"), "body", texts("attachments").alias("attachments")),
    "B24_envelope": lambda s, d: enveloped(s, d).select("doc_id", F.coalesce("email_from", F.lit("")).alias("email_from"), F.coalesce("email_to", F.lit("")).alias("email_to"), texts("revision_dates").alias("revisions"), texts("timeline_dates").alias("timeline"), F.coalesce("meeting_date", F.lit("")).alias("meeting")),
    "B24_tickets": lambda s, d: enveloped(s, d).select("doc_id", F.explode("ticket_ids").alias("ticket")),
    "B25_resolved_times": lambda s, d: R.resolved_times(enveloped(s, d)).select("doc_id", "observed_at", "observed_source", "valid_from", "valid_to"),
    "B33_links": lambda s, d: table(s, d, "artifacts").select(R.chat_link(F.lit("acme"), F.col("metadata.channel_id"), F.col("metadata.message_id")).alias("chat"), R.mail_link(F.col("metadata.message_id")).alias("mail")).distinct(),
}

_TYPE = "CASE source " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.TYPES.items()) + " END"
_IN = "(" + ", ".join(f"'{k}'" for k in R.TYPES) + ")"


def _x(text: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({text}, '{pattern}', {group}), '')"


def _slug(s: str) -> str:
    y, m, d = (_x(s, R.DATE_SLUG, g) for g in (1, 2, 3))
    return f"CASE WHEN regexp_matches({s}, '{R.EPOCH_SLUG}') THEN strftime(make_timestamp(CAST({_x(s, R.EPOCH_SLUG)} AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S') WHEN {y} IS NOT NULL THEN {y} || '-' || coalesce({m}, '01') || '-' || CASE WHEN {m} IS NOT NULL THEN coalesce({d}, '01') ELSE '01' END || 'T00:00:00' END"


def _iso(t: str) -> str:
    d, h, m, z = (_x(t, R.ISO, g) for g in (1, 2, 3, 4))
    return f"CASE WHEN try_cast({d} AS DATE) IS NOT NULL AND coalesce(CAST({h} AS INTEGER), 0) <= 23 AND coalesce(CAST({m} AS INTEGER), 0) <= 59 THEN {d} || 'T' || coalesce({h}, '00') || ':' || coalesce({m}, '00') || ':00' || CASE WHEN {z} IS NULL THEN '' ELSE '+00:00' END END"


def _head(n: str) -> str:
    return f"trim({_x('text', '(?m)^' + n + ':[\\s]*(.+)$')})"


_FILES = """f0 AS (SELECT lower(trim(source)) AS source, coalesce(text, '') AS text, CASE WHEN doc_id % 50 = 7 THEN 'readme.md' ELSE dsid || '__' || coalesce(CASE doc_id % 6 WHEN 0 THEN CAST(CAST(floor(epoch(coalesce(created_at, TIMESTAMP '2024-01-01'))) AS BIGINT) AS VARCHAR) || '-note'
  WHEN 1 THEN strftime(created_at, '%Y-%m-%d') || '_note' WHEN 2 THEN strftime(created_at, '%Y-%m') || '-note' WHEN 3 THEN strftime(created_at, '%Y%m%d') || '-note' ELSE 'plain-note' END, 'x') || '.txt' END AS n FROM documents)"""
_CHAT = r"""c0 AS (SELECT metadata.channel_id AS channel_id, metadata.channel_name AS channel_name, trim(metadata.thread_id) AS thread_id, metadata.message_id AS message_id, metadata.author_user_id AS user_id FROM artifacts WHERE source = 'slack' AND metadata.channel_id IS NOT NULL
  AND regexp_matches(trim(metadata.thread_id), '^[0-9]{10}[.][0-9]{6}$')), c AS (SELECT channel_id, thread_id, message_id, min(user_id) AS user_id FROM c0 GROUP BY ALL)"""
_DOC = """e0 AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN strftime(created_at, '%Y-%m-%dT%H:%M:%S') END AS timestamp, replace(concat_ws(chr(10), coalesce(text, ''), CASE doc_id % 5 WHEN 0 THEN '2024-03-04 - began' WHEN 1 THEN '- 2024-04-05: changed' WHEN 2 THEN 'Ann is taking over Acme next Friday'
  WHEN 3 THEN 'effective 2024-06-01 until 2024-05-01' ELSE 'from 2024-01-01 until 2024-07-01' END), '\\n', chr(10)) AS content FROM documents)"""
_ALL = "array_to_string(regexp_extract_all(content, '{}', 1), ',')"
_TOP = "array_to_string(list_slice(string_split(content, chr(10)), 1, 40), chr(10))"

ORACLES = {
    "B01_raw_artifacts": f"""WITH {_FILES}, f AS (SELECT *, regexp_extract(n, '^dsid_([0-9a-f]{{32}})__', 1) AS hex, {_x('n', '^dsid_[0-9a-f]{32}__(.+)[.]txt$')} AS slug FROM f0 WHERE source IN {_IN} AND regexp_matches(n, '^dsid_[0-9a-f]{{32}}__')),
      g AS (SELECT *, CASE WHEN source = 'gmail' THEN coalesce({_iso(_head('Date'))}, {_slug('slug')}) WHEN source = 'fireflies' THEN coalesce({_iso(_x('text', '(?m)^Date:[\\s]*([0-9]{4}-[0-9]{2}-[0-9]{2})'))}, {_slug('slug')}) ELSE {_slug('slug')} END AS ts FROM f)
      SELECT 'dsid_' || hex AS id, source, {_TYPE} AS type, CASE WHEN source = 'gmail' THEN {_head('From')} END AS author, ts AS timestamp, coalesce(CASE WHEN source = 'gmail' THEN {_head('Subject')} END, nullif(trim(string_split(text, chr(10))[1]), ''), slug) AS title, slug,
      CASE WHEN source = 'fireflies' THEN {_head('Attendees')} END AS attendees, contains(text, 'dataset_noise_document') AS noise, CASE WHEN ts IS NULL THEN NULL WHEN {_head('Date')} IS NOT NULL THEN 'header' WHEN regexp_matches(slug, '{R.EPOCH_SLUG}') THEN 'unix-slug' WHEN regexp_matches(slug, '{R.DATE_SLUG}') THEN 'date-slug' END AS ts_source, length(text) AS chars FROM g""",
    "B02_live_artifacts": f"SELECT DISTINCT 'dsid_' || left(sha256(source || '|' || trim(source_id)), 32) AS id, source, trim(source_id) AS native FROM artifacts WHERE source IN {_IN} AND trim(coalesce(source_id, '')) <> '' AND trim(coalesce(content, '')) <> ''",
    "B02_rejected": f"SELECT * FROM (SELECT CASE WHEN NOT coalesce(source IN {_IN}, false) THEN 'source' WHEN trim(coalesce(source_id, '')) = '' THEN 'native_source_id' WHEN trim(coalesce(content, '')) = '' THEN 'content' END AS reason, count(*) AS rows FROM artifacts GROUP BY 1) WHERE reason IS NOT NULL",
    "B04_slug_times": f"WITH {_FILES}, s AS (SELECT 'raw/' || source || '/' || n AS path, regexp_extract(n, '__(.*)[.]txt$', 1) AS slug FROM f0) SELECT * FROM (SELECT path, {_slug('slug')} AS slug_at FROM s) WHERE slug_at IS NOT NULL",
    "B06_first_iso": f"SELECT * FROM (SELECT doc_id, {_iso('text')} AS iso_time FROM documents) WHERE iso_time IS NOT NULL",
    "B14_participants": f"WITH {_CHAT}, u AS (SELECT channel_id, thread_id, user_id, min(message_id) AS first_at FROM c WHERE user_id <> '' GROUP BY ALL) SELECT channel_id, thread_id, string_agg(user_id, ',' ORDER BY first_at, user_id) AS users FROM u GROUP BY ALL",
    "B24_envelope": f"""WITH {_DOC} SELECT doc_id, coalesce(trim({_x(_TOP, '(?mi)^from:(.*)$')}), '') AS email_from, coalesce(trim({_x(_TOP, '(?mi)^to:(.*)$')}), '') AS email_to, {_ALL.format(R.REVISION)} AS revisions, {_ALL.format(R.TIMELINE)} AS timeline,
      coalesce({_x('content', R.MEETING)}, '') AS meeting FROM e0""",
    "B25_resolved_times": f"""WITH {_DOC}, e AS (SELECT *, {_x('content', R.MEETING)} AS m, regexp_extract_all(content, '{R.REVISION}', 1)[-1] AS r, regexp_extract_all(content, '{R.TIMELINE}', 1)[-1] AS t, {_x('content', R.STARTS)} AS f, {_x('content', R.ENDS)} AS e, lower({_x('content', R.TAKES_OVER)}) AS w FROM e0),
      o AS (SELECT *, coalesce(timestamp, m, r, t) AS observed_at, CASE WHEN timestamp IS NOT NULL THEN 'artifact' WHEN m IS NOT NULL THEN 'meeting-date' WHEN r IS NOT NULL THEN 'revision-history' WHEN t IS NOT NULL THEN 'text-timeline' END AS observed_source FROM e),
      v AS (SELECT *, coalesce(strftime(try_cast(left(observed_at, 10) AS DATE) + CAST((list_position(['monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday', 'sunday'], w) - isodow(try_cast(left(observed_at, 10) AS DATE)) + 6) % 7 + 1 AS INTEGER), '%Y-%m-%d'), f) AS valid_from FROM o)
      SELECT doc_id, observed_at, observed_source, valid_from, CASE WHEN NOT coalesce(e < valid_from, false) THEN e END AS valid_to FROM v""",
    "B33_links": "SELECT DISTINCT 'https://acme.slack.com/archives/' || metadata.channel_id || '/p' || replace(metadata.message_id, '.', '') AS chat, 'https://mail.google.com/mail/u/0/#inbox/' || metadata.message_id AS mail FROM artifacts",
}
