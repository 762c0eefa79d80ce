"""Queries of the llm operators and the SQL that checks them."""

from __future__ import annotations

from factweave.llm import conversations, groups, leaks, mixing, names, pii, sentences
from factweave.time_sql import read_sql

QUERIES = {
    "p2_found": conversations.p2_found,
    "p3_found": groups.p3_found,
    "p4_found": names.p4_found,
    "p4_members": names.p4_members,
    "p5_found": pii.p5_found,
    "p5_redacted": pii.p5_redacted,
    "p8_found": leaks.p8_found,
    "p8_items": leaks.p8_items,
    "p9_shares": mixing.p9_shares,
    "p9_mix": mixing.p9_mix,
    "p10_found": sentences.p10_found,
}

_KEY = "list_filter({}.external_ids, lambda x: starts_with(x, 'mention:'))[1]"
_SAME = "upper(trim(label)) IN ('SAME', 'SAME_ENTITY')"

_UNSEEN = r"[\s\p{Z}\p{Cf}\p{Cc}]+"
_T = f"regexp_replace(regexp_replace(metadata.thread_id, '{_UNSEEN}', '', 'g'), '^[pP](\\d{{10}})(\\d{{6}})$', '\\1.\\2')"
_AFTER = "ltrim(regexp_replace(regexp_replace(content, '^\\s*#[^\\n]*', ''), '^\\s+', ''))"
_LABEL = "trim(metadata.author_display_name) || ':'"
_BODY = f"coalesce(CASE WHEN starts_with({_AFTER}, {_LABEL}) THEN substr({_AFTER}, length({_LABEL}) + 1) END, regexp_replace({_AFTER}, '^[^\\n:]*(:|$)', ''))"
_P2 = f"""WITH {read_sql("SELECT timestamp AS v, coalesce(date_order, 'YMD') AS ord FROM artifacts LEFT JOIN workspaces ON workspace_id = metadata.workspace_id WHERE source = 'slack'")},
  m0 AS (SELECT metadata.channel_id AS channel_id, CASE WHEN regexp_matches({_T}, '^\\d{{10}}(\\.\\d{{0,6}})?$') THEN left({_T}, 10) || '.' || rpad(substr({_T}, 12, 6), 6, '0') END AS thread_id, trim(metadata.message_id) AS message_id, id, nullif(upper(regexp_replace(metadata.author_user_id, '[\\s\\p{{Z}}<>@]|\\|.*', '', 'g')), '') AS u,
    coalesce(i, l) IS NOT NULL AS readable, coalesce(regexp_replace({_BODY}, '{_UNSEEN}', '', 'g') <> '', false) AS body, metadata.reply_count AS n FROM artifacts LEFT JOIN workspaces ON workspace_id = metadata.workspace_id LEFT JOIN rd ON v = timestamp AND ord = coalesce(date_order, 'YMD') WHERE lower(trim(source)) = 'slack'),
  m AS (SELECT channel_id, thread_id, message_id, min(id) AS id, max(u) AS u, bool_or(readable) AS readable, bool_or(body) AS body, max(n) AS n FROM m0 WHERE channel_id IS NOT NULL AND thread_id IS NOT NULL AND message_id IS NOT NULL GROUP BY ALL),
  c AS (SELECT channel_id, thread_id, max(u) FILTER (message_id = thread_id) AS starter, max(coalesce(n, 0)) FILTER (message_id = thread_id) AS wanted, count(*) FILTER (message_id <> thread_id) AS replies, count(DISTINCT u) AS people, bool_and(u IS NOT NULL AND readable AND body) AS sound FROM m GROUP BY ALL)
  SELECT channel_id, thread_id, CAST(row_number() OVER (PARTITION BY channel_id, thread_id ORDER BY CAST(message_id AS DECIMAL(20, 6)), message_id) AS INTEGER) AS turn_no, id AS artifact_id, CASE WHEN u = starter THEN 'starter' ELSE 'replier' END AS role FROM m JOIN c USING (channel_id, thread_id) WHERE sound AND starter IS NOT NULL AND replies >= wanted AND people > 1"""
_GRAMS = "SELECT DISTINCT {k}, array_to_string(list_slice(w, i, i + 9), ' ') AS g FROM (SELECT {k}, w, unnest(range(1, len(w) - 8)) AS i FROM (SELECT {k}, regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}]+') AS w FROM {f}) WHERE len(w) >= 10)"
_P8 = f"""WITH d AS ({_GRAMS.format(k='doc_id', t='text', f='documents')}), i AS ({_GRAMS.format(k='question_id', t='question', f='retrieval_questions')} UNION {_GRAMS.format(k='question_id', t='gold_answer', f='retrieval_questions')}), r AS (SELECT DISTINCT doc_id, question_id FROM d JOIN i USING (g))"""

ORACLES: dict[str, str] = {
    "p2_found": _P2,
    "p8_found": f"{_P8} SELECT doc_id, question_id FROM r",
    "p8_items": f"{_P8} SELECT q.question_id, count(DISTINCT doc_id) AS documents FROM (SELECT DISTINCT question_id FROM retrieval_questions) q LEFT JOIN r USING (question_id) GROUP BY 1",
    "p3_found": f"""WITH RECURSIVE r AS (SELECT {_KEY.format('a')} AS u, {_KEY.format('b')} AS v, {_SAME} AS same FROM phase3_identity_pairs WHERE trim(coalesce(label, '')) <> ''),
      n AS (SELECT u AS m FROM r UNION SELECT v FROM r), e AS (SELECT u, v FROM r WHERE same UNION SELECT v, u FROM r WHERE same),
      w AS (SELECT m, m AS o FROM n UNION SELECT w.m, e.v FROM w JOIN e ON w.o = e.u)
      SELECT m AS mention_id, min(o) AS group_id FROM w GROUP BY m""",
}
