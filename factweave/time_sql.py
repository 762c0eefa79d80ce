"""SQL that reads written times, to check the reading of times with another engine."""

from __future__ import annotations

import re

from factweave.functions import timestamps as T


def _fields(pattern: tuple[str, str], text: str) -> str:
    p, order = pattern
    p = p.replace(r"\2", "[-/.]").replace("'", "''")
    return f"regexp_replace({text}, '{p}', '{re.sub(r'[$]([0-9]+)', lambda m: chr(92) + m.group(1), order)}')"


def read_sql(source: str, name: str = "rd") -> str:
    """CTEs that end with ``name(v, ord, i, l)``: instants and wall-clock micros of the distinct ``(v, ord)`` of a relation.

    The engine's regular expressions have no group beyond nine, so figures with a zone are cut
    before the zone is read.
    """
    t = "t"
    figures = T.MDY[0]
    plain = lambda order: _fields((figures, order), t)
    zone = "coalesce(nullif(regexp_extract(t, '[0-9](?:\\s*[AaPp]\\.?[Mm]\\.?)?\\s*([A-Za-z]{2,5}|[+-]\\d{2}:?\\d{2}|[+-]\\d{2})$', 1), ''), '')"
    shown = {
        "MDY": plain("$4|$1|$3|$5|$6|$7|$8|$9") + f" || CASE WHEN regexp_matches(t, '{figures.replace(chr(92) + '2', '[-/.]')}') THEN '|' || regexp_replace({zone}, '^(?i)[ap]m$', '') ELSE '' END",
        "DMY": plain("$4|$3|$1|$5|$6|$7|$8|$9") + f" || CASE WHEN regexp_matches(t, '{figures.replace(chr(92) + '2', '[-/.]')}') THEN '|' || regexp_replace({zone}, '^(?i)[ap]m$', '') ELSE '' END",
    }
    names = " ".join(f"WHEN '{k}' THEN {m}" for k, m in T.ZONE_NAMES.items())
    num = lambda i: f"try_cast(p[{i}] AS INTEGER)"
    return f"""{name}0 AS (SELECT DISTINCT v, ord, trim(v) AS t FROM ({source})),
      {name}1 AS (SELECT *, string_split(CASE WHEN regexp_matches(t, '^\\d{{4}}[-/.]') THEN {_fields(T.ISO, t)} WHEN regexp_matches(t, '^\\d{{8}}([Tt]|$)') THEN {_fields(T.BASIC, t)} WHEN regexp_matches(t, '^[A-Za-z]{{3,9}},?\\s+\\d{{1,2}}\\s+[A-Za-z]|^\\d{{1,2}}[\\s-][A-Za-z]') THEN {_fields(T.MAIL, t)}
        WHEN regexp_matches(t, '^[A-Za-z]{{3,9}}[.,]?\\s+[A-Za-z0-9]') THEN {_fields(T.WORDY, t)} WHEN regexp_matches(t, '^\\d{{1,2}}[/.-]\\d') AND ord = 'MDY' THEN {shown['MDY']} WHEN regexp_matches(t, '^\\d{{1,2}}[/.-]\\d') AND ord = 'DMY' THEN {shown['DMY']} END, '|') AS p,
        CASE WHEN regexp_matches(t, '^\\d{{9,10}}(\\.\\d{{1,9}})?$') THEN CAST(floor(CAST(t AS DECIMAL(28, 9)) * 1000000) AS BIGINT) WHEN regexp_matches(t, '^\\d{{12,13}}$') THEN CAST(t AS BIGINT) * 1000 WHEN regexp_matches(t, '^\\d{{15,16}}$') THEN CAST(t AS BIGINT) END AS e FROM {name}0),
      {name}2 AS (SELECT *, CASE WHEN regexp_matches(p[2], '^\\d') THEN {num(2)} WHEN (instr('{T.MONTHS}', lower(left(p[2], 3))) % 3) = 1 THEN (instr('{T.MONTHS}', lower(left(p[2], 3))) + 2) // 3 END AS mo, coalesce({num(4)}, 0) AS h, coalesce({num(5)}, 0) AS mi, coalesce({num(6)}, 0) AS s,
        CASE WHEN p[7] <> '' THEN CAST(rpad(left(p[7], 6), 6, '0') AS INTEGER) ELSE 0 END AS us, upper(left(p[8], 1)) AS ap, upper(p[9]) AS z, rpad(regexp_replace(p[9], '[^\\d]', '', 'g'), 4, '0') AS zd FROM {name}1),
      {name}3 AS (SELECT *, CASE WHEN ap = '' THEN h WHEN h BETWEEN 1 AND 12 THEN h % 12 + CASE WHEN ap = 'P' THEN 12 ELSE 0 END END AS hh, try_cast(p[1] || '-' || lpad(CAST(mo AS VARCHAR), 2, '0') || '-' || lpad(p[3], 2, '0') AS DATE) AS d,
        CASE WHEN regexp_matches(z, '^[+-]') THEN CASE WHEN CAST(left(zd, 2) AS INTEGER) <= 18 AND CAST(substr(zd, 3, 2) AS INTEGER) <= 59 THEN (CASE WHEN z LIKE '-%' THEN -1 ELSE 1 END) * (CAST(left(zd, 2) AS INTEGER) * 60 + CAST(substr(zd, 3, 2) AS INTEGER)) END ELSE CASE z {names} END END AS off FROM {name}2),
      {name}4 AS (SELECT *, CASE WHEN len(p) = 9 AND d IS NOT NULL AND hh <= 23 AND mi <= 59 AND s <= 59 THEN date_diff('day', DATE '1970-01-01', d) * 86400000000 + CAST(hh * 3600 + mi * 60 + s AS BIGINT) * 1000000 + us END AS w FROM {name}3),
      {name} AS (SELECT v, ord, coalesce(e, CASE WHEN z <> '' THEN w - CAST(off AS BIGINT) * 60000000 END) AS i, CASE WHEN e IS NULL AND z = '' THEN w END AS l FROM {name}4)"""


def utc_sql(zone: str, local: str) -> str:
    """UTC micros of wall-clock micros in a zone: of two meanings the first, a skipped time moved forward."""
    at = f"timezone({zone}, make_timestamp({local}))"
    hour = f"({at} - INTERVAL 1 HOUR)"
    return f"epoch_us(CASE WHEN timezone({zone}, {hour}) = make_timestamp({local}) THEN {hour} ELSE {at} END)"


#: Key of a mention in SQL; see ``functions.text.mention_key``.
KEY_SQL = _K = "lower(trim(regexp_replace(trim(regexp_replace({}, '\\s+', ' ', 'g')), '^@', '')))"
_CL = "claims_checkpoint50"
_ISO = "coalesce(strftime(make_timestamp({} // 1000000 * 1000000), '%Y-%m-%dT%H:%M:%SZ'), '9999-12-31')"
_EMPTY = "regexp_replace(coalesce({}, ''), '\\s+', '', 'g') = ''"
_OBS = f"""{read_sql(f"SELECT observed_at AS v, 'YMD' AS ord FROM {_CL}")}, ob AS (SELECT DISTINCT {_K.format('subject_mention')} AS k, upper(trim(predicate)) AS p, {_K.format('object_mention')} AS o, coalesce(i, l) AS ts FROM {_CL} JOIN rd ON v = observed_at
    WHERE {_EMPTY.format('valid_from')} AND {_EMPTY.format('valid_to')} AND coalesce(i, l) IS NOT NULL AND object_mention IS NOT NULL),
  st AS (SELECT *, lag(o) OVER (PARTITION BY k, p ORDER BY ts, o) AS prev FROM ob), lg AS (SELECT k, p, o, ts, lead(ts) OVER (PARTITION BY k, p ORDER BY ts, o) AS nx FROM st WHERE prev IS DISTINCT FROM o)"""


def p1_sql() -> str:
    return f"WITH {_OBS} SELECT DISTINCT k AS subject_key, p AS predicate, o AS object_key, {_ISO.format('ts')} AS version_from, {_ISO.format('nx')} AS version_to FROM lg"


def p1_combined_sql(predicates: list[str]) -> str:
    """Every boundary of a subject with the last value of each attribute at it; neighbours that agree are one."""
    cols = [p.lower() for p in predicates]
    at = ", ".join(f"max(o) FILTER (p = '{p}') AS {p.lower()}" for p in predicates)
    fill = ", ".join(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY k ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}" for c in cols)
    row = "struct_pack(" + ", ".join(f"{c} := {c}" for c in cols) + ")"
    return f"""WITH {_OBS}, ev AS (SELECT k, ts, {at} FROM lg WHERE p IN ({", ".join(f"'{p}'" for p in predicates)}) GROUP BY 1, 2), fl AS (SELECT k, ts, {fill} FROM ev), ch AS (SELECT *, lag({row}) OVER (PARTITION BY k ORDER BY ts) AS prev, {row} AS now FROM fl),
      kp AS (SELECT *, lead(ts) OVER (PARTITION BY k ORDER BY ts) AS nx FROM ch WHERE prev IS DISTINCT FROM now) SELECT k AS subject_key, {_ISO.format('ts')} AS period_from, {_ISO.format('nx')} AS period_to, {", ".join(cols)} FROM kp"""


P6_SQL = f"""WITH {read_sql(f"SELECT observed_at AS v, 'YMD' AS ord FROM {_CL} UNION ALL SELECT metadata.ingested_at, 'YMD' FROM artifacts UNION ALL SELECT timestamp, coalesce(date_order, 'YMD') FROM artifacts LEFT JOIN workspaces ON workspace_id = metadata.workspace_id")},
  x AS (SELECT 'artifacts.timestamp' AS f, id AS r, timestamp AS v, coalesce(date_order, 'YMD') AS ord, time_zone AS z FROM artifacts LEFT JOIN workspaces ON workspace_id = metadata.workspace_id UNION ALL SELECT 'artifacts.metadata.ingested_at', id, metadata.ingested_at, 'YMD', NULL FROM artifacts UNION ALL SELECT 'claims_checkpoint50.observed_at', claim_id, observed_at, 'YMD', NULL FROM {_CL}),
  u AS (SELECT f, r, CASE WHEN i IS NOT NULL THEN i WHEN z IS NULL THEN l ELSE {utc_sql('z', 'l')} END AS m FROM x JOIN rd USING (v, ord) WHERE NOT regexp_matches(v, '^\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}\\+00:00$'))
  SELECT DISTINCT f AS field_name, r AS row_id, m AS utc_micros FROM u WHERE m IS NOT NULL"""
