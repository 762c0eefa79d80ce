"""Registry of the core queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factweave import contract_queries, evaluation_queries, identity_queries, more_queries, record_queries, relation_queries, resolution_queries, retrieval_queries, state_queries, store_queries, stream_queries, text_queries
from factweave.operators import histories, instants, periods
from factweave.time_sql import P6_SQL, p1_combined_sql, p1_sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "p1_found": histories.p1_found,
    "p1_combined": histories.p1_combined,
    "p6_found": instants.p6_found,
    "p7_found": periods.p7_found,
    **state_queries.QUERIES,
    **retrieval_queries.QUERIES,
    **identity_queries.QUERIES,
    **text_queries.QUERIES,
    **stream_queries.QUERIES,
    **contract_queries.QUERIES,
    **record_queries.QUERIES,
    **resolution_queries.QUERIES,
    **relation_queries.QUERIES,
    **store_queries.QUERIES,
    **evaluation_queries.QUERIES,
    **more_queries.QUERIES,
}

P7_SQL = """
WITH c AS (SELECT lower(trim(regexp_replace(trim(regexp_replace(object_mention, '\\s+', ' ', 'g')), '^@', ''))) AS object_key, TRY_CAST(left(trim(valid_from), 10) AS DATE) AS f,
    CASE WHEN trim(coalesce(valid_to, '')) = '' THEN DATE '9999-12-31' ELSE TRY_CAST(left(trim(valid_to), 10) AS DATE) END AS t FROM claims_checkpoint50),
  m AS (SELECT *, max(t) OVER (PARTITION BY object_key ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM (SELECT DISTINCT * FROM c WHERE f < t)),
  g AS (SELECT *, sum(CASE WHEN r IS NULL OR f > r THEN 1 ELSE 0 END) OVER (PARTITION BY object_key ORDER BY f, t) AS n FROM m),
  p AS (SELECT object_key, min(f) AS s, max(t) AS e FROM g GROUP BY object_key, n), l AS (SELECT *, lead(s) OVER (PARTITION BY object_key ORDER BY s) AS nx FROM p)
SELECT object_key, 'period' AS kind, strftime(s, '%Y-%m-%d') AS start_day, strftime(e, '%Y-%m-%d') AS end_day FROM l
UNION ALL SELECT object_key, 'gap', strftime(e, '%Y-%m-%d'), strftime(nx, '%Y-%m-%d') FROM l WHERE nx IS NOT NULL
"""

ORACLES: dict[str, str] = {"p1_found": p1_sql(), "p1_combined": p1_combined_sql(histories.PREDICATES), "p6_found": P6_SQL, "p7_found": P7_SQL, **state_queries.ORACLES, **retrieval_queries.ORACLES, **identity_queries.ORACLES, **text_queries.ORACLES, **stream_queries.ORACLES, **contract_queries.ORACLES, **record_queries.ORACLES, **resolution_queries.ORACLES, **relation_queries.ORACLES, **store_queries.ORACLES, **evaluation_queries.ORACLES, **more_queries.ORACLES}
