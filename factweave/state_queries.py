"""Queries on state and traversals over the claims of the orders table, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.functions.text import mention_key
from factweave.operators import claims as C
from factweave.operators import graph as G
from factweave.operators import state as S
from factweave.operators import temporal as X
from factweave.operators.instants import normalize
from factweave.plans.answers import ClaimGraph
from factweave.sources.tables import table
from factweave.time_sql import KEY_SQL, read_sql

DAY = "1998-06-01"
WEIGHTS = {"order": 3, "lineitem": 2}


def over(op, *args):
    """A query that applies ``op`` to the claims of the orders."""
    return lambda spark, folder: op(C.order_claims(spark, folder), *args)


def chain(spark, folder):
    """Claims with their artifact (the order) and source (the nation of its customer)."""
    orders = table(spark, folder, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey")).alias("artifact_id"), F.col("o_custkey").alias("c_custkey"), F.lit("order").alias("kind"))
    customers = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("source_id"))
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("source_id"), F.col("n_name").alias("source_name"))
    return G.provenance(C.order_claims(spark, folder), orders.join(customers, "c_custkey"), nations)


def supplier_claims(spark, folder):
    """Claims whose artifact is an order and whose subjects are its suppliers, objects its parts."""
    l = table(spark, folder, "lineitem")
    return l.select(
        F.concat(F.lit("order:"), F.col("l_orderkey")).alias("artifact_id"), F.concat(F.lit("supplier:"), F.col("l_suppkey")).alias("subject_id"),
        F.lit("SUPPLIES").alias("predicate"), F.concat(F.lit("part:"), F.col("l_partkey")).alias("object_id"),
        F.col("l_shipdate").cast("date").alias("valid_from"), F.col("l_receiptdate").cast("date").alias("valid_to") if "l_receiptdate" in l.columns else F.lit(C.OPEN_END).cast("date").alias("valid_to"),
    )


def probes(spark, folder):
    o = table(spark, folder, "orders")
    kind = F.when(F.col("o_orderkey") % 3 == 0, "OWNS").when(F.col("o_orderkey") % 3 == 1, "MAINTAINS").otherwise("LEADS")
    return o.select(
        F.col("o_orderkey").alias("probe_id"), F.concat(F.lit("account:"), F.col("o_custkey")).alias("object_id"), kind.alias("predicate"), F.date_add(F.col("o_orderdate").cast("date"), 30).alias("day")
    ).distinct()


def shared_claims(spark, folder):
    """Claims of the orders whose artifacts hold some forty orders each, with names of their subjects."""
    number = F.floor(F.split_part("artifact_id", F.lit(":"), F.lit(2)).cast("long") / 40)
    named = F.concat(F.lit("Person-"), F.split_part("subject_id", F.lit(":"), F.lit(2)))
    return C.order_claims(spark, folder).withColumns({"artifact_id": F.concat(F.lit("batch:"), number), "subject_name": named})


def shared_chain(spark, folder):
    number = F.split_part("artifact_id", F.lit(":"), F.lit(2)).cast("long")
    source = F.element_at(F.array(F.lit("Slack"), F.lit("Gmail"), F.lit("Jira")), (number % 3 + 1).cast("int"))
    return shared_claims(spark, folder).withColumns({"source_id": source, "source_name": source, "kind": F.lit("batch")})


def _asked():
    """Twelve kinds of questions, dealt to the accounts."""
    k, name, person = F.col("c_custkey"), F.concat(F.lit("Account-"), F.col("c_custkey")), F.concat(F.lit("Person-"), F.col("c_custkey") % 97)
    kinds = [
        ("Who owns ", name, " now?"), ("Who maintains ", name, f" as of {DAY}?"), ("Who actually owns ", name, "?"), ("Who previously owned ", name, "?"), ("Who owned ", name, f" before {DAY}?"), ("Who maintains ", name, f" after {DAY}?"),
        ("Who owned ", name, f" during {DAY}?"), ("Which source shows who owned ", name, "?"), ("Does gmail or jira show who owned ", name, "?"), ("Who else appears with ", person, "?"), ("Is 'Account-4' the same as '", name, "'?"),
    ]
    text = None
    for no, (a, b, c) in enumerate(kinds):
        one = F.concat(F.lit(a), b, F.lit(c))
        text = F.when(k % 12 == no, one) if text is None else text.when(k % 12 == no, one)
    return text.otherwise(F.concat(F.lit("Who owned "), name, F.lit(" before "), person, F.lit("?")))


def answers(spark, folder):
    """A question about every account, on every route."""
    c = table(spark, folder, "customer").select("c_custkey")
    names = c.select(F.concat(F.lit("Account-"), F.col("c_custkey")).alias("mention"), F.concat(F.lit("account:"), F.col("c_custkey")).alias("entity"))
    people = spark.range(97).select(F.concat(F.lit("Person-"), F.col("id")).alias("mention"), F.concat(F.lit("person:"), F.col("id")).alias("entity"))
    g = ClaimGraph(shared_claims(spark, folder), names.unionByName(people), shared_chain(spark, folder))
    return g.answer(c.select(F.col("c_custkey").alias("question_id"), _asked().alias("question")))


def named_probes(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey")
    return c.select(F.col("c_custkey").alias("probe_id"), F.concat(F.lit("account:"), F.col("c_custkey")).alias("object_id"), F.lit("OWNS").alias("predicate"), F.concat(F.lit("person-"), F.col("c_custkey") % 10).alias("reference"))


def presence(spark, folder):
    return named_probes(spark, folder).select("probe_id", "object_id", "predicate", F.when(F.col("probe_id") % 2 == 0, "Does slack or Gmail show it?").otherwise("Where is it?").alias("question"))


QUERIES = {
    "M10_answers": answers,
    "D08_before_many": lambda s, d: S.before_many(C.order_claims(s, d), probes(s, d)),
    "D09_first_start": lambda s, d: X.started(shared_claims(s, d), named_probes(s, d)),
    "D11_anchor_in_claims": lambda s, d: X.anchored(shared_claims(s, d), named_probes(s, d)),
    "D10_anchor_in_texts": lambda s, d: X.dated_mentions(table(s, d, "documents").select(F.col("created_at").cast("date").alias("day"), "text"), table(s, d, "claims_checkpoint50").select(F.col("claim_id").alias("probe_id"), F.col("object_mention").alias("reference")).distinct()),
    "F08_owners": over(lambda c: X.owners(S.history(c))),
    "M08_source_presence": lambda s, d: X.source_presence(shared_chain(s, d), presence(s, d)).select("probe_id", F.array_join("sources", ",").alias("sources")),
    "M13_current_owner": over(lambda c: ClaimGraph(c, None).current_owner().select("object_id", "subject_id")),
    "F01_current_state": over(S.current),
    "D07_as_of": over(S.as_of, DAY),
    "D07_as_of_many": lambda s, d: S.as_of_many(C.order_claims(s, d), probes(s, d)),
    "D08_before": over(S.before, DAY),
    "F02_history": over(S.history),
    "F03_previous_holder": over(S.previous),
    "F04_after_event": over(S.after_event),
    "F05_disjoint": over(S.disjoint),
    "F07_strictly_observed": over(S.strictly_observed),
    "D05_contradictions": over(S.contradictions),
    "E08_conflicts": over(S.conflicts),
    "M05_conflict_state": over(S.conflict_state),
    "C13_open_claims": over(lambda c: c.where(S._open()).select("claim_id")),
    "C14_holding_claims": over(lambda c: S.holds(c, DAY).select("claim_id")),
    "D02_provenance": lambda s, d: chain(s, d).select("claim_id", "artifact_id", "source_id", "source_name", "observed_at"),
    "E07_evidence_by_subject": lambda s, d: G.evidence(chain(s, d)),
    "F09_rank_evidence": lambda s, d: G.rank_evidence(chain(s, d), S.current(C.order_claims(s, d)), WEIGHTS, 3),
    "D06_cooccurrence": lambda s, d: G.cooccurring(supplier_claims(s, d)),
    "D12_edge_history": over(lambda c: G.edges(c)),
    "D13_dependencies_out": lambda s, d: G.degree(G.edges(supplier_claims(s, d)), True),
    "D13_dependencies_in": lambda s, d: G.degree(G.edges(supplier_claims(s, d)), False),
    "D14_two_hop": lambda s, d: G.two_hop(supplier_claims(s, d)),
    "D15_export_nodes": over(G.export_nodes),
    "D15_export_edges": over(G.export_edges),
    "D16_neighbourhood": over(lambda c: G.reachable(G.edges(c).unionByName(G.edges(c).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel", "valid_from", "valid_to")), G.edges(c).select(F.col("dst").alias("node")).where("node = 'account:1'"), 2)),
    "E02_claims_per_predicate": over(lambda c: c.groupBy("predicate").agg(F.count(F.lit(1)).alias("claims"))),
    "D30_scope_counts": over(lambda c: c.groupBy("object_id").agg(F.count(F.lit(1)).alias("claims"), F.count_distinct("artifact_id").alias("artifacts"))),
}

_W = "WITH " + C.ORDER_CLAIMS_SQL
_STATE = "object_id, predicate, subject_id, valid_from, valid_to, observed_at, claim_id"
_CHAIN = (
    _W + ", chain AS (SELECT c.*, cu.c_nationkey AS source_id, n.n_name AS source_name, 'order' AS kind FROM claims c JOIN orders o ON c.artifact_id = 'order:' || o.o_orderkey"
    " JOIN customer cu ON cu.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = cu.c_nationkey)"
)
_SUP = "WITH claims AS (SELECT 'order:' || l_orderkey AS artifact_id, 'supplier:' || l_suppkey AS subject_id, 'SUPPLIES' AS predicate, 'part:' || l_partkey AS object_id FROM lineitem)"


def _top(where: str, order: str) -> str:
    return f"{_W} SELECT {_STATE} FROM (SELECT *, row_number() OVER (PARTITION BY object_id, predicate ORDER BY {order}) AS rn FROM claims WHERE {where}) WHERE rn = 1"


_START, _SEEN = "coalesce(valid_from, DATE '9999-12-31')", "coalesce(observed_at, DATE '0001-01-01')"
_SEQ = f"PARTITION BY object_id, predicate ORDER BY {_START}, {_SEEN}, claim_id"
_DISJOINT = (
    "SELECT object_id, predicate, bool_and(coalesce(nf >= valid_to, true)) AS disjoint FROM (SELECT *, lead(valid_from) OVER"
    " (PARTITION BY object_id, predicate ORDER BY coalesce(observed_at, DATE '0001-01-01'), coalesce(valid_from, DATE '9999-12-31'), claim_id) AS nf FROM claims) GROUP BY 1, 2"
)
_STRICT = 'SELECT object_id, predicate, count(observed_at) = count(*) AND count(DISTINCT observed_at) = count(*) AS "strict" FROM claims GROUP BY 1, 2'

def _one(order: str, where: str, rank: int) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY object_id, predicate ORDER BY {order}) AS rn FROM claims WHERE {where}) WHERE rn = {rank})"


_SHARED = _W.rstrip().removesuffix(")") .replace("claims AS (", "claims0 AS (") + """), claims AS (SELECT * REPLACE ('batch:' || (CAST(split_part(artifact_id, ':', 2) AS BIGINT) // 40) AS artifact_id), 'Person-' || split_part(subject_id, ':', 2) AS subject_name,
  ['slack', 'gmail', 'jira'][CAST((CAST(split_part(artifact_id, ':', 2) AS BIGINT) // 40) % 3 AS INTEGER) + 1] AS source FROM claims0)"""

ORACLES = {
    "M10_answers": f"""{_SHARED}, d AS ({_DISJOINT}), s AS ({_STRICT}), l AS {_one(f"{_SEEN} DESC, {_START} DESC, claim_id DESC", "true", 1)}, e AS (SELECT object_id, predicate, count(DISTINCT subject_id) AS k FROM claims GROUP BY 1, 2),
        st AS (SELECT e.object_id, e.predicate, l.subject_id, CASE WHEN k = 1 OR disjoint OR "strict" THEN 'stands' ELSE 'conflict' END AS state FROM e JOIN d USING (object_id, predicate) JOIN s USING (object_id, predicate) JOIN l USING (object_id, predicate)),
        n AS {_one("valid_from DESC, claim_id DESC", "valid_to = DATE '9999-12-31'", 1)}, p AS {_one("valid_from DESC, observed_at DESC, claim_id DESC", "true", 2)}, o AS {_one("observed_at DESC, claim_id DESC", "true", 1)},
        q AS (SELECT c_custkey AS question_id, CASE c_custkey % 12 WHEN 0 THEN 'current' WHEN 1 THEN 'as_of' WHEN 2 THEN 'conflict' WHEN 3 THEN 'previous' WHEN 4 THEN 'before' WHEN 5 THEN 'after' WHEN 6 THEN 'interval' WHEN 7 THEN 'provenance'
            WHEN 8 THEN 'source_presence' WHEN 9 THEN 'cooccurrence' WHEN 10 THEN 'entity_pair' ELSE 'before' END AS route,
          CASE c_custkey % 12 WHEN 9 THEN 'person:' || (c_custkey % 97) WHEN 10 THEN 'account:4' ELSE 'account:' || c_custkey END AS entity, CASE WHEN c_custkey % 12 IN (1, 5) THEN 'MAINTAINS' ELSE 'OWNS' END AS predicate, c_custkey % 12 AS no FROM customer),
        fs AS (SELECT question_id, min(valid_from) AS day FROM q JOIN claims c ON c.object_id = entity AND c.predicate = q.predicate AND contains(lower(subject_name), 'person-' || (question_id % 97)) WHERE no = 11 GROUP BY 1),
        pr AS (SELECT question_id, entity, q.predicate, no, CASE WHEN no = 11 THEN fs.day ELSE DATE '{DAY}' END AS day FROM q LEFT JOIN fs USING (question_id) WHERE no IN (1, 4, 5, 6, 11)),
        pc AS (SELECT pr.question_id, pr.day, no, c.*, valid_from <= pr.day AND valid_to > pr.day AS holds, valid_from <= pr.day - 1 AND valid_to > pr.day - 1 AS held, valid_to < pr.day AS ended FROM pr JOIN claims c ON c.object_id = entity AND c.predicate = pr.predicate),
        t AS (SELECT question_id, subject_id FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY valid_from DESC, claim_id DESC) AS rn FROM pc WHERE holds AND no IN (1, 5, 6)) WHERE rn = 1
          UNION ALL SELECT question_id, subject_id FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY held DESC, CASE WHEN held THEN valid_from ELSE valid_to END DESC, claim_id DESC) AS rn FROM pc WHERE (held OR ended) AND no IN (4, 11)) WHERE rn = 1),
        src AS (SELECT object_id, predicate, list_sort(list_distinct(list(source))) AS sources FROM claims GROUP BY 1, 2), co AS (SELECT a.subject_id, list_sort(list_distinct(list(b.subject_id))) AS others FROM claims a JOIN claims b ON a.artifact_id = b.artifact_id AND a.subject_id <> b.subject_id GROUP BY 1),
        a AS (SELECT q.*, CASE WHEN no IN (1, 4, 5, 6, 11) THEN pr.day END AS day, CASE no WHEN 0 THEN n.subject_id WHEN 2 THEN CASE WHEN st.state = 'stands' THEN st.subject_id END WHEN 3 THEN p.subject_id WHEN 7 THEN o.subject_id WHEN 8 THEN NULL WHEN 9 THEN NULL WHEN 10 THEN NULL ELSE t.subject_id END AS subject_id, st.state,
          CASE no WHEN 7 THEN sources WHEN 8 THEN list_filter(sources, lambda x: x IN ('gmail', 'jira')) WHEN 9 THEN others WHEN 10 THEN [CASE WHEN question_id = 4 THEN 'same' ELSE 'different' END] END AS names FROM q LEFT JOIN (SELECT question_id, day FROM pr) pr USING (question_id) LEFT JOIN t USING (question_id)
          LEFT JOIN n ON n.object_id = q.entity AND n.predicate = q.predicate LEFT JOIN p ON p.object_id = q.entity AND p.predicate = q.predicate LEFT JOIN o ON o.object_id = q.entity AND o.predicate = q.predicate LEFT JOIN st ON st.object_id = q.entity AND st.predicate = q.predicate
          LEFT JOIN src ON src.object_id = q.entity AND src.predicate = q.predicate LEFT JOIN co ON co.subject_id = q.entity),
        r AS (SELECT *, CASE WHEN (names IS NULL AND subject_id IS NOT NULL) OR len(names) > 0 THEN 'found' WHEN no = 2 AND state = 'conflict' THEN 'conflict' ELSE 'absent' END AS status FROM a)
        SELECT question_id, route, entity, predicate, CASE WHEN subject_id IS NOT NULL OR (no IN (1, 4, 5, 6, 11) AND day IS NOT NULL) THEN day END AS day, status, subject_id,
          CASE WHEN status = 'found' THEN CASE WHEN route IN ('previous', 'conflict') THEN 0.9 WHEN route = 'before' THEN 0.94 ELSE 0.96 END END::DOUBLE AS confidence,
          CASE status WHEN 'found' THEN coalesce(array_to_string(names, ', '), subject_id) WHEN 'conflict' THEN 'conflict' ELSE 'unknown' END AS answer FROM r""",
    "D08_before_many": _W + """, probes AS (SELECT DISTINCT o_orderkey AS probe_id, 'account:' || o_custkey AS object_id, CASE o_orderkey % 3 WHEN 0 THEN 'OWNS' WHEN 1 THEN 'MAINTAINS' ELSE 'LEADS' END AS predicate, CAST(o_orderdate AS DATE) + 30 AS day FROM orders),
        m AS (SELECT p.*, c.subject_id, c.valid_from, c.valid_to, c.claim_id, c.valid_from <= day - 1 AND c.valid_to > day - 1 AS held FROM probes p LEFT JOIN claims c ON c.object_id = p.object_id AND c.predicate = p.predicate AND ((c.valid_from <= day - 1 AND c.valid_to > day - 1) OR c.valid_to < day))
        SELECT probe_id, object_id, predicate, day, subject_id, valid_from, claim_id FROM (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY held DESC NULLS LAST, CASE WHEN held THEN valid_from ELSE valid_to END DESC, claim_id DESC) AS rn FROM m) WHERE rn = 1""",
    "D09_first_start": f"{_SHARED} SELECT c_custkey AS probe_id, min(valid_from) AS day FROM customer JOIN claims ON object_id = 'account:' || c_custkey AND predicate = 'OWNS' AND contains(lower(subject_name), 'person-' || (c_custkey % 10)) GROUP BY 1",
    "D11_anchor_in_claims": f"{_SHARED} SELECT c_custkey AS probe_id, max(valid_from) AS day FROM customer JOIN claims ON object_id = 'account:' || c_custkey AND predicate = 'OWNS' AND contains(lower(subject_name), 'person-' || (c_custkey % 10)) GROUP BY 1",
    "D10_anchor_in_texts": "WITH a AS (SELECT DISTINCT claim_id AS probe_id, lower(trim(object_mention)) AS anchor FROM claims_checkpoint50 WHERE trim(object_mention) <> ''), m AS (SELECT anchor, max(CAST(created_at AS DATE)) AS day FROM documents, (SELECT DISTINCT anchor FROM a) WHERE created_at IS NOT NULL AND contains(lower(text), anchor) GROUP BY 1) SELECT probe_id, day FROM a JOIN m USING (anchor)",
    "F08_owners": f"{_W}, h AS (SELECT *, row_number() OVER ({_SEQ}) AS seq FROM claims), g AS (SELECT *, lead(subject_id) OVER (PARTITION BY object_id, predicate ORDER BY seq) AS nx, lead(seq) OVER (PARTITION BY object_id, predicate ORDER BY seq) AS ns FROM h) SELECT object_id, predicate, row_number() OVER (PARTITION BY object_id, predicate ORDER BY seq DESC) AS turn, subject_id FROM g WHERE ns IS NULL OR nx IS DISTINCT FROM subject_id",
    "M08_source_presence": f"{_SHARED} SELECT c_custkey AS probe_id, array_to_string(list_filter(list_sort(list_distinct(list(source))), lambda x: c_custkey % 2 = 1 OR x IN ('slack', 'gmail')), ',') AS sources FROM customer JOIN claims ON object_id = 'account:' || c_custkey AND predicate = 'OWNS' GROUP BY 1",
    "M13_current_owner": f"SELECT object_id, subject_id FROM ({_top("valid_to = DATE '9999-12-31'", "valid_from DESC, claim_id DESC")}) WHERE predicate = 'OWNS'",
    "F01_current_state": _top("valid_to = DATE '9999-12-31'", "valid_from DESC, claim_id DESC"),
    "D07_as_of": _top(f"valid_from <= DATE '{DAY}' AND valid_to > DATE '{DAY}'", "valid_from DESC, claim_id DESC"),
    "D07_as_of_many": _W + """, probes AS (SELECT DISTINCT o_orderkey AS probe_id, 'account:' || o_custkey AS object_id,
        CASE o_orderkey % 3 WHEN 0 THEN 'OWNS' WHEN 1 THEN 'MAINTAINS' ELSE 'LEADS' END AS predicate, CAST(o_orderdate AS DATE) + 30 AS day FROM orders)
        SELECT probe_id, object_id, predicate, day, subject_id, valid_from, claim_id FROM (SELECT p.*, c.subject_id, c.valid_from, c.claim_id,
        row_number() OVER (PARTITION BY p.probe_id, p.object_id, p.predicate, p.day ORDER BY c.valid_from DESC, c.claim_id DESC) AS rn
        FROM probes p LEFT JOIN claims c ON c.object_id = p.object_id AND c.predicate = p.predicate AND c.valid_from <= p.day AND c.valid_to > p.day) WHERE rn = 1""",
    "D08_before": _W + f""" SELECT {_STATE} FROM (SELECT *, row_number() OVER (PARTITION BY object_id, predicate ORDER BY h DESC,
        CASE WHEN h = 1 THEN valid_from ELSE valid_to END DESC, claim_id DESC) AS rn FROM (SELECT *,
        CASE WHEN valid_from <= DATE '{DAY}' - 1 AND valid_to > DATE '{DAY}' - 1 THEN 1 ELSE 0 END AS h FROM claims) WHERE h = 1 OR valid_to < DATE '{DAY}') WHERE rn = 1""",
    "F02_history": f"{_W} SELECT {_STATE}, row_number() OVER ({_SEQ}) AS seq FROM claims",
    "F03_previous_holder": f"{_W} SELECT {_STATE} FROM (SELECT *, row_number() OVER (PARTITION BY object_id, predicate ORDER BY {_START} DESC, {_SEEN} DESC, claim_id DESC) AS rn FROM claims) WHERE rn = 2",
    "F04_after_event": f"""{_W}, led AS (SELECT *, lead(subject_id) OVER ({_SEQ}) AS ns, lead(valid_from) OVER ({_SEQ}) AS nf, lead(claim_id) OVER ({_SEQ}) AS nc, row_number() OVER ({_SEQ}) AS rn FROM claims),
        a AS (SELECT *, row_number() OVER (PARTITION BY object_id, predicate ORDER BY rn) AS k FROM led WHERE valid_to <> DATE '9999-12-31' AND nc IS NOT NULL),
        b AS (SELECT *, row_number() OVER (PARTITION BY object_id, predicate ORDER BY rn) AS k FROM led WHERE ns <> subject_id)
        SELECT object_id, predicate, ns AS subject_id, nf AS valid_from, nc AS claim_id, true AS by_end FROM a WHERE k = 1
        UNION ALL SELECT object_id, predicate, ns, nf, nc, false FROM b WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM a WHERE a.object_id = b.object_id AND a.predicate = b.predicate)""",
    "F05_disjoint": f"{_W} {_DISJOINT}",
    "F07_strictly_observed": f"{_W} {_STRICT}",
    "D05_contradictions": _W + """ SELECT a.object_id, a.predicate, a.claim_id AS first_id, b.claim_id AS second_id, a.subject_id AS first_subject, b.subject_id AS second_subject FROM claims a JOIN claims b
        ON a.object_id = b.object_id AND a.predicate = b.predicate AND (coalesce(a.observed_at, DATE '0001-01-01'), a.claim_id) < (coalesce(b.observed_at, DATE '0001-01-01'), b.claim_id)
        AND a.subject_id <> b.subject_id AND a.valid_from <= b.valid_to AND a.valid_to > b.valid_from""",
    "E08_conflicts": f"{_W} SELECT object_id, predicate, count(DISTINCT subject_id) AS subjects, CASE WHEN count(DISTINCT subject_id) > 1 THEN 'conflict' ELSE 'consistent' END AS status FROM claims GROUP BY 1, 2",
    "M05_conflict_state": f"""{_W}, d AS ({_DISJOINT}), s AS ({_STRICT}), l AS (SELECT object_id, predicate, subject_id AS last_subject FROM (SELECT *, row_number() OVER (PARTITION BY object_id, predicate
        ORDER BY {_SEEN} DESC, {_START} DESC, claim_id DESC) AS rn FROM claims) WHERE rn = 1), e AS (SELECT object_id, predicate, count(DISTINCT subject_id) AS k FROM claims GROUP BY 1, 2),
        st AS (SELECT e.object_id, e.predicate, l.last_subject, CASE WHEN k = 1 THEN 'definitive' WHEN disjoint THEN 'succession' WHEN "strict" THEN 'superseded' ELSE 'conflict' END AS state
        FROM e JOIN d USING (object_id, predicate) JOIN s USING (object_id, predicate) JOIN l USING (object_id, predicate))
        SELECT object_id, predicate, state, CASE WHEN state <> 'conflict' THEN last_subject END AS subject_id,
        CAST(CASE WHEN state IN ('definitive', 'succession') THEN 0.9 WHEN state = 'superseded' THEN 0.85 END AS DOUBLE) AS confidence FROM st""",
    "C13_open_claims": f"{_W} SELECT claim_id FROM claims WHERE valid_to = DATE '9999-12-31'",
    "C14_holding_claims": f"{_W} SELECT claim_id FROM claims WHERE valid_from <= DATE '{DAY}' AND valid_to > DATE '{DAY}'",
    "D02_provenance": f"{_CHAIN} SELECT claim_id, artifact_id, source_id, source_name, observed_at FROM chain",
    "E07_evidence_by_subject": f"{_CHAIN} SELECT object_id, predicate, subject_id, count(*) AS claims, count(DISTINCT source_id) AS sources, count(DISTINCT source_id) > 1 AS multi_source FROM chain GROUP BY 1, 2, 3",
    "F09_rank_evidence": f"""{_CHAIN}, cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY object_id, predicate ORDER BY valid_from DESC, claim_id DESC) AS rn FROM claims WHERE valid_to = DATE '9999-12-31') WHERE rn = 1),
        m AS (SELECT c.object_id, c.predicate, c.claim_id, c.subject_id, c.observed_at, CASE WHEN cur.subject_id = c.subject_id THEN 1 ELSE 0 END AS supports FROM chain c LEFT JOIN cur USING (object_id, predicate))
        SELECT object_id, predicate, rank, claim_id, subject_id, supports FROM (SELECT *, CAST(row_number() OVER (PARTITION BY object_id, predicate ORDER BY supports DESC, observed_at DESC, claim_id) AS INTEGER) AS rank FROM m) WHERE rank <= 3""",
    "D06_cooccurrence": f"{_SUP} SELECT DISTINCT a.subject_id, b.subject_id AS other_id FROM claims a JOIN claims b ON a.artifact_id = b.artifact_id AND a.subject_id <> b.subject_id",
    "D12_edge_history": f"{_W} SELECT subject_id AS src, object_id AS dst, predicate AS rel, valid_from, valid_to FROM claims",
    "D13_dependencies_out": f"{_SUP} SELECT subject_id AS node, predicate AS rel, count(DISTINCT object_id) AS neighbours FROM claims GROUP BY 1, 2",
    "D13_dependencies_in": f"{_SUP} SELECT object_id AS node, predicate AS rel, count(DISTINCT subject_id) AS neighbours FROM claims GROUP BY 1, 2",
    "D14_two_hop": f"{_SUP}, o AS (SELECT DISTINCT artifact_id, object_id FROM claims) SELECT a.object_id, b.object_id AS other_object, count(*) AS artifacts FROM o a JOIN o b ON a.artifact_id = b.artifact_id AND a.object_id < b.object_id GROUP BY 1, 2",
    "D15_export_nodes": f"{_W} SELECT subject_id AS id, 'Subject' AS label FROM claims UNION SELECT object_id, 'Object' FROM claims UNION SELECT claim_id, 'Claim' FROM claims UNION SELECT artifact_id, 'Artifact' FROM claims",
    "D15_export_edges": f"{_W} SELECT claim_id AS src, object_id AS dst, 'ABOUT' AS rel FROM claims UNION SELECT claim_id, artifact_id, 'SOURCED_FROM' FROM claims UNION SELECT subject_id, object_id, predicate FROM claims",
    "D16_neighbourhood": f"""{_W}, e AS (SELECT DISTINCT subject_id AS src, object_id AS dst FROM claims UNION SELECT DISTINCT object_id, subject_id FROM claims),
        h1 AS (SELECT DISTINCT dst AS node FROM e WHERE src = 'account:1'), h2 AS (SELECT DISTINCT dst AS node FROM e WHERE src IN (SELECT node FROM h1)),
        r AS (SELECT DISTINCT object_id AS node, 0 AS hops FROM claims WHERE object_id = 'account:1')
        SELECT 'account:1' AS start, node, CAST(min(hops) AS INTEGER) AS hops FROM (SELECT * FROM r UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2) GROUP BY node""",
    "E02_claims_per_predicate": f"{_W} SELECT predicate, count(*) AS claims FROM claims GROUP BY 1",
    "D30_scope_counts": f"{_W} SELECT object_id, count(*) AS claims, count(DISTINCT artifact_id) AS artifacts FROM claims GROUP BY 1",
}


# ---------------------------------------------------------------- the same over the claims table as it is
def checkpoint_claims(spark, folder):
    """The claims of the test tables by their keys, with nulls, unreadable times and repeated facts left as they are."""
    c = table(spark, folder, "claims_checkpoint50")
    read = normalize(c, "observed_at", "at")
    day = lambda name: F.left(F.trim(name), F.lit(10)).try_cast("date")
    observed = F.date_from_unix_date(F.floor(F.col("at") / 86_400_000_000).cast("int"))
    start, end = C.bounds(day("valid_from"), day("valid_to"), observed)
    return read.select(
        "claim_id", "artifact_id", mention_key(F.col("subject_mention")).alias("subject_id"), F.upper(F.trim("predicate")).alias("predicate"), mention_key(F.col("object_mention")).alias("object_id"),
        observed.alias("observed_at"), start.alias("valid_from"), end.alias("valid_to"),
    ).distinct()


_CHECKPOINT = f"""{read_sql("SELECT observed_at AS v, 'YMD' AS ord FROM claims_checkpoint50")}, cc AS (SELECT DISTINCT claim_id, artifact_id, {KEY_SQL.format('subject_mention')} AS subject_id, upper(trim(predicate)) AS predicate, {KEY_SQL.format('object_mention')} AS object_id,
  CAST(make_timestamp(coalesce(i, l)) AS DATE) AS observed_at, try_cast(left(trim(valid_from), 10) AS DATE) AS f, try_cast(left(trim(valid_to), 10) AS DATE) AS t FROM claims_checkpoint50 LEFT JOIN rd ON v = observed_at),
claims AS (SELECT claim_id, artifact_id, subject_id, predicate, object_id, observed_at, coalesce(f, CASE WHEN t IS NOT NULL THEN DATE '0001-01-01' END, observed_at) AS valid_from, coalesce(t, DATE '9999-12-31') AS valid_to FROM cc)
"""
_ON_CHECKPOINT = {
    "F01_current_state": S.current, "F02_history": S.history, "F05_disjoint": S.disjoint, "F07_strictly_observed": S.strictly_observed, "D05_contradictions": S.contradictions, "E08_conflicts": S.conflicts, "M05_conflict_state": S.conflict_state,
    "F03_previous_holder": S.previous, "F04_after_event": S.after_event, "F08_owners": lambda c: X.owners(S.history(c)), "D15_export_nodes": G.export_nodes, "D15_export_edges": G.export_edges, "E02_claims_per_predicate": lambda c: c.groupBy("predicate").agg(F.count(F.lit(1)).alias("claims")),
}
for _name, _op in _ON_CHECKPOINT.items():
    QUERIES[f"{_name}_of_claims"] = lambda spark, folder, op=_op: op(checkpoint_claims(spark, folder))
    ORACLES[f"{_name}_of_claims"] = ORACLES[_name].replace(C.ORDER_CLAIMS_SQL, _CHECKPOINT)
