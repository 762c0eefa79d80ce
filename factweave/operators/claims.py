"""Claims: ids, validity bounds, and claims made of the orders table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.sources.tables import table

# Ends of open intervals.
OPEN_START, OPEN_END = "0001-01-01", "9999-12-31"


def short_hash(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts joined by ``|`` (null parts as empty)."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16)


def artifact_id(source: Column, native: Column) -> Column:
    """Identity of an artifact from its source and native id."""
    return F.concat(F.lit("dsid_"), F.substring(F.sha2(F.concat(source, F.lit("|"), native), 256), 1, 32))


def bounds(valid_from: Column, valid_to: Column, observed: Column) -> tuple[Column, Column]:
    """Half-open validity: an open end is far ahead; a start that is missing is the far past
    where the end is known and the observation where it is not."""
    end = F.coalesce(valid_to, F.lit(OPEN_END).cast("date"))
    start = F.coalesce(valid_from, F.when(valid_to.isNotNull(), F.lit(OPEN_START).cast("date")), observed)
    return start, end


def order_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Claims made of the orders table: who answers for an account, from order to order.

    The next order of an account and status ends a claim, unless its key is a multiple of 7.
    """
    o = table(spark, folder, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    nxt = F.lead("day").over(Window.partitionBy("o_custkey", "o_orderstatus").orderBy("day", "o_orderkey"))
    kind = F.when(F.col("o_orderstatus") == "F", "OWNS").when(F.col("o_orderstatus") == "O", "MAINTAINS").otherwise("LEADS")
    ended = o.withColumn("end", F.when(F.col("o_orderkey") % 7 != 0, nxt))
    start, end = bounds(F.col("day"), F.col("end"), F.col("day"))
    return ended.select(
        short_hash(F.lit("o"), F.col("o_orderkey")).alias("claim_id"), F.concat(F.lit("order:"), F.col("o_orderkey")).alias("artifact_id"),
        F.concat(F.lit("person:"), F.col("o_orderkey") % 97).alias("subject_id"), kind.alias("predicate"),
        F.concat(F.lit("account:"), F.col("o_custkey")).alias("object_id"), F.col("day").alias("observed_at"), start.alias("valid_from"), end.alias("valid_to"),
    )


ORDER_CLAIMS_SQL = """
claims AS (
  SELECT left(sha256('o|' || o_orderkey), 16) AS claim_id, 'order:' || o_orderkey AS artifact_id,
    'person:' || (o_orderkey % 97) AS subject_id,
    CASE o_orderstatus WHEN 'F' THEN 'OWNS' WHEN 'O' THEN 'MAINTAINS' ELSE 'LEADS' END AS predicate,
    'account:' || o_custkey AS object_id, CAST(o_orderdate AS DATE) AS observed_at, CAST(o_orderdate AS DATE) AS valid_from,
    COALESCE(CASE WHEN o_orderkey % 7 <> 0 THEN
      LEAD(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY CAST(o_orderdate AS DATE), o_orderkey) END,
      DATE '9999-12-31') AS valid_to
  FROM orders)
"""
