"""Problem 6: one UTC instant for every readable time, whatever its format and zone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions import timestamps, zones
from factweave.plans.small import bounded
from factweave.sources.tables import table

CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\+00:00$"


def normalize(df: DataFrame, value: str, out: str, workspace: str | None = None, workspaces: DataFrame | None = None) -> DataFrame:
    """Adds ``out``: UTC micros of the textual time in column ``value``, null if unreadable.

    Without ``workspace`` a time without a zone is UTC. With it, column ``workspace`` is
    looked up in ``workspaces(workspace_id, time_zone, date_order)`` for the zone and for the
    order of dates in figures; rows whose workspace is null or unknown use UTC and ``YMD``.
    An ambiguous wall-clock time means its first occurrence, one that the clocks skipped is
    moved forward by the skipped amount. Null and blank values and words give null. All
    columns of ``df`` are kept; names beginning with ``__fw_``, ``__ts_`` and ``__z_`` are reserved.
    """
    spark = df.sparkSession
    if workspace is None:
        read = timestamps.parse(df, value, None, "__fw_instant", "__fw_local")
        return read.withColumn(out, F.coalesce("__fw_instant", "__fw_local")).drop("__fw_instant", "__fw_local")
    places = workspaces.groupBy(F.col("workspace_id").alias("__fw_w")).agg(
        F.min("time_zone").alias("__fw_zone"), F.min_by("date_order", "time_zone").alias("__fw_order")
    )
    near = df.join(bounded(places), F.col(workspace) == F.col("__fw_w"), "left")
    read = timestamps.parse(near, value, "__fw_order", "__fw_instant", "__fw_local")
    seg = zones.segments(spark, workspaces.select("time_zone"))
    placed = zones.localize(read, "__fw_local", "__fw_zone", seg, "__fw_utc")
    plain = F.when(F.col("__fw_zone").isNull(), F.col("__fw_local"))
    done = placed.withColumn(out, F.coalesce("__fw_instant", "__fw_utc", plain))
    return done.drop("__fw_w", "__fw_zone", "__fw_order", "__fw_instant", "__fw_local", "__fw_utc")


def instants(values: DataFrame, workspaces: DataFrame) -> DataFrame:
    """``field_name, row_id, utc_micros`` of values not already in canonical form, distinct.

    ``values``: ``field_name, row_id, value, workspace_id``. Rows whose value cannot be read
    give no row; repeated rows give one.
    """
    rest = values.where(~F.coalesce(F.col("value").rlike(CANONICAL), F.lit(True)))
    read = normalize(rest, "value", "utc_micros", "workspace_id", workspaces)
    return read.where("utc_micros is not null").select("field_name", "row_id", "utc_micros").distinct()


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """All three time columns of the test tables; only artifacts.timestamp has a local zone."""
    artifacts, claims = table(spark, folder, "artifacts"), table(spark, folder, "claims_checkpoint50")
    none = F.lit(None).cast("string")
    pairs = F.array(
        F.struct(F.lit("artifacts.timestamp").alias("field_name"), F.col("timestamp").alias("value"), F.col("metadata.workspace_id").alias("workspace_id")),
        F.struct(F.lit("artifacts.metadata.ingested_at").alias("field_name"), F.col("metadata.ingested_at").alias("value"), none.alias("workspace_id")),
    )
    of_artifacts = artifacts.select(F.col("id").alias("row_id"), F.explode(pairs).alias("x")).select(
        "x.field_name", "row_id", "x.value", "x.workspace_id"
    )
    of_claims = claims.select(
        F.lit("claims_checkpoint50.observed_at").alias("field_name"), F.col("claim_id").alias("row_id"), F.col("observed_at").alias("value"), none.alias("workspace_id")
    )
    return instants(of_artifacts.unionByName(of_claims), table(spark, folder, "workspaces"))
