"""Incremental ingestion: deduplication, retries with parking, and state from an append-only log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from factweave.plans.lineage import cut, shared_dir, stored
from factweave.sources.tables import table

MAX_ATTEMPTS = 3


def replay(df: DataFrame, files: int, order: str) -> DataFrame:
    """``df`` as a stream of ``files`` micro-batches in the order of a column.

    A file stream reads by modification time, so the parts are written one after another.
    """
    spark = df.sparkSession
    at = shared_dir(spark, "replay")
    parts = stored(df.repartitionByRange(files, order).withColumn("__part", F.spark_partition_id()), "parts")
    for no in range(files):
        parts.where(F.col("__part") == no).drop("__part").coalesce(1).sortWithinPartitions(order).write.mode("append").parquet(at)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", "1").parquet(at)


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], at: str) -> None:
    """Runs ``each`` on every micro-batch of all there is, then stops; restarts go on from ``at``."""
    query = stream.writeStream.option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


def polled(stream: DataFrame, each: Callable[[DataFrame, int], None], at: str, every: str = "2 seconds"):
    """A query that looks for new input ``every`` so often until it is stopped; a batch that fails is tried again at the next start.

    Returns the running query: ``stop()`` ends it after the batch at hand.
    """
    def guarded(batch: DataFrame, no: int) -> None:
        if not batch.isEmpty():
            each(batch, no)

    return stream.writeStream.option("checkpointLocation", f"{at}/progress").trigger(processingTime=every).foreachBatch(guarded).start()


def first_of_either(batch: DataFrame, id_: str, key: str, order: str) -> DataFrame:
    """Rows kept by taking them in ``order`` and dropping each whose id or key is already taken.

    In every round the rows that come first by both are taken and what shares an id or a key
    with them is dropped, which is what taking them one by one gives. Null keys take nothing
    from each other. Equal orders are broken by the id.
    """
    rest, kept = cut(batch.withColumn("__o", F.struct(order, id_))), None
    while not rest.isEmpty():
        by_id = rest.groupBy(id_).agg(F.min("__o").alias("oi"))
        by_key = rest.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("__o").alias("ok"))
        firsts = rest.join(by_id, id_).join(by_key, key, "left").where((F.col("__o") == F.col("oi")) & (F.col("ok").isNull() | (F.col("__o") == F.col("ok")))).select(*rest.columns)
        firsts = cut(firsts.dropDuplicates([id_]))
        kept = firsts if kept is None else kept.unionByName(firsts)
        rest = cut(rest.join(firsts.select(id_), id_, "left_anti").join(firsts.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").select(*rest.columns))
    return (batch.limit(0) if kept is None else kept.drop("__o")).select(*batch.columns)


def deduplicated(stream: DataFrame, id_: str, key: str, order: str) -> DataFrame:
    """Rows of a stream whose id and key both are new, over all micro-batches.

    The ledger is the result itself: what it holds is dropped by two anti joins, the rest is
    settled inside the batch. Each batch writes its own folder, so a repeated batch leaves one.
    """
    spark = stream.sparkSession
    at = shared_dir(spark, "ledger")
    schema = stream.schema

    def each(batch: DataFrame, no: int) -> None:
        session = batch.sparkSession
        fresh = batch
        if no > 0:
            seen = session.read.schema(schema).parquet(*[f"{at}/out/{i}" for i in range(no)])
            fresh = fresh.join(seen.select(id_), id_, "left_anti").join(seen.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
        first_of_either(fresh.select(*schema.names), id_, key, order).write.mode("overwrite").parquet(f"{at}/out/{no}")

    run(stream, each, at)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{at}/out")


def ingested(stream: DataFrame, make: Callable[[DataFrame], DataFrame], ok: str) -> tuple[DataFrame, DataFrame]:
    """The log of all rows that ``make`` turned out well (``ok`` holds), and the parked others.

    A row that fails is tried again with each of the next batches, ``MAX_ATTEMPTS`` times in
    all, then parked with its number of attempts. When the input has ended, what still waits is
    tried again by itself, so every row ends in one of the two.
    """
    spark = stream.sparkSession
    at = shared_dir(spark, "ingest")
    names = [*stream.columns, "__attempts"]
    batches = []

    def waiting(session: SparkSession, no: int) -> DataFrame:
        return session.read.schema(StructType([*stream.schema.fields, StructField("__attempts", IntegerType())])).parquet(f"{at}/retry/{no}")

    def attempt(rows: DataFrame, no: int) -> None:
        tried = cut(make(rows).withColumn("__attempts", F.col("__attempts") + 1))
        good = F.coalesce(F.expr(ok), F.lit(False))
        tried.where(good).write.mode("overwrite").parquet(f"{at}/log/{no}")
        again = tried.where(~good & (F.col("__attempts") < MAX_ATTEMPTS))
        again.select(*names).write.mode("overwrite").parquet(f"{at}/retry/{no}")
        tried.where(~good & (F.col("__attempts") >= MAX_ATTEMPTS)).write.mode("overwrite").parquet(f"{at}/parked/{no}")

    def each(batch: DataFrame, no: int) -> None:
        rows = batch.withColumn("__attempts", F.lit(0))
        attempt(rows.unionByName(waiting(batch.sparkSession, no - 1)) if no > 0 else rows, no)
        batches.append(no)

    run(stream, each, at)
    last = max(batches, default=None)
    while last is not None and not (rest := waiting(spark, last)).isEmpty():
        last += 1
        attempt(rest, last)
    read = spark.read.option("recursiveFileLookup", "true")
    return read.parquet(f"{at}/log"), read.parquet(f"{at}/parked")


def windowed(stream: DataFrame, time: str, length: str, late: str, by: str) -> DataFrame:
    """``window_start, by, n``: rows per tumbling window, each window once, after the watermark has passed it.

    When the bounded input has ended, a mark far ahead closes the windows that are still open:
    the job is started again where it stopped and reads just the mark. Rows that come ``late``
    behind the newest are not counted.
    """
    spark = stream.sparkSession
    at = shared_dir(spark, "windows")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema.fields if f.name not in (time, by)]
    mark = spark.range(1).select(F.lit("9000-01-01").cast(stream.schema[time].dataType).alias(time), F.lit(None).cast(stream.schema[by].dataType).alias(by), *none).select(*stream.columns)
    mark.limit(0).write.parquet(f"{at}/mark")
    both = stream.union(spark.readStream.schema(stream.schema).parquet(f"{at}/mark"))
    counted = both.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), by, "n")

    def once() -> None:
        counted.writeStream.outputMode("append").option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).foreachBatch(
            lambda batch, no: batch.write.mode("overwrite").parquet(f"{at}/out/{no}")
        ).start().awaitTermination()

    once()
    mark.write.mode("append").parquet(f"{at}/mark")
    once()
    # The mark's own window never closes.
    return spark.read.schema(counted.schema).option("recursiveFileLookup", "true").parquet(f"{at}/out")


def looked_up(stream: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Every event with the record it names (stream-static join); events without a record stay, with nulls."""
    return stream.join(records, key, "left")


def unique_soon(stream: DataFrame, time: str, within: str, *keys: str) -> DataFrame:
    """The first of events with the same keys that come within ``within`` of each other; state is forgotten after that."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(list(keys))


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The events table with a record key and its time as an instant."""
    e = table(spark, folder, "events")
    return e.select("event_id", F.concat_ws("|", "user_id", "event_type").alias("record_key"), "event_type", "user_id", F.col("ts").cast("timestamp").alias("at"), "value")
