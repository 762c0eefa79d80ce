"""Problem 2: rebuilding conversations from message rows with keyed streaming state."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions import timestamps
from factweave.functions.text import UNSEEN, thread_key
from factweave.plans import sharded
from factweave.plans.lineage import shared_dir
from factweave.plans.small import bounded
from factweave.sources.tables import table

#: How long after its root a conversation stays open for late rows (they come weeks late).
CLOSE_AFTER = "90 days"
#: Event time of the mark that ends a bounded input and so closes whatever is still open.
END_MARK = "9000-01-01 00:00:00"

MESSAGE = (
    "channel_id string, thread string, root_at timestamp, message_id string, artifact_id string,"
    " author string, readable boolean, body boolean, reply_count int"
)


def user_key(c: Column) -> Column:
    """User id without case, blanks and ``<@>``; null when nothing is left."""
    u = F.upper(F.regexp_replace(c, r"[\s\p{Z}<>@]|\|.*", ""))
    return F.when(u != "", u)


def has_body(content: Column, name: Column) -> Column:
    """Whether something visible follows the channel line and the display name.

    Without a display name the label ends at the first colon of the line.
    """
    after = F.regexp_replace(content, r"^\s*#[^\n]*", "")
    after = F.ltrim(F.regexp_replace(after, r"^\s+", ""))
    label = F.concat(F.trim(name), F.lit(":"))
    body = F.when(after.startswith(label), F.substring(after, F.length(label) + 1, F.lit(2147483647)))
    body = F.coalesce(body, F.regexp_replace(after, r"^[^\n:]*(:|$)", ""))
    return F.coalesce(F.regexp_replace(body, rf"{UNSEEN}+", "") != "", F.lit(False))


def messages(artifacts: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Threaded chat rows of ``artifacts`` (batch or stream) reduced to what validation needs.

    Rows of other sources, without a channel or without a thread id of the known forms are no
    part of any conversation and are left out.
    """
    m = F.col("metadata")
    rows = artifacts.where((F.lower(F.trim("source")) == "slack") & m["channel_id"].isNotNull()).select(
        m["channel_id"].alias("channel_id"), thread_key(m["thread_id"]).alias("thread"), F.trim(m["message_id"]).alias("message_id"),
        F.col("id").alias("artifact_id"), user_key(m["author_user_id"]).alias("author"), "timestamp",
        has_body(F.col("content"), m["author_display_name"]).alias("body"), m["reply_count"].alias("reply_count"),
        m["workspace_id"].alias("workspace_id"),
    )
    places = workspaces.groupBy(F.col("workspace_id").alias("__w")).agg(F.min("date_order").alias("__order"))
    rows = rows.where("thread is not null and message_id is not null")
    near = rows.join(bounded(places), F.col("workspace_id") == F.col("__w"), "left")
    read = timestamps.parse(near, "timestamp", "__order", "__i", "__l")
    return read.select(
        "channel_id", "thread", F.timestamp_seconds(F.col("thread").cast("decimal(20,6)")).alias("root_at"), "message_id",
        "artifact_id", "author", F.coalesce("__i", "__l").isNotNull().alias("readable"), "body", "reply_count",
    )


def buffered(stream: DataFrame, close_after: str = CLOSE_AFTER) -> DataFrame:
    """One row per message, held in keyed state until its conversation closes.

    The key starts with channel and thread, and the event time is that of the thread's root,
    so all messages of a conversation leave the state together once the watermark has passed
    its root by ``close_after``. Deliveries of a message are merged on arrival. State is one
    row of fixed size per message: a conversation of any length spreads over all partitions.
    """
    timed = stream.withWatermark("root_at", close_after)
    return timed.groupBy("channel_id", "thread", "root_at", "message_id").agg(
        F.min("artifact_id").alias("artifact_id"), F.max("author").alias("author"), F.bool_or("readable").alias("readable"),
        F.bool_or("body").alias("body"), F.max("reply_count").alias("reply_count"),
    )


def validated(closed: DataFrame) -> DataFrame:
    """Ordered messages, with roles, of the closed conversations that are whole.

    ``closed`` has one row per message (see ``buffered``). A conversation is kept if its root
    is there, somebody other than the root's author replied, at least the root's
    ``reply_count`` replies (null: 0) are there, and every message has an author, a readable
    time and a body. The check is a map-side aggregate of fixed size; messages are numbered in
    hour shards, so neither a long conversation nor a busy channel ends in one task.
    """
    is_root = F.col("message_id") == F.col("thread")
    per = closed.groupBy("channel_id", "thread").agg(
        F.max(F.when(is_root, F.col("author"))).alias("starter"),
        F.max(F.when(is_root, F.coalesce("reply_count", F.lit(0)))).alias("wanted"),
        F.count_if(~is_root).alias("replies"),
        F.min("author").alias("least"),
        F.max("author").alias("most"),
        F.bool_and(F.col("author").isNotNull() & F.col("readable") & F.col("body")).alias("sound"),
    )
    # The root's author is among the authors, so two different ones mean somebody else replied.
    whole = per.where("sound and starter is not null and replies >= wanted and least <> most")
    kept = closed.join(whole.select("channel_id", "thread", "starter"), ["channel_id", "thread"])
    hours = kept.withColumn("__hour", F.floor(F.col("message_id").try_cast("decimal(20,6)") / 3600))
    order = [F.col("message_id").try_cast("decimal(20,6)"), F.col("message_id")]
    numbered = sharded.row_number(hours, ["channel_id", "thread"], "__hour", order, "turn_no")
    role = F.when(F.col("author") == F.col("starter"), "starter").otherwise("replier")
    return numbered.select("channel_id", "thread", F.col("turn_no").cast("int").alias("turn_no"), "artifact_id", role.alias("role"))


@contextmanager
def _state_on_disk(spark: SparkSession):
    """State in RocksDB with bounded memory, so it may outgrow the executors' heaps."""
    own = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
        "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    }
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: A root whose time is more than this ahead of the clock is no time of sending; it would close all other conversations.
AHEAD = "1 day"


def plausible(rows: DataFrame, ahead: str = AHEAD) -> Column:
    """Whether a row's root lies no further ahead of the clock than ``ahead``."""
    return F.col("root_at") <= F.current_timestamp() + F.expr(f"interval {ahead}")


def run(rows: DataFrame, at: str, close_after: str = CLOSE_AFTER, bounded_input: bool = True) -> str:
    """Runs the streaming job over ``rows`` (a stream of ``messages``), returns its output folder.

    Every micro-batch writes the messages of the conversations it closed to its own folder,
    validates them and writes the result; both writes overwrite, so a batch that is repeated
    after a failure leaves one result. All of a bounded input is one micro-batch, so its order
    is free and nothing is late; an end mark then closes what is open. With
    ``bounded_input=False`` nothing is closed before its time: a conversation ends ``close_after``
    behind the newest root. Rows that come later belong to a closed one; ``late`` lists them.
    Rows whose root is ahead of the clock never move the watermark; they go to ``refused``. A
    job that is started again in the same folder goes on where it stopped.
    """
    spark = rows.sparkSession
    if not bounded_input:
        ahead = rows.where(~plausible(rows)).writeStream.format("parquet").option("path", f"{at}/refused").option("checkpointLocation", f"{at}/refused-state")
        ahead.trigger(availableNow=True).start().awaitTermination()
        rows = rows.where(plausible(rows))
    if bounded_input:
        mark = spark.range(1).select(*[
            (F.lit(END_MARK).cast("timestamp") if f.name == "root_at" else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in rows.schema.fields
        ])
        mark.write.parquet(f"{at}/end")
        rows = rows.union(spark.readStream.schema(rows.schema).parquet(f"{at}/end"))

    def emit(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/closed/{no}")
        closed = batch.sparkSession.read.schema(batch.schema).parquet(f"{at}/closed/{no}")
        validated(closed).write.mode("overwrite").parquet(f"{at}/out/batch={no}")

    with _state_on_disk(spark):
        query = (
            buffered(rows, close_after)
            .writeStream.outputMode("append")
            .option("checkpointLocation", f"{at}/state")
            .trigger(availableNow=True)
            .foreachBatch(emit)
            .start()
        )
        query.awaitTermination()
    marks = [p["eventTime"]["watermark"] for p in query.recentProgress if "watermark" in (p["eventTime"] or {})]
    if marks:
        spark.createDataFrame([(max(marks),)], "watermark string").write.mode("append").parquet(f"{at}/watermarks")
    return f"{at}/out"


def late(arrived: DataFrame, at: str) -> DataFrame:
    """The rows of ``arrived`` (``messages`` read as a table) that a job in folder ``at`` did not take in time.

    Their conversation's time has passed the watermark, but no conversation that was closed
    holds them: they came after it had been closed. What is still open is not late.
    """
    spark = arrived.sparkSession
    mark = spark.read.schema("watermark string").parquet(f"{at}/watermarks").agg(F.max("watermark").cast("timestamp").alias("m")).first()["m"]
    taken = spark.read.schema(MESSAGE).option("recursiveFileLookup", "true").parquet(f"{at}/closed").select("channel_id", "thread", "message_id").distinct()
    passed = arrived.where(F.col("root_at") <= F.lit(mark))
    return passed.join(taken, ["channel_id", "thread", "message_id"], "left_anti").select(*arrived.columns)


RESULT = "channel_id string, thread string, turn_no int, artifact_id string, role string"


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every kept conversation of the chat rows, message by message."""
    path = f"{folder.rstrip('/')}/artifacts.parquet"
    schema = spark.read.parquet(path).schema
    # As a pattern, because a stream's plain path must be a folder and the table may be one file.
    stream = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    rows = messages(stream, table(spark, folder, "workspaces"))
    out = run(rows, shared_dir(spark, "conversations"))
    found = spark.read.schema(RESULT).option("recursiveFileLookup", "true").parquet(out)
    return found.select("channel_id", F.col("thread").alias("thread_id"), "turn_no", "artifact_id", "role")
