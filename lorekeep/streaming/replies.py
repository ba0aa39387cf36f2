"""The event loop: a stream of chat events in, replies out.

Messages, commands and button presses come in one stream and differ in their
kind.  A button carries its own page and query, so the only thing kept between
batches is which events have been taken up, in the stream's state store and for a
time.  Search and authorisation run per micro-batch on the batch operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorekeep.operators.joins import scratch, written
from lorekeep.plans.answer import Answers
from lorekeep.plans.directory import pinned

EVENT_SCHEMA = (
    "event_id bigint, kind string, channel_id string, ts string, user_id string, subtype string, text string, "
    "actions array<struct<name: string, value: string>>"
)


def read_events(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def start_replies(
    events: DataFrame,
    answer: Callable[..., Answers],
    out: str,
    checkpoint: str,
    interval: str | None = None,
    remember: str = "7 days",
    directory: str | None = None,
) -> StreamingQuery:
    """Answer each micro-batch of ``events``; write heads to ``out``/heads and rows to ``out``/rows.

    An event is answered once, however often it is delivered within the time of
    ``remember``: ids taken up are kept in the state of the stream, and leave it
    when that time has passed since they arrived, so the state is bounded by what
    arrives in it.  Events without an id can neither be told apart nor answered;
    each goes to ``out``/rejects with the reason.  A batch that is run again after
    a failure replaces its own output.  With the path of a ``directory``, each
    batch is answered by ``answer(batch, version)``, the version that was
    published last when the batch ran first; else by ``answer(batch)``.  The
    scratch tables of a batch are deleted with it.  Without an ``interval`` the
    query stops when all that has arrived is answered.
    """
    spark = events.sparkSession
    # Of events without an id, only exact copies are one.
    whole = F.sha2(F.to_json(F.struct(*events.columns)), 256)
    key = F.coalesce(F.concat(F.lit("id-"), F.col("event_id").cast("string")), whole)
    arriving = events.withColumns({"key": key, "arrived": F.current_timestamp()})
    once = arriving.withWatermark("arrived", remember).dropDuplicatesWithinWatermark(["key"]).drop("key", "arrived")

    def write(batch: DataFrame, batch_id: int) -> None:
        with scratch(spark):
            batch = written(batch)
            if batch.isEmpty():
                return
            fresh = batch.filter(F.col("event_id").isNotNull())
            answers = answer(fresh, pinned(spark, directory, f"{out}/pins", batch_id)) if directory else answer(fresh)
            answers.heads.write.mode("overwrite").parquet(f"{out}/heads/batch={batch_id}")
            answers.rows.write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")
            rejects = batch.filter(F.col("event_id").isNull()).withColumn("reason", F.lit("missing event_id"))
            rejects.write.mode("overwrite").parquet(f"{out}/rejects/batch={batch_id}")

    writer = once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    trigger = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return trigger.start()
