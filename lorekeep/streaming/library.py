"""A library kept current by a stream of drops: sources and commits in, versions out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lorekeep.plans.build import apply_drop

DROP_SCHEMA = (
    "kind string, path string, seq bigint, text string, html string, "
    "authored_at string, author_name string, author_email string"
)


def read_drops(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Files that are put into a folder, each a number of changes."""
    reader = spark.readStream.schema(DROP_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def start_ingest(
    drops: DataFrame, path: str, stream: str, checkpoint: str, buckets: int | None = None, interval: str | None = None
) -> StreamingQuery:
    """Bring the library at ``path`` forward by each micro-batch of ``drops``.

    A version names the last batch of each stream that is in it, so a batch that
    is run again after a failure publishes nothing, and each batch is just one
    version.  Without an ``interval`` the query stops when all that has arrived is
    taken in.
    """

    def take_in(batch: DataFrame, batch_id: int) -> None:
        # Read where it lies, once for its commits and once for its files: a copy would be as large as the drop.
        apply_drop(batch, path, stream, batch_id, buckets)

    writer = drops.writeStream.foreachBatch(take_in).option("checkpointLocation", checkpoint)
    trigger = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return trigger.start()
