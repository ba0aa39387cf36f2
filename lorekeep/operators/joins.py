"""Deciding between a broadcast and a shuffled join by the size of the rows; scratch tables."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.sources.shared import new_table_path

MAX_BROADCAST_BYTES = 64 << 20
#: Bytes that a row costs beside its text form.
ROW_BYTES = 32
#: Rows are measured up to this many; more are never broadcast.
MAX_BROADCAST_ROWS = 500_000

_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


def written(rows: DataFrame) -> DataFrame:
    """The rows, computed once and kept as a table in the session's shared folder."""
    spark = rows.sparkSession
    folder = _SCRATCH.get()
    path = f"{folder}/{uuid.uuid4().hex}" if folder else new_table_path(spark, "written")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``written`` makes within are deleted at the end, whatever happens.

    What is computed from them must have been written elsewhere by then.
    """
    path = new_table_path(spark, "scratch")
    before = _SCRATCH.set(path)
    try:
        yield
    finally:
        _SCRATCH.reset(before)
        _delete(spark, path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the tables that ``written`` has made so far in the innermost ``scratch``; none of them may be needed again."""
    if path := _SCRATCH.get():
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def broadcast_if_small(rows: DataFrame, limit: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast rows that have been measured to be small; else leave the join to
    Spark, which shuffles it and splits skewed partitions at run time.

    The size is that of the rows as text, so a few long texts count for what
    they are.  Derived rows should be ``written`` first, or measuring computes
    them twice.
    """
    return F.broadcast(rows) if is_small(rows, limit) else rows


def is_small(rows: DataFrame, limit: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether rows have been measured to be few and short enough for a broadcast."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*rows.columns))) + F.lit(ROW_BYTES))
    n, total = rows.limit(MAX_BROADCAST_ROWS + 1).agg(F.count("*"), size).first()
    return n <= MAX_BROADCAST_ROWS and (total or 0) <= limit
