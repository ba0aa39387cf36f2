"""Tables written between the jobs of one operator, and numbering across partitions."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.sources.shared import new_table_path


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, and read from there.

    Lineage ends here: if an executor is lost, later jobs read the files again.
    """
    path = new_table_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that stores rows like ``stored``, in a folder that is deleted at the end, whatever happens.

    What is computed from them must have been stored elsewhere by then.
    """
    path = new_table_path(spark, "passing")

    def keep(rows: DataFrame) -> DataFrame:
        table = f"{path}/{uuid.uuid4().hex}"
        rows.write.parquet(table)
        return spark.read.schema(rows.schema).parquet(table)

    try:
        yield keep
    finally:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def free_name(taken: list[str], name: str) -> str:
    """The name, with as many underscores after it as it takes to differ from all taken ones."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; none for a null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def crc32_of(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes of a text; a null counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def fraction(key: Column) -> Column:
    """A number from 0 to below 1 that follows from the key."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 31)) / float(1 << 31)


def numbered(rows: DataFrame, order: list[str], name: str, number: str = "number", weight: Column | None = None) -> DataFrame:
    """Rows in a total order with a number from 0, and where asked the sum of a weight before them.

    The rows are dealt out by ranges of the order and counted within each range;
    the ranges' own totals (one row per partition) then give where each starts.
    No task holds more than one range, however many rows share a leading key.
    Adds ``number`` and, with a weight, ``before``.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.withColumns(
        {
            "_part": F.spark_partition_id(),
            "_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
            **({} if weight is None else {"_weight": weight}),
        }
    )
    placed = stored(placed, name)
    totals = [F.count("*").alias("_count")] + ([] if weight is None else [F.sum("_weight").alias("_sum")])
    parts = placed.groupBy("_part").agg(*totals)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        "_part",
        F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_first"),
        *([] if weight is None else [F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start")]),
    )
    # One row per partition: the number of partitions bounds this broadcast.
    out = placed.join(F.broadcast(starts), "_part").withColumn(number, F.col("_first") + F.col("_row"))
    if weight is not None:
        within = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("before", F.col("_start") + F.coalesce(F.sum("_weight").over(within), F.lit(0)))
    return out.drop("_part", "_row", "_first", "_start", "_weight")
