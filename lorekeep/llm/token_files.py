"""Token ids of documents as Parquet files that can be read in part.

Documents lie in ascending doc_id order over the files and within them.  The
ids are a list column in dictionary encoding, the numbers beside them are delta
encoded; row groups and pages are kept small enough that the statistics of row
groups and the page index let a reader of a few documents, or of the numbers
alone, skip the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.llm.tokens import crc32_of_ids, encoded

#: Bytes of a row group and of a page, and rows of a page.
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 16 << 20, 256 << 10, 1_000

SCHEMA = "doc_id long, n_tokens long, part int, before_in_part long, tokens array<int>"


def write_tokens(
    documents: DataFrame, path: str, tokenizer_path: str, end_id: int,
    row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS,
) -> None:
    """Encode every whole text, with an end id after it, and write the files.

    A null text is empty, so its document holds the end id alone.  Rows without
    doc_id come first; rows that repeat an id follow each other in the order of a
    digest of their texts, each with its own ids.  Other columns, whatever their
    names, are not looked at.  ``part`` numbers the runs of documents that tasks
    wrote, and ``before_in_part`` counts the ids of earlier documents of a run, so
    neither the names nor the number of the files matter.
    """

    def encode(batches):
        before, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            rows = list(encoded(batch.column("text"), tokenizer_path, end_id))
            lengths = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
            ends = np.cumsum(lengths)
            flat = np.concatenate(rows).astype(np.int32) if rows else np.empty(0, dtype=np.int32)
            lists = pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(lengths), pa.array(np.full(len(rows), part, np.int32)),
                    pa.array(before + ends - lengths), lists,
                ],
                ["doc_id", "n_tokens", "part", "before_in_part", "tokens"],
            )
            before += int(lengths.sum())

    placed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    # The digest and a spread part rows with one id, or none, over many tasks.
    placed = placed.withColumn("spread", F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16)))
    order = ["doc_id", "digest", "spread"]
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    options = {
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.page.row.count.limit": page_rows,
        "parquet.writer.version": "v2",
        "parquet.enable.dictionary": "true",
        **{f"parquet.enable.dictionary#{name}": "false" for name in ("doc_id", "n_tokens", "before_in_part")},
        "compression": "zstd",
    }
    placed.mapInArrow(encode, SCHEMA).write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str, with_tokens: bool = True) -> DataFrame:
    """Documents of the files with ``start``, the ids of all documents before them.

    Without tokens, only the numbers are read.  A filter on doc_id reaches the
    row groups and pages.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    # A row per part, and parts follow the order of the documents.
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("_ids"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("_ids").over(earlier), F.lit(0)).alias("_start"))
    # Every part has a start; the left join adds no test of its own to what reaches the files.
    rows = files.join(F.broadcast(starts), "part", "left")
    columns = ["doc_id", (F.col("_start") + F.col("before_in_part")).alias("start"), "n_tokens"]
    return rows.select(*columns, *(["tokens"] if with_tokens else []))


def digests(tokens: DataFrame) -> DataFrame:
    """The rows of ``read_tokens`` with the CRC-32 of the ids read in place of the ids."""

    def run(batches):
        for batch in batches:
            lists = batch.column("tokens")
            flat = lists.flatten().to_numpy().astype(np.uint32)
            ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
            sums = [crc32_of_ids(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), pa.array(np.diff(ends)), pa.array(sums, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
