"""Document files read from a folder tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators.ingest import SUPPORTED_EXTENSIONS, is_hidden, relative_path


def read_document_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every supported, visible file below ``folder``: path, text, length, reason.

    A file that is not valid UTF-8 has no text and a reason, for the reject
    tables; it does not stop the others.
    The listing runs on the cluster; the content column is only read when a
    later step asks for it.  Spark's own listing keeps names such as ``_k=v``,
    so hidden components are filtered here as well.
    """
    pattern = "*.{" + ",".join(SUPPORTED_EXTENSIONS) + "}"
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(folder)
    )
    root = F.regexp_replace(F.lit(folder), "^[a-z0-9]+:/*(?=/)|/+$", "")
    path = relative_path(F.regexp_replace("path", "^[a-z0-9]+:/*(?=/)", ""), root)
    return (
        files.withColumn("path", path)
        .filter(~is_hidden(F.col("path")))
        .select(
            "path",
            F.try_validate_utf8(F.col("content").cast("string")).alias("text"),
            "length",
            "modificationTime",
            F.when(~F.is_valid_utf8(F.col("content").cast("string")), "not UTF-8").alias("reason"),
        )
    )
