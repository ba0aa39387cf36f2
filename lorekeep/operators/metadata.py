"""Latest change of each file, from commit records or from log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METADATA_SCHEMA = "updated string, author_name string, author_email string"


def last_change(commits: DataFrame) -> DataFrame:
    """Newest commit of each path in commit order, not in author time.

    ``max_by`` combines before the shuffle, so a file with very many commits
    sends one record per task.
    """
    record = F.struct(F.col("authored_at").alias("updated"), "author_name", "author_email", "seq")
    return commits.groupBy("path").agg(F.max_by(record, "seq").alias("r")).select("path", "r.*")


def parse_commit_lines(lines: DataFrame) -> DataFrame:
    """Tab-separated log lines; a line without exactly three parts has no record."""
    parts = F.split(F.regexp_replace("line", r"\n$", ""), "\t")
    fits = F.size(parts) == 3
    return lines.select(
        "*", *[F.when(fits, parts[i]).alias(name) for i, name in enumerate(["updated", "author_name", "author_email"])]
    )


def decode_metadata(records: DataFrame, column: str = "json") -> tuple[DataFrame, DataFrame]:
    """JSON records with all three keys, and the others with the reason."""
    decoded = records.withColumn("m", F.from_json(column, METADATA_SCHEMA))
    missing = F.array_join(
        F.filter(
            F.array(*[F.when(F.col(f"m.{key}").isNull(), F.lit(key)) for key in ["updated", "author_name", "author_email"]]),
            lambda key: key.isNotNull(),
        ),
        ",",
    )
    marked = decoded.withColumn("missing", F.coalesce(missing, F.lit("updated,author_name,author_email")))
    valid = marked.filter(F.col("missing") == "").select(*records.columns, "m.*")
    rejects = marked.filter(F.col("missing") != "").select(
        *records.columns, F.concat(F.lit("missing: "), "missing").alias("reason")
    )
    return valid, rejects


def require_metadata(records: DataFrame, column: str = "json") -> DataFrame:
    """The strict form: any record that does not decode stops the job."""
    decoded = F.from_json(column, METADATA_SCHEMA)
    whole = decoded.getField("updated").isNotNull() & decoded.getField("author_name").isNotNull() & decoded.getField(
        "author_email"
    ).isNotNull()
    checked = F.when(whole, decoded).otherwise(
        F.raise_error(F.concat(F.lit("undecodable metadata: "), F.coalesce(F.col(column), F.lit("null"))))
    )
    return records.withColumn("m", checked).select(*records.columns, "m.*")
