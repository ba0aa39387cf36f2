"""Field analyzers as DataFrame jobs.

``content`` goes through markup stripping, word splitting, lower case, stemming
and stop-word removal in that order; ``title`` only through word splitting,
lower case and stemming.  Because stop words go after stemming, a stop word
whose stem differs from it ("this", "was", "they") is kept.

Each of these jobs takes rows with a unique key.  They are hash-partitioned by
that key once, as text; from there on the aggregates and windows of the key all
find their rows in place, and nothing larger than one row's own text is ever
grouped together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.porter import with_stem
from lorekeep.functions.text import STOP_WORDS, strip_html, tokens


def content_tokens(content: Column) -> Column:
    return tokens(F.lower(strip_html(content)))


def title_tokens(title: Column) -> Column:
    return tokens(F.lower(title))


def _surface(rows: DataFrame, key: list[str], title: Column, content: Column) -> DataFrame:
    """One row per key, field and distinct word, with its count ``n``."""
    fields = F.explode(
        F.array(
            F.struct(F.lit("title").alias("field"), title_tokens(title).alias("words")),
            F.struct(F.lit("content").alias("field"), content_tokens(content).alias("words")),
        )
    )
    return (
        rows.select(*key, fields.alias("f"))
        .select(*key, "f.field", F.explode("f.words").alias("token"))
        .groupBy(*key, "field", "token")
        .agg(F.count("*").alias("n"))
    )


def _is_indexed() -> Column:
    return (F.col("field") != "content") | ~F.col("term").isin(STOP_WORDS)


def term_counts(
    rows: DataFrame,
    key: str | list[str],
    title: str = "title",
    content: str = "content",
    place_by: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Analysed terms: key, field, term, tf.

    Rows are placed by their key, or by the one column of it named in
    ``place_by``.  Counting words before stemming halves the rows to be stemmed.
    """
    key = [key] if isinstance(key, str) else key
    columns = [place_by] if place_by else key
    placed = rows.repartition(partitions, *columns) if partitions else rows.repartition(*columns)
    return (
        with_stem(_surface(placed, key, F.col(title), F.col(content)), "token", "term")
        .filter(_is_indexed())
        .groupBy(*key, "field", "term")
        .agg(F.sum("n").alias("tf"))
    )


def with_field_length(counts: DataFrame, key: list[str]) -> DataFrame:
    """Add ``dl``, the terms of the field, and mark one row per key and field."""
    field = Window.partitionBy(*key, "field")
    return counts.withColumn("dl", F.sum("tf").over(field)).withColumn(
        "first_of_field", F.col("term") == F.min("term").over(field)
    )


def word_counts(rows: DataFrame, text: str) -> DataFrame:
    """How often each lower-case word occurs in a column of texts."""
    return (
        rows.select(F.explode(tokens(F.lower(F.col(text)))).alias("token"))
        .groupBy("token").agg(F.count("*").alias("n"))
    )
