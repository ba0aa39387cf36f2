"""Passages of hit documents with the matched words marked.

A shown document is an array of its words.  The distinct words of all shown
documents are stemmed once, and those whose stem is asked for make up, for each
query, the words it looks for.  Everything else is done on the arrays in place:
where these words are, which of their surroundings overlap, and the slices that
are shown.  No word is moved by its position, and no group is larger than one
document's own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.porter import with_stem
from lorekeep.functions.text import strip_html, tokens
from lorekeep.operators.joins import broadcast_if_small, written
from lorekeep.operators.search import QUERY

# Defaults: words shown on either side of a hit, and passages shown.
REACH = 6
FRAGMENTS = 5
OPEN_TAG = "<em>"
CLOSE_TAG = "</em>"


def _shown_words(page: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Words of the documents on any page as an array, each document once.

    Only those few texts are shuffled, so that their analysis is spread evenly.
    """
    shown = broadcast_if_small(written(page.select(key).distinct()))
    texts = documents.select(key, "content").join(shown, key, "left_semi").repartition(key)
    return written(texts.select(key, tokens(strip_html(F.col("content"))).alias("words")))


def _hits(page: DataFrame, terms: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Each row of a page with its document's words, those looked for, and where they are.

    ``wanted`` maps lower-case words to the terms of the query; stop words are
    never among them because no query term is one.
    """
    page = written(page.select(QUERY, key))
    words = _shown_words(page, documents, key)
    asked = written(terms.filter(F.col("field") == "content").select(QUERY, "term").distinct())
    lower = words.select(F.explode(F.array_distinct(F.transform("words", F.lower))).alias("token")).distinct()
    few = broadcast_if_small(asked.select("term").distinct())
    known = written(with_stem(lower, "token", "term").join(few, "term", "left_semi"))
    wanted = asked.join(broadcast_if_small(known), "term").groupBy(QUERY)
    wanted = written(wanted.agg(F.map_from_entries(F.collect_set(F.struct("token", "term"))).alias("wanted")))
    rows = page.join(broadcast_if_small(wanted), QUERY).join(words, key)
    places = F.transform("words", lambda w, i: F.when(F.map_contains_key(F.col("wanted"), F.lower(w)), i))
    return rows.withColumn("hits", F.filter(places, lambda i: i.isNotNull()))


def matched_words(page: DataFrame, terms: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Where a page's documents hold a content term of their query."""
    rows = _hits(page, terms, documents, key).select(QUERY, key, "words", "wanted", F.explode("hits").alias("pos"))
    word = F.get("words", F.col("pos"))
    return rows.select(QUERY, key, "pos", word.alias("word"), F.element_at("wanted", F.lower(word)).alias("term"))


def fragments(
    page: DataFrame, terms: DataFrame, documents: DataFrame, key: str, passages: int | None = FRAGMENTS, reach: int = REACH
) -> DataFrame:
    """First passages around the hits (all for ``None``), overlapping ones merged, in their order."""
    rows = _hits(page, terms, documents, key).filter(F.size("hits") > 0)

    def apart(i: Column, j: Column) -> Column:
        return F.get("hits", j) - F.get("hits", i) > 2 * reach

    first = F.filter("hits", lambda h, i: (i == 0) | apart(i - 1, i))
    last = F.filter("hits", lambda h, i: (i == F.size("hits") - 1) | apart(i, i + 1))
    spans = F.zip_with(first, last, lambda low, high: F.struct(low.alias("low"), high.alias("high")))
    spans = spans if passages is None else F.slice(spans, 1, passages)
    rows = rows.select(QUERY, key, "words", "wanted", F.posexplode(spans).alias("n", "span"))
    low = F.greatest(F.col("span.low") - reach, F.lit(0))
    shown = F.slice("words", low + 1, F.col("span.high") + reach - low + 1)
    marked = F.transform(
        shown, lambda w: F.when(F.map_contains_key(F.col("wanted"), F.lower(w)), F.concat(F.lit(OPEN_TAG), w, F.lit(CLOSE_TAG))).otherwise(w)
    )
    return rows.select(QUERY, key, (F.col("n") + 1).cast("long").alias("fragment"), F.array_join(marked, " ").alias("passage"))


def to_markup(passage: Column) -> Column:
    """Highlight tags as the chat's own emphasis."""
    return F.replace(F.replace(passage, F.lit(OPEN_TAG), F.lit("*")), F.lit(CLOSE_TAG), F.lit("*"))


def highlights(page: DataFrame, passages: DataFrame, key: str) -> DataFrame:
    """One text per hit, a line for each passage; null without content match."""
    lines = passages.groupBy(QUERY, key).agg(
        F.array_sort(F.collect_list(F.struct("fragment", to_markup(F.col("passage")).alias("line")))).alias("ls")
    )
    text = F.concat(F.array_join(F.col("ls.line"), "\n"), F.lit("\n"))
    return page.select(QUERY, key).join(lines, [QUERY, key], "left").select(QUERY, key, text.alias("highlight"))
