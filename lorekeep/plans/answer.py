"""From chat events and questions to replies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.urls import document_url
from lorekeep.operators import access
from lorekeep.operators.highlight import FRAGMENTS, fragments, highlights
from lorekeep.operators.joins import broadcast_if_small, written
from lorekeep.operators.reply import CONFUSED, can_be_run, heads, new_page_value, result_rows, shown_rows
from lorekeep.operators.search import QUERY, query_terms, search, search_results
from lorekeep.plans.build import Library
from lorekeep.plans.directory import Directory


@dataclass(frozen=True)
class Chat:
    """Whom the bot knows and whom it answers; ``bot`` is its own user id."""

    rules: DataFrame
    users: DataFrame
    channels: DataFrame
    members: DataFrame
    bot: str

    def decide(self, events: DataFrame) -> DataFrame:
        return access.decide(events, self.rules, self.users, self.channels, self.members, self.bot)


def find(queries: DataFrame, library: Library, base: str, highlighted: bool = False) -> DataFrame:
    """Result rows of queries (query_id, text, page), the page cumulative; on request with their ``highlight``."""
    runnable = queries.filter(can_be_run(F.col("text"), F.col("page")))
    page = search(runnable, library.index, 0, shown_rows(F.col("page")))
    url = document_url(base, F.col("file_name"))
    found = search_results(page, library.documents, library.index.key, url)
    return with_highlights(written(found), runnable, library) if highlighted else found


def with_highlights(results: DataFrame, queries: DataFrame, library: Library, passages: int | None = FRAGMENTS) -> DataFrame:
    """Result rows with ``highlight``: the passages of each document that match its query."""
    key = library.index.key
    page = written(results.select(QUERY, key))
    found = fragments(page, query_terms(queries), library.documents, key, passages)
    return results.join(highlights(page, found, key), [QUERY, key], "left")


def find_shared(
    queries: DataFrame, library: Library, base: str, highlighted: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The same, ranking each distinct text once for all who ask for it.

    A text is ranked down to the last row anyone wants of it; a text asked for
    by very many thus costs one search and a join of its page.  Given are the
    queries that can be run (query_id, text_id, page) and the rows of the texts
    (text_id and those of ``find``), of which each shows the first of its page.
    """
    runnable = queries.filter(can_be_run(F.col("text"), F.col("page")))
    # Texts are named by their digest, so only that meets the askers.
    digest = F.sha2("text", 256).alias("digest")
    distinct = runnable.groupBy(digest).agg(F.first("text").alias("text"), F.max("page").alias("page"))
    # The ids are fixed by being written before anything reads them.
    texts = written(distinct.withColumn(QUERY, F.monotonically_increasing_id()))
    found = written(find(texts, library, base, highlighted)).withColumnRenamed(QUERY, "text_id")
    named = broadcast_if_small(texts.select("digest", F.col(QUERY).alias("text_id")))
    return runnable.select(QUERY, digest, "page").join(named, "digest").drop("digest"), found


def _of_askers(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of texts, each as often as its page is asked for."""
    shown_to = asked.join(broadcast_if_small(rows), "text_id").filter(F.col("rank") <= shown_rows(F.col("page")))
    return shown_to.drop("text_id", "page")


def _counts(asked: DataFrame, found: DataFrame) -> DataFrame:
    """What ``shown`` says of each query, counted once for each text and page."""
    pages = written(asked.select("text_id", "page").distinct())
    ranks = found.select("text_id", "rank", "total").join(broadcast_if_small(pages), "text_id")
    counts = ranks.filter(F.col("rank") <= shown_rows(F.col("page"))).groupBy("text_id", "page").agg(
        F.first("total").alias("total"), F.count("*").alias("n_rows")
    )
    met = asked.join(broadcast_if_small(written(counts)), ["text_id", "page"])
    return met.groupBy(QUERY).agg(F.first("total").alias("total"), F.sum("n_rows").alias("n_rows"))


@dataclass(frozen=True)
class Answers:
    """Heads of replies and, apart from them, their result rows."""

    heads: DataFrame
    rows: DataFrame


def answer_queries(queries: DataFrame, library: Library, base: str, highlighted: bool = False) -> Answers:
    """Replies to queries (query_id, text, page, user_id); on request, result rows carry their ``highlight``."""
    asked, found = find_shared(queries, library, base, highlighted)
    rows = result_rows(found.withColumnRenamed("text_id", QUERY)).withColumnRenamed(QUERY, "text_id")
    if highlighted:
        rows = rows.join(found.select("text_id", "rank", "highlight"), ["text_id", "rank"])
    rows = _of_askers(asked, rows)
    return Answers(heads(queries, _counts(asked, found), base), rows.select(QUERY, *[c for c in rows.columns if c != QUERY]))


def answer_events(events: DataFrame, chat: Chat | Directory, library: Library, base: str) -> Answers:
    """Replies to chat events (event_id, kind, channel_id, ts, user_id, subtype, text, actions).

    The text of a button press is the query it was shown for, its actions say
    which page is wanted.  A refused command is told so; other events that may
    not be answered get no reply.  A reply goes to the channel of its event and
    carries the event's time stamp.
    """
    routed = events.withColumn("route", access.route(F.col("kind"))).filter("route <> 'ignore'")
    decided = written(chat.decide(routed))
    route = F.col("route")
    asked = decided.filter("allowed").select(
        F.col("event_id").alias(QUERY),
        F.when(route == "message", access.query_text(F.col("text"))).otherwise(F.col("text")).alias("text"),
        F.when(route == "button", new_page_value(F.col("actions"))).otherwise(F.lit(0)).alias("page"),
        F.when(route == "message", F.col("user_id")).alias("user_id"),
    )
    queries = written(asked)
    answered = answer_queries(queries.filter("page is not null"), library, base)
    confused = queries.filter("page is null").select(QUERY, F.lit(CONFUSED).alias("reply"))
    refused = decided.filter("not allowed and route = 'command'").select(
        F.col("event_id").alias(QUERY), F.lit(access.REFUSAL).alias("reply")
    )
    told = answered.heads.unionByName(confused.unionByName(refused), allowMissingColumns=True)
    placed = told.withColumnRenamed(QUERY, "event_id").join(decided.select("event_id", "channel_id", "ts"), "event_id")
    return Answers(placed, answered.rows.withColumnRenamed(QUERY, "event_id"))
