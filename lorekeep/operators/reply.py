"""Search answers as chat replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.colors import score_color
from lorekeep.functions.urls import new_page_url
from lorekeep.operators.search import PAGE_SIZE, QUERY

FAILURE = "The search could not be run just now."
CONFUSED = "That button says nothing that can be acted on."
DEFAULT_COLOR = "default"


def shown_rows(page: Column) -> Column:
    """Pages grow: page 0 shows the first rows, page 1 those and the next."""
    return (page.cast("long") + 1) * PAGE_SIZE


def can_be_run(text: Column, page: Column) -> Column:
    """A query needs a text and a page that is no less than the one before the first."""
    return (F.trim(F.coalesce(text, F.lit(""))) != "") & (shown_rows(page) >= 0)


def quote_query(text: Column) -> Column:
    """The query in emphasis, without signs that would end it."""
    return F.concat(F.lit("_"), F.translate(text, "`*_\n", ""), F.lit("_"))


def header(total: Column, text: Column) -> Column:
    return F.concat(total.cast("string"), F.lit(" hits for "), quote_query(text))


def no_hit_header(text: Column) -> Column:
    return F.concat(F.lit("Nothing is known about "), quote_query(text))


def with_mention(user_id: Column, text: Column) -> Column:
    """Chat messages are answered to their author; commands and buttons are not."""
    return F.when(user_id.isNotNull(), F.concat(F.lit("<@"), user_id, F.lit("> "), text)).otherwise(text)


def new_page_value(actions: Column) -> Column:
    """Page asked for by the first action that says so; null when none does."""
    usable = F.filter(
        actions,
        lambda a: a["name"].isin("more", "less")
        & F.coalesce(a["value"].rlike(r"^-?[0-9]{1,18}$"), F.lit(False)),
    )
    pages = F.transform(
        usable,
        lambda a: a["value"].try_cast("bigint") + F.when(a["name"] == "more", F.lit(1)).otherwise(F.lit(-1)),
    )
    return F.try_element_at(pages, F.lit(1))


def result_rows(results: DataFrame) -> DataFrame:
    """The rows of a reply, each with title, link, footer, colour and time of the last change.

    They stay rows, however many a page asks for, and carry their rank.
    """
    return results.select(
        QUERY,
        "rank",
        "title",
        F.col("url").alias("link"),
        F.concat(F.lit("changed by "), F.col("updated_by")).alias("footer"),
        F.coalesce(score_color(F.col("score")), F.lit(DEFAULT_COLOR)).alias("color"),
        F.unix_seconds(F.col("updated_on").cast("timestamp")).alias("ts"),
    )


def shown(results: DataFrame) -> DataFrame:
    """How many hits and result rows each query has; none without a row."""
    return results.groupBy(QUERY).agg(F.first("total").alias("total"), F.count("*").alias("n_rows"))


def pager_text(page: Column, total: Column) -> Column:
    return F.concat(
        F.lit("Shown: "), shown_rows(page).cast("string"), F.lit(" of "), total.cast("string"), F.lit(" hits")
    )


def pager_buttons(page: Column, text: Column) -> Column:
    """The buttons under a reply: each brings back its page and the query."""

    def button(name: str) -> Column:
        return F.struct(F.lit(name).alias("name"), page.cast("string").alias("value"), text.alias("callback"))

    return F.when(page > 0, F.array(button("less"), button("more"))).otherwise(F.array(button("more")))


def pager(answers: DataFrame) -> DataFrame:
    """The row that offers more, left out once all hits are shown."""
    page, total = F.col("page"), F.col("total")
    return answers.filter(F.col("n_rows") < total).select(
        QUERY, "page", pager_text(page, total).alias("pager"), pager_buttons(page, F.col("text")).alias("buttons")
    )


def no_hits(queries: DataFrame, results: DataFrame, base: str) -> DataFrame:
    """Queries without any result row, with a link to start a new document."""
    return queries.join(results.select(QUERY).distinct(), QUERY, "left_anti").select(
        QUERY, no_hit_header(F.col("text")).alias("reply"), new_page_url(base, F.col("text")).alias("link")
    )


def replies(queries: DataFrame, results: DataFrame, base: str) -> DataFrame:
    """The head of the reply to each query row (query_id, text, page, user_id).

    Its result rows are those of ``result_rows``, of which it has ``n_rows``.
    """
    return heads(queries, shown(results), base)


def heads(queries: DataFrame, counts: DataFrame, base: str) -> DataFrame:
    """The same from what is ``shown`` of each query."""
    joined = queries.join(counts, QUERY, "left")
    text, page, total = F.col("text"), F.col("page"), F.col("total")
    failed = ~can_be_run(text, page)
    empty = F.col("n_rows").isNull()
    has_more = F.col("n_rows") < total
    user = F.col("user_id")
    return joined.select(
        QUERY,
        F.when(failed, F.lit(FAILURE))
        .when(empty, with_mention(user, no_hit_header(text)))
        .otherwise(with_mention(user, header(total, text))).alias("reply"),
        F.when(~failed, F.coalesce("n_rows", F.lit(0))).alias("n_rows"),
        F.when(~failed & has_more, pager_text(page, total)).alias("pager"),
        F.when(~failed & has_more, pager_buttons(page, text)).alias("buttons"),
        F.when(~failed & empty, new_page_url(base, text)).alias("new_page"),
    )
