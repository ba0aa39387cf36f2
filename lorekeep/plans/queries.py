"""Every operator as a named query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.colors import score_color
from lorekeep.functions.porter import with_stem
from lorekeep.functions.text import strip_html
from lorekeep.functions.urls import document_url
from lorekeep.operators import access, analysis, highlight, index, ingest, metadata, reply, search
from lorekeep.operators.joins import written
from lorekeep.plans import answer, build, versions
from lorekeep.plans.directory import Directory, publish_directory
from lorekeep.sources.shared import new_table_path
from lorekeep.sources.tables import BASE_URL, BOT, Tables
from lorekeep.streaming.library import DROP_SCHEMA, read_drops, start_ingest
from lorekeep.streaming.replies import read_events, start_replies

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_LIBRARIES: dict[tuple[str, str], build.Library] = {}


def query(name: str):
    """Register a query; it is handed the tables of the folder."""

    def register(run: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: run(Tables(spark, folder))
        return run

    return register


# ---------------------------------------------------------------- shared parts


def corpus(t: Tables) -> DataFrame:
    """Every document with the title its file name gives it."""
    return t["wiki_files"].select(
        "doc_id", ingest.title_from_path(F.col("path")).alias("title"), F.col("text").alias("content")
    )


def files_with_html(t: Tables) -> DataFrame:
    """Files with their markup: the page of the same number, or the text."""
    pages = t["pages"].select(F.col("page_id").alias("doc_id"), "html")
    return t["wiki_files"].join(pages, "doc_id", "left").withColumn("html", F.coalesce("html", "text"))


def documents(t: Tables) -> DataFrame:
    accepted, _ = build.documents_of(files_with_html(t), t["commits"], keep=["doc_id"])
    return accepted


def library(t: Tables) -> build.Library:
    """Index over all documents and the store of the accepted ones.

    Built once per application and folder, in the session's shared folder; the
    searches that follow read it, as they would in use.  The index covers every
    document, so the few hits that the store lacks show how results drop them.
    """
    place = (t.spark.sparkContext.applicationId, t.folder)
    if place not in _LIBRARIES:
        path = new_table_path(t.spark, "library")
        stored = build.write_documents(documents(t), f"{path}/documents")
        _LIBRARIES[place] = build.Library(index.build_index(corpus(t), f"{path}/index", "doc_id"), stored)
    return _LIBRARIES[place]


def epoch(column: str):
    """An instant as microseconds, equal in every session zone."""
    return F.unix_micros(F.col(column)).alias(column)


def paged_queries(t: Tables, name: str = "queries") -> DataFrame:
    return t[name].withColumn("page", F.col("query_id") % 3)


def results(t: Tables, queries: DataFrame) -> DataFrame:
    return answer.find(queries, library(t), BASE_URL)


def first_pages(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """First page of each query, its terms, and the texts shown."""
    queries = t["queries"]
    texts = t["documents"].select("doc_id", F.col("text").alias("content"))
    return search.search(queries, library(t).index), search.query_terms(queries), texts


# ---------------------------------------------------------------------- ingest


@query("scan_docs")
def _(t):
    return ingest.scan_documents(t["wiki_files"]).select("doc_id", "path")


@query("filter_hidden")
def _(t):
    return ingest.filter_hidden(t["wiki_files"]).select("doc_id", "path")


@query("relative_path")
def _(t):
    root = F.when(F.col("lang") == "en", "/srv/wiki/").otherwise("/srv/wiki-old/")
    full = t["wiki_files"].withColumn("full", F.concat(root, "path"))
    return full.select("doc_id", ingest.relative_path(F.col("full"), F.lit("/srv/wiki")).alias("path"))


@query("resolve_stems")
def _(t):
    return build.source_files(t["wiki_files"]).select("doc_id", "path", "stem")


@query("source_format")
def _(t):
    path = F.col("path")
    return t["wiki_files"].select(
        "doc_id",
        ingest.source_format(path).alias("format"),
        ingest.source_format(path, always_default=True).alias("compat_format"),
    )


@query("html_to_text")
def _(t):
    return ingest.html_to_text(t["pages"]).select("page_id", "plain")


@query("page_toc")
def _(t):
    return ingest.page_contents(t["pages"])


@query("last_change")
def _(t):
    return metadata.last_change(t["commits"])


@query("parse_commit_line")
def _(t):
    return metadata.parse_commit_lines(t["commit_lines"]).drop("path", "line")


@query("decode_metadata")
def _(t):
    valid, _ = metadata.decode_metadata(build.metadata_records(t["commits"]))
    return valid.select("path", "updated", "author_name", "author_email")


@query("metadata_rejects")
def _(t):
    _, rejects = metadata.decode_metadata(build.metadata_records(t["commits"]))
    return rejects.select("path", "reason")


@query("assemble_documents")
def _(t):
    return documents(t).withColumn("updated_on", epoch("updated_on"))


@query("document_id")
def _(t):
    return t["wiki_files"].select("doc_id", ingest.document_id(F.col("path")).alias("id"))


@query("title_from_path")
def _(t):
    return t["wiki_files"].select("doc_id", ingest.title_from_path(F.col("path")).alias("title"))


@query("documents_json")
def _(t):
    written = documents(t).withColumn("updated_on", epoch("updated_on").cast("string"))
    lines = ingest.to_json_lines(written)
    back = ingest.from_json_lines(lines).select("id", "title", "updated_on", F.sha1("content").alias("content_digest"))
    return lines.join(back, "id")


@query("parse_updated_on")
def _(t):
    parsed = ingest.parse_updated_on(F.col("written"))
    return t["date_texts"].select("event_id", F.unix_micros(parsed).alias("updated_on"))


@query("changed_documents")
def _(t):
    digest = ingest.content_hash(F.col("text")).alias("hash")
    return ingest.changed_documents(
        build.source_files(t["wiki_files"]).select("path", digest), t["previous_texts"].select("path", digest)
    )


@query("removed_documents")
def _(t):
    return ingest.removed_documents(build.source_files(t["wiki_files"]), t["previous_texts"])


@query("upsert_documents")
def _(t):
    identity = ingest.document_id(F.col("path")).alias("id")
    stored = t["wiki_files"].select(
        identity, F.col("text").alias("content"), F.lit("import").alias("updated_by"), F.lit(-1).cast("long").alias("version")
    )
    writes = t["commits"].filter(F.col("author_email").isNotNull()).select(
        identity,
        F.concat("path", F.lit(" as of "), F.col("seq").cast("string")).alias("content"),
        F.col("author_name").alias("updated_by"),
        F.col("seq").alias("version"),
    )
    return ingest.upsert(stored, writes)


def _fresh_library(t: Tables) -> build.Library:
    return build.build_library(files_with_html(t), t["commits"], new_table_path(t.spark, "rebuilt"))


@query("rebuild_index")
def _(t):
    built = _fresh_library(t).index
    vocabulary = built.terms.groupBy("field").agg(F.count("*").alias("n_vocabulary"))
    return built.fields.join(vocabulary, "field").withColumn("avgdl", F.round("avgdl", 6))


def library_facts(kept: build.Library, manifest: DataFrame) -> DataFrame:
    """Documents, manifest and field statistics of a library as rows of one table."""
    fields = kept.index.fields.select("field", "n_docs", F.col("n_terms").cast("long").alias("n_terms"), "n_postings")
    facts = kept.documents.select(
        F.lit("document").alias("fact"), "id", F.sha1("content").alias("digest"), F.lit(0).cast("long").alias("n")
    )
    facts = facts.union(manifest.select(F.lit("manifest"), "id", F.sha1("path"), F.lit(0).cast("long")))
    for name in ("n_docs", "n_terms", "n_postings"):
        facts = facts.union(fields.select(F.lit(name), "field", F.lit(""), name))
    return facts


def as_draft(files: DataFrame) -> DataFrame:
    german = F.col("lang") == "de"
    return files.withColumn("text", F.when(german, F.concat("text", F.lit(" (draft)"))).otherwise(F.col("text")))


@query("incremental_build")
def _(t):
    """What a library holds after a first build and two rounds of edits.

    First without Spanish and with German drafts, then with all files and the
    German ones as they are, then without the files in French.
    """
    files, place = files_with_html(t), new_table_path(t.spark, "library")
    for state in (as_draft(files.filter("lang <> 'es'")), files, files.filter("lang <> 'fr'")):
        build.update_library(state, t["commits"], place)
    return library_facts(*build.open_library(t.spark, place))


@query("stream_library")
def _(t):
    """The same through a stream of drops, the last of them run a second time.

    First without Spanish, with German drafts and half of the commits, then the
    Spanish and German files and the other commits, then the French ones removed.
    """
    files, place = files_with_html(t), new_table_path(t.spark, "stream-library")

    def drop(name: str, *parts: DataFrame) -> None:
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part, allowMissingColumns=True)
        columns = [f.split()[0] for f in DROP_SCHEMA.split(", ")]
        kinds = dict(f.split() for f in DROP_SCHEMA.split(", "))
        rows = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in columns])
        rows.write.mode("append").parquet(f"{place}/drops")
        for _ in range(1 + (name == "last")):
            start_ingest(read_drops(t.spark, f"{place}/drops"), f"{place}/library", "drops", f"{place}/state").awaitTermination()
        # Nobody writes or reads now, so segments that were merged can go.
        versions.keep_last(t.spark, f"{place}/library", 1)

    def as_files(rows: DataFrame, seq: int) -> DataFrame:
        return rows.select(F.lit("file").alias("kind"), "path", F.lit(seq).cast("long").alias("seq"), "text", "html")

    commits = t["commits"].withColumn("kind", F.lit("commit")).withColumn("authored_at", F.col("authored_at").cast("string"))
    drop("first", as_files(as_draft(files.filter("lang <> 'es'")), 1), commits.filter("seq % 2 = 0"))
    drop("second", as_files(files.filter("lang IN ('es', 'de')"), 2), commits.filter("seq % 2 = 1"))
    removed = files.filter("lang = 'fr'").select(F.lit("removed").alias("kind"), "path", F.lit(3).cast("long").alias("seq"))
    drop("last", removed)
    return library_facts(*build.open_library(t.spark, f"{place}/library"))


@query("clear_index")
def _(t):
    built = _fresh_library(t).index

    def counts():
        named = {"postings": built.postings, "terms": built.terms, "fields": built.fields}
        rows = [df.agg(F.count("*").alias("n_rows")).withColumn("table_name", F.lit(n)) for n, df in named.items()]
        return rows[0].unionByName(rows[1]).unionByName(rows[2])

    before = new_table_path(t.spark, "counts")
    counts().write.parquet(before)
    index.clear_index(built)
    after = counts()
    return t.spark.read.parquet(before).withColumnRenamed("n_rows", "rows_before").join(
        after.withColumnRenamed("n_rows", "rows_after"), "table_name"
    )


@query("index_rejects")
def _(t):
    valid, _ = build.file_metadata(t["commits"])
    dated = t["wiki_files"].join(valid, "path", "left").select(
        ingest.document_id(F.col("path")).alias("id"),
        F.when(F.col("lang") != "es", F.col("text")).alias("content"),
        F.col("updated").alias("updated_on"),
    )
    _, rejects = ingest.split_rejects(dated)
    return rejects.select("id", "reason")


# -------------------------------------------------------------------- analysis


@query("html_strip")
def _(t):
    return t["pages"].select("page_id", strip_html(F.col("html")).alias("stripped"))


@query("tokenize")
def _(t):
    return analysis.word_counts(t["documents"], "text")


@query("tokenize_pages")
def _(t):
    return analysis.word_counts(t["pages"].select(strip_html(F.col("html")).alias("text")), "text")


@query("stem_vocabulary")
def _(t):
    return with_stem(analysis.word_counts(t["documents"], "text"), "token", "term").select("token", "term")


def corpus_terms(t: Tables) -> DataFrame:
    """Terms of every document, counted in tasks of a bounded share of the text."""
    rows, size = t["wiki_files"].agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    tasks = index.bucket_count(rows, t.spark.sparkContext.defaultParallelism, size or 0)
    return analysis.term_counts(corpus(t), "doc_id", partitions=tasks)


@query("analyze_content")
def _(t):
    return corpus_terms(t).filter("field = 'content'").select("doc_id", "term", "tf")


@query("analyze_title")
def _(t):
    return corpus_terms(t).filter("field = 'title'").select("doc_id", "term", "tf")


# ----------------------------------------------------------------------- index


@query("postings")
def _(t):
    return library(t).index.postings.select("field", "term", "doc_id", "tf", "dl")


@query("doc_lengths")
def _(t):
    return library(t).index.lengths


@query("corpus_stats")
def _(t):
    built = library(t).index
    fields = built.fields.select("field", "n_docs", F.round("avgdl", 6).alias("avgdl"))
    return built.terms.select("field", "term", "df", "cf").join(F.broadcast(fields), "field")


@query("update_index")
def _(t):
    changed = t["revised_texts"].select(
        "doc_id", ingest.title_from_path(F.col("path")).alias("title"), F.col("text").alias("content")
    )
    updated = index.update_index(library(t).index, changed, new_table_path(t.spark, "updated"))
    fields = updated.fields.select("field", "n_docs", F.round("avgdl", 6).alias("avgdl"))
    return updated.terms.join(F.broadcast(fields), "field")


# ---------------------------------------------------------------------- search


@query("query_terms")
def _(t):
    return search.query_terms(t["queries"])


@query("match_docs")
def _(t):
    return search.match_documents(t["queries"], library(t).index)


@query("bm25_scores")
def _(t):
    return search.field_scores(t["queries"], library(t).index)


@query("search_ranked")
def _(t):
    return search.ranked(t["queries"], library(t).index).select("query_id", "doc_id", "score")


@query("search_totals")
def _(t):
    return search.totals(t["name_queries"], library(t).index)


@query("search_page")
def _(t):
    page = F.col("query_id") % 4
    return search.search(t["queries"], library(t).index, page * 5, page + 3)


@query("highlight_terms")
def _(t):
    page, terms, texts = first_pages(t)
    return highlight.matched_words(page, terms, texts, "doc_id").withColumn("pos", F.col("pos").cast("long"))


@query("highlight")
def _(t):
    return highlight.fragments(*first_pages(t), "doc_id")


@query("highlight_markup")
def _(t):
    page, terms, texts = first_pages(t)
    return highlight.highlights(page, highlight.fragments(page, terms, texts, "doc_id"), "doc_id")


@query("document_url")
def _(t):
    return t["file_names"].select("doc_id", document_url(BASE_URL, F.col("file_name")).alias("url"))


@query("search_results")
def _(t):
    found = results(t, t["name_queries"].withColumn("page", F.lit(0)))
    return found.select("query_id", "rank", "id", "title", "url", "updated_by", epoch("updated_on"), "score", "total")


@query("search_highlights")
def _(t):
    queries = t["queries"].withColumn("page", F.lit(0))
    found = answer.with_highlights(results(t, queries), queries, library(t))
    return found.select("query_id", "rank", "id", "highlight")


@query("search_status")
def _(t):
    queries = t["odd_queries"]
    return search.search_status(queries, search.search(queries, library(t).index))


# ---------------------------------------------------------------------- access


@query("route_events")
def _(t):
    return t["chat_events"].withColumn("route", access.route(F.col("kind")))


@query("eligible_messages")
def _(t):
    return access.eligible(t["chat_messages"], BOT).select("message_id", "user_id", "subtype")


@query("is_dm")
def _(t):
    return t["chat_messages"].select("message_id", access.is_direct(F.col("channel_id")).alias("is_dm"))


@query("is_mentioned")
def _(t):
    return t["chat_messages"].select("message_id", access.is_mentioned(F.col("text"), BOT).alias("is_mentioned"))


@query("message_query_text")
def _(t):
    return t["chat_messages"].select("message_id", access.query_text(F.col("text")).alias("query_text"))


def rules(t: Tables) -> DataFrame:
    return access.parse_rules(t["rule_list"])


@query("allow_rules")
def _(t):
    return rules(t)


@query("allowed_channels")
def _(t):
    return access.allowed_channels(rules(t), t["chat_channels"])


@query("allowed_members")
def _(t):
    return access.allowed_members(access.allowed_channels(rules(t), t["chat_channels"]), t["chat_members"])


@query("allowed_users")
def _(t):
    return access.allowed_users(rules(t), t["chat_users"])


def directory(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    return t["chat_users"], t["chat_channels"], t["chat_members"]


def everyone(t: Tables) -> DataFrame:
    return access.parse_rules(t.spark.range(1).select(F.lit("*").alias("rule")))


@query("authorized_messages")
def _(t):
    return access.authorise_messages(t["chat_messages"], rules(t), *directory(t), BOT)


@query("authorized_messages_everyone")
def _(t):
    return access.authorise_messages(t["chat_messages"], everyone(t), *directory(t), BOT)


@query("authorized_commands")
def _(t):
    decided = access.authorise_requests(t["commands"], rules(t), *directory(t), BOT)
    return access.refusals(decided).select("command_id", "allowed", "reply")


@query("authorized_buttons")
def _(t):
    decided = access.authorise_requests(t["button_events"], rules(t), *directory(t), BOT)
    return decided.filter("allowed").select("event_id", "user_id")


def actions():
    pair = lambda which: F.struct(F.col(f"{which}_name").alias("name"), F.col(f"{which}_value").alias("value"))
    return F.array(pair("first"), pair("second"))


@query("button_pages")
def _(t):
    page = reply.new_page_value(actions())
    return t["button_events"].select(
        "event_id", page.alias("page"), F.when(page.isNull(), F.lit(reply.CONFUSED)).alias("reply")
    )


# --------------------------------------------------------------------- replies


@query("reply_pages")
def _(t):
    queries = paged_queries(t)
    page = search.search(queries, library(t).index, 0, reply.shown_rows(F.col("page")))
    return page.join(queries.select("query_id", "page"), "query_id").select("query_id", "page", "rank", "doc_id", "total")


@query("reply_headers")
def _(t):
    totals = search.totals(t["name_queries"], library(t).index)
    text = F.col("text")
    head = F.when(F.col("total").isNull(), reply.no_hit_header(text)).otherwise(reply.header(F.col("total"), text))
    user = F.when(F.col("query_id") % 2 == 0, F.concat(F.lit("U"), F.col("query_id").cast("string")))
    return t["name_queries"].join(totals, "query_id", "left").select(
        "query_id", reply.with_mention(user, head).alias("reply")
    )


@query("deep_page")
def _(t):
    """All hits of each query on one page."""
    queries = t["queries"].withColumn("page", F.lit(2500))
    return search.search(queries, library(t).index, 0, reply.shown_rows(F.col("page"))).drop("score")


@query("reply_attachments")
def _(t):
    return reply.result_rows(results(t, paged_queries(t)))


@query("reply_pager")
def _(t):
    queries = paged_queries(t)
    found = reply.pager(queries.join(reply.shown(results(t, queries)), "query_id"))
    return found.withColumn("buttons", F.to_json("buttons"))


@query("no_hit_links")
def _(t):
    queries = t["name_queries"].withColumn("page", F.lit(0))
    return reply.no_hits(queries, results(t, queries), BASE_URL)


@query("quote_query")
def _(t):
    return t["chat_messages"].select("message_id", reply.quote_query(F.col("text")).alias("quoted"))


@query("score_color")
def _(t):
    return t["events"].select("event_id", score_color(F.col("value") / 5).alias("color"))


def events(t: Tables) -> DataFrame:
    return t["chat_events"].select(
        "event_id", "kind", "channel_id", "ts", "user_id", "subtype", "text", actions().alias("actions")
    )


def answer_batch(t: Tables, batch: DataFrame, chat: answer.Chat | Directory | None = None) -> answer.Answers:
    return answer.answer_events(batch, chat or answer.Chat(rules(t), *directory(t), BOT), library(t), BASE_URL)


@query("message_replies")
def _(t):
    allowed = access.authorise_messages(t["chat_messages"], rules(t), *directory(t), BOT)
    asked = allowed.select(F.col("message_id").alias("query_id"), "text", F.lit(0).alias("page"), "user_id")
    heads = answer.answer_queries(written(asked), library(t), BASE_URL).heads
    return heads.withColumnRenamed("query_id", "message_id").withColumn("buttons", F.to_json("buttons"))


@query("event_replies")
def _(t):
    return answer_batch(t, events(t)).heads.withColumn("buttons", F.to_json("buttons"))


@query("event_reply_rows")
def _(t):
    return answer_batch(t, events(t)).rows


@query("stream_replies")
def _(t):
    """The same replies through a stream over files of events, some of them delivered twice.

    Each batch is decided by a published version of the directory.
    """
    place = new_table_path(t.spark, "stream")
    copies = F.array_repeat(F.lit(1), F.when(F.col("event_id") % 3 == 0, 2).otherwise(1))
    delivered, files = events(t).withColumn("copy", F.explode(copies)).drop("copy"), t.spark.sparkContext.defaultParallelism
    delivered.repartition(3 * files).write.parquet(f"{place}/in")
    stream = read_events(t.spark, f"{place}/in", files_per_batch=files)
    publish_directory(rules(t), *directory(t), BOT, f"{place}/directory")
    answered = lambda batch, version: answer_batch(t, batch, version)
    started = start_replies(stream, answered, f"{place}/out", f"{place}/state", directory=f"{place}/directory")
    started.awaitTermination()
    return t.spark.read.parquet(f"{place}/out/heads").drop("batch").withColumn("buttons", F.to_json("buttons"))
