"""Ranked search of many queries at once over a written index.

The plan for a table of queries: analyse the texts, look up the statistics of
their terms, meet the postings of those terms bucket by bucket, add up BM25 per
document, keep the best field, and number the hits of each query.  Postings are
bucketed by shards of documents, so all of that happens in place, segment by
segment; only each shard's best rows are shuffled, to be ranked against those of
other shards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators.analysis import term_counts
from lorekeep.operators.dense import best_hits
from lorekeep.operators.index import Index, bucket_count
from lorekeep.operators.joins import MAX_BROADCAST_BYTES, broadcast_if_small, is_small, written
from lorekeep.operators.segments import all_of

# Ranking constants of the reference behaviour.
K1 = 1.2
B = 0.75
TITLE_BOOST = 3.0
PAGE_SIZE = 5

#: Ranges of terms that a scan is told, at most.
MAX_PUSHED_TERMS = 500
#: Ranges of terms that postings are tested for in a search, at most.  Each posting
#: meets the tests, and the code of many is too long to be compiled.
SCANNED_RANGES = 16
#: Postings that the queries of a batch meet together, up to which each becomes a row.
MAX_JOINED_POSTINGS = 100_000_000
#: Groups of shards whose best rows are ranked together before all of them are.
SHARD_GROUPS = 64
QUERY = "query_id"


def _any_of(tests: list[Column]) -> Column:
    """The tests joined by "or" as a balanced tree."""
    half = len(tests) // 2
    return tests[0] if len(tests) == 1 else _any_of(tests[:half]) | _any_of(tests[half:])


def term_ranges(
    terms: DataFrame, heavy_terms: Callable[[], list[str]], most: int | None = None
) -> list[tuple[str, str]]:
    """Ranges of terms that hold all of the given ones, ``most`` (MAX_PUSHED_TERMS) of them at most.

    Up to so many terms are a range each.  Of more, those between two heavy terms
    that are not asked for make one range, from their first to their last, so
    however many are asked for, the longest runs of other postings are left out.
    """
    most = MAX_PUSHED_TERMS if most is None else min(most, MAX_PUSHED_TERMS)
    terms = terms.select("term").distinct()
    few = [row[0] for row in terms.limit(most + 1).collect()]
    if len(few) <= most:
        return [(term, term) for term in sorted(few)]
    heavy = heavy_terms()
    asked = {r[0] for r in terms.filter(F.col("term").isin(heavy)).collect()} if heavy else set()
    holes = sorted([term for term in heavy if term not in asked][: most - 1])
    before = F.size(F.filter(F.array(*[F.lit(h) for h in holes]), lambda h: h < F.col("term"))) if holes else F.lit(0)
    ranges = terms.groupBy(before.alias("at")).agg(F.min("term").alias("low"), F.max("term").alias("high"))
    return sorted((r["low"], r["high"]) for r in ranges.collect())


def _within(table: DataFrame, ranges: list[tuple[str, str]]) -> DataFrame:
    """Narrow an index table, sorted by term, to ranges of terms.

    The tests reach the files one by one, where a list of more than ten values
    would reach them as its least and greatest, and pages without a match are
    not read.
    """
    if not ranges:
        return table.filter(F.lit(False))
    term = F.col("term")
    return table.filter(_any_of([term == low if low == high else term.between(low, high) for low, high in ranges]))


def query_terms(queries: DataFrame) -> DataFrame:
    """Terms of each query text per field, with how often they are asked for.

    They are counted in tasks of a bounded share of the queries, however many there are.
    """
    texts = queries.select(QUERY, F.col("text").alias("title"), F.col("text").alias("content"))
    rows, size = texts.agg(F.count("*"), F.sum(F.octet_length("content"))).first()
    tasks = bucket_count(rows, queries.sparkSession.sparkContext.defaultParallelism, size or 0)
    return term_counts(texts, QUERY, partitions=tasks).withColumnRenamed("tf", "qtf")


def weighted_terms(terms: DataFrame, index: Index) -> tuple[DataFrame, list[tuple[str, str]], int]:
    """Query terms known to the index, with weight and length norm of BM25, the ranges they lie in, and the postings they meet.

    The rows are marked for a broadcast if those that are known are measured to be few,
    however many are asked for.  Of very many, each term meets the statistics once, so
    one that nearly every query asks for is not gathered in one task.
    """
    asked = written(terms)
    ranges = term_ranges(asked, lambda: index.heavy, SCANNED_RANGES)
    statistics = index.term_rows(lambda rows: _within(rows, ranges))
    if is_small(asked, MAX_BROADCAST_BYTES // 2):
        known = F.broadcast(asked).join(statistics, ["field", "term"])
    else:
        found = written(asked.select("field", "term").distinct().join(statistics, ["field", "term"]))
        known = asked.join(broadcast_if_small(found), ["field", "term"])
    # Two rows, one for each field.
    known = known.join(F.broadcast(index.fields.select("field", "n_docs", "avgdl")), "field")
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = written(known.select(QUERY, "field", "term", (F.col("qtf") * idf).alias("weight"), "avgdl", "df"))
    met = known.agg(F.sum("df")).first()[0] or 0
    return broadcast_if_small(known.drop("df")), ranges, met


def contributions(queries: DataFrame, index: Index) -> list[DataFrame]:
    """What each matched posting adds to its document's score for its field, for each segment of the index.

    Rows stay in the bucket of their shard when the terms are few enough to be
    broadcast; beyond that the join is Spark's to shuffle and to split.
    """
    wanted, ranges, _ = weighted_terms(query_terms(queries), index)
    return _gains(wanted, ranges, index)


def _gains(wanted: DataFrame, ranges: list[tuple[str, str]], index: Index) -> list[DataFrame]:
    norm = K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    gain = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    return [
        wanted.join(_within(postings, ranges), ["field", "term"]).select(
            QUERY, "shard", index.key, "field", "term", gain.alias("gain")
        )
        for postings in index.parts
    ]


def match_documents(queries: DataFrame, index: Index) -> DataFrame:
    """Documents holding any term of the query in any field."""
    hits = [part.groupBy(QUERY, "shard", index.key) for part in contributions(queries, index)]
    return all_of([part.agg(F.count("*").alias("matched_terms")).drop("shard") for part in hits])


def field_scores(queries: DataFrame, index: Index) -> DataFrame:
    """BM25 of each matched document per field, not boosted."""
    hits = [part.groupBy(QUERY, "shard", index.key, "field") for part in contributions(queries, index)]
    return all_of([part.agg(F.round(F.sum("gain"), 6).alias("score")).drop("shard") for part in hits])


def _ranked(parts: list[DataFrame], index: Index) -> list[DataFrame]:
    """Every hit with its score, the better of boosted title and content, for each segment of the index."""
    title = F.sum(F.when(F.col("field") == "title", F.col("gain"))) * TITLE_BOOST
    content = F.sum(F.when(F.col("field") == "content", F.col("gain")))
    score = F.round(F.greatest(title, content), 6).alias("score")
    return [part.groupBy(QUERY, "shard", index.key).agg(score) for part in parts]


def ranked(queries: DataFrame, index: Index) -> DataFrame:
    return all_of(_ranked(contributions(queries, index), index))


def totals(queries: DataFrame, index: Index) -> DataFrame:
    """Number of all hits of each query, whatever page is shown."""
    return match_documents(queries, index).groupBy(QUERY).agg(F.count("*").alias("total"))


def top_hits(parts: list[DataFrame], key: str, upto: Column) -> DataFrame:
    """Number the hits of each query by score and keep ranks to ``upto``; adds the number of all hits.

    Each shard of each segment is read and sorted once, in place: its best hits
    of a query are kept with the number of all of them, which holds no more rows
    together than a shard has documents.  Only what is kept is written and ranked
    further, in groups of shards and then against each other, so postings are
    read and scored one time.
    """
    ranks = _ranks(key)

    def best_of(hits: DataFrame) -> DataFrame:
        counted = F.count("*").over(Window.partitionBy(QUERY, "shard"))
        placed = hits.withColumns({"upto": upto.cast("int"), "place": ranks("shard")}).withColumn("n", counted)
        return placed.filter(F.col("place") <= F.greatest("upto", F.lit(1))).select(QUERY, "shard", key, "score", "upto", "place", "n")

    return _ranked_of_shards(written(all_of([best_of(hits) for hits in parts])), key)


def _ranks(key: str) -> Callable[..., Column]:
    """Number of a hit among those of its query, and of further columns."""
    order = [F.desc("score"), F.asc(key)]
    return lambda *by: F.row_number().over(Window.partitionBy(QUERY, *by).orderBy(*order))


def _ranked_of_shards(shards: DataFrame, key: str) -> DataFrame:
    """The best of all shards, from the written best of each."""
    ranks = _ranks(key)
    totals = shards.filter("place = 1").groupBy(QUERY).agg(F.sum("n").alias("total"))
    grouped = shards.withColumn("group", F.pmod(F.xxhash64("shard"), F.lit(SHARD_GROUPS)))
    best = grouped.withColumn("rank", ranks("group")).filter("rank <= upto").withColumn("rank", ranks()).filter("rank <= upto")
    return best.join(totals, QUERY).select(QUERY, F.col("rank").cast("long").alias("rank"), key, "score", "total")


def search(queries: DataFrame, index: Index, start: int | Column = 0, size: int | Column = PAGE_SIZE) -> DataFrame:
    """A page of hits per query: query, rank, document key, score, total hits.

    ``start`` and ``size`` are numbers, or columns of ``queries``.
    """
    wanted, ranges, met = weighted_terms(query_terms(queries), index)
    if isinstance(start, int) and isinstance(size, int):
        few, upto, first = None, F.lit(start + size), F.lit(start)
    else:
        start, size = (F.lit(n) if isinstance(n, int) else n for n in (start, size))
        # Only queries with a known term have hits, however many are asked.
        bounds = queries.select(QUERY, start.alias("page_start"), (start + size).alias("page_end"))
        bounds = written(bounds.join(wanted.select(QUERY), QUERY, "left_semi"))
        few, upto, first = broadcast_if_small(bounds), F.col("page_end"), F.col("page_start")
    if met > MAX_JOINED_POSTINGS:
        hits = _ranked_of_shards(_best_in_arrays(wanted, ranges, index, few, upto), index.key)
    else:
        parts = _ranked(_gains(wanted, ranges, index), index)
        hits = top_hits(parts if few is None else [part.join(few, QUERY) for part in parts], index.key, upto)
    return _page(hits if few is None else hits.join(few, QUERY), index.key, first)


def _best_in_arrays(
    wanted: DataFrame, ranges: list[tuple[str, str]], index: Index, bounds: DataFrame | None, upto: Column
) -> DataFrame:
    """The best hits of groups of shards as ``top_hits`` wants them, without a row for each posting that is met."""
    asked = wanted.select(QUERY).distinct() if bounds is None else bounds
    limits = written(asked.groupBy(QUERY).agg(F.max(upto.cast("int")).alias("upto")))
    parts = [_within(postings, ranges) for postings in index.parts]
    best = written(all_of(best_hits(wanted, limits, parts, index.buckets, index.key, QUERY, K1, B, TITLE_BOOST)))
    best = (best if bounds is None else best.join(bounds, QUERY)).withColumn("upto", upto.cast("int"))
    return best.filter(F.col("place") <= F.greatest("upto", F.lit(1))).select(QUERY, "shard", index.key, "score", "upto", "place", "n")


def _page(hits: DataFrame, key: str, first: Column) -> DataFrame:
    return hits.filter(F.col("rank") > first).select(QUERY, "rank", key, "score", "total")


def search_results(page: DataFrame, documents: DataFrame, key: str, url: Column) -> DataFrame:
    """The page's hits with their documents; a hit without one is left out.

    ``total`` stays the number of all hits.  A page is small; counted to be so,
    it is broadcast and the documents are not shuffled.
    """
    shown = documents.select(key, "id", "title", "file_name", "updated_by", "updated_on", url.alias("url"))
    return broadcast_if_small(written(page)).join(shown, key)


def search_status(queries: DataFrame, page: DataFrame) -> DataFrame:
    """Outcome of each query: ``bad_query``, ``empty`` or ``ok``."""
    found = page.select(QUERY).distinct().withColumn("found", F.lit(True))
    blank = F.col("text").isNull() | (F.trim("text") == "")
    return queries.join(found, QUERY, "left").select(
        QUERY, F.when(blank, "bad_query").when(F.col("found"), "ok").otherwise("empty").alias("status")
    )
