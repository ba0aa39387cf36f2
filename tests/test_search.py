import re

import pytest
from pyspark.sql import functions as F

from lorekeep.functions.urls import document_url
from lorekeep.operators import highlight, search
from lorekeep.operators.index import bucket_count, build_index, clear_index, merge_segments, open_index, update_index
from lorekeep.operators.segments import to_be_merged

from tests import plain

DOCS = {
    1: {"title": "running dogs", "content": "the dog runs and the dog sleeps"},
    2: {"title": "cats", "content": "cats and dogs are animals"},
    3: {"title": "dog", "content": "nothing to see"},
    4: {"title": "weather", "content": "rain rain rain and sun"},
    5: {"title": "weather", "content": "rain rain rain and sun"},
    6: {"title": "the and", "content": "this was they are the"},
    7: {"title": "long text", "content": " ".join(["rain", *["filler"] * 40, "dog"])},
    8: {"title": "sun", "content": ""},
}
QUERIES = {1: "dogs", 2: "rain sun", 3: "the and", 4: "zebra", 5: "dog dog rain", 6: "this was", 7: "running"}


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(k, v["title"], v["content"]) for k, v in DOCS.items()]
    return spark.createDataFrame(rows, "doc_id long, title string, content string")


@pytest.fixture(scope="module")
def index(corpus, tmp_path_factory):
    return build_index(corpus, str(tmp_path_factory.mktemp("ix")), "doc_id", buckets=3)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(list(QUERIES.items()), "query_id long, text string")


@pytest.fixture(scope="module")
def expected():
    return plain.scores(DOCS, QUERIES)


def pages(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.doc_id, r.score))
    return out


def test_scores_match_the_book(index, queries, expected):
    got = {}
    for r in search.ranked(queries, index).collect():
        got.setdefault(r.query_id, {})[r.doc_id] = r.score
    assert got == {q: pytest.approx(dict(hits), abs=2e-6) for q, hits in expected.items() if hits}


def test_best_field_counts_not_the_sum(index, queries):
    fields = {(r.doc_id, r.field): r.score for r in search.field_scores(queries.filter("query_id = 1"), index).collect()}
    best = {r.doc_id: r.score for r in search.ranked(queries.filter("query_id = 1"), index).collect()}
    assert best[1] == pytest.approx(max(3 * fields[1, "title"], fields[1, "content"]), abs=1e-5)


def test_ties_go_by_key_and_pages_are_prefixes(index, queries, expected):
    previous = {}
    for size in (1, 2, 3, 50):
        page = pages(search.search(queries, index, 0, size))
        assert {q: [d for d, _ in hits] for q, hits in page.items()} == {
            q: [d for d, _ in hits[:size]] for q, hits in expected.items() if hits
        }
        assert all(page[q][: len(hits)] == hits for q, hits in previous.items())
        previous = page
    tied = [d for d, _ in previous[2]]
    assert tied.index(4) + 1 == tied.index(5)


def test_paging_by_columns_and_totals(index, queries, expected):
    got = search.search(queries, index, F.col("query_id") % 2, F.lit(2)).collect()
    assert {(r.query_id, r["rank"], r.doc_id) for r in got} == {
        (q, i + 1, d) for q, hits in expected.items() for i, (d, _) in enumerate(hits) if q % 2 <= i < q % 2 + 2
    }
    assert all(r.total == len(expected[r.query_id]) for r in got)
    assert {r.query_id: r.total for r in search.totals(queries, index).collect()} == {
        q: len(h) for q, h in expected.items() if h
    }


def test_stop_words_match_titles_only(index, queries):
    hits = search.match_documents(queries.filter("query_id in (3, 6)"), index).collect()
    assert {(r.query_id, r.doc_id) for r in hits} == {(3, 6), (6, 6)}


def test_lengths_and_frequencies_agree(index):
    sums = index.postings.groupBy("field", "doc_id").agg(F.sum("tf").alias("sum_tf"))
    assert index.lengths.join(sums, ["field", "doc_id"]).filter("dl <> sum_tf").count() == 0
    assert index.lengths.count() == sums.count() == 15
    assert index.fields.filter("field = 'content'").first().n_docs == 7


def test_many_terms_and_large_batches_take_the_other_paths(index, queries, monkeypatch):
    want = pages(search.search(queries, index))
    monkeypatch.setattr(search, "MAX_PUSHED_TERMS", 0)
    monkeypatch.setattr(search, "broadcast_if_small", lambda rows: rows)
    monkeypatch.setattr(search, "is_small", lambda rows, limit: False)
    assert pages(search.search(queries, index)) == want


def test_a_search_shuffles_only_the_shortlist(index, queries, spark, monkeypatch):
    """Postings are read once and ranked in place; what is moved is the best of each shard."""
    kept, plans = search.written, []

    def recorded(rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return kept(rows)

    monkeypatch.setattr(search, "written", recorded)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = search.search(queries, index)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    # The best of each shard by group, those of each group by query, and the counts.
    moved = re.findall(r"Exchange hashpartitioning\((\w+)#\d+L?(?:, (\w+)#)?", plan)
    assert sorted(moved) == [("query_id", ""), ("query_id", ""), ("query_id", "group")]
    ranking = [p for p in plans if "row_number" in p]
    assert len(ranking) == 1 and ranking[0].count("FileScan parquet") == 2  # postings, and the weighted terms
    assert "Exchange hashpartitioning" not in ranking[0] and "postings" not in plan


def test_rows_read_follow_the_terms_asked_for(spark, tmp_path, monkeypatch):
    """Pushed equalities skip row groups and pages; the list form reads nearly all."""
    words = spark.range(400_000).select(F.lpad(F.col("id").cast("string"), 8, "0").alias("term"), F.col("id").alias("tf"))
    path = str(tmp_path / "sorted")
    words.coalesce(1).write.option("parquet.block.size", 64 << 10).option("parquet.page.size", 8 << 10).option(
        "parquet.page.row.count.limit", 500).parquet(path)
    read = []
    for n in (5, 50, 500):
        terms = spark.range(n).select(F.lpad((F.col("id") * (400_000 // n)).cast("string"), 8, "0").alias("term"))
        narrowed = search._within(spark.read.parquet(path), search.term_ranges(terms, list))
        assert narrowed.count() == n
        plan = narrowed._jdf.queryExecution().executedPlan()
        plan.execute().count()
        read.append(sum(leaf.metrics().apply("numOutputRows").value() for leaf in [plan.collectLeaves().head()]))
    assert read[0] < read[1] < 400_000 / 2 and read[0] < 20_000


def test_rows_read_of_very_many_terms_leave_out_the_heavy_ones(spark, tmp_path):
    """Beyond the terms that are told one by one, ranges between heavy terms that nobody asks for are read."""
    words = spark.range(60_000).select(F.lpad(F.col("id").cast("string"), 8, "0").alias("term"), F.lit(1).alias("n"))
    heavy = [f"{i:08d}" for i in range(500, 60_000, 6000)]
    rows = words.withColumn("n", F.when(F.col("term").isin(heavy), 20_000).otherwise(1))
    rows = rows.select("term", F.explode(F.sequence(F.lit(1), "n")).alias("tf")).orderBy("term")
    path, read = str(tmp_path / "heavy"), []
    rows.coalesce(1).write.option("parquet.block.size", 64 << 10).option("parquet.page.row.count.limit", 500).parquet(path)
    for n in (50, 500, 5000):
        terms = words.filter(F.col("term").cast("int") % (60_000 // n) == 7).select("term")
        ranges = search.term_ranges(terms, lambda: heavy)
        assert len(ranges) <= search.MAX_PUSHED_TERMS
        narrowed = search._within(spark.read.parquet(path), ranges)
        assert narrowed.join(terms, "term").count() == n
        plan = narrowed._jdf.queryExecution().executedPlan()
        plan.execute().count()
        read.append(plan.collectLeaves().head().metrics().apply("numOutputRows").value())
    assert read[0] < read[1] < read[2] < 0.5 * 260_000
    # A heavy term that is asked for is read.
    asked = words.select("term").unionByName(spark.createDataFrame([(heavy[3],)], "term string"))
    ranges = search.term_ranges(asked.filter(~F.col("term").isin([*heavy[:3], *heavy[4:]])), lambda: heavy)
    assert any(low <= heavy[3] <= high for low, high in ranges) and not any(low <= heavy[2] <= high for low, high in ranges)


def test_what_an_update_writes_follows_the_change(spark, tmp_path, queries):
    """Bytes of a new segment beside those of the base, and searches over many segments and over the merged one."""
    docs = spark.range(4000).selectExpr(
        "id doc_id", "concat('page ', id) title",
        "concat_ws(' ', transform(sequence(1, 60), i -> concat('word', pmod(xxhash64(id, i), 5000)))) content",
    )
    size = lambda path: sum(f.stat().st_size for f in path.rglob("*.parquet"))
    now = build_index(docs, str(tmp_path / "base"), "doc_id", buckets=2)
    base = size(tmp_path / "base")
    whole = docs
    for i in range(3):
        changed = docs.filter(F.col("doc_id") % 400 == i).withColumn("content", F.concat("content", F.lit(f" fresh{i}")))
        removed = docs.filter(F.col("doc_id") == 100 + i).select("doc_id")
        now = update_index(now, changed, str(tmp_path / f"seg-{i}"), removed=removed)
        whole = whole.join(changed.unionByName(docs.filter(F.col("doc_id") == 100 + i)).select("doc_id"), "doc_id", "left_anti")
        whole = whole.select(*docs.columns).unionByName(changed)
        assert size(tmp_path / f"seg-{i}") < 0.1 * base
    assert len(now.segments) == 4 and not to_be_merged(now.segments)
    rebuilt = build_index(whole, str(tmp_path / "whole"), "doc_id", buckets=2)
    asked = spark.createDataFrame([(1, "fresh1 word7"), (2, "page 100"), (3, "word1 word2 word3")], "query_id long, text string")
    merged = merge_segments(now, str(tmp_path / "merged"))
    assert len(merged.segments) == 1
    for other in (now, open_index(spark, now.path), merged):
        assert sorted(other.terms.collect()) == sorted(rebuilt.terms.collect())
        assert sorted(other.fields.collect()) == sorted(rebuilt.fields.collect())
        assert pages(search.search(asked, other, 0, 20)) == pages(search.search(asked, rebuilt, 0, 20))


def test_index_opens_again_and_clears(corpus, queries, tmp_path, spark):
    built = build_index(corpus, str(tmp_path), "doc_id")
    want = pages(search.search(queries, built))
    again = open_index(spark, str(tmp_path))
    assert pages(search.search(queries, again)) == want
    clear_index(again)
    assert again.postings.count() == again.terms.count() == again.fields.count() == 0
    assert search.search(queries, again).count() == 0
    assert pages(search.search(queries, build_index(corpus, str(tmp_path), "doc_id"))) == want


def test_an_update_equals_a_rebuild(index, corpus, queries, tmp_path, spark):
    changed = spark.createDataFrame([(3, "zebra", "now about rain"), (9, "dog sun", "rain")], corpus.schema)
    whole = corpus.filter("doc_id <> 3").unionByName(changed)
    updated = update_index(index, changed, str(tmp_path / "a"))
    rebuilt = build_index(whole, str(tmp_path / "b"), "doc_id", buckets=3)
    assert sorted(updated.postings.collect()) == sorted(rebuilt.postings.collect())
    assert sorted(updated.terms.collect()) == sorted(rebuilt.terms.collect())
    assert pages(search.search(queries, open_index(spark, str(tmp_path / "a")))) == pages(search.search(queries, rebuilt))
    again = update_index(updated, changed, str(tmp_path / "c"))
    assert sorted(again.postings.collect()) == sorted(rebuilt.postings.collect())


def test_a_term_in_a_third_of_all_documents(spark, tmp_path):
    docs = spark.range(3000).selectExpr(
        "id doc_id", "concat('page ', id) title", "if(id % 3 = 0, concat('hot text', repeat(' pad', cast(id % 7 as int))), 'cold') content"
    )
    index = build_index(docs, str(tmp_path), "doc_id")
    assert index.buckets > 1
    queries = spark.range(20).selectExpr("id query_id", "'hot' text")
    got = search.search(queries, index).collect()
    assert len(got) == 100 and {r.total for r in got} == {1000}
    assert all(r.doc_id == 21 * (r["rank"] - 1) for r in got)
    sizes = [r[0] for r in index.postings.filter("term = 'hot'").groupBy("shard").count().select("count").collect()]
    assert max(sizes) < 100


def test_more_documents_never_lower_totals(corpus, queries, tmp_path, spark):
    more = corpus.unionByName(spark.createDataFrame([(9, "dog sun", "rain")], corpus.schema))
    before = {r.query_id: r.total for r in search.totals(queries, build_index(corpus, str(tmp_path / "a"), "doc_id")).collect()}
    after = {r.query_id: r.total for r in search.totals(queries, build_index(more, str(tmp_path / "b"), "doc_id")).collect()}
    assert all(after[q] >= n for q, n in before.items()) and after[1] == before[1] + 1


def test_bucket_count_grows_with_the_corpus():
    assert [bucket_count(n, 8) for n in (0, 1, 1000, 10**5, 10**7, 10**12)] == [1, 1, 4, 16, 200, 100_000]


def test_results_drop_hits_without_document_but_keep_the_total(index, queries, spark):
    stored = spark.createDataFrame(
        [(1, "i1", "running dogs", "d/running-dogs.md", "ann", 0)],
        "doc_id long, id string, title string, file_name string, updated_by string, updated_on long",
    )
    page = search.search(queries.filter("query_id = 1"), index)
    got = search.search_results(page, stored, "doc_id", document_url("http://h/w/home", F.col("file_name"))).collect()
    assert [(r.id, r.url) for r in got] == [("i1", "http://h/w/d/running-dogs")]
    assert got[0].total == 4


def test_status(index, spark):
    queries = spark.createDataFrame([(1, "dog"), (2, "zebra"), (3, " "), (4, None)], "query_id long, text string")
    got = search.search_status(queries, search.search(queries, index)).collect()
    assert {r.query_id: r.status for r in got} == {1: "ok", 2: "empty", 3: "bad_query", 4: "bad_query"}


def test_highlights(index, queries, corpus):
    asked = queries.filter("query_id = 5")
    page = search.search(asked, index, 0, 50)
    passages = highlight.fragments(page, search.query_terms(asked), corpus, "doc_id")
    got = {(r.doc_id, r.fragment): r.passage for r in passages.collect()}
    assert got[1, 1] == "the <em>dog</em> runs and the <em>dog</em> sleeps"
    assert got[7, 1] == "<em>rain</em>" + " filler" * 6 and got[7, 2] == "filler " * 6 + "<em>dog</em>"
    lines = {r.doc_id: r.highlight for r in highlight.highlights(page, passages, "doc_id").collect()}
    assert lines[7] == "*rain*" + " filler" * 6 + "\n" + "filler " * 6 + "*dog*\n"
    assert lines[3] is None


def test_urls(values):
    build = lambda base: lambda name: document_url(base, name)
    names = ["a/b-c.md", "x", "two words.md", "é.md", "x:y/z.md", "a/x:y.md", "q%41.md", "q%4.md"]
    assert values(build("https://h/w/home"), names) == [
        "https://h/w/a/b-c", "https://h/w/x", "https://h/w/home", "https://h/w/home", "https://h/w/home",
        "https://h/w/a/x:y", "https://h/w/q%41", "https://h/w/home",
    ]
    assert values(build("https://h/w/"), ["x.md"]) == ["https://h/w/x"]
    assert values(build("https://h"), ["x.md", "/y.md"]) == ["https://h/x", "https://h/y"]
