"""What a task, a scan and a scratch table hold must not grow beyond their bounds."""

import os
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorekeep.operators import dense
from lorekeep.operators import index as index_module
from lorekeep.operators import search
from lorekeep.operators.index import BYTES_PER_BUCKET, bucket_count, build_index, merge_segments, update_index


def corpus(spark, n, words):
    return spark.range(n).selectExpr(
        "id doc_id", "concat('page ', id) title",
        f"concat_ws(' ', transform(sequence(1, {words}), i -> concat('word', pmod(xxhash64(id, i), 3000)))) content",
    )


def test_buckets_follow_the_bytes_of_the_texts(spark, tmp_path, monkeypatch):
    assert bucket_count(10**5, 8, 0) == 16 and bucket_count(10**5, 8, 100 * BYTES_PER_BUCKET) == 100
    assert bucket_count(3, 8, 10**12) == 3
    monkeypatch.setattr("lorekeep.operators.index.BYTES_PER_BUCKET", 4_000)
    assert build_index(corpus(spark, 100, 100), str(tmp_path / "ix"), "doc_id").buckets > 10


def test_postings_are_sorted_by_their_terms_alone(spark, tmp_path):
    """A task has one bucket, so its rows are not compared by their buckets; files are in order, and whole."""
    index = build_index(corpus(spark, 300, 20), str(tmp_path / "ix"), "doc_id", buckets=6)
    now = update_index(index, corpus(spark, 400, 5).filter("doc_id >= 200"), str(tmp_path / "up"))
    for place, n in (("ix", 300), ("up", 200)):
        rows = spark.read.parquet(str(tmp_path / place / "postings")).selectExpr(
            "doc_id", "term", "pmod(hash(shard), 6) AS bucket", "input_file_name() AS file", "_metadata.row_index AS at"
        ).collect()
        assert {r.doc_id for r in rows} == set(range(400 - n, 400) if place == "up" else range(n))
        assert {int(re.search(r"_(\d+)\.", r.file).group(1)) - r.bucket for r in rows} == {0}
        files = {r.file: [] for r in rows}
        assert len(files) == 6
        for r in sorted(rows, key=lambda r: r["at"]):
            files[r.file].append(r.term)
        assert all(terms == sorted(terms) and len(set(terms)) > 5 for terms in files.values())
    sorts = []
    writing = index_module._write_postings

    def seen(postings, *args, **kwargs):
        sorts.append(kwargs.get("placed", args[3] if len(args) > 3 else False))
        writing(postings, *args, **kwargs)

    with pytest.MonkeyPatch.context() as patched:
        patched.setattr(index_module, "_write_postings", seen)
        merge_segments(update_index(now, corpus(spark, 10, 5), str(tmp_path / "again")), str(tmp_path / "merged"))
    assert sorts == [True, False]
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_segments_are_merged_bucket_by_bucket(spark, tmp_path):
    """No task of a merge sorts more than a bucket, however many of them a scan would read together."""
    index = build_index(corpus(spark, 300, 20), str(tmp_path / "ix"), "doc_id", buckets=40)
    changed = corpus(spark, 100, 5).withColumn("content", F.concat("content", F.lit(" revised")))
    now = update_index(index, changed, str(tmp_path / "up"))
    merged = merge_segments(now, str(tmp_path / "merged"))
    buckets = {}
    for name in os.listdir(tmp_path / "merged" / "postings"):
        if name.endswith(".parquet"):
            task, bucket = re.match(r"part-(\d+)-.*_(\d+)\.", name).groups()
            buckets.setdefault(task, set()).add(bucket)
    assert len(set().union(*buckets.values())) > 30 and all(len(b) == 1 for b in buckets.values())
    columns = sorted(now.postings.columns)
    assert sorted(merged.postings.select(columns).collect()) == sorted(now.postings.select(columns).collect())
    assert spark.conf.get("spark.sql.sources.bucketing.autoBucketedScan.enabled") == "true"


def test_postings_meet_few_tests_however_many_terms_are_asked_for(spark, tmp_path):
    index = build_index(corpus(spark, 60, 200), str(tmp_path / "ix"), "doc_id", buckets=2)
    text = " ".join(f"word{i}" for i in range(400))
    queries = spark.createDataFrame([(1, text), (2, "page 7")], "query_id long, text string")
    _, ranges, _ = search.weighted_terms(search.query_terms(queries), index)
    assert len(ranges) <= search.SCANNED_RANGES
    got = {(r.query_id, r.doc_id) for r in search.ranked(queries, index).collect()}
    held = index.postings.filter("field = 'content'").select("doc_id", "term")
    asked = spark.createDataFrame([(f"word{i}",) for i in range(400)], "term string")
    assert {d for q, d in got if q == 1} == {r.doc_id for r in held.join(asked, "term").collect()}
    assert {d for q, d in got if q == 2} == set(range(60))


def test_terms_that_the_index_lacks_do_not_count_for_the_broadcast(spark, tmp_path, monkeypatch):
    index = build_index(corpus(spark, 60, 50), str(tmp_path / "ix"), "doc_id", buckets=2)
    unknown = spark.range(2000).selectExpr("id + 10 AS query_id", "concat('unheard', id) AS text")
    queries = unknown.union(spark.createDataFrame([(1, "word5 word6")], "query_id long, text string"))
    monkeypatch.setattr("lorekeep.operators.joins.MAX_BROADCAST_ROWS", 1000)
    wanted, _, _ = search.weighted_terms(search.query_terms(queries), index)
    assert "strategy=broadcast" in wanted._jdf.queryExecution().analyzed().toString()
    assert {r.query_id for r in search.totals(queries, index).collect()} == {1}


def test_many_queries_are_analysed_in_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr("lorekeep.operators.index.DOCUMENTS_PER_BUCKET", 50)
    queries = spark.range(1000).selectExpr("id AS query_id", "concat('customer ', id) AS text")
    tasks = search.query_terms(queries).groupBy(F.spark_partition_id()).agg(F.countDistinct("query_id").alias("n")).collect()
    assert sum(r.n for r in tasks) == 1000 and len(tasks) > 15


def test_many_unknown_queries_leave_few_rows_to_be_joined(spark, tmp_path, monkeypatch):
    """A term that all ask for meets the statistics once; only queries with a known term have a page."""
    index = build_index(corpus(spark, 60, 50), str(tmp_path / "ix"), "doc_id", buckets=2)
    unknown = spark.range(2000).selectExpr("id + 10 AS query_id", "concat('customer unheard', id) AS text")
    queries = unknown.union(spark.createDataFrame([(1, "word5 word6"), (None, "word5")], "query_id long, text string"))
    want = sorted(map(tuple, search.search(queries.filter("query_id = 1"), index, F.lit(0), F.lit(7)).collect()))
    monkeypatch.setattr("lorekeep.operators.joins.MAX_BROADCAST_ROWS", 1000)
    joined, broadcast = {}, search.broadcast_if_small

    def counted(rows):
        joined["page" if "page_end" in rows.columns else "weight" if "weight" in rows.columns else "df"] = rows.count()
        return broadcast(rows)

    monkeypatch.setattr(search, "broadcast_if_small", counted)
    assert sorted(map(tuple, search.search(queries, index, F.lit(0), F.lit(7)).collect())) == want and len(want) > 1
    assert joined == {"df": 2, "weight": 3, "page": 1}


def test_a_large_batch_in_arrays_ranks_as_rows_do(spark, tmp_path, monkeypatch):
    docs = corpus(spark, 120, 30).withColumn("doc_id", F.col("doc_id").cast("string"))
    docs = docs.unionByName(spark.createDataFrame([(None, "word3 page", "word4 word5")], "doc_id string, title string, content string"))
    index = build_index(docs, str(tmp_path / "ix"), "doc_id", buckets=2)
    rows = [(i, f"word{i} word{i * 7 % 3000} page {i % 120} word{i}") for i in range(1, 90)]
    rows += [(500, "page"), (500, "page"), (None, "word3"), (600, None), (601, "unheard")]
    queries = spark.createDataFrame(rows, "query_id long, text string")

    def found(*page):
        return sorted(map(tuple, search.search(queries, index, *page).collect()), key=str)

    for page in [(2, 4), (F.coalesce(F.col("query_id") % 3, F.lit(0)), F.lit(6))]:
        want = found(*page)
        with monkeypatch.context() as few:
            few.setattr(search, "MAX_JOINED_POSTINGS", 0)
            few.setattr("lorekeep.operators.dense.MAX_BROADCAST_BYTES", 9_000)
            got = found(*page)
        assert len(got) == len(want) > 100
        for r, w in zip(got, want, strict=True):
            assert r[:3] + r[4:] == w[:3] + w[4:] and r[3] == pytest.approx(w[3], abs=2e-6)


def test_a_large_batch_leaves_rows_by_tasks_and_not_by_shards(spark):
    """400 documents in 100 shards, all of them hits of each query: the best come by task, the numbers are those of all."""
    postings = spark.range(400).selectExpr(
        "CAST(id % 100 AS INT) AS shard", "id AS doc_id", "'content' AS field", "'word' AS term", "id % 7 + 1 AS tf", "10 AS dl"
    )
    wanted = spark.range(30).selectExpr("id AS query_id", "'content' AS field", "'word' AS term", "1.0D + id AS weight", "10.0D AS avgdl")
    limits = spark.range(30).selectExpr("id AS query_id", "2 AS upto")
    (best,) = dense.best_hits(wanted, limits, [postings], 25, "doc_id", "query_id", 1.2, 0.75, 3.0)
    rows = best.collect()
    assert len(rows) <= 30 * 2 * spark.sparkContext.defaultParallelism
    for q in range(30):
        assert sum(r["n"] for r in rows if r["query_id"] == q and r["place"] == 1) == 400
        top = sorted((-r["score"], r["doc_id"]) for r in rows if r["query_id"] == q)[:2]
        assert [d for _, d in top] == [6, 13] and top[0][0] == pytest.approx(-(1 + q) * 7 * 2.2 / 8.2, abs=2e-6)


@pytest.mark.parametrize("upto", [1, 7, 5000])
@pytest.mark.parametrize("share", [2, 50])
def test_documents_left_out_early_are_none_of_the_best(monkeypatch, upto, share):
    """Every hit is counted and the best are found, whatever a chunk and a task hold; equal scores go by key."""
    monkeypatch.setattr(dense, "CHUNK_POSTINGS", 3000)
    monkeypatch.setattr(dense, "DENSE_SHARE", share)
    random = np.random.default_rng(7)
    n, terms, asking, boost = 900, np.arange(60) * 10, 40, 3.0
    chance = 0.9 * random.random(len(terms)) ** 3 + 0.002
    held = random.random((n, len(terms))) < chance
    gains = np.where(held, random.integers(1, 9, held.shape) / 4, 0.0)
    in_title = np.arange(len(terms)) >= 57
    weights = np.where(random.random((asking, len(terms))) < 0.3, np.log(1 / chance), 0.0)
    weights[: asking // 2, in_title] = 0
    weights[3] = 0
    doc, term = np.nonzero(held)
    keys = np.array([f"k{i * 7919 % n:04d}" for i in range(n)], object)
    keys[5] = None
    mixed = random.permutation(len(doc))
    make = dense._by_document("key")
    batches = []
    for shard in range(3):
        own = mixed[doc[mixed] % 3 == shard]
        postings = pa.table({
            "shard": pa.array(np.full(len(own), shard, np.int32)), "key": pa.array(keys[doc[own]], pa.string()),
            "term_no": pa.array(terms[term[own]]), "gain": pa.array(gains[doc[own], term[own]]),
        })
        rows = make(postings)
        assert rows.num_rows == len(np.unique(doc[own]))
        batches += rows.to_batches(100)
    by_query, of_term = np.nonzero(weights)
    first = np.searchsorted(by_query, np.arange(asking + 1))
    block = (pa.array(np.arange(asking)), np.full(asking, upto), terms, in_title, first, of_term, weights[by_query, of_term])
    run = dense._best_of_documents(SimpleNamespace(value=block), "key", "query_id", boost)
    found = pa.Table.from_batches(list(run(iter(batches)))).to_pylist()
    got = [[r for r in found if r["query_id"] == q] for q in range(asking)]
    for q in range(asking):
        content = gains[:, ~in_title] @ weights[q, ~in_title]
        score = np.maximum(content, gains[:, in_title] @ weights[q, in_title] * boost)
        score = np.floor(score * 1e6 + 0.5) / 1e6
        hits = sorted(np.flatnonzero(score), key=lambda i: (-score[i], keys[i] or ""))
        assert [r["key"] for r in got[q]] == [keys[i] for i in hits[:upto]]
        assert [r["score"] for r in got[q]] == pytest.approx([score[i] for i in hits[:upto]], abs=2e-6)
        assert [r["place"] for r in got[q]] == list(range(1, len(got[q]) + 1)) and {r["n"] for r in got[q]} <= {len(hits)}
    assert got[3] == [] and sum(map(len, got)) > 30
    # A task that keeps too much hands it on, and begins anew.
    monkeypatch.setattr(dense, "KEPT_HITS", 0)
    parts = pa.Table.from_batches(list(run(iter(batches)))).to_pylist()
    assert len(parts) > len(found) or upto == 5000
    count = lambda rows, q: sum(r["n"] for r in rows if r["query_id"] == q and r["place"] == 1)
    assert all(count(parts, q) == count(found, q) for q in range(asking))
