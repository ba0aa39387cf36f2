"""The inverted index as written tables.

=============  ==============================================================
``postings``   shard, key, field, term, tf, dl, first_of_field
``terms``      field, term, df, cf
``fields``     field, n_docs, n_terms, n_postings, avgdl (one row per field)
``heavy``      the terms with most postings, a bounded number of them
=============  ==============================================================

Postings are sharded by document: ``shard`` is a hash of the key, and the table
is bucketed by it and sorted by term inside.  Two things follow.

* The texts are shuffled once, by shard.  Counting, stemming, field lengths and
  the bucketed write all find their rows in place after that.
* A search adds up, ranks and cuts its hits within each bucket, without moving
  a posting.  A term that occurs in a third of all documents is spread over all
  shards as evenly as the documents are.

The width of it all is the number of buckets, as one task writes or reads one
bucket.  It grows with the number and the bytes of the documents unless it is
given, so a task's share stays the same, however large the corpus.

An index is a base and additions, each a segment with tables of its own.  An
update writes a segment: postings of new and changed documents, the keys it
replaces, and what it adds to and takes from the statistics, which are sums.
Segments hold different documents, so each is searched in place.  When the
additions are many or large beside the base, they are merged into a new base.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators.analysis import term_counts, with_field_length
from lorekeep.operators.joins import broadcast_if_small, written
from lorekeep.operators.segments import Segment, all_of, live, write_gone

SHARDS_PER_BUCKET = 4
DOCUMENTS_PER_BUCKET = 50_000
MIN_DOCUMENTS_PER_BUCKET = 250
#: Bytes of text whose words one task counts, stems and sorts.
BYTES_PER_BUCKET = 4 << 20
MAX_BUCKETS = 100_000
#: Heaviest terms that a segment names, and shards up to which a scan is told which buckets to read.
HEAVY_TERMS, MAX_PUSHED_SHARDS = 1_000, 200


def shard_of(key: Column, buckets: int) -> Column:
    """Several shards for each bucket, so that buckets come out evenly filled."""
    return F.pmod(F.xxhash64(key), F.lit(buckets * SHARDS_PER_BUCKET)).cast("int")


def bucket_count(documents: int, parallelism: int, size: int = 0) -> int:
    """Buckets for a corpus of ``size`` bytes: of a size that suits a task, and
    where there are documents enough, some for every core."""
    by_size = max(-(-documents // DOCUMENTS_PER_BUCKET), min(documents, -(-size // BYTES_PER_BUCKET)))
    by_cores = min(2 * parallelism, -(-documents // MIN_DOCUMENTS_PER_BUCKET))
    return max(1, min(MAX_BUCKETS, max(by_size, by_cores)))


def field_statistics(postings: DataFrame) -> DataFrame:
    """Documents, terms and postings of each field."""
    return postings.groupBy("field").agg(
        F.sum(F.col("first_of_field").cast("bigint")).alias("n_docs"),
        F.sum("tf").alias("n_terms"),
        F.count("*").alias("n_postings"),
    )


def term_statistics(postings: DataFrame) -> DataFrame:
    """Document and collection frequency of each term."""
    return postings.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@dataclass(frozen=True)
class Index:
    """A written index: its segments, the tables of their postings, its document key."""

    spark: SparkSession
    path: str
    key: str
    buckets: int
    columns: tuple[tuple[str, str], ...]
    segments: tuple[Segment, ...]
    tables: tuple[str, ...]

    @property
    def parts(self) -> list[DataFrame]:
        """Live postings of each segment, in their buckets."""
        return live(self.spark, self.segments, self.key, lambda i: self.spark.table(self.tables[i]))

    @property
    def postings(self) -> DataFrame:
        return all_of(self.parts)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{s.path}/{name}" for s in self.segments])

    def term_rows(self, narrow: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        """Statistics of terms, narrowed where they are read, added up over the segments."""
        rows = narrow(self._read("terms"))
        if len(self.segments) == 1:
            return rows
        sums = rows.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        return sums.filter("df > 0")

    @property
    def terms(self) -> DataFrame:
        return self.term_rows()

    @property
    def fields(self) -> DataFrame:
        sums = self._read("fields").groupBy("field").agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_terms", "n_postings")])
        return sums.filter("n_docs > 0").withColumn("avgdl", F.col("n_terms") / F.col("n_docs"))

    @property
    def heavy(self) -> list[str]:
        """Terms with very many postings, the heaviest first; at most HEAVY_TERMS for each segment."""
        rows = self._read("heavy").groupBy("term").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "term").limit(HEAVY_TERMS)
        return [r["term"] for r in rows.collect()]

    @property
    def lengths(self) -> DataFrame:
        """Length of each document's fields."""
        return self.postings.filter("first_of_field").select("field", self.key, "dl")


def _new_table_name() -> str:
    return f"lorekeep_postings_{uuid.uuid4().hex}"


@contextlib.contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _write_postings(postings: DataFrame, table: str, path: str, buckets: int, placed: bool = False) -> None:
    """Write postings by bucket, in the order of their terms.

    Those that are ``placed`` come with one bucket a task, which is sorted by term
    alone.  For others the writer sorts by bucket and term, and works out the
    buckets of two rows each time that it compares them.
    """
    writer = (postings.sortWithinPartitions("term") if placed else postings).write.mode("overwrite").bucketBy(buckets, "shard")
    writer = (writer if placed else writer.sortBy("term")).option("path", f"{path}/postings").format("parquet")
    # With a writer for each bucket, of which a task has one, rows are taken in the order they are in.
    with _setting(postings.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", "1" if placed else "0"):
        writer.saveAsTable(table)


def _write_statistics(terms: DataFrame, fields: DataFrame, path: str) -> int:
    """Write what a segment adds to the statistics; returns the postings it has more than before."""
    spark = terms.sparkSession
    fields.coalesce(1).write.mode("overwrite").parquet(f"{path}/fields")
    terms.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    counted = spark.read.schema(terms.schema).parquet(f"{path}/terms").groupBy("term").agg(F.sum("df").alias("n"))
    counted.orderBy(F.desc("n"), "term").limit(HEAVY_TERMS).coalesce(1).write.mode("overwrite").parquet(f"{path}/heavy")
    return spark.read.schema(fields.schema).parquet(f"{path}/fields").agg(F.sum("n_postings")).first()[0] or 0


def _analysed(documents: DataFrame, key: str, title: str, content: str, buckets: int) -> DataFrame:
    """Postings of documents, placed in their buckets."""
    keys = ["shard", key]
    texts = documents.select(shard_of(F.col(key), buckets).alias("shard"), key, title, content)
    return with_field_length(term_counts(texts, keys, title, content, place_by="shard", partitions=buckets), keys)


def build_index(
    documents: DataFrame,
    path: str,
    key: str,
    title: str = "title",
    content: str = "content",
    buckets: int | None = None,
) -> Index:
    """Write the index of ``documents`` to ``path``, replacing what is there.

    Statistics are made from the written postings, so the texts are read and
    shuffled one time and a lost executor costs no second analysis.
    """
    spark = documents.sparkSession
    if not buckets:
        rows, size = documents.agg(F.count("*"), F.sum(F.octet_length(content))).first()
        buckets = bucket_count(rows, spark.sparkContext.defaultParallelism, size or 0)
    return _write_base(spark, _analysed(documents, key, title, content, buckets), path, key, buckets, placed=True)


def _write_base(
    spark: SparkSession, postings: DataFrame, path: str, key: str, buckets: int,
    reading: contextlib.AbstractContextManager | None = None, placed: bool = False,
) -> Index:
    table = _new_table_name()
    with reading or contextlib.nullcontext():
        _write_postings(postings, table, path, buckets, placed)
    written_ = spark.table(table)
    rows = _write_statistics(term_statistics(written_), field_statistics(written_), path)
    none = spark.createDataFrame([], f"`{key}` {dict(written_.dtypes)[key]}")
    return _with_meta(spark, path, key, buckets, postings, (Segment(path, rows, *write_gone(none, path)),), (table,))


def _with_meta(
    spark: SparkSession, path: str, key: str, buckets: int, postings: DataFrame, segments: tuple[Segment, ...], tables: tuple[str, ...]
) -> Index:
    # Without postings there is no file that could tell their columns.
    columns = tuple((c.name, c.dataType.simpleString()) for c in postings.schema)
    meta = json.dumps({"key": key, "buckets": buckets, "columns": columns, "segments": [s.as_list() for s in segments]})
    line = spark.range(1).select(F.lit(meta).alias("value")).coalesce(1)
    line.write.mode("overwrite").text(f"{path}/meta")
    return Index(spark, path, key, buckets, columns, segments, tables)


def update_index(
    index: Index, changed: DataFrame, path: str, title: str = "title", content: str = "content",
    removed: DataFrame | None = None,
) -> Index:
    """The index with new and changed documents, as one more segment at ``path``.

    Only ``changed`` is analysed, and what is written follows it: its postings,
    the replaced keys, and the changes of the statistics.  For these the replaced
    documents' postings are looked up in the buckets of their shards.  Documents
    whose keys are in ``removed`` are taken out.  The index given stays as it is.
    """
    spark = index.spark
    added = _analysed(changed, index.key, title, content, index.buckets).select(*[c for c, _ in index.columns])
    table = _new_table_name()
    _write_postings(added, table, path, index.buckets, placed=True)
    keys = changed.select(index.key)
    keys = keys if removed is None else keys.unionByName(removed.select(index.key))
    gone = write_gone(keys, path)
    replaced = spark.read.schema(keys.schema).parquet(f"{path}/gone")
    old = written(_of_keys(index, replaced).select("field", "term", "tf", "first_of_field"))
    parts = [(spark.table(table).select("field", "term", "tf", "first_of_field"), 1), (old, -1)]
    terms = all_of([term_statistics(rows).select("field", "term", (F.col("df") * n).alias("df"), (F.col("cf") * n).alias("cf")) for rows, n in parts])
    terms = terms.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).filter("df <> 0 OR cf <> 0")
    counts = ("n_docs", "n_terms", "n_postings")
    fields = all_of([field_statistics(rows).select("field", *[(F.col(c) * n).alias(c) for c in counts]) for rows, n in parts])
    fields = fields.groupBy("field").agg(*[F.sum(c).alias(c) for c in counts])
    _write_statistics(terms, fields, path)
    segments = (*index.segments, Segment(path, spark.table(table).count(), *gone))
    return _with_meta(spark, path, index.key, index.buckets, added, segments, (*index.tables, table))


def _of_keys(index: Index, keys: DataFrame) -> DataFrame:
    """Live postings of some documents; if they lie in few shards, other buckets are not read."""
    shards = [r[0] for r in keys.select(shard_of(F.col(index.key), index.buckets)).distinct().limit(MAX_PUSHED_SHARDS + 1).collect()]
    postings = index.postings
    if len(shards) <= MAX_PUSHED_SHARDS:
        postings = all_of([part.filter(F.col("shard").isin(shards)) for part in index.parts])
    return postings.join(broadcast_if_small(keys), index.key, "left_semi")


def _read_by_bucket(spark: SparkSession) -> contextlib.AbstractContextManager:
    """Tables are read bucket by bucket even where no aggregate or join asks for it."""
    return _setting(spark, "spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")


def merge_segments(index: Index, path: str) -> Index:
    """The index with all its segments as one new base at ``path``; nothing is analysed.

    A task reads, sorts and writes one bucket, as in a build, so what it holds
    follows the bucket and not the share of all postings that a scan would give it.
    """
    return _write_base(index.spark, index.postings, path, index.key, index.buckets, _read_by_bucket(index.spark))


def open_index(spark: SparkSession, path: str) -> Index:
    """An index that an earlier session wrote."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    ddl = ", ".join(f"`{name}` {kind}" for name, kind in meta["columns"])
    segments, tables = tuple(Segment(*s) for s in meta["segments"]), []
    for segment in segments:
        tables.append(_new_table_name())
        spark.sql(
            f"CREATE TABLE {tables[-1]} ({ddl}) USING parquet "
            f"CLUSTERED BY (shard) INTO {meta['buckets']} BUCKETS LOCATION '{segment.path}/postings'"
        )
    columns = tuple((name, kind) for name, kind in meta["columns"])
    return Index(spark, path, meta["key"], meta["buckets"], columns, segments, tuple(tables))


def close_index(index: Index) -> None:
    """Forget the session's names of the tables; their files stay."""
    for table in index.tables:
        index.spark.sql(f"DROP TABLE IF EXISTS {table}")


def clear_index(index: Index) -> None:
    """Leave every table of the index readable and without rows."""
    spark = index.spark
    empty = spark.createDataFrame([], ", ".join(f"`{name}` {kind}" for name, kind in index.columns))
    gone = spark.createDataFrame([], f"`{index.key}` {dict(index.columns)[index.key]}")
    for segment, table in zip(index.segments, index.tables, strict=True):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        _write_postings(empty, table, segment.path, index.buckets)
        _write_statistics(term_statistics(empty), field_statistics(empty), segment.path)
        write_gone(gone, segment.path)
