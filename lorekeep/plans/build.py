"""From files and commits to written documents and their index."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators.index import Index, build_index, close_index, merge_segments, open_index, update_index
from lorekeep.operators.ingest import (
    DOCUMENT_SCHEMA,
    assemble_documents,
    content_hash,
    document_id,
    filter_hidden,
    resolve_stems,
    scan_documents,
    split_rejects,
    stem,
)
from lorekeep.operators.joins import broadcast_if_small, clear_scratch, scratch, written
from lorekeep.operators.metadata import decode_metadata, last_change
from lorekeep.operators.segments import Segment, all_of, live, to_be_merged, write_gone
from lorekeep.plans import versions


def source_files(files: DataFrame) -> DataFrame:
    """Supported, visible files, one per stem."""
    return resolve_stems(filter_hidden(scan_documents(files)))


def metadata_records(commits: DataFrame) -> DataFrame:
    """Latest change of each path as the JSON record kept beside the file."""
    return last_change(commits).select(
        "path", F.to_json(F.struct(F.col("updated").cast("string").alias("updated"), "author_name", "author_email")).alias("json")
    )


def file_metadata(commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid metadata with the time as an instant, and the rejects.

    Times without a zone are read as UTC, whatever the session's zone.
    """
    valid, rejects = decode_metadata(metadata_records(commits))
    return _dated(valid), rejects


def _dated(valid: DataFrame) -> DataFrame:
    zoned = F.when(F.col("updated").rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.col("updated")).otherwise(
        F.concat("updated", F.lit("Z"))
    )
    return valid.withColumn("updated", F.try_to_timestamp(zoned))


def documents_of(files: DataFrame, commits: DataFrame, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents ready for the index, and those that are not with the reason.

    A reason that the files come with, such as a text that is not UTF-8, stays.
    """
    metadata, _ = file_metadata(commits)
    given = "reason" in files.columns and "reason" not in (keep or [])
    found = assemble_documents(source_files(files), metadata, [*(keep or []), *(["reason"] if given else [])])
    accepted, rejected = split_rejects(found)
    return (accepted.drop("reason") if given else accepted), rejected


@dataclass(frozen=True)
class Library:
    """Written documents and the index over them."""

    index: Index
    documents: DataFrame


def write_documents(documents: DataFrame, path: str) -> DataFrame:
    documents.write.mode("overwrite").parquet(path)
    return documents.sparkSession.read.parquet(path)


def build_library(files: DataFrame, commits: DataFrame, path: str, buckets: int | None = None) -> Library:
    """The whole batch job: files with path, text and html; commits by path."""
    with scratch(files.sparkSession):
        accepted, _ = documents_of(files, commits)
        documents = write_documents(accepted, f"{path}/documents")
        return Library(build_index(documents, f"{path}/index", "id", buckets=buckets), documents)


# ------------------------------------------------------- keeping a library current

#: Attempts to publish before a writer that always comes second gives up.
ATTEMPTS = 20
#: Beside its documents a segment has: the manifest (with replaced entries of its
#: own, as a file may get a new time and stay the same document), the latest change
#: of each path, and sources that are no documents (yet).
DOCUMENTS = DOCUMENT_SCHEMA.replace("updated_on string", "updated_on timestamp")
MANIFEST = "path string, id string, body string, length bigint, modified timestamp"
CHANGES = "path string, updated string, author_name string, author_email string, seq bigint"
WAITING = "id string, path string, text string, html string"


@dataclass(frozen=True)
class State:
    """A version of a library, opened."""

    version: versions.Version
    index: Index
    documents: DataFrame
    manifest: DataFrame
    waiting: DataFrame
    changes: DataFrame

    def segments(self, name: str = "segments") -> tuple[Segment, ...]:
        return tuple(Segment(*s) for s in self.version.content[name])


def _open(spark: SparkSession, version: versions.Version) -> State:
    segments = tuple(Segment(*s) for s in version.content["segments"])
    entries = tuple(Segment(*s) for s in version.content["entries"])

    def table(parts: tuple[Segment, ...], name: str, schema: str) -> DataFrame:
        return all_of(live(spark, parts, "id", lambda i: spark.read.schema(schema).parquet(f"{parts[i].path}/{name}")))

    changes = spark.read.schema(CHANGES).parquet(*[f"{s.path}/changes" for s in segments])
    index = open_index(spark, f"{segments[-1].path}/index")
    documents, waiting = table(segments, "documents", DOCUMENTS), table(segments, "waiting", WAITING)
    return State(version, index, documents, table(entries, "manifest", MANIFEST), waiting, changes)


def current_version(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """Number and newest folder of the version published last; 0 and none before the first."""
    version = versions.current(spark, path)
    return (version.number, version.content["segments"][-1][0]) if version else (0, None)


def open_library(spark: SparkSession, path: str) -> tuple[Library, DataFrame]:
    """The published library at ``path`` and its manifest (path, id, body, length, modified)."""
    version = versions.current(spark, path)
    if version is None:
        raise ValueError(f"no library has been published at {path}")
    state = _open(spark, version)
    return Library(state.index, state.documents), state.manifest


def _latest(changes: DataFrame) -> DataFrame:
    """Latest change of each path, of rows that are such already."""
    record = F.struct("updated", "author_name", "author_email", "seq")
    return changes.groupBy("path").agg(F.max_by(record, "seq").alias("r")).select("path", "r.*")


def _metadata_of(state: State | None, new: DataFrame, paths: DataFrame) -> DataFrame:
    """Valid metadata of some paths: from their new changes, else from the kept ones."""
    wanted = broadcast_if_small(paths)
    known = new if state is None else state.changes.unionByName(new)
    records = _latest(known.join(wanted, "path", "left_semi"))
    json = F.to_json(F.struct("updated", "author_name", "author_email"))
    return _dated(decode_metadata(records.select("path", json.alias("json")))[0])


def _as_changes(commits: DataFrame) -> DataFrame:
    """Latest change of each path among some commits."""
    last = last_change(commits.filter(F.col("path").isNotNull()))
    return last.select("path", F.col("updated").cast("string").alias("updated"), "author_name", "author_email", F.col("seq").cast("bigint").alias("seq"))


def _extend(
    spark: SparkSession, path: str, state: State | None, fresh: DataFrame, beside: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
    gone: DataFrame, changes: DataFrame, facts: dict, buckets: int | None, renewed: DataFrame | None = None,
) -> Library:
    """Write a segment and publish the version that ends with it; raises ``versions.Taken`` if that comes too late.

    What is written follows the change, unless the segments are to be merged.
    ``beside`` gives the manifest and the sources that wait, from the written
    documents.  ``gone`` has the ids of documents that are replaced or removed,
    ``renewed`` those of further entries of the manifest that are replaced.  The
    scratch tables that all of these come from are deleted before the index is made.
    """
    number = versions.next_number(spark, path)
    folder = f"{path}/segment-{number}-{uuid.uuid4().hex}"
    try:
        documents = write_documents(fresh, f"{folder}/documents")
        manifest, waiting = beside(documents)
        manifest.write.parquet(f"{folder}/entries/manifest")
        waiting.write.parquet(f"{folder}/waiting")
        changes.write.parquet(f"{folder}/changes")
        segments = (Segment(folder, documents.count(), *write_gone(gone, folder)),)
        replaced = gone if renewed is None else gone.unionByName(renewed)
        entries = (Segment(f"{folder}/entries", segments[0].rows, *write_gone(replaced, f"{folder}/entries")),)
        gone = spark.read.schema(gone.schema).parquet(f"{folder}/gone")
        clear_scratch(spark)
        if state is None:
            index = build_index(documents, f"{folder}/index", "id", buckets=buckets)
        else:
            index = update_index(state.index, documents, f"{folder}/index", removed=gone)
            segments, entries = state.segments() + segments, state.segments("entries") + entries
        content = {
            "segments": [s.as_list() for s in segments], "entries": [s.as_list() for s in entries],
            "folders": [s.path for s in segments], **facts,
        }
        if to_be_merged(segments) or to_be_merged(entries) or to_be_merged(index.segments):
            content |= _merged(spark, path, versions.Version(number, content))
        # Claimed by number: a version that was published meanwhile has it.
        if (versions.current(spark, path) or versions.Version(0, {})).number != (state.version.number if state else 0):
            raise versions.Taken(number)
        published = versions.publish(spark, path, number, content)
    except versions.Taken:
        versions.delete(spark, folder)
        raise
    # The session's names of the tables so far; the new version has its own.
    close_index(index)
    state = _open(spark, published)
    return Library(state.index, state.documents)


def _merged(spark: SparkSession, path: str, version: versions.Version) -> dict:
    """The segments of a version as one."""
    state = _open(spark, version)
    folder = f"{path}/segment-{version.number}-{uuid.uuid4().hex}"
    documents = write_documents(state.documents, f"{folder}/documents")
    state.manifest.write.parquet(f"{folder}/entries/manifest")
    state.waiting.write.parquet(f"{folder}/waiting")
    _latest(state.changes).write.parquet(f"{folder}/changes")
    merge_segments(state.index, f"{folder}/index")
    close_index(state.index)
    return _base(spark, folder, documents.count())


def _base(spark: SparkSession, folder: str, rows: int) -> dict:
    """What a version says of a single segment, which replaces nothing."""
    none = spark.createDataFrame([], "id string")
    parts = {name: Segment(place, rows, *write_gone(none, place)) for name, place in (("segments", folder), ("entries", f"{folder}/entries"))}
    return {name: [part.as_list()] for name, part in parts.items()} | {"folders": [folder]}


def _again(spark: SparkSession, work: Callable[[], Library]) -> Library:
    """Do the work on the current version, and again on the next one whenever another writer was first.

    What is written on the way is deleted; the library's own tables are not among it.
    """
    for _ in range(ATTEMPTS):
        try:
            with scratch(spark):
                return work()
        except versions.Taken:
            continue
    raise RuntimeError(f"{ATTEMPTS} times another writer published first")


def update_library(files: DataFrame, commits: DataFrame, path: str, buckets: int | None = None) -> Library:
    """Bring the library at ``path`` up to date with all its files and commits, or begin it.

    Where the files come with ``length`` and ``modificationTime``, only those are
    read for which these differ from the manifest; of the commits only those are
    read that are later than all seen before.  Hashes then tell which files are
    new or changed, and only these are assembled and analysed; what is gone is
    taken out.  One small file publishes the new tables together, so a search in
    between, and a job that fails, sees the version before; of two writers the
    second one starts again on what the first has published.  Nothing is
    published if nothing changed.  Files without text or complete metadata are
    looked at again each time.
    """
    return _again(files.sparkSession, lambda: _update(files, commits, path, buckets))


def _update(files: DataFrame, commits: DataFrame, path: str, buckets: int | None) -> Library:
    spark = files.sparkSession
    version = versions.current(spark, path)
    state = _open(spark, version) if version else None
    upto = version.content.get("commits_upto") if version else None
    later = commits if upto is None else commits.filter(F.col("seq") > upto)
    changes = written(_as_changes(later))
    upto = changes.agg(F.max("seq")).first()[0] or upto

    timed = {"length", "modificationTime"} <= set(files.columns)
    stamp = [F.col("length").cast("bigint").alias("length"), F.col("modificationTime").alias("modified")] if timed else [
        F.lit(None).cast("bigint").alias("length"), F.lit(None).cast("timestamp").alias("modified")]
    sources = source_files(files)
    # Names, and what the listing says: no text is read for these.
    listed = written(sources.select("path", *stamp))
    known = spark.createDataFrame([], MANIFEST) if state is None else state.manifest
    beside = known.select("path", "body", F.col("length").alias("was_length"), F.col("modified").alias("was_modified"))
    same = F.col("body").isNotNull() & (F.col("length") == F.col("was_length")) & (F.col("modified") == F.col("was_modified"))
    differ = listed.join(beside, "path", "left").filter(~F.coalesce(same, F.lit(False)))
    suspects = written(differ.select("path", "body", "length", "modified"))
    texts = sources.select("path", "text", "html", *(["modificationTime"] if timed else []))
    if timed:
        # Reaches the listing of files: older ones are not opened.
        earliest = suspects.agg(F.min("modified")).first()[0]
        texts = texts.filter(F.col("modificationTime") >= F.lit(earliest) if earliest else F.lit(False))
    texts = texts.join(broadcast_if_small(suspects.select("path")), "path", "left_semi").filter(F.col("text").isNotNull())
    hashed = texts.select("path", "text", "html", content_hash(F.col("text"), F.col("html")).alias("now"))
    read = written(hashed.join(broadcast_if_small(suspects), "path"))
    new = read.filter(F.col("body").isNull() | (F.col("body") != F.col("now")))
    # Files touched but not changed only get their new times.
    touched = read.filter((F.col("body") == F.col("now")) & F.col("modified").isNotNull()).select("path", "now", "length", "modified")

    metadata = _metadata_of(state, changes, new.select("path"))
    fresh = assemble_documents(new.select("path", "text", "html"), metadata)
    gone = listed.select("path", F.lit(True).alias("there"))
    gone = known.select("path").join(gone, "path", "left").filter(F.col("there").isNull()).select("path")
    # Files that are no longer text are no documents either.
    unreadable = suspects.filter(F.col("body").isNotNull()).select("path").join(read.select("path"), "path", "left_anti")
    replaced = new.filter(F.col("body").isNotNull()).select("path")
    if state is not None:
        # Documents whose latest change is new, with the text they have; if that change is incomplete, they go.
        renewed = known.select("path").join(broadcast_if_small(changes.select("path")), "path", "left_semi")
        renewed = renewed.join(new.select("path"), "path", "left_anti").join(gone.unionByName(unreadable), "path", "left_anti")
        renewed = written(renewed)
        replaced = replaced.unionByName(renewed)
        held = state.documents.select(F.col("file_name").alias("path"), F.col("content").alias("text"), "html")
        held = held.join(broadcast_if_small(renewed), "path", "left_semi")
        fresh = fresh.unionByName(assemble_documents(held, _metadata_of(state, changes, renewed)))
    fresh = written(split_rejects(fresh)[0])
    entries = read.select("path", F.col("now").alias("body"), "length", "modified")
    if state is not None:
        entries = entries.unionByName(
            known.select("path", "body", "length", "modified").join(broadcast_if_small(renewed), "path", "left_semi")
            .join(read.select("path"), "path", "left_anti")
        )
    entries = entries.select("path", document_id(F.col("path")).alias("id"), "body", "length", "modified")
    accepted = fresh.select(F.col("file_name").alias("path"))
    leaving = written(all_of([gone, unreadable, accepted, replaced]).distinct())
    if state is not None and leaving.isEmpty() and changes.isEmpty() and touched.isEmpty():
        return Library(state.index, state.documents)
    # A document that stays as it is may get a new entry.
    entries = entries.join(accepted.unionByName(touched.select("path")), "path", "left_semi")
    ids = leaving.select(document_id(F.col("path")).alias("id"))
    renewed_ids = touched.select(document_id(F.col("path")).alias("id"))
    none = spark.createDataFrame([], WAITING)
    facts = {"commits_upto": upto, "batches": version.content.get("batches", {}) if version else {}}
    return _extend(spark, path, state, fresh, lambda _: (entries, none), ids, changes, facts, buckets, renewed_ids)


def apply_drop(
    drop: DataFrame, path: str, stream: str, batch_id: int, buckets: int | None = None
) -> Library:
    """Bring the library at ``path`` forward by one batch of changes, just once for each batch of a stream.

    A row of ``drop`` has a ``kind``: ``file`` (path, text, html) and ``removed``
    (path), the last of a path by ``seq`` counting, or ``commit`` (path, seq,
    authored_at, author_name, author_email).  A file waits for its first commit,
    and so do sources that another format of the same stem wins over; rows of
    other kinds, or without path, change nothing.  Running a batch again
    publishes nothing.
    """
    return _again(drop.sparkSession, lambda: _apply(drop, path, stream, batch_id, buckets))


def _apply(drop: DataFrame, path: str, stream: str, batch_id: int, buckets: int | None) -> Library:
    spark = drop.sparkSession
    version = versions.current(spark, path)
    state = _open(spark, version) if version else None
    batches = version.content.get("batches", {}) if version else {}
    if state is not None and batches.get(stream, -1) >= batch_id:
        return Library(state.index, state.documents)
    rows = drop.filter(F.col("path").isNotNull())
    changes = written(_as_changes(rows.filter("kind = 'commit'")))
    last = rows.filter("kind IN ('file', 'removed')").groupBy("path").agg(
        F.max_by(F.struct("kind", "text", "html"), F.struct("seq", "kind")).alias("r")
    )
    incoming = written(filter_hidden(scan_documents(last.select("path", "r.*"))))
    names = incoming.select("path").unionByName(changes.select("path")).distinct()
    stems = written(names.select(stem(F.col("path")).alias("stem")).distinct())
    sources, old = incoming.filter("kind = 'file'").select("path", "text", "html"), incoming.select("path")
    if state is not None:
        held = state.documents.select(F.col("file_name").alias("path"), F.col("content").alias("text"), "html")
        held = held.unionByName(state.waiting.select("path", "text", "html")).withColumn("stem", stem(F.col("path")))
        held = held.join(broadcast_if_small(stems), "stem", "left_semi").drop("stem")
        old = old.unionByName(written(held.select("path")))
        # Of what is replaced no text is written.
        sources = sources.unionByName(written(held.join(incoming.select("path"), "path", "left_anti")))
    winners = resolve_stems(sources).select("path", "text", "html")
    metadata = _metadata_of(state, changes, winners.select("path"))
    fresh = split_rejects(assemble_documents(winners, metadata))[0]

    def beside(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
        waiting = sources.join(documents.select(F.col("file_name").alias("path")), "path", "left_anti")
        waiting = waiting.select(document_id(F.col("path")).alias("id"), "path", "text", "html")
        return documents.select(
            F.col("file_name").alias("path"), "id", content_hash(F.col("content"), F.col("html")).alias("body"),
            F.lit(None).cast("bigint").alias("length"), F.lit(None).cast("timestamp").alias("modified"),
        ), waiting

    gone = old.select(document_id(F.col("path")).alias("id"))
    upto = changes.agg(F.max("seq")).first()[0]
    before = version.content.get("commits_upto") if version else None
    facts = {
        "commits_upto": max((x for x in (upto, before) if x is not None), default=None), "batches": batches | {stream: batch_id},
    }
    return _extend(spark, path, state, fresh, beside, gone, changes, facts, buckets)


def clear_library(spark: SparkSession, path: str) -> Library:
    """Publish a version without documents, postings, manifest rows and kept changes."""

    def work() -> Library:
        version = versions.current(spark, path)
        if version is None:
            raise ValueError(f"no library has been published at {path}")
        state = _open(spark, version)
        number = versions.next_number(spark, path)
        folder = f"{path}/segment-{number}-{uuid.uuid4().hex}"
        documents = write_documents(state.documents.limit(0), f"{folder}/documents")
        for name, rows in (("entries/manifest", state.manifest), ("waiting", state.waiting), ("changes", state.changes)):
            rows.limit(0).write.parquet(f"{folder}/{name}")
        build_index(documents, f"{folder}/index", "id", buckets=state.index.buckets)
        content = _base(spark, folder, 0) | {"commits_upto": None, "batches": version.content["batches"]}
        try:
            cleared = _open(spark, versions.publish(spark, path, number, content))
        except versions.Taken:
            versions.delete(spark, folder)
            raise
        return Library(cleared.index, cleared.documents)

    return _again(spark, work)
