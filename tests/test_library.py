"""A library kept current: writers side by side, drops, what is read and what is left."""

import os

import pytest
from pyspark.sql import functions as F

from lorekeep.plans import build, versions
from lorekeep.plans.answer import answer_queries
from lorekeep.plans.build import apply_drop, build_library, clear_library, current_version, documents_of, open_library, update_library
from lorekeep.sources.files import read_document_files
from lorekeep.sources.shared import shared_folder
from lorekeep.streaming.library import DROP_SCHEMA, read_drops, start_ingest

FILES = "path string, text string, html string"
COMMITS = "path string, seq long, authored_at string, author_name string, author_email string"


def commit(path, seq, name="ann"):
    return (path, seq, "2024-01-01 00:00:00", name, "a@e")


def files_of(spark, texts):
    return spark.createDataFrame([(p, t, "<p>") for p, t in texts.items()], FILES)


def texts_of(library):
    return {r.file_name: (r.content, r.updated_by) for r in library.documents.collect()}


def same(library, whole):
    assert sorted(library.documents.collect()) == sorted(whole.documents.collect())
    assert sorted(library.index.postings.collect()) == sorted(whole.index.postings.collect())
    assert sorted(library.index.terms.collect()) == sorted(whole.index.terms.collect())
    assert sorted(library.index.fields.collect()) == sorted(whole.index.fields.collect())


def test_of_two_writers_neither_is_lost(spark, tmp_path, monkeypatch):
    """Both read one version; the second one finds its number taken and starts again on what the first has published."""
    place = str(tmp_path / "lib")
    commits = spark.createDataFrame([commit(f"{n}.md", i) for i, n in enumerate("abcd")], COMMITS)
    update_library(files_of(spark, {"a.md": "alpha"}), commits, place, buckets=2)
    publish, raced = versions.publish, []

    def late(session, path, number, content):
        if not raced:
            raced.append(number)
            # Just before this one publishes, another writer does.
            apply_drop(spark.createDataFrame([("file", "b.md", 1, "beta", "<p>", None, None, None)], DROP_SCHEMA), place, "other", 0)
        return publish(session, path, number, content)

    monkeypatch.setattr(versions, "publish", late)
    drop = spark.createDataFrame([("file", "c.md", 1, "gamma", "<p>", None, None, None)], DROP_SCHEMA)
    library = apply_drop(drop, place, "drops", 0)
    assert raced == [2] and current_version(spark, place)[0] == 3
    assert set(texts_of(library)) == {"a.md", "b.md", "c.md"} == set(texts_of(open_library(spark, place)[0]))
    with pytest.raises(versions.Taken):
        publish(spark, place, 3, {})
    # A number that was claimed and never written is passed over.
    open(f"{place}/versions/{4:012d}.json", "w").close()
    assert current_version(spark, place)[0] == 3
    apply_drop(spark.createDataFrame([("removed", "c.md", 2, None, None, None, None, None)], DROP_SCHEMA), place, "drops", 1)
    assert current_version(spark, place)[0] == 5 and set(texts_of(open_library(spark, place)[0])) == {"a.md", "b.md"}


def test_old_versions_are_deleted_and_the_last_ones_stay_readable(spark, tmp_path):
    place = str(tmp_path / "lib")
    commits = spark.createDataFrame([commit("a.md", 1), commit("b.md", 2)], COMMITS)
    for i in range(5):
        whole = files_of(spark, {"a.md": "alpha " * (i + 1), "b.md": "beta", **{f"x{k}.md": "no commit" for k in range(2)}})
        library = update_library(whole, commits, place, buckets=2)
    folders = set(versions.folders(spark, place))
    versions.keep_last(spark, place, 2)
    left = set(versions.folders(spark, place))
    assert left < folders and versions.numbers(spark, place) == [4, 5]
    same(open_library(spark, place)[0], build_library(whole, commits, str(tmp_path / "whole"), buckets=2))
    assert texts_of(library)["a.md"][0] == "alpha " * 5


def test_three_drops_and_a_batch_run_again_equal_a_batch_build(spark, tmp_path):
    """Waiting files, a stem that another format wins, a removed winner, later commits, and one version for each batch."""
    place, folder = str(tmp_path / "lib"), str(tmp_path / "drops")
    put = lambda path, seq, text: ("file", path, seq, text, "<p>", None, None, None)
    gone = lambda path, seq: ("removed", path, seq, None, None, None, None, None)
    by = lambda *c: ("commit", c[0], c[1], None, None, c[2], c[3], c[4])
    drops = [
        [put("a.md", 1, "old"), put("a.md", 2, "alpha"), put("a.txt", 1, "loses"), put("b.org", 1, "beta"), put("w.md", 1, "waits"),
         by(*commit("a.md", 1)), by(*commit("a.txt", 2)), by(*commit("b.org", 3)), put("_h.md", 1, "hidden"), put(None, 1, "lost")],
        [by(*commit("w.md", 5)), by(*commit("b.org", 6, "bob")), put("c.rst", 3, "gamma"), by(*commit("c.rst", 7)), ("other", "a.md", 9, "x", None, None, None, None)],
        [gone("a.md", 4), put("b.org", 4, "beta two"), gone("never.md", 1), by(*commit("c.rst", 4, "late"))],
    ]
    seen = []
    for rows in drops:
        spark.createDataFrame(rows, DROP_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        start_ingest(read_drops(spark, folder), place, "drops", str(tmp_path / "state"), buckets=2).awaitTermination()
        seen.append(current_version(spark, place)[0])
    again = apply_drop(spark.createDataFrame(drops[2], DROP_SCHEMA), place, "drops", 2)
    assert seen == [1, 2, 3] and current_version(spark, place)[0] == 3
    files = files_of(spark, {"a.txt": "loses", "b.org": "beta two", "w.md": "waits", "c.rst": "gamma"})
    commits = [r[1:3] + (r[5], r[6], r[7]) for rows in drops for r in rows if r[0] == "commit"]
    whole = build_library(files, spark.createDataFrame(commits, COMMITS), str(tmp_path / "whole"), buckets=2)
    same(again, whole)
    assert texts_of(again) == {"a.txt": ("loses", "ann"), "b.org": ("beta two", "bob"), "w.md": ("waits", "ann"), "c.rst": ("gamma", "ann")}
    clear_library(spark, place)
    assert texts_of(open_library(spark, place)[0]) == {}


def plans_of_written(monkeypatch):
    """Plans of the tables that a build writes on its way."""
    plans, kept = [], build.written

    def recorded(rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return kept(rows)

    monkeypatch.setattr(build, "written", recorded)
    return plans


def test_what_a_drop_writes_on_the_way_is_gone_before_the_index_is_made(spark, tmp_path, monkeypatch):
    """A drop is not copied, and the texts of an update are in its segment alone while postings are written."""
    place, left, copied = str(tmp_path / "lib"), [], []
    folder = os.path.join(shared_folder(spark).removeprefix("file:"), "lorekeep")

    def seen(make):
        def run(*args, **kwargs):
            left.extend(f for name in os.listdir(folder) if name.startswith("scratch-") for _, _, files in os.walk(f"{folder}/{name}") for f in files)
            return make(*args, **kwargs)

        return run

    def counted(rows, write=build.written):
        copied.extend(rows.select("path").collect() if "text" in rows.columns else [])
        return write(rows)

    monkeypatch.setattr(build, "build_index", seen(build.build_index))
    monkeypatch.setattr(build, "update_index", seen(build.update_index))
    monkeypatch.setattr(build, "written", counted)
    for n in range(2):
        rows = [("file", f"{c}.md", n, f"text {n}", "<p>", None, None, None) for c in "abcd"[2 * n :]]
        rows += [("commit", f"{c}.md", n, None, None, *commit("", 0)[2:]) for c in "abcd"[2 * n :]]
        rows += [("file", "a.org", 5, "waits", "<p>", None, None, None)] if n else []
        spark.createDataFrame(rows, DROP_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        start_ingest(read_drops(spark, str(tmp_path / "in")), place, "drops", str(tmp_path / "state"), buckets=2).awaitTermination()
    library, manifest = open_library(spark, place)
    assert texts_of(library) == {"a.md": ("text 0", "ann"), "b.md": ("text 0", "ann"), "c.md": ("text 1", "ann"), "d.md": ("text 1", "ann")}
    assert left == [] and manifest.count() == 4 and library.index.postings.filter("field = 'title'").count() == 4
    # Four files, then three and of those held the one that another format of its stem may win over.
    assert sorted(r.path for r in copied) == sorted(["a.md", "b.md", "c.md", "d.md", "c.md", "d.md", "a.org", "a.md"])


def test_only_files_that_look_different_are_read(spark, tmp_path, monkeypatch):
    """Length and time tell which files to read; the scan of texts is told the earliest time of these."""
    folder, place = tmp_path / "wiki", str(tmp_path / "lib")
    folder.mkdir()
    for i in range(30):
        (folder / f"f{i}.md").write_text(f"text {i}")
        os.utime(folder / f"f{i}.md", (1_700_000_000 + i, 1_700_000_000 + i))
    commits = spark.createDataFrame([commit(f"f{i}.md", i) for i in range(30)], COMMITS)
    listing = lambda: read_document_files(spark, str(folder)).withColumn("html", F.lit(""))
    library = update_library(listing(), commits, place, buckets=2)
    assert library.documents.count() == 30
    # One is changed, one only touched, one new and older than all, one gone, one no longer text.
    (folder / "f3.md").write_text("changed 3")
    os.utime(folder / "f4.md", (1_800_000_000, 1_800_000_000))
    (folder / "f5.md").unlink()
    (folder / "f6.md").write_bytes(b"\xff\xfe")
    plans = plans_of_written(monkeypatch)
    now = update_library(listing(), commits, place, buckets=2)
    assert any("GreaterThanOrEqual(modificationTime" in p for p in plans)
    same(now, build_library(listing().filter("reason IS NULL"), commits, str(tmp_path / "whole"), buckets=2))
    number = current_version(spark, place)[0]
    update_library(listing(), commits, place, buckets=2)
    assert current_version(spark, place)[0] == number
    touched = {r.path: r.modified.timestamp() for r in open_library(spark, place)[1].collect()}
    assert touched["f4.md"] == 1_800_000_000 and "f6.md" not in touched


def test_old_commits_are_not_read_again(spark, tmp_path):
    """What is kept of commits is the latest change of each path; only later ones are looked at."""
    place = str(tmp_path / "lib")
    texts = {"a.md": "alpha", "b.md": "beta"}
    first = [commit("a.md", 1), commit("b.md", 2), commit("a.md", 3, "bob")]
    update_library(files_of(spark, texts), spark.createDataFrame(first, COMMITS), place, buckets=2)
    # The old commits are gone from the log, and the later ones are enough.
    later = [commit("b.md", 9, "eve")]
    library = update_library(files_of(spark, texts), spark.createDataFrame(later, COMMITS), place, buckets=2)
    whole = build_library(files_of(spark, texts), spark.createDataFrame(first + later, COMMITS), str(tmp_path / "whole"), buckets=2)
    same(library, whole)
    assert texts_of(library) == {"a.md": ("alpha", "bob"), "b.md": ("beta", "eve")}
    # A later change without an address: no document until the next one, as in a batch build.
    states = [(*commit("a.md", 11)[:4], None)], [commit("a.md", 12, "joe")]
    for more in states:
        later += more
        library = update_library(files_of(spark, texts), spark.createDataFrame(more, COMMITS), place, buckets=2)
        whole = build_library(files_of(spark, texts), spark.createDataFrame(first + later, COMMITS), str(tmp_path / f"whole-{len(later)}"), buckets=2)
        same(library, whole)
    assert texts_of(library)["a.md"] == ("alpha", "joe")
    plan = spark.createDataFrame(first + later, COMMITS)
    plan.write.parquet(str(tmp_path / "log"))
    narrowed = spark.read.parquet(str(tmp_path / "log")).filter(F.col("seq") > versions.current(spark, place).content["commits_upto"])
    assert narrowed.count() == 0


def test_answers_carry_their_highlights_on_request(spark, tmp_path):
    texts = {"a-b.md": "the quick dogs run", "c.md": "no animals here"}
    commits = spark.createDataFrame([commit(p, i) for i, p in enumerate(texts)], COMMITS)
    library = build_library(files_of(spark, texts), commits, str(tmp_path / "lib"), buckets=2)
    queries = spark.createDataFrame([(1, "dog", 0, None), (2, "c", 0, None)], "query_id long, text string, page int, user_id string")
    answers = answer_queries(queries, library, "http://h/w/", highlighted=True)
    got = {r.query_id: (r.title, r.highlight) for r in answers.rows.collect()}
    assert got == {1: ("a b", "the quick *dogs* run\n"), 2: ("c", None)}
    assert "highlight" not in answer_queries(queries, library, "http://h/w/").rows.columns


def test_the_reason_of_a_file_reaches_the_rejects(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"\xff\xfe")
    (tmp_path / "b.md").write_text("fine")
    files = read_document_files(spark, str(tmp_path)).withColumn("html", F.lit(""))
    commits = spark.createDataFrame([commit("a.md", 1), commit("b.md", 2)], COMMITS)
    accepted, rejected = documents_of(files, commits)
    assert [(r.file_name, r.reason) for r in rejected.collect()] == [("a.md", "not UTF-8")]
    assert "reason" not in accepted.columns and accepted.count() == 1
