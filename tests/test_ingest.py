import pytest
from pyspark.sql import functions as F

from lorekeep.operators import ingest, metadata
from lorekeep.plans.build import (
    build_library,
    clear_library,
    current_version,
    documents_of,
    open_library,
    update_library,
)
from lorekeep.sources.files import read_document_files


def paths(spark, names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def test_scan_and_hidden(spark):
    names = ["a.md", "U.MD", "b/c.org", "_k=v/z.md", "_k=w.md", "x/.git/y.txt", "x/y._md", "noext", "d.e/f"]
    df = paths(spark, names)
    assert {r.path for r in ingest.scan_documents(df).collect()} == {"a.md", "b/c.org", "_k=v/z.md", "_k=w.md", "x/.git/y.txt"}
    assert {r.path for r in ingest.filter_hidden(df).collect()} == {"a.md", "U.MD", "b/c.org", "x/y._md", "noext", "d.e/f"}


def test_read_document_files(spark, tmp_path):
    for name in ["a.md", "b/c-d.txt", "_k=v/z.md", "_k=w.md", "U.MD", ".h/x.md", "p.png"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"text of {name}", encoding="utf-8")
    rows = read_document_files(spark, str(tmp_path)).collect()
    assert {(r.path, r.text) for r in rows} == {("a.md", "text of a.md"), ("b/c-d.txt", "text of b/c-d.txt")}


def test_relative_path(values):
    build = lambda p: ingest.relative_path(p, F.lit("/srv/wiki/"))
    assert values(build, ["/srv/wiki/a/b.md", "/srv/wikis/a.md", "a.md"]) == ["a/b.md", "/srv/wikis/a.md", "a.md"]


def test_one_source_per_stem(spark):
    df = paths(spark, ["a.txt", "a.org", "b.rst", "x/a.md", "c.d.md", "c.md"])
    got = {r.stem: r.path for r in ingest.resolve_stems(df).collect()}
    assert got == {"a": "a.org", "b": "b.rst", "x/a": "x/a.md", "c.d": "c.d.md", "c": "c.md"}


def test_formats(values):
    assert values(ingest.source_format, ["a.md", "a.org", "a.rst", "a.txt"]) == ["gfm", "org", "rst", "markdown"]
    assert set(values(lambda p: ingest.source_format(p, True), ["a.md", "a.org"])) == {"markdown"}


def test_titles_and_ids(values):
    assert values(ingest.title_from_path, ["x/b-c.d.md", "A_b-c", "é-f.txt"]) == ["b c.d", "A_b c", "é f"]
    import hashlib

    names = ["a.md", "日本.md"]
    assert values(ingest.document_id, names) == [hashlib.sha1(n.encode()).hexdigest() for n in names]


def test_latest_change_is_in_commit_order(spark):
    rows = [("a", 1, "2024-05-02", "x", "x@e"), ("a", 2, "2024-05-01", "y", "y@e"), ("b", 3, "2024-01-01", "z", None)]
    df = spark.createDataFrame(rows, "path string, seq long, authored_at string, author_name string, author_email string")
    got = {r.path: (r.updated, r.author_name) for r in metadata.last_change(df).collect()}
    assert got == {"a": ("2024-05-01", "y"), "b": ("2024-01-01", "z")}


def test_commit_lines(spark):
    rows = [("t\tn\te\n",), ("t\tn\n",), ("t\tn\te\tx\n",), ("",)]
    got = [tuple(r)[1:] for r in metadata.parse_commit_lines(spark.createDataFrame(rows, "line string")).collect()]
    assert got == [("t", "n", "e"), (None, None, None), (None, None, None), (None, None, None)]


def test_metadata_rejects(spark):
    rows = [
        ("a", '{"updated":"2024-01-01","author_name":"n","author_email":"e","title":"T"}'),
        ("b", '{"updated":"2024-01-01","author_name":"n"}'),
        ("c", "no json"),
        ("d", None),
    ]
    df = spark.createDataFrame(rows, "path string, json string")
    valid, rejects = metadata.decode_metadata(df)
    assert [r.path for r in valid.collect()] == ["a"]
    assert {r.path: r.reason for r in rejects.collect()} == {
        "b": "missing: author_email",
        "c": "missing: updated,author_name,author_email",
        "d": "missing: updated,author_name,author_email",
    }
    assert metadata.require_metadata(df.filter("path = 'a'")).count() == 1
    with pytest.raises(Exception, match="undecodable metadata"):
        metadata.require_metadata(df).collect()


def test_dates(spark, values):
    build = lambda v: F.unix_millis(ingest.parse_updated_on(v))
    cases = ["2024-01-01T02:00:00+02:00", "2024-01-01", "1704067200000", "soon", "123", None, "9" * 30, "2024", "2024-01",
             "2024-01-01T00:00:00", "2024-01-01 00:00:00.000", "2024-01-01T00:00:00Z", "2024-13"]
    wanted = [1704067200000, 1704067200000, 1704067200000, None, 123, None, None, *[1704067200000] * 5, None]
    assert values(build, cases) == wanted
    for zone in ("America/New_York", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert values(build, cases) == wanted
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_changes(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    then = spark.createDataFrame([("a", "1"), ("b", "0"), ("gone", "9")], "path string, hash string")
    assert {(r.path, r.state) for r in ingest.changed_documents(now, then).collect()} == {("b", "changed"), ("c", "new")}
    assert [r.path for r in ingest.removed_documents(now, then).collect()] == ["gone"]


def test_hash_counts_metadata_only_when_given(spark):
    df = spark.createDataFrame([("t", "x"), ("t", "y"), ("t", None)], "text string, author string")
    assert df.select(ingest.content_hash(F.col("text"))).distinct().count() == 1
    assert df.select(ingest.content_hash(F.col("text"), F.col("author"))).distinct().count() == 3


def test_upsert_last_write_wins_and_repeats_harmlessly(spark):
    schema = "id string, content string, version long"
    stored = spark.createDataFrame([("a", "old", 0), ("b", "old", 0)], schema)
    writes = spark.createDataFrame([("a", "v2", 2), ("a", "v1", 1), ("c", "new", 1), ("c", "new", 1)], schema)
    once = ingest.upsert(stored, writes)
    want = {("a", "v2", 2), ("b", "old", 0), ("c", "new", 1)}
    assert {tuple(r) for r in once.collect()} == want and once.count() == 3
    assert sorted(tuple(r) for r in ingest.upsert(once, writes).collect()) == sorted(want)


def test_upsert_loses_nothing(spark):
    schema = "id string, version long, content string"
    stored = spark.createDataFrame([("a", 5, "held"), ("b", 1, "held"), ("c", 1, "held"), ("d", None, "held")], schema)
    writes = spark.createDataFrame(
        [("a", 2, "stale"), ("b", None, "no version"), (None, 9, "no key"), ("c", 3, "y"), ("c", 3, "x"), ("c", 2, "z"),
         ("d", 0, "first"), ("e", None, "no version"), ("b", 1, "as high")],
        schema,
    )
    wanted = {("a", 5, "held"), ("b", 1, "as high"), ("c", 3, "y"), ("d", 0, "first")}
    for order in (writes, writes.orderBy(F.desc("content"))):
        assert sorted(tuple(r) for r in ingest.upsert(stored, order.repartition(3)).collect()) == sorted(wanted)
    _, rejects = ingest.split_writes(writes)
    assert sorted(r.reason for r in rejects.collect()) == ["missing id", "missing version", "missing version"]


def test_files_that_are_not_utf8_are_rejected(spark, tmp_path):
    (tmp_path / "good.md").write_text("caf\u00e9", encoding="utf-8")
    (tmp_path / "bad.md").write_bytes(b"caf\xe9")
    got = {r.path: (r.text, r.reason) for r in read_document_files(spark, str(tmp_path)).collect()}
    assert got == {"good.md": ("caf\u00e9", None), "bad.md": (None, "not UTF-8")}


def test_upsert_with_one_hot_key(spark):
    stored = spark.range(1000).selectExpr("cast(id as string) id", "'old' content", "-1L version")
    writes = spark.range(30000).selectExpr(
        "cast(if(id % 3 = 0, 7, id % 500) as string) id", "concat('w', id) content", "id version"
    )
    got = {r.id: r.content for r in ingest.upsert(stored, writes).collect()}
    want = {str(i): "old" for i in range(1000)}
    for i in range(30000):
        want[str(7 if i % 3 == 0 else i % 500)] = f"w{i}"
    assert got == want


def test_contents_of_nested_headings(spark):
    html = "<h1>Top <em>one</em></h1><p>x</p><h2 class='s'>Sub &amp; so</h2><h3>Deep\nhere</h3><h4>open</h5><header>no</header>"
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    got = [(r.ord, r.level, r.heading, r.anchor) for r in ingest.page_contents(df).orderBy("ord").collect()]
    assert got == [(1, 1, "Top one", "top-one"), (2, 2, "Sub & so", "sub-so"), (3, 3, "Deep here", "deep-here")]


def test_json_round_trip(spark):
    row = ("i", 'quo"te\n', "<p>", "f.md", "tï", "me", "2024-01-01T00:00:00Z")
    df = spark.createDataFrame([row], ingest.DOCUMENT_SCHEMA)
    assert [tuple(r) for r in ingest.from_json_lines(ingest.to_json_lines(df)).collect()] == [row]


def test_build_from_files_to_index(spark, tmp_path):
    files = spark.createDataFrame(
        [("a-b.md", "alpha beta", "<p>"), ("a-b.txt", "gamma", "<p>"), ("_x.md", "alpha", "<p>"), ("c.org", "alpha", "<p>")],
        "path string, text string, html string",
    )
    commits = spark.createDataFrame(
        [("a-b.md", 1, "2024-01-01 00:00:00", "ann", "a@e"), ("c.org", 2, "2024-01-01 00:00:00", "bob", None)],
        "path string, seq long, authored_at string, author_name string, author_email string",
    )
    accepted, rejected = documents_of(files, commits)
    assert [(r.title, r.updated_by) for r in accepted.collect()] == [("a b", "ann")] and rejected.count() == 0
    library = build_library(files, commits, str(tmp_path / "lib"))
    assert {(r.field, r.term) for r in library.index.postings.collect()} == {
        ("title", "a"), ("title", "b"), ("content", "alpha"), ("content", "beta")
    }
    assert library.documents.count() == 1


def test_a_library_is_kept_current(spark, tmp_path):
    place = str(tmp_path / "lib")
    schema = "path string, text string, html string"
    commit_schema = "path string, seq long, authored_at string, author_name string, author_email string"
    commit = lambda path, seq, name="ann": (path, seq, "2024-01-01 00:00:00", name, "a@e")

    def update(texts, commits):
        files = spark.createDataFrame([(p, t, "<p>") for p, t in texts.items()], schema)
        changes = spark.createDataFrame(commits, commit_schema)
        library = update_library(files, changes, place, buckets=2)
        whole = build_library(files, changes, str(tmp_path / f"whole-{len(numbers)}"), buckets=2)
        assert sorted(library.documents.collect()) == sorted(whole.documents.collect())
        assert sorted(library.index.postings.collect()) == sorted(whole.index.postings.collect())
        assert sorted(library.index.terms.collect()) == sorted(whole.index.terms.collect())
        opened, manifest = open_library(spark, place)
        assert sorted(opened.documents.collect()) == sorted(library.documents.collect())
        assert {r.path for r in manifest.collect()} == {r.file_name for r in library.documents.collect()}
        numbers.append(current_version(spark, place)[0])

    numbers = []
    commits = [commit("a.md", 1), commit("b.md", 2), commit("c.org", 3)]
    update({"a.md": "alpha", "b.md": "beta", "nothing.md": "no commit", "_x.md": "hidden"}, commits)
    update({"a.md": "alpha", "b.md": "beta", "nothing.md": "no commit"}, commits)
    update({"a.md": "alpha again", "c.org": "gamma", "nothing.md": "no commit"}, commits)
    update({"a.md": "alpha again", "c.org": "gamma"}, [*commits, commit("c.org", 9, "bob")])
    # The second call found nothing to do.
    assert numbers == [1, 1, 2, 3]
    cleared = clear_library(spark, place)
    assert cleared.documents.count() == cleared.index.postings.count() == open_library(spark, place)[1].count() == 0
    update({"a.md": "alpha"}, commits)
