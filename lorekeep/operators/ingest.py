"""From files of a folder tree to documents ready for the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import plain_text
from lorekeep.operators.joins import broadcast_if_small, written

# Document formats in the order in which they win a stem.
SUPPORTED_EXTENSIONS = ["md", "org", "rst", "txt"]


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def stem(path: Column) -> Column:
    """The path without its last extension."""
    return F.regexp_replace(path, r"\.[^./]*$", "")


def is_hidden(path: Column) -> Column:
    """Whether any component of the path starts with a dot or an underscore."""
    return path.rlike(r"(^|/)[._]")


def scan_documents(files: DataFrame) -> DataFrame:
    """Files whose extension, in lower case only, is a document format."""
    return files.filter(extension(F.col("path")).isin(SUPPORTED_EXTENSIONS))


def filter_hidden(files: DataFrame) -> DataFrame:
    return files.filter(~is_hidden(F.col("path")))


def relative_path(path: Column, base: Column) -> Column:
    """The path below ``base``; a path outside of it stays as it is."""
    prefix = F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"))
    return F.when(F.startswith(path, prefix), F.substring(path, F.length(prefix) + 1, F.length(path))).otherwise(path)


def resolve_stems(files: DataFrame) -> DataFrame:
    """One source per stem: the earliest format, then the first path.

    The winner is picked by an aggregate on (format rank, path) alone, which
    combines before the shuffle; the texts never move for it.  Being unique,
    the winners then join back without skew.
    """
    ranked = F.array_position(F.array(*map(F.lit, SUPPORTED_EXTENSIONS)), extension(F.col("path")))
    winners = (
        files.select("path", stem(F.col("path")).alias("stem"), ranked.alias("rank"))
        .groupBy("stem")
        .agg(F.min(F.struct("rank", "path")).getField("path").alias("path"))
        .select("path")
    )
    return files.join(winners, "path", "left_semi").withColumn("stem", stem(F.col("path")))


def source_format(path: Column, always_default: bool = False) -> Column:
    """Markup dialect by extension; the default serves everything else."""
    if always_default:
        return F.when(path.isNotNull(), F.lit("markdown"))
    ext = extension(path)
    return (
        F.when(ext == "md", "gfm").when(ext == "org", "org").when(ext == "rst", "rst")
        .when(path.isNotNull(), "markdown")
    )


def html_to_text(pages: DataFrame) -> DataFrame:
    return pages.withColumn("plain", plain_text(F.col("html")))


def page_contents(pages: DataFrame) -> DataFrame:
    """Table of contents of each page: its headings in order, with anchors."""
    heading = r"(?is)<h([1-6])(?:\s[^>]*)?>(.*?)</h\1\s*>"
    rows = pages.select(
        "page_id",
        F.posexplode(F.regexp_extract_all("html", F.lit(heading), 0)).alias("pos", "found"),
    )
    # An inner heading end may differ from the start, so both come from one match.
    title = F.trim(F.regexp_replace(plain_text(F.regexp_extract("found", heading, 2)), r"\s+", " "))
    anchor = F.regexp_replace(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}\s_.-]", ""), r"\s+", "-")
    return rows.select(
        "page_id",
        (F.col("pos") + 1).cast("long").alias("ord"),
        F.regexp_extract("found", heading, 1).cast("long").alias("level"),
        title.alias("heading"),
        anchor.alias("anchor"),
    )


def document_id(path: Column) -> Column:
    """Hex SHA-1 of the relative path as UTF-8."""
    return F.sha1(path)


def title_from_path(path: Column) -> Column:
    """File name without its last extension, hyphens read as blanks."""
    name = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
    return F.replace(name, F.lit("-"), F.lit(" "))


def parse_updated_on(written_as: Column) -> Column:
    """ISO date or date-time, else epoch milliseconds, as an instant; else null.

    Four digits are a year.  Missing parts are the first of their kind, and a
    missing zone is UTC, whatever the session's zone.
    """
    day = r"^\d{4}-\d{2}-\d{2}"
    iso = (
        F.when(written_as.rlike(r"^\d{4}$"), F.concat(written_as, F.lit("-01-01T00:00:00Z")))
        .when(written_as.rlike(r"^\d{4}-\d{2}$"), F.concat(written_as, F.lit("-01T00:00:00Z")))
        .when(written_as.rlike(day + "$"), F.concat(written_as, F.lit("T00:00:00Z")))
        .when(written_as.rlike(day + r"[T ].*(Z|[+-]\d{2}(:?\d{2})?)$"), written_as)
        .when(written_as.rlike(day + "[T ]"), F.concat(written_as, F.lit("Z")))
    )
    millis = F.when(written_as.rlike(r"^-?\d{1,18}$") & ~written_as.rlike(r"^\d{4}$"), written_as.try_cast("bigint"))
    return F.coalesce(F.try_to_timestamp(iso), F.timestamp_millis(millis))


def assemble_documents(files: DataFrame, metadata: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Text, markup and latest change of each file as one document.

    ``files`` has path, text and html, and any columns to ``keep``;
    ``metadata`` has one valid record per path.
    """
    path = F.col("path")
    return files.join(metadata, "path").select(
        *(keep or []),
        document_id(path).alias("id"),
        F.col("text").alias("content"),
        "html",
        path.alias("file_name"),
        title_from_path(path).alias("title"),
        F.col("author_name").alias("updated_by"),
        F.col("updated").alias("updated_on"),
    )


DOCUMENT_FIELDS = ["id", "content", "html", "file_name", "title", "updated_by", "updated_on"]
DOCUMENT_SCHEMA = (
    "id string, content string, html string, file_name string, title string, updated_by string, updated_on string"
)


def to_json_lines(documents: DataFrame) -> DataFrame:
    return documents.select("id", F.to_json(F.struct(*DOCUMENT_FIELDS)).alias("json"))


def from_json_lines(lines: DataFrame) -> DataFrame:
    return lines.select(F.from_json("json", DOCUMENT_SCHEMA).alias("d")).select("d.*")


def content_hash(content: Column, *metadata: Column) -> Column:
    """Digest of a file's text, and of its metadata where that is to count."""
    marked = [F.coalesce(part.cast("string"), F.lit("\u0000")) for part in (content, *metadata)]
    return F.sha2(F.concat_ws("\u0001", *marked), 256)


def changed_documents(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are new or whose hash differs from the previous manifest.

    Both sides carry path and hash only, so the texts stay where they are.
    """
    previous = manifest.select("path", F.col("hash").alias("previous_hash"))
    return (
        current.select("path", "hash").join(previous, "path", "left")
        .filter(F.col("previous_hash").isNull() | (F.col("previous_hash") != F.col("hash")))
        .select("path", "hash", F.when(F.col("previous_hash").isNull(), "new").otherwise("changed").alias("state"))
    )


def removed_documents(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files of the previous manifest that are gone."""
    return manifest.select("path").join(current.select("path"), "path", "left_anti")


def split_writes(writes: DataFrame, key: str = "id", version: str = "version") -> tuple[DataFrame, DataFrame]:
    """Writes that can be applied, and those without key or version with the reason."""
    reason = F.when(F.col(key).isNull(), f"missing {key}").when(F.col(version).isNull(), f"missing {version}")
    marked = writes.withColumn("reason", reason)
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())


def latest_versions(writes: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """The last write of each key; of equal versions the one with the greatest other columns.

    One aggregate, which keeps a single row per key before the shuffle.
    """
    others = sorted(c for c in writes.columns if c not in (key, version))
    last = writes.groupBy(key).agg(F.max(F.struct(version, *others)).alias("last"))
    return last.select(*[F.col(key) if c == key else F.col(f"last.{c}").alias(c) for c in writes.columns])


def upsert(stored: DataFrame, writes: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """Stored rows with writes applied; of both sides the highest version of a key wins.

    A write as high as what is stored replaces it.  Writes without key or
    version change nothing; ``split_writes`` tells them.  The stored side meets
    keys and versions of the writes only, so it is not moved when these are few.
    """
    accepted, _ = split_writes(writes, key, version)
    last = written(latest_versions(accepted, key, version))
    newest = last.select(key, F.col(version).alias("_written"))
    higher = F.col("_written").isNull() | F.coalesce(F.col(version) > F.col("_written"), F.lit(False))
    kept = stored.join(broadcast_if_small(newest), key, "left").filter(higher).drop("_written")
    held = stored.select(key, F.col(version).alias("_held")).join(broadcast_if_small(newest), key).filter(
        F.col("_held") > F.col("_written")
    )
    return kept.unionByName(last.join(held.select(key), key, "left_anti"))


def split_rejects(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents fit for the index, and the others with the reason; one they come with is kept."""
    given = F.col("reason") if "reason" in documents.columns else F.lit(None).cast("string")
    reason = (
        F.when(given.isNotNull(), given)
        .when(F.col("id").isNull(), "missing id")
        .when(F.col("content").isNull(), "missing content")
        .when(F.col("updated_on").isNull(), "missing date")
    )
    marked = documents.withColumn("reason", reason)
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())
