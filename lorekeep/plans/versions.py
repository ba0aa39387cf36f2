"""Versions of a library: each is one small file, and its number goes to whoever claims it first.

A writer reads the current version, writes new tables beside the old ones and
claims the next number by creating its file, which only one can.  The others
learn that they were too late, read the version that won and try again on it, so
no version is lost and none is made of two.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Taken(Exception):
    """The number was claimed by another writer."""


@dataclass(frozen=True)
class Version:
    """A published version: its number and what it consists of."""

    number: int
    content: dict


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _file(path: str, number: int) -> str:
    return f"{path}/versions/{number:012d}.json"


def numbers(spark: SparkSession, path: str) -> list[int]:
    """Claimed numbers in order."""
    place, files = _place(spark, f"{path}/versions")
    if not files.exists(place):
        return []
    names = [status.getPath().getName() for status in files.listStatus(place)]
    return sorted(int(name[:12]) for name in names if re.fullmatch(r"\d{12}\.json", name))


def read(spark: SparkSession, path: str, number: int) -> Version | None:
    """A version; none if its writer has claimed the number and written nothing yet, or never will."""
    place, files = _place(spark, _file(path, number))
    lines = files.open(place)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(lines, "UTF-8")
    finally:
        lines.close()
    try:
        return Version(number, json.loads(text))
    except ValueError:
        return None


def current(spark: SparkSession, path: str) -> Version | None:
    """The version published last."""
    for number in reversed(numbers(spark, path)):
        version = read(spark, path, number)
        if version is not None:
            return version
    return None


def next_number(spark: SparkSession, path: str) -> int:
    return max(numbers(spark, path), default=0) + 1


def publish(spark: SparkSession, path: str, number: int, content: dict) -> Version:
    """Claim a number for a version, or raise ``Taken``."""
    place, files = _place(spark, _file(path, number))
    files.mkdirs(place.getParent())
    try:
        if files.getScheme() == "file":
            # Hadoop's local files are created in two steps; this is one.
            jvm = spark._jvm
            local = jvm.java.nio.file.Path.of(place.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.String, 0))
            attributes = spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0)
            jvm.java.nio.file.Files.createFile(local, attributes)
            out = files.create(place, True)
        else:
            out = files.create(place, False)
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            raise Taken(number) from error
        raise
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    return Version(number, content)


def delete(spark: SparkSession, path: str) -> None:
    place, files = _place(spark, path)
    files.delete(place, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders of tables below a library."""
    place, files = _place(spark, path)
    names = [status.getPath().getName() for status in files.listStatus(place) if status.isDirectory()]
    return sorted(name for name in names if name.startswith("segment-"))


def keep_last(spark: SparkSession, path: str, keep: int) -> None:
    """Delete all versions but the last ones, and the folders of tables that none of these names.

    For times without a writer: a folder that a writer has not published yet is
    named by no version.
    """
    kept = [v for v in (read(spark, path, n) for n in reversed(numbers(spark, path))) if v is not None][: max(1, keep)]
    if not kept:
        return
    used = {folder.rstrip("/").rsplit("/", 1)[-1] for v in kept for folder in v.content["folders"]}
    for number in numbers(spark, path):
        if number < kept[-1].number:
            delete(spark, _file(path, number))
    for name in folders(spark, path):
        if name not in used:
            delete(spark, f"{path}/{name}")
