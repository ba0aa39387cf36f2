"""Who is answered, settled once for each change of the rules and kept as versions.

Rules, users, channels and members are joined when one of them changes, not when
somebody writes.  What is kept is their outcome, the open channels and the
permitted users.  A batch of events is decided by one version, whatever is
published meanwhile, and a batch that is run again by the same one.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import access
from lorekeep.operators.joins import written
from lorekeep.plans import versions


@dataclass(frozen=True)
class Directory:
    """One version: the channels in which mentions are answered, and the users who are."""

    number: int
    open_channels: DataFrame
    permitted: DataFrame
    bot: str

    def decide(self, events: DataFrame) -> DataFrame:
        return access.decide_by(events, self.open_channels, self.permitted, self.bot)


def publish_directory(
    rules: DataFrame, users: DataFrame, channels: DataFrame, members: DataFrame, bot: str, path: str
) -> Directory:
    """Publish what the rules come to as the next version, unless it is that of the last one."""
    spark = rules.sparkSession
    open_channels = written(access.allowed_channels(rules, channels).distinct())
    permitted = written(access.permitted_users(rules, users, open_channels, members))

    def digest(rows: DataFrame, column: str) -> str:
        return str(rows.agg(F.count("*"), F.sum(F.xxhash64(column).cast("decimal(38,0)"))).first()[:])

    content = {"bot": bot, "digest": [digest(open_channels, "channel_id"), digest(permitted, "user_id")]}
    while True:
        last = versions.current(spark, path)
        if last is not None and last.content["digest"] == content["digest"] and last.content["bot"] == bot:
            return open_directory(spark, path, last.number)
        number = versions.next_number(spark, path)
        folder = f"{path}/segment-{number}-{uuid.uuid4().hex}"
        open_channels.write.parquet(f"{folder}/channels")
        permitted.write.parquet(f"{folder}/users")
        try:
            versions.publish(spark, path, number, content | {"folders": [folder]})
        except versions.Taken:
            versions.delete(spark, folder)
            continue
        return open_directory(spark, path, number)


def open_directory(spark: SparkSession, path: str, number: int | None = None) -> Directory:
    """A version by its number, or the last one."""
    version = versions.current(spark, path) if number is None else versions.read(spark, path, number)
    if version is None:
        raise ValueError(f"no directory has been published at {path}")
    (folder,) = version.content["folders"]
    channels = spark.read.schema("channel_id string").parquet(f"{folder}/channels")
    users = spark.read.schema("user_id string").parquet(f"{folder}/users")
    return Directory(version.number, channels, users, version.content["bot"])


def pinned(spark: SparkSession, path: str, pins: str, batch_id: int) -> Directory:
    """The version by which a batch is decided: the last one when the batch ran first."""
    try:
        versions.publish(spark, pins, batch_id, {"number": open_directory(spark, path).number})
    except versions.Taken:
        pass
    pin = versions.read(spark, pins, batch_id)
    return open_directory(spark, path, pin.content["number"] if pin else None)
