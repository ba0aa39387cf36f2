import os
import time

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import access
from lorekeep.operators.joins import broadcast_if_small, scratch, written
from lorekeep.plans.answer import Answers
from lorekeep.plans.directory import open_directory, pinned, publish_directory
from lorekeep.sources.shared import new_table_path, shared_folder
from lorekeep.streaming.replies import EVENT_SCHEMA, read_events, start_replies


def shout(batch):
    heads = written(batch.select("event_id", F.upper("text").alias("reply")))
    return Answers(heads, heads.select("event_id", F.lit(1).alias("rank")))


def test_new_messages_are_answered_once(spark, tmp_path):
    folder = lambda name: str(tmp_path / name)
    message = lambda i, text: (i, "message", "D1", "1.0", "U1", None, text, None)
    spark.createDataFrame([message(1, "a"), message(1, "a"), message(2, "b")], EVENT_SCHEMA).coalesce(1).write.mode(
        "append"
    ).parquet(folder("in"))

    def run():
        started = start_replies(read_events(spark, folder("in"), 1), shout, folder("out"), folder("state"))
        started.awaitTermination()
        assert len(spark.read.parquet(folder("out") + "/rows").collect()) == len(spark.read.parquet(folder("out") + "/heads").collect())
        return sorted((r.event_id, r.reply) for r in spark.read.parquet(folder("out") + "/heads").collect())

    assert run() == [(1, "A"), (2, "B")]
    spark.createDataFrame([message(3, "c"), message(1, "a")], EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(folder("in"))
    assert run() == [(1, "A"), (2, "B"), (3, "C")]
    assert run() == [(1, "A"), (2, "B"), (3, "C")]


def deliver(spark, folder, *rows):
    spark.createDataFrame(list(rows), EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def message(i, text, user="U1"):
    return (i, "message", "D1", "1.0", user, None, text, None)


def test_events_without_id_are_rejected_one_by_one(spark, tmp_path):
    folder = lambda name: str(tmp_path / name)
    for rows in ([message(None, "x"), message(None, "y"), message(1, "a")], [message(None, "z"), message(None, "x"), message(1, "a")]):
        deliver(spark, folder("in"), *rows)
        start_replies(read_events(spark, folder("in"), 1), shout, folder("out"), folder("state")).awaitTermination()
    rejects = spark.read.parquet(folder("out") + "/rejects").collect()
    assert sorted((r.text, r.reason) for r in rejects) == [(t, "missing event_id") for t in "xyz"]
    assert [r.event_id for r in spark.read.parquet(folder("out") + "/heads").collect()] == [1]


def test_ids_leave_the_state_when_their_time_has_passed(spark, tmp_path):
    """Each delivery brings new ids; what is kept is bounded by the time, not by the number of batches."""
    folder = lambda name: str(tmp_path / name)
    kept = []
    for batch in range(4):
        deliver(spark, folder("in"), *[message(100 * batch + i, "a") for i in range(20)], message(100 * batch, "a"))
        running = start_replies(read_events(spark, folder("in")), shout, folder("out"), folder("state"), remember="1 seconds")
        running.awaitTermination()
        kept.append(max(p["stateOperators"][0]["numRowsTotal"] for p in running.recentProgress if p["stateOperators"]))
        time.sleep(1.5)
    assert len(spark.read.parquet(folder("out") + "/heads").collect()) == 80
    assert max(kept) <= 40


def test_a_batch_is_decided_by_one_version_of_the_directory(spark, tmp_path):
    """A rule that changes between batches counts from the next one on; a batch run again is decided as before."""
    folder = lambda name: str(tmp_path / name)
    users = spark.createDataFrame([("U1", "ann"), ("U2", "bob")], "user_id string, user_name string")
    channels = spark.createDataFrame([("C1", "talk", True)], "channel_id string, channel_name string, bot_is_member boolean")
    members = spark.createDataFrame([], "channel_id string, user_id string")

    def publish(*names):
        rules = access.parse_rules(spark.createDataFrame([(f"@{n}",) for n in names], "rule string"))
        return publish_directory(rules, users, channels, members, "UBOT", folder("directory")).number

    def shout_to_allowed(batch, version):
        allowed = version.decide(batch.withColumn("route", F.lit("message"))).filter("allowed")
        return shout(allowed)

    def run():
        start_replies(
            read_events(spark, folder("in")), shout_to_allowed, folder("out"), folder("state"), directory=folder("directory")
        ).awaitTermination()
        return sorted(r.event_id for r in spark.read.parquet(folder("out") + "/heads").collect())

    assert publish("ann") == 1 == publish("ann")
    deliver(spark, folder("in"), message(1, "a"), message(2, "b", "U2"))
    assert run() == [1]
    assert publish("ann", "bob") == 2
    deliver(spark, folder("in"), message(3, "a"), message(4, "b", "U2"))
    assert run() == [1, 3, 4]
    first = pinned(spark, folder("directory"), folder("out") + "/pins", 0)
    assert first.number == 1 and [r.user_id for r in first.permitted.collect()] == ["U1"]
    assert open_directory(spark, folder("directory")).number == 2


def test_scratch_tables_go_with_their_batch(spark):
    with scratch(spark):
        rows = written(spark.range(3))
        place = rows.inputFiles()[0].removeprefix("file:").rsplit("/", 2)[0]
        assert rows.count() == 3 and os.path.isdir(place)
    assert not os.path.exists(place)


def test_few_long_rows_are_not_broadcast(spark):
    rows = spark.range(40).select(F.repeat(F.lit("x"), 4000).alias("t"))
    plan = lambda limit: broadcast_if_small(rows, limit)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(1 << 20).lower() and "broadcast" not in plan(100_000).lower()


def test_shared_folder_is_the_sessions(spark):
    folder = shared_folder(spark)
    assert new_table_path(spark, "x").startswith(folder + "/lorekeep/x-")
    set_by_session = spark.conf.get("spark.checkpoint.dir", None)
    assert set_by_session is None or folder == set_by_session.rstrip("/")
