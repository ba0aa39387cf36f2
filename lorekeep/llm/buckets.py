"""Verified pairs within buckets, without a task that holds a large bucket.

Members of a bucket are to be compared with each other.  A bucket of more than
``BLOCK`` members is cut into blocks by a hash of the member, and each pair of
its blocks is a group of its own, so that a group never holds more than about
two blocks.  Rows of a group lie together in a partition; many small groups are
compared in one go by array operations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.tables import stored

#: Members of a block.
BLOCK = 128
#: Pairs compared in one go.
PAIRS = 150_000


def blocked(members: DataFrame, key: str, spread: str) -> DataFrame:
    """Members of buckets with two or more, once for each pair of blocks they take part in.

    Adds ``group`` (of the bucket and its two blocks) and ``part``: 0 for the
    first and 1 for the second block of the group, or 2 where both are the same.
    """
    sizes = stored(members.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1"), "bucket-sizes")
    n = F.ceil(F.col("_n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64(spread, F.lit(7)), n.cast("long")).cast("int")
    placed = members.join(sizes, key).withColumns({"_blocks": n, "_own": own})
    placed = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    first, last = F.least("_own", "_other"), F.greatest("_own", "_other")
    part = F.when(F.col("_own") == F.col("_other"), 2).when(F.col("_own") < F.col("_other"), 0).otherwise(1)
    return placed.select(
        *[c for c in members.columns],
        F.xxhash64(key, first, last).alias("group"),
        part.cast("int").alias("part"),
    )


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node it is connected with by the pairs."""
    roots = np.arange(n)
    while True:
        least = np.minimum(roots[a], roots[b])
        new = roots.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == roots).all():
            return roots
        roots = new


def pairs_in_runs(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i < j) of all pairs within runs, a bounded number of pairs at a time."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    position = np.arange(len(owner))
    # Each member meets those that follow it in its run.
    follow = (starts + sizes)[owner] - 1 - position
    done = np.concatenate(([0], np.cumsum(follow)))
    i = 0
    while i < len(position):
        j = max(i + 1, int(np.searchsorted(done, done[i] + PAIRS, "right")) - 1)
        first = np.repeat(position[i:j], follow[i:j])
        step = np.arange(len(first)) - np.repeat(done[i:j] - done[i], follow[i:j])
        yield first, first + 1 + step
        i = j


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches of a partition regrouped so that no group is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        groups = batch.column("group").to_numpy()
        change = np.flatnonzero(groups[1:] != groups[:-1]) + 1
        if held and held[-1].column("group")[-1].as_py() != groups[0]:
            yield pa.Table.from_batches(held)
            held = []
        if len(change):
            yield pa.Table.from_batches([*held, batch.slice(0, change[-1])])
            held = [batch.slice(change[-1])]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def compare(members: DataFrame, verify: Callable, payload: list[str]) -> DataFrame:
    """Links of each member and the smallest member it is connected with, by group.

    ``members`` come from ``blocked`` and have ``node``, ``weight`` (how many
    rows a member stands for), ``group``, ``part`` and the payload columns.
    ``verify(table, i, j)`` says which pairs of rows are linked and to be
    counted here.  Returns ``node``, ``links`` and ``root``; only rows with a link.
    """

    def run(batches):
        for table in whole_groups(batches):
            groups = table.column("group").to_numpy()
            part = table.column("part").to_numpy()
            node = table.column("node").to_numpy()
            weight = table.column("weight").to_numpy()
            starts = np.concatenate(([0], np.flatnonzero(groups[1:] != groups[:-1]) + 1))
            sizes = np.diff(np.append(starts, len(groups)))
            read = verify(table)
            found = []
            for i, j in pairs_in_runs(starts, sizes):
                # Within one block all pairs, between two blocks those across.
                chosen = (part[i] == 2) | (part[i] != part[j])
                i, j = i[chosen], j[chosen]
                linked = read(i, j)
                found.append((i[linked], j[linked]))
            a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, int),) * 2
            order = np.argsort(node, kind="stable")
            rank = np.empty(len(node), dtype=np.int64)
            rank[order] = np.arange(len(node))
            roots = node[order][local_roots(len(node), rank[a], rank[b])][rank]
            links = np.zeros(len(node), dtype=np.int64)
            np.add.at(links, a, weight[b])
            np.add.at(links, b, weight[a])
            kept = links > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[kept]), pa.array(links[kept]), pa.array(roots[kept])], ["node", "links", "root"]
            )

    chosen = members.select("node", "weight", "group", "part", *payload)
    return chosen.repartition("group").sortWithinPartitions("group").mapInArrow(
        run, "node long, links long, root long"
    )
