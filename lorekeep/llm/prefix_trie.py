"""The trie of shared beginnings of conversations, by peeling from its deepest turns.

Every conversation is a path of turns.  Truncation peeling starts at the greatest
depth: conversations that end there are merged with the nodes that survive from
below, each node is counted, its last turn is stripped, and what is left is
grouped again one level up, until the root.  All counts of a node follow from
its children and from the conversations that end in it, so nodes are counted
while they are discovered.

Levels are peeled in blocks of ``LEVELS``.  Within a block each task peels the
rows it happens to hold, level by level, and Spark adds up the partial nodes of
all tasks, so a beginning that a third of all conversations share is one partial
row per task and never a group.  A block needs the digests of its own levels only,
so a conversation of any length is carried in bounded rows, and the number of
jobs is the greatest depth divided by ``LEVELS``.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.tables import stored
from lorekeep.sources.shared import new_table_path

#: Levels peeled in one block.
LEVELS = 64
#: Turns that a conversation takes over at most from the first of its five.
SHARED, GROUP = 9, 5
#: Ids joined in one piece of the list of a node's conversations.
IDS = 50_000
_ROOT = b"\0" * 16
_EMPTY = hashlib.sha256(b"").hexdigest()

_NODE = (
    "key binary, keys array<binary>, sizes array<long>, conv_id long, n_convs long, ended long, "
    "below_children long, below_leaves long, below_saved long"
)


def turns_of(conversations: DataFrame) -> DataFrame:
    """Each conversation as an array of turns (digest, bytes of the text) in order.

    Turns are ordered by number, null first; of turns with one number that with
    the smaller role, then digest, comes first.  A null role or text is empty.
    The texts stay where they are: only digests and sizes are shuffled.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    size = F.octet_length(text).cast("long")
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), size.alias("size")).alias("t"),
    )
    # A conversation's own turns, narrow; a null number sorts first.
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return turns.select("conv_id", F.transform("ts", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("ts"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Conversations with their first turns taken over from the first of their five."""
    shared = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(SHARED)).cast("int")
    first = turns.where(F.col("conv_id") % GROUP == 0).select(
        F.col("conv_id").alias("base"), F.slice("ts", 1, SHARED - 1).alias("begin")
    )
    rows = turns.select("conv_id", "ts", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), shared.alias("h"))
    taken = F.coalesce(F.slice("begin", F.lit(1), F.col("h")), F.slice("ts", 1, 0))
    own = F.slice("ts", F.col("h") + 1, F.greatest(F.size("ts") - F.col("h"), F.lit(0)))
    return rows.join(first, "base", "left").select("conv_id", F.concat(taken, own).alias("ts"))


def paths(conversations: DataFrame) -> DataFrame:
    """A row per conversation and block of levels: the digests of its beginnings there.

    ``keys`` holds the node digest at the depth before the block and at each of
    its levels, ``sizes`` the bytes of these levels' last texts; ``turns`` is the
    depth at which the conversation ends, ``last`` marks the block it ends in.
    """

    def run(batches):
        for batch in batches:
            ids, blocks, keys, sizes, ends, last = [], [], [], [], [], []
            for conv, turns in zip(batch.column("conv_id").to_pylist(), batch.column("ts").to_pylist(), strict=True):
                key, at = _ROOT, 0
                while True:
                    part = turns[at : at + LEVELS]
                    row = [key]
                    for t in part:
                        key = hashlib.blake2b(key + t["digest"], digest_size=16).digest()
                        row.append(key)
                    ids.append(conv)
                    blocks.append(at // LEVELS)
                    keys.append(row)
                    sizes.append([t["size"] for t in part])
                    ends.append(len(turns))
                    at += LEVELS
                    last.append(at >= len(turns))
                    if at >= len(turns):
                        break
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(blocks, pa.int32()), pa.array(keys, pa.list_(pa.binary())),
                    pa.array(sizes, pa.list_(pa.int64())), pa.array(ends, pa.int64()), pa.array(last, pa.bool_()),
                ],
                ["conv_id", "block", "keys", "sizes", "turns", "last"],
            )

    return conversations.mapInArrow(
        run, "conv_id long, block int, keys array<binary>, sizes array<long>, turns long, last boolean"
    )


def _peeled(rows: list[dict], add) -> dict[tuple[bytes, int], list]:
    """Rows by the key of their end, level by level from the deepest, each merged and passed on one level up.

    ``add(node, row, own)`` merges a row, or a node that survives from below,
    into a node; ``own`` is true at the row's own end.
    """
    by_depth: dict[int, list] = {}
    for row in rows:
        by_depth.setdefault(len(row["keys"]) - 1, []).append(row)
    found: dict[tuple[bytes, int], list] = {}
    live: dict[bytes, list] = {}
    for depth in range(max(by_depth, default=-1), -1, -1):
        level: dict[bytes, list] = {}
        for node in live.values():
            path = node[0]
            key = path["keys"][depth]
            level[key] = add(level.get(key), node, False)
        for row in by_depth.get(depth, ()):
            key = row["keys"][depth]
            level[key] = add(level.get(key), row, True)
        for key, node in level.items():
            found[key, depth] = node
        live = level
    return found


def _count(node, row, own):
    """Conversations of a node, its smallest one, and those that end in it."""
    if own:
        new = [row, row["n_convs"], row["conv_id"], row["ended"], row["below_children"], row["below_leaves"], row["below_saved"]]
    else:
        new = [row[0], row[1], row[2], 0, 0, 0, 0]
    if node is None:
        return new
    return [node[0], node[1] + new[1], min(node[2], new[2]), *(a + b for a, b in zip(node[3:], new[3:], strict=True))]


def _sum(node, row, own):
    """Sums over a subtree; a child counts for its parent where its own row is."""
    new = [row, 0, row["leaves"], row["saved"], row["children"], 1] if own else [row[0], row[5], row[2], row[3], 0, 0]
    if node is None:
        return new
    return [node[0], *(a + b for a, b in zip(node[1:], new[1:], strict=True))]


def _partial_nodes(batches):
    for batch in batches:
        found = _peeled(batch.to_pylist(), _count)
        rows = []
        for (key, depth), (path, n, conv, ended, *below) in found.items():
            rows.append((key, path["keys"][: depth + 1], path["sizes"][:depth], conv, n, ended, *below))
        columns = list(zip(*rows, strict=True)) or [()] * 9
        kinds = [pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()), *[pa.int64()] * 6]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            ["key", "keys", "sizes", "conv_id", "n_convs", "ended", "below_children", "below_leaves", "below_saved"],
        )


def _partial_sums(batches):
    for batch in batches:
        rows = batch.to_pylist()
        given = {r["key"]: r for r in rows}
        out = []
        for (key, depth), (_, kids, leaves, saved, below, _own) in _peeled(rows, _sum).items():
            own = given.get(key)
            facts = (None,) * 6
            if own:
                parent = own["keys"][depth - 1] if depth else None
                facts = (own["conv_id"], own["n_convs"], own["ended"], depth, own["keys"][0], parent)
            out.append((key, kids + below, leaves, saved, *facts))
        columns = list(zip(*out, strict=True)) or [()] * 10
        kinds = [pa.binary(), *[pa.int64()] * 7, pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            ["key", "children", "leaves", "saved", "conv_id", "n_convs", "ended", "level", "anchor", "parent"],
        )


def ids_digest(ended: DataFrame) -> DataFrame:
    """SHA-256 of the ids of each key, ascending and comma-joined: ``key``, ``ends_sha256``.

    Ids are sorted over all tasks, joined in pieces of bounded size where they
    lie, and the pieces of a key, a few bytes an id, are read one after the other.
    """

    def pieces(batches):
        part = TaskContext.get().partitionId()
        number, key, held = 0, None, []

        def piece():
            return pa.RecordBatch.from_arrays(
                [pa.array([key], pa.binary()), pa.array([(part << 32) + number], pa.int64()), pa.array([",".join(held)])],
                ["key", "number", "ids"],
            )

        for batch in batches:
            for k, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if held and (k != key or len(held) >= IDS):
                    yield piece()
                    number, held = number + 1, []
                key = k
                held.append(str(conv))
        if held:
            yield piece()

    def digests(batches):
        key, state = None, None
        for batch in batches:
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if k != key:
                    if state:
                        yield _digest_row(key, state)
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if state:
            yield _digest_row(key, state)

    placed = ended.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    joined = stored(placed.mapInArrow(pieces, "key binary, number long, ids string"), "trie-ids")
    ordered = joined.repartition("key").sortWithinPartitions("key", "number")
    return ordered.mapInArrow(digests, "key binary, ends_sha256 string")


def _digest_row(key: bytes, state) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])


def peel(rows: DataFrame) -> DataFrame:
    """All nodes of the trie over the paths of conversations, from the deepest block to the root."""
    spark = rows.sparkSession
    ended = rows.where("last").select(
        "conv_id", "block", "keys", "sizes", F.lit(1).cast("long").alias("n_convs"), F.lit(1).cast("long").alias("ended"),
        *[F.lit(0).cast("long").alias(c) for c in ("below_children", "below_leaves", "below_saved")],
    )
    deepest = rows.agg(F.max("block")).first()[0]
    if deepest is None:
        return spark.createDataFrame(
            [], "key binary, children long, leaves long, saved long, conv_id long, n_convs long, ended long, depth long, parent binary"
        )
    folder, live, blocks = new_table_path(spark, "trie-nodes"), None, []
    fields = ["conv_id", "keys", "sizes", "n_convs", "ended", "below_children", "below_leaves", "below_saved"]
    for block in range(deepest, -1, -1):
        here = ended.where(F.col("block") == block).select(*fields)
        if live is not None:
            # The surviving nodes, each by the path of its smallest conversation.
            held = rows.where(F.col("block") == block).select("conv_id", "keys", "sizes")
            here = here.unionByName(live.join(held, "conv_id").select(*fields))
        found = here.mapInArrow(_partial_nodes, _NODE).groupBy("key").agg(
            F.first("keys").alias("keys"), F.first("sizes").alias("sizes"), F.min("conv_id").alias("conv_id"),
            *[F.sum(c).alias(c) for c in fields[3:]],
        )
        # The node before the block belongs to the block below it.
        found = found.where(F.size("keys") > 1) if block else found
        own = F.when(F.size("sizes") > 0, F.element_at("sizes", -1)).otherwise(0) * (F.col("n_convs") - 1)
        leaf = ((F.col("n_convs") == F.col("ended")) & (F.col("below_children") == 0)).cast("long")
        found = stored(
            found.select(
                "key", "keys", "conv_id", "n_convs", "ended", F.col("below_children").alias("children"),
                (leaf + F.col("below_leaves")).alias("leaves"), (own + F.col("below_saved")).alias("saved"),
            ),
            "trie-found",
        )
        sums = found.mapInArrow(
            _partial_sums,
            "key binary, children long, leaves long, saved long, conv_id long, n_convs long, ended long, level long, "
            "anchor binary, parent binary",
        )
        nodes = sums.groupBy("key").agg(
            *[F.sum(c).alias(c) for c in ("children", "leaves", "saved")],
            *[F.max(c).alias(c) for c in ("conv_id", "n_convs", "ended", "level", "anchor", "parent")],
        )
        # The node before the block has no row of its own here.
        nodes = nodes.where("conv_id IS NOT NULL").withColumn("depth", F.col("level") + block * LEVELS)
        path = f"{folder}/block-{block}"
        nodes.drop("level").write.parquet(path)
        blocks.append(path)
        if block:
            top = spark.read.parquet(path).where(F.col("depth") == block * LEVELS + 1)
            live = top.groupBy("anchor").agg(
                F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
                F.count("*").alias("below_children"), F.sum("leaves").alias("below_leaves"), F.sum("saved").alias("below_saved"),
            ).withColumn("ended", F.lit(0).cast("long"))
            live = stored(live.drop("anchor"), "trie-live")
    return spark.read.parquet(*blocks).drop("anchor")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row per node of the trie of rebuilt conversations.

    Returns ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (the
    parent's conv_id, null for the root), ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.  Rows without conv_id are
    left out; a null role or text is empty; turns without a number come first, and
    rows that repeat a number are turns of their own, in the order of role and
    digest; an empty table has no node.  Of roles and texts only equality counts,
    as 128-bit digests.  The remainder of a negative id is negative, as in SQL.
    Other columns, whatever their names, are not looked at.
    """
    rows = stored(paths(rebuilt(turns_of(conversations))), "trie-paths")
    nodes = peel(rows)
    ends = ids_digest(rows.where("last").select(F.element_at("keys", -1).alias("key"), "conv_id"))
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(parents, "parent", "left").join(ends, "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
    )
