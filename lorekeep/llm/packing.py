"""Packing of documents into sequences of a fixed length, as few as can be found.

Where two items have the same length it does not matter which of them goes
where, so the instance to be solved is how many pieces there are of each
length: one number per length up to the capacity, whatever the corpus.  It is
shrunk by dominance: an item and a few others are put together for good where no
other filling of that item's sequence could be better.  Best fit by falling
length fills the rest, many equal sequences in one step.  The plan then says,
for the first, second, ... piece of each length, its sequence and place there,
and the pieces, numbered by length across partitions, look that up.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.tables import numbered, stored
from lorekeep.llm.tokens import crc32_of_ids, encoded

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass
class Plan:
    """Kinds of sequences: how many there are of each, and their (length, count) items in order."""

    kinds: list[tuple[int, list[tuple[int, int]]]] = field(default_factory=list)

    def add(self, times: int, items: list[tuple[int, int]]) -> None:
        if times:
            self.kinds.append((times, items))


def best_pair(lengths: list[int], counts: dict[int, int], room: int) -> int:
    """The largest sum of two items that fits, or 0."""
    best, low, high = 0, 0, len(lengths) - 1
    while low <= high:
        total = lengths[low] + lengths[high]
        if total > room or low == high and counts[lengths[low]] < 2:
            high -= 1
        else:
            best = max(best, total)
            low += 1
    return best


def reduce_by_dominance(counts: dict[int, int], capacity: int, plan: Plan) -> None:
    """Fix, for item after item by falling length, what dominates all else it could be with.

    * Nothing fits beside it: it is alone.
    * Another item fills the sequence exactly: both go together.
    * No two others fit beside it: it takes the largest that fits.
    * No three others fit, and the largest single one is as long as any two that
      fit: it takes that one.

    ``counts`` (pieces by length) is left with the rest.  Repeated until a pass
    over all lengths fixes nothing.
    """
    changed = True
    while changed:
        changed = False
        for item in sorted(counts, reverse=True):
            while counts.get(item):
                room = capacity - item
                others = dict(counts)
                others[item] -= 1
                lengths = sorted(n for n, c in others.items() if c and n <= room)
                least = [n for n in lengths[:3] for _ in range(min(3, others[n]))]
                times, partner = counts[item], None
                if lengths:
                    partner = lengths[-1]
                    single = partner == room or len(least) < 2 or least[0] + least[1] > room
                    if not single and (len(least) < 3 or sum(least[:3]) > room):
                        single = partner >= best_pair(lengths, others, room)
                    if not single:
                        break
                    times = counts[item] // 2 if partner == item else min(counts[item], counts[partner])
                    counts[partner] -= times
                counts[item] -= times
                plan.add(times, [(item, 1)] if partner is None else [(item, 2)] if partner == item else [(item, 1), (partner, 1)])
                changed = True
        for item in [n for n, c in counts.items() if not c]:
            del counts[item]


def best_fit(counts: dict[int, int], capacity: int, plan: Plan) -> None:
    """Best fit by falling length: each item goes where the least room is left.

    An item that fits where the least room is leaves still less room there, so
    equal items fill that sequence before they go on; equal sequences are
    treated together.
    """
    opened: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {0: []}
    rooms: list[int] = []

    def leave(room: int, times: int, items: list[tuple[int, int]]) -> None:
        if times:
            if room not in opened:
                opened[room] = []
                rooms.insert(bisect_right(rooms, room), room)
            opened[room].append((times, items))

    for item in sorted(counts, reverse=True):
        left = counts[item]
        while left:
            at = next((i for i in range(bisect_right(rooms, item - 1), len(rooms)) if opened[rooms[i]]), None)
            room = capacity if at is None else rooms[at]
            each = room // item
            times, items = (-(-left // each), []) if at is None else opened[room].pop()
            full = min(times, left // each)
            leave(room - each * item, full, [*items, (item, each)])
            left -= full * each
            times -= full
            if times and left:
                leave(room - left * item, 1, [*items, (item, left)])
                times, left = times - 1, 0
            if at is not None:
                leave(room, times, items)
    for groups in opened.values():
        for times, items in groups:
            plan.add(times, items)


def planned(counts: dict[int, int], capacity: int) -> Plan:
    """How to pack so many pieces of each length."""
    plan, rest = Plan(), {n: c for n, c in counts.items() if c}
    reduce_by_dominance(rest, capacity, plan)
    best_fit(rest, capacity, plan)
    return plan


def lookup(plan: Plan) -> dict[str, np.ndarray]:
    """The plan by piece: for runs of pieces, numbered by rising length, where they go."""
    parts: dict[int, list[tuple[int, int, int, int]]] = {}
    first = 0
    for times, items in plan.kinds:
        place = 0
        for length, count in items:
            parts.setdefault(length, []).append((times, count, first, place))
            place += length * count
        first += times
    rows = [(length, *part) for length in sorted(parts) for part in parts[length]]
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    taken = table[:, 1] * table[:, 2]
    return {"low": np.cumsum(taken) - taken, "length": table[:, 0], "count": table[:, 2], "first": table[:, 3], "place": table[:, 4]}


def pieces_of_documents(documents: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """Every whole text as pieces of at most ``capacity`` ids; only longer ones are cut.

    Of a document that is cut, all pieces but the first have the full length.
    """

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            ids_of = batch.column("doc_id").to_pylist()
            for doc_id, ids in zip(ids_of, encoded(batch.column("text"), tokenizer_path, end_id), strict=True):
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    out.append((doc_id, piece, a, b - a, crc32_of_ids(ids[a:b])))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def packed(documents: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """All documents in sequences of at most ``capacity`` ids.

    Returns a row per piece: ``doc_id``, ``piece``, ``start`` (ids of its
    document before it), ``length``, ``ids_crc32``, ``sequence_id`` (from 0) and
    ``offset``, its place there; the pieces of a sequence follow each other
    without gaps.  A null text is empty and holds the end id alone.  Rows without
    doc_id and rows that repeat an id are packed like any other.  Other columns
    are not looked at.
    """
    pieces = stored(pieces_of_documents(documents, tokenizer_path, end_id, capacity), "pieces")
    # At most one row per length.
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    where = lookup(planned(counts, capacity))

    def place(batches):
        for batch in batches:
            number = batch.column("number").to_numpy()
            run = np.searchsorted(where["low"], number, "right") - 1
            nth, count = number - where["low"][run], where["count"][run]
            sequence = where["first"][run] + nth // count
            offset = where["place"][run] + nth % count * where["length"][run]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ordered = numbered(pieces, ["length", "doc_id", "piece"], "pieces-by-length")
    ordered = ordered.select("doc_id", "piece", "start", "length", "ids_crc32", "number")
    return ordered.mapInArrow(place, PIECES + ", sequence_id long, offset long")
