"""Distributed merge sort of byte strings that never looks twice at a known common prefix.

Tasks sort runs of strings and front-code them: of each string only what follows
its longest common prefix (LCP) with the one before is kept.  Splitters drawn from
all runs cut them into parts, the coded pieces are exchanged, and each part is
merged by a loser tree.  Every string in the tree knows its LCP with the string
that left the tree last; of two strings the one with the longer such prefix is
the smaller, and only if they are equally long is there a comparison, which
starts after that prefix and tells the loser's new LCP.  The LCPs of neighbours
in the final order come out with it.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.tables import fraction, passing, stored

#: Strings and bytes of a run, and strings for each sample drawn from it.
RUN, RUN_BYTES, EACH_SAMPLE = 8192, 4 << 20, 256
#: Bytes, as front-coded, that one task merges, and samples that splitters are chosen from at most.
PART_BYTES, SAMPLES = 8 << 20, 32_768

Named = tuple[bytes, tuple[int, int]]


def common(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix of two strings that are equal up to ``start``."""
    n, step = min(len(a), len(b)), 32
    while start < n:
        end = min(n, start + step)
        x, y = a[start:end], b[start:end]
        if x != y:
            return end - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7) // 8
        start, step = end, 4 * step
    return n


def front_coded(rows: list[Named]) -> tuple[bytes, bytes, bytes, bytes]:
    """Sorted strings as LCPs, lengths of the rests, the rests, and the names."""
    lcps, rests, before = np.empty(len(rows), np.int32), [], b""
    for i, (s, _) in enumerate(rows):
        lcps[i] = common(before, s, 0)
        rests.append(s[lcps[i] :])
        before = s
    lengths = np.fromiter(map(len, rests), np.int32, len(rests))
    names = np.array([name for _, name in rows], dtype=np.int64)
    return lcps.tobytes(), lengths.tobytes(), b"".join(rests), names.tobytes()


def decoded(lcps: bytes, lengths: bytes, rests: bytes, names: bytes) -> Iterator[tuple[bytes, int, tuple[int, int]]]:
    """The strings of a coded run, each with its LCP with the one before and its name."""
    before, at = b"", 0
    pairs = np.frombuffer(names, np.int64).reshape(-1, 2).tolist()
    for lcp, n, name in zip(np.frombuffer(lcps, np.int32).tolist(), np.frombuffer(lengths, np.int32).tolist(), pairs, strict=True):
        before = before[:lcp] + rests[at : at + n]
        at += n
        yield before, lcp, tuple(name)


def merged(runs: list[Iterator[tuple[bytes, int, tuple[int, int]]]]) -> Iterator[tuple[bytes, int, tuple[int, int]]]:
    """Sorted runs as one, by a loser tree over their heads: string, LCP with the one before, name."""
    k = len(runs)
    heads = [next(run, None) for run in runs]
    text = [h and h[0] for h in heads]
    # With the string that left the tree last; before the first, with the empty one.
    lcp = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        if heads[a] is None:
            return b, a
        if heads[b] is None or lcp[a] > lcp[b]:
            return a, b
        if lcp[b] > lcp[a]:
            return b, a
        x, y = text[a], text[b]
        c = common(x, y, lcp[a])
        if c == len(x) or (c < len(y) and x[c] < y[c]):
            lcp[b] = c
            return a, b
        lcp[a] = c
        return b, a

    winner, losers = [*[0] * k, *range(k)], [0] * k
    for node in range(k - 1, 0, -1):
        winner[node], losers[node] = play(winner[2 * node], winner[2 * node + 1])
    best = winner[1] if k else 0
    while k and heads[best] is not None:
        yield text[best], lcp[best], heads[best][2]
        heads[best] = head = next(runs[best], None)
        if head is not None:
            # Its predecessor in the run is the string that just left.
            text[best], lcp[best] = head[0], head[1]
        node = (k + best) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2


_CODED = ["lcps", "lengths", "rests", "names"]
_EDGE = ["part", "first", "first_1", "first_2", "last", "last_1", "last_2"]
_RUNS = "run long, n long, bytes long, lcps binary, lengths binary, rests binary, names binary, samples array<binary>"


def sorted_runs(strings_of: Callable[[pa.RecordBatch], Iterator[Named]]) -> Callable:
    """A function for ``mapInArrow``: the strings of the batches as sorted, front-coded runs."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def row():
            held.sort()
            coded = front_coded(held)
            samples = [s for s, _ in held[:: EACH_SAMPLE]]
            columns = [number, len(held), sum(map(len, coded)), *coded, samples]
            kinds = [pa.int64()] * 3 + [pa.binary()] * 4 + [pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays(
                [pa.array([c], k) for c, k in zip(columns, kinds, strict=True)], ["run", "n", "bytes", *_CODED, "samples"]
            )

        for named in itertools.chain.from_iterable(map(strings_of, batches)):
            held.append(named)
            size += len(named[0])
            if len(held) >= RUN or size >= RUN_BYTES:
                yield row()
                number, held, size = number + 1, [], 0
        if held:
            yield row()

    return run


def splitters(runs: DataFrame) -> list[bytes]:
    """Strings that cut the sorted order into parts of about PART_BYTES, as short as they may be.

    Chosen from a sample of at most about SAMPLES strings; one splitter for each part.
    """
    total, n = runs.agg(F.sum("bytes"), F.sum(F.size("samples"))).first()
    parts = -(-(total or 0) // PART_BYTES)
    if parts < 2:
        return []
    drawn = runs.select("run", F.posexplode("samples").alias("i", "sample"))
    drawn = drawn.where(fraction(F.concat_ws(":", "run", "i")) < SAMPLES / n).select("sample")
    sample = sorted(r["sample"] for r in drawn.collect())
    cuts = []
    for i in range(1, parts):
        at = i * len(sample) // parts
        if at and sample[at] != sample[at - 1]:
            cuts.append(bytes(sample[at][: common(bytes(sample[at - 1]), bytes(sample[at]), 0) + 1]))
    return sorted(set(cuts))


def neighbours(strings: DataFrame, strings_of: Callable, seen: Callable, schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """What ``seen`` says of each two strings that are neighbours in the order of all.

    ``strings_of`` makes the named strings of a batch of ``strings``.  ``seen``
    gets two neighbours (string and name each) and their LCP, and returns a list
    of rows of the schema.  The last string of a part meets the first of the next
    one in a table of a row per part.
    """
    cuts: list[bytes] = []

    def pieces(batches):
        for batch in batches:
            for r in batch.to_pylist():
                rows = [(s, name) for s, _, name in decoded(*(r[c] for c in _CODED))]
                keys = [s for s, _ in rows]
                places = [0, *(bisect.bisect_left(keys, cut) for cut in cuts), len(rows)]
                for part, (a, b) in enumerate(itertools.pairwise(places)):
                    if a < b:
                        coded = front_coded(rows[a:b])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([part], pa.int64()), pa.array([r["run"]], pa.int64()), *(pa.array([c], pa.binary()) for c in coded)],
                            ["part", "run", *_CODED],
                        )

    names = [field.split()[0] for field in schema.split(", ")]

    def rows_out(rows: list[tuple], part: int | None = None, first=None, last=None) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        edge = (part, *first, *last) if first else None
        extra = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        arrays = [pa.array([*c, *([None] if edge else [])], k) for c, k in zip(columns, kinds, strict=True)]
        arrays += [pa.array([*[None] * len(rows), *([e] if edge else [])], k) for e, k in zip(edge or [None] * 7, extra, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, [*names, *_EDGE])

    def merge(batches):
        # Pieces come sorted by part.
        rows = itertools.chain.from_iterable(b.to_pylist() for b in batches)
        for part, group in itertools.groupby(rows, key=lambda r: r["part"]):
            runs_of = [decoded(*(r[c] for c in _CODED)) for r in group]
            first = before = None
            out = []
            for s, lcp, name in merged(runs_of):
                if before is None:
                    first = (s, *name)
                else:
                    out += seen(before, (s, name), lcp)
                before = (s, name)
                if len(out) > 20_000:
                    yield rows_out(out)
                    out = []
            yield rows_out(out, part, first, (before[0], *before[1]))

    edges = "part long, first binary, first_1 long, first_2 long, last binary, last_1 long, last_2 long"
    # The runs hold all strings; once they are merged, nothing reads them.
    with passing(strings.sparkSession) as keep:
        runs = keep(strings.mapInArrow(sorted_runs(strings_of), _RUNS))
        cuts += splitters(runs)
        cut = runs.mapInArrow(pieces, "part long, run long, lcps binary, lengths binary, rests binary, names binary")
        cut = cut.repartition(len(cuts) + 1, "part").sortWithinPartitions("part", "run")
        found = stored(cut.mapInArrow(merge, f"{schema}, {edges}"), "string-neighbours")

    def meet(batches):
        before = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if before is not None:
                    first = (r["first"], (r["first_1"], r["first_2"]))
                    out += seen(before, first, common(before[0], first[0], 0))
                before = (r["last"], (r["last_1"], r["last_2"]))
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    # A row per part, a part per PART_BYTES of strings.
    ends = found.where("part IS NOT NULL").select(*_EDGE).repartition(1).sortWithinPartitions("part")
    return found.where("part IS NULL").select(*names).union(ends.mapInArrow(meet, schema))
