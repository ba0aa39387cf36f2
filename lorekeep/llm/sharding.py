"""Shards of nearly equal bytes from an ordered run of groups that stay whole.

The groups lie in a fixed order.  Cutting that order in ``n`` runs so that the
largest run is as small as can be is a minimax problem: a capacity is enough if
filling run after run up to it, greedily, needs no more than ``n`` runs, and the
smallest such capacity is found by search between a bound that is never enough
and one that always is.  The greedy check needs, for each run, the last group
that still fits, which is a look-up in the table of running sizes; one job
looks up the next cut of many capacities at once.  Within that capacity the cuts
are made where what is left is divided most evenly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.tables import crc32_of, numbered, stored, text_bytes

#: Capacities tried together in one round of the search.
TRIED = 48


def next_cuts(ends: DataFrame, limits: list[int], longest: int) -> list[int]:
    """For each limit the largest running size not above it.

    That size lies less than one group below the limit, so only these short
    stretches of the sorted table are read (the filter reaches the files).
    """
    near = None
    for limit in sorted(set(limits)):
        one = (F.col("end") <= limit) & (F.col("end") > limit - longest)
        near = one if near is None else near | one
    found = ends.where(near).agg(
        *[F.max(F.when(F.col("end") <= limit, F.col("end"))).alias(f"c{i}") for i, limit in enumerate(limits)]
    ).first()
    return list(found)


def smallest_capacity(ends: DataFrame, total: int, longest: int, shards: int) -> int:
    """The smallest capacity that is enough for the shards."""
    low, high = max(longest, -(-total // shards)) - 1, total // shards + longest
    while high - low > 1:
        step = max(1, -(-(high - low) // (TRIED + 1)))
        tried = sorted({min(high, low + step * (i + 1)) for i in range(TRIED)} | {high})
        at = [0] * len(tried)
        for _ in range(shards - 1):
            at = next_cuts(ends, [min(total, a + c) for a, c in zip(at, tried)], longest)
        first = next(i for i, (a, c) in enumerate(zip(at, tried, strict=True)) if total - a <= c)
        high, low = tried[first], tried[first - 1] if first else low
    return high


def even_end(at: int, total: int, shards: int, largest: list[tuple[int, int]]) -> int:
    """Where the next of the shards left would best end, given the largest groups left and where they end.

    Groups that are larger than an even share have shards of their own; the
    stretch up to the next one is divided into a whole number of shards.
    """
    rest, apart = total - at, []
    for size, end in largest:
        if shards == 1 or size * shards <= rest:
            break
        rest, shards = rest - size, shards - 1
        apart.append(end - size)
    share = max(1, rest // shards)
    stretch = min(apart, default=total) - at
    if apart and stretch:
        share = stretch // max(1, round(stretch / share))
    return at + share


def even_cuts(runs: DataFrame, total: int, longest: int, groups: int, shards: int) -> list[int]:
    """Where to cut: shards - 1 running sizes in order, none of the runs above the smallest capacity.

    Filling every run up to the capacity would leave the last ones empty where
    one large group alone decides it.  So each run ends as near as can be to an
    even share of what is left, at a place from which the rest still fits, and
    no run is empty as long as there are groups for all.
    """
    used = min(shards, groups)
    capacity = smallest_capacity(runs.select("end"), total, longest, used)
    # From the end backwards: what each cut must reach, so that the rest fits.
    least = [total]
    for _ in range(used - 1):
        need = least[-1] - capacity
        if need <= 0:
            least.append(0)
            continue
        near = runs.where((F.col("end") >= need) & (F.col("end") < need + longest))
        least.append(near.agg(F.min("end")).first()[0])
    least = least[::-1]
    # As many groups as shards at most.
    largest = [(r["bytes"], r["end"]) for r in runs.select("bytes", "end").orderBy(F.desc("bytes")).limit(used).collect()]
    cuts, at = [], 0
    for k in range(1, used):
        share = even_end(at, total, used - k + 1, [x for x in largest if x[1] > at])
        allowed = runs.where(
            (F.col("end") >= least[k - 1]) & (F.col("end") <= at + capacity) & (F.col("end") > at)
            & (F.col("number") <= groups - 1 - (used - k))
        )
        below, above = allowed.agg(
            F.max(F.when(F.col("end") <= share, F.col("end"))), F.min(F.when(F.col("end") > share, F.col("end")))
        ).first()
        at = min((x for x in (below, above) if x is not None), key=lambda x: abs(x - share))
        cuts.append(at)
    return cuts + [total] * (shards - used)


def shard_texts(documents: DataFrame, shards: int = 8) -> DataFrame:
    """All documents in shards 0 to shards - 1 of nearly equal bytes; equal texts stay together.

    A size is the text's UTF-8 bytes plus 1.  Groups of equal texts are ordered
    by their smallest doc_id and cut into runs.  Within a shard, ``slot`` counts
    from 0 along that order.  A null text has size 1 and is the same group as
    other null texts (an empty text is another group); a row without doc_id goes
    with its text, ordered before all ids; repeated rows are rows; other columns,
    whatever their names, are not looked at.  Shards stay empty only if there are
    fewer groups than shards, and no shard is larger than the smallest capacity that
    is enough; a group larger than an even share leaves the rest to the others,
    which share it evenly.
    """
    rows = stored(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (text_bytes(F.col("text")) + 1).alias("size"),
            crc32_of(F.col("text")).alias("text_crc32"),
            F.coalesce(F.sha2("text", 256), F.lit("")).alias("same"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("same").agg(F.min("doc_id").alias("first_id"), F.sum("size").alias("bytes"))
    runs = numbered(groups, ["first_id", "same"], "shard-groups", weight=F.col("bytes"))
    runs = stored(runs.withColumn("end", F.col("before") + F.col("bytes")), "shard-runs")
    total, longest, count = runs.agg(F.sum("bytes"), F.max("bytes"), F.count("*")).first()
    cuts = even_cuts(runs, total, longest, count, shards) if total else []
    shard = sum([(F.col("end") > cut).cast("int") for cut in cuts], F.lit(0))
    placed = rows.join(runs.select("same", F.col("number").alias("run"), shard.cast("int").alias("shard")), "same")
    ordered = numbered(
        placed.select("shard", "run", "doc_id", "size", "text_crc32"), ["run", "doc_id", "size"], "shard-slots", "place"
    )
    # A row per shard.
    firsts = ordered.groupBy("shard").agg(F.min("place").alias("first_place"))
    return ordered.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("first_place")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
