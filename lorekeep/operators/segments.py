"""Tables kept as a base and small additions, so that a change writes what it changes.

A segment is a folder with rows and the keys that it replaces or removes in all
segments before it.  What is live of a segment is what no later one replaces.
Keys to be left out are few beside the rows and are broadcast as long as their
measured bytes are; beyond that the join is Spark's to shuffle and to split.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators.joins import MAX_BROADCAST_BYTES, ROW_BYTES

#: Segments, and share of the first one's rows that later ones have together, beyond which all are merged.
MAX_SEGMENTS, MERGE_SHARE = 8, 0.25


@dataclass(frozen=True)
class Segment:
    """A folder of rows, how many these are, and how many keys it replaces, of how many bytes."""

    path: str
    rows: int
    gone: int
    gone_bytes: int

    def as_list(self) -> list:
        return [self.path, self.rows, self.gone, self.gone_bytes]


def write_gone(keys: DataFrame, path: str) -> tuple[int, int]:
    """Write the keys that a segment replaces; returns how many there are and their bytes."""
    keys.distinct().write.mode("overwrite").parquet(f"{path}/gone")
    size = F.sum(F.octet_length(F.col(keys.columns[0]).cast("string")) + ROW_BYTES)
    n, size = keys.sparkSession.read.schema(keys.schema).parquet(f"{path}/gone").agg(F.count("*"), size).first()
    return n, size or 0


def live(
    spark: SparkSession, segments: tuple[Segment, ...], key: str, read: Callable[[int], DataFrame], gone_key: str | None = None
) -> list[DataFrame]:
    """The rows of each segment whose keys no later segment replaces; ``read`` gives a segment's rows."""
    out = []
    for i in range(len(segments)):
        rows, later = read(i), [s for s in segments[i + 1 :] if s.gone]
        if later:
            gone = spark.read.parquet(*[f"{s.path}/gone" for s in later]).select(F.col(gone_key or key).alias(key)).distinct()
            small = sum(s.gone_bytes for s in later) <= MAX_BROADCAST_BYTES
            rows = rows.join(F.broadcast(gone) if small else gone, key, "left_anti").select(*rows.columns)
        out.append(rows)
    return out


def all_of(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def to_be_merged(segments: tuple[Segment, ...]) -> bool:
    """Whether the additions have grown so many or so large that one new base is better."""
    added = sum(s.rows + s.gone for s in segments[1:])
    return len(segments) > MAX_SEGMENTS or (len(segments) > 1 and added > max(1, MERGE_SHARE * segments[0].rows))
