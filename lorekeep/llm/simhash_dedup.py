"""Near-duplicate texts by SimHash, with candidates pruned on a ring of segments.

The 64 bits of a fingerprint are a ring of four segments of 16.  If two
fingerprints differ in at most 3 bits, then from some segment on every chain of
1, 2, 3 and 4 consecutive segments differs in at most 3/4 of a bit per segment:
in 0, 1, 2 and 3 bits.  Candidates come from a bucket that follows from the
first three links of such a chain: the first segment is equal; of the second,
which may differ in one bit, one half is equal; of the third, with at most two
bits in both together, one third is equal.  A candidate pair then has to pass
the chain, link by link, before its whole distance is counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.llm.buckets import blocked, compare
from lorekeep.llm.components import connected, same_id_links
from lorekeep.llm.tables import stored

BITS, SEGMENTS = 64, 4
WIDTH = BITS // SEGMENTS
DISTANCE = 3
#: Words of a shingle, and the seed of its hash.
WORDS, SEED = 3, 42
#: Bits of a segment's halves and thirds.
_HALVES = [(0, 8), (8, 16)]
_THIRDS = [(0, 5), (5, 10), (10, 16)]
#: Shingles counted in one go.
_STEP = 50_000


def shingle_hashes(text: str | None, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Hashes of all shingles of a text, repeats included.

    Bytes A-Z are lower-cased; words are runs without ASCII white space.
    """
    found = text.encode().lower().split() if text else []
    if len(found) > words:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    else:
        shingles = [b" ".join(found)] if found else []
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, seed) for s in shingles), dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes; zero if there are none."""
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), _STEP):
        bits = np.unpackbits(hashes[i : i + _STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(texts: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """Adds ``print``, the fingerprint as a signed 64-bit integer, in place of ``text``."""

    others = texts.drop("text", "print")
    names = others.columns

    def run(batches):
        for batch in batches:
            text = batch.column("text")
            prints = [fingerprint(shingle_hashes(t.as_py(), words, seed)) for t in text]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(np.array(prints, dtype=np.uint64).view(np.int64))],
                [*names, "print"],
            )

    return texts.mapInArrow(run, T.StructType([*others.schema, T.StructField("print", T.LongType())]))


def chain_keys(prints: np.ndarray) -> np.ndarray:
    """The bucket names of fingerprints: rows x 24."""
    prints = prints.view(np.uint64)
    segments = [(prints >> np.uint64(WIDTH * s)) & np.uint64((1 << WIDTH) - 1) for s in range(SEGMENTS)]
    keys = []
    for start in range(SEGMENTS):
        first, second, third = (segments[(start + k) % SEGMENTS] for k in range(3))
        for low, high in _HALVES:
            half = (second >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)
            for begin, end in _THIRDS:
                rest = (third >> np.uint64(begin)) & np.uint64((1 << (end - begin)) - 1)
                name = len(keys)
                keys.append((np.uint64(name) << np.uint64(40)) | (first << np.uint64(16)) | (half << np.uint64(8)) | rest)
    return np.stack(keys, axis=1).view(np.int64)


def pigeonring(difference: np.ndarray) -> np.ndarray:
    """Whether some chain of segments keeps to its budget, link by link, all around."""
    parts = [
        np.bitwise_count((difference >> np.uint64(WIDTH * s)) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)
        for s in range(SEGMENTS)
    ]
    passed = np.zeros(len(difference), dtype=bool)
    for start in range(SEGMENTS):
        chain, total = np.ones(len(difference), dtype=bool), 0
        for length in range(1, SEGMENTS + 1):
            total = total + parts[(start + length - 1) % SEGMENTS]
            chain &= total <= length * DISTANCE / SEGMENTS
        passed |= chain
    return passed


def _bucket_rows(batches):
    for batch in batches:
        keys = chain_keys(batch.column("print").to_numpy())
        each = np.repeat(np.arange(batch.num_rows), keys.shape[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.ravel()), batch.column("node").take(pa.array(each)), batch.column("print").take(pa.array(each))],
            ["bucket", "node", "print"],
        )


def _verify(table: pa.Table):
    prints = table.column("print").to_numpy().view(np.uint64)
    bucket = table.column("bucket").to_numpy()

    def linked(i, j):
        passed = bucket[i] == bucket[j]
        difference = prints[i] ^ prints[j]
        passed[passed] = pigeonring(difference[passed])
        passed[passed] = np.bitwise_count(difference[passed]) <= DISTANCE
        return passed

    return linked


def linked_prints(nodes: DataFrame) -> DataFrame:
    """Links between fingerprints (``node``, ``print``) as rows of ``node`` and ``root``."""
    members = nodes.mapInArrow(_bucket_rows, "bucket long, node long, print long")
    members = blocked(members, "bucket", "node").withColumn("weight", F.lit(1).cast("long"))
    return compare(members, _verify, ["print", "bucket"])


def near_texts(documents: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """Fingerprint and component of every document.

    Returns a row per row: ``doc_id``, ``fingerprint`` (16 lower-case hex
    digits) and ``component_id``, the smallest doc_id that links of at most 3
    differing bits lead to, its own included.  Null texts and texts without
    words have fingerprint zero and are linked like any other.  Links join
    fingerprints, also those that only rows without id have; rows that repeat an
    id are one node, so their fingerprints are of one component.  A component
    without any id is null.  Other columns are not looked at.
    """
    rows = fingerprints(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), words, seed)
    rows = stored(rows, "prints")
    # Equal fingerprints are one node, named by the fingerprint itself.
    nodes = stored(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "print-nodes")
    links = linked_prints(nodes.select(F.col("print").alias("node"), "print")).select("node", "root")
    groups = connected(links.unionByName(same_id_links(rows, "doc_id", "print")), "node", "root")
    named = nodes.join(groups.withColumnRenamed("node", "print"), "print", "left").select(
        "print", "least", F.coalesce("component", "print").alias("component")
    )
    named = stored(named, "print-components")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stored(named.join(least, "component").select("print", "component_id"), "print-least")
    hexed = F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint")
    return rows.join(named, "print").select("doc_id", hexed, "component_id")


def one_row_of_each(documents: DataFrame) -> DataFrame:
    """The documents without near copies: just one row of each component of fingerprints.

    It is the row with the smallest id, rows without id being last; of rows with
    the same id that with the smallest digest of its text, and of those the
    first as the rows are written here.  Rows without id and rows that repeat an
    id are rows of their own, so a text unlike all others stays whatever its id.
    """
    row = "_row"
    while row in documents.columns:
        row += "_"
    # Numbers are only the same on each reading if they are written.
    numbered = stored(documents.withColumn(row, F.monotonically_increasing_id()), "copies-rows")
    place = F.struct(
        F.col("doc_id").isNull().alias("last"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.sha2("text", 256), F.lit("")).alias("digest"), F.col(row).alias("row"),
    )
    rows = stored(fingerprints(numbered.select(place.alias("place"), "text")), "copies-prints")
    first = stored(rows.groupBy("print").agg(F.min("place").alias("place")), "copies-nodes")
    groups = connected(linked_prints(first.select(F.col("print").alias("node"), "print")), "node", "root")
    chosen = first.join(groups, F.col("print") == F.col("node"), "left")
    chosen = chosen.groupBy(F.coalesce("component", "print").alias("component")).agg(F.min("place").alias("place"))
    gone = rows.select(F.col("place.row").alias(row)).join(chosen.select(F.col("place.row").alias(row)), row, "left_anti")
    return numbered.join(gone, row, "left_anti").select(*documents.columns)
