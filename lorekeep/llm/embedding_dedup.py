"""Near-duplicate vectors by cross-polytope hashing.

Each table of the index turns a unit vector by random signs and fast Hadamard
transforms, a few times over; its hash is the coordinate axis, with sign, that
the turned vector is closest to.  Several such hashes make a bucket.  A vector
lies in its own bucket of each table and in the next best ones, where the axis
of one hash is replaced by its runner-up with the smallest loss (multiprobe).
Pairs that share a bucket are verified by their exact cosine; a pair that
shares more buckets is verified in the first of them only, so its link is
counted once and no pair is ever written out.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.buckets import blocked, compare
from lorekeep.llm.components import connected, same_id_links
from lorekeep.llm.tables import stored

#: Tables, hashes in a bucket, and buckets of a vector in each table beside its own.
#: A pair at the threshold shares no bucket with a chance of well below 1e-6, at 64
#: and at 768 dimensions (see the tests for the measured chance in one table).
TABLES, HASHES, PROBES = 10, 3, 3
#: Rounds of signs and transforms in one rotation.
ROUNDS = 3
SEED = 20
#: Vectors hashed together.
TOGETHER = 2048


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the last axis, whose length is a power of two."""
    n, h = x.shape[-1], 1
    x, out = x.copy(), np.empty_like(x)
    while h < n:
        pairs, made = (y.reshape(*x.shape[:-1], n // (2 * h), 2, h) for y in (x, out))
        np.add(pairs[..., 0, :], pairs[..., 1, :], out=made[..., 0, :])
        np.subtract(pairs[..., 0, :], pairs[..., 1, :], out=made[..., 1, :])
        x, out = out, x
        h *= 2
    x *= x.dtype.type(1 / np.sqrt(n))
    return x


def rotated(unit: np.ndarray, table: int, part: int) -> np.ndarray:
    """The vectors, padded to a power of two, after one of the fast rotations."""
    n = 1 << max(1, (unit.shape[1] - 1).bit_length())
    signs = np.random.default_rng((SEED, table, part, n)).choice([-1.0, 1.0], (ROUNDS, n)).astype(unit.dtype)
    x = np.zeros((len(unit), n), dtype=unit.dtype)
    x[:, : unit.shape[1]] = unit
    for sign in signs:
        x = hadamard(x * sign)
    return x


def short(code: np.ndarray) -> np.ndarray:
    """A 31-bit name of the axes of several hashes."""
    mixed = code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(33)).astype(np.int32)


def codes(unit: np.ndarray) -> np.ndarray:
    """Buckets of unit vectors: rows x tables x (1 + probes); a vector's own bucket first."""
    # Half the width is enough to choose a bucket; equal vectors still get equal ones.
    unit = unit.astype(np.float32)
    rows = np.arange(len(unit))
    out = np.empty((len(unit), TABLES, 1 + PROBES), dtype=np.int32)
    for table in range(TABLES):
        axes, seconds, losses = [], [], []
        for part in range(HASHES):
            x = rotated(unit, table, part)
            size = np.abs(x)
            best = size.argmax(axis=1)
            top = size[rows, best]
            size[rows, best] = -1
            second = size.argmax(axis=1)
            axes.append(2 * best + (x[rows, best] < 0))
            seconds.append(2 * second + (x[rows, second] < 0))
            losses.append(top - size[rows, second])
        base = 2 * x.shape[1]
        scale = [pow(base, k, 1 << 62) for k in range(HASHES)]
        own = sum(a * s for a, s in zip(axes, scale, strict=True))
        out[:, table, 0] = short(own)
        order = np.argsort(np.stack(losses, axis=1), axis=1, kind="stable")
        change = np.stack([(b - a) * s for a, b, s in zip(axes, seconds, scale, strict=True)], axis=1)
        for probe in range(PROBES):
            out[:, table, 1 + probe] = short(own + change[rows, order[:, probe % HASHES]])
    return out


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """The vectors, which have one length and no nulls, as unit rows in double precision."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(vectors), -1) if len(vectors) else np.empty((0, 1))
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def by_length(vectors: pa.Array) -> list[np.ndarray]:
    """Positions of the vectors of each length."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    return [np.flatnonzero(lengths == n) for n in np.unique(lengths)]


def add_codes(batches):
    for batch in itertools.chain.from_iterable(
        (b.slice(i, TOGETHER) for i in range(0, b.num_rows, TOGETHER)) for b in batches
    ):
        vectors = batch.column("embedding")
        out = np.empty((batch.num_rows, TABLES * (1 + PROBES)), dtype=np.int32)
        for rows in by_length(vectors):
            out[rows] = codes(unit_rows(vectors.take(pa.array(rows)))).reshape(len(rows), -1)
        ends = np.arange(0, out.size + 1, max(1, out.shape[1]), dtype=np.int32)
        lists = pa.ListArray.from_arrays(ends, pa.array(out.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "codes"])


def usable(vector: Column, label: Column) -> Column:
    """Whether a vector can have links: a label, a direction, and finite components only."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(label.isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    threshold: float = 0.98,
) -> DataFrame:
    """Links between the vectors of a label whose cosine reaches the threshold, and their components.

    Returns a row per row: the id, ``n_links`` (other rows linked directly),
    ``component_id`` (the smallest id that links lead to, its own included) and
    ``kept``.  A vector that is null, empty, zero or holds null or non-finite
    components, and one without label, links with nothing; so do vectors of
    different length.  Equal vectors are linked; rows that repeat an id are
    vectors of their own in ``n_links`` and the same node in the components,
    whatever their vectors and labels.  A row without id links with nothing and
    is returned with a null component and kept false.  Other columns are not
    looked at.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("node"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label")
    )
    # 128 bits name a label and vector; equal vectors are compared once.
    key = [F.xxhash64("label", "embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding", "label").alias("k2")]
    good = rows.where(F.col("node").isNotNull() & usable(F.col("embedding"), F.col("label"))).select("*", *key)
    classes = good.groupBy("k1", "k2").agg(
        F.min("node").alias("least"), F.count("*").alias("weight"),
        F.first("embedding").alias("embedding"), F.first("label").alias("label"),
    )
    types = dict(classes.dtypes)
    coded = classes.mapInArrow(
        add_codes,
        f"k1 long, k2 long, least long, weight long, embedding {types['embedding']}, label {types['label']}, codes array<int>",
    )
    # Classes of equal vectors are numbered, and keep their numbers by being written.
    coded = stored(coded.withColumn("node", F.monotonically_increasing_id()), "vector-codes")
    # A bucket is a table and a code, within a label; a code that a vector has
    # twice in a table counts once.
    places = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(TABLES - 1)),
            lambda t: F.transform(
                F.array_distinct(F.slice("codes", t * (1 + PROBES) + 1, F.lit(1 + PROBES))),
                lambda c: F.shiftleft(t.cast("long"), 32) + c,
            ),
        )
    )
    members = coded.select("node", "label", F.explode(places).alias("at"))
    members = members.select("node", "at", F.xxhash64("label", "at").alias("bucket"))
    # Only what shares a bucket fetches its vector.
    members = blocked(members, "bucket", "node").join(coded.select("node", "weight", "embedding", "codes"), "node")

    def verify(table: pa.Table):
        vectors = table.column("embedding").combine_chunks()
        lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
        unit = np.zeros((table.num_rows, int(lengths.max())))
        for chosen in by_length(vectors):
            part = unit_rows(vectors.take(pa.array(chosen)))
            unit[chosen, : part.shape[1]] = part
        code = table.column("codes").combine_chunks().flatten().to_numpy().reshape(-1, TABLES, 1 + PROBES)
        bucket = table.column("bucket").to_numpy()
        at = table.column("at").to_numpy()

        def linked(i, j):
            near = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
            near &= (lengths[i] == lengths[j]) & (bucket[i] == bucket[j])
            hits = np.flatnonzero(near)
            a, b = code[i[hits]], code[j[hits]]
            shared = (a[:, :, :, None] == b[:, :, None, :]).any(axis=3)
            first = np.where(shared, a, np.iinfo(np.int32).max)
            table_of = shared.any(axis=2).argmax(axis=1)
            code_of = first[np.arange(len(hits)), table_of].min(axis=1)
            near[hits] = (at[i[hits]] == table_of * (1 << 32) + code_of)
            return near

        return linked

    found = stored(compare(members, verify, ["embedding", "codes", "bucket", "at"]), "vector-links")
    links = stored(found.groupBy("node").agg(F.sum("links").alias("links")), "vector-counts")
    # A row that links with nothing still is the node of its id.
    classes = coded.select("k1", "k2", F.col("node").alias("class"), "least", "weight")
    placed = stored(good.select("node", "k1", "k2").join(classes.drop("least"), ["k1", "k2"]), "vector-rows")
    groups = connected(
        found.select("node", "root").unionByName(same_id_links(placed, "node", "class")), "node", "root"
    ).withColumnRenamed("node", "class")
    settled = classes.join(links.withColumnRenamed("node", "class"), "class", "left").join(groups, "class", "left")
    settled = settled.select(
        "class", "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "class").alias("component"),
    )
    settled = stored(settled, "vector-classes")
    smallest = settled.groupBy("component").agg(F.min("least").alias("component_id"))
    settled = stored(settled.join(smallest, "component").select("class", "n_links", "component_id"), "vector-components")
    linked_rows = placed.select("node", "class").join(settled, "class").select("node", "n_links", "component_id")
    alone = rows.where(~(F.col("node").isNotNull() & usable(F.col("embedding"), F.col("label"))))
    alone = alone.select("node", F.lit(0).cast("long").alias("n_links"))
    # An id whose other rows have links is in their component.
    known = linked_rows.where("node IS NOT NULL").groupBy("node").agg(F.min("component_id").alias("component_id"))
    alone = alone.join(known, "node", "left").select("node", "n_links", F.coalesce("component_id", "node").alias("component_id"))
    return linked_rows.union(alone).select(
        F.col("node").alias(id_col),
        "n_links",
        "component_id",
        F.coalesce(F.col("node") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
