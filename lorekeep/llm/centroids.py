"""Centroid clustering whose nearest-centroid search skips most distances, exactly.

Equal-average equal-variance search.  Centroids are sorted by the sum of their
components.  For a vector, the scan starts where its own sum belongs and goes
outward, always to the side that is nearer in the mean.  With ``n`` components,
means ``m`` and lengths ``v`` of the parts that deviate from the mean,

    distance >= n * (m - m')**2 + (v - v')**2

so a side is closed as soon as the means alone lie too far apart, and a centroid
is passed over where both terms together do.  What is left gets its distance in
whole numbers.  Bounds are compared in whole numbers (means) or with a margin for
rounding (deviations), so the centroid found is the nearest, and of equally near
ones the one with the smallest number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.tables import stored

#: Components, the factor that makes them whole numbers, centroids and rounds.
DIMENSIONS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Whole numbers beyond this in size could overflow a squared distance.
MOST = 1 << 27
#: Vectors searched together.
STEP = 4096


@dataclass(frozen=True)
class Centroids:
    """Centroids in the order of their sums, with what the inequalities need."""

    values: np.ndarray
    numbers: np.ndarray
    sums: np.ndarray
    deviations: np.ndarray

    @staticmethod
    def of(values: np.ndarray) -> Centroids:
        sums = values.sum(axis=1)
        order = np.argsort(sums, kind="stable")
        return Centroids(values[order], order, sums[order], deviation(values[order]))


def deviation(x: np.ndarray) -> np.ndarray:
    """Length of the part of each row that deviates from its mean."""
    return np.sqrt(((x - x.mean(axis=1, keepdims=True)) ** 2).sum(axis=1))


def nearest(x: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of the nearest centroid of each row, and how many distances that took."""
    n, k, width = len(x), len(centroids.sums), x.shape[1]
    sums, dev = x.sum(axis=1), deviation(x)
    best = np.full(n, np.iinfo(np.int64).max)
    number = np.full(n, k, dtype=np.int64)
    high = np.searchsorted(centroids.sums, sums)
    low = high - 1
    rows, taken = np.arange(n), 0
    while len(rows):
        lo, hi = low[rows], high[rows]
        below = np.where(lo >= 0, sums[rows] - centroids.sums[np.maximum(lo, 0)], MOST * 2 * width)
        above = np.where(hi < k, centroids.sums[np.minimum(hi, k - 1)] - sums[rows], MOST * 2 * width)
        left = below <= above
        apart, at = np.where(left, below, above), np.where(left, lo, hi)
        # The nearer side is the last hope: if its mean is too far, so are all others.
        # Divided, as the product with the width could overflow.
        open_ = ((lo >= 0) | (hi < k)) & ~((apart.astype(np.float64) ** 2 / width) * (1 - 1e-12) > best[rows])
        rows, at, left, apart = rows[open_], at[open_], left[open_], apart[open_]
        low[rows[left]] -= 1
        high[rows[~left]] += 1
        bound = apart.astype(np.float64) ** 2 / width + (dev[rows] - centroids.deviations[at]) ** 2
        margin = 1e-6 * (1 + dev[rows] + centroids.deviations[at])
        near = ~(bound * (1 - 1e-12) - margin * (1 + np.abs(dev[rows] - centroids.deviations[at])) > best[rows])
        chosen, at = rows[near], at[near]
        taken += len(chosen)
        distance = ((x[chosen] - centroids.values[at]) ** 2).sum(axis=1)
        named = centroids.numbers[at]
        better = (distance < best[chosen]) | ((distance == best[chosen]) & (named < number[chosen]))
        best[chosen[better]], number[chosen[better]] = distance[better], named[better]
    return number, best, taken


def whole_numbers(vectors: pa.Array, width: int, scale: int) -> np.ndarray:
    """Vectors of one length without nulls as rows of floor(scale * x)."""
    x = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width) * scale)
    if len(x) and np.abs(x).max() > MOST:
        raise ValueError(f"components beyond {MOST} in size after scaling: squared distances would not fit")
    return x.astype(np.int64)


def usable(vector: Column, width: int) -> Column:
    """Whether a vector has just so many components, all of them finite."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(vector) == width) & finite, F.lit(False))


def first_centroids(rows: DataFrame, k: int, width: int, scale: int, seed: int) -> np.ndarray:
    """The vectors whose seeded name has the smallest hashes; vectors without id are none of them."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    # Sorted with its limit, so each task keeps k rows.
    got = rows.where("vec_id IS NOT NULL").select(name.alias("name"), "vector").orderBy("name", "vector").limit(k).toArrow()
    return whole_numbers(got.column("vector").combine_chunks(), width, scale) if got.num_rows else np.empty((0, width), np.int64)


def moved(rows: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """Each centroid as the floored mean of the vectors nearest to it; one without vectors stays.

    Tasks add up their own vectors; what is shuffled is a row per task, centroid
    and component, and what reaches the driver one per centroid and component.
    """
    k, width = centroids.shape
    index = Centroids.of(centroids)

    def add_up(batches):
        sums, counts = np.zeros((k, width), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            x = whole_numbers(batch.column("vector"), width, scale)
            for i in range(0, len(x), STEP):
                number = nearest(x[i : i + STEP], index)[0]
                np.add.at(sums, number, x[i : i + STEP])
                counts += np.bincount(number, minlength=k)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.arange(k), width)), pa.array(np.tile(np.arange(width), k)),
                pa.array(sums.ravel()), pa.array(np.repeat(counts, width)),
            ],
            ["cluster", "component", "total", "n"],
        )

    added = rows.select("vector").mapInArrow(add_up, "cluster long, component long, total long, n long")
    added = added.groupBy("cluster", "component").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in added.where("n > 0").collect():
        out[r["cluster"], r["component"]] = r["total"] // r["n"]
    return out


def clusters(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS,
    rounds: int = ROUNDS, width: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED,
) -> tuple[DataFrame, np.ndarray]:
    """Cluster and squared distance of each vector, and the final centroids.

    Vectors that are null, of another length or hold null or non-finite
    components are left out.  Rows that repeat an id are vectors of their own,
    as start centroids too; a row without id is assigned but starts no
    centroid.  With fewer vectors than centroids there are as many centroids
    as vectors with an id; without any, no row is returned.  Other columns, whatever
    their names, are not looked at.  Each round reads the vectors anew; only
    centroids are kept between rounds.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    rows = rows.where(usable(F.col("vector"), width))
    centroids = first_centroids(rows, k, width, scale, seed)
    if len(centroids):
        for _ in range(rounds):
            centroids = moved(rows, centroids, scale)
    index = Centroids.of(centroids)

    def assign(batches):
        for batch in batches:
            if not len(index.sums):
                continue
            x = whole_numbers(batch.column("vector"), width, scale)
            found = [nearest(x[i : i + STEP], index)[:2] for i in range(0, len(x), STEP)] or [(np.empty(0, np.int64),) * 2]
            number, distance = (np.concatenate(c) for c in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"]
            )

    return stored(rows.mapInArrow(assign, "vec_id long, cluster int, distance long"), "clusters"), centroids


def with_digests(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds the inertia of each cluster and of all, and the digest of each centroid."""
    spark = assigned.sparkSession
    # One row per centroid in both.
    named = [(i, ",".join(map(str, c))) for i, c in enumerate(centroids.tolist())]
    digests = spark.createDataFrame(named, "cluster int, components string")
    digests = digests.select("cluster", F.sha2("components", 256).alias("centroid_sha256"))
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    facts = sums.join(F.broadcast(digests), "cluster").join(F.broadcast(total))
    return assigned.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
