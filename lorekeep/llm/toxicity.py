"""Toxicity of texts, learned from confirmed toxic ones and unlabelled text.

Non-negative positive-unlabelled learning: the unlabelled texts hold toxic ones
too, so their risk as clean text is corrected by the class prior and the
positive texts' share in it, and is kept from falling below zero, which would
be over-fitting.  The model is linear over beginnings of words and, of words longer
than these, over pieces of what follows, hashed, so that compounds, endings and
texts without spaces are read to their end.  Those are features that positive
texts have markedly more often than clean ones, whose rate is the unlabelled
texts' without the share that the prior says is toxic.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.llm.tables import fraction, stored
from lorekeep.llm.tokens import blocks

#: Hash space of features, and lengths in bytes of the beginnings of words; one
#: more than a word's length stands for the whole word.  Of longer words, pieces of
#: so many bytes from each later character on.
SPACE_BITS = 22
BEGINNINGS, PIECE = (4, 5, 6, 8), 6
#: Sizes of the training samples: confirmed toxic texts and unlabelled ones.
POSITIVES, UNLABELLED = 4_000, 16_000
#: A feature occurs in so many positive texts, at this ratio to clean ones, and so
#: many standard deviations more often than in unlabelled ones.
LEAST_TEXTS, LEAST_RATIO, LEAST_SURPRISE = 3, 4.0, 4.0
STEPS, RATE, SHRINK = 600, 0.05, 1e-4
#: Bytes of text whose features are found together; a longer text is taken alone.
TOGETHER = 1_000_000
#: Used where labels do not give the share of toxic texts.
DEFAULT_PRIOR = 0.1
#: Base of a model without features at most; a chance of just under a half.
UNTOLD = -0.01

_LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of beginning, and for pieces of long words: the text of each, and its hashed feature."""
    low = np.where(_WORD[data], _LOWER[data], 0).astype(np.uint8)
    begins = low != 0
    begins[1:] &= low[:-1] == 0
    begins[offsets[:-1][offsets[:-1] < len(data)]] |= low[offsets[:-1][offsets[:-1] < len(data)]] != 0
    at = np.flatnonzero(begins)
    owner = np.searchsorted(offsets, at, "right") - 1
    end = offsets[owner + 1]
    value = np.zeros(len(at), dtype=np.uint64)
    open_ = np.ones(len(at), dtype=bool)
    for k in range(max(BEGINNINGS)):
        place = at + k
        byte = np.where(place < end, low[np.minimum(place, len(low) - 1)], 0).astype(np.uint64)
        open_ &= byte != 0
        value |= np.where(open_, byte, 0).astype(np.uint64) << np.uint64(8 * k)
        if k + 1 in BEGINNINGS:
            yield owner, hashed(value, k + 1)
    gaps = np.append(np.flatnonzero(low == 0), len(low))
    last = np.minimum(gaps[np.searchsorted(gaps, at)], end)
    long = np.flatnonzero(last - at > max(BEGINNINGS))
    n = last[long] - at[long] - PIECE
    places = np.repeat(at[long] + 1 - (np.cumsum(n) - n), n) + np.arange(n.sum())
    whole = (data[places] & 0xC0) != 0x80
    places, owner = places[whole], np.repeat(owner[long], n)[whole]
    value = np.zeros(len(places), dtype=np.uint64)
    for k in range(PIECE):
        value |= low[places + k].astype(np.uint64) << np.uint64(8 * k)
    yield owner, hashed(value, 0)


def hashed(value: np.ndarray, kind: int) -> np.ndarray:
    return ((value * np.uint64(0x9E3779B97F4A7C15 + 2 * kind)) >> np.uint64(64 - SPACE_BITS)).astype(np.int64)


def distinct_features(texts: pa.Array, wanted: np.ndarray | None = None) -> list[np.ndarray]:
    """Distinct features of each text; only wanted ones where a mask is given."""
    out: list[np.ndarray] = []
    for data, offsets, _ in blocks(texts, TOGETHER):
        pairs = []
        for owner, feature in features(data, offsets) if len(data) else ():
            if wanted is not None:
                chosen = wanted[feature]
                owner, feature = owner[chosen], feature[chosen]
            pairs.append(np.unique((owner << SPACE_BITS) | feature))
        both = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, dtype=np.int64)
        cuts = np.searchsorted(both >> SPACE_BITS, np.arange(1, len(offsets) - 1))
        out += [x & ((1 << SPACE_BITS) - 1) for x in np.split(both, cuts)]
    return out


@dataclass
class Model:
    """The chosen features in order, their weights, and the base."""

    features: np.ndarray
    weights: np.ndarray
    base: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        wanted = mask_of(self.features)
        found = distinct_features(texts, wanted)
        sums = np.array([self.weights[np.searchsorted(self.features, x)].sum() for x in found], dtype=np.float64)
        return 1 / (1 + np.exp(-np.clip(sums + self.base, -30, 30)))


def mask_of(features: np.ndarray) -> np.ndarray:
    mask = np.zeros(1 << SPACE_BITS, dtype=bool)
    mask[features] = True
    return mask


def surprising(
    positive: np.ndarray, unlabelled: np.ndarray, n_positive: int, n_unlabelled: int, n_both: int, prior: float
) -> np.ndarray:
    """Which features, given in how many texts of each kind they occur, mark positive texts.

    ``n_both`` texts are in both samples; what these have in common is no chance.
    """
    n_positive, n_unlabelled = max(1, n_positive), max(1, n_unlabelled)
    rate, overall = positive / n_positive, unlabelled / n_unlabelled
    clean = np.maximum(0, overall - prior * rate) / (1 - prior)
    # Both rates as draws from one, half a text off in favour of chance.
    both = np.minimum(1, (positive + unlabelled + 0.5) / (n_positive + n_unlabelled))
    apart = 1 / n_positive + 1 / n_unlabelled - 2 * n_both / (n_positive * n_unlabelled)
    spread = np.sqrt(both * (1 - both) * max(0.0, apart))
    beyond = (positive - 0.5) / n_positive - (unlabelled + 0.5) / n_unlabelled
    return (positive >= LEAST_TEXTS) & (rate >= LEAST_RATIO * clean) & (beyond > 0) & (beyond >= LEAST_SURPRISE * spread)


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[np.ndarray, float]:
    """Weights and base by non-negative positive-unlabelled risk, logistic loss, full batches.

    The lists hold each text's feature numbers.  Where the corrected negative
    risk is below zero, the step goes against it instead of along the whole risk.
    """
    rows = positive + unlabelled
    size = 1 + max((int(r.max()) for r in rows if len(r)), default=0)
    column = np.concatenate(rows) if rows else np.empty(0, dtype=np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    is_positive = np.arange(len(rows)) < len(positive)
    n_positive, n_unlabelled = max(1, len(positive)), max(1, len(unlabelled))
    weights, base = np.zeros(size), np.log(prior / (1 - prior))
    moment = [np.zeros(size + 1), np.zeros(size + 1)]
    for step in range(1, STEPS + 1):
        margin = np.bincount(row, weights=weights[column], minlength=len(rows)) + base
        chance = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        as_negative = np.logaddexp(0, margin)
        negative_risk = as_negative[~is_positive].sum() / n_unlabelled - prior * as_negative[is_positive].sum() / n_positive
        # Slopes of the risks in each text's margin.
        slope_negative = np.where(is_positive, -prior * chance / n_positive, chance / n_unlabelled)
        slope_positive = np.where(is_positive, prior * (chance - 1) / n_positive, 0.0)
        slope = slope_positive + slope_negative if negative_risk >= 0 else -slope_negative
        gradient = np.append(np.bincount(column, weights=slope[row], minlength=size) + SHRINK * weights, slope.sum())
        moment[0] += 0.1 * (gradient - moment[0])
        moment[1] += 0.001 * (gradient**2 - moment[1])
        change = RATE * (moment[0] / (1 - 0.9**step)) / (np.sqrt(moment[1] / (1 - 0.999**step)) + 1e-8)
        weights -= change[:-1]
        # A text without any feature is no likelier toxic than texts are at large.
        base = min(base - change[-1], np.log(prior / (1 - prior)))
    return weights, float(base)


def learn(documents: DataFrame, known: DataFrame, prior: float | None = None) -> Model:
    """A model from the texts of documents; ``known`` says which are toxic (doc_id, toxic 1).

    Unlabelled text is drawn from all documents, confirmed ones among them, since
    the class prior is that of all.  The samples are about POSITIVES and
    UNLABELLED documents, chosen by a hash of their id; equal texts count once.
    Which they are is settled on ids, and only their texts are fetched.  Features
    are counted and chosen over both samples by Spark; the chosen features of the
    samples, a few per text, are what the training on the driver gets.  Without a
    feature that tells toxic texts, the model gives every text the prior, but
    less than a half, so that none is called toxic for want of a sign; there is a
    warning if there were confirmed texts.
    """
    prior = DEFAULT_PRIOR if prior is None else prior
    confirmed = F.coalesce(F.col("toxic"), F.lit(0)) == 1
    kinds = F.when(confirmed, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    ids = documents.select("doc_id").join(known, "doc_id", "left")
    ids = ids.select("doc_id", F.explode(kinds).alias("kind"), fraction(F.col("doc_id")).alias("at"))
    totals = {r["kind"]: r["count"] for r in ids.groupBy("kind").count().collect()}
    share = F.when(F.col("kind") == 1, POSITIVES / totals.get(1, 1)).otherwise(UNLABELLED / totals.get(0, 1))
    # About POSITIVES + UNLABELLED narrow rows.
    chosen = F.broadcast(ids.where(F.col("at") < share).select("doc_id", "kind").distinct())
    sample = documents.where("text IS NOT NULL").join(chosen, "doc_id").select("kind", "text").dropDuplicates(["kind", "text"])

    def count(batches):
        for batch in batches:
            kinds = batch.column("kind").to_pylist()
            found = distinct_features(batch.column("text"))
            for k in (0, 1):
                mine = [f for f, x in zip(found, kinds, strict=True) if x == k]
                feature, n = np.unique(np.concatenate(mine), return_counts=True) if mine else (np.empty(0, int),) * 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array(feature, pa.int64()), pa.array(n if k else 0 * n, pa.int64()), pa.array(0 * n if k else n, pa.int64())],
                    ["feature", "positive", "unlabelled"],
                )

    sample = stored(sample, "toxicity-sample")
    sizes = sample.groupBy(F.xxhash64("text").alias("text")).agg(F.max("kind").alias("positive"), (1 - F.min("kind")).alias("unlabelled"))
    sizes = sizes.groupBy("positive", "unlabelled").count().collect()
    n_positive, n_unlabelled = (sum(r["count"] for r in sizes if r[k]) for k in ("positive", "unlabelled"))
    n_both = sum(r["count"] for r in sizes if r["positive"] and r["unlabelled"])
    counts = sample.repartition(F.xxhash64("text")).mapInArrow(count, "feature long, positive long, unlabelled long")
    counts = counts.groupBy("feature").agg(F.sum("positive").alias("p"), F.sum("unlabelled").alias("u"))
    # Bounded by the hash space; as columns, not rows.
    likely = counts.where((F.col("p") >= LEAST_TEXTS) & (F.col("p") * n_unlabelled > F.col("u") * n_positive)).toArrow()
    feature = likely.column("feature").to_numpy()
    p, u = (likely.column(c).to_numpy().astype(np.float64) for c in ("p", "u"))
    feature = np.sort(feature[surprising(p, u, n_positive, n_unlabelled, n_both, prior)])
    if not len(feature):
        if n_positive:
            warnings.warn(f"no feature tells the {n_positive} toxic texts; no text is called toxic", stacklevel=2)
        return Model(feature, np.zeros(0), min(float(np.log(prior / (1 - prior))), UNTOLD))

    def look_up(batches):
        wanted = mask_of(feature)
        for batch in batches:
            found = distinct_features(batch.column("text"), wanted)
            yield pa.RecordBatch.from_arrays(
                [batch.column("kind"), pa.array([x.tolist() for x in found], pa.list_(pa.int64()))], ["kind", "found"]
            )

    got = sample.mapInArrow(look_up, "kind int, found array<long>").collect()
    texts = [[np.searchsorted(feature, r["found"]) for r in got if r["kind"] == k] for k in (1, 0)]
    found, base = train(*texts, prior)
    # Features that no sampled text has are not trained.
    chosen = np.flatnonzero(found)
    return Model(feature[chosen], found[chosen], base)


def score(documents: DataFrame, model: Model, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Adds ``score`` and ``predicted``, or columns of other names, to the columns of the documents.

    Every whole text is scored; a null or empty one has the score of a text
    without features.  Columns of the same names are replaced.
    """
    rows = documents.drop(*names)
    added = [T.StructField(n, kind) for n, kind in zip(names, (T.DoubleType(), T.IntegerType()), strict=True)]
    schema = T.StructType([*rows.schema, *added])

    def run(batches):
        # The model is a few numbers per chosen feature.
        for batch in batches:
            scores = model.scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=schema.names
            )

    return rows.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def learn_from_labels(documents: DataFrame, labels: DataFrame) -> Model:
    """A model from the documents and labels outside the held-out rows.

    The prior is the share of toxic among those labels.  Of documents with
    several labels the largest counts; a row without id is not learned from.
    """
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n, n_toxic = known.where("toxic IS NOT NULL").agg(F.count("*"), F.sum("toxic")).first()
    prior = min(0.9, max(0.001, n_toxic / n)) if n and n_toxic and n_toxic < n else DEFAULT_PRIOR
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return learn(texts, known.where("toxic = 1"), prior)


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of every document: ``doc_id``, ``held_out``, ``score``, ``predicted``.

    Rows that repeat an id, or have none, are scored like any other.  Other
    columns, whatever their names, are not looked at.
    """
    model = learn_from_labels(documents, labels)
    rows = score(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
