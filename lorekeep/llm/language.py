"""Language of texts in two steps: the family first, then the languages within it.

Linear support vector machines over hashed byte trigrams.  One machine per
family tells it from the rest; within the family that wins, one machine per pair
of its languages votes, so closely related languages are told apart by what
distinguishes just these two.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.llm.tables import fraction, stored
from lorekeep.llm.tokens import blocks, ragged_take

#: Families of languages by code; a language that is in none is its own family.
FAMILIES = {
    "germanic": ("da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "semitic": ("ar", "he", "mt"),
    "turkic": ("az", "kk", "tr", "uz"),
    "uralic": ("et", "fi", "hu"),
    "indo-iranian": ("bn", "fa", "gu", "hi", "mr", "ne", "pa", "ur"),
}
#: Hash space of trigrams, and texts of each language that are learned from at most.
SPACE_BITS, PER_LANGUAGE = 12, 600
#: Languages that are learned, and texts of all of them together, at most; a longer
#: name than LONGEST_NAME bytes is no language.
MOST_LANGUAGES, MOST_TEXTS, LONGEST_NAME = 100, 12_000, 64
#: Bytes of text, and texts, whose trigrams are counted together.
STRETCH, TOGETHER = 1_000_000, 256
ROUNDS, SHRINK = 30, 1e-4
UNKNOWN = "und"

_LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def family_of(language: str) -> str:
    return next((f for f, members in FAMILIES.items() if language in members), language)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigram at each byte of a block, and whether it counts.

    Signs and digits are spaces; a trigram with a space in its middle, or at two
    places, tells nothing and does not count.  None reaches into the next text.
    """
    low = np.where(_LETTER[data], _LOWER[data], 0x20).astype(np.uint32)
    after = np.append(low[1:], 0x20)[: len(low)].astype(np.uint32)
    later = np.append(low[2:], [0x20, 0x20])[: len(low)].astype(np.uint32)
    ends = offsets[1:][offsets[1:] > 0]
    after[ends - 1] = later[ends - 1] = later[np.maximum(ends - 2, 0)] = 0x20
    counts = (after != 0x20) & ((low != 0x20) | (later != 0x20))
    code = low | after << np.uint32(8) | later << np.uint32(16)
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - SPACE_BITS), counts


def sums_by_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the values (a row per byte) over each text."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]))
    filled = np.flatnonzero(np.diff(offsets))
    if len(filled):
        out[filled] = np.add.reduceat(values, offsets[filled], axis=0, dtype=np.float64)
    return out


def counted(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each text of a block has each trigram: texts x trigrams.

    Texts of more than STRETCH bytes are counted stretch by stretch.
    """
    out = np.zeros((len(offsets) - 1, 1 << SPACE_BITS), dtype=np.float32)
    if len(data) <= STRETCH:
        code, counts = trigrams(data, offsets)
        owner = np.repeat(np.arange(len(out)), np.diff(offsets))
        both = (owner[counts] << SPACE_BITS) | code[counts]
        out += np.bincount(both, minlength=out.size).reshape(out.shape)
        return out
    for i, (a, b) in enumerate(itertools.pairwise(offsets.tolist())):
        for at in range(a, b, STRETCH):
            end = min(b, at + STRETCH)
            piece = data[at : min(b, end + 2)]
            code, counts = trigrams(piece, np.array([0, len(piece)]))
            chosen = code[: end - at][counts[: end - at]]
            out[i] += np.bincount(chosen, minlength=1 << SPACE_BITS)
    return out


def counts_of(texts: pa.Array):
    """Runs of a few texts, with the trigram counts of each and whether it has a letter."""
    for data, offsets, row in blocks(texts):
        for a, b in part_rows(offsets):
            piece, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            yield row + a, counted(piece, own), has_letter(piece, own)


def packed_profiles(texts: pa.Array) -> list[tuple[bytes, bytes]]:
    """Of each text the trigrams that it has, and their shares."""
    out = []
    for _, counts, _ in counts_of(texts):
        for row in counts:
            codes = np.flatnonzero(row)
            out.append((codes.astype("<u2").tobytes(), (row[codes] / max(1, row.sum())).astype("<f4").tobytes()))
    return out


@dataclass
class Rows:
    """Sparse rows: the trigrams of each text, one after the other, and their shares."""

    starts: np.ndarray
    lengths: np.ndarray
    codes: np.ndarray
    shares: np.ndarray

    @staticmethod
    def of(packed: list[tuple[bytes, bytes]]) -> Rows:
        lengths = np.array([len(c) // 2 for c, _ in packed], dtype=np.int64)
        codes = np.frombuffer(b"".join(c for c, _ in packed), dtype="<u2").astype(np.int64)
        return Rows(np.cumsum(lengths) - lengths, lengths, codes, np.frombuffer(b"".join(s for _, s in packed), dtype="<f4"))

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the rows each entry belongs to, its trigram and its share."""
        index, _ = ragged_take(self.starts, self.lengths, rows)
        return np.repeat(np.arange(len(rows)), self.lengths[rows]), self.codes[index], self.shares[index]

    def products(self, rows: np.ndarray, w: np.ndarray) -> np.ndarray:
        owner, codes, shares = self.take(rows)
        return np.bincount(owner, weights=shares * w[codes], minlength=len(rows))


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text of a block has a letter of any script."""
    found = sums_by_text(_ASCII_LETTER[data], offsets) > 0
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode())
    return found


def svm(rows: Rows, index: np.ndarray, sign: np.ndarray, seed: int = 1) -> tuple[np.ndarray, float, float]:
    """Linear support vector machine: weights, bias, and the slope that makes margins chances.

    Trained on the rows of ``index``.  Stochastic steps on the hinge loss, each
    side weighted alike; the average of the later steps is returned.
    """
    size = 1 << SPACE_BITS
    owner, _, shares = rows.take(index)
    norms = np.bincount(owner, weights=shares.astype(np.float64) ** 2, minlength=max(1, len(index)))
    scale = 1 / max(1e-9, float(np.sqrt(norms.mean()))) if len(index) else 1.0
    weight = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum())) * len(sign)
    w, bias = np.zeros(size), 0.0
    total, total_bias, kept, step = np.zeros(size), 0.0, 0, 0
    order = np.random.default_rng(seed)
    for turn in range(ROUNDS):
        for i in np.array_split(order.permutation(len(index)), max(1, len(index) // 16)):
            step += 1
            rate = 1 / (1 + 0.01 * step)
            owner, codes, shares = rows.take(index[i])
            shares = shares * scale
            margin = np.bincount(owner, weights=shares * w[codes], minlength=len(i)) + bias
            pull = sign[i] * weight[i] * (sign[i] * margin < 1) / max(1, len(i))
            w += rate * (np.bincount(codes, weights=pull[owner] * shares, minlength=size) - SHRINK * w)
            bias += rate * 0.1 * pull.sum()
            if turn >= ROUNDS // 2:
                total, total_bias, kept = total + w, total_bias + bias, kept + 1
    w, bias = (total / kept, total_bias / kept) if kept else (w, bias)
    # A logistic slope, by the margin that half of the texts reach.
    margin = np.median(np.abs(rows.products(index, w) * scale + bias)) if len(index) else 1.0
    return w * scale, bias, float(3 / max(1e-6, margin))


@dataclass
class Model:
    """Machines over trigram shares: first one per family, then one per pair of languages."""

    languages: list[str]
    families: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray
    bias: np.ndarray
    slope: np.ndarray

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        for row, counts, lettered in counts_of(texts):
            sums = counts.astype(np.float64) @ self.weights / np.maximum(1, counts.sum(axis=1, keepdims=True, dtype=np.float64))
            chance = 1 / (1 + np.exp(-np.clip((sums + self.bias) * self.slope, -30, 30)))
            for i in np.flatnonzero(lettered):
                names[row + i], scores[row + i] = self.decide(chance[i])
        return names, scores

    def decide(self, chance: np.ndarray) -> tuple[str, float]:
        family = int(np.argmax(chance[: len(self.families)]))
        members = [i for i, x in enumerate(self.languages) if family_of(x) == self.families[family]]
        score = float(chance[family]) if len(self.families) > 1 else 1.0
        if len(members) == 1:
            return self.languages[members[0]], score
        votes = {i: 0.0 for i in members}
        wins = {i: 0 for i in members}
        for k, (a, b) in enumerate(self.pairs, len(self.families)):
            if a in votes:
                votes[a] += chance[k]
                votes[b] += 1 - chance[k]
                wins[a if chance[k] >= 0.5 else b] += 1
        best = max(members, key=lambda i: (wins[i], votes[i]))
        return self.languages[best], score * votes[best] / (len(members) - 1)


def part_rows(offsets: np.ndarray):
    """Runs of texts of at most STRETCH bytes, a longer text alone, and of at most TOGETHER texts."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + STRETCH, "right")) - 1)
        b = min(b, a + TOGETHER)
        yield a, b
        a = b


def train(rows: Rows, language: np.ndarray) -> Model:
    """A model from trigram shares and the texts' languages."""
    languages = sorted(set(language.tolist()))
    families = sorted({family_of(x) for x in languages})
    own = np.array([family_of(x) for x in language.tolist()])
    everything = np.arange(len(language))
    machines = [svm(rows, everything, np.where(own == f, 1.0, -1.0)) for f in families]
    pairs = [
        (a, b) for a, b in itertools.combinations(range(len(languages)), 2)
        if family_of(languages[a]) == family_of(languages[b])
    ]
    for a, b in pairs:
        chosen = np.flatnonzero((language == languages[a]) | (language == languages[b]))
        machines.append(svm(rows, chosen, np.where(language[chosen] == languages[a], 1.0, -1.0)))
    weights = np.stack([m[0] for m in machines], axis=1) if machines else np.empty((1 << SPACE_BITS, 0))
    return Model(
        languages, families, pairs, weights.astype(np.float32),
        np.array([m[1] for m in machines], dtype=np.float64), np.array([m[2] for m in machines], dtype=np.float64),
    )


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(documents: DataFrame) -> Model:
    """A model from the texts with a language outside the held-out rows.

    The MOST_LANGUAGES names that most rows have are languages (of equally
    frequent ones the first in order); rows with another name are not learned
    from.  Of each language about PER_LANGUAGE documents, or an equal share of
    MOST_TEXTS if that is less, chosen by a hash of their id, are learned from,
    each whole; equal texts count once.
    """
    rows = documents.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.where("text IS NOT NULL").select(
        F.col("lang").cast("string").alias("lang"), fraction(F.col("doc_id")).alias("at"), "text"
    ).where((F.col("lang") != UNKNOWN) & (F.octet_length("lang") <= LONGEST_NAME))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    each = min(PER_LANGUAGE, MOST_TEXTS // max(1, len(sizes)))
    # A row per language, MOST_LANGUAGES at most.
    shares = documents.sparkSession.createDataFrame([(r["lang"], each / r["n"]) for r in sizes], "lang string, share double")
    sample = rows.join(F.broadcast(shares), "lang").where("at < share").select("lang", "text")
    sample = sample.dropDuplicates(["lang", "text"])

    def profile(batches):
        for batch in batches:
            packed = packed_profiles(batch.column("text"))
            columns = [pa.array(c, pa.binary()) for c in (list(zip(*packed, strict=True)) or [(), ()])]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), *columns], ["lang", "codes", "shares"])

    got = stored(sample.mapInArrow(profile, "lang string, codes binary, shares binary"), "language-sample")
    got = got.orderBy("lang", "codes", "shares").collect()
    return train(Rows.of([(r["codes"], r["shares"]) for r in got]), np.array([r["lang"] for r in got]))


def predict(documents: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds ``lang_pred`` and ``score``, or columns of other names, to the columns of the documents.

    ``und`` with score 0 where the text is null or has no letter, or where
    nothing was learned.  Columns of the same names are replaced.
    """
    rows = documents.drop(*names)
    added = [T.StructField(n, kind) for n, kind in zip(names, (T.StringType(), T.DoubleType()), strict=True)]
    schema = T.StructType([*rows.schema, *added])

    def run(batches):
        # The model is a few numbers per trigram for each machine.
        for batch in batches:
            found, scores = model.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.string()), pa.array(scores)], names=schema.names
            )

    return rows.mapInArrow(run, schema)


def with_letters(documents: DataFrame) -> DataFrame:
    """The rows, with all their columns, whose text has a letter of any script."""

    def run(batches):
        for batch in batches:
            lettered = np.zeros(batch.num_rows, dtype=bool)
            for data, offsets, row in blocks(batch.column("text")):
                for a, b in part_rows(offsets):
                    piece, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                    lettered[row + a : row + b] = has_letter(piece, own)
            yield batch.filter(pa.array(lettered))

    return documents.mapInArrow(run, documents.schema)


def languages(documents: DataFrame) -> DataFrame:
    """Language of every document: ``doc_id``, ``held_out``, ``lang_pred``, ``score``.

    Learned from the rows that are not held out.  Rows that repeat an id, or
    have none, are predicted like any other.  Other columns, whatever their
    names, are not looked at.
    """
    rows = predict(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), learn(documents))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
