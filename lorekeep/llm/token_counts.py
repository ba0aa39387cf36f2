"""Token counts of whole texts, by merging many words at once in arrays.

The distinct words of a block of texts lie one after the other in one array of
symbols.  In each round every word finds the pair of neighbours with the lowest
rank among its own, and all words merge that pair at the same time, wherever it
occurs in them.  Words without a pair left leave the arrays; what survives of
them is the number of their tokens.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.tokens import PieceStore, blocks, pieces_of, tokenizer, whole_words

_NONE = np.iinfo(np.int64).max


class Merges:
    """The merge list of a tokenizer file as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.size = max(vocabulary.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        self.made = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)
        self.inner = {s: i for s, i in vocabulary.items() if len(s) == 1}
        self.last = {s[0]: i for s, i in vocabulary.items() if self.end and s[1:] == self.end}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; _NONE where there is no merge."""
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], _NONE)

    def symbols(self, word: str) -> list[int]:
        """First symbols of a word; a sign that the vocabulary lacks has none."""
        signs = [self.inner.get(c) for c in word]
        if self.end and word:
            signs[-1] = self.last.get(word[-1])
        return [s for s in signs if s is not None]

    def counts(self, words: list[str]) -> np.ndarray:
        """How many symbols are left of each word when no pair can be merged."""
        first = [self.symbols(w) for w in words]
        total = np.fromiter(map(len, first), dtype=np.int64, count=len(first))
        owner = np.repeat(np.arange(len(words)), total)
        symbol = np.fromiter((s for x in first for s in x), dtype=np.int64, count=len(owner))
        rank = self._ranks(symbol, owner)
        while True:
            # The lowest rank of each word that still has symbols here.
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            if not len(starts):
                return total
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(owner)))
            active = np.repeat(lowest != _NONE, sizes)
            least = np.repeat(lowest, sizes)[active]
            owner, symbol, rank = owner[active], symbol[active], rank[active]
            merge = rank == least
            at = np.flatnonzero(merge)
            # Of overlapping pairs of equal symbols every other one, from the left.
            run = np.cumsum(np.diff(at, prepend=-2) > 1)
            place = np.arange(len(at)) - np.searchsorted(run, run)
            at = at[place % 2 == 0]
            total -= np.bincount(owner[at], minlength=len(total))
            symbol[at] = self.made[rank[at]]
            kept = np.ones(len(symbol), dtype=bool)
            kept[at + 1] = False
            # Only pairs at a new symbol, or just before one, change their rank.
            stale = np.zeros(len(symbol), dtype=bool)
            stale[at] = True
            owner, symbol, rank, stale = owner[kept], symbol[kept], rank[kept], stale[kept]
            stale[:-1] |= stale[1:]
            changed = np.flatnonzero(stale)
            rank[changed] = self._ranks(symbol, owner, changed)

    def _ranks(self, symbol: np.ndarray, owner: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Rank of the pair that begins at each place; none at the end of a word."""
        at = np.arange(len(symbol)) if at is None else at
        following = np.minimum(at + 1, max(len(symbol) - 1, 0))
        within = (at + 1 < len(symbol)) & (owner[following] == owner[at])
        out = np.full(len(at), _NONE)
        out[within] = self.rank(symbol[at[within]], symbol[following[within]])
        return out


@functools.cache
def merges(path: str) -> Merges:
    return Merges(path)


def split_words(text: str, path: str) -> tuple[list[str], int]:
    """The words that the tokenizer cuts a text into, and how many special tokens it takes out first."""
    tool = tokenizer(path)
    special = [t.content for t in tool.get_added_tokens_decoder().values()]
    parts = re.split("|".join(map(re.escape, special)), text) if special else [text]
    words: list[str] = []
    for part in filter(None, parts):
        part = tool.normalizer.normalize_str(part) if tool.normalizer else part
        words += [w for w, _ in tool.pre_tokenizer.pre_tokenize_str(part)]
    return words, len(parts) - 1


def count_pieces(pieces: list[bytes], path: str) -> np.ndarray:
    """Tokens of each piece of text."""
    words = whole_words(pieces, path)
    found = [[w] if w is not None else None for w in words]
    extra = np.zeros(len(pieces), dtype=np.int64)
    for i, word in enumerate(words):
        if word is None:
            found[i], extra[i] = split_words(pieces[i].decode(), path)
    slots: dict[str, int] = {}
    places = [slots.setdefault(w, len(slots)) for ws in found for w in ws]
    counts = merges(path).counts(list(slots))
    owner = np.repeat(np.arange(len(pieces)), np.fromiter(map(len, found), dtype=np.int64, count=len(found)))
    summed = np.bincount(owner, weights=counts[places], minlength=len(pieces)) if places else np.zeros(len(pieces))
    return summed.astype(np.int64) + extra


@functools.cache
def count_store(path: str) -> PieceStore:
    """The worker's store of counts for a tokenizer file."""

    def compute(pieces):
        return count_pieces(pieces, path).astype(np.uint32), np.ones(len(pieces), dtype=np.int64)

    return PieceStore(compute)


def counted(texts: pa.Array, path: str) -> np.ndarray:
    """Tokens of each text; none for a null or empty one."""
    out = np.zeros(len(texts), dtype=np.int64)
    store = count_store(path)
    for data, offsets, row in blocks(texts):
        if not len(data):
            continue
        coded, firsts = pieces_of(data, offsets)
        flat, _, rows = store.values(coded.dictionary.to_pylist())
        sums = np.append(0, np.cumsum(flat[rows[coded.indices.to_numpy()]], dtype=np.int64))
        out[row : row + len(offsets) - 1] = np.diff(sums[firsts])
    return out


def token_counts(documents: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """Bytes and tokens of every whole text, without begin and end tokens.

    Returns a row per row: ``doc_id``, ``n_bytes``, ``n_tokens`` and
    ``over_limit``.  Null and empty texts have none of either.  Strings of
    special tokens inside a text count as one token, as the library has it.
    Other columns are not looked at.
    """

    def run(batches):
        for batch in batches:
            text = batch.column("text")
            size = pc.binary_length(text.cast(pa.binary())).fill_null(0).cast(pa.int64())
            count = counted(text, tokenizer_path)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), size, pa.array(count), pa.array(count > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
