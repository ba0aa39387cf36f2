"""Benchmark passages in documents, by one automaton over all benchmark texts.

Bytes are mapped one to one: A-Z to lower case, and every ASCII sign that is not
part of a word to a space.  A window is ten words of an item.  The automaton
(Aho-Corasick) holds the items cut into tiles of five words, so its size follows
the items and not their windows, of which there are ten times as much: every
window holds a whole tile.  Texts of words with single spaces between them are
scanned once; where a tile occurs, the match is followed word by word in both
directions, and ten words or more are windows.  Since the mapping keeps positions,
a word that is hit is found again in the original text.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a window, and bytes of normalised items that one automaton may hold at
#: most (it takes about fifty times that in each worker); more is an error, not a cut.
WINDOW = 10
MAX_ITEM_BYTES = 6 << 20

_WORD = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(0x80, 0x100))
_MAP = bytes(b if b in _WORD else 0x20 for b in bytes(range(256)).lower())


def normalised(text: str | None) -> bytes:
    """The text's bytes with words lower-cased and all else as spaces, in place."""
    return text.encode().translate(_MAP) if text else b""


def joined(words: list[bytes]) -> str:
    """Words with single spaces between and around them, a sign per byte."""
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


@dataclass
class Benchmark:
    """Texts of a benchmark, each with the ids of the items that have it, and the words of a window."""

    texts: list[list[bytes]]
    items: list[list[str]]
    size: int

    def tiles(self, i: int) -> list[tuple[int, int]]:
        """Where the tiles of a text begin, and their words; a text shorter than a window is one tile."""
        n = len(self.texts[i])
        if n <= self.size:
            return [(0, n)]
        step = max(1, self.size // 2)
        return [(at, step) for at in range(0, n - step + 1, step)]


def benchmark_of(items: DataFrame, size: int = WINDOW) -> Benchmark:
    """The distinct normalised texts of a benchmark.

    A benchmark is a stated set of questions and answers that is small beside
    the corpus; its texts are measured, and refused beyond a bound.  A text
    without words has no window; one that only rows without id have, no items.
    """

    def run(batches):
        for batch in batches:
            words = [b" ".join(normalised(t).split()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(words, pa.binary())], ["item", "words"])

    rows = items.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(run, "item string, words binary")
    found = rows.where(F.length("words") > 0).groupBy("words").agg(F.collect_set("item").alias("items"))
    total = found.agg(F.sum(F.length("words") + F.length(F.concat_ws(",", "items")))).first()[0] or 0
    if total > MAX_ITEM_BYTES:
        raise ValueError(f"a benchmark of {total} bytes; give it in parts of at most {MAX_ITEM_BYTES}")
    got = found.orderBy("words").collect()
    return Benchmark([bytes(r["words"]).split() for r in got], [sorted(r["items"]) for r in got], size)


#: The automaton last used in this worker, by the digest of its benchmark.
_BUILT: dict[str, ahocorasick.Automaton] = {}


def automaton(name: str, benchmark: Benchmark) -> ahocorasick.Automaton:
    """All tiles, each with the texts and places it has and its words."""
    if name not in _BUILT:
        places: dict[str, list[tuple[int, int, int]]] = {}
        for i, words in enumerate(benchmark.texts):
            for at, n in benchmark.tiles(i):
                places.setdefault(joined(words[at : at + n]), []).append((i, at, n))
        made = ahocorasick.Automaton()
        for tile, found in places.items():
            made.add_word(tile, found)
        made.make_automaton()
        _BUILT.clear()
        _BUILT[name] = made
    return _BUILT[name]


def hit_words(words: list[bytes], scan: ahocorasick.Automaton, benchmark: Benchmark) -> tuple[np.ndarray, set[int]]:
    """Which words lie in an occurrence of a window, and the benchmark texts whose windows occur."""
    found = list(scan.iter(joined(words))) if words else []
    marks, texts = np.zeros(len(words) + 1, dtype=np.int64), set()
    if found:
        # A tile ends at the space that follows its last word.
        spaces = np.cumsum([len(w) + 1 for w in words])
        after = (np.searchsorted(spaces, [end for end, _ in found]) + 1).tolist()
        # How far each text has been followed at each shift against the document.
        followed: dict[tuple[int, int], int] = {}
        for end, (_, places) in zip(after, found, strict=True):
            for i, at, n in places:
                own, begin = benchmark.texts[i], end - n
                if followed.get((i, begin - at), 0) >= end:
                    continue
                low, high = 0, n
                while low < min(at, begin) and own[at - low - 1] == words[begin - low - 1]:
                    low += 1
                while high < min(len(own) - at, len(words) - begin) and own[at + high] == words[begin + high]:
                    high += 1
                followed[i, begin - at] = begin + high
                if low + high >= min(benchmark.size, len(own)):
                    marks[begin - low] += 1
                    marks[begin + high] -= 1
                    texts.add(i)
    return np.cumsum(marks[:-1]) > 0, texts


def spans_of(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges of runs of hit words in the original text."""
    data = np.frombuffer(b" " + normalised(text) + b" ", dtype=np.uint8) == 0x20
    edges = np.flatnonzero(data[1:] != data[:-1])
    begins, ends = edges[0::2][hit], edges[1::2][hit]
    index = np.flatnonzero(hit)
    breaks = np.flatnonzero(np.diff(index) > 1)
    return list(zip(begins[np.append(0, breaks + 1)].tolist(), ends[np.append(breaks, -1)].tolist(), strict=True))


def scanner(documents: DataFrame, items: DataFrame, size: int):
    """A function for tasks: the words of a text, which are hit, and the benchmark texts whose windows occur."""
    found = benchmark_of(items, size)
    name = hashlib.sha256(repr((found.texts, size)).encode()).hexdigest()
    # Bounded by MAX_ITEM_BYTES.
    shared = documents.sparkSession.sparkContext.broadcast(found)

    def scan(text: str | None) -> tuple[list[bytes], np.ndarray, set[int]]:
        words = normalised(text).split()
        if not shared.value.texts:
            return words, np.zeros(len(words), dtype=bool), set()
        return words, *hit_words(words, automaton(name, shared.value), shared.value)

    return scan, shared


def leaks(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """What each document has of the benchmark.

    Returns a row per row: ``doc_id``, ``n_words``, ``n_hit`` (words inside any
    occurrence of a window), ``items`` (items with occurring windows, sorted as
    strings) and ``spans`` (byte ranges of the hit runs in the original text).
    A null text has no words; an empty benchmark or items without words hit
    nothing; items that share an id are one; windows of items without id hit like
    any other, only the list of items leaves them out.  Rows that repeat an id are
    rows of their own.  Other columns, whatever their names, are not looked at.
    """
    scan, shared = scanner(documents, benchmark, size)

    def run(batches):
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                text = value.as_py()
                words, hit, found = scan(text)
                items = sorted({item for i in found for item in shared.value.items[i]})
                spans = [{"begin": a, "end": b} for a, b in spans_of(text, hit)] if found else []
                rows.append((len(words), int(hit.sum()), items, spans))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(span))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "n_words", "n_hit", "items", "spans"],
            )

    schema = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<begin:long,end:long>>"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def digests(found: DataFrame) -> DataFrame:
    """The rows of ``leaks`` with the items counted and digested."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def without_leaks(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows, with all their columns, in which no window of the benchmark occurs.

    Each row is judged by its own text as it is read; nothing is shuffled.
    """
    scan, _ = scanner(documents, benchmark, size)

    def run(batches):
        for batch in batches:
            clean = [not scan(value.as_py())[2] for value in batch.column("text")]
            yield batch.filter(pa.array(clean, pa.bool_()))
        # The worker may go on to other work.
        _BUILT.clear()

    return documents.mapInArrow(run, documents.schema)
