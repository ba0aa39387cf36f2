"""Token ids of many texts at once, with a public tokenizer file.

A text is cut where a letter, digit or sign is followed by white space, and
where a letter is followed by a stop.  The tokenizers used here never let a token reach across such a place and decide
nothing by what lies beyond it, so the ids of the pieces, one after the other,
are the ids of the text.  Pieces repeat a lot: each distinct one of a block of
texts is encoded once by the tokenizers library, and the ids of the block are
gathered by array indexing.  A bounded cache carries the first distinct pieces
(the frequent ones are among them) from block to block of a worker; it changes
the speed and never the ids.
"""

from __future__ import annotations

import functools
import itertools
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled together; a longer text is a block of its own.
BLOCK_BYTES = 6_000_000
#: Bytes of distinct pieces, and their number, kept from block to block in a worker.
CACHED_BYTES, CACHED_PIECES = 12_000_000, 300_000
#: Longer pieces are not kept.
CACHED_LENGTH = 64


def tokenizer_path(name: str) -> str:
    """Place of an installed tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def tokenizer(path: str):
    """The library's tokenizer of a file, once in each worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _flags(*spans: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for first, last in spans:
        out[first : last + 1] = True
    return out


# A cut lies before white space if the byte before it ends a character that is
# surely no white space (a printable ASCII sign, or a two-byte character from
# U+00C0 on), and before . , ; : ! ? if that byte ends a letter.
_PRINTABLE = _flags((0x21, 0x7E))
_LETTER = _flags((0x41, 0x5A), (0x61, 0x7A))
_CONTINUED = _flags((0x80, 0xBF))
_LATIN_LETTER = _flags((0x80, 0x96), (0x98, 0xB6), (0xB8, 0xBF))
_TWO_BYTE_LEAD = _flags((0xC3, 0xDF))
_LATIN_LEAD = _flags((0xC3, 0xC3))
_SPACE = _flags((0x09, 0x0A), (0x0D, 0x0D), (0x20, 0x20))
_STOP = _flags((0x21, 0x21), (0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F))


def cut_places(data: np.ndarray) -> np.ndarray:
    """Positions in UTF-8 bytes at which a piece may begin, beside the start."""
    at = np.flatnonzero((_SPACE | _STOP)[data[1:]]) + 1
    here, before, lead = data[at], data[at - 1], data[np.maximum(at - 2, 0)]
    solid = _PRINTABLE[before] | _CONTINUED[before] & _TWO_BYTE_LEAD[lead]
    letter = _LETTER[before] | _LATIN_LETTER[before] & _LATIN_LEAD[lead]
    return at[np.where(_SPACE[here], solid, letter)]


@functools.cache
def _byte_signs() -> dict[int, str]:
    """The signs that a byte-level tokenizer writes for the bytes 0 to 255."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@functools.cache
def _steps(path: str):
    """Normaliser and model of a tokenizer, and whether words carry a space before them."""
    tool = tokenizer(path)
    return tool.normalizer, tool.model, tool.normalizer is None


def whole_words(pieces: list[bytes], path: str) -> list[str | None]:
    """For each piece that is one word of letters only: that word as the model gets it.

    The tokenizer's own normaliser is used, many pieces at a time.  None for
    every other piece, to which the tokenizer must be applied as a whole.
    """
    normalizer, _, spaced = _steps(path)
    words = [p.decode() for p in pieces]
    if spaced:
        plain = [(w[1:] if w[:1] == " " else w).isalpha() for w in words]
    else:
        plain = [w.lstrip(" \n").isalpha() for w in words]
        lines = iter(normalizer.normalize_str("\n".join([w.lstrip(" \n") for w, ok in zip(words, plain) if ok])).split(" "))
        words = [next(lines) if ok else "" for ok in plain]
        plain = [ok and w.isalpha() for ok, w in zip(plain, words)]
    signs = _byte_signs()
    return [
        (w if w.isascii() and w[0] != " " else w.encode().decode("latin-1").translate(signs)) if ok else None
        for w, ok in zip(words, plain)
    ]


def encode_pieces(pieces: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces, one after the other, and how many each has.

    Words of letters go straight to the tokenizer's model, which is what the
    tokenizer would do with them; all other pieces go through the tokenizer.
    """
    model, tool = _steps(path)[1], tokenizer(path)
    ids = [w and [t.id for t in model.tokenize(w)] for w in whole_words(pieces, path)]
    others = [i for i, x in enumerate(ids) if x is None]
    encoded = tool.encode_batch_fast([pieces[i].decode() for i in others], add_special_tokens=False)
    for i, e in zip(others, encoded, strict=True):
        ids[i] = e.ids
    lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
    return np.fromiter(itertools.chain.from_iterable(ids), dtype=np.uint32, count=int(lengths.sum())), lengths


class PieceStore:
    """Values of pieces (a short array each), computed once per distinct piece.

    Only short pieces are kept, with their values and with nothing else, and
    only up to a number and size of them, whatever a worker reads in its life.
    """

    def __init__(self, compute: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self.compute = compute
        self.slots: dict[bytes, int] = {}
        self.kept_bytes = 0
        self.flat = np.empty(0, dtype=np.uint32)
        self.lengths = np.empty(0, dtype=np.int64)

    def values(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A flat array, the lengths of its rows, and the row of each piece."""
        rows = np.fromiter((self.slots.get(p, -1) for p in pieces), dtype=np.int64, count=len(pieces))
        missing = np.flatnonzero(rows < 0)
        flat, lengths = self.flat, self.lengths
        if len(missing):
            more, counts = self.compute([pieces[i] for i in missing])
            rows[missing] = len(lengths) + np.arange(len(missing))
            flat, lengths = np.concatenate((flat, more)), np.concatenate((lengths, counts))
            self.keep([pieces[i] for i in missing], more, counts)
        return flat, lengths, rows

    def keep(self, pieces: list[bytes], flat: np.ndarray, lengths: np.ndarray) -> None:
        """Add short pieces and their values while there is room."""
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        short = np.flatnonzero(sizes <= CACHED_LENGTH)[: max(0, CACHED_PIECES - len(self.slots))]
        short = short[self.kept_bytes + np.cumsum(sizes[short] + 4 * lengths[short]) <= CACHED_BYTES]
        if len(short):
            self.kept_bytes += int((sizes[short] + 4 * lengths[short]).sum())
            self.slots.update(zip([pieces[i] for i in short], range(len(self.slots), len(self.slots) + len(short)), strict=True))
            index, _ = ragged_take(np.cumsum(lengths) - lengths, lengths, short)
            self.flat = np.concatenate((self.flat, flat[index]))
            self.lengths = np.concatenate((self.lengths, lengths[short]))


@functools.cache
def id_store(path: str) -> PieceStore:
    """The worker's store of ids for a tokenizer file."""
    return PieceStore(lambda pieces: encode_pieces(pieces, path))


def blocks(texts: pa.Array, size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Bytes, offsets and first row of runs of texts of about so many bytes, else BLOCK_BYTES; a null is empty."""
    size = size or BLOCK_BYTES
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    start = texts.offset
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[start : start + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        end = min(end, len(texts))
        yield data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], row
        row = end


def pieces_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The pieces of a block as a dictionary array, and where each text's pieces begin."""
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[cut_places(data)] = begins[offsets] = True
    bounds = np.flatnonzero(begins)
    slices = pa.Array.from_buffers(
        pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    )
    return slices.dictionary_encode(), np.searchsorted(bounds, offsets)


def ragged_take(starts: np.ndarray, lengths: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the flat values of the picked rows, and the rows' ends in them."""
    n = lengths[picks]
    ends = np.cumsum(n)
    index = np.repeat((starts[picks] - (ends - n)).astype(np.int32), n)
    index += np.arange(len(index), dtype=np.int32)
    return index, ends


def ids_of_block(data: np.ndarray, offsets: np.ndarray, store: PieceStore) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a block, and the n + 1 places at which the texts begin and end in them."""
    if not len(data):
        return np.empty(0, dtype=np.uint32), np.zeros(len(offsets), dtype=np.int64)
    coded, firsts = pieces_of(data, offsets)
    flat, lengths, rows = store.values(coded.dictionary.to_pylist())
    index, ends = ragged_take(np.cumsum(lengths) - lengths, lengths, rows[coded.indices.to_numpy()])
    return flat[index], np.concatenate(([0], ends))[firsts]


def encoded(texts: pa.Array, path: str, end_id: int) -> Iterator[np.ndarray]:
    """Ids of each text with the end id after them, in the order of the texts."""
    store = id_store(path)
    for data, offsets, _ in blocks(texts):
        ids, bounds = ids_of_block(data, offsets, store)
        with_end = np.insert(ids, bounds[1:], end_id)
        bounds = bounds + np.arange(len(bounds))
        for first, last in zip(bounds[:-1], bounds[1:], strict=True):
            yield with_end[first:last]


def crc32_of_ids(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").data)
