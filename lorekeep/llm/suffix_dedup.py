"""Removal of passages that occur more than once, byte for byte, by sorting suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere
else.  Sorting a suffix for every byte would move a hundred times the corpus, so
suffixes are sorted where the text itself says: of all strings of ``GRAM`` bytes
inside a window of LENGTH bytes, the one with the smallest hash is the window's
anchor, and equal windows have equal anchors.  Neighbouring windows mostly share
theirs, so there is an anchor per 150 bytes or so.  An anchor's context is what
its windows reach: some bytes before it, some after it.

* An anchor whose gram occurs nowhere else has no repeated window.
* Equal contexts are collapsed first; all their windows are repeated.
* Every remaining distinct context is sorted, by what follows the anchor and
  then by what precedes it, read backwards; contexts whose gram has several
  distinct ones also the other way round.  The sort is the merge sort of
  ``string_sort``.  The common prefixes of neighbours say how far a context
  agrees with another one on each side.  Two contexts that agree on ``l`` bytes
  before the anchor and ``r`` after it share the windows that begin between
  LENGTH - r and l bytes before it; the greatest r and l of all neighbours
  bound what can be shared at all.
* Windows within these bounds that no neighbour settles are compared with all
  others of their gram one by one.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.string_sort import common, neighbours
from lorekeep.llm.tables import passing, stored
from lorekeep.llm.tokens import blocks
from lorekeep.sources.shared import new_table_path

#: Bytes of a repeated string, and of the grams that anchors are chosen from.
LENGTH, GRAM = 400, 100
#: Windows looked at in one go.
STEP = 1 << 20
_BASE = 0x9E3779B97F4A7C15
#: Never occurs in UTF-8; ends the first of two parts of a string.
_END = b"\xff"
KEY = ["k1", "k2"]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Grams:
    """Hashes of all grams of a stretch of bytes, and the smallest of each window."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.width = length, gram, length - gram + 1
        self.up = powers(_BASE, STEP + length + 1)
        self.down = powers(pow(_BASE, -1, 1 << 64), STEP + length + 1)

    def anchors(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each gram, and the place of the anchor of each window."""
        n = len(data)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        hashes = mixed((sums[self.gram :] - sums[: -self.gram]) * self.down[: n - self.gram + 1])
        # The place breaks ties, so the first of equal grams is taken.
        low = np.uint64((1 << (STEP + self.length).bit_length()) - 1)
        ranked = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        return hashes, (self.smallest(ranked) & low).astype(np.int64)

    def smallest(self, x: np.ndarray) -> np.ndarray:
        """Least of each ``width`` values in a row, from running minima of blocks in both directions."""
        n = len(x) - self.width + 1
        padded = np.full(-(-len(x) // self.width) * self.width, np.iinfo(np.uint64).max, dtype=np.uint64)
        padded[: len(x)] = x
        rows = padded.reshape(-1, self.width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        return np.minimum(back[:n], ahead[self.width - 1 : self.width - 1 + n])


def stretches(offsets: np.ndarray, length: int):
    """Runs of whole texts of about STEP bytes; of a longer text, pieces that overlap so that no window is cut."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + STEP, "right")) - 1)
        begin, end = int(offsets[a]), int(offsets[b])
        for at in range(begin, max(begin + 1, end), STEP):
            yield a, b, at, min(end, at + STEP + length - 1)
        a = b


_ANCHORS = "gram long, c1 long, c2 long, at int, first int, last int"


def find_anchors(length: int, gram: int):
    """A function for ``mapInArrow``: the anchors of each text, the windows they stand for, and their contexts' digests."""

    def run(batches):
        grams = Grams(length, gram)
        for batch in batches:
            keys = [batch.column(c) for c in (*KEY, "n")]
            for data, offsets, row in blocks(batch.column("text")):
                for a, b, begin, end in stretches(offsets, length):
                    if end - begin < length:
                        continue
                    piece = data[begin:end]
                    hashes, anchor = grams.anchors(piece)
                    sizes = np.minimum(offsets[a + 1 : b + 1], end) - np.maximum(offsets[a:b], begin)
                    owner = np.repeat(np.arange(a, b), sizes)[: len(anchor)]
                    place = np.flatnonzero(np.arange(len(anchor)) + length + begin <= offsets[1:][owner])
                    anchor, owner = anchor[place], owner[place]
                    if not len(place):
                        continue
                    new = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(place) != 1)) + 1
                    starts, ends = np.append(0, new), np.append(new, len(place)) - 1
                    first, last, at, owner = place[starts], place[ends], anchor[starts], owner[starts]
                    raw = piece.tobytes()
                    digest = b"".join(
                        xxhash.xxh3_128_digest(raw[f : e + length], seed=s)
                        for f, e, s in zip(first.tolist(), last.tolist(), (at - first).tolist(), strict=True)
                    )
                    context = np.frombuffer(digest, dtype=np.int64).reshape(-1, 2)
                    rows, base = pa.array(row + owner), begin - offsets[owner]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(k.take(rows) for k in keys), pa.array(hashes[at].view(np.int64)),
                            pa.array(context[:, 0]), pa.array(context[:, 1]),
                            *(pa.array((x + base).astype(np.int32)) for x in (at, first, last)),
                        ],
                        [*KEY, "n", "gram", "c1", "c2", "at", "first", "last"],
                    )

    return run


def named(documents: DataFrame) -> DataFrame:
    """Adds the 128 bits that name a text; a null text is the empty one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.withColumn("text", text).withColumns(
        {"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")}
    )


def distinct_texts(documents: DataFrame, length: int) -> DataFrame:
    """Each text that is long enough once, with the number of its rows, bucketed by its name.

    Copies are collapsed within tasks before texts are shuffled, and later steps
    find the texts in their buckets without a further shuffle.
    """
    spark = documents.sparkSession
    texts = named(documents.select("text")).where(F.octet_length("text") >= length)
    texts = texts.groupBy(*KEY).agg(F.first("text").alias("text"), F.count("*").alias("n"))
    table = f"lorekeep_texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = texts.write.bucketBy(buckets, *KEY).option("path", new_table_path(spark, "repeat-texts"))
    writer.option("compression", "zstd").format("parquet").saveAsTable(table)
    return spark.table(table)


def candidates(anchors: DataFrame) -> DataFrame:
    """Distinct contexts of grams that occur more than once, with what is known from counting them."""
    # None of these is null; said here, both uses of the contexts have one plan and share its shuffle.
    known = anchors.where("gram IS NOT NULL AND c1 IS NOT NULL AND c2 IS NOT NULL")
    contexts = known.groupBy("gram", "c1", "c2").agg(F.sum("n").alias("n"))
    grams = contexts.groupBy("gram").agg(
        F.sum("n").alias("all"), F.count("*").alias("contexts"), F.sum((F.col("n") == 1).cast("long")).alias("single")
    ).where("all > 1")
    return contexts.join(grams, "gram").select(
        "gram", "c1", "c2", (F.col("n") > 1).alias("whole"), ((F.col("contexts") > 1) & (F.col("single") > 0)).alias("several")
    )


def context_strings(length: int):
    """Of a batch of texts with their contexts: the strings to be sorted, named by the context."""

    def strings(batch: pa.RecordBatch):
        for text, contexts in zip(batch.column("text"), batch.column("contexts").to_pylist(), strict=True):
            data = text.as_py().encode()
            for c in contexts:
                after = data[c["at"] : c["last"] + length]
                before = data[c["first"] : c["at"]][::-1]
                name = (c["c1"], c["c2"])
                yield b"\0" + after + _END + before, name
                if c["several"]:
                    gram = c["gram"].to_bytes(8, signed=True)
                    yield b"\1" + gram + before + _END + after, name

    return strings


def agreement(gram: int):
    """What two neighbours say: rows of the context, the order, and the bytes they share after and before the anchor."""

    def split(s: bytes) -> tuple[bytes, bytes]:
        if s[0]:
            cut = s.index(_END, 9)
            return s[cut + 1 :], s[9:cut]
        cut = s.index(_END, 1)
        return s[1:cut], s[cut + 1 :]

    def seen(a, b, lcp: int) -> list[tuple]:
        kind = a[0][0]
        if kind != b[0][0] or lcp < (10 if kind else 1 + gram):
            return []
        (after, before), (after_b, before_b) = split(a[0]), split(b[0])
        if kind:
            l = min(lcp - 9, len(before), len(before_b))
            r = common(after, after_b, 0)
        else:
            r = min(lcp - 1, len(after), len(after_b))
            l = common(before, before_b, 0)
        return [(*name, kind, r, l) for name in (a[1], b[1])]

    return seen


def settle(length: int):
    """Windows of a context, by the bytes they begin before the anchor, that are shared for sure, and that may be."""

    def run(batches):
        for batch in batches:
            shared, low, high = [], [], []
            for c in batch.to_pylist():
                least, most = c["at"] - c["last"], c["at"] - c["first"]
                if c["whole"]:
                    shared.append([{"low": least, "high": most}])
                    low.append(None)
                    high.append(None)
                    continue
                pairs = c["pairs"] or []
                spans = [(max(least, length - p["r"]), min(most, p["l"])) for p in pairs]
                spans = joined([(a, b + 1) for a, b in spans if a <= b])
                bound = (
                    max(least, length - max((p["r"] for p in pairs if not p["kind"]), default=0)),
                    min(most, max((p["l"] for p in pairs if p["kind"]), default=0)),
                )
                open_ = np.ones(max(0, bound[1] - bound[0] + 1), dtype=bool)
                for a, b in spans:
                    open_[max(0, a - bound[0]) : max(0, b - bound[0])] = False
                left = np.flatnonzero(open_)
                shared.append([{"low": a, "high": b - 1} for a, b in spans])
                low.append(int(bound[0] + left[0]) if len(left) else None)
                high.append(int(bound[0] + left[-1]) if len(left) else None)
            span = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(x) for x in ("gram", "c1", "c2", *KEY, "at", "first", "last", "whole")),
                    pa.array(shared, span), pa.array(low, pa.int32()), pa.array(high, pa.int32()),
                ],
                ["gram", "c1", "c2", *KEY, "at", "first", "last", "whole", "shared", "low", "high"],
            )

    return run


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open spans in order, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def one_by_one(contexts: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """Windows left open by the sort that are shared after all: ``c1``, ``c2`` and their spans.

    All contexts of a gram show their windows in the range left open in any of
    them; windows are counted by 128-bit digests, added up before the shuffle.
    """
    grams = contexts.where("low IS NOT NULL").groupBy("gram").agg(F.min("low").alias("from"), F.max("high").alias("to"))
    asked = contexts.select("gram", "c1", "c2", *KEY, "at", "first", "last").join(grams, "gram").select(
        "c1", "c2", *KEY, "at", F.greatest("from", F.col("at") - F.col("last")).alias("from"),
        F.least("to", F.col("at") - F.col("first")).alias("to"),
    ).where("from <= to")

    def windows(batches):
        for batch in batches:
            ids, places, digests = [], [], []
            for r in batch.to_pylist():
                data = r["text"].encode()
                for c in r["contexts"]:
                    for back in range(c["from"], c["to"] + 1):
                        begin = c["at"] - back
                        ids.append((c["c1"], c["c2"]))
                        places.append(back)
                        digests.append(xxhash.xxh3_128_digest(data[begin : begin + length]))
            named_, found = np.array(ids, np.int64).reshape(-1, 2), np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (named_[:, 0], named_[:, 1], np.array(places, np.int32), found[:, 0], found[:, 1])],
                ["c1", "c2", "back", "w1", "w2"],
            )

    by_text = asked.groupBy(*KEY).agg(F.collect_list(F.struct("c1", "c2", "at", "from", "to")).alias("contexts"))
    shown = texts.join(by_text, KEY).select("text", "contexts")
    shown = stored(shown.mapInArrow(windows, "c1 long, c2 long, back int, w1 long, w2 long"), "repeat-windows")
    shared = shown.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    found = shown.join(shared, ["w1", "w2"])
    return found.select("c1", "c2", F.struct(F.col("back").alias("low"), F.col("back").alias("high")).alias("s"))


def repeated_spans(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Distinct texts with repeated strings: ``k1``, ``k2``, ``text`` and ``spans`` (half-open byte ranges, in order, apart)."""
    texts = distinct_texts(documents, length)
    schema = f"k1 long, k2 long, n long, {_ANCHORS}"
    # Most anchors are of grams that occur once; what is left of them are the hits.
    with passing(documents.sparkSession) as keep:
        anchors = keep(texts.select(*KEY, "n", "text").mapInArrow(find_anchors(length, gram), schema))
        hits = stored(anchors.drop("n").join(candidates(anchors), ["gram", "c1", "c2"]), "repeat-hits")
    place = F.struct(*KEY, "at", "first", "last")
    chosen = hits.groupBy("gram", "c1", "c2").agg(
        F.min(place).alias("place"), F.max("whole").alias("whole"), F.max("several").alias("several")
    ).select("gram", "c1", "c2", "place.*", "whole", "several")
    chosen = stored(chosen, "repeat-contexts")
    # The contexts of one text.
    by_text = chosen.groupBy(*KEY).agg(F.collect_list(F.struct("gram", "c1", "c2", "at", "first", "last", "several")).alias("contexts"))
    shown = texts.join(by_text, KEY).select("text", "contexts")
    pairs = neighbours(
        shown, context_strings(length), agreement(gram), "c1 long, c2 long, kind int, r int, l int",
        [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()],
    )
    # At most two neighbours in each order.
    pairs = pairs.groupBy("c1", "c2").agg(F.collect_list(F.struct("kind", "r", "l")).alias("pairs"))
    settled = chosen.drop("several").join(pairs, ["c1", "c2"], "left").mapInArrow(
        settle(length),
        "gram long, c1 long, c2 long, k1 long, k2 long, at int, first int, last int, whole boolean, "
        "shared array<struct<low:int,high:int>>, low int, high int",
    )
    settled = stored(settled, "repeat-settled")
    shared = settled.select("c1", "c2", F.explode("shared").alias("s"))
    shared = shared.unionByName(one_by_one(settled, texts, length))
    # At most a window's places.
    shared = stored(shared.groupBy("c1", "c2").agg(F.collect_set("s").alias("shared")), "repeat-shared")
    found = hits.select("c1", "c2", *KEY, "at").join(shared, ["c1", "c2"])
    found = found.select(*KEY, "at", F.explode("shared").alias("s"))
    span = F.struct((F.col("at") - F.col("s.high")).alias("begin"), (F.col("at") - F.col("s.low") + length).alias("end"))
    # The spans of one text, first those of each task as one list.
    by_text = found.groupBy(*KEY).agg(F.collect_set(span).alias("spans"))

    def tidy(batches):
        for batch in batches:
            spans = [joined([(s["begin"], s["end"]) for s in row]) for row in batch.column("spans").to_pylist()]
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in KEY), pa.array([[{"begin": a, "end": b} for a, b in row] for row in spans], kind)],
                [*KEY, "spans"],
            )

    tidied = by_text.mapInArrow(tidy, "k1 long, k2 long, spans array<struct<begin:int,end:int>>")
    return texts.select(*KEY, "text").join(stored(tidied, "repeat-spans"), KEY)


def kept_bytes(data: bytes, spans: list[dict]) -> bytes:
    """What is left of a text without its spans."""
    out, at = [], 0
    for s in spans:
        out.append(data[at : s["begin"]])
        at = s["end"]
    return b"".join([*out, data[at:]])


def _with_kept(rows: DataFrame, result) -> DataFrame:
    """Adds a column that ``result`` makes of the bytes kept, in place of the text."""

    def run(batches):
        for batch in batches:
            kept = [
                kept_bytes(t.as_py().encode(), s)
                for t, s in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1"), batch.column("k2"), batch.column("spans"), pa.array([result(k) for k in kept])],
                [*KEY, "spans", "kept"],
            )

    kind = "string" if isinstance(result(b""), str) else "binary"
    return rows.mapInArrow(run, f"k1 long, k2 long, spans array<struct<begin:int,end:int>>, kept {kind}")


def without_repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """A row per row: ``doc_id``, ``kept`` (the bytes left, which may end within a character) and ``spans`` (what went).

    Each byte goes that lies in a string of ``length`` bytes which also starts at
    another place of any document, its own included; strings are judged on the
    input.  A null text is empty; texts shorter than a string, and empty ones,
    stay as they are; of equal texts of that length and more nothing is left.
    Rows that repeat an id, or have none, are documents of their own.  An empty
    table has no rows.  Other columns, whatever their names, are not looked at.
    """
    found = _with_kept(repeated_spans(documents, length, gram), bytes)
    rows = named(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    none = F.array().cast("array<struct<begin:int,end:int>>")
    return rows.join(found, KEY, "left").select(
        "doc_id", F.coalesce("kept", F.col("text").cast("binary")).alias("kept"), F.coalesce("spans", none).alias("spans")
    )


def digests(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Sizes and digests of what ``without_repeats`` leaves, with no text joined to documents.

    Returns ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256``.
    """
    found = _with_kept(repeated_spans(documents, length, gram), lambda kept: hashlib.sha256(kept).hexdigest())
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    found = stored(found.select(*KEY, gone.alias("gone"), F.size("spans").cast("long").alias("runs"), "kept"), "repeat-digests")
    rows = named(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select(
        "doc_id", *KEY, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole")
    )
    zero = F.lit(0).cast("long")
    return rows.join(found, KEY, "left").select(
        "doc_id", "n_bytes", F.coalesce("gone", zero).alias("n_removed"), F.coalesce("runs", zero).alias("n_spans"),
        F.coalesce("kept", "whole").alias("kept_sha256"),
    )
