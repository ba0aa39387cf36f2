"""Token files, token counts and packing against the tokenizers library itself."""

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep.llm import packing, token_counts, token_files, tokens
from lorekeep.llm.ship import ship
from lorekeep.llm.tokens import encoded, tokenizer, tokenizer_path
from lorekeep.sources.shared import new_table_path

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ODD = [
    "", " ", "a   b", "<|endoftext|> x<|startoftext|>y", " \n\n  Déjà vu é à  don't 's\t x", "×.÷, a. b.. c.d é, E.É.",
    "Σ ΑΣ ΟΔΟΣ. ΟΔΟΣ", "é ́e ́", "İstanbul ǅ ﬁ", "x" * 3000, "ab" * 4000, "\x1c \x1d a\x85 b", "日本 語 12 34,5",
    "a  b   c   d", "aaaa aaaaa aaaaaa !!!!!!!", "it's: a;b 'RE 'll", None,
]
DOCUMENTS = "doc_id long, text string, size int, tokens string, piece string, number int"


def library(text, path, end_id):
    return [*tokenizer(path).encode(text or "", add_special_tokens=False).ids, end_id]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def documents(spark, texts):
    ship(spark)
    return spark.createDataFrame([(i, t, 7, "x", "y", -1) for i, t in enumerate(texts)], DOCUMENTS)


@pytest.mark.parametrize("file", FILES)
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.sampled_from("aEé à.,'s!\n\t  ſ1Σ日́|<>"), max_size=40), max_size=5))
def test_ids_and_counts_of_any_text(file, texts):
    path = tokenizer_path(file)
    wanted = [library(t, path, 0) for t in texts]
    assert [x.tolist() for x in encoded(pa.array(texts, pa.string()), path, 0)] == wanted
    assert token_counts.counted(pa.array(texts, pa.string()), path).tolist() == [len(w) - 1 for w in wanted]


@pytest.mark.parametrize("file", FILES)
def test_ids_and_counts_of_odd_texts(file):
    path = tokenizer_path(file)
    wanted = [library(t, path, 0) for t in ODD]
    assert [x.tolist() for x in encoded(pa.array(ODD), path, 0)] == wanted
    assert token_counts.counted(pa.array(ODD), path).tolist() == [len(w) - 1 for w in wanted]


def test_token_counts(spark):
    path = tokenizer_path(FILES[0])
    rows = token_counts.token_counts(documents(spark, ODD), path, limit=3).orderBy("doc_id").collect()
    wanted = [(i, len((t or "").encode()), len(library(t, path, 2)) - 1) for i, t in enumerate(ODD)]
    assert [(r.doc_id, r.n_bytes, r.n_tokens) for r in rows] == wanted
    assert [r.over_limit for r in rows] == [w[2] > 3 for w in wanted]


def test_token_files_round_trip(spark):
    path, tool = new_table_path(spark, "test-tokens"), tokenizer_path(FILES[0])
    texts = ODD * 3
    df = documents(spark, texts).union(spark.createDataFrame([(None, "no id", 1, "", "", 1), (0, "again", 1, "", "", 1)], DOCUMENTS))
    token_files.write_tokens(df.repartition(5), path, tool, 2)
    read = token_files.read_tokens(spark, path)
    rows = read.orderBy("start").collect()
    ids = [r.doc_id for r in rows]
    assert ids == [None, 0, 0, *range(1, len(texts))]
    before = 0
    for r in rows:
        assert r.start == before and r.n_tokens == len(r.tokens)
        if r.doc_id:
            assert r.tokens == library(texts[r.doc_id], tool, 2)
        before += r.n_tokens
    got = {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.digests(read).collect()}
    assert got == {(r.doc_id, r.start, r.n_tokens, crc(r.tokens)) for r in rows}
    # Numbers alone are read without the ids; a filter reaches the files.
    plan = token_files.read_tokens(spark, path, with_tokens=False).where("doc_id = 5")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)]" in plan
    assert "tokens:array" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_token_files_split_equal_ids_and_follow_the_written_order(spark):
    """Rows with one id, or none, are spread over tasks; starts do not hang on the names or number of files."""
    path, place = tokenizer_path(FILES[0]), new_table_path(spark, "many-files")
    texts = [f"text {i % 7} " * (i % 5) for i in range(600)]
    rows = [(None if i < 400 else 5 if i < 500 else i, t) for i, t in enumerate(texts)]
    ship(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "20")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write_tokens(df, place, path, 2)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = spark.read.parquet(place)
    assert files.where("doc_id IS NULL").select("part").distinct().count() > 2
    found = sorted(token_files.read_tokens(spark, place).collect(), key=lambda r: r.start)
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)])[:-1].tolist()
    assert [r.doc_id or -1 for r in found] == sorted(r.doc_id or -1 for r in found)
    got = sorted((r.doc_id or -1, tuple(r.tokens)) for r in found)
    assert got == sorted((i or -1, tuple(library(t, path, 2))) for i, t in rows)


def test_token_files_are_encoded_as_stated(spark, tmp_path):
    """Dictionary pages for the ids, deltas for the numbers, and a page index."""
    path, place = tokenizer_path(FILES[0]), str(tmp_path / "files")
    token_files.write_tokens(documents(spark, ["some words of text " * 50] * 300).coalesce(1), place, path, 2)
    names = [n for n in os.listdir(place) if n.endswith(".parquet")]
    meta = pq.ParquetFile(f"{place}/{names[0]}").metadata
    group = meta.row_group(0)
    found = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    ids = next(c for n, c in found.items() if n.startswith("tokens"))
    assert any("DICTIONARY" in e for e in ids.encodings) and ids.has_offset_index and ids.has_column_index
    for name in ("doc_id", "n_tokens", "before_in_part"):
        assert "DELTA_BINARY_PACKED" in found[name].encodings and found[name].has_column_index


def test_a_store_of_pieces_stays_bounded(monkeypatch):
    """Whatever is read, long pieces and ever new ones, only so many short pieces and their values are kept."""
    monkeypatch.setattr(tokens, "CACHED_PIECES", 500)
    monkeypatch.setattr(tokens, "CACHED_BYTES", 6000)
    seen = []

    def compute(pieces):
        seen.append(len(pieces))
        lengths = np.array([len(p) for p in pieces])
        return np.concatenate([np.frombuffer(p, np.uint8) for p in pieces]).astype(np.uint32), lengths

    store = tokens.PieceStore(compute)
    for i in range(60):
        pieces = [f"p{(i * 37 + k) % 900}".encode() for k in range(100)] + [f"{i}-{k}".encode() * 40 for k in range(50)]
        flat, lengths, rows = store.values(pieces)
        starts = np.cumsum(lengths) - lengths
        assert all(bytes(flat[starts[r] : starts[r] + lengths[r]].astype(np.uint8)) == p for p, r in zip(pieces, rows))
        assert len(store.slots) <= 500 and store.kept_bytes <= 6000
        assert len(store.lengths) == len(store.slots) and len(store.flat) == store.lengths.sum() <= 6000
    assert len(store.slots) > 100 and sum(seen) < 60 * 150


def test_empty_tables(spark):
    none = documents(spark, []).limit(0)
    path = new_table_path(spark, "test-tokens")
    token_files.write_tokens(none, path, tokenizer_path(FILES[0]), 2)
    assert token_files.digests(token_files.read_tokens(spark, path)).collect() == []
    assert token_counts.token_counts(none, tokenizer_path(FILES[0])).collect() == []
    assert packing.packed(none, tokenizer_path(FILES[1])).collect() == []


def bins(counts, capacity, shrink=True):
    plan = packing.planned(counts, capacity) if shrink else packing.Plan()
    if not shrink:
        packing.best_fit({n: c for n, c in counts.items() if c}, capacity, plan)
    packed = {}
    for times, items in plan.kinds:
        assert sum(n * c for n, c in items) <= capacity
        for n, c in items:
            packed[n] = packed.get(n, 0) + times * c
    assert packed == {n: c for n, c in counts.items() if c}
    return sum(times for times, _ in plan.kinds)


def one_by_one(counts, capacity):
    rooms = []
    for item in sorted(counts, reverse=True):
        for _ in range(counts[item]):
            fitting = [r for r in rooms if r >= item]
            if fitting:
                rooms.remove(min(fitting))
            rooms.append(min(fitting, default=capacity) - item)
    return len(rooms)


def fewest(items, capacity):
    """Exact, by trying every open sequence for each item in turn."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k, r in {r: (k, r) for k, r in enumerate(rooms) if r >= items[i]}.values():
            go(i + 1, [*rooms[:k], r - items[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(40))
def test_plans(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([10, 30, 100])
    counts = {rnd.randint(1, capacity): rnd.randint(1, 12) for _ in range(rnd.randint(1, 15))}
    assert bins(counts, capacity, shrink=False) == one_by_one(counts, capacity)
    assert bins(counts, capacity) <= one_by_one(counts, capacity)
    few = {rnd.randint(1, 10): rnd.randint(1, 2) for _ in range(4)}
    # What dominance fixes can be part of a best packing.
    plan, rest = packing.Plan(), dict(few)
    packing.reduce_by_dominance(rest, 10, plan)
    items, left = ([n for n, c in x.items() for _ in range(c)] for x in (few, rest))
    assert sum(t for t, _ in plan.kinds) + (fewest(left, 10) if left else 0) == fewest(items, 10)


def test_packing(spark):
    tool, capacity = tokenizer_path(FILES[1]), 16
    texts = [t for t in ODD if len(t or "") < 100] + ["word " * n for n in range(1, 60)] + ["same"] * 30
    rows = packing.packed(documents(spark, texts), tool, 0, capacity).collect()
    ids = {i: library(t, tool, 0) for i, t in enumerate(texts)}
    for i, own in ids.items():
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(-(-len(own) // capacity)))
        assert [r.length for r in mine[1:]] == [capacity] * (len(mine) - 1)
        assert sum(r.length for r in mine) == len(own)
        for r in mine:
            assert r.ids_crc32 == crc(own[r.start : r.start + r.length])
        assert [r.start for r in mine] == list(np.cumsum([0] + [r.length for r in mine[:-1]]))
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(sequences) <= sum(map(len, ids.values())) / capacity + 2
    assert sorted(sequences) == list(range(len(sequences)))


def test_packing_keeps_rows_without_id_and_repeats(spark):
    df = documents(spark, ["a", "b"]).select(F.lit(None).cast("long").alias("doc_id"), "text", "size")
    rows = packing.packed(df.union(df), tokenizer_path(FILES[1])).collect()
    assert len(rows) == 4 and {r.sequence_id for r in rows} == {0} and sorted(r.offset for r in rows) == [0, 2, 4, 6]
