"""Components, near-duplicate vectors and near-duplicate texts against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lorekeep.llm import buckets, embedding_dedup, simhash_dedup
from lorekeep.llm.components import connected
from lorekeep.llm.ship import ship

NAN, INF = float("nan"), float("inf")


def least_reachable(ids, links):
    """Smallest node that links lead to, by sweeping until nothing changes."""
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


@pytest.mark.parametrize("seed", range(3))
def test_connected(spark, seed):
    rnd = random.Random(seed)
    links = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 140)]
    links += [(7, 7), (200, 3)]
    found = connected(spark.createDataFrame([*links, (None, 1), (2, None)], "a long, b long"), "a", "b").collect()
    least = least_reachable({x for p in links for x in p}, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert {(r.node, r.component) for r in found} == {(x, least[x]) for x in linked} and len(found) == len(linked)


def test_connected_without_links(spark):
    assert connected(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_pairs_in_runs():
    starts, sizes = np.array([0, 1, 4]), np.array([1, 3, 2])
    pairs = [(int(a), int(b)) for i, j in buckets.pairs_in_runs(starts, sizes) for a, b in zip(i, j)]
    assert pairs == [(1, 2), (1, 3), (2, 3), (4, 5)]


def cloud(seed, copies=40):
    """Vectors in loose and dense groups, exact copies, and rows that can have no links."""
    rng = np.random.default_rng(seed)
    rows = []
    for group in range(6):
        centre = rng.normal(size=24)
        for _ in range(copies if group < 2 else 4):
            rows.append((centre + rng.normal(size=24) * rng.choice([0.05, 0.2]), int(group % 3)))
    rows += [(rng.normal(size=24), 1) for _ in range(30)]
    rows = [([float(np.float32(x)) for x in v], label) for v, label in rows]
    rows += [rows[0], rows[0], ([3 * x for x in rows[1][0]], rows[1][1]), (rows[0][0], 2), (rows[0][0], None)]
    rows += [(None, 0), ([], 0), ([0.0] * 24, 0), ([NAN] + rows[0][0][1:], 0), ([INF] + rows[0][0][1:], 0)]
    rows += [([None] + rows[0][0][1:], 0), (rows[0][0][:12], 0), (rows[0][0][:12], 0), ([1.0], 0), ([2.0], 0), ([-1.0], 0)]
    return [(i, v, label) for i, (v, label) in enumerate(rows)]


def links_of(rows):
    def good(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    links = []
    for i, v, label in rows:
        for j, w, other in rows:
            if i < j and label == other and good(v, label) and good(w, other) and len(v) == len(w):
                a, b = np.array(v), np.array(w)
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98:
                    links.append((i, j))
    return links


@pytest.mark.parametrize("block", [8, 128])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(buckets, "BLOCK", block)
    ship(spark)
    rows = cloud(block)
    schema = "vec_id long, embedding array<float>, label int, node string, weight int, bucket int, links string"
    df = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], schema)
    links = links_of(rows)
    least = least_reachable([r[0] for r in rows], links)
    wanted = {(i, sum(i in p for p in links), least[i], least[i] == i) for i, _, _ in rows}
    found = embedding_dedup.near_vectors(df.repartition(4)).collect()
    assert {tuple(r) for r in found} == wanted and len(found) == len(rows)


def test_vectors_without_id_and_repeated_rows(spark):
    ship(spark)
    df = spark.createDataFrame([(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (None, [1.0, 2.0], 0), (4, [1.0, 2.0], 0)],
                               "vec_id long, embedding array<float>, label int")
    found = sorted(embedding_dedup.near_vectors(df).collect(), key=str)
    assert sorted(map(tuple, found), key=str) == sorted(
        [(1, 2, 1, True), (1, 2, 1, True), (4, 2, 1, False), (None, 0, None, False)], key=str
    )
    assert embedding_dedup.near_vectors(df.limit(0)).collect() == []


def test_vectors_that_share_an_id_are_one_node(spark):
    """Ids as nodes, whatever the vectors and labels of their rows."""
    ship(spark)
    one, two, three = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(5, one, 0), (5, two, 0), (3, one, 0), (7, two, 0), (9, three, 0), (9, three, 1), (2, three, 1), (7, None, 0), (8, None, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = sorted(map(tuple, embedding_dedup.near_vectors(df.repartition(3)).collect()))
    assert found == sorted(
        [(5, 1, 3, False), (5, 1, 3, False), (3, 1, 3, True), (7, 1, 3, False), (9, 0, 2, False), (9, 1, 2, False), (2, 1, 2, True),
         (7, 0, 3, False), (8, 0, 8, True)]
    )


@pytest.mark.parametrize(("size", "pairs", "least"), [(64, 4000, 0.70), (768, 400, 0.70)])
def test_pairs_at_the_threshold_nearly_always_meet(size, pairs, least):
    """The chance to meet in one table, and what that makes over all of them."""
    rng = np.random.default_rng(size)
    x = rng.normal(size=(pairs, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.normal(size=(pairs, size))
    away -= (away * x).sum(axis=1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * away / np.linalg.norm(away, axis=1, keepdims=True)
    a, b = embedding_dedup.codes(x), embedding_dedup.codes(y)
    meet = (a[:, :, :, None] == b[:, :, None, :]).any(axis=(2, 3))
    assert meet.any(axis=1).all()
    assert meet.mean() >= least and (1 - meet.mean()) ** embedding_dedup.TABLES < 1e-6


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 3))
    y = embedding_dedup.rotated(x, 0, 0)
    assert y.shape == (5, 4)
    np.testing.assert_allclose((y**2).sum(axis=1), (x**2).sum(axis=1))


def plain_print(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ")
             .replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_copies(seed):
    rnd = random.Random(seed)
    words = ["alpha", "Beta", "gámma", "delta", "E\u0085e", "z z"]
    texts = []
    for _ in range(25):
        base = [rnd.choice(words) + str(rnd.randrange(400)) for _ in range(rnd.choice([80, 400]))]
        texts.append(" ".join(base))
        for _ in range(4):
            copy = list(base)
            copy[rnd.randrange(len(copy))] = "changed"
            texts.append(rnd.choice([" ", "\t", " \n"]).join(copy))
    return texts + [None, "", "  \n", "one", "one two", "ONE TWO", "a b c", "x" * 100_000, "a " * 30_000, "same", "same"]


@pytest.mark.parametrize("block", [4, 128])
def test_near_texts(spark, monkeypatch, block):
    monkeypatch.setattr(buckets, "BLOCK", block)
    ship(spark)
    texts = near_copies(block)
    df = spark.createDataFrame([(i, t, 0, "c", "d") for i, t in enumerate(texts)],
                               "doc_id long, text string, node int, print string, bucket string")
    prints = [plain_print(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3]
    least = least_reachable(range(len(texts)), links)
    found = simhash_dedup.near_texts(df.repartition(4)).collect()
    assert {tuple(r) for r in found} == {(i, f"{prints[i]:016x}", least[i]) for i in range(len(texts))}
    assert len(found) == len(texts) and len(set(least.values())) < len(texts) - 30


def test_every_near_pair_shares_a_bucket_and_passes_the_ring():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.int64).view(np.uint64)
    flips = np.zeros(3000, dtype=np.uint64)
    for _ in range(3):
        flips |= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    b = a ^ flips
    shared = (simhash_dedup.chain_keys(a.view(np.int64)) == simhash_dedup.chain_keys(b.view(np.int64))).any(axis=1)
    assert shared.all() and simhash_dedup.pigeonring(flips).all()
    far = np.array([0b1111 << 16, (1 << 0) | (1 << 16) | (1 << 32) | (1 << 48)], dtype=np.uint64)
    assert not simhash_dedup.pigeonring(far).any()


def test_texts_without_id_repeats_and_empty(spark):
    ship(spark)
    df = spark.createDataFrame([(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, "other words are here"), (5, "a b c d")],
                               "doc_id long, text string")
    found = simhash_dedup.near_texts(df).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in found) == [(0, 0), (0, 3), (3, 3), (3, 3), (5, 3)]
    assert simhash_dedup.near_texts(df.where(F.lit(False))).collect() == []


def test_links_over_rows_without_id_and_repeated_ids(spark, monkeypatch):
    """Prints 0, 7 and 63 are linked through the one that has no id; ids are nodes."""
    ship(spark)
    given = {"zero": 0, "seven": 7, "most": 63, "far": 0xFFFF << 40, "other": 0xFF << 8}
    rows = [(1, "zero"), (None, "seven"), (2, "most"), (5, "far"), (3, "far"), (5, "other"), (7, "other"), (None, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    prints = spark.createDataFrame([(i, given[t]) for i, t in rows], "doc_id long, print long")
    monkeypatch.setattr(simhash_dedup, "fingerprints", lambda *_: prints)
    found = sorted((r.doc_id or 0, r.component_id) for r in simhash_dedup.near_texts(df).collect())
    assert found == [(0, 1), (0, 3), (1, 1), (2, 1), (3, 3), (5, 3), (5, 3), (7, 3)]


def test_one_row_of_each_component(spark):
    """Repeated rows, rows without id, and an id with two texts."""
    ship(spark)
    unlike = "this text is unlike all of the others here"
    rows = [(3, "a b c d", "x"), (3, "a b c d", "x"), (None, "a b c d", "x"), (5, "a b c d", "x"), (5, unlike, "x"),
            (None, "other words are here", "x"), (None, "other words are here", "x"), (9, None, "x"), (None, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    for parts in (1, 4):
        kept = corpus_pipeline.without_near_copies(spark, df.repartition(parts), "")
        assert kept.columns == df.columns
        assert sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(
            f"Row(doc_id={i}, text={t!r})" for i, t in [(3, "a b c d"), (5, unlike), (None, "other words are here"), (9, None)]
        )
    assert simhash_dedup.one_row_of_each(df.where(F.lit(False))).collect() == []


@pytest.mark.parametrize("block", [4, 128])
def test_one_row_of_each_near_copy(spark, monkeypatch, block):
    """Near copies, some of them without id, against brute force."""
    monkeypatch.setattr(buckets, "BLOCK", block)
    ship(spark)
    texts = near_copies(block)
    ids = [None if i % 3 == 0 else i // 2 for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts, range(len(texts)))), "doc_id long, text string, n int")
    prints = [plain_print(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3]
    least = least_reachable(range(len(texts)), links)
    groups = {}
    for i, root in least.items():
        groups.setdefault(root, []).append(i)
    kept = sorted(r.n for r in simhash_dedup.one_row_of_each(df.repartition(4)).collect())
    assert sorted(least[n] for n in kept) == sorted(groups)
    for n in kept:
        known = [ids[i] for i in groups[least[n]] if ids[i] is not None]
        assert ids[n] == (min(known) if known else None)
