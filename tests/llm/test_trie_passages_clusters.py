"""Prefix trie, repeated passages and clustering against brute force."""

import collections
import hashlib
import math
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import centroids, prefix_trie, string_sort, suffix_dedup
from lorekeep.llm.ship import ship
from lorekeep.sources.shared import shared_folder

TURNS = "conv_id long, turn long, role string, text string"


def with_nulls(row):
    return tuple((x is not None, x) for x in row)


# ------------------------------------------------------------------ prefix trie


def plain_trie(rows):
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
        if conv is not None:
            turns[conv].append(((turn is not None, turn or 0), role, digest, text))
    turns = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in turns.items()}
    paths = {}
    for conv, own in turns.items():
        h = zlib.crc32(str(conv).encode()) % 9
        paths[conv] = turns.get(conv - int(math.fmod(conv, 5)), [])[:h] + own[h:]
    members, children = collections.defaultdict(list), collections.Counter()
    for conv, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(conv)
    for node in members:
        children[node[:-1]] += bool(node)
    leaves, saved = collections.Counter(), collections.Counter()
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += not children[node]
        saved[node] += (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        if node:
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(paths[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(who), len(node), parent, len(who), children[node], leaves[node], saved[node], digest))
    return sorted(out, key=with_nulls)


def trie_of(spark, rows):
    ship(spark)
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS).withColumn("keys", F.lit(1)).withColumn("n_convs", F.lit("x")))
    return sorted(map(tuple, found.collect()), key=with_nulls)


@pytest.mark.parametrize("levels", [3, 64])
def test_trie(spark, monkeypatch, levels):
    monkeypatch.setattr(prefix_trie, "LEVELS", levels)
    monkeypatch.setattr(prefix_trie, "IDS", 4)
    rnd = random.Random(levels)
    rows = [
        (c, t if rnd.random() > 0.05 else None, rnd.choice(["user", None]), rnd.choice(["x", "yy", "zé", None]))
        for c in range(120) for t in range(rnd.choice([1, 2, 3, 9, 14]))
    ]
    # Copies of one conversation, negative and large ids, repeated rows, and rows without id.
    rows += [(1000 + c, t, "user", "same") for c in range(60) for t in range(5)]
    rows += [(c, t, "user", "far") for c in (-7, -5, 1 << 40) for t in range(11)] + rows[:40] + [(None, 0, "user", "lost")] * 3
    assert trie_of(spark, rows) == plain_trie(rows)


def test_trie_of_nothing_and_of_one_very_long(spark, monkeypatch):
    assert trie_of(spark, []) == []
    monkeypatch.setattr(prefix_trie, "LEVELS", 100)
    rows = [(10, t, "user", "a" * (t % 3)) for t in range(300)] + [(11, 0, "user", "é" * 100_000)]
    assert trie_of(spark, rows) == plain_trie(rows)


# ------------------------------------------------------------ repeated passages


def plain_removal(rows, length):
    seen = collections.Counter()
    for _, text in rows:
        data = (text or "").encode()
        seen.update(data[i : i + length] for i in range(len(data) - length + 1))
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data) + 1)
        for i in range(len(data) - length + 1):
            if seen[data[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, y in zip(data, gone, strict=False) if not y)
        spans = [i for i in range(len(data)) if gone[i] and (i == 0 or not gone[i - 1])]
        out.append((doc, len(data), sum(gone), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=with_nulls)


def corpus(seed):
    """Texts of few words, passages shared whole or in part, copies, periodic texts, empty ones and repeated ids."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.choice([1, 2, 5])))
    passages = [" ".join(word() for _ in range(rnd.randrange(5, 60))) for _ in range(12)]
    rows = []
    for doc in range(120):
        parts = []
        for _ in range(rnd.randrange(6)):
            if rnd.random() < 0.5:
                parts.append(rnd.choice(passages)[rnd.randrange(30) :][: rnd.randrange(10, 400)])
            else:
                parts.append(" ".join(word() for _ in range(rnd.randrange(1, 40))))
        rows.append((doc, " ".join(parts)))
    rows += [(200, None), (201, ""), (202, "a" * 300), (203, "ab" * 200), (None, "x" * 100), (5, rows[7][1]), (5, rows[5][1])]
    return rows + [(300 + i, passages[0] + f" {i * 7919} tail") for i in range(30)]


@pytest.mark.parametrize(("seed", "length", "gram"), [(1, 30, 4), (2, 40, 10), (3, 60, 25)])
def test_repeats(spark, monkeypatch, seed, length, gram):
    if seed % 2:
        # Many runs, parts and stretches.
        monkeypatch.setattr(string_sort, "RUN", 50)
        monkeypatch.setattr(string_sort, "PART_BYTES", 2000)
        monkeypatch.setattr(string_sort, "EACH_SAMPLE", 7)
        monkeypatch.setattr(suffix_dedup, "STEP", 300)
    ship(spark)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k1", F.lit(1)).withColumn("spans", F.lit("x"))
    assert sorted(map(tuple, suffix_dedup.digests(docs, length, gram).collect()), key=with_nulls) == plain_removal(rows, length)


def test_repeats_kept_bytes_and_production_length(spark):
    ship(spark)
    rnd = random.Random(9)
    long = " ".join(rnd.choice(["lorem", "ipsum", "dolor", "été"]) + str(rnd.randrange(1000)) for _ in range(30_000))
    passage = long[1000:1700]
    rows = [(1, long), (2, f"before {passage} after"), (3, passage[:360]), (4, "short")]
    found = {r.doc_id: r for r in suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = {r[0]: r[2] for r in plain_removal(rows, 400)}
    assert {d: sum(s.end - s.begin for s in r.spans) for d, r in found.items()} == gone
    assert gone[1] == gone[2] == len(passage.encode()) and gone[3] == gone[4] == 0
    assert bytes(found[2].kept).decode() == "before  after" and bytes(found[4].kept) == b"short"


def test_repeats_of_nothing(spark):
    ship(spark)
    assert suffix_dedup.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_repeats_leave_no_anchors_and_runs_on_disk(spark):
    folder = Path(shared_folder(spark).removeprefix("file:")) / "lorekeep"
    before = set(folder.glob("*"))
    rows = [(i, f"{i} " * 30 + "one passage that all texts have in common " * 3) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, suffix_dedup.digests(docs, 60, 20).collect())) == plain_removal(rows, 60)
    kinds = {path.name.rsplit("-", 1)[0] for path in set(folder.glob("*")) - before}
    assert "repeat-hits" in kinds and kinds.isdisjoint({"repeat-anchors", "string-runs", "passing"})


def test_merge_gives_order_and_prefixes_without_comparing_them():
    rnd = random.Random(5)
    strings = [(bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(30))), (i, 0)) for i in range(500)]
    runs = [string_sort.front_coded(sorted(strings[i::7])) for i in range(7)]
    got = list(string_sort.merged([string_sort.decoded(*r) for r in runs]))
    assert [s for s, _, _ in got] == sorted(s for s, _ in strings)
    assert sorted(name for _, _, name in got) == sorted(name for _, name in strings)
    before = b""
    for s, lcp, _ in got:
        assert lcp == string_sort.common(before, s, 0) == len(next((before[:k] for k in range(min(len(s), len(before)), -1, -1) if s[:k] == before[:k])))
        before = s
    assert list(string_sort.merged([])) == []


# ------------------------------------------------------------------- clustering


def plain_clusters(rows, k, rounds):
    kept = [
        (v, [int(np.floor(64 * np.float64(x))) for x in e]) for v, e in rows
        if e is not None and len(e) == 64 and all(x is not None and np.isfinite(x) for x in e)
    ]
    names = sorted((hashlib.sha256(f"1:{v}".encode()).hexdigest(), e) for v, e in kept if v is not None)
    means = [e for _, e in names[:k]]
    assign = lambda e: min((sum((a - b) ** 2 for a, b in zip(e, c, strict=True)), i) for i, c in enumerate(means))
    for _ in range(rounds):
        found = [assign(e)[1] for _, e in kept]
        for i in range(len(means)):
            mine = [e for (_, e), f in zip(kept, found, strict=True) if f == i]
            if mine:
                means[i] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [assign(e) for _, e in kept]
    total = sum(d for d, _ in found)
    out = []
    for (v, _), (d, i) in zip(kept, found, strict=True):
        digest = hashlib.sha256(",".join(map(str, means[i])).encode()).hexdigest()
        out.append((v, i, d, sum(x for x, j in found if j == i), total, digest))
    return sorted(out, key=with_nulls)


VECTORS = "vec_id long, embedding array<float>, cluster string, vector int"


def clusters_of(spark, rows):
    ship(spark)
    found = centroids.with_digests(*centroids.clusters(spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)))
    return sorted(map(tuple, found.collect()), key=with_nulls)


def test_clusters(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(5, 64))
    rows = [(i, [float(np.float32(x)) for x in centre[i % 5] + 0.3 * rng.normal(size=64)]) for i in range(300)]
    # Ties, repeated rows and ids, a copy that a third of all rows are, and vectors that are left out.
    rows += [(1000 + i, [0.0] * 64) for i in range(150)] + rows[:20] + [(7, [1.0] * 64), (None, [0.5] * 64)]
    rows += [(2000, None), (2001, [1.0] * 63), (2002, [1.0] * 63 + [None]), (2003, [float("nan")] + [0.0] * 63), (2004, [])]
    assert clusters_of(spark, rows) == plain_clusters(rows, 16, 3)


def test_few_or_no_vectors(spark):
    few = [(i, [float(i)] * 64) for i in range(3)]
    assert clusters_of(spark, few) == plain_clusters(few, 16, 3)
    assert clusters_of(spark, [(1, None)]) == [] == clusters_of(spark, [])


def test_search_is_exact_and_skips_distances():
    rng = np.random.default_rng(1)
    values = rng.integers(-3, 4, size=(200, 8))
    values[50:60] = values[40:50]
    x = np.concatenate((rng.integers(-5, 6, size=(3000, 8)), values[:70]))
    far = values * 1000
    for c, y in ((values, x), (far, x * 900), (np.full((5, 8), 1 << 27), x - (1 << 27) + 5)):
        number, distance, taken = centroids.nearest(y, centroids.Centroids.of(c))
        every = ((y[:, None] - c[None]) ** 2).sum(axis=2)
        assert (distance == every.min(axis=1)).all() and (number == every.argmin(axis=1)).all()
        assert taken <= len(y) * len(c)
    assert centroids.nearest(x, centroids.Centroids.of(values))[2] < 0.7 * len(x) * len(values)
