"""SimHash near-dedup against comparing all pairs."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from fleetgauge.llm import graph
from fleetgauge.llm import simhash_dedup as N

SCHEMA = "doc_id long, text string, id int, prints string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, k):
    words = [w for w in lower(text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
    return [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


def fingerprint(text, k):
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, k)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(rows, linked):
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if linked(i, j):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return [least.get(root(i)) for i in range(len(rows))]


def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdeÉ", k=rng.randint(1, 5))) for _ in range(300)]
    rows = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice([3, 30, 90, 200]))
        for _ in range(rng.randint(1, 6)):
            words = list(base)
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = rng.choice([" ", "\n", " \t"]).join(words)
            rows.append((len(rows) * 7 % 211, text.upper() if rng.random() < 0.2 else text))
    return rows + [(500, ""), (501, None), (502, " \n"), (503, "one"), (504, "ONE"), (None, rows[3][1]), (None, "lonely two words"), rows[4]]


def test_contract_agrees_with_all_pairs(spark):
    rows = corpus()
    out = N.near_duplicates(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA), 3, similarity=None)
    prints = [fingerprint(t, 3) for _, t in rows]
    want = grouped(rows, lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    mine = sorted((tuple(r) for r in out.select("doc_id", "fingerprint", "component_id").collect()), key=repr)
    assert mine == sorted(((d, f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, want)), key=repr)


def test_similarity_agrees_with_all_pairs(spark):
    rows = corpus()
    sets = [Counter(shingles(t, 5)) for _, t in rows]

    def similar(i, j):
        union = (sets[i] | sets[j]).total()
        return union == 0 or (sets[i] & sets[j]).total() >= 0.8 * union

    want = grouped(rows, similar)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    out = N.near_duplicates(df)
    assert sorted((tuple(r) for r in out.select("doc_id", "component_id").collect()), key=repr) == sorted(((d, c) for (d, _), c in zip(rows, want)), key=repr)
    kept = N.kept_documents(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} - {None} == {c for c in want if c is not None}


def test_links_hidden_behind_false_ones(spark):
    """Variants of one text around the similarity: nearest links are often false, and true ones are no part of the first forest."""
    rng = random.Random(3)
    rows = []
    for size in (60, 120):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(60):
            words = list(base)
            for at in rng.sample(range(size), size // 40 + rng.randint(0, 1)):
                words[at] = f"v{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    sets = [Counter(shingles(t, 5)) for _, t in rows]
    want = grouped(rows, lambda i, j: (sets[i] & sets[j]).total() >= 0.8 * (sets[i] | sets[j]).total())
    assert 2 < len(set(want)) < len(rows)
    out = N.near_duplicates(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA), radius=100)
    assert sorted(tuple(r) for r in out.select("doc_id", "component_id").collect()) == list(zip(range(len(rows)), want, strict=True))


def test_repeated_lines_and_short_texts(spark):
    """Pairs at the similarity of which one repeats a line, and pairs of four and five shingles."""
    rng = random.Random(11)

    def text(n):
        return [f"w{rng.randrange(10**7)}" for _ in range(n)]

    pairs = []
    for size, line, times in ((1000, 12, 15), (2000, 12, 35), (300, 1, 60)):
        for _ in range(3):
            base, repeated = text(size), text(line)
            pairs.append((base, base + repeated * times))
    for _ in range(1000):
        base = text(8)
        pairs.append((base, base + text(1)))
    rows = [(2 * i + k, " ".join(words)) for i, pair in enumerate(pairs) for k, words in enumerate(pair)]
    sets = [Counter(shingles(t, 5)) for _, t in rows]
    want = []
    for i in range(0, len(rows), 2):
        similar = (sets[i] & sets[i + 1]).total() >= 0.8 * (sets[i] | sets[i + 1]).total()
        want += [(i, i), (i + 1, i if similar else i + 1)]
    assert all(least == doc // 2 * 2 for doc, least in want)
    out = N.near_duplicates(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA))
    assert sorted(tuple(r) for r in out.select("doc_id", "component_id").collect()) == want


def test_radii():
    """Against simulated sets: four common elements and one more, and many."""
    rng = np.random.default_rng(1)
    for common, a, b in ((4, 0, 1), (12, 1, 2), (80, 10, 10)):
        h = [N.mix(rng.integers(0, 2**64, common + a + b, dtype=np.uint64)) for _ in range(2000)]
        differ = [int(np.bitwise_count(N.fingerprint(x[: common + a]) ^ N.fingerprint(np.delete(x, np.s_[common : common + a])))) for x in h]
        assert abs(np.mean(differ) / 64 - N.bit_difference(common, b)[a, b]) < 0.005
    found = N.radii(0.8, 4)
    assert max(found) < 100 and found[N.band(4, 0.8)] > found[-1] > 64


@pytest.mark.parametrize("n", [3000])
def test_tiles_miss_no_pair(spark, n):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, n // 3, dtype=np.uint64)
    flips = [base ^ (np.uint64(1) << rng.integers(0, 64, n // 3, dtype=np.uint64)) for _ in range(2)]
    all_ = np.unique(np.concatenate([base, *flips]))
    items = spark.createDataFrame([(int(x), [int(x)], 5) for x in all_.view(np.int64)], "id long, prints array<long>, n long")
    old, N.CHUNK = N.CHUNK, 64
    try:
        found = graph.components(N.links(items, 2))
    finally:
        N.CHUNK = old
    mine = {r.node: r.root for r in found.collect()}
    near = np.bitwise_count(all_[:, None] ^ all_[None, :]) <= 2
    label = np.arange(len(all_))
    while True:
        new = np.where(near, label[None, :], len(all_)).min(axis=1)
        if (new == label).all():
            break
        label = new
    groups = {}
    for i, x in enumerate(all_.view(np.int64)):
        groups.setdefault(label[i], []).append(int(x))
    for members in groups.values():
        assert {mine.get(m, m) for m in members} == {min(members)}


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1002), (1002, 1000), (7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000, 1002: 1000}


def test_empty(spark):
    for options in ({}, {"similarity": None}):
        assert N.near_duplicates(spark.createDataFrame([], SCHEMA), **options).count() == 0
