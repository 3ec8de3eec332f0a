"""Substring dedup, suffix dedup and language-model scores against brute force."""

from __future__ import annotations

import random

import pytest

import numpy as np

from fleetgauge.llm import hashing, lm_scoring, queries, slices, substring_dedup, suffix_dedup
from tests.llm import brute

SCHEMA = "doc_id long, text string"


def corpus(seed, n=60, shared=6):
    rng = random.Random(seed)
    vocabulary = ["é" * rng.randint(0, 2) + "".join(rng.choices("abcdef", k=rng.randint(1, 7))) for _ in range(400)]
    passages = [rng.choices(vocabulary, k=rng.randint(8, 120)) for _ in range(shared)]
    rows = []
    for doc_id in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts.append(rng.choices(vocabulary, k=rng.randint(0, 40)))
            if rng.random() < 0.5:
                p = rng.choice(passages)
                parts.append(p[rng.randint(0, 3) : len(p) - rng.randint(0, 3)])
        text = "".join(w + rng.choice([" ", " ", "\n", "\t ", "  "]) for p in parts for w in p)
        rows.append((doc_id * 3 - 20, text))
    rows += [(1000 + i, rows[i][1]) for i in range(0, 12)] + [rows[5], (None, rows[7][1]), (2000, None), (2001, ""), (2002, " \n\t")]
    rows.append((3000, " ".join(passages[0] * 6) + " x\x1cy \x0b z"))
    rng.shuffle(rows)
    return rows


def tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_agrees_with_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as slice", "1 as kept_text").repartition(3)
    out = substring_dedup.remove_repeated_passages(docs, slice_bytes=3000, bucket_bytes=2000)
    assert tuples(out, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.repeated_passages(rows), key=repr)
    small = substring_dedup.remove_repeated_passages(docs, window=5, period=3, slice_bytes=900)
    assert tuples(small, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.repeated_passages(rows, 5), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_agrees_with_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "2 as bucket", "3 as reply")
    for window, period in ((400, 181), (37, 13)):
        out = suffix_dedup.remove_repeated_strings(docs, window, period, slice_bytes=4000, bucket_bytes=4000)
        assert tuples(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.repeated_strings(rows, window), key=repr)
    row = out.filter("n_spans > 0").first()
    assert sum(s.end - s.begin for s in row.spans) == row.n_removed and len(row.kept) == row.n_bytes - row.n_removed


def alternating(first, second, steps):
    """A Thue-Morse sequence of two strings."""
    signs = [0]
    for _ in range(steps):
        signs += [1 - x for x in signs]
    return "".join((first, second)[x] for x in signs)


def test_suffix_dedup_keeps_regular_texts_that_differ(spark):
    """Hashes modulo a power of two, whatever their base, are equal for these strings, whole documents and windows alike."""
    one, other = alternating("qR", "sA", 8), alternating("sA", "qR", 8)
    left, right = "".join(f"{i:x}-" for i in range(60)), "".join(f"{i * i}+" for i in range(60))
    x, y = alternating("nOM", "Kwm", 7), alternating("Kwm", "nOM", 7)
    rows = [(1, one), (2, other), (3, left + x + right), (4, left + y + right), (5, x), (6, y), (7, one + x), (8, "x" + one)]
    for slice_bytes in (500, 1 << 20):
        for some in (rows[:2], rows[2:6], rows):
            out = suffix_dedup.remove_repeated_strings(spark.createDataFrame(some, SCHEMA), slice_bytes=slice_bytes, bucket_bytes=500)
            assert tuples(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.repeated_strings(some), key=repr)
    assert not any(r[2] for r in brute.repeated_strings(rows[:6]))


def test_byte_runs_are_sums_modulo_a_prime():
    buffer = np.random.default_rng(1).integers(0, 256, 200_000, np.uint8)
    runs, prime = hashing.ByteRuns(buffer), (1 << 61) - 1
    for start, width in ((0, 400), (65_530, 400), (131_000, 37), (199_600, 400), (5, 3)):
        total = sum(int(buffer[start + k]) * pow(hashing._PRIME_BASE, k, prime) for k in range(width)) % prime
        lead = int.from_bytes(bytes(8 - min(width, 8)) + buffer[start : start + min(width, 8)].tobytes(), "little")
        want = hashing.mix(np.array([total], np.uint64) + hashing.mix(np.array([lead], np.uint64)))
        assert (runs.hashes(np.array([start]), np.array([start + width])) == want).all()


def test_long_words_that_differ_are_not_equal(spark):
    """As above, for words: substring dedup and language-model scores tell them apart."""
    one, other, rest = alternating("qR", "sA", 8), alternating("sA", "qR", 8), " a b c d e f g h i j k l"
    rows = [(1, one + rest), (2, other + rest), (3, one + rest + " m"), (4, other)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = substring_dedup.remove_repeated_passages(docs)
    assert tuples(out, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.repeated_passages(rows), key=repr)
    scores = {r.doc_id: r.log10_score for r in lm_scoring.score_documents(docs, 3, 0.4, 1).collect()}
    assert scores == {d: pytest.approx(x, abs=1e-9) for d, _, x in brute.lm_scores(rows, min_count=1)}


@pytest.mark.parametrize(("order", "min_count", "others"), [(3, 2, False), (1, 1, False), (4, 1, False), (2, 3, False), (3, 1, True), (4, 2, True), (1, 1, True)])
def test_lm_scores_agree_with_brute_force(spark, order, min_count, others):
    rows = corpus(3)
    out = lm_scoring.score_documents(spark.createDataFrame(rows, SCHEMA), order, 0.4, min_count, slice_bytes=3000, bucket_bytes=3000, others_only=others)
    mine = sorted(((r.doc_id, r.n_words, r.log10_score) for r in out.collect()), key=lambda r: repr(r[:2]))
    want = sorted(brute.lm_scores(rows, order, 0.4, min_count, others), key=lambda r: repr(r[:2]))
    assert [r[:2] for r in mine] == [r[:2] for r in want]
    for a, b in zip(mine, want):
        assert a[2] == pytest.approx(b[2], abs=1e-6)
    assert {r.n_words for r in out.filter("mean_log10 is null").collect()} == {0}


def test_registered_lm_scoring_counts_every_ngram(spark, tmp_path):
    rows = [(1, "a b c a b d"), (2, "a b c x"), (3, "once only here"), (4, ""), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.QUERIES["op8_lm_scoring"](spark, str(tmp_path)).collect()
    want = {r[0]: r for r in brute.lm_scores(rows, min_count=1)}
    assert {r.doc_id: r.n_words for r in out} == {d: r[1] for d, r in want.items()}
    for r in out:
        assert r.log10_score == pytest.approx(want[r.doc_id][2], abs=1e-9)


def test_slices_grow_with_the_square_root(spark, monkeypatch):
    """The rows between slices and buckets stay few, and results the same, when both have to grow."""
    rows = corpus(6)
    df = spark.createDataFrame(rows, SCHEMA)
    total = sum(len((t or "").encode()) for _, t in rows)
    dealt = slices.slice_documents(df, 100, 100)
    assert dealt.frame.select("slice").distinct().count() << dealt.bits <= 2 * total / slices.ROW_BYTES + 1
    monkeypatch.setattr(slices, "ROW_BYTES", 1)
    small = sorted(map(tuple, lm_scoring.score_documents(df, slice_bytes=500, bucket_bytes=500).select("doc_id", "n_words").collect()), key=repr)
    assert small == sorted(((d, n) for d, n, _ in brute.lm_scores(rows)), key=repr)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    for build in (substring_dedup.remove_repeated_passages, suffix_dedup.remove_repeated_strings, lm_scoring.score_documents):
        assert build(none).count() == 0
        assert build(spark.createDataFrame([(None, None)], SCHEMA)).count() == 1


def test_difference_covers():
    for period in (1, 2, 7, 13, 100, 181):
        cover = slices.difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_packed_keys_come_back():
    rng = np.random.default_rng(3)
    for bits, width, n in ((1, 8, 1), (3, 8, 5000), (8, 6, 5000), (8, 5, 1), (20, 5, 300), (9, 6, 70000)):
        keys = np.unique(rng.integers(0, 1 << (64 - bits), n, np.uint64)) | np.uint64(1 << (64 - bits))
        got = slices.unpack(slices.pack(keys, bits, width))
        assert (got == (keys << np.uint64(bits)) >> np.uint64(64 - 8 * width)).all()
