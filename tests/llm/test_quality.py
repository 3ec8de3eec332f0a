"""Importance resampling: held-out accuracy, the top-k cut, edge cases."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetgauge.llm import quality as Q
from fleetgauge.llm.topk import kth_largest


def test_held_out_accuracy(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(3000)]
    docs, truth = [], {}
    for i in range(1500):
        body = rng.choices(words, k=rng.randint(20, 300))
        kind = rng.random()
        if kind < 0.1:
            for _ in range(rng.randint(2, 5)):
                body.insert(rng.randrange(len(body)), rng.choice(["vile", "nasty"]))
        elif kind < 0.2:
            body = [w + "$$" for w in body]
        truth[i] = kind >= 0.2
        docs.append((i, " ".join(body), 1.5))
    labels = [(i, 1, 0 if good else 1) for i, good in truth.items() if i % 2 == 0] + [(0, None, None), (99999, 1, 0), (None, 1, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, log_weight double")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in Q.sample_quality(df, lab, temperature=1e-6).collect()}
    held_out = [i for i in truth if i % 2]
    assert sum((i in kept) == truth[i] for i in held_out) >= 0.97 * len(held_out)
    assert all(i not in kept for i in held_out if not truth[i])


@pytest.mark.parametrize(("sf", "at_most"), [("sf0.001", 2), ("sf0.01", 0)])
def test_planted_toxic_words_go(spark, sf, at_most):
    """Also from small tables. The two that may stay of sf0.001's nine have a single such word, seen in few labelled documents."""
    words = r"\\b(disgusting|scum|moron|loser|clown|worthless|trash|pathetic|stupid|idiot)\\b"
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    planted = {r.doc_id for r in docs.filter(F.expr(f"lower(text) rlike '{words}'")).select("doc_id").collect()}
    kept = {r.doc_id for r in Q.resample(docs, Q.fit(docs, labels), temperature=1e-6).select("doc_id").collect()}
    good = {r.doc_id for r in labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).filter("q = 1 and t = 0").collect()}
    assert len(planted) >= 9 and len(planted & kept) <= at_most
    assert len(good & kept) >= 0.99 * len(good)


def test_inclusion_follows_the_weights(spark):
    """Over many seeds, two of five documents are drawn as by drawing one after the other in proportion to the weights."""
    weights, seeds = np.array([1.0, 2.0, 3.0, 6.0, 0.5]), 4000
    want = np.zeros(5)
    for a in range(5):
        for b in set(range(5)) - {a}:
            p = weights[a] / weights.sum() * weights[b] / (weights.sum() - weights[a])
            want[[a, b]] += p
    rows = spark.createDataFrame([(i, f"text {i}", float(np.log(w))) for i, w in enumerate(weights)], "doc_id long, text string, log_weight double")
    drawings = rows.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))).withColumn("key", Q.sample_key(F.col("text"), 1.0, F.col("seed")))
    keys = np.array([r["key"] for r in drawings.orderBy("doc_id", "seed").select("key").collect()]).reshape(5, seeds)
    drawn = np.argsort(-keys, axis=0)[:2]
    assert np.abs(np.bincount(drawn.ravel(), minlength=5) / seeds - want).max() < 4 * np.sqrt(0.25 / seeds)


def brute_features(text, order):
    """The features of a text by name."""
    tokens = [t.lower() for t in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\t-\r]+", (text or "").encode())]
    n, some = len(tokens), max(1, len(tokens))
    length = int(np.log2(some))
    out = {(k, *tokens[i : i + k]) for k in range(1, order + 1) for i in range(n - k + 1)}
    marks = sum(not re.match(rb"[0-9A-Za-z\x80-\xff]", t) for t in tokens)
    return out | {("length", length), ("distinct", length, 10 * len(set(tokens)) // some), ("repeats", 10 * sum(map(bytes.__eq__, tokens, tokens[1:])) // some), ("marks", 20 * marks // some)}


@pytest.mark.parametrize("order", [1, 2])
def test_weights_agree_with_brute_force(spark, order):
    rng = random.Random(order)
    words = ["Ab", "ab", "c", "déf", "$$", "x1", "--", "zz"]
    docs = [(i, rng.choice((" ", "  ", "\n")).join(rng.choices(words[: rng.randint(2, 8)], k=rng.randint(0, 40)))) for i in range(200)] + [(None, "Ab c"), (7, "again"), (500, None)]
    labels = [(i, rng.choice((0, 1, 1, None)), rng.choice((0, 0, 1, None))) for i in range(0, 220, 2)] + [(4, 0, 0), (None, 1, 0)]
    verdict = {}
    for d, q, t in labels:
        verdict.setdefault(d, []).append((q, t))
    kind = {}
    for d, seen in verdict.items():
        quality, toxic = [q for q, _ in seen if q is not None], [t for _, t in seen if t is not None]
        if d is not None and quality and min(quality) == 1 and max(toxic, default=0) == 0:
            kind[d] = 1
        elif d is not None and (quality and min(quality) == 0 or max(toxic, default=0) == 1):
            kind[d] = 2
    held = [(kind.get(d, 0), brute_features(t, order)) for d, t in docs]
    rows = [len(held), *(sum(k == i for k, _ in held) for i in (1, 2))]
    raw, aim, bad = ({f: sum(f in fs for k, fs in held if want in (0, k)) for _, all_ in held for f in all_} for want in (0, 1, 2))

    def shrunk(count, f, n):
        expected = raw[f] * n / rows[0]
        ratio, z = np.log((count + 0.5) / (expected + 0.5)), (count - expected) / np.sqrt(expected + 1)
        return ratio * ratio**8 / (ratio**8 + 1) * z**4 / (z**4 + Q.SHRINK**4)

    want = [sum(shrunk(aim[f], f, rows[1]) - shrunk(bad[f], f, rows[2]) for f in fs) for _, fs in held]
    df = spark.createDataFrame([(*d, i) for i, d in enumerate(docs)], "doc_id long, text string, i int").repartition(3)
    model = Q.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), order)
    got = df.select("i", model.column(spark, F.coalesce("text", F.lit(""))).alias("w")).orderBy("i").collect()
    assert np.allclose([r.w for r in got], want, atol=1e-9)


def test_every_text_is_scored_once(spark):
    """What comes back is read from the stored keys; the texts are not scored again."""
    df = spark.createDataFrame([(i, f"w{i % 7}") for i in range(50)], "doc_id long, text string")
    out = Q.sample_quality(df, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"), columns=["doc_id"])
    assert out.columns == ["doc_id", "log_weight", "sample_key"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_kth_largest(spark):
    rng = np.random.default_rng(0)
    values = [int(x) for x in rng.integers(-(2**62), 2**62, 500)] + [5, 5, 5, -1, 0, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(v,) for v in values], "key long").cache()
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 250, 251, 252, 253, len(values)):
        assert kth_largest(df, k) == ordered[k - 1]
    assert kth_largest(df, 0) is None and kth_largest(df, len(values) + 1) is None


def test_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "x y"), (3, "a " * 200_000), (3, "a " * 200_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.sample_quality(df, none).count() == 5
    assert Q.sample_quality(df.limit(0), none).count() == 0
    assert Q.resample(df, Q.Model(np.zeros(0, np.int64), np.zeros(0), 1), k=0).count() == 0
    assert Q.resample(df.filter("doc_id <> 3"), Q.Model(np.zeros(0, np.int64), np.zeros(0), 1), k=1).count() == 1


@pytest.mark.parametrize("order", [1, 3])
def test_features_are_per_document(order):
    texts = [b"A b, a b", b"", b"zz zz zz !!", "é é".encode()]
    alone = [set(Q.features(np.frombuffer(t, np.uint8), np.array([len(t)]), order)[1].tolist()) for t in texts]
    doc, number = Q.features(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]), order)
    assert [set(number[doc == i].tolist()) for i in range(4)] == alone
