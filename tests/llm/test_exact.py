"""Exact dedup against grouping by text, with weakened hashes too."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from fleetgauge.llm import exact_dedup as X

SCHEMA = "doc_id long, text string, bucket string, keep_id int, key double"


def rows(seed=1):
    rng = random.Random(seed)
    texts = ["".join(rng.choices("ab é\n", k=rng.randint(0, 6))) for _ in range(120)] + ["x" * 100_000, "", None]
    out = [(i, rng.choice(texts)) for i in range(300)] + [(300 + i, "hot") for i in range(200)]
    out += [(5, out[5][1]), (None, "hot"), (None, "alone"), (None, "alone"), (None, None)]
    return [(*r, "b", 1, 0.5) for r in out]


def brute(data):
    groups = {}
    for doc_id, text, *_ in data:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for doc_id, text, *_ in data:
        ids = groups[text or ""]
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out.append((doc_id, keep, len(ids), doc_id == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(
    ("key", "digest", "capacity"),
    [
        (X._key, X._digest, 16384),
        (X._key, X._digest, 2),
        (lambda t: X._key(t).bitwiseAND(F.lit(-(1 << 60))), X._digest, 3),
        (lambda t: X._key(t).bitwiseAND(F.lit(-(1 << 62))), lambda t: F.substring(X._digest(t), 1, 1), 3),
    ],
)
def test_groups_agree_with_brute_force(spark, key, digest, capacity):
    data = rows()
    out = X.exact_dedup(spark.createDataFrame(data, SCHEMA).repartition(5), capacity, key=key, digest=digest)
    mine = sorted((tuple(r) for r in out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)
    assert mine == brute(data)


@pytest.mark.parametrize("broken", ["one bucket by two names", "a cell in two buckets", "a cell is missing"])
def test_the_directory_decides(spark, monkeypatch, broken):
    """With a directory that sends rows elsewhere, the groups come out otherwise."""
    data, build = rows(), X.build_directory

    def wrong(keys, capacity):
        cells, depth = build(keys, capacity)
        first = cells.agg(F.min("cell")).first()[0]
        if broken == "one bucket by two names":
            other = cells.withColumn("bucket", F.floor(F.rand(1) * 1e6).cast("long"))
            return cells.unionByName(other), depth
        if broken == "a cell in two buckets":
            return cells.unionByName(cells.filter(F.col("cell") == first).withColumn("bucket", F.lit(-1).cast("long"))), depth
        return cells.filter(F.col("cell") != first), depth

    monkeypatch.setattr(X, "build_directory", wrong)
    out = X.exact_dedup(spark.createDataFrame(data, SCHEMA), 8).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted((tuple(r) for r in out.collect()), key=repr) != brute(data)


def test_directory_splits_only_what_is_overfull(spark):
    crowded = [(i,) for i in range(1, 2000)]  # all below one leading prefix
    spread = [((i << 54) - (1 << 63),) for i in range(0, 1024, 7)]
    cells, depth = X.build_directory(spark.createDataFrame(crowded + spread, "key long"), 500)
    got = {r.cell: (r.depth, r.bucket) for r in cells.collect()}
    assert depth > X.ROOT_BITS and min(d for d, _ in got.values()) < depth
    for cell, (d, bucket) in got.items():
        assert cell >> (depth - d) == bucket >> (depth - d)


def test_kept_documents(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    out = X.kept_documents(df)
    assert out.columns == df.columns
    kept = sorted((tuple(r)[:2] for r in out.collect()), key=repr)
    want = {(d, t) for (d, t, *_), b in zip(data, [None] * len(data)) if d is not None or t in ("alone",)}
    best = {}
    for d, t in want:
        if (t or "") not in best or (d or -1) > (best[t or ""][0] or -1):
            best[t or ""] = (d, t)
    assert len(kept) == len(best) and {k[0] for k in kept} == {b[0] for b in best.values()}
    assert X.kept_documents(df.limit(0)).count() == 0 and X.exact_dedup(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = X.exact_dedup(spark.createDataFrame(rows(), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
