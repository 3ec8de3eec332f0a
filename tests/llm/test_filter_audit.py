"""The filter audit against brute force, with sketches that fill up, and edge cases."""

from __future__ import annotations

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetgauge.llm import filter_audit as A
from fleetgauge.llm.queries import QUERIES
from tests.llm.brute import words

SCHEMA = "doc_id long, text string, lang string, mask string, part int, h double, n boolean"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute(docs, labels):
    first = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    good, toxic = ({d for d, *v in labels if v[i] == 1 and d is not None} for i in (0, 1))
    parts = defaultdict(list)
    for doc_id, text, lang in docs:
        t, w = text or "", words(text)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": doc_id is not None and first[t] < doc_id,
        }
        parts[lang or ""].append(({f for f in fails if fails[f]}, doc_id in good, doc_id in toxic))
    out, shapley = {}, defaultdict(int)
    for part, rows in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                shapley[part, f] += len(gone)
                redundant = sum(f in r[0] for r in rows) - len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)]
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def fixture(seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdé語", k=rng.randint(1, 5))) for _ in range(400)]

    def text():
        size, pool = rng.choice((0, 3, 199, 200, 201, 260)), rng.choice((vocabulary, vocabulary[:90]))
        out = rng.choices(pool, k=size)
        if rng.random() < 0.3 and out:
            out[rng.randrange(size)] = rng.choice(("$$", "a|b", "ABCDEFGHIJKLMNOPQRSTUVWXYZABCDEFG", "Àx", "%"))
        return rng.choice((" ", "  ", "\t", "\n")).join(out)

    texts = [text() for _ in range(60)] + ["", None, " \n", "x " * 50_000, "A", "AA bbb"]
    docs = [(i, rng.choice(texts), rng.choice(("en", "de", "", None, "zz"))) for i in range(250)]
    docs += [(1000 + i, "one text of many", "en") for i in range(120)]
    docs += [(7, docs[7][1], "en"), (None, "one text of many", "en"), (None, None, None), (-3, "one text of many", "fr")]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in rng.choices(range(1200), k=400)] + [(None, 1, 1), (99_999, 1, 1)]
    return docs, labels


def result(rows):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in rows}


@pytest.mark.parametrize("most_bits", [28, 16])
def test_agrees_with_brute_force(spark, monkeypatch, most_bits):
    monkeypatch.setattr(A, "MOST_BITS", most_bits)
    docs, labels = fixture(most_bits)
    df = spark.createDataFrame([(*d, "m", 1, 0.5, True) for d in docs], SCHEMA).repartition(4)
    rows = A.audit_filters(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = brute(docs, labels)
    assert len(rows) == len(want) == 5 * 120 * 5 and result(rows) == want


def test_sketch_never_clears_a_repeat(spark, monkeypatch):
    """Also when there are more texts than cells; and with room, few unique ones are left."""
    rng = np.random.default_rng(0)
    unique = rng.integers(-(2**63), 2**63 - 1, 30_000)
    rows = [(int(h),) for h in unique] + [(int(h),) for h in unique[:500]] * 3
    df = spark.createDataFrame(rows, "h long").repartition(7)
    for bits, held in ((16, 1000), (18, 1 << 21)):
        monkeypatch.setattr(A, "MOST_BITS", bits)
        monkeypatch.setattr(A, "_HELD", held)
        left = {r.h for r in df.filter(A.may_repeat(df, df, df.count())).select("h").distinct().collect()}
        assert {int(h) for h in unique[:500]} <= left
        assert bits == 16 or len(left) < 0.1 * len(unique)


def test_unique_texts_do_not_shuffle(spark):
    """Of the rows that the exact step aggregates, only possible repeats are left."""
    docs = spark.createDataFrame([(i, f"text number {i}", "en") for i in range(5000)] + [(9000, "text number 7", "en")], "doc_id long, text string, lang string")
    hashed = docs.withColumn("h", F.xxhash64("text"))
    assert hashed.filter(A.may_repeat(docs, hashed, 5001)).count() < 500
    assert A.failed_filters(docs).filter("mask >= 16").select("doc_id").collect()[0].doc_id == 9000


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit_filters(none, labels).count() == 0
    one = spark.createDataFrame([(None, None, None)], none.schema)
    rows = A.audit_filters(one, labels).collect()
    assert len(rows) == 600 and result(rows) == brute([(None, None, None)], [])


def test_query_over_the_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert result(QUERIES["op13_filter_audit"](spark, sf).collect()) == brute(docs, labels)
