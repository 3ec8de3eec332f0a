"""Packing: token ids against the library, subset sums against brute force, and the rules of sequences."""

from __future__ import annotations

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetgauge.llm import packing
from fleetgauge.llm.queries import QUERIES
from tests.llm.test_tokens import texts

WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids int, start string, sequence_id double"


def odd_texts():
    return [*texts(11, 120), "İSTANBUL ΣΑΣ ǅ ﬁn", "é ́a ạ́", "<|startoftext|>x<|endoftext|>y", "a<|endoftext|> <|endoftext|>", " x Y　z", "A'S don'T 12 345 x'll"]


def library_ids(values):
    library = Tokenizer.from_file(WORDS)
    return [library.encode(t or "", add_special_tokens=False).ids + [1] for t in values]


def check(rows, want, capacity):
    """``want``: of each document its id and ids, as a multiset."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        documents[r.doc_id].append((r.start, r.doc_tokens, ids))
    lengths = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity and at & (at - 1) == 0
        lengths.append(at)
    assert sorted(documents) == sorted(d for d, _ in want)
    for doc_id, ids in want:
        at = []
        for start, tokens, part in sorted(documents[doc_id]):
            assert start == len(at) and tokens == len(ids)
            at += part
        assert at == ids
    return lengths


def test_word_ids_are_those_of_the_library(monkeypatch):
    values = odd_texts()
    for remembered in (10**6, 20):
        monkeypatch.setattr(packing, "REMEMBERED", remembered)
        coder = packing.WordIds(WORDS)
        got = []
        for part in range(0, len(values), 30):
            ids, ends = coder.encode(pa.array(values[part : part + 30]), 1)
            got += [x.tolist() for x in np.split(ids, ends[:-1])]
        assert got == library_ids(values)


@pytest.mark.parametrize("seed", range(30))
def test_fill_is_the_largest_sum(seed):
    rng = random.Random(seed)
    pool, lengths = packing.Pool(64), [rng.choice((3, 5, 7, 12, 13, 20, 31)) for _ in range(rng.randint(0, 9))]
    for i, n in enumerate(lengths):
        pool.add((i, 0, n))
    target = rng.randint(0, 64)
    sums = {sum(c) for k in range(len(lengths) + 1) for c in itertools.combinations(lengths, k)}
    found = pool.fill(target)
    assert sum(n * k for n, k in found.items()) == max(s for s in sums if s <= target)
    assert all(lengths.count(n) >= k for n, k in found.items())


@pytest.mark.parametrize("shape", ["mixed", "equal", "long", "ones"])
def test_windows_are_full(shape):
    rng = random.Random(7)
    draw = {"mixed": lambda: rng.randint(1, 63), "equal": lambda: 27, "long": lambda: rng.randint(40, 63), "ones": lambda: 1}[shape]
    pool, total = packing.Pool(64), 0
    for i in range(500):
        pool.add((i, 0, n := draw()))
        total += n
    sizes = [sum(n for _, _, n in w) for w in pool.windows()]
    assert sum(sizes) == total and sum(s == 64 for s in sizes) == total // 64
    assert sorted(s for s in sizes if s < 64) == [1 << b for b in range(6) if total >> b & 1]


@pytest.mark.parametrize(("capacity", "pool", "parts"), [(16, 40, 3), (2048, 1 << 21, 1), (1, 4, 2)])
def test_every_id_is_in_one_piece(spark, capacity, pool, parts):
    values = odd_texts()
    # Ids 0 and 1 of documents must not meet: repeated ids would make the rows of one id ambiguous here.
    rows = [(i, t, 1, "s", 0.5) for i, t in enumerate(values)]
    out = packing.pack_documents(spark.createDataFrame(rows, SCHEMA).repartition(parts), WORDS, capacity, 1, pool).collect()
    lengths = check(out, list(enumerate(library_ids(values))), capacity)
    assert sum(n < capacity for n in lengths) <= parts * capacity.bit_length()


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert packing.pack_documents(none, WORDS).count() == 0
    df = spark.createDataFrame([(None, "a b"), (None, None), (5, ""), (5, ""), (6, "word " * 30_000)], "doc_id long, text string").coalesce(1)
    out = packing.pack_documents(df, WORDS).collect()
    assert sum(r.length for r in out) == 3 + 1 + 1 + 1 + 30_001
    assert sorted({(r.doc_id, r.doc_tokens) for r in out}, key=repr) == [(5, 1), (6, 30_001), (None, 1), (None, 3)]
    with pytest.raises(ValueError):
        packing.pack_documents(df, WORDS, capacity=1000)


def test_query_over_the_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = dict(zip(docs, library_ids(docs.values()), strict=True))
    rows = QUERIES["op12_packing"](spark, sf).collect()
    sizes, seen = defaultdict(int), defaultdict(list)
    for r in rows:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(part.tobytes()) and r.length == len(part) and r.doc_tokens == len(ids[r.doc_id])
        sizes[r.sequence_id] += r.length
        seen[r.doc_id].append((r.start, r.length))
    assert all(n <= 2048 and n & (n - 1) == 0 for n in sizes.values())
    for doc_id, parts in seen.items():
        assert sum(n for _, n in parts) == len(ids[doc_id]) and [s for s, _ in sorted(parts)] == [0, *itertools.accumulate(n for _, n in sorted(parts))][:-1]
    # Minimum bin slack: few documents are cut beyond what their length asks for.
    cuts = sum(len(parts) - -(-len(ids[d]) // 2048) for d, parts in seen.items())
    assert len(seen) == len(docs) and cuts <= 0.1 * len(docs) and spark.range(1).select(F.crc32(F.lit("a"))).first()[0] == zlib.crc32(b"a")
