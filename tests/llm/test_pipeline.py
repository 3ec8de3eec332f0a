"""Every stage of the pipeline against brute force on its predecessor's rows, and the registered queries."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as driver
import corpus_pipeline as P
from fleetgauge.llm.queries import ORACLES, QUERIES
from tests.llm import brute
from tests.llm.test_scan import brute_leaks
from tests.llm.test_simhash import fingerprint, grouped
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        out.append(docs.collect())
        if docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]:
            docs = spark.createDataFrame(out[-1], docs.schema)
    return out


def test_classifier_keeps_clean_documents(spark, steps):
    kept = {r.doc_id for r in steps[1]}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    clean = [r.doc_id for r in labels if r.quality == 1 and not r.toxic]
    assert sum(d in kept for d in clean) >= 0.97 * len(clean)
    assert kept <= {r.doc_id for r in steps[0]}


def test_exact_stage(steps):
    best = {}
    for r in steps[1]:
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in steps[2]) == sorted(best.values())


def test_near_stage(steps):
    """The stage of the contract: three-word shingles, fingerprints within two bits."""
    rows = [(r.doc_id, r.text) for r in steps[2]]
    prints = [fingerprint(t, 3) for _, t in rows]
    want = grouped(rows, lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    assert {r.doc_id for r in steps[3]} == {d for (d, _), c in zip(rows, want) if d == c} and len(steps[3]) == len(set(want))


def test_benchmark_stage(spark, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {row[0] for row in brute_leaks([(r.doc_id, r.text) for r in steps[3]], items)}
    assert sorted(r.doc_id for r in steps[4]) == sorted(r.doc_id for r in steps[3] if r.doc_id not in dirty)


def test_coding_stage(steps):
    library = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))
    texts = {r.doc_id: r.text for r in steps[4]}
    assert len(steps[5]) == len(texts)
    for r in steps[5]:
        assert r.ids == ",".join(map(str, library.encode(texts[r.doc_id], add_special_tokens=False).ids))
        assert r.n_tokens == len(r.ids.split(",")) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_queries_are_registered(spark):
    names = driver.queries()
    assert set(QUERIES) <= set(names) and {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in QUERIES if n != "pipeline"}
    con = connect(SF)
    for name, sql in ORACLES.items():
        assert not compare(spark, con, QUERIES[name], sql, SF)[1]


def test_passage_queries_over_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    mine = [tuple(r) for r in QUERIES["op1_substring_dedup"](spark, SF).collect()]
    assert sorted(mine) == sorted(brute.repeated_passages(rows))
    mine = [tuple(r) for r in QUERIES["op10_suffix_dedup"](spark, SF).collect()]
    assert sorted(mine) == sorted(brute.repeated_strings(rows))


ODD = [
    (1, "", "en", "s", 0, 5, "k"),
    (2, None, "en", "s", None, 5, "k"),
    (None, None, None, None, None, 5, "k"),
    (None, "one text without an id", "de", "s", 3, 5, "k"),
    (3, "one text of two rows", "de", "s", 3, 5, "k"),
    (3, "one text of two rows", "de", "s", 3, 5, "k"),
    (4, "one text of two rows", "de", "s", 3, 5, "k"),
    (5, "word " * 60_000, "de", "s", 3, 5, "k"),
    (6, "quite another text, with <|endoftext|> in it\t\n", "fr", "s", 3, 5, "k"),
]
#: Columns whose names the operators use inside.
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, bucket int, key string"


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_on_odd_rows(spark, tmp_path, rows):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(len(rows)).write.parquet(f"{tmp_path}/{name}.parquet")
    docs, seen = spark.createDataFrame(rows, CLASHING), []
    for _, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        seen.append(out.collect())
        if out.columns == docs.columns:
            docs = spark.createDataFrame(seen[-1], CLASHING)
    if not rows:
        assert seen == [[]] * len(P.STAGES)
        return
    # Nothing speaks against any of the rows; exact dedup leaves one of each text, near dedup one of those without words.
    by_text = [sorted({(r.text or "")[:20]: r.doc_id for r in s}.items()) for s in seen[:4]]
    assert len(seen[0]) == len(rows) and [len(s) for s in seen[1:4]] == [5, 5, 5]
    assert dict(by_text[1]) == {"": 2, "one text without an ": None, "one text of two rows": 4, "word word word word ": 5, "quite another text, ": 6}
    assert by_text[1] == by_text[2] == by_text[3]
    library = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))
    texts = {r.doc_id: r.text or "" for r in seen[3]}
    assert {(r.doc_id, r.ids) for r in seen[4]} == {(d, ",".join(map(str, library.encode(t, add_special_tokens=False).ids))) for d, t in texts.items()}
