"""A training-data pipeline over the table of documents: classify, dedup, decontaminate, encode.

Each stage takes all rows that its predecessor kept, and returns them with the columns of documents, whatever those are; columns with
the names that operators use inside clash with nothing. A null text counts as empty. Rows without ``doc_id`` are documents that
no label, benchmark finding or group can name. No documents pass every stage as an empty table.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.llm import bpe, decontaminate, exact_dedup, quality, simhash_dedup
from fleetgauge.session import shared_dir

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by importance; junk and toxic ones go. Repeated rows stay or go together; without labels all stay."""
    return quality.sample_quality(docs, _table(spark, sf_dir, "labels")).select(*docs.columns)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest id; of repeated rows of one id and text, one."""
    return exact_dedup.kept_documents(docs)


def distinct_contents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by fingerprints of three-word shingles within two bits, the one with the smallest id.

    Ties cannot occur after exact dedup, but for rows of one id and several texts, which stay if they are their group's. Texts
    without words form one group. Rows without an id stay unless their group has a document with one.
    """
    return simhash_dedup.kept_documents(docs, shingle=3, radius=2, similarity=None)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark. Empty documents stay, and a row without an id goes if its text holds an item."""
    return decontaminate.clean_documents(docs, _table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the digest of the text decoded from them; empty texts have none. One row per document."""
    coded = bpe.encode_documents(docs, public_tokenizers.path(TOKENIZER))
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", good_quality),
    ("exact_dedup", distinct_texts),
    ("simhash_near_dedup", distinct_contents),
    ("benchmark_decontamination", without_benchmark),
    ("bpe_coding", encoded),
]

#: SQL can express neither the first nor the last stage; tests/llm holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is a table in a new folder of the shared one, which the next one reads; whoever runs it removes it."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = _table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
