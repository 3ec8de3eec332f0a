"""Quality classifier by importance resampling.

Generative models over hashed n-grams, of the target text (documents labelled good) and the raw text (all documents), give every
document a log importance weight, target over raw. A third model, of the documents labelled otherwise, is the prior of what the target
is not: its log ratio, rejected over raw, is subtracted. The documents with the largest log weights, perturbed by Gumbel noise, are
the sample (Gumbel top-k, that is, sampling without replacement in proportion to the weights).

A feature is an n-gram of tokens (runs of letters and digits, or of other visible characters; A-Z in lower case), or the text's shape:
length, share of distinct tokens, of repeated neighbours and of punctuation, each in bands. A document counts a feature once, so no
long document makes a word common. Each log ratio shrinks, the less its count stands out from chance the more: by z**4 / (z**4 +
SHRINK**4) at z standard errors, and likewise the closer it is to zero, by r**8 / (r**8 + 1) at a ratio of e**r. So the many rare or
common n-grams do not add up to noise in long documents, and none is cut.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.llm.hashing import BYTE_VALUES, mix, prefix, runs
from fleetgauge.llm.textio import byte_pieces
from fleetgauge.llm.topk import kth_largest
from fleetgauge.session import shared_dir

BITS = 20
_CHUNK_BITS = 10
#: Bytes of text whose features are made at once: several numbers of 8 bytes for each byte.
_PIECE = 256 << 10
#: The standard errors at which a log ratio counts by half.
SHRINK = 3.0
#: Bytes by kind: 0 space, 1 letters, digits and all non-ASCII, 2 the rest.
_KIND = np.full(256, 2, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_LOWER = np.arange(256)
_LOWER[0x41:0x5B] += 0x20


def features(buffer: np.ndarray, ends: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and feature numbers, each pair once, of concatenated texts."""
    n_docs = len(ends)
    kind = _KIND[buffer]
    first = np.ones(len(buffer), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[ends[ends < len(buffer)]] = True
    starts = np.flatnonzero(first)
    stops = np.append(starts[1:], len(buffer))
    visible = kind[starts] > 0
    starts, stops = starts[visible], stops[visible]
    tokens = mix(runs(prefix(BYTE_VALUES[_LOWER[buffer]]), starts, stops) + (stops - starts).astype(np.uint64))
    doc = np.searchsorted(ends, starts, side="right")
    parts = [(doc, tokens)]
    for n in range(2, order + 1):
        whole = doc[: len(doc) - n + 1] == doc[n - 1 :]
        at = np.flatnonzero(whole)
        parts.append((doc[at], runs(prefix(tokens), at, at + n)))
    n = np.bincount(doc, minlength=n_docs)
    some = np.maximum(n, 1)
    distinct = np.unique((doc.astype(np.uint64) << np.uint64(40)) | (tokens >> np.uint64(24)))
    shares = (
        np.bincount((distinct >> np.uint64(40)).astype(np.int64), minlength=n_docs),
        np.bincount(doc[1:][(tokens[1:] == tokens[:-1]) & (doc[1:] == doc[:-1])], minlength=n_docs),
        np.bincount(doc[kind[starts] == 2], minlength=n_docs),
    )
    length = np.floor(np.log2(some)).astype(np.uint64)
    every = np.arange(n_docs)
    parts.append((every, mix(length + np.uint64(1 << 32))))
    for i, (share, bands) in enumerate(zip(shares, (10, 10, 20), strict=True), 2):
        band = np.floor(bands * share / some).astype(np.uint64)
        by_length = length * np.uint64(64) if i == 2 else np.uint64(0)
        parts.append((every, mix(np.uint64(i << 32) + by_length + band)))
    docs = np.concatenate([d for d, _ in parts]).astype(np.uint64)
    hashes = np.concatenate([h for _, h in parts]) >> np.uint64(64 - BITS)
    pairs = np.unique((docs << np.uint64(BITS)) | hashes)
    return (pairs >> np.uint64(BITS)).astype(np.int64), (pairs & np.uint64((1 << BITS) - 1)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Log importance weight of each feature that has one."""

    feature: np.ndarray
    weight: np.ndarray
    order: int

    def column(self, spark: SparkSession, text: Column) -> Column:
        """The log importance weight of a text. The table of all ``2**BITS`` weights (8 MB) is broadcast."""
        order, dense = self.order, np.zeros(1 << BITS)
        dense[self.feature] = self.weight
        shared = spark.sparkContext.broadcast(dense)

        @F.arrow_udf("double")
        def log_weight(texts: pa.Array) -> pa.Array:
            out = np.zeros(len(texts))
            for a, b, buffer, ends in byte_pieces(texts, _PIECE):
                doc, number = features(buffer, ends, order)
                out[a:b] = np.bincount(doc, weights=shared.value[number], minlength=b - a)
            return pa.array(out)

        return log_weight(text)


def shrunk(count: np.ndarray, raw: np.ndarray, rows: int, all_rows: int) -> np.ndarray:
    """The shrunk log ratio of the counts in a sample of ``rows`` documents to the raw counts."""
    expected = raw * rows / all_rows
    ratio = np.log((count + 0.5) / (expected + 0.5))
    z4 = ((count - expected) ** 2 / (expected + 1)) ** 2
    return ratio * ratio**8 / (ratio**8 + 1) * z4 / (z4 + SHRINK**4)


def fit(docs: DataFrame, labels: DataFrame, order: int = 1, max_labelled: int = 200_000, seed: int = 0) -> Model:
    """Fit the models. Raw counts cover every document.

    The target is at most ``max_labelled`` good documents (quality 1, not toxic, by all their labels), the rejects as many of those with
    a label of quality 0 or toxic, chosen by a hash of the id; their ids are sent to all tasks. The weight of a feature is its
    :func:`shrunk` log ratio of target to raw less that of rejects to raw.
    """
    verdict = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    good = verdict.filter("doc_id is not null and quality = 1 and coalesce(toxic, 0) = 0")
    bad = verdict.filter("doc_id is not null and (quality = 0 or toxic = 1)")

    def chosen(some: DataFrame, kind: int) -> DataFrame:
        keyed = some.withColumn("key", F.xxhash64("doc_id", F.lit(seed)))
        cut = kth_largest(keyed, max_labelled)
        return (keyed if cut is None else keyed.filter(F.col("key") >= F.lit(cut))).select("doc_id", F.lit(kind).alias("kind"))

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # At most max_labelled ids of either kind (and any with the hash at the cut).
    labelled = F.broadcast(chosen(good, 1).unionByName(chosen(bad, 2)))
    marked = own.join(labelled, "doc_id", "left").select("text", F.coalesce("kind", F.lit(0)).alias("kind"))
    chunks = 1 << (BITS - _CHUNK_BITS)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, aim, bad = (np.zeros(1 << BITS, np.int64) for _ in range(3))
        rows = good_rows = bad_rows = 0
        for batch in batches:
            kind = batch.column("kind").to_numpy(zero_copy_only=False)
            rows, good_rows, bad_rows = rows + len(kind), good_rows + int((kind == 1).sum()), bad_rows + int((kind == 2).sum())
            for a, b, buffer, ends in byte_pieces(batch.column("text"), _PIECE):
                doc, number = features(buffer, ends, order)
                own_kind = kind[a:b][doc]
                for counts, some in ((raw, number), (aim, number[own_kind == 1]), (bad, number[own_kind == 2])):
                    if len(some):
                        counts += np.bincount(some, minlength=1 << BITS)
        if rows:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(chunks), pa.int32()),
                    pa.array([x.tobytes() for x in raw.reshape(chunks, -1)], pa.binary()),
                    pa.array([x.tobytes() for x in aim.reshape(chunks, -1)], pa.binary()),
                    pa.array([x.tobytes() for x in bad.reshape(chunks, -1)], pa.binary()),
                    pa.array([rows] * chunks, pa.int64()),
                    pa.array([good_rows] * chunks, pa.int64()),
                    pa.array([bad_rows] * chunks, pa.int64()),
                ],
                names=["chunk", "raw", "aim", "bad", "rows", "good_rows", "bad_rows"],
            )

    def weigh(table: pa.Table) -> pa.Table:
        raw, aim, bad = (sum(np.frombuffer(x, np.int64).astype(np.float64) for x in table.column(c).to_pylist()) for c in ("raw", "aim", "bad"))
        rows, good_rows, bad_rows = (sum(table.column(c).to_pylist()) for c in ("rows", "good_rows", "bad_rows"))
        weight = shrunk(aim, raw, good_rows, rows) - shrunk(bad, raw, bad_rows, rows)
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "weight": pa.array([weight.astype("<f8").tobytes()], pa.binary())})

    counted = marked.mapInArrow(count, "chunk int, raw binary, aim binary, bad binary, rows long, good_rows long, bad_rows long")
    found = counted.groupBy("chunk").applyInArrow(weigh, "chunk int, weight binary").collect()  # 2**BITS numbers in all
    dense = np.zeros((chunks, 1 << _CHUNK_BITS))
    for r in found:
        dense[r.chunk] = np.frombuffer(r.weight, "<f8")
    feature = np.flatnonzero(dense)
    return Model(feature, dense.reshape(-1)[feature], order)


def sample_key(text: Column, temperature: float, seed: int | Column) -> Column:
    """The log weight over ``temperature`` plus Gumbel noise, as a whole number, so that all passes agree whatever the order of additions."""
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", text, F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.round((F.round(F.col("log_weight"), 6) / temperature - F.log(-F.log(uniform))) * (1 << 20)).cast("long")


def resample(docs: DataFrame, model: Model, k: int | None = None, reject_below: float = -2.0, temperature: float = 1.0, seed: int = 0, columns: Sequence[str] | None = None) -> DataFrame:
    """The sampled rows with their ``columns`` (default: all), ``log_weight`` and ``sample_key``: the ``k`` largest keys (ties at the
    cut stay).

    The key is the log weight over ``temperature`` plus Gumbel noise that is a function of id, text and ``seed``; at 1 documents are
    drawn without replacement in proportion to their weights. By default ``k`` is the number of documents with a log weight of at
    least ``reject_below``. Existing columns of the two names are replaced. Every text is scored once: the rows are kept with their
    keys below the shared folder, and cut there.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    weight = model.column(docs.sparkSession, text)
    scored = docs.withColumn("log_weight", weight).withColumn("sample_key", sample_key(text, temperature, seed))
    store = f"{shared_dir(docs.sparkSession)}/quality-{uuid.uuid4().hex}"
    kept = [c for c in (docs.columns if columns is None else columns) if c not in ("log_weight", "sample_key")]
    scored.select(*kept, "log_weight", "sample_key").write.parquet(store)
    scored = docs.sparkSession.read.schema(scored.select(*kept, "log_weight", "sample_key").schema).parquet(store)
    if k is None:
        k = scored.filter(F.col("log_weight") >= reject_below).count()
    cut = kth_largest(scored.select(F.col("sample_key").alias("key")), k)
    return scored.filter(F.lit(False) if cut is None else F.col("sample_key") >= F.lit(cut))


def sample_quality(docs: DataFrame, labels: DataFrame, seed: int = 0, **options) -> DataFrame:
    """Fit on ``docs`` (``doc_id``, ``text``) and ``labels`` (``doc_id``, ``quality``, ``toxic``), then :func:`resample`.

    A null text counts as empty and is scored like any other; a null ``doc_id`` has no label. Labels of no document, null labels and
    repeated labels are allowed (a document is good if all its labels say so). Without labels no feature has a weight and all
    documents stay. Repeated rows get one key, so they stay or go together. No documents give no rows.
    """
    return resample(docs, fit(docs, labels, seed=seed), seed=seed, **options)
