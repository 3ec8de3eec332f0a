"""How text filters interact: what each removes in every order of application, and which labelled documents it costs.

A document is a set of failed filters, a mask of five bits. Four bits come from its own text. The fifth, a copy of a smaller id's text,
takes a prepass: every task counts the hashes of its texts in a counting Bloom sketch (counters end at two), the sketches are merged by
segment, and a text with a counter of one is guaranteed unique. Only possible repeats are shuffled, by their full text, for the
smallest id. Flags then join by the text's digest, and masks are counted. The counts add up, so the 120 orders are sums over at most 32
masks of a part, whatever the number of documents.
"""

from __future__ import annotations

import itertools
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.llm.hashing import mix
from fleetgauge.llm.textio import byte_pieces
from fleetgauge.llm.words import numbered_words
from fleetgauge.session import shared_dir

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT = 50  # per cent of the words
MAX_CAPITALS = 3  # per cent of the characters
SYMBOLS = b"#$%&*|"

#: Cells per document, cells of one document, and the bits of the largest sketch: 2**28 cells, one bit each once merged, are 32 MB.
CELLS, HASHES, MOST_BITS = 8, 3, 28
_SEGMENT_BITS = 16
_HELD = 1 << 21

_IS_CAPITAL = np.zeros(256, bool)
_IS_CAPITAL[0x41:0x5B] = True
_STARTS_CHARACTER = (np.arange(256) & 0xC0) != 0x80
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def text_masks(texts: pa.Array) -> np.ndarray:
    """Of each text (null: empty), the sum of 1, 2, 4 and 8 for the failed filters A to D."""
    out = np.zeros(len(texts), np.int32)
    for a, b, data, stops in byte_pieces(texts, 4 << 20):
        number, ends, distinct = numbered_words(texts.slice(a, b - a))
        words = np.diff(ends, prepend=0)
        doc = np.repeat(np.arange(b - a), words)
        different = np.bincount(np.unique(doc * max(1, len(distinct)) + number) // max(1, len(distinct)), minlength=b - a)

        def held(kind: np.ndarray, data: np.ndarray = data, stops: np.ndarray = stops) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(kind[data])])[stops], prepend=0)

        fails = (words < MIN_WORDS, 100 * different < MIN_DISTINCT * words, 100 * held(_IS_CAPITAL) > MAX_CAPITALS * held(_STARTS_CHARACTER), held(_IS_SYMBOL) > 0)
        out[a:b] = sum(f.astype(np.int32) << i for i, f in enumerate(fails))
    return out


def cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The cells of each hash, a row of ``HASHES``."""
    own = hashes.view(np.uint64)[:, None]
    return (mix(own + np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _sketch_bits(rows: int) -> int:
    return min(MOST_BITS, max(_SEGMENT_BITS, (CELLS * rows).bit_length()))


def repeated_cells(hashes: DataFrame, bits: int) -> np.ndarray:
    """The cells (a bitmap) that at least two rows of the long column ``h`` count in.

    A task sends, for each segment of the sketch, the cells it counted once and more than once; what reaches the driver is one bit per
    cell, at most ``2**MOST_BITS`` in all.
    """

    def parts(counted: np.ndarray) -> Iterator[pa.RecordBatch]:
        cell, n = np.unique(counted, return_counts=True)
        segment = cell >> _SEGMENT_BITS
        place = (cell & ((1 << _SEGMENT_BITS) - 1)).astype(np.uint16)
        first = np.flatnonzero(np.diff(segment, prepend=-1))
        once, more = [], []
        for a, b in itertools.pairwise([*first.tolist(), len(cell)]):
            once.append(place[a:b][n[a:b] == 1].tobytes())
            more.append(place[a:b][n[a:b] > 1].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(segment[first], pa.int32()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], names=["segment", "once", "more"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(cells(batch.column("h").to_numpy(), bits).ravel())
            size += len(held[-1])
            if size > _HELD:
                yield from parts(np.concatenate(held))
                held, size = [], 0
        if size:
            yield from parts(np.concatenate(held))

    def merge(table: pa.Table) -> pa.Table:
        counter = np.zeros(1 << _SEGMENT_BITS, np.uint8)
        for once, more in zip(table.column("once").to_pylist(), table.column("more").to_pylist(), strict=True):
            counter[np.frombuffer(more, np.uint16)] = 2
            place = np.frombuffer(once, np.uint16)
            counter[place] = np.minimum(counter[place] + 1, 2)
        return pa.table({"segment": table.column("segment").slice(0, 1), "bitmap": pa.array([zlib.compress(np.packbits(counter > 1).tobytes(), 1)], pa.binary())})

    merged = hashes.select("h").mapInArrow(count, "segment int, once binary, more binary").groupBy("segment").applyInArrow(merge, "segment int, bitmap binary")
    out = np.zeros(1 << (bits - 3), np.uint8)
    width = 1 << (_SEGMENT_BITS - 3)
    for r in merged.collect():
        out[r.segment * width : (r.segment + 1) * width] = np.frombuffer(zlib.decompress(r.bitmap), np.uint8)
    return out


def may_repeat(docs: DataFrame, hashes: DataFrame, rows: int) -> Column:
    """Whether a text whose hash is the column ``h`` may occur twice; false only where it certainly does not."""
    bits = _sketch_bits(rows)
    shared = docs.sparkSession.sparkContext.broadcast(repeated_cells(hashes, bits))

    @F.pandas_udf("boolean")
    def marked(h: pd.Series) -> pd.Series:
        at = cells(h.to_numpy(np.int64), bits)
        return pd.Series(((shared.value[at >> 3] >> (7 - (at & 7))) & 1).all(axis=1))

    return marked(F.col("h"))


def failed_filters(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``part`` (the language, null: empty), ``digest`` of the text and ``mask``: 1, 2, 4, 8, 16 for A to E failed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    hashed = own.withColumn("h", F.xxhash64("text"))

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = ["doc_id", "part", "h", "digest"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(text_masks(batch.column("text")), pa.int32())], names=[*rest, "mask"])

    measured = hashed.select("doc_id", "part", "h", F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    folder = f"{shared_dir(docs.sparkSession)}/filter-audit-{uuid.uuid4().hex}"
    measured.mapInArrow(measure, "doc_id long, part string, h long, digest binary, mask int").write.parquet(folder)
    flags = docs.sparkSession.read.parquet(folder)
    maybe = may_repeat(docs, flags, flags.count())
    first = hashed.filter(maybe).groupBy("text").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = first.select(F.unhex(F.sha2("text", 256)).alias("digest"), "first_id")
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    return flags.join(first, "digest", "left").select("doc_id", "part", "digest", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"))


def mask_counts(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, and those labelled good or toxic, by ``part`` and ``mask``."""
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    joined = flags.select("doc_id", "part", "mask").join(marks, "doc_id", "left")
    return joined.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, zeros included.

    ``part``, ``filter_order``, ``step`` (1 to 5), and counts of documents: ``kept`` after the step, ``removed`` in it, ``redundant``
    (fail its filter, removed earlier), ``unique_fails`` (fail no other filter), ``good_lost`` and ``toxic_lost`` (removed in it, with
    any label of quality 1, of toxic 1), ``shapley`` (removed by its filter, summed over all orders).

    Filters fail texts of under 200 words (A), of under half distinct words (B), of over 3 % A-Z (C), with any of ``#$%&*|`` (D), and
    copies of a smaller id's text in the whole table (E). A null text counts as empty, a null ``lang`` is the part of the empty
    string. Every row counts, so repeated rows of one id and text count each, and are no copies of each other. A row without
    ``doc_id`` has no label, and is neither a copy nor an original. Labels of no document, null and repeated labels are allowed. Other
    columns are ignored. No documents give no rows.
    """
    counts = mask_counts(failed_filters(docs), labels)
    orders = F.array(*(F.lit("".join(p)) for p in itertools.permutations(FILTERS)))
    steps = counts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    steps = steps.withColumn("bit", F.expr("shiftleft(1, ascii(substring(filter_order, step, 1)) - 65)"))
    earlier = "aggregate(sequence(1, 5), 0, (sum, i) -> sum + if(i < step, shiftleft(1, ascii(substring(filter_order, i, 1)) - 65), 0))"
    steps = steps.withColumn("earlier", F.expr(earlier))
    failed, gone = F.expr("mask & bit <> 0"), F.expr("mask & earlier <> 0")

    def total(when: Column, of: str = "n") -> Column:
        return F.sum(F.when(when, F.col(of)).otherwise(0))

    out = steps.groupBy("part", "filter_order", "step").agg(
        total(~failed & ~gone).alias("kept"),
        total(failed & ~gone).alias("removed"),
        total(failed & gone).alias("redundant"),
        total(F.expr("mask = bit")).alias("unique_fails"),
        total(failed & ~gone, "good").alias("good_lost"),
        total(failed & ~gone, "toxic").alias("toxic_lost"),
    )
    # 120 rows, one per order.
    letter = Window.partitionBy("part", F.expr("substring(filter_order, step, 1)"))
    return out.withColumn("shapley", F.sum("removed").over(letter))
