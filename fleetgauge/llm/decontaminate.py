"""Benchmark decontamination by SimHash windows and exact verification, with DataFrame functions only.

For every benchmark item, all windows of a document with as many words as the item are candidates if they hold at least one word
shingle of an item of that length; a window without one has similarity zero. A candidate window and the items of its length get a
64-bit SimHash of their shingles. The multi-index: fingerprints within ``radius`` bits agree in at least one of eight blocks up to
``radius // 8`` bits, so an equi join on blocks, the items' blocks in all their variants, finds every such pair. Pairs within the
radius are verified by the similarity of their weighted shingles (smaller over larger counts, summed).
"""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
BLOCKS = 8
_LANES = 16
_LANE_ONES = 0x0001000100010001
#: So many hashes fit the 16-bit lanes; more are counted bit by bit.
LANE_LIMIT = 0xFFFF
#: More distinct shingles than this are joined without being broadcast (16 bytes each).
BROADCAST_SHINGLES = 500_000


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingles(tokens: str, size: int) -> Column:
    """Hashes of the runs of ``size`` words."""
    n = F.size(tokens)
    some = F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(tokens, i, size)))
    return F.when(n >= size, some).otherwise(F.array().cast("array<long>"))


def simhash(hashes: str) -> Column:
    """The bits set in over half of the hashes. Counts are kept in 16-bit lanes, those of more than ``LANE_LIMIT`` hashes as 64 numbers."""
    return F.when(F.size(hashes) <= LANE_LIMIT, _simhash_in_lanes(hashes)).otherwise(_simhash_of_many(hashes))


def _simhash_of_many(hashes: str) -> Column:
    """Bit by bit, each with a counter of its own."""

    def bit(p: Column) -> Column:
        count = F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + F.call_function("shiftrightunsigned", h, p).bitwiseAND(F.lit(1).cast("long")))
        return F.call_function("shiftleft", F.when(count * 2 > F.size(hashes), F.lit(1)).otherwise(F.lit(0)).cast("long"), p)

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda f, p: f.bitwiseOR(bit(p)))


def _simhash_in_lanes(hashes: str) -> Column:
    lanes = F.transform(
        F.sequence(F.lit(0), F.lit(_LANES - 1)),
        lambda j: F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + F.call_function("shiftrightunsigned", h, j).bitwiseAND(F.lit(_LANE_ONES))),
    )

    def bit(lanes: Column, p: Column) -> Column:
        lane = F.element_at(lanes, (p % _LANES) + 1)
        count = F.call_function("shiftrightunsigned", lane, p - p % _LANES).bitwiseAND(F.lit(0xFFFF))
        return F.call_function("shiftleft", F.when(count * 2 > F.size(hashes), F.lit(1)).otherwise(F.lit(0)).cast("long"), p)

    # The lanes are bound once by a one-element transform.
    bound = F.transform(F.array(lanes), lambda c: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda f, p: f.bitwiseOR(bit(c, p))))
    return bound[0]


def _block(value: Column, number: Column | int) -> Column:
    if isinstance(number, int):
        return F.shiftrightunsigned(value, number * 8).bitwiseAND(F.lit(0xFF))
    return F.call_function("shiftrightunsigned", value, number * 8).bitwiseAND(F.lit(0xFF))


def _variants(radius: int) -> list[int]:
    """All changes of a block by at most ``radius // BLOCKS`` bits."""
    flips = range(min(8, radius // BLOCKS) + 1)
    return [functools.reduce(lambda a, b: a | 1 << b, bits, 0) for n in flips for bits in itertools.combinations(range(8), n)]


def weighted_similarity(a: str, b: str) -> Column:
    """Of two arrays with repeats: the smaller counts of common elements over the larger counts of all."""

    def count(array: str, x: Column) -> Column:
        return F.size(F.filter(array, lambda y: y == x))

    common = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))
    return common / (F.size(a) + F.size(b) - common)


def _keyed(docs: DataFrame) -> DataFrame:
    own = F.col("doc_id").cast("long")
    text = F.coalesce("text", F.lit(""))
    # A row is known by id and text; a missing id by the smallest long.
    return docs.select(own.alias("doc_id"), F.coalesce(own, F.lit(-(1 << 63)).cast("long")).alias("id"), F.xxhash64(text).alias("content"), text.alias("text"))


def _hits(rows: DataFrame, items: DataFrame, size: int, radius: int, similarity: float) -> DataFrame:
    """Hits of the items whose shingles have ``size`` words."""
    hashed = rows.select("id", "content", shingles("tokens", size).alias("hashes")).withColumn("held", F.size("hashes"))
    known = items.select(F.explode_outer("item_hashes").alias("hash"), "n").distinct()
    few = known.count() <= BROADCAST_SHINGLES
    # Of a document only its numbers go along with each shingle, never the array. (The outer form, because for the inner one the
    # optimizer would push a filter on the array down to the text, and split the text anew for every element.)
    seeds = hashed.select("id", "content", "held", F.posexplode_outer("hashes").alias("at", "hash")).join(F.broadcast(known) if few else known, "hash")
    # Shingles of a window of n words; a shorter document is one window.
    m = F.col("n") - (size - 1)
    last = F.least(F.col("at"), F.greatest(F.col("held") - m, F.lit(0)))
    first = F.least(F.greatest(F.col("at") - m + 1, F.lit(0)), last)
    starts = seeds.select("id", "content", "n", F.explode(F.sequence(first, last)).alias("start")).distinct()
    by_document = starts.groupBy("id", "content").agg(F.collect_list(F.struct("n", "start")).alias("wanted"))  # at most n windows a word
    cut = F.transform("wanted", lambda w: F.struct(w["n"].alias("n"), w["start"].alias("start"), F.slice("hashes", w["start"] + 1, w["n"] - (size - 1)).alias("window")))
    documents = hashed.join(by_document, ["id", "content"]).dropDuplicates(["id", "content"])
    windows = documents.select("id", "content", F.explode_outer(cut).alias("w")).select("id", "content", "w.*")
    windows = windows.withColumn("print", simhash("window"))
    blocks = F.array(*[F.struct(F.lit(b).alias("block"), _block(F.col("print"), b).alias("value")) for b in range(BLOCKS)])
    variants = F.array(*map(F.lit, _variants(radius)))
    probes = windows.select("id", "content", "n", "start", "window", "print", F.explode(blocks).alias("b")).select("*", "b.*").drop("b")
    index = items.select("item_id", "n", "item_hashes", "item_print", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block"))
    index = index.withColumn("flip", F.explode(variants)).withColumn("value", _block(F.col("item_print"), F.col("block")).bitwiseXOR(F.col("flip"))).drop("flip")
    near = probes.join(index, ["n", "block", "value"]).filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
    # Of the blocks in which a pair agrees, the first one counts.
    agree = [F.bit_count(_block(F.col("print").bitwiseXOR(F.col("item_print")), b)) <= radius // BLOCKS for b in range(BLOCKS)]
    first_block = F.coalesce(*[F.when(a, F.lit(b)) for b, a in enumerate(agree)])
    once = near.filter(F.col("block") == first_block)
    scored = once.withColumn("similarity", weighted_similarity("window", "item_hashes"))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n")).alias("best")
    hits = scored.groupBy("id", "content", "item_id").agg(best).filter(F.col("best.similarity") >= similarity)
    return hits.select("id", "content", "item_id", "best.similarity", (-F.col("best.back")).alias("start"), F.col("best.n").alias("n_words"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, radius: int = 23, similarity: float = 0.8) -> DataFrame:
    """Benchmark items found in documents: ``doc_id``, ``item_id``, ``similarity``, ``start`` (word), ``n_words`` and ``content``.

    One row per document and item, with the most similar (then first) window of the item's length. Words are lower-case runs of letters
    and digits; shingles have five words, or as many as a shorter item has. At similarity 0.8 fingerprints differ by ten bits on
    average, and by more than the default radius once in a hundred thousand windows.

    Null texts, texts and items without words match nothing; a document shorter than an item is one window. Rows without ``doc_id`` are
    searched, too (``doc_id`` null); of repeated rows of one id and text one is reported. Items repeated under one id are
    searched each and reported once; a null ``item_id`` is an id like any other. Other columns are ignored.
    """
    rows = _keyed(docs).withColumn("tokens", words(F.col("text")))
    tokens = benchmark.select("item_id", words(F.coalesce("text", F.lit(""))).alias("tokens")).withColumn("n", F.size("tokens")).filter("n > 0")
    tokens = tokens.withColumn("size", F.least(F.col("n"), F.lit(SHINGLE)))
    sizes = [r["size"] for r in tokens.select("size").distinct().orderBy("size").collect()]  # at most SHINGLE values
    found = []
    for size in sizes or [SHINGLE]:
        items = tokens.filter(F.col("size") == size).select("item_id", "n", shingles("tokens", size).alias("item_hashes"))
        found.append(_hits(rows, items.withColumn("item_print", simhash("item_hashes")), size, radius, similarity))
    hits = functools.reduce(DataFrame.unionByName, found)
    doc_id = F.when(F.col("id") != F.lit(-(1 << 63)).cast("long"), F.col("id"))
    return hits.select(doc_id.alias("doc_id"), "item_id", "similarity", "start", "n_words", "id", "content")


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The input rows, all columns, without documents that hold a benchmark item."""
    leaks = find_leaks(docs, benchmark, **options).select(F.col("id").alias("__id"), F.col("content").alias("__content")).distinct()
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))
    same = (own == F.col("__id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__content"))
    return docs.join(leaks, same, "left_anti")
