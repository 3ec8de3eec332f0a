"""SimHash near-dedup by tiled exact comparison.

Every document gets a fingerprint of its word shingles. Distinct fingerprints are dealt into tiles and, within a tile, into chunks
of a few thousand; pairs of chunks are compared whole in numpy, by exclusive-or and bit counts, so no pair within the radius is
missed. Pairs of tiles that cannot hold a link are never built:

* fingerprints within ``radius`` bits have population counts that differ by at most ``radius``, also when the counts of ``blocks``
  parts of the fingerprint are taken apart and their differences added, so a tile is a vector of such counts and meets only the
  tiles within ``radius`` of it;
* where links are verified by similarity, shingle counts in a ratio below the similarity rule a pair out as well, so a tile is a
  band of shingle counts and meets the next band. (Radii that fit a similarity of 0.8 are too wide for counts to rule much out.)

Where links are verified, the repeats of a shingle are numbered and count as different elements. The similarity of two multisets is
then that of two sets, to which the distance of fingerprints is tied, however often a line is repeated.

A chunk pair returns a spanning forest of its links, nearest links first, never all pairs of a dense group. Where links are
verified, a forest's link may turn out false while one left out of the forest is true. So the groups with a false link are compared
again, with what is already connected taken as one, and more forests are returned each time, until none is left out.
"""

from __future__ import annotations

import functools
import itertools
import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.graph import components
from fleetgauge.llm.hashing import mix
from fleetgauge.session import shared_dir

SEED = 42
CHUNK = 4096
#: Further words of a wide fingerprint take their bits from these re-mixed shingle hashes.
SKETCH_WORDS = 4
#: The share of pairs at the similarity whose fingerprints may lie beyond the radius.
MISSED = 1e-8
#: Up to so many shingles the radius is computed exactly; the chance that a bit differs falls from there on.
EXACT_SHINGLES = 128


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of the space-joined word shingles of a text, A-Z in lower case, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = list(itertools.accumulate((len(w) + 1 for w in words)))
    size = min(size, len(words))
    starts = [0, *ends[: len(words) - size]]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[size - 1 :], strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> np.uint64:
    """The bits that are set in over half of the hashes; zero for none."""
    count = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[part : part + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int32)
    return np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0]


def numbered(hashes: np.ndarray) -> np.ndarray:
    """The hashes, where the second and later of equal ones are mixed with their number, so that all are distinct."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    first = np.ones(len(ranked), bool)
    first[1:] = ranked[1:] != ranked[:-1]
    place = np.arange(len(ranked))
    number = (place - np.maximum.accumulate(np.where(first, place, 0))).astype(np.uint64)
    out = hashes.copy()
    out[order] = np.where(first, ranked, mix(ranked ^ mix(number)))
    return out


def bit_difference(common: int, most: int) -> np.ndarray:
    """The chance that a fingerprint bit of two sets differs: they share ``common`` elements, and have 0 to ``most`` further ones each."""

    def chances(n: int) -> np.ndarray:
        return np.array([math.comb(n, k) / 2**n for k in range(n + 1)])

    share = chances(common)
    lead = 2 * np.arange(common + 1) - common
    # For each number of further elements and each lead of ones among the common ones: the chance that ones are over half.
    over = np.array([((2 * np.arange(n + 1) - n)[None, :] > -lead[:, None]) @ chances(n) for n in range(most + 1)])
    mean = over @ share
    return mean[:, None] + mean[None, :] - 2 * (over * share) @ over.T


def band(n: int, similarity: float) -> int:
    return math.floor(math.log(max(n, 1)) / math.log(1 / similarity))


@functools.cache
def radii(similarity: float, words: int) -> list[int]:
    """For each band of shingle counts, the last one standing for all above: the radius that a pair of the similarity exceeds with
    a chance of ``MISSED`` at most, from the exact distribution of the distance in the worst case."""
    worst = [0.0] * (band(EXACT_SHINGLES, similarity) + 1)
    for common in range(1, EXACT_SHINGLES + 1):
        most = math.floor(common * (1 / similarity - 1) + 1e-9)
        difference = bit_difference(common, most)
        for a in range(most + 1):
            at = band(common + a, similarity)
            if at < len(worst):
                worst[at] = max(worst[at], float(difference[a, : most - a + 1].max()))
    bits = 64 * words
    out = []
    for p in worst[:-1]:  # the last band is not whole
        tail, radius = 0.0, bits
        while radius and (tail := tail + math.comb(bits, radius) * p**radius * (1 - p) ** (bits - radius)) <= MISSED:
            radius -= 1
        out.append(radius)
    return out


def fingerprints(docs: DataFrame, shingle: int, words: int, number: bool = False) -> DataFrame:
    """``doc_id``, ``content`` (a hash of the text), ``n`` (shingles) and ``words`` fingerprint words as signed longs; with
    ``number``, of the :func:`numbered` shingles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, prints = [], []
            for text in batch.column("text"):
                h = shingle_hashes(text.as_py().encode(), shingle)
                n.append(len(h))
                h = numbered(h) if number else h
                prints.append([fingerprint(h)] + [fingerprint(mix(h + np.uint64(i))) for i in range(1, words)])
            signed = pa.array(list(np.array(prints, np.uint64).reshape(-1, words).view(np.int64)), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("content"), pa.array(n, pa.int64()), signed], names=["doc_id", "content", "n", "prints"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("content"), "text").mapInArrow(run, "doc_id long, content long, n long, prints array<long>")


def forest(u: np.ndarray, v: np.ndarray, distance: np.ndarray, nodes: int) -> np.ndarray:
    """Indexes of links that connect what all links connect, nearest first (a minimum spanning forest)."""
    order = np.argsort(distance, kind="stable")
    parent = list(range(nodes))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    chosen: list[int] = []
    while len(order):
        head, order = order[:8192], order[8192:]
        for i in head.tolist():
            a, b = root(int(u[i])), root(int(v[i]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                chosen.append(i)
        if len(order):
            label = np.array([root(x) for x in range(nodes)])
            order = order[label[u[order]] != label[v[order]]]
    return np.array(chosen, np.int64)


def spanning(u: np.ndarray, v: np.ndarray, distance: np.ndarray, nodes: int, forests: int) -> np.ndarray:
    """Indexes of so many spanning forests without a common link, each of the nearest links that the earlier ones left."""
    rest, chosen = np.arange(len(u)), []
    for _ in range(forests):
        if not len(rest):
            break
        keep = rest[forest(u[rest], v[rest], distance[rest], nodes)]
        chosen.append(keep)
        rest = np.setdiff1d(rest, keep, assume_unique=True)
        if len(rest) <= nodes * (forests - len(chosen)):
            # No more than the forests to come could hold.
            chosen.append(rest)
            break
    return np.concatenate(chosen) if chosen else rest


def compare(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` (rows of fingerprint words) and distances of all pairs within the radius."""
    found = []
    for start in range(0, len(a), 128):
        part = a[start : start + 128]
        distance = np.bitwise_count(part[:, None, 0] ^ b[None, :, 0]).astype(np.uint16)
        for w in range(1, a.shape[1]):
            distance += np.bitwise_count(part[:, None, w] ^ b[None, :, w])
        i, j = np.nonzero(distance <= radius)
        found.append((i + start, j, distance[i, j].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def _compare_chunks(words: int, forests: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids_a, ids_b, groups_a, groups_b, a, b = (
                    np.asarray(batch.column(c)[row].values) for c in ("ids_a", "ids_b", "groups_a", "groups_b", "prints_a", "prints_b")
                )
                a, b = a.view(np.uint64).reshape(-1, words), b.view(np.uint64).reshape(-1, words)
                i, j, d = compare(a, b, batch.column("radius")[row].as_py())
                groups, place = np.unique(np.concatenate([groups_a, groups_b]), return_inverse=True)
                u, v = place[: len(ids_a)][i], place[len(ids_a) :][j]
                own = u != v
                if ids_a[0] in ids_b:
                    # A chunk with itself: each pair is met twice.
                    own &= ids_a[i] < ids_b[j]
                i, j, u, v, d = i[own], j[own], u[own], v[own], d[own]
                keep = spanning(u, v, d, len(groups), forests)
                more = pa.array(np.full(len(keep), len(keep) < len(u)))
                yield pa.RecordBatch.from_arrays([pa.array(ids_a[i[keep]], pa.int64()), pa.array(ids_b[j[keep]], pa.int64()), more], names=["u", "v", "more"])

    return run


def _tiles(items: DataFrame, radius: int | None, blocks: int, similarity: float | None) -> tuple[DataFrame, list[tuple[int, ...]]]:
    """Items with their tile (an array of coordinates), and the tile offsets that can hold links, one of each opposite pair."""
    if similarity is not None:
        of_count = F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / math.log(1 / similarity))
        return items.withColumn("tile", F.array(of_count.cast("int"))), [(0,), (1,)]
    width = 64 // blocks
    mask = (1 << width) - 1
    part = [F.bit_count(F.shiftrightunsigned(F.col("prints")[0], width * b).bitwiseAND(F.lit(mask))).cast("int") for b in range(blocks)]
    steps = range(-radius, radius + 1)
    offsets = [o for o in itertools.product(steps, repeat=blocks) if sum(map(abs, o)) <= radius and o >= (0,) * blocks]
    return items.withColumn("tile", F.array(*part)), offsets


def links(items: DataFrame, radius: int | None, words: int = 1, blocks: int = 4, similarity: float | None = None, forests: int = 1) -> DataFrame:
    """Links ``u``, ``v`` within the radius between the ``id`` of ``items`` (distinct ``id``, ``prints``, ``n``): ``forests`` spanning
    forests of each chunk pair, and whether it holds ``more``. All words of a fingerprint count towards the radius; None stands
    for the :func:`radii` of the similarity. Items of one ``group`` (if there is such a column) are connected already."""
    if "group" not in items.columns:
        items = items.withColumn("group", F.col("id"))
    dealt, offsets = _tiles(items, radius, blocks, similarity)
    size = dealt.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    row = F.struct("id", "group", "prints")
    chunks = (
        dealt.join(size, "tile")
        .groupBy("tile", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"))
        .agg(F.collect_list(row).alias("rows"))
        .select("tile", "chunk", F.col("rows.id").alias("ids"), F.col("rows.group").alias("groups"), F.flatten("rows.prints").alias("prints"))
    )
    steps = F.array(*[F.array(*map(F.lit, o)) for o in offsets])
    left = chunks.select("tile", F.col("chunk").alias("mine"), F.col("ids").alias("ids_a"), F.col("groups").alias("groups_a"), F.col("prints").alias("prints_a"))
    # Only the addresses of chunks are multiplied by the offsets; a chunk's rows join when its partner is known to exist.
    address = size.withColumn("mine", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("tile", "mine", F.explode(steps).alias("step"))
    address = address.withColumn("other", F.zip_with("tile", "step", lambda a, b: a + b))
    partner = size.select(F.col("tile").alias("other"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("theirs"))
    pairs = address.join(partner, "other").filter((F.col("other") != F.col("tile")) | (F.col("theirs") >= F.col("mine"))).drop("step")
    right = chunks.select(F.col("tile").alias("other"), F.col("chunk").alias("theirs"), F.col("ids").alias("ids_b"), F.col("groups").alias("groups_b"), F.col("prints").alias("prints_b"))
    both = pairs.join(left, ["tile", "mine"]).join(right, ["other", "theirs"])
    columns = [f"{name}_{side}" for name in ("ids", "groups", "prints") for side in "ab"]
    if radius is None:
        by_band = radii(similarity, words)
        # A pair of the similarity is within the radius of either band.
        reach = F.array(*map(F.lit, by_band))[F.least(F.col("tile")[0], F.lit(len(by_band) - 1))]
    else:
        reach = F.lit(radius)
    return both.select(*columns, reach.alias("radius")).mapInArrow(_compare_chunks(words, forests), "u long, v long, more boolean")


def _similarity(docs: DataFrame, edges: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The edges, and whether the shingle multisets of their texts have the similarity (``good``; smaller over larger counts, summed)."""

    def shingles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.sort(shingle_hashes(t.as_py().encode(), shingle)).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(sets, pa.list_(pa.int64()))], names=["content", "hashes"])

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for row in range(batch.num_rows):
                a, b = (np.unique(np.asarray(batch.column(c)[row].values), return_counts=True) for c in ("a", "b"))
                _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
                common = int(np.minimum(a[1][i], b[1][j]).sum())
                total = int(a[1].sum() + b[1].sum()) - common
                good.append(total == 0 or common >= similarity * total)
            columns = [batch.column(c) for c in ("u", "v", "more")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(good, pa.bool_())], names=["u", "v", "more", "good"])

    named = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("content"), F.coalesce("text", F.lit("")).alias("text"))
    wanted = edges.select(F.col("u").alias("content")).unionByName(edges.select(F.col("v").alias("content"))).distinct()
    texts = named.join(wanted, "content", "left_semi").dropDuplicates(["content"]).mapInArrow(shingles, "content long, hashes array<long>")
    left = texts.select(F.col("content").alias("u"), F.col("hashes").alias("a"))
    right = texts.select(F.col("content").alias("v"), F.col("hashes").alias("b"))
    return edges.join(left, "u").join(right, "v").select("u", "v", "more", "a", "b").mapInArrow(verify, "u long, v long, more boolean, good boolean")


def verified_links(docs: DataFrame, items: DataFrame, radius: int | None, words: int, shingle: int, similarity: float, folder: str) -> DataFrame:
    """Links ``u``, ``v`` that connect all that the links within the radius and of the similarity connect.

    Each round writes its links below ``folder``. A link that was left out runs inside a group of the links returned. If those all
    hold, it adds nothing; groups where one failed, and more were left out, go to the next round with eight times as many forests.
    """
    spark = docs.sparkSession
    rest, forests, rounds = items, 1, 0
    good = spark.createDataFrame([], "u long, v long")
    while True:
        here = f"{folder}/round-{rounds}"
        links(rest, radius, words, similarity=similarity, forests=forests).write.parquet(f"{here}/proposed")
        proposed = spark.read.parquet(f"{here}/proposed")
        _similarity(docs, proposed, shingle, similarity).write.parquet(f"{here}/judged")
        judged = spark.read.parquet(f"{here}/judged")
        before, good = good, good.unionByName(judged.filter("good").select("u", "v"))
        failed = judged.filter("more and not good").select(F.col("u").alias("node"))
        if failed.isEmpty():
            return good
        reached = components(before.unionByName(proposed.select("u", "v")), f"{here}/reached")
        again = reached.join(reached.join(failed, "node", "left_semi").select("root").distinct(), "root", "left_semi")
        group = components(good, f"{here}/connected").select(F.col("node").alias("id"), F.col("root").alias("group"))
        rest = items.join(again, F.col("id") == F.col("node"), "left_semi").join(group, "id", "left")
        rest = rest.withColumn("group", F.coalesce("group", "id"))
        forests, rounds = forests * 8, rounds + 1


def near_duplicates(docs: DataFrame, shingle: int = 5, radius: int | None = None, similarity: float | None = 0.8, blocks: int = 4) -> DataFrame:
    """Groups of documents whose fingerprints lie within a radius, or whose shingles are similar.

    With ``similarity`` (default 0.8 over five-word shingles), fingerprints of 256 bits within ``radius`` propose links, which hold if
    the shingle multisets have the similarity. The fingerprints are of the numbered shingles, and the default radius is that which a
    pair at the similarity exceeds once in a hundred million, wider for texts of few shingles (:func:`radii`). With
    ``similarity=None``, 64-bit fingerprints of the shingles with their repeats within ``radius`` (default 2) are links, all found.

    One row per input row: ``doc_id``, ``fingerprint`` (first 64 bits, 16 lowercase hex digits), ``component_id`` (the smallest
    ``doc_id`` reachable over links, itself included). A-Z are lower-cased; words are runs of characters other than space and the
    controls tab to carriage return. Fewer words than a shingle: the whole sequence is one shingle. A null, empty or blank text has
    fingerprint zero, linked like any other. Rows without ``doc_id`` link, too, but name no component unless all its rows lack ids
    (null). Repeated rows share a group. Other columns are ignored. No documents give no rows.
    """
    words = 1 if similarity is None else SKETCH_WORDS
    radius = 2 if radius is None and similarity is None else radius
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/simhash-{uuid.uuid4().hex}"
    fingerprints(docs, shingle, words, number=similarity is not None).write.parquet(f"{folder}/prints")
    prints = spark.read.parquet(f"{folder}/prints")
    item = F.col("prints")[0] if similarity is None else F.col("content")
    prints = prints.withColumn("id", item)
    items = prints.groupBy("id").agg(F.first("prints").alias("prints"), F.first("n").alias("n"), F.min("doc_id").alias("least"))
    if similarity is None:
        edges = links(items.drop("least"), radius, words, blocks)
    else:
        edges = verified_links(docs, items.drop("least"), radius, words, shingle, similarity, folder)
    roots = components(edges, f"{folder}/components")
    placed = items.select("id", "least").join(roots, F.col("id") == F.col("node"), "left").select("id", "least", F.coalesce("root", "id").alias("root"))
    named = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("id", "component_id")
    hexed = F.lower(F.lpad(F.hex(F.col("prints")[0]), 16, "0"))
    return prints.join(named, "id").select("doc_id", hexed.alias("fingerprint"), "component_id", "content")


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The input rows, all columns, with one document of each group: that of the smallest ``doc_id``.

    Rows without ``doc_id`` stay unless their group has a document with one; of repeated rows of the kept id and text, all stay.
    """
    found = near_duplicates(docs, **options)
    keep = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id"), F.col("content").alias("__content")).distinct()
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.join(keep, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (own == F.col("__content")), "left_semi")
