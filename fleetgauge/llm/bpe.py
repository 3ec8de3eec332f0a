"""Byte-level BPE encoding and decoding with a transducer lexicon of frequent words.

The corpus' frequent words (pre-tokens) are compiled, with their ids, into a minimal acyclic transducer, which is written to the
shared folder, handed to all executors as a file by Spark and memory-mapped by their workers. Words that are not in it are merged
exactly, many at a time.

Texts are cut into units before every space that stands between two visible characters; no pre-token crosses such a place and none
depends on the other side, so a unit has the same ids wherever it occurs. The units of a run of texts are numbered once, each worker
remembers those it met last, and texts are put together by number.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
import re
import uuid
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.lexicon import Lexicon, build
from fleetgauge.llm.topk import kth_largest
from fleetgauge.llm.words import numbered_units, text_runs
from fleetgauge.session import shared_dir

#: Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: The same for units of printable ASCII and Latin-1 letters, which need no Unicode classes.
_PLAIN = re.compile(rf"[ -~{_LETTERS}]*")
_PLAIN_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_NONE = np.iinfo(np.int32).max
REMEMBERED = 200_000
#: Distinct units a task counts before it sends them; bytes of text handled at once.
COUNTED = 500_000
RUN_BYTES = 2 << 20
_WIDE = 32


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: visible Latin-1 characters are themselves, the rest follow 255."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """The merges of a tokenizer file (``tokenizers`` JSON, byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        self.bytes_of |= {i: content.encode() for content, i in self.special.items()}
        self.byte_ids = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_ids[b] = vocab[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # The longest first, so that of two special strings at one place the longer is taken.
        longest = sorted(self.special, key=len, reverse=True)
        self.specials = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.pattern = regex.compile(PATTERN)

    def pre_tokens(self, text: str) -> list[str]:
        """The pre-tokens of a text; special strings are tokens of their own."""
        if self.specials is None or not self.specials.search(text):
            return (_PLAIN_PATTERN if _PLAIN.fullmatch(text) else self.pattern).findall(text)
        out = []
        for part in self.specials.split(text):
            out += [part] if part in self.special else self.pattern.findall(part)
        return out

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, ``_NONE`` where there is none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], _NONE)

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The ids of words, by merging."""
        return [array("I", ids).tolist() for ids in self.merged_bytes(words)]

    def merged_bytes(self, words: list[bytes]) -> list[bytes]:
        """The same, as unsigned numbers of 32 bits."""
        out = [b""] * len(words)
        for low, high in ((0, 8), (8, 16), (16, _WIDE)):
            rows = [i for i, w in enumerate(words) if low < len(w) <= high]
            for part in range(0, len(rows), 4096):
                some = rows[part : part + 4096]
                for i, ids in zip(some, self._merge_narrow([words[i] for i in some], high), strict=True):
                    out[i] = ids
        for i, word in enumerate(words):
            if len(word) > _WIDE:
                out[i] = array("I", self._merge_wide(word)).tobytes()
        return out

    def _merge_narrow(self, words: list[bytes], width: int) -> list[bytes]:
        """All words in step: each round merges the best pair of every word that has one."""
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        length = np.array([len(w) for w in words])
        ids = np.where(np.arange(width) < length[:, None], self.byte_ids[raw], -1)
        ids = np.concatenate([ids, np.full((len(ids), 1), -1)], axis=1)
        rank = self.rank(ids[:, :-1], ids[:, 1:])
        done = ids.copy()
        index = np.arange(len(words))
        columns = np.arange(width + 1)
        while len(index):
            best = rank.argmin(axis=1)
            row = np.arange(len(index))
            value = rank[row, best]
            open_ = value < _NONE
            done[index[~open_]] = ids[~open_]
            index, ids, rank, best, value = index[open_], ids[open_], rank[open_], best[open_], value[open_]
            if not len(index):
                break
            row = np.arange(len(index))
            ids[row, best] = self.merged[value]
            shifted = columns + (columns > best[:, None])
            ids = np.take_along_axis(np.concatenate([ids, np.full((len(ids), 1), -1)], axis=1), shifted, axis=1)
            shifted = columns[:-1] + (columns[:-1] > best[:, None])
            rank = np.take_along_axis(np.concatenate([rank, np.full((len(rank), 1), _NONE, rank.dtype)], axis=1), shifted, axis=1)
            rank[row, best] = self.rank(ids[row, best], ids[row, best + 1])
            before = np.maximum(best - 1, 0)
            rank[row, before] = self.rank(ids[row, before], ids[row, before + 1])
        real = done >= 0
        data, ends = done[real].astype(np.uint32).tobytes(), (4 * np.cumsum(real.sum(axis=1))).tolist()
        return [data[a:b] for a, b in itertools.pairwise([0, *ends])]

    @functools.cached_property
    def _pairs(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))

    def _merge_wide(self, word: bytes) -> list[int]:
        """One word of any length, by a queue of pairs over a linked list."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        after = [*range(1, len(ids)), -1]
        before = list(range(-1, len(ids) - 1))
        queue: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (rank := self._pairs.get(ids[i] << 32 | ids[j])) is not None:
                heapq.heappush(queue, (rank, i, ids[i], ids[j]))

        for i in range(len(ids)):
            offer(i)
        while queue:
            rank, i, left, right = heapq.heappop(queue)
            j = after[i] if ids[i] == left else -1
            if j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = int(self.merged[rank]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [i for i in ids if i >= 0]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Memory:
    """Ids (unsigned, 32 bits each) of what was met last, in two generations: when the younger is full it becomes the older one, so what recurs is not forgotten."""

    def __init__(self, size: int):
        self.size = size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, keys: list[str]) -> list[str]:
        """Which of the distinct keys are not known; the others are in the younger generation then."""
        wanted = [k for k in keys if k not in self.young]
        if len(self.young) + len(wanted) > self.size:
            self.old, self.young = self.young, {}
            wanted = keys
        if not self.old:
            return wanted
        known = {k: self.old[k] for k in wanted if k in self.old}
        self.young |= known
        return [k for k in wanted if k not in known]


class Coder:
    """Ids and decoded bytes of units: remembered, or put together from words that are remembered, in the lexicon, or merged."""

    def __init__(self, path: str, lexicon: str | None):
        self.vocabulary = vocabulary(path)
        self.lexicon = Lexicon(lexicon) if lexicon else None
        self.units, self.words = Memory(REMEMBERED), Memory(REMEMBERED * 3 // 5)
        ids = range(max(self.vocabulary.bytes_of) + 1)
        self.texts = pa.array([f"{i}," for i in ids], pa.large_string())
        self.pieces = pa.array([self.vocabulary.bytes_of.get(i, b"") for i in ids], pa.large_binary())

    def _learn_words(self, words: list[str]) -> None:
        fresh, special, known = self.words.missing(words), self.vocabulary.special, self.words.young
        for word in fresh:
            if word in special:
                known[word] = array("I", [special[word]]).tobytes()
        fresh = [w for w in fresh if w not in special]
        raw = [w.encode() for w in fresh]
        unseen = list(range(len(fresh)))
        if self.lexicon is not None:
            ranks = self.lexicon.ranks(raw)
            for i in np.flatnonzero(ranks >= 0).tolist():
                known[fresh[i]] = array("I", self.lexicon.tokens(int(ranks[i]))).tobytes()
            unseen = np.flatnonzero(ranks < 0).tolist()
        for i, ids in zip(unseen, self.vocabulary.merged_bytes([raw[i] for i in unseen]), strict=True):
            known[fresh[i]] = ids

    def learn(self, units: list[str]) -> list[bytes]:
        """The ids of distinct units."""
        fresh = self.units.missing(units)
        split = [self.vocabulary.pre_tokens(u) for u in fresh]
        self._learn_words(list({w for tokens in split for w in tokens}))
        known, words = self.units.young, self.words.young
        for unit, tokens in zip(fresh, split, strict=True):
            known[unit] = words[tokens[0]] if len(tokens) == 1 else b"".join([words[w] for w in tokens])
        return list(map(known.__getitem__, units))

    def encode(self, texts: pa.Array) -> tuple[list[bytes], np.ndarray, list[bytes]]:
        """Of each text: its ids joined by commas, their number, and the bytes decoded from them."""
        code, ends, distinct = numbered_units(texts)
        found = self.learn(distinct.to_pylist())
        start = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)])
        counts = np.diff(start)[code]
        after = np.concatenate([[0], np.cumsum(counts)])
        ids = np.frombuffer(b"".join(found), np.uint32)[np.arange(after[-1]) + np.repeat(start[code] - after[:-1], counts)]
        bounds = after[ends]
        return [x[:-1] for x in _joined(self.texts, ids, bounds)], np.diff(bounds, prepend=0), _joined(self.pieces, ids, bounds)


def _joined(values: pa.Array, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The values of the ids, put together for each text."""
    taken = values.take(pa.array(ids))
    _, offsets, data = taken.buffers()
    if data is None or not len(taken):
        return [b""] * len(ends)
    at = np.frombuffer(offsets, np.int64)[np.concatenate([[0], ends])].tolist()
    view = memoryview(data)
    return [bytes(view[a:b]) for a, b in itertools.pairwise(at)]


@functools.lru_cache(maxsize=1)
def _coder(path: str, lexicon: str | None) -> Coder:
    return Coder(path, lexicon)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def frequent_words(docs: DataFrame, path: str, size: int) -> list[str]:
    """The pre-tokens of the ``size`` most frequent units of all texts; of units equally frequent, those with the larger hash.

    All units are counted; tasks send each once for every :data:`COUNTED` distinct ones. The counts stay below the shared folder: the
    least count that belongs to the ``size`` largest is found by a histogram, so only that many units come to the driver (and those
    whose count and 32-bit hash are equal to the last). No texts, or a ``size`` of 0, give none.
    """

    def batch_of(counts: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["unit", "n"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for batch in batches:
            for a, b in text_runs(batch.column("text"), RUN_BYTES):
                code, _, distinct = numbered_units(batch.column("text").slice(a, b - a))
                for unit, n in zip(distinct.to_pylist(), np.bincount(code, minlength=len(distinct)).tolist(), strict=True):
                    counts[unit] = counts.get(unit, 0) + n
                if len(counts) > COUNTED:
                    yield batch_of(counts)
                    counts = {}
        if counts:
            yield batch_of(counts)

    if size < 1:
        return []
    counted = _texts(docs).mapInArrow(count, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    key = F.shiftleft(F.least("n", F.lit((1 << 31) - 1)), 32) + F.col("h")
    folder = f"{shared_dir(docs.sparkSession)}/bpe-units-{uuid.uuid4().hex}"
    counted.withColumn("h", F.hash("unit").cast("long") + F.lit(1 << 31)).select("unit", key.alias("key")).write.parquet(folder)
    stored = docs.sparkSession.read.schema("unit string, key long").parquet(folder)
    cut = kth_largest(stored.select("key"), size)
    units = [r.unit for r in (stored if cut is None else stored.filter(F.col("key") >= F.lit(cut))).collect()]  # about ``size``
    return sorted({w for u in units for w in vocabulary(path).pre_tokens(u)})


def share_lexicon(docs: DataFrame, path: str, words: list[str]) -> str:
    """Compile the words, write them below the shared folder, and let Spark bring the file to every executor; returns its name."""
    spark = docs.sparkSession
    vocab = vocabulary(path)
    words = [w for w in words if w not in vocab.special]
    raw = [w.encode() for w in words]
    data = build(dict(zip(raw, vocab.merge(raw), strict=True)))
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(place.toString())
    return name


def encode_documents(docs: DataFrame, path: str, lexicon_words: int = 65_536, digests: bool = False) -> DataFrame:
    """Ids of every whole text under the tokenizer file ``path`` (on every executor), and the text decoded from them.

    One row per input row: ``doc_id``, ``n_tokens``, ``ids`` (decimal, joined by commas) and ``decoded``; with ``digests`` the SHA-256 of
    the two in hexadecimal instead, ``ids_sha256`` and ``decoded_sha256``. Special strings in a text become their tokens, as by
    default in the library; none are added. A null text counts as empty, with no ids. Repeated rows and rows without ``doc_id`` are
    coded like any other; other columns are ignored.
    """
    name = share_lexicon(docs, path, frequent_words(docs, path, lexicon_words))
    columns = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, SparkFiles.get(name))
        for batch in batches:
            for a, b in text_runs(batch.column("text"), RUN_BYTES):
                ids, counts, raw = coder.encode(batch.column("text").slice(a, b - a))
                pair = [[x.decode() for x in ids], [x.decode("utf-8", "replace") for x in raw]]
                if digests:
                    pair = [[hashlib.sha256(x.encode()).hexdigest() for x in column] for column in pair]
                arrays = [batch.column("doc_id").slice(a, b - a), pa.array(counts, pa.int64()), *(pa.array(c, pa.string()) for c in pair)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", *columns])

    return _texts(docs).mapInArrow(run, f"doc_id long, n_tokens long, {columns[0]} string, {columns[1]} string")
