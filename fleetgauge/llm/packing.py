"""Documents packed into training sequences of a fixed length, by minimum bin slack.

Documents longer than a sequence fill whole sequences; what is left of each waits in a pool, counted by length. A window takes the
longest remaining length, and a subset-sum dynamic programme over the other lengths (one bit per reachable sum, the copies of a length
added by doubling) finds the multiset that fills it closest to capacity; the copies of each length are read off backwards, and the
same multiset is used again as long as the counts allow. Where no multiset fills the window, the longest piece left is cut to fit, and
what remains at the very end is cut at powers of two, which need no padding.

A task packs the documents of its own partition as it reads them. It holds at most ``pool_tokens`` tokens and a run of texts, moves
nothing, and after a lost executor does the same again, so sequences are numbered by partition and place.
"""

from __future__ import annotations

import functools
import json
import os
import re
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.bpe import byte_letters
from fleetgauge.llm.words import numbered_words, text_runs

#: Words whose ids a worker remembers, and their characters.
REMEMBERED = 1_000_000
REMEMBERED_BYTES = 64 << 20
#: The normalizer, the pre-tokenizer and the mark of a word's end that the shorter way of :class:`WordIds` stands for.
KNOWN_STEPS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "</w>",
)
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Letters and punctuation but for the apostrophe, which may begin a part of its own.
_PLAIN = re.compile(rf"[{_LETTERS}!-&(-/:-@\[-`{{-~]+")
_PARTS = re.compile(rf"[{_LETTERS}]+|[^{_LETTERS}]+")
#: A sequence's number is its task's partition times this, plus its place.
_PER_PARTITION = 1 << 36

Piece = tuple[int, int, int]  # document, start, length


class _Store:
    """Ids of numbered keys, one key's after the other's."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1, np.int64)

    def add(self, keys: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        used = int(self.start[-1])
        if used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(used + len(ids), np.uint32)])
        self.ids[used : used + len(ids)] = ids
        self.start = np.concatenate([self.start, used + np.cumsum(counts)])
        self.number.update(zip(keys, range(len(self.number), len(self.number) + len(keys)), strict=True))

    def numbers(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, keys), np.int64, len(keys))

    def read(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of keys, and the place before each key's and after the last's."""
        first = self.start[number]
        counts = self.start[number + 1] - first
        after = np.concatenate([[0], np.cumsum(counts)])
        return self.ids[np.arange(after[-1]) + np.repeat(first - after[:-1], counts)], after


class WordIds:
    """Token ids of texts under a tokenizer for which white space always ends a word.

    The normalizer of such a file works within words and its pre-tokenizer drops white space, so a word has the same ids wherever it
    stands; each distinct word is encoded once, and remembered. Where the file has the steps of :data:`KNOWN_STEPS`, words of Latin-1
    letters and ASCII punctuation are put in lower case and cut here, and only their distinct parts go to the library's model; the
    library encodes all other words whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = re.compile("|".join([re.escape(t["content"]) for t in spec["added_tokens"]]) or "(?!)")
        self.ends_word = None
        if (spec["normalizer"], spec["pre_tokenizer"], spec["model"]["end_of_word_suffix"]) == KNOWN_STEPS:
            vocabulary = self.library.get_vocab()
            self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends_word[[i for token, i in vocabulary.items() if token.endswith(KNOWN_STEPS[2])]] = True
            self.model = tokenizers.Tokenizer(self.library.model)
            self.model.pre_tokenizer = tokenizers.pre_tokenizers.WhitespaceSplit()
            self.letters = {byte: letter for letter, byte in byte_letters().items() if byte != 0x20}
        self._forget()

    def _forget(self) -> None:
        self.words, self.parts = _Store(), _Store()
        self.bytes = 0

    def _learn(self, words: list[str]) -> None:
        if not words:
            return
        self.bytes += sum(map(len, words))
        matches, special = _PLAIN.fullmatch, self.special.search
        plain = [w for w in words if matches(w) and not special(w)] if self.ends_word is not None else []
        if len(plain) < len(words):
            known = set(plain)
            other = [w for w in words if w not in known]
            found = [e.ids for e in self.library.encode_batch_fast(other, add_special_tokens=False)]
            self.words.add(other, np.fromiter((i for ids in found for i in ids), np.uint32), np.fromiter(map(len, found), np.int64, len(found)))
        if not plain:
            return
        cut = list(map(_PARTS.findall, "\n".join(plain).lower().split("\n")))
        flat = [p for parts in cut for p in parts]
        self._learn_parts([p for p in dict.fromkeys(flat) if p not in self.parts.number])
        ids, after = self.parts.read(self.parts.numbers(flat))
        ends = after[np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))]
        self.words.add(plain, ids, np.diff(ends, prepend=0))

    def _learn_parts(self, parts: list[str]) -> None:
        """Encode letters or punctuation, a few thousand at a time: every part ends with the one token that may end a word."""
        for i in range(0, len(parts), 4096):
            some = parts[i : i + 4096]
            line = " ".join(some)
            if not line.isascii():
                line = line.encode().decode("latin-1").translate(self.letters)
            ids = np.array(self.model.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.uint32)
            self.parts.add(some, ids, np.diff(np.flatnonzero(self.ends_word[ids]) + 1, prepend=0))

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text ends; ``end_id`` follows every text."""
        code, ends, distinct = numbered_words(texts)
        words = distinct.to_pylist()
        if len(self.words.number) > REMEMBERED or self.bytes > REMEMBERED_BYTES:
            self._forget()
        self._learn([w for w in words if w not in self.words.number])
        ids, after = self.words.read(self.words.numbers(words)[code])
        bounds = after[ends]
        if end_id is not None:
            ids = np.insert(ids, bounds, np.uint32(end_id))
            bounds = bounds + np.arange(1, len(bounds) + 1)
        return ids, bounds


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


class Pool:
    """Pieces that wait for a sequence, by length."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.lengths: list[int] = []  # ascending
        self.pieces: dict[int, list[Piece]] = {}
        self.tokens = 0

    def add(self, piece: Piece) -> None:
        length = piece[2]
        if length not in self.pieces:
            insort(self.lengths, length)
            self.pieces[length] = []
        self.pieces[length].append(piece)
        self.tokens += length

    def take(self, length: int) -> Piece:
        waiting = self.pieces[length]
        piece = waiting.pop()
        if not waiting:
            del self.pieces[length]
            self.lengths.remove(length)
        self.tokens -= length
        return piece

    def fill(self, target: int, used: int = 0) -> dict[int, int]:
        """The copies of each length whose sum is the largest not above ``target``; one piece of length ``used`` is spoken for."""
        goal, mask, reach = 1 << target, (2 << target) - 1, 1
        steps = []
        for i in range(bisect_right(self.lengths, target) - 1, -1, -1):
            length = self.lengths[i]
            copies = min(len(self.pieces[length]) - (length == used), target // length)
            steps.append((length, reach))
            step = 1
            while copies > 0:
                n = min(step, copies)
                reach |= (reach << n * length) & mask
                copies, step = copies - n, 2 * step
            if reach & goal:
                break
        at, out = reach.bit_length() - 1, {}
        for length, before in reversed(steps):
            n = 0
            while not before >> at & 1:
                at, n = at - length, n + 1
            if n:
                out[length] = n
        return out

    def windows(self, keep: int = 0) -> Iterator[list[Piece]]:
        """Full windows until at most ``keep`` tokens wait; with 0, everything goes, the last of it in windows of powers of two."""
        while self.tokens > keep:
            longest = self.lengths[-1]
            copies = self.fill(self.capacity - longest, longest)
            slack = self.capacity - longest - sum(length * n for length, n in copies.items())
            copies[longest] = copies.get(longest, 0) + 1
            if not slack:
                for _ in range(min(len(self.pieces[length]) // n for length, n in copies.items())):
                    yield [self.take(length) for length, n in copies.items() for _ in range(n)]
                continue
            window = [self.take(length) for length, n in copies.items() for _ in range(n)]
            if self.tokens:
                # All that is left is longer than the slack, else it would have been taken.
                row, start, length = self.take(self.lengths[-1])
                self.add((row, start + slack, length - slack))
                yield [*window, (row, start, slack)]
            else:
                yield from _powers_of_two(window, self.capacity - slack)


def _powers_of_two(pieces: list[Piece], tokens: int) -> Iterator[list[Piece]]:
    """The pieces, cut where a window of each power of two in ``tokens`` is full."""
    rest = list(reversed(pieces))
    for bit in range(tokens.bit_length() - 1, -1, -1):
        size = tokens & 1 << bit
        window = []
        while size:
            row, start, length = rest.pop()
            if length > size:
                rest.append((row, start + size, length - size))
                length = size
            window.append((row, start, length))
            size -= length
        if window:
            yield window


COLUMNS = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Packs the documents of one partition; gives batches of placed pieces."""

    def __init__(self, capacity: int, pool_tokens: int, partition: int, batch_tokens: int = 1 << 20):
        self.pool = Pool(capacity)
        self.capacity, self.pool_tokens, self.batch_tokens = capacity, pool_tokens, batch_tokens
        self.sequence = partition * _PER_PARTITION
        self.documents: dict[int, tuple[int | None, int, int, np.ndarray]] = {}  # id, tokens, first token held, tokens held
        self.rows = 0
        self.placed: list[tuple] = []
        self.waiting_tokens = 0

    def _place(self, window: list[Piece]) -> None:
        offset = 0
        for row, start, length in window:
            doc_id, tokens, first, held = self.documents[row]
            self.placed.append((doc_id, start, length, held[start - first : start - first + length], tokens, self.sequence, offset))
            offset += length
            # A piece in the pool always reaches its document's end, so the document is done when its last token is placed.
            if start + length == tokens:
                del self.documents[row]
        self.sequence += 1
        self.waiting_tokens += offset

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        row, tokens = self.rows, len(ids)
        self.rows += 1
        whole = tokens - tokens % self.capacity
        self.documents[row] = doc_id, tokens, 0, ids
        for start in range(0, whole, self.capacity):
            self._place([(row, start, self.capacity)])
            yield from self._flush(self.batch_tokens)
        if whole < tokens:
            self.documents[row] = doc_id, tokens, whole, ids[whole:].copy()
            self.pool.add((row, whole, tokens - whole))
        if self.pool.tokens > self.pool_tokens:
            yield from self._pack(self.pool_tokens // 2)

    def _pack(self, keep: int) -> Iterator[pa.RecordBatch]:
        for window in self.pool.windows(keep):
            self._place(window)
            yield from self._flush(self.batch_tokens)

    def close(self) -> Iterator[pa.RecordBatch]:
        yield from self._pack(0)
        yield from self._flush(0)

    def _flush(self, limit: int) -> Iterator[pa.RecordBatch]:
        if self.waiting_tokens <= limit:
            return
        doc_id, start, length, ids, tokens, sequence, offset = zip(*self.placed, strict=True)
        ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int64) * 4
        data = np.concatenate(ids).astype("<u4", copy=False)
        binary = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(data)]).cast(pa.binary())
        longs = [pa.array(x, pa.int64()) for x in (doc_id, start, length, tokens, sequence, offset)]
        yield pa.RecordBatch.from_arrays([*longs[:3], binary, *longs[3:]], names=[c.split()[0] for c in COLUMNS.split(", ")])
        self.placed, self.waiting_tokens = [], 0


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, pool_tokens: int = 1 << 21) -> DataFrame:
    """Pieces of documents, placed in sequences of at most ``capacity`` tokens (a power of two).

    ``doc_id``, ``start`` (the document's ids before the piece), ``length``, ``ids`` (unsigned 32-bit, little-endian), ``doc_tokens``
    (of the whole document, with its end id), ``sequence_id`` and ``offset`` (of the piece in its sequence, without gaps from 0). A
    document is its token ids under the ``tokenizers`` file ``path`` (on every executor; see :class:`WordIds`), without added ones, and
    then ``end_id``. Every id is in exactly one piece. Every sequence is full or as long as a power of two, so none needs padding;
    sequences that are not full occur only at the end of a partition, at most one of each power of two.

    A null or empty text is its end id alone. Repeated rows and rows without ``doc_id`` are documents like any other; other columns are
    ignored. No documents give no rows. Sequence numbers have gaps between partitions.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the length of a sequence has to be a power of two")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer = word_ids(path), Packer(capacity, pool_tokens, TaskContext.get().partitionId())
        for batch in batches:
            texts, doc_ids = batch.column("text"), batch.column("doc_id").to_pylist()
            for a, b in text_runs(texts):
                ids, ends = tokens.encode(texts.slice(a, b - a), end_id)
                for doc_id, start, end in zip(doc_ids[a:b], [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    yield from packer.add(doc_id, ids[start:end])
        yield from packer.close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, COLUMNS)
