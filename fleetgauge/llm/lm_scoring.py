"""Stupid-backoff language-model scores of all documents under the n-gram counts of the whole corpus.

The counts of all orders are made in buckets of the n-grams' hashes (:mod:`slices`), which are count tables partitioned by hash. A
slice of documents explodes its texts into n-grams, sends each distinct one with its own count, and is joined with the corpus counts
that come back, from which every token is scored and the scores are summed per document. All orders are asked in one round, so the
counts travel once in either direction. (As rows of a table, one per document and n-gram, the same join moves more than the corpus
many times over; README has the figures.)

An n-gram that occurs fewer than ``min_count`` times counts as unseen, an option for pruned models. With a ``min_count`` of 1, as in
the registered query, every n-gram counts, and a document's own are then all seen. With ``others_only`` a document is scored by the
counts of the other documents, its own occurrences taken away; unseen n-grams then back off.

With c the counts, the score of a word is c(context word) / c(context) where the n-gram is seen, and ``backoff`` times the score
with the context shortened by its first word where it is not; a single word scores c(word) / N, N being the words counted. A word
that is nowhere else scores ``backoff`` / N instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetgauge.llm import slices as S
from fleetgauge.llm.hashing import prefix, runs, words

RESULT = "doc_id long, n_words long, log10_score double, mean_log10 double"
KEY_BYTES = 6
#: Asked by every slice with its number of words, so that the answer is the number of words of the corpus.
ALL_WORDS = 0


def _total(keys: np.ndarray, own: np.ndarray, _owner: np.ndarray) -> np.ndarray:
    """The count of each key over all slices."""
    order = np.argsort(keys)
    ranked = keys[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    sums = np.add.reduceat(own[order], np.flatnonzero(first))
    out = np.zeros(len(keys), np.int64)
    out[order] = sums[np.cumsum(first) - 1]
    return out


class _Tokens:
    """The words of a slice, the n-grams it asks about, and their counts."""

    def __init__(self, table: pa.Table, order: int):
        self.texts, self.order = S.Texts(table), order
        begin, _, hashes = words(self.texts.buffer, self.texts.ends)
        self.n = len(hashes)
        self.ends = np.searchsorted(begin, self.texts.ends).astype(np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.sums = prefix(hashes)
        self.length = self.ends - self.starts
        self.room = np.repeat(self.ends, self.length) - np.arange(self.n)
        self.doc = np.repeat(np.arange(len(self.length)), self.length)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Order ``n``: starts of the n-grams, their distinct hashes, each start's place there, counts in the slice."""
        at = np.flatnonzero(self.room >= n)
        keys, inverse, count = np.unique(runs(self.sums, at, at + n), return_inverse=True, return_counts=True)
        return at, keys, inverse, count.astype(np.int64)

    def questions(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        _, keys, _, count = self.grams(n)
        if n > 1:
            return keys, count
        return np.concatenate([[np.uint64(ALL_WORDS)], keys]), np.concatenate([[self.n], count])

    def ask(self, bits: int) -> pa.Table:
        return pa.concat_tables([S.question(self.texts.slice, *self._sent(n, bits), kind=n - 1) for n in range(1, self.order + 1)])

    def _sent(self, n: int, bits: int) -> tuple[np.ndarray, int, int, np.ndarray]:
        keys, count = self.questions(n)
        return keys, bits, KEY_BYTES, count

    def counts(self, replies: pa.Table, bits: int, n: int, others_only: bool) -> np.ndarray:
        """The count of the n-gram at each start, 0 where none fits. Order 1 also notes the words counted for each token."""
        at, keys, inverse, _ = self.grams(n)
        answer = S.read_reply(replies, self.questions(n)[0], bits, np.int64, kind=n - 1)
        if n == 1:
            self.total, answer = np.full(self.n, answer[0]), answer[1:]
        found = answer[inverse]
        if others_only:
            # Occurrences in a token's own document.
            _, own, times = np.unique(self.doc[at] * max(1, len(keys)) + inverse, return_inverse=True, return_counts=True)
            found = found - times[own]
            if n == 1:
                self.total = self.total - self.length[self.doc]
        out = np.zeros(self.n + 1, np.int64)
        out[at] = found
        return out

    def scores(self, replies: pa.Table, bits: int, backoff: float, min_count: int, others_only: bool) -> np.ndarray:
        """Base-10 log score of every word."""
        shorter = self.counts(replies, bits, 1, others_only)
        # A single word below min_count keeps its own count: there is nothing left to back off to.
        single = shorter[: self.n]
        out = np.log10(np.where(single > 0, single, backoff) / np.maximum(1, self.total))
        shorter = np.where(shorter < min_count, 0, shorter)
        position = np.arange(self.n) - np.repeat(self.starts, self.length)
        for n in range(2, self.order + 1):
            longer = self.counts(replies, bits, n, others_only)
            longer[longer < min_count] = 0
            last = np.flatnonzero(position >= n - 1)
            first = last - (n - 1)
            count, context = longer[first], shorter[first]
            ratio = np.log10(np.maximum(count, 1) / np.maximum(context, 1))
            out[last] = np.where(count > 0, ratio, np.log10(backoff) + out[last])
            shorter = longer
        return out


def score_documents(
    docs: DataFrame,
    order: int = 3,
    backoff: float = 0.4,
    min_count: int = 2,
    slice_bytes: int = 4 << 20,
    bucket_bytes: int = 4 << 20,
    others_only: bool = False,
) -> DataFrame:
    """The sum and mean of the base-10 log score of the words of each document.

    Words are runs of characters other than space and the controls tab to carriage return, unchanged; n-grams stay inside a document.
    One row per input row. A null, empty or blank text has no words, the sum 0 and no mean. Rows without ``doc_id`` and repeated rows
    count like any other (as other documents, with ``others_only``). Other columns are ignored. No documents give no rows.
    """
    if order < 1 or min_count < 1:
        raise ValueError("order and min_count have to be at least 1")
    dealt = S.slice_documents(docs, slice_bytes, bucket_bytes)
    bits = dealt.bits

    def ask(table: pa.Table) -> pa.Table:
        return _Tokens(table, order).ask(bits)

    def score(table: pa.Table, replies: pa.Table) -> pa.Table:
        t = _Tokens(table, order)
        total = np.bincount(t.doc, weights=t.scores(replies, bits, backoff, min_count, others_only), minlength=len(t.length))
        return pa.table(
            {
                "doc_id": pa.array(t.texts.ids, pa.int64()),
                "n_words": pa.array(t.length, pa.int64()),
                "log10_score": pa.array(total, pa.float64()),
                "mean_log10": pa.array(total / np.maximum(t.length, 1), pa.float64(), mask=t.length == 0),
            }
        )

    by_slice = dealt.frame.groupBy("slice")
    replies = S.answers(by_slice.applyInArrow(ask, S.SENT), bits, *[_total] * order)
    return by_slice.cogroup(replies.groupBy("slice")).applyInArrow(score, RESULT)
