"""Substring dedup: remove the later copies of long passages.

Difference-cover anchors. A window is ``window`` consecutive words. Two equal windows anywhere in the corpus have, whatever their
alignment, a common offset at which both positions lie in a difference cover modulo ``period``, so hashing runs of
``window - period + 1`` words at cover positions alone (three of seven) finds every candidate. Around anchors that occur in two
documents the match is extended: the full windows that hold such an anchor are hashed, and each distinct window learns whether a
document with a smaller id has it.

Windows compare by 64-bit hashes within buckets of a bounded number of windows; a false match has a chance below 1e-13 per window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetgauge.llm import slices as S
from fleetgauge.llm.hashing import prefix, runs, words

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
ANCHOR_BYTES = 5


class _Words:
    """The words of a slice with the smallest document id per distinct hash."""

    def __init__(self, table: pa.Table):
        self.texts = S.Texts(table)
        self.begin, self.stop, hashes = words(self.texts.buffer, self.texts.ends)
        self.ends = np.searchsorted(self.begin, self.texts.ends).astype(np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.sums = prefix(hashes)
        known = np.array([i is not None for i in self.texts.ids], bool)
        length = self.ends - self.starts
        #: Unknown ids come last in a slice; their words are neither compared nor removed.
        self.known = int(length[known].sum())
        self.doc = np.repeat(np.array([i or 0 for i in self.texts.ids], np.int64), length)

    def distinct(self, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes of runs at positions, where each position's hash is, and the smallest and largest document with it."""
        keys, inverse = np.unique(runs(self.sums, at, at + width), return_inverse=True)
        low = np.full(len(keys), np.iinfo(np.int64).max)
        high = np.full(len(keys), np.iinfo(np.int64).min)
        np.minimum.at(low, inverse, self.doc[at])
        np.maximum.at(high, inverse, self.doc[at])
        return keys, inverse, low, high


def _smaller_elsewhere(keys: np.ndarray, own: np.ndarray, _owner: np.ndarray) -> np.ndarray:
    """Whether any slice reports a smaller document for the same key."""
    order = np.lexsort((own, keys))
    ranked = keys[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    least = own[order][np.flatnonzero(first)][np.cumsum(first) - 1]
    out = np.zeros(len(keys), bool)
    out[order] = least < own[order]
    return out


def remove_repeated_passages(docs: DataFrame, window: int = 13, period: int = 7, slice_bytes: int = 4 << 20, bucket_bytes: int = 4 << 20) -> DataFrame:
    """Documents without the words of any window that a document with a smaller id has, too.

    Words are runs of characters other than space and the controls tab to carriage return. Windows are judged on the input. One row
    per input row: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` and ``kept_text`` (the kept words joined by a space).

    A null or empty text has no words. A row without ``doc_id`` is kept whole and takes nothing from others. Repeated rows of one
    id do not affect each other. Other columns of the input are ignored. No documents give no rows.
    """
    if not 1 <= period <= window:
        raise ValueError("the period has to be between 1 and the window")
    cover, anchor = S.difference_cover(period), window - period + 1
    dealt = S.slice_documents(docs, slice_bytes, bucket_bytes)
    bits = dealt.bits

    def anchors(w: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at = S.cover_positions(w.starts, w.ends, cover, period, anchor)
        at = at[at < w.known]
        keys, inverse, low, high = w.distinct(at, anchor)
        return at, keys, inverse, low < high

    def ask_anchors(table: pa.Table) -> pa.Table:
        w = _Words(table)
        return S.question(w.texts.slice, anchors(w)[1], bits, ANCHOR_BYTES)

    def ask_windows(table: pa.Table, replies: pa.Table) -> pa.Table:
        w = _Words(table)
        at, keys, inverse, in_slice = anchors(w)
        shared = S.read_reply(replies, keys, bits) | in_slice
        marks = np.zeros(len(w.doc), bool)
        marks[at[shared[inverse]]] = True
        extended = S.windows_with_anchor(marks, w.starts, w.ends, period, window)
        keys, _, low, _ = w.distinct(np.flatnonzero(extended), window)
        return S.question(w.texts.slice, keys, bits, 8, low, S.flags_to_note(extended))

    def cut(table: pa.Table, replies: pa.Table) -> pa.Table:
        w = _Words(table)
        n = len(w.doc)
        at = np.flatnonzero(S.note_to_flags(S.read_note(replies), n))
        keys, inverse, low, _ = w.distinct(at, window)
        later = S.read_reply(replies, keys, bits)[inverse] | (low[inverse] < w.doc[at])
        marks = np.zeros(n, bool)
        marks[at[later]] = True
        gone = S.covered(marks, window, n)
        rows = {"doc_id": [], "n_words": [], "n_removed": [], "kept_sha256": [], "kept_text": []}
        for i, doc_id in enumerate(w.texts.ids):
            a, b = w.starts[i], w.ends[i]
            all_words = w.texts.document(i).split()
            kept = all_words if not gone[a:b].any() else [all_words[k] for k in np.flatnonzero(~gone[a:b])]
            text = b" ".join(kept)
            for name, value in zip(rows, (doc_id, int(b - a), int(b - a) - len(kept), hashlib.sha256(text).hexdigest(), text.decode()), strict=True):
                rows[name].append(value)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.table({name: pa.array(values, t) for (name, values), t in zip(rows.items(), types, strict=True)})

    by_slice = dealt.frame.groupBy("slice")
    shared = S.answers(by_slice.applyInArrow(ask_anchors, S.SENT), bits, S.in_two_places)
    asked = by_slice.cogroup(shared.groupBy("slice")).applyInArrow(ask_windows, S.SENT)
    later = S.answers(asked, bits, _smaller_elsewhere)
    return by_slice.cogroup(later.groupBy("slice")).applyInArrow(cut, RESULT)
