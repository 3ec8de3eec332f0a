"""Suffix dedup: remove every byte string of a given length that occurs more than once.

Difference-cover blockwise construction. Suffixes at the positions of a difference cover modulo ``period`` (about a tenth of all)
are the sample; a sample suffix is ranked by its first ``window - period + 1`` bytes. Two suffixes that agree on ``window`` bytes
have a cover position at a common offset below ``period``, where their samples tie, so only suffixes above tied samples need to be
ordered at all. These are dealt into blocks, and each block is sorted on its own, its size bounded by the number of blocks; what a
suffix needs to be compared over its whole length is one 64-bit rank of its first ``window`` bytes. A run of equal ranks in a
sorted block is a repeated string.

Of equal documents only one deals out its suffixes. Only equality of prefixes matters to the result, so blocks are cut by rank, not by leading bytes: natural text would put a third of
all suffixes behind a few leading bytes. Ranks are 64-bit hashes, sums modulo a prime, which regular texts do not cancel; a suffix's
chance of a false tie is the number of distinct suffixes asked about in 2**64. Whole documents are compared by BLAKE2b of 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetgauge.llm import slices as S
from fleetgauge.llm.hashing import ByteRuns

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<begin:long,end:long>>"
SAMPLE_BYTES = 5
_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _ranked(runs: ByteRuns, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ranks, each position's place among them, and whether a rank occurs twice in the slice."""
    keys, inverse, count = np.unique(runs.hashes(at, at + width), return_inverse=True, return_counts=True)
    return keys, inverse, count > 1


def remove_repeated_strings(docs: DataFrame, window: int = 400, period: int = 181, slice_bytes: int = 2 << 20, bucket_bytes: int = 8 << 20) -> DataFrame:
    """Documents without the bytes of any ``window``-byte string that starts at two places of the corpus.

    Texts are read as UTF-8; matches stay inside a document, may overlap, and may be in one and the same document. Strings are judged
    on the input. One row per input row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256``,
    ``kept`` (the remaining bytes) and ``spans`` (the removed runs, end exclusive).

    A null or empty text has no bytes. Rows without ``doc_id`` and repeated rows count as documents of their own, so repeated rows
    remove each other. Other columns are ignored. No documents give no rows.
    """
    if not 1 <= period <= window:
        raise ValueError("the period has to be between 1 and the window")
    cover, sample = S.difference_cover(period), window - period + 1
    dealt = S.slice_documents(docs, slice_bytes, bucket_bytes)
    bits = dealt.bits

    def whole(t: S.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Documents long enough to hold a window, their distinct digests, each one's place there, and how often each occurs."""
        long = np.flatnonzero(t.ends - t.starts >= window)
        digests = b"".join(hashlib.blake2b(t.buffer[t.starts[i] : t.ends[i]], digest_size=8).digest() for i in long)
        return long, *np.unique(np.frombuffer(digests, np.uint64), return_inverse=True, return_counts=True)

    def samples(t: S.Texts, runs: ByteRuns) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at = S.cover_positions(t.starts, t.ends, cover, period, sample)
        return at, *_ranked(runs, at, sample)

    def ask_samples(table: pa.Table) -> pa.Table:
        t = S.Texts(table)
        runs = ByteRuns(t.buffer)
        asked = S.question(t.slice, samples(t, runs)[1], bits, SAMPLE_BYTES)
        return pa.concat_tables([asked, S.question(t.slice, whole(t)[1], bits, 8, kind=1)])

    def ask_suffixes(table: pa.Table, replies: pa.Table) -> pa.Table:
        t = S.Texts(table)
        runs = ByteRuns(t.buffer)
        at, keys, inverse, in_slice = samples(t, runs)
        tied = S.read_reply(replies, keys, bits) | in_slice
        marks = np.zeros(len(t.buffer), bool)
        marks[at[tied[inverse]]] = True
        open_ = S.windows_with_anchor(marks, t.starts, t.ends, period, window)
        # Of equal texts only the first sends its suffixes: the others are removed whole, and say nothing the first doesn't.
        long, keys, inverse, count = whole(t)
        found = S.read_reply(replies, keys, bits, np.int64, kind=1)
        copied, first = np.zeros(len(t.ids), bool), np.ones(len(t.ids), bool)
        copied[long] = ((found > 0) | (count > 1))[inverse]
        first[long] = False
        first[long[np.unique(inverse, return_index=True)[1][found < 2]]] = True
        open_ &= np.repeat(first, t.ends - t.starts)
        keys = _ranked(runs, np.flatnonzero(open_), window)[0]
        return S.question(t.slice, keys, bits, 8, note=S.flags_to_note(np.concatenate([open_, copied])))

    def cut(table: pa.Table, replies: pa.Table) -> pa.Table:
        t = S.Texts(table)
        n = len(t.buffer)
        runs = ByteRuns(t.buffer)
        flags = S.note_to_flags(S.read_note(replies), n + len(t.ids))
        at, copied = np.flatnonzero(flags[:n]), flags[n:]
        keys, inverse, in_slice = _ranked(runs, at, window)
        repeated = S.read_reply(replies, keys, bits) | in_slice
        marks = np.zeros(n, bool)
        marks[at[repeated[inverse]]] = True
        gone = S.covered(marks, window, n) | np.repeat(copied, t.ends - t.starts)
        columns: list[list] = [[] for _ in range(7)]
        for i, doc_id in enumerate(t.ids):
            a, b = t.starts[i], t.ends[i]
            cut_here = gone[a:b]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], cut_here, [False]]).astype(np.int8)))
            kept = t.buffer[a:b][~cut_here].tobytes() if len(edges) else t.document(i)
            spans = [{"begin": int(x), "end": int(y)} for x, y in zip(edges[::2], edges[1::2], strict=True)]
            row = (doc_id, int(b - a), int(b - a) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept, spans)
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), _SPANS)
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans")
        return pa.table({k: pa.array(c, ty) for k, c, ty in zip(names, columns, types, strict=True)})

    by_slice = dealt.frame.groupBy("slice")
    tied = S.answers(by_slice.applyInArrow(ask_samples, S.SENT), bits, S.in_two_places, S.copies_elsewhere)
    asked = by_slice.cogroup(tied.groupBy("slice")).applyInArrow(ask_suffixes, S.SENT)
    repeated = S.answers(asked, bits, S.in_two_places)
    return by_slice.cogroup(repeated.groupBy("slice")).applyInArrow(cut, RESULT)
