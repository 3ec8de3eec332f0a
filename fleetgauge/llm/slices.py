"""Questions about hashes anywhere in a corpus, asked and answered without moving the corpus.

The corpus is dealt into slices of a few megabytes by a hash of the row, so a slice holds the same rows however often it is
computed, also after the loss of an executor. A slice *asks*: it sends its distinct hashes, cut into buckets by their leading
bits, as one packed row per bucket. A bucket's task *answers* every slice in the order the slice asked, one bit or one number per
hash. A hash that a third of all documents share is sent once per slice, so no bucket grows with a hot hash; answers return by
slice, and the slice's texts are met by co-grouping on the one exchange that all steps read.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENT = "bucket long, slice long, keys binary, extra binary"
#: Bytes of text for each row between a slice and a bucket, at least: about 30 words.
ROW_BYTES = 200
REPLY = "slice long, bucket long, reply binary"
_SENT_ARROW = pa.schema([("bucket", pa.int64()), ("slice", pa.int64()), ("keys", pa.binary()), ("extra", pa.binary())])
_REPLY_ARROW = pa.schema([("slice", pa.int64()), ("bucket", pa.int64()), ("reply", pa.binary())])


@dataclass(frozen=True)
class Slices:
    """Documents with their slice number and compressed text, and the number of bucket bits that suits their size."""

    frame: DataFrame
    bits: int


def _compressed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = pa.array([zlib.compress(t.as_py().encode(), 1) for t in batch.column("text")], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("slice"), batch.column("doc_id"), packed], names=["slice", "doc_id", "text"])


def slice_documents(docs: DataFrame, slice_bytes: int, bucket_bytes: int) -> Slices:
    """Deal ``doc_id`` and ``text`` (null: empty) into slices of about ``slice_bytes`` of text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    # A slice sends a row to each bucket. Both grow with the square root of a large corpus, so that a row never holds but a few keys.
    slice_bytes, bucket_bytes = (max(n, math.isqrt(ROW_BYTES * total)) for n in (slice_bytes, bucket_bytes))
    count = max(1, -(-total // slice_bytes))
    bits = max(1, (total // bucket_bytes).bit_length())
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    dealt = own.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)).alias("slice"), "doc_id", "text")
    # Texts are compressed before they are shuffled, once for all the steps that read the exchange.
    return Slices(dealt.mapInArrow(_compressed, "slice long, doc_id long, text binary"), bits)


class Texts:
    """The rows of a slice in a fixed order, as one byte buffer."""

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id").to_pylist()
        raw = [zlib.decompress(x.as_buffer()) for x in table.column("text")]
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, raw[i]))
        raw = [raw[i] for i in order]
        self.slice = table.column("slice")[0].as_py() if len(ids) else 0
        self.ids = [ids[i] for i in order]
        self.buffer = np.frombuffer(b"".join(raw), np.uint8)
        length = np.array([len(x) for x in raw], np.int64)
        self.ends = np.cumsum(length)
        self.starts = self.ends - length

    def document(self, i: int) -> bytes:
        return self.buffer[self.starts[i] : self.ends[i]].tobytes()


def pack(keys: np.ndarray, bits: int, width: int) -> bytes:
    """Sorted keys of one bucket, by the ``width`` bytes that follow their leading ``bits``.

    Sent are the steps from key to key, by byte planes; the low planes, where steps are evenly spread, are sent as they are.
    """
    values = (keys << np.uint64(bits)) >> np.uint64(64 - 8 * width)
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    plain = max(0, (int(values[-1]) // len(values)).bit_length() - 2) // 8
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    return struct.pack("<IB", len(values), plain) + planes[:plain].tobytes() + zlib.compress(planes[plain:].tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    n, plain = struct.unpack_from("<IB", data)
    start = 5 + n * plain
    planes = np.frombuffer(data[5:start] + zlib.decompress(data[start:]), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def squeeze(numbers: np.ndarray) -> bytes:
    """Whole numbers, compressed byte plane by byte plane: the high bytes of small numbers are runs of zeros."""
    return zlib.compress(np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 6)


def expand(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket begins in sorted keys, and the end."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int64)


def question(
    slice_id: int, keys: np.ndarray, bits: int, width: int, extra: np.ndarray | None = None, note: bytes | None = None, kind: int = 0
) -> pa.Table:
    """The rows a slice sends: sorted distinct ``keys`` by bucket, a value for each, and a note to itself.

    Questions of different kinds may be sent together; each kind has buckets of its own.
    """
    at = cuts(keys, bits)
    full = np.flatnonzero(at[1:] > at[:-1])
    columns = [
        [(kind << bits) + int(b) for b in full],
        [slice_id] * len(full),
        [pack(keys[at[b] : at[b + 1]], bits, width) for b in full],
        [None if extra is None else squeeze(extra[at[b] : at[b + 1]]) for b in full],
    ]
    if note is not None:
        for column, value in zip(columns, (-1 - slice_id, slice_id, note, None), strict=True):
            column.append(value)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _SENT_ARROW.types, strict=True)], schema=_SENT_ARROW)


Judge = Callable[[np.ndarray, np.ndarray | None, np.ndarray], np.ndarray]


def answers(sent: DataFrame, bits: int, *judges: Judge) -> DataFrame:
    """One reply for each row sent.

    For each kind of question a judge, which gets all keys of a bucket, their values, and the slice that sent each key, and returns a
    value per key. Truth values go back as bits, numbers compressed. Notes (negative buckets) return unread.
    """

    def reply(table: pa.Table) -> pa.Table:
        slices = table.column("slice")
        bucket = table.column("bucket")[0].as_py()
        if bucket < 0:
            return pa.Table.from_arrays([slices, pa.array([-1] * len(table), pa.int64()), table.column("keys")], schema=_REPLY_ARROW)
        judge = judges[bucket >> bits]
        parts = [unpack(x) for x in table.column("keys").to_pylist()]
        length = [len(p) for p in parts]
        extras = table.column("extra").to_pylist()
        extra = None if extras[0] is None else np.concatenate([expand(x) for x in extras])
        values = judge(np.concatenate(parts), extra, np.repeat(np.array(slices.to_pylist(), np.int64), length))
        out = []
        for value in np.split(values, np.cumsum(length)[:-1]):
            out.append(np.packbits(value).tobytes() if value.dtype == bool else squeeze(value))
        return pa.Table.from_arrays([slices, table.column("bucket"), pa.array(out, pa.binary())], schema=_REPLY_ARROW)

    return sent.groupBy("bucket").applyInArrow(reply, REPLY)


def read_reply(table: pa.Table, keys: np.ndarray, bits: int, dtype: type = bool, kind: int = 0) -> np.ndarray:
    """The value of each of the sorted distinct ``keys`` that this slice asked about."""
    at = cuts(keys, bits)
    out = np.zeros(len(keys), dtype)
    for number, data in zip(table.column("bucket").to_pylist(), table.column("reply").to_pylist(), strict=True):
        if number >= 0 and number >> bits == kind:
            bucket = number - (kind << bits)
            n = at[bucket + 1] - at[bucket]
            raw = np.unpackbits(np.frombuffer(data, np.uint8), count=n) if dtype is bool else expand(data)
            out[at[bucket] : at[bucket + 1]] = raw
    return out


def read_note(table: pa.Table) -> bytes | None:
    for bucket, data in zip(table.column("bucket").to_pylist(), table.column("reply").to_pylist(), strict=True):
        if bucket < 0:
            return data
    return None


def flags_to_note(flags: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(flags).tobytes(), 1)


def note_to_flags(note: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(note), np.uint8), count=n).astype(bool)


def in_two_places(keys: np.ndarray, _extra: np.ndarray | None, _owner: np.ndarray) -> np.ndarray:
    """Whether another slice sent the same key."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    found = np.zeros(len(keys), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    return found


def copies_elsewhere(keys: np.ndarray, extra: np.ndarray | None, owner: np.ndarray) -> np.ndarray:
    """1 where another slice sent the same key, 2 more where one of a smaller number did."""
    order = np.lexsort((owner, keys))
    ranked = keys[order]
    later = np.concatenate([[False], ranked[1:] == ranked[:-1]])
    out = np.zeros(len(keys), np.int64)
    out[order] = 2 * later
    return out + in_two_places(keys, extra, owner)


def difference_cover(period: int) -> tuple[int, ...]:
    """A set of residues whose pairwise differences give every residue; greedy, hence small but not minimal."""
    cover, missing = [0], set(range(1, period))
    while missing:
        best = max(range(1, period), key=lambda x: len({d for c in cover for d in ((x - c) % period, (c - x) % period)} & missing))
        missing -= {d for c in cover for d in ((best - c) % period, (c - best) % period)}
        cover.append(best)
    return tuple(sorted(cover))


def cover_positions(starts: np.ndarray, ends: np.ndarray, cover: tuple[int, ...], period: int, width: int) -> np.ndarray:
    """Positions at cover residues, counted from each document's start, from which ``width`` units remain."""
    chosen = np.zeros(period, bool)
    chosen[list(cover)] = True
    length = ends - starts
    relative = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(starts, length)
    room = np.repeat(length, length) - relative >= width
    return np.flatnonzero(chosen[relative % period] & room)


def windows_with_anchor(shared: np.ndarray, starts: np.ndarray, ends: np.ndarray, period: int, window: int) -> np.ndarray:
    """Flags of the window starts that hold a shared anchor among their first ``period`` units."""
    n = len(shared)
    seen = np.zeros(n + 1, np.int64)
    np.cumsum(shared, out=seen[1:])
    length = ends - starts
    at = np.arange(n, dtype=np.int64)
    fits = np.repeat(ends, length) - at >= window
    return (seen[np.minimum(at + period, n)] > seen[:n]) & fits


def covered(marked: np.ndarray, window: int, n: int) -> np.ndarray:
    """Flags of the units inside a window that starts at a marked position."""
    at = np.flatnonzero(marked)
    change = np.bincount(at, minlength=n + 1) - np.bincount(np.minimum(at + window, n), minlength=n + 1)
    return np.cumsum(change)[:n] > 0
