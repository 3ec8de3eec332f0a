"""The words of Arrow texts as numbers of a dictionary, exact and without Python work per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def text_runs(texts: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """First and last row of runs of texts of at most about ``limit`` bytes (one row at least)."""
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < len(texts):
        done = total[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(total, done + limit, side="right")))
        yield row, stop
        row = stop


def numbered_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of texts (null: empty): the number of each word, the place after each text's last word, and the distinct words by number.

    Words are what ASCII white space (space and the controls tab to carriage return) separates; they are compared as they are.
    """
    cut = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    coded = cut.flatten().dictionary_encode()
    number = coded.indices.to_numpy(zero_copy_only=False)
    ends = cut.offsets.to_numpy()[1:].astype(np.int64) - int(cut.offsets[0].as_py())
    # White space at either end of a text leaves an empty word there.
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if empty >= 0:
        real = number != empty
        ends = np.concatenate([[0], np.cumsum(real)])[ends]
        number = number[real]
    return number, ends, coded.dictionary


#: Bytes that are or may be white space, and those that may begin a character of white space beyond ASCII.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_MAY_BLANK = np.zeros(256, bool)
_MAY_BLANK[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def numbered_units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of texts (null: empty): the number of each unit, the place after each text's last unit, and the distinct units by number.

    The units of a text, one after the other, are the text. It is cut before every space that stands between two characters which
    certainly are no white space; next to a character that may be some (told by its first byte) it is not.
    """
    raw = texts.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    _, offsets, data = raw.buffers()
    bounds = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    buffer = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    begins = np.zeros(len(buffer) + 1, bool)
    begins[bounds[:-1]] = True
    at = np.flatnonzero(buffer == 0x20)
    at = at[~begins[at] & ~begins[at + 1] & (at + 1 < len(buffer))]
    before, after = buffer[at - 1], buffer[at + 1]
    wide = (before >= 0x80) & ((buffer[np.maximum(at - 2, 0)] == 0xC2) | _MAY_BLANK[buffer[np.maximum(at - 3, 0)]])
    at = at[~(_BLANK[before] | wide | _BLANK[after] | _MAY_BLANK[after])]
    begins[at] = True
    starts = np.flatnonzero(begins[:-1])
    edges = pa.py_buffer(np.append(starts, len(buffer)).astype(np.int64))
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, edges, pa.py_buffer(buffer)]).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), np.searchsorted(starts, bounds[1:]), coded.dictionary.cast(pa.large_string())
