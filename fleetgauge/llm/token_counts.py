"""Token counts of a sentencepiece model, in bounded memory for documents of any length.

Overlap resynchronisation: a huge document is encoded in overlapping chunks, with offsets. Neighbouring chunks are spliced at a
position in their overlap where both encodings begin a token and which is proven stable: a space after another character. No piece
of the vocabulary holds a space after another character (checked when the model is loaded), so no token crosses such a position and
no merge on one side depends on the other. Where an overlap holds no such position, it is widened until it does, at worst to the end
of the document.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The character that stands for a space in pieces, and in texts is one.
_MARK = "▁"
_SPACES = (" ", _MARK)


@functools.lru_cache(maxsize=2)
def load(path: str) -> sentencepiece.SentencePieceProcessor:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    crossing = [p for p in map(model.id_to_piece, range(model.get_piece_size())) if _MARK in p.lstrip(_MARK)]
    if crossing:
        raise ValueError(f"{len(crossing)} pieces hold a space after another character, so no cut before a space is stable")
    return model


def stable(text: str, at: int) -> bool:
    return 0 < at < len(text) and text[at] in _SPACES and text[at - 1] not in _SPACES


def _offsets(model: sentencepiece.SentencePieceProcessor, text: str, start: int, end: int) -> list[int]:
    """Where the tokens of a chunk begin, in the text. (The library counts bytes.)"""
    part = text[start:end]
    data = np.frombuffer(part.encode(), np.uint8)
    character = np.append(np.cumsum((data & 0xC0) != 0x80) - 1, len(part)) + start
    return character[[p.begin for p in model.encode(part, return_type="proto").pieces]].tolist()


def count_spliced(model: sentencepiece.SentencePieceProcessor, text: str, chunk: int, overlap: int) -> int:
    """The number of tokens of a text, from overlapping chunks."""
    total, owned, start = 0, 0, 0
    end = min(len(text), chunk)
    tokens = _offsets(model, text, start, end)
    while end < len(text):
        width = overlap
        while True:
            next_start = max(start, end - width)
            next_end = min(len(text), max(next_start + chunk, end + 1))
            ahead = _offsets(model, text, next_start, next_end)
            # Both encodings know the position, and the next one sees the character before it.
            common = set(tokens) & set(ahead)
            meeting = [p for p in common if max(owned, next_start) < p < end and stable(text, p)]
            if meeting:
                break
            if next_start == start:
                # The overlap is the whole chunk: take a longer one instead.
                end = min(len(text), start + 2 * (end - start))
                tokens = _offsets(model, text, start, end)
                if end == len(text):
                    return total + sum(p >= owned for p in tokens)
            width *= 2
        middle = (next_start + end) // 2
        splice = min(meeting, key=lambda p: (abs(p - middle), p))
        total += sum(owned <= p < splice for p in tokens)
        owned, start, end, tokens = splice, next_start, next_end, ahead
    return total + sum(p >= owned for p in tokens)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, chunk: int = 16384, overlap: int = 256) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every row.

    Tokens are those of the library for the whole text, without added ones. ``model_path`` is a file on every executor. Texts of more
    than ``chunk`` characters are encoded in chunks of that size. A null text counts as empty, with no tokens. One row per input row,
    repeated rows and rows without ``doc_id`` included; other columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = [0] * len(texts)
            short = [i for i, t in enumerate(texts) if 0 < len(t) <= chunk]
            for part in range(0, len(short), 256):
                rows = short[part : part + 256]
                for i, ids in zip(rows, model.encode([texts[i] for i in rows], num_threads=1), strict=True):
                    counts[i] = len(ids)
            for i, text in enumerate(texts):
                if len(text) > chunk:
                    counts[i] = count_spliced(model, text, chunk, overlap)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
