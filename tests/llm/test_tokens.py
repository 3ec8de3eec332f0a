"""Token counts and BPE codes against the libraries on whole texts."""

from __future__ import annotations

import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fleetgauge.llm import bpe, lexicon, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, ids int, n_tokens string"


def texts(seed=3, n=150):
    rng = random.Random(seed)
    alphabet = ["a", "b", "th", "e", "é", "ß", "語", "😀", "1", "23", "'s", "'LL", ".", "**", "\n", " ", " ", " ", "  ", "\t", " ", " ", "\x1c", "\x1f", "\x85", "▁", "<|endoftext|>", "<s>", "́", "\x00", "​", "A" * 40, "=" * 70]
    out = ["", None, " ", "  \n", "<|endoftext|>", " <|endoftext|> x", "x" * 3000, " " * 500, "the cat's  hat \n\n sat"]
    for _ in range(n):
        out.append("".join(rng.choices(alphabet, k=rng.randint(1, 60))))
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 12))) for _ in range(200)]
    out.append(" ".join(rng.choices(words, k=8000)))
    out.append("".join(rng.choices(words, k=3000)))
    return out


def frame(spark, values):
    return spark.createDataFrame([(i if i % 9 else None, t, 1, "n") for i, t in enumerate(values)], SCHEMA)


def test_counts_agree_with_the_library(spark):
    values = texts()
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted(((t or "") and len(model.encode(t)) or 0, len((t or "").encode())) for t in values)
    for chunk, overlap in ((16384, 256), (50, 7), (9, 1)):
        out = token_counts.count_tokens(frame(spark, values), PIECES, limit=20, chunk=chunk, overlap=overlap).collect()
        assert sorted((r.n_tokens, r.n_bytes) for r in out) == want
        assert all(r.over_limit == (r.n_tokens > 20) for r in out)


def test_codes_agree_with_the_library(spark):
    values = texts()
    library = Tokenizer.from_file(BYTES)
    codes = [library.encode(t or "", add_special_tokens=False).ids for t in values]
    want = sorted((",".join(map(str, c)), len(c), library.decode(c, skip_special_tokens=False)) for c in codes)
    for size in (0, 40, 5000):
        out = bpe.encode_documents(frame(spark, values), BYTES, size).collect()
        assert sorted((r.ids, r.n_tokens, r.decoded) for r in out) == want


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    coder = bpe.Coder(BYTES, None)
    library = Tokenizer.from_file(BYTES)
    for text in texts(5, 40):
        if text:
            assert coder.encode(pa.array([text]))[0][0].decode() == ",".join(map(str, library.encode(text, add_special_tokens=False).ids))


@pytest.mark.parametrize("n", [0, 1, 500])
def test_lexicon(tmp_path, n):
    rng = random.Random(n)
    entries = {bytes(rng.choices(b"abc", k=rng.randint(0 if i else 1, 9))): [i, i * 2] for i in range(n)}
    path = tmp_path / "lexicon"
    path.write_bytes(lexicon.build(entries))
    lex = lexicon.Lexicon(str(path))
    probes = [*entries, b"zz", b"abcabcabcabc", b"a", b""]
    for probe, rank in zip(probes, lex.ranks(probes).tolist()):
        assert (lex.tokens(rank) if rank >= 0 else None) == entries.get(probe)
    if n == 500:
        assert len(lex.final) < sum(map(len, entries)) / 3


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert token_counts.count_tokens(none, PIECES).count() == 0
    assert bpe.encode_documents(none, BYTES).count() == 0
