"""Brute-force versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def repeated_passages(rows, window=13):
    first = {}
    for doc_id, text in rows:
        w = words(text)
        if doc_id is None:
            continue
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1 if doc_id is not None else 0):
            if first[tuple(w[i : i + window])] < doc_id:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((doc_id, len(w), sum(gone), sha(" ".join(kept))))
    return out


def repeated_strings(rows, window=400):
    count = Counter()
    data = [(doc_id, (text or "").encode()) for doc_id, text in rows]
    for _, b in data:
        count.update(b[i : i + window] for i in range(len(b) - window + 1))
    out = []
    for doc_id, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if count[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((doc_id, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def lm_scores(rows, order=3, backoff=0.4, min_count=2, others_only=False):
    docs = [(doc_id, words(text)) for doc_id, text in rows]

    def grams(w):
        return Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))

    whole = sum((grams(w) for _, w in docs), Counter())
    everything = sum(len(w) for _, w in docs)
    out = []
    for doc_id, w in docs:
        count, total = (whole - grams(w), everything - len(w)) if others_only else (whole, everything)

        def score(context, word, count=count, total=total):
            if not context:
                return (count[(word,)] or backoff) / max(1, total)
            seen = count[(*context, word)]
            if seen >= min_count:
                return seen / count[tuple(context)]
            return backoff * score(context[1:], word)

        out.append((doc_id, len(w), math.fsum(math.log10(score(w[max(0, i - order + 1) : i], x)) for i, x in enumerate(w))))
    return out
