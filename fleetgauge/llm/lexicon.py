"""A minimal acyclic transducer from words to token ids, in one flat file for memory-mapping.

Words are byte strings. States with the same continuations are one state, so suffixes are shared as well as prefixes. Each transition
carries a number; the numbers along a word's path add up to the word's rank, under which its ids are stored. Look-ups walk all words
of a batch together, one byte at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_NAMES = ("keys", "targets", "outputs", "final", "offsets", "ids")
_TYPES = (np.int64, np.int64, np.int64, np.int64, np.int64, np.int64)


def _minimal(words: Sequence[bytes]) -> tuple[list[tuple[bool, tuple[tuple[int, int], ...]]], int]:
    """States (final, transitions) of the minimal automaton of sorted distinct words, every target before its source; the start."""
    known: dict[tuple, int] = {}
    states: list[tuple] = []
    # The states along the last word: [final, closed transitions], the open transition being the next byte of the word.
    path: list[list] = [[False, []]]
    last = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, edges = path.pop()
            state = (final, tuple(edges))
            if state not in known:
                known[state] = len(states)
                states.append(state)
            path[-1][1].append((last[len(path) - 1], known[state]))

    for word in words:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        close(shared)
        path.extend([False, []] for _ in word[shared:])
        path[-1][0] = True
        last = word
    close(0)
    final, edges = path[0]
    states.append((final, tuple(edges)))
    return states, len(states) - 1


def build(entries: dict[bytes, Sequence[int]]) -> bytes:
    """The file for words and their ids."""
    words = sorted(entries)
    states, start = _minimal(words)
    size, rows = [0] * len(states), []
    for number, (final, edges) in enumerate(states):
        passed = int(final)
        for label, target in edges:
            rows.append((number * 256 + label, target, passed))
            passed += size[target]
        size[number] = passed
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    length = np.array([0, *(len(entries[w]) for w in words)], np.int64)
    ids = np.array([i for w in words for i in entries[w]], np.int64)
    arrays = (table[:, 0], table[:, 1], table[:, 2], np.array([f for f, _ in states], np.int64), np.cumsum(length), ids)
    header = np.array([start, *(len(a) for a in arrays)], np.int64)
    return b"".join(a.astype("<i8").tobytes() for a in (header, *arrays))


class Lexicon:
    """A memory-mapped file of :func:`build`."""

    def __init__(self, path: str):
        flat = np.memmap(path, np.int64, "r")
        at = len(_NAMES) + 1
        self.start = int(flat[0])
        for name, length in zip(_NAMES, flat[1:at].tolist(), strict=True):
            setattr(self, name, flat[at : at + length])
            at += length

    def ranks(self, words: Sequence[bytes]) -> np.ndarray:
        """The rank of each word, -1 for words that are not in the lexicon."""
        rank = np.zeros(len(words), np.int64)
        if not len(self.keys):
            return rank - 1
        lengths = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        begin = np.cumsum(lengths) - lengths
        state = np.full(len(words), self.start, np.int64)
        alive = np.arange(len(words))
        for depth in range(int(lengths.max(initial=0))):
            alive = alive[lengths[alive] > depth]
            key = state[alive] * 256 + data[begin[alive] + depth]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[edge] == key
            rank[alive[~hit]] = -1
            state[alive[~hit]] = -1
            alive, edge = alive[hit], edge[hit]
            state[alive] = self.targets[edge]
            rank[alive] += self.outputs[edge]
            if not len(alive):
                break
        ended = (state >= 0) & (self.final[np.maximum(state, 0)] == 1)
        return np.where(ended, rank, -1)

    def tokens(self, rank: int) -> list[int]:
        return self.ids[self.offsets[rank] : self.offsets[rank + 1]].tolist()
