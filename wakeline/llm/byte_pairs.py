"""Byte-pair merges of many words at once, for words that a tokenizer file takes whole.

All words go a merge forward together: the pair of lowest rank of each word, the
leftmost of equal ones, becomes one symbol. Serves lower-case Latin words, which the
tokenizer's normaliser leaves alone and its splitter keeps in one piece.
"""

from __future__ import annotations

import json

import numpy as np

END = "</w>"
NEVER = np.iinfo(np.int32).max


def plain(word: str) -> bool:
    """Whether a word is nothing but lower-case letters up to U+00FF."""
    return word.isalpha() and word.islower() and max(word) <= "\u00ff"


def byte_names() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself if printable, else the next free one."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in shown}
    for k, b in enumerate(b for b in range(256) if b not in names):
        names[b] = chr(256 + k)
    return [names[b] for b in range(256)]


class BytePairs:
    """Merges of a tokenizer file with word ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        ids = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], dtype=np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.merged = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        self.whole = [w.removesuffix(END) for w in ids if w.endswith(END)]
        names = byte_names()
        self.inner = np.array([ids[n] for n in names], dtype=np.int64)
        self.last = np.array([ids[n + END] for n in names], dtype=np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NEVER)

    def sample(self, most: int = 400) -> list[str]:
        """Words to compare with the tokenizer itself: joined pairs of its own tokens."""
        held = [a + b for a, b in zip(self.whole, reversed(self.whole)) if plain(a + b)]
        return held[:: max(1, len(held) // most)]

    def code(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian uint32s."""
        coded = [w.encode() for w in words]
        data = np.frombuffer(b"".join(coded), dtype=np.uint8)
        ends = np.cumsum(np.fromiter(map(len, coded), dtype=np.int64, count=len(coded)))
        symbols = self.inner[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        first = np.append(0, ends[:-1])
        rank = np.full(len(symbols), NEVER)
        rank[:-1] = self.ranks(symbols[:-1], symbols[1:])
        rank[ends - 1] = NEVER
        found: list[bytes] = [b""] * len(words)
        name = np.arange(len(words))
        while len(name):
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(symbols)))
            done = least == NEVER
            if done.any():
                gone = np.repeat(done, sizes)
                parts = symbols[gone].astype("<u4").tobytes()
                stops = (4 * np.cumsum(sizes[done])).tolist()
                for k, a, b in zip(name[done].tolist(), [0, *stops], stops):
                    found[k] = parts[a:b]
                symbols, rank, name = symbols[~gone], rank[~gone], name[~done]
                least, sizes = least[~done], sizes[~done]
                first = np.cumsum(sizes) - sizes
                if not len(name):
                    break
            hits = np.flatnonzero(rank == np.repeat(least, sizes))
            # The first hit of each word, as hits are in order.
            at = hits[np.searchsorted(hits, first)]
            symbols[at] = self.merged[least]
            left = np.ones(len(symbols), dtype=bool)
            left[at + 1] = False
            after = np.minimum(at + 2, len(symbols) - 1)
            more = at + 2 < first + sizes
            rank[at] = np.where(more, self.ranks(symbols[at], symbols[after]), NEVER)
            before = at > first
            rank[at[before] - 1] = self.ranks(symbols[at[before] - 1], symbols[at[before]])
            symbols, rank = symbols[left], rank[left]
            sizes = sizes - 1
            first = np.cumsum(sizes) - sizes
        return found
