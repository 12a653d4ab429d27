"""Texts as codes, a batch at a time: words are cut in bulk and each distinct one is coded once.

A text's codes have to be those of its words in a row; what parts words is told by
classes of bytes, so only ASCII characters can. Distinct words of a batch are found
by dictionary encoding, and codes are gathered by offsets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text coded at a time; a longer text is coded in parts that end between words.
CHUNK = 1 << 22
#: Bytes of words and codes that a task remembers, and what each takes besides; beyond it the
#: memory starts anew.
REMEMBERED, ENTRY = 96 << 20, 220


class Cuts:
    """Where words are parted: between bytes whose pair of classes is marked.

    ``classes`` gives each of the 256 bytes a small number; ``parted`` is a square
    table over them. Bytes beyond ASCII are class 0, and (0, 0) is never parted.
    """

    def __init__(self, classes: np.ndarray, parted: np.ndarray) -> None:
        self.classes, self.parted = classes.astype(np.uint8), parted.ravel()
        self.width = len(parted)

    def marks(self, data: np.ndarray) -> np.ndarray:
        """For every byte whether a word starts there; never for the first one."""
        kind = self.classes[data]
        found = np.zeros(len(data), dtype=bool)
        found[1:] = self.parted[kind[:-1] * self.width + kind[1:]]
        return found

    def next_start(self, data: np.ndarray, at: int) -> int:
        """First word start behind ``at``, or the end."""
        while at < len(data):
            found = np.flatnonzero(self.marks(data[at : at + (1 << 20) + 1]))
            if len(found):
                return at + int(found[0])
            at += 1 << 20
        return len(data)


def column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of a string column as one array, and the offsets of its rows; null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data or b"", dtype=np.uint8), offsets


def chunks(texts: pa.Array, cuts: Cuts) -> Iterator[tuple[np.ndarray, np.ndarray, bool, np.ndarray]]:
    """Rows of about ``CHUNK`` bytes: row numbers, their offsets, whether they end here, bytes.

    A row that is longer comes alone, in parts.
    """
    if not len(texts):
        return
    data, offsets = column_bytes(texts)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
        part = data[offsets[row] : offsets[stop]]
        if len(part) <= CHUNK:
            yield np.arange(row, stop), offsets[row : stop + 1] - offsets[row], True, part
        else:
            at = 0
            while at < len(part):
                end = cuts.next_start(part, at + CHUNK)
                yield np.array([row]), np.array([0, end - at]), end == len(part), part[at:end]
                at = end
        row = stop


class Coder:
    """Codes of words, learnt when first met: ``learn`` gives each of a list little-endian uint32s."""

    def __init__(self, learn: Callable[[list[str]], list[bytes]]) -> None:
        self.learn = learn
        self.known: dict[str, bytes] = {}
        self.held = 0

    def codes(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """All codes in a row, and how many each word has."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if self.held > REMEMBERED:
            self.known.clear()
            self.held = 0
        new = [w for w in distinct if w not in self.known]
        for word, found in zip(new, self.learn(new) if new else []):
            self.known[word] = found
            self.held += len(word) + len(found) + ENTRY
        each = pa.array([self.known[w] for w in distinct], pa.large_binary()).take(coded.indices)
        _, ends, data = each.buffers()
        counts = np.diff(np.frombuffer(ends, dtype=np.int64)[: len(each) + 1]) // 4
        return np.frombuffer(data or b"", dtype="<u4", count=int(counts.sum())), counts


def coded_texts(
    texts: pa.Array,
    cuts: Cuts,
    coder: Coder,
    finer: Callable[[np.ndarray], tuple[np.ndarray, Cuts]] | None = None,
) -> Iterator[tuple[np.ndarray, np.ndarray, bool, np.ndarray]]:
    """Codes of rows, as from ``chunks``: row numbers, offsets into the codes, whether they end, codes.

    ``finer`` may give a chunk's bytes in a plainer form with cuts of its own.
    """
    for rows, offsets, ends, data in chunks(texts, cuts):
        data, own = finer(data) if finer else (data, cuts)
        marks = own.marks(data)
        marks[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.append(np.flatnonzero(marks), len(data))
        words = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(data))
        codes, counts = coder.codes(words)
        total = np.append(0, np.cumsum(counts))
        yield rows, total[np.searchsorted(starts, offsets)], ends, codes
