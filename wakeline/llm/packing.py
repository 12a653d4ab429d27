"""Packing token sequences by a configuration linear program.

Documents become pieces of at most ``capacity`` tokens. What has to be packed is
then no more than a histogram of lengths. The configuration program (choose how
often to use each way of filling a sequence, so that every length is covered) is
solved by multiplicative weights: a length costs less the more of it is covered,
and a knapsack over the capacity finds the best fillings at the present costs and
with them a bound. Rounding down leaves a rest, which is a smaller program.
"""

from __future__ import annotations

import os
import string
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.byte_pairs import BytePairs, plain
from wakeline.llm.common import given_back, rank_within, settle
from wakeline.llm.words import Coder, Cuts, coded_texts

CAPACITY = 4096
END_ID = 1
#: How near the program comes to its bound, the share of a length that a round may cover, how
#: fast its weight falls, and how much less than the best a filling may be worth, by rounds.
GAP, STEP, RATE, NEAR = 0.002, 0.25, 0.5, 0.002
#: Rounds at most, and how tight fillings are at the bound's prices for either rounding.
ROUNDS, TIGHT = 8, (0.999, 0.0)
#: Plain words whose merges go forward together.
BLOCK = 1 << 16
#: ASCII white space, and what the names of special tokens start with.
WHITE, SPECIAL = b" \t\n\v\f\r", b"<|"
#: Words whose coding shows whether a tokenizer codes them one by one, also if nothing parts them.
PROBES = (
    (["a", "b"], False),
    (["it's", "the", "end."], False),
    (["\u00e9t\u00e9", "\u0301e", "x\u0301"], False),
    (["word", "7", "2", "(", "next", ").", "3", "-", "4"], True),
    (["\u00e9word", ",", "l'eau"], True),
)

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _cuts() -> tuple[Cuts, Cuts]:
    """Where words start: at white space behind anything else, and finer where ASCII allows.

    The finer cuts part letters, digits and marks; an apostrophe may belong to a
    letter behind it and stays with its neighbours, as does all beyond ASCII.
    """
    kind = np.zeros(256, dtype=np.uint8)
    kind[33:127] = 4
    kind[[ord("'"), 127]] = 0
    kind[list(string.ascii_letters.encode())] = 2
    kind[list(string.digits.encode())] = 3
    kind[list(WHITE)] = 1
    parted = np.zeros((5, 5), dtype=bool)
    parted[[0, 2, 3, 4], 1] = True
    plain = Cuts(kind == 1, np.array([[False, True], [False, False]]))
    for a, b in ((2, 3), (3, 2), (2, 4), (4, 2), (3, 4), (4, 3), (3, 3)):
        parted[a, b] = True
    return plain, Cuts(kind, parted)


def load_tokenizer(path: str):
    """The tokenizer of a file, checked to code words one by one and without regard to ASCII case.

    White space is dropped and parts words, and so do changes between ASCII letters,
    digits and marks, but for apostrophes.
    """
    # Tasks are the parallelism here; threads of the tokenizer would only contend.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    for words, joined in PROBES:
        apart = [i for w in words for i in tokenizer.encode(w, add_special_tokens=False).ids]
        texts = [gap.join(words) for gap in (" ", "\n", " \t ", "\r\n\v\f")]
        for text in [*texts, f" {texts[0]}\n", texts[0].upper(), *(["".join(words)] if joined else [])]:
            if tokenizer.encode(text, add_special_tokens=False).ids != apart:
                raise ValueError(f"{path} does not code words one by one: {text!r}")
    return tokenizer


def load_pairs(path: str, tokenizer) -> BytePairs:
    """The file's merges for plain words, compared with the tokenizer on some."""
    pairs = BytePairs(path)
    words = pairs.sample()
    coded = tokenizer.encode_batch_fast(words, add_special_tokens=False)
    if [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in coded] != pairs.code(words):
        raise ValueError(f"{path} does not merge plain words by its ranks alone")
    return pairs


def tokenise(documents: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32.

    The tokenizer drops white space and no token spans it (``load_tokenizer`` checks
    that), so the ids of a text are those of its words, and each distinct word of a
    batch is tokenised once. ``vocabulary`` is the path of the tokenizer file on the
    machines. A null text has no words, so its one piece is the end id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(vocabulary)

        pairs = load_pairs(vocabulary, tokenizer)

        def learn(words: list[str]) -> list[bytes]:
            found: list[bytes] = [b""] * len(words)
            bare = [w.lstrip(white) for w in words]
            easy = [k for k, w in enumerate(bare) if plain(w)]
            for at in range(0, len(easy), BLOCK):
                part = easy[at : at + BLOCK]
                for k, ids in zip(part, pairs.code([bare[k] for k in part])):
                    found[k] = ids
            hard = [k for k, w in enumerate(bare) if not plain(w)]
            for at in range(0, len(hard), 4096):
                part = hard[at : at + 4096]
                coded = tokenizer.encode_batch_fast([words[k] for k in part], add_special_tokens=False)
                for k, e in zip(part, coded):
                    found[k] = struct.pack(f"<{len(e.ids)}I", *e.ids)
            return found

        white = WHITE.decode()
        coder = Coder(learn)
        cuts, fine = _cuts()
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32

        def finer(data: np.ndarray) -> tuple[np.ndarray, Cuts]:
            # Names of special tokens have marks, and their case counts.
            return (data, cuts) if SPECIAL in memoryview(data).tobytes() else (lower[data], fine)

        end = np.uint32(END_ID).astype("<u4").tobytes()
        crc, width = zlib.crc32, 4 * capacity
        for batch in batches:
            rows: list[int] = []
            pieces: list[int] = []
            lengths: list[int] = []
            sums: list[int] = []

            def add(row: int, piece: int, ids) -> None:
                rows.append(row)
                pieces.append(piece)
                lengths.append(len(ids) // 4)
                sums.append(crc(ids))

            kept, piece = b"", 0
            for group, bounds, ends, codes in coded_texts(batch.column(1), cuts, coder, finer):
                data = memoryview(codes.astype("<u4", copy=False)).cast("B")
                at = (4 * bounds).tolist()
                for row, a, b in zip(group.tolist(), at, at[1:]):
                    left = kept + data[a:b] if kept else data[a:b]
                    while len(left) >= width:
                        add(row, piece, left[:width])
                        left, piece = left[width:], piece + 1
                    if ends:
                        add(row, piece, bytes(left) + end)
                        kept, piece = b"", 0
                    else:
                        kept = bytes(left)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(pieces, pa.int32()),
                    pc.multiply(pa.array(pieces, pa.int64()), capacity),
                    pa.array(lengths, pa.int64()),
                    pa.array(sums, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        lambda batches: given_back(run(batches)), PIECES
    )


def knapsack(price: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Worth of the best filling of every room up to the capacity, lengths used any number of times."""
    best = np.zeros(capacity + 1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right").tolist()
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if n := fits[room]:
            best[room] = max(best[room], (best[room - lengths[:n]] + price[:n]).max())
    return best


class Filler:
    """Fillings around a length that are worth the most at given prices."""

    def __init__(self, price: np.ndarray, lengths: np.ndarray, capacity: int) -> None:
        self.price, self.lengths, self.capacity = price, lengths, capacity
        self.best = knapsack(price, lengths, capacity)

    def around(self, lead: int, stock: np.ndarray) -> tuple[dict[int, int], float]:
        """The best filling with ``lead`` in it and the others from what is in stock, and its worth.

        Each piece is one of those that leave the rest of the room worth the most; of
        equals it is the one with most stock, so that none runs out early.
        """
        lengths, best = self.lengths, self.best
        stock = np.ceil(stock)
        found = {lead: 1}
        stock[lead] -= 1
        room, worth = self.capacity - int(lengths[lead]), self.price[lead]
        while room and (n := int(np.searchsorted(lengths, room, side="right"))):
            value = np.where(stock[:n] > 0, self.price[:n] + best[room - lengths[:n]], -1.0)
            most = value.max()
            if most < 0:
                break
            near = np.flatnonzero(value >= most * (1 - 1e-9))
            k = int(near[stock[near].argmax()])
            found[k] = found.get(k, 0) + 1
            stock[k] -= 1
            room -= int(lengths[k])
            worth += self.price[k]
        return found, float(worth)


@dataclass
class Program:
    """Fillings with how often each is used, their sum, the bound that no packing beats, and prices."""

    fillings: list[tuple[dict[int, int], float]]
    primal: float
    dual: float
    price: np.ndarray


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> Program:
    """The covering program over all fillings: use few, and cover every length as often as it is there.

    Multiplicative weights: each length has a weight, and its price is the weight
    by the count. A knapsack finds what a filling is worth at most. Divided by that,
    prices are a dual solution, so the sum of the weights by it is a bound. A round
    uses fillings around each length that are worth nearly the most, and covers a
    length by no more than a step; the weight of a length falls with the share of it
    that was covered. Rounds end when the used fillings, with what is not
    covered yet added in further ones, are within ``GAP`` of the bound.
    """
    weight = counts * lengths.astype(float)
    covered = np.zeros(len(lengths))
    used: dict[tuple, float] = defaultdict(float)
    dual, price = 0.0, weight / counts
    best: tuple[float, dict[tuple, float]] = (np.inf, {})
    for turn in range(rounds):
        filler = Filler(weight / counts, lengths, capacity)
        bound = float(weight.sum() / filler.best[capacity])
        if bound > dual:
            dual, price = bound, filler.price / filler.best[capacity]
        # Later rounds also take what is worth a little less, for lengths in no filling of the most worth.
        near = filler.best[capacity] * (1 - min(0.5, NEAR * turn))
        stock = STEP * counts
        cover(filler, stock, used, near)
        fresh = STEP - stock / counts
        covered += fresh
        if (turn + 1) * STEP >= 1:
            trial = defaultdict(float, {f: times / max(covered.max(), 1) for f, times in used.items()})
            cover(filler, counts * np.maximum(0, 1 - covered / max(covered.max(), 1)), trial, 0.0)
            if (total := sum(trial.values())) < best[0]:
                best = (total, dict(trial))
            if best[0] <= (1 + GAP) * dual:
                break
        weight *= np.exp(-RATE * fresh / STEP)
        weight /= weight.max()
    return Program([(dict(f), times) for f, times in best[1].items()], best[0], dual, price)


def cover(filler: Filler, stock: np.ndarray, used: dict[tuple, float], near: float) -> None:
    """Use up a fractional stock by fillings that are worth at least ``near``, longest pieces first."""
    for lead in range(len(stock) - 1, -1, -1):
        while stock[lead] > 1e-9:
            found, worth = filler.around(lead, stock)
            if worth < near:
                break
            times = min(stock[k] / n for k, n in found.items())
            for k, n in found.items():
                stock[k] -= times * n
            used[tuple(sorted(found.items(), reverse=True))] += times


@dataclass
class Packing:
    """Runs of pieces, the number of sequences, and the first program's two bounds.

    A run (length, first, count, sequence, offset) says: of this length, pieces
    ``first`` to ``first + count - 1`` go to sequences ``sequence`` onwards, one
    each, at ``offset``.
    """

    runs: list[tuple[int, int, int, int, int]]
    sequences: int
    primal: float
    dual: float


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> Packing:
    """Where the pieces of each length go; the number of runs depends on the lengths, not on the rows.

    The program's fillings are used as often as it has them, rounded down: those that its
    prices say waste nothing, or all of them, whichever needs fewer sequences. What
    that leaves goes to the smallest gap it fits in, the longest pieces first, and
    to new sequences.
    """
    lengths = np.array(sorted(histogram), dtype=np.int64)
    counts = np.array([histogram[int(x)] for x in lengths], dtype=np.int64)
    if not counts.any():
        return Packing([], 0, 0.0, 0.0)
    program = solve(lengths, counts, capacity)
    placed, sequences = min((place(program, lengths, counts, capacity, t) for t in TIGHT), key=lambda p: p[1])
    first: dict[int, int] = defaultdict(int)
    numbered = []
    for k, count, sequence, offset in placed:
        numbered.append((int(lengths[k]), first[k], count, sequence, offset))
        first[k] += count
    return Packing(numbered, sequences, program.primal, program.dual)


def place(
    program: Program, lengths: np.ndarray, counts: np.ndarray, capacity: int, tight: float
) -> tuple[list[tuple[int, int, int, int]], int]:
    """Runs of one rounding and its sequences: fillings worth ``tight`` at least, then gaps."""
    left = counts.copy()
    runs: list[tuple[int, int, int, int]] = []
    sequences = 0

    def use(found: dict[int, int], times: int) -> None:
        nonlocal sequences
        offset = 0
        for k, n in sorted(found.items(), reverse=True):
            for _ in range(n):
                runs.append((k, times, sequences, offset))
                offset += int(lengths[k])
            left[k] -= times * n
        sequences += times

    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for found, times in sorted(program.fillings, key=lambda f: -f[1]):
        worth = sum(program.price[k] * n for k, n in found.items())
        times = int(min([times + 1e-9, *(left[k] // n for k, n in found.items())]))
        if times > 0 and worth >= tight:
            room = capacity - sum(int(lengths[k]) * n for k, n in found.items())
            gaps[room].append((sequences, times))
            use(found, times)
    rooms = np.zeros(capacity + 2, dtype=bool)
    rooms[[r for r in gaps if r]] = True
    for k in range(len(lengths) - 1, -1, -1):
        length = int(lengths[k])
        while left[k]:
            space = length + int(rooms[length:].argmax())
            if rooms[space]:
                sequence, count = gaps[space].pop()
                part = int(min(count, left[k]))
                if part < count:
                    gaps[space].append((sequence + part, count - part))
                rooms[space] = bool(gaps[space])
                runs.append((k, part, sequence, capacity - space))
                left[k] -= part
                after = space - length
                gaps[after].append((sequence, part))
            else:
                each = int(min(capacity // length, left[k]))
                part = int(left[k] // each)
                after = capacity - each * length
                gaps[after].append((sequences, part))
                use({k: each}, part)
            if after:
                rooms[after] = True
    return runs, sequences


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity``.

    Pieces of one length are numbered in slices, so one length may hold any share
    of the rows. Equal rows are interchangeable. An empty table gives an empty
    result.
    """
    pieces = settle(pieces)
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    table = np.array(sorted(pack_histogram(counts, capacity).runs), dtype=np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 44) | table[:, 1]

    ranked = rank_within(pieces, "length", ["doc_id", "piece", "ids_crc32"], counts)

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rank = frame.pop("rank_").to_numpy()
            at = np.searchsorted(keys, (frame["length"].to_numpy() << 44) | rank, side="right") - 1
            frame["sequence_id"] = table[at, 3] + rank - table[at, 1]
            frame["offset"] = table[at, 4]
            yield frame

    names = [c for c in ranked.columns if c != "rank_"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.select(names).schema)
    return ranked.select(*names, "rank_").mapInPandas(
        put, f"{fields}, sequence_id bigint, offset bigint"
    )


def pack_documents(documents: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Whole documents as packed pieces.

    A null or empty text is its end id alone. Longer documents than ``capacity``
    are cut; others never. Nulls in doc_id are kept.
    """
    return pack(tokenise(documents, vocabulary, capacity), capacity)
