"""Merge-type subword encoding by a table of each prefix's last token, and decoding.

Merging pairs of symbols, best score first and leftmost of equals, gives every prefix
of a word exactly one last token, and a row of tokens is what merging makes of its
text if and only if that holds for each two neighbours alone. So one pass suffices:
an automaton names the tokens that end at a place, the one that goes with the last
token of the prefix before it is the last token there, and ids are read backwards
from the end.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.words import Coder, Cuts, coded_texts

#: Fixed value: the character that stands for a space in pieces.
SPACE = "▁"
#: Pairs of neighbours whose verdict is remembered; beyond it the memory starts anew.
PAIRS = 1 << 21
#: Characters of a word up to which words go through the table together, and words at a time.
SHORT, BLOCK = 64, 1 << 16
#: Texts whose ids have to be the library's own for a file to be taken.
PROBES = ("", " ", "a", "  two  Spaces ", "tab\tline\nend\r\n", "ﬁ ① Ａ é é", "x▁y▁", "\u0000\U0001f600一 aaaa")


class Pieces:
    """The pieces of a model file and the table of last tokens.

    Raises ``ValueError`` for files of another kind: no merges by score, a normaliser
    that changes characters, no space put in front, or no byte pieces.
    """

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        self.library = library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.size: list[int] = []
        self.text: list[str] = []
        surfaces: list[bytes] = []
        for k in range(library.vocab_size()):
            piece = library.id_to_piece(k)
            self.text.append(piece)
            self.size.append(len(piece))
            if library.is_byte(k):
                surfaces.append(bytes([int(piece[3:5], 16)]))
            elif library.is_control(k):
                surfaces.append(b"")
            elif library.is_unknown(k):
                surfaces.append(" ⁇ ".encode())
            else:
                surfaces.append(piece.replace(SPACE, " ").encode())
                if not library.is_unused(k):
                    self.ids[piece], self.score[piece] = k, library.get_score(k)
        self.surfaces = pa.array(surfaces, pa.large_binary())
        self.opens = np.array([t.startswith(SPACE) for t in self.text])
        self.widths = np.array([len(s) for s in surfaces])
        self.bytes = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        # A character of longer pieces that is none itself still takes part in merges.
        longer = {c for piece in self.ids if len(piece) > 1 for c in piece}
        for c in sorted(longer - self.ids.keys()):
            self.ids[c] = len(self.text)
            self.text.append(c)
            self.size.append(1)
        self.matches = ahocorasick.Automaton()
        for piece, k in self.ids.items():
            self.matches.add_word(piece, (len(piece), k))
        self.matches.make_automaton()
        self.single = {piece for piece in self.ids if len(piece) == 1 and self.ids[piece] < len(surfaces)}
        self._grow_tree()
        self.scripts: dict[int, list | None] = {}
        self.valid = np.full(len(self.text), -1, dtype=np.int8)
        self.fits: dict[int, bool] = {}
        self.forget()
        self.cuts = self._cuts(longer)
        for text in PROBES:
            words = self.learn([" " + text] if text else [])
            if b"".join(words) != np.array(library.encode(text), dtype="<u4").tobytes():
                raise ValueError(f"{path} is not a plain merge-type model: {text!r}")

    def _grow_tree(self) -> None:
        """The pieces as a tree: sorted edges (node and kind of character) and the id at each node."""
        kinds = {c: k for k, c in enumerate(sorted({c for piece in self.ids for c in piece}))}
        self.kinds = len(kinds)
        self.kind = np.zeros(0x110000, dtype=np.int32)
        for c, k in kinds.items():
            self.kind[ord(c)] = k
        self.kind[ord(" ")] = kinds.get(SPACE, 0)
        edges: dict[int, int] = {}
        token = [-1]
        for piece, k in self.ids.items():
            node = 0
            for c in piece:
                key = node * self.kinds + kinds[c]
                node = edges.get(key, 0)
                if not node:
                    node = edges[key] = len(token)
                    token.append(-1)
            token[node] = k
        keys = np.fromiter(edges, dtype=np.int64, count=len(edges))
        order = np.argsort(keys)
        self.edge_keys = keys[order]
        self.edge_to = np.fromiter(edges.values(), dtype=np.int64, count=len(edges))[order]
        self.node_token = np.array(token, dtype=np.int64)

    def _cuts(self, longer: set[str]) -> Cuts:
        """Words start at spaces, if no piece has one behind another character; characters that
        stand in no longer piece are words of their own."""
        classes = np.zeros(256, dtype=np.uint8)
        for b in range(128):
            classes[b] = 0 if chr(b) in longer else 2
        inside = any(SPACE in piece.lstrip(SPACE) for piece in self.ids)
        classes[ord(" ")] = 0 if inside else 1
        parted = np.zeros((3, 3), dtype=bool)
        parted[0, 1] = parted[:, 2] = parted[2, :] = True
        return Cuts(classes, parted)

    def script(self, k: int) -> list | None:
        """How merging builds token ``k``: (score of the step, first symbol, last symbol) before each.

        Behind the last step stands the token itself. None if merging ends in something else.
        """
        found = self.scripts.get(k, 0)
        if found != 0:
            return found
        symbols, score, steps = list(self.text[k]), self.score, []
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                here = score.get(symbols[i] + symbols[i + 1])
                if here is not None and (best is None or here > best):
                    best, at = here, i
            if best is None:
                break
            steps.append((best, symbols[0], symbols[-1]))
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        steps.append((-np.inf, symbols[0], symbols[0]))
        self.scripts[k] = found = steps if len(symbols) == 1 else None
        return found

    def goes_with(self, a: int, b: int) -> bool:
        """Whether merging the text of two tokens gives the two: no step joins across their border.

        The steps inside each go on in their own order, the better score first and the
        left one of equals; a join across comes before an equal step on its right.
        """
        left, right = self.script(a), self.script(b)
        i = j = 0
        while True:
            step_a, _, last = left[i]
            step_b, first, _ = right[j]
            across = self.score.get(last + first)
            if across is not None and across > step_a and across >= step_b:
                return False
            if step_a >= step_b:
                if step_a == -np.inf:
                    return True
                i += 1
            else:
                j += 1

    def _tokens(self, word: str) -> list[int]:
        """Ids of a word in which every character stands in some piece."""
        last = [-1] * (len(word) + 1)
        fits, width = self.fits, len(self.text)
        for end, (size, k) in self.matches.iter(word):
            end += 1
            if last[end] >= 0:
                continue
            before = end - size
            if before:
                good = fits.get(last[before] * width + k)
                if good is None:
                    good = self._judge(last[before], k)
            else:
                good = self.script(k) is not None
            if good:
                last[end] = k
        found, at = [], len(word)
        while at:
            found.append(last[at])
            at -= self.size[last[at]]
        found.reverse()
        return found

    def _runs(self, word: str) -> Iterator[list[int]]:
        """Ids of a word by runs of known characters; others become their bytes."""
        start = 0
        for at, c in enumerate(word):
            if c not in self.ids:
                if at > start:
                    yield self._tokens(word[start:at])
                yield [self.bytes[b] for b in c.encode()]
                start = at + 1
        if start < len(word):
            yield self._tokens(word[start:])

    def word(self, word: str) -> list[int]:
        """Ids of a part of a text, its spaces as they are."""
        word = word.replace(" ", SPACE)
        found = self._tokens(word) if self.ids.keys() >= set(word) else [k for run in self._runs(word) for k in run]
        known = len(self.widths)
        if any(k >= known for k in found):
            return [x for k in found for x in ([k] if k < known else [self.bytes[b] for b in self.text[k].encode()])]
        return found

    def encode(self, text: str) -> list[int]:
        """Ids of a text, all of it as one word."""
        return self.word(" " + text) if text else []

    def learn(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian uint32s; short words of known characters go together."""
        if len(self.fits) > PAIRS:
            self.forget()
        found: list[bytes] = [b""] * len(words)
        known = self.single | {" "}
        easy = [k for k, w in enumerate(words) if len(w) <= SHORT and known.issuperset(w)]
        for at in range(0, len(easy), BLOCK):
            part = easy[at : at + BLOCK]
            for k, ids in zip(part, self.together([words[k] for k in part])):
                found[k] = ids
        for k in set(range(len(words))).difference(easy):
            found[k] = np.array(self.word(words[k]), dtype="<u4").tobytes()
        return found

    def forget(self) -> None:
        self.fits.clear()
        self.pair_keys = np.zeros(0, dtype=np.int64)
        self.pair_fits = np.zeros(0, dtype=bool)

    def _pairs(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """``goes_with`` of many pairs; pairs not met before are judged one by one."""
        width = len(self.text)
        keys = before.astype(np.int64) * width + token
        at = np.searchsorted(self.pair_keys, keys)
        held = np.zeros(len(keys), dtype=bool)
        inside = at < len(self.pair_keys)
        held[inside] = self.pair_keys[at[inside]] == keys[inside]
        if not held.all():
            new = np.unique(keys[~held])
            judged = [self._judge(*divmod(k, width)) for k in new.tolist()]
            place = np.searchsorted(self.pair_keys, new)
            self.pair_keys = np.insert(self.pair_keys, place, new)
            self.pair_fits = np.insert(self.pair_fits, place, judged)
            at = np.searchsorted(self.pair_keys, keys)
        return self.pair_fits[at]

    def _judge(self, a: int, b: int) -> bool:
        pair = a * len(self.text) + b
        good = self.fits.get(pair)
        if good is None:
            good = self.fits[pair] = self.script(b) is not None and self.goes_with(a, b)
        return good

    def _matches(self, kind: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every piece in a row of characters: start, end, id. ``stop`` ends each character's word."""
        starts, ends, tokens = [], [], []
        alive, node = np.arange(len(kind)), np.zeros(len(kind), dtype=np.int64)
        size = 0
        while len(alive):
            inside = alive + size < stop[alive]
            alive, node = alive[inside], node[inside]
            key = node * self.kinds + kind[alive + size]
            at = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
            there = self.edge_keys[at] == key
            alive, node = alive[there], self.edge_to[at[there]]
            size += 1
            token = self.node_token[node]
            held = token >= 0
            starts.append(alive[held])
            ends.append(alive[held] + size)
            tokens.append(token[held])
        return np.concatenate(starts), np.concatenate(ends), np.concatenate(tokens)

    def together(self, words: list[str]) -> list[bytes]:
        """Ids of many words of known characters, one place of all words at a time."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        stops = np.cumsum(sizes)
        begin, stop = np.repeat(stops - sizes, sizes), np.repeat(stops, sizes)
        start, end, token = self._matches(self.kind[points], stop)
        place = (end - begin[start]).astype(np.int16)
        order = np.argsort(place, kind="stable")
        start, end, token = start[order], end[order], token[order]
        edges = np.searchsorted(place[order], np.arange(1, int(sizes.max()) + 2)) if len(words) else []
        last = np.full(len(points) + 1, -1, dtype=np.int64)
        leads = start == begin[start]
        for a, b in zip(edges, edges[1:]):
            good = np.zeros(b - a, dtype=bool)
            lead = leads[a:b]
            good[lead] = self._valid(token[a:b][lead])
            good[~lead] = self._pairs(last[start[a:b][~lead]], token[a:b][~lead])
            last[end[a:b][good]] = token[a:b][good]
        # Back from the ends of the words, one token of each at a time.
        at, name, width = stops.copy(), np.arange(len(words)), np.array(self.size)
        steps = []
        first = stops - sizes
        while len(name):
            found = last[at]
            steps.append((name, found))
            at = at - width[found]
            going = at > first[name]
            at, name = at[going], name[going]
        counts = np.zeros(len(words), dtype=np.int64)
        for name, _ in steps:
            counts[name] += 1
        ends = np.cumsum(counts)
        flat = np.zeros(int(counts.sum()), dtype="<u4")
        for k, (name, found) in enumerate(steps):
            flat[ends[name] - 1 - k] = found
        data, cut = flat.tobytes(), (4 * ends).tolist()
        return [data[a:b] for a, b in zip([0, *cut], cut)]

    def _valid(self, token: np.ndarray) -> np.ndarray:
        for k in np.unique(token[self.valid[token] < 0]).tolist():
            self.valid[k] = self.script(k) is not None
        return self.valid[token] > 0

    def decode(self, ids: pa.Array, offsets: np.ndarray) -> pa.Array:
        """Texts of the rows of ids that ``offsets`` part.

        A space that opens the first piece with a text is the one that encoding put
        there and goes; control pieces have no text. Byte pieces that are not UTF-8 read as replacement characters.
        """
        number = ids.to_numpy(zero_copy_only=False)
        surface = self.surfaces.take(ids)
        ends = np.frombuffer(surface.buffers()[1], dtype=np.int64)[: len(surface) + 1]
        data = np.frombuffer(surface.buffers()[2] or b"", dtype=np.uint8)[: ends[-1]]
        said = np.append(np.flatnonzero(self.widths[number] > 0), len(number))
        first = said[np.searchsorted(said, offsets[:-1])]
        bare = np.zeros(len(offsets) - 1, dtype=bool)
        there = first < offsets[1:]
        bare[there] = self.opens[number[first[there]]]
        kept = np.ones(len(data), dtype=bool)
        kept[ends[first[bare]]] = False
        places = ends[offsets] - np.append(0, np.cumsum(bare))
        texts = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(bare), [None, pa.py_buffer(places), pa.py_buffer(data[kept])]
        )
        mute = np.flatnonzero(self.widths[number] == 0)
        if len(mute):
            # A control piece parts the byte pieces around it.
            rows = np.unique(np.searchsorted(offsets, mute, side="right") - 1)
            values = [t.decode("utf-8", "wakeline-bytewise") for t in texts.to_pylist()]
            for row in rows.tolist():
                a, b = int(offsets[row]), int(offsets[row + 1])
                cuts = [a, *mute[(mute >= a) & (mute < b)].tolist(), b]
                runs = [bytes(data[ends[i] : ends[j]]).decode("utf-8", "wakeline-bytewise") for i, j in zip(cuts, cuts[1:])]
                values[row] = "".join(runs)[int(bare[row]) :]
            return pa.array(values, pa.large_string())
        try:
            return texts.cast(pa.large_string())
        except pa.ArrowInvalid:
            return pa.array([t.decode("utf-8", "wakeline-bytewise") for t in texts.to_pylist()], pa.large_string())


def _bytewise(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


def _coded(pieces: Pieces, coder: Coder, texts: pa.Array) -> Iterator[tuple[int, int, pa.Array, np.ndarray]]:
    """Rows ``first`` to ``stop`` of some texts, their ids in a row, and the offsets that part them."""
    front, none = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
    texts = pc.replace_substring(texts.fill_null("").cast(pa.large_string()), SPACE, " ")
    texts = pc.if_else(
        pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(front, texts, none)
    )
    parts: list[np.ndarray] = []
    for rows, bounds, ends, codes in coded_texts(texts, pieces.cuts, coder):
        parts.append(codes.astype(np.int32))
        if ends:
            ids = np.concatenate(parts)
            offsets = bounds if len(parts) == 1 else np.array([0, len(ids)])
            parts = []
            yield int(rows[0]), int(rows[-1]) + 1, pa.array(ids), offsets


def _lists(ids: pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), ids)


def encode(documents: DataFrame, model: str) -> DataFrame:
    """``(doc_id, ids)`` of every row: the ids of the whole text, without begin or end.

    ``model`` is the path of the model file on the machines. A null or empty text has
    no ids; null ids of documents and repeated rows stay; an empty table gives an empty
    result. Each distinct word of a chunk is coded once, and a very long text goes
    through in parts that end between words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        coder = Coder(pieces.learn)
        for batch in batches:
            for first, stop, ids, offsets in _coded(pieces, coder, batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:stop], _lists(ids, offsets)], ["doc_id", "ids"]
                )

    return _input(documents).mapInArrow(run, "doc_id bigint, ids array<int>")


def round_trip(documents: DataFrame, model: str) -> DataFrame:
    """``(doc_id, ids, text)``: what ``decode`` reads from the ids of ``encode``, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codecs.register_error("wakeline-bytewise", _bytewise)
        pieces = Pieces(model)
        coder = Coder(pieces.learn)
        for batch in batches:
            for first, stop, ids, offsets in _coded(pieces, coder, batch.column(1)):
                texts = pieces.decode(ids, offsets).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:stop], _lists(ids, offsets), texts], ["doc_id", "ids", "text"]
                )

    return _input(documents).mapInArrow(run, "doc_id bigint, ids array<int>, text string")


def _input(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))


def decode(coded: DataFrame, model: str) -> DataFrame:
    """``(doc_id, ids, text)`` of ``coded(doc_id, ids)``.

    Null ids read as no ids, and so does a null list; an id that the file does not
    have fails, as no text is right for it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codecs.register_error("wakeline-bytewise", _bytewise)
        pieces = Pieces(model)
        for batch in batches:
            lists = batch.column(1)
            counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
            offsets = np.append(0, np.cumsum(counts, dtype=np.int64))
            texts = pieces.decode(lists.flatten(), offsets).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, texts], ["doc_id", "ids", "text"])

    return coded.select(
        F.col("doc_id").cast("bigint"), F.filter(F.col("ids").cast("array<int>"), lambda k: k.isNotNull()).alias("ids")
    ).mapInArrow(run, "doc_id bigint, ids array<int>, text string")
