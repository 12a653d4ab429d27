"""Exact substring dedup by suffix arrays with induced sorting.

Every byte covered by a string of ``WIDTH`` bytes that also starts in a document
with a smaller id is removed. Candidates come first: a window of ``WIDTH`` bytes is
anchored at its smallest hashed gram, and only anchors that two documents share go
on. The text around the anchors (a piece) is dealt by anchor, so equal windows
meet in one shard; a shard sorts all suffixes of its distinct pieces, but for those
alone on their anchor, and reads equal windows off the permuted common prefixes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 50
#: Bytes of an anchoring gram; a window has WIDTH - GRAM + 1 of them.
GRAM = 24
#: Bytes of text of a group of documents, about; there are as many shards of pieces.
GROUP_BYTES = 6 << 20
#: Bytes of text whose anchor hashes meet in one shard, about.
HASH_BYTES = 24 << 20
#: Bytes that are hashed at a time, few enough to stay in a core's cache.
BLOCK = 1 << 17


def stable_order(keys: np.ndarray) -> np.ndarray:
    """Places of non-negative whole numbers in rising order, equal ones as they stand.

    Key and place are sorted as one number where both fit, as numpy sorts numbers
    several times as fast as it sorts places by them.
    """
    bits = len(keys).bit_length()
    if not len(keys) or int(keys.max()) >> (64 - bits):
        return np.argsort(keys, kind="stable")
    both = (keys.astype(np.uint64) << np.uint64(bits)) | np.arange(len(keys), dtype=np.uint64)
    both.sort()
    return (both & np.uint64((1 << bits) - 1)).astype(np.int64)


def distinct(values: np.ndarray) -> np.ndarray:
    """Each value once, rising; sorted, which is faster than the hash table of ``np.unique``."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


# --- suffix arrays -----------------------------------------------------------


def _types(text: np.ndarray) -> np.ndarray:
    """True for S suffixes (smaller than their right neighbour); the end counts as smallest."""
    n = len(text)
    # Each position takes its type from the next place where the text changes.
    change = np.flatnonzero(text[1:] != text[:-1])
    rising = text[change] < text[change + 1]
    ends = np.append(change, n - 1)
    return np.repeat(np.append(rising, False), np.diff(ends, prepend=-1))


def _induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Suffix order from sorted leftmost-S suffixes ``seeds``: L suffixes, then S suffixes.

    One bucket per symbol, as arrays: a bucket is scanned in waves, since it feeds
    itself; what it feeds to others is dealt in order by a stable counting sort.
    """
    n, symbols = len(text), 256
    by_symbol = text[seeds]
    bounds = np.searchsorted(by_symbol, np.arange(symbols + 1))
    placed: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    # The end of the text is the smallest suffix of all; it feeds the last position.
    placed[int(text[n - 1])].append(np.array([n - 1]))
    large_part: list[np.ndarray] = []
    for c in range(symbols):
        waves = [np.concatenate(placed[c])] if placed[c] else []
        current = waves[0] if waves else None
        while current is not None and len(current):
            before = current[current > 0] - 1
            current = before[~small[before] & (text[before] == c)]
            if len(current):
                waves.append(current)
        own = np.concatenate(waves) if waves else np.zeros(0, dtype=np.int64)
        large_part.append(own)
        scanned = np.concatenate([own, seeds[bounds[c] : bounds[c + 1]]])
        before = scanned[scanned > 0] - 1
        before = before[~small[before]]
        symbol = text[before]
        before, symbol = before[symbol > c], symbol[symbol > c]
        _deal(before, symbol, placed)
    placed = [[] for _ in range(symbols)]
    parts: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * (2 * symbols)
    for c in range(symbols - 1, -1, -1):
        # Scanned from the largest suffix down, so kept in falling order.
        waves = [np.concatenate(placed[c])] if placed[c] else []
        current = waves[0] if waves else None
        while current is not None and len(current):
            before = current[current > 0] - 1
            current = before[small[before] & (text[before] == c)]
            if len(current):
                waves.append(current)
        own = np.concatenate(waves) if waves else np.zeros(0, dtype=np.int64)
        parts[2 * c], parts[2 * c + 1] = large_part[c], own[::-1]
        scanned = np.concatenate([own, large_part[c][::-1]])
        before = scanned[scanned > 0] - 1
        before = before[small[before]]
        symbol = text[before]
        before, symbol = before[symbol < c], symbol[symbol < c]
        _deal(before, symbol, placed)
    return np.concatenate(parts)


def _deal(rows: np.ndarray, symbol: np.ndarray, placed: list[list[np.ndarray]]) -> None:
    if not len(rows):
        return
    order = np.argsort(symbol, kind="stable")
    rows, symbol = rows[order], symbol[order]
    edges = np.flatnonzero(np.diff(symbol)) + 1
    for part, c in zip(np.split(rows, edges), symbol[np.concatenate([[0], edges])]):
        placed[int(c)].append(part)


def _name(words: np.ndarray, at: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    """Names of the leftmost-S substrings, from 1, equal for equal ones; by position."""
    stop = np.append(at[1:], n - 1) + 1
    place = np.empty(n, dtype=np.int64)
    place[at] = np.arange(len(at))
    rank = place[order]
    begin, size = order, stop[rank] - order
    differs = np.ones(len(order), dtype=bool)
    open_ = np.flatnonzero(size[1:] == size[:-1]) + 1
    differs[open_] = False
    offset = 0
    while len(open_):
        left, right = words[begin[open_] + offset], words[begin[open_ - 1] + offset]
        over = np.maximum(0, 8 - (size[open_] - offset))
        shift = (8 * np.minimum(over, 7)).astype(np.uint64)
        unequal = (left >> shift) != (right >> shift)
        differs[open_[unequal]] = True
        offset += 8
        open_ = open_[~unequal & (size[open_] > offset)]
    names = np.zeros(len(at), dtype=np.int64)
    names[rank] = np.cumsum(differs)
    return names


def _sort_names(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names, by their first ``depth`` names at least.

    The recursive step: names of pairs of neighbours, then of pairs of those. An
    alphabet of names is too large for buckets held as arrays, so each level sorts
    by (name, next name) instead of inducing.
    """
    rank, step = names.copy(), 1
    order = stable_order(rank)
    bits = len(rank).bit_length()
    while step < depth:
        following = np.zeros(len(rank), dtype=np.int64)
        following[: max(0, len(rank) - step)] = rank[step:]
        key = (rank << bits) | following
        order = stable_order(key)
        sorted_ = key[order]
        new = np.cumsum(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        rank = np.empty_like(rank)
        rank[order] = new
        step *= 2
        if new[-1] == len(rank):
            break
    return order


def eight_bytes(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, first byte highest, zeros after the end."""
    n = len(text)
    padded = np.zeros(n + 8, dtype=np.uint8)
    padded[:n] = text
    out = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        out <<= np.uint64(8)
        out |= padded[k : n + k]
    return out


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a byte array, sorted by their first ``depth`` bytes at least."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    small = _types(text)
    at = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(at):
        # Leftmost-S suffixes by first symbol only: inducing sorts their substrings.
        first = at[np.argsort(text[at], kind="stable")]
        induced = _induce(text, small, first)
        leftmost = np.zeros(n, dtype=bool)
        leftmost[at] = True
        substrings = induced[leftmost[induced]]
        names = _name(np.append(eight_bytes(text), np.zeros(8, np.uint64)), at, substrings, n)
        # Two such positions are at least two bytes apart.
        at = at[_sort_names(names, depth // 2 + 1)]
    return _induce(text, small, at)


def permuted_common_prefix(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each place in ``order`` the bytes shared with the place before, up to ``most``.

    Found in text order (each suffix against its predecessor in the array), so the
    text is read from front to back, eight bytes at a time.
    """
    words = np.append(eight_bytes(text), np.zeros(most + 8, np.uint64))
    before = np.full(len(text), -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    here = np.sort(order)
    there = before[here]
    shared = np.zeros(len(text), dtype=np.int64)
    live = np.flatnonzero(there >= 0)
    for offset in range(0, most, 8):
        differ = words[here[live] + offset] ^ words[there[live] + offset]
        ended = differ != 0
        if ended.any():
            # Leading equal bytes; float64 may round up across a power of two, so check.
            bits = np.floor(np.log2(differ[ended].astype(np.float64))).astype(np.int64)
            bits -= (np.uint64(1) << np.minimum(bits, 63).astype(np.uint64)) > differ[ended]
            shared[here[live[ended]]] = offset + (63 - bits) // 8
        live = live[~ended]
    shared[here[live]] = most
    return np.minimum(shared, most)[order]


# --- anchors -----------------------------------------------------------------


def _gram_hashes(part: np.ndarray) -> np.ndarray:
    """Hash of the gram of 24 bytes from every position on: its three words, each mixed first."""
    words = np.ndarray((len(part) - 7,), dtype="<u8", buffer=part, strides=(1,))
    words = words * np.uint64(0x9E3779B97F4A7C15)
    words ^= words >> np.uint64(32)
    m, factor = len(part) - GRAM + 1, np.uint64(0xD6E8FEB86659FD93)
    mixed = words[:m].copy()
    for k in range(8, GRAM, 8):
        mixed *= factor
        mixed += words[k : k + m]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xE9846AF9B1A615D)
    mixed ^= mixed >> np.uint64(28)
    return mixed


def anchor_runs(
    text: np.ndarray, sizes: np.ndarray, width: int = WIDTH
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, last window, hash of the anchor.

    ``text`` holds documents of the given sizes back to back; windows lie within
    one. The anchor is the leftmost gram with the smallest hash of 40 bits, so equal
    windows have equal anchors. Blocks overlap by a window.
    """
    n, grams = len(text), width - GRAM + 1
    firsts, lasts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    ends = np.cumsum(sizes)
    low = np.uint64(0xFFFFFF)
    for begin in range(0, n - width + 1, BLOCK):
        part = text[begin : min(n, begin + BLOCK + width - 1)]
        mixed = _gram_hashes(part)
        least = (mixed & ~low) | np.arange(len(mixed), dtype=np.uint64)
        span = 1
        while span * 2 <= grams:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < grams:
            least = np.minimum(least[: span - grams], least[grams - span :])
        at = (least & low).astype(np.int64)
        fits = np.zeros(len(at) + 1, dtype=np.int64)
        # Windows that would leave their document: the last width - 1 before an end.
        inner = ends[(ends > begin) & (ends < begin + len(at) + width)] - begin
        np.add.at(fits, np.clip(inner - width + 1, 0, len(at)), 1)
        np.add.at(fits, np.clip(inner, 0, len(at)), -1)
        inside = np.cumsum(fits[:-1]) == 0
        edge = np.concatenate([[True], (at[1:] != at[:-1]) | ~inside[:-1]])
        starts = np.flatnonzero(edge & inside)
        if not len(starts):
            continue
        stops = np.flatnonzero(np.append(edge[1:] | ~inside[1:], True) & inside)
        firsts.append(starts + begin)
        lasts.append(stops + begin)
        hashes.append(mixed[at[starts]] >> np.uint64(24))
    return np.concatenate(firsts), np.concatenate(lasts), np.concatenate(hashes)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; they are read back by ``_unpacked`` with their types."""
    head = struct.pack(f"<{len(arrays)}q", *(a.nbytes for a in arrays))
    return zstandard.compress(head + b"".join(a.tobytes() for a in arrays), 1)


def _unpacked(value: bytes, *kinds: str) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(value), 8 * len(kinds), []
    for size, kind in zip(struct.unpack_from(f"<{len(kinds)}q", raw), kinds):
        out.append(np.frombuffer(raw, dtype=kind, count=size // np.dtype(kind).itemsize, offset=at))
        at += size
    return out


class Group:
    """The documents of one group, concatenated, and the runs of their windows."""

    def __init__(self, table: pa.Table, width: int):
        table = table.combine_chunks()
        ids = table.column("doc_id").to_numpy()
        texts = table.column("body").to_pylist()
        order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k]))
        self.ids = ids[order].astype(np.int64)
        self.texts = [texts[k] for k in order]
        self.text = np.frombuffer(b"".join(self.texts), dtype=np.uint8)
        self.sizes = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.first, self.last, self.code = anchor_runs(self.text, self.sizes, width)
        self.doc = np.searchsorted(np.cumsum(self.sizes), self.first, side="right")

    def shared(self, others: np.ndarray) -> np.ndarray:
        """Runs whose anchor stands in two documents, here or (``others``) elsewhere."""
        if not len(self.code):
            return np.zeros(0, dtype=np.int64)
        order = stable_order(self.code)
        code, owner = self.code[order], self.ids[self.doc[order]]
        edges = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        # Documents stand by id and runs by document, so ids rise within a code.
        stops = np.append(edges[1:], len(code))
        found = owner[edges] != owner[stops - 1]
        if len(others):
            each = code[edges]
            slot = np.minimum(np.searchsorted(others, each), len(others) - 1)
            found |= others[slot] == each
        keep = np.zeros(len(code), dtype=bool)
        keep[order] = np.repeat(found, stops - edges)
        return np.flatnonzero(keep)

    def pieces(self, runs: np.ndarray, width: int):
        """Distinct pieces of the runs: piece of each run, then text, hash and least id of each."""
        raw = self.text.tobytes()
        known: dict[bytes, int] = {}
        which = np.array(
            [
                known.setdefault(raw[a : z + width], len(known))
                for a, z in zip(self.first[runs].tolist(), self.last[runs].tolist())
            ],
            dtype=np.int64,
        )
        code = np.zeros(len(known), dtype=np.uint64)
        code[which] = self.code[runs]
        least = np.full(len(known), np.iinfo(np.int64).max)
        np.minimum.at(least, which, self.ids[self.doc[runs]])
        return which, list(known), code, least


def least_ids(
    texts: list[bytes], codes: np.ndarray, owners: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """For every window of the distinct ``texts`` the least owner of an equal window.

    Windows in the order of the texts, and the number of windows of each text. Equal
    windows stand in texts of one anchor, by ``codes``; so a text alone on its anchor
    has no equal elsewhere, and only the others are sorted.
    """
    windows = np.array([len(t) for t in texts], dtype=np.int64) - width + 1
    order = stable_order(codes)
    edge = np.concatenate([[True], codes[order][1:] != codes[order][:-1], [True]])
    some = np.ones(len(texts), dtype=bool)
    some[order] = ~(edge[:-1] & edge[1:])
    out = np.repeat(owners, windows)
    met = np.flatnonzero(some)
    if len(met):
        out[np.repeat(some, windows)] = _sorted_least([texts[k] for k in met.tolist()], owners[met], width)
    return out, windows


def _sorted_least(texts: list[bytes], owners: np.ndarray, width: int) -> np.ndarray:
    """The least owner of every window by a suffix array of the texts."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    text = np.frombuffer(b"".join(texts), dtype=np.uint8)
    windows = sizes - width + 1
    begins = np.cumsum(sizes) - sizes
    piece = np.repeat(np.arange(len(texts)), windows)
    inner = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = begins[piece] + inner
    number = np.full(len(text), -1, dtype=np.int64)
    number[at] = np.arange(len(at))
    order = suffix_array(text, width)
    order = order[number[order] >= 0]
    common = permuted_common_prefix(text, order, width)
    heads = np.flatnonzero(np.concatenate([[True], common[1:] < width]))
    window = number[order]
    least = np.minimum.reduceat(owners[piece[window]], heads)
    out = np.empty(len(at), dtype=np.int64)
    out[window] = np.repeat(least, np.diff(np.append(heads, len(order))))
    return out


# --- the job -----------------------------------------------------------------

_DIGEST = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def remove_repeats(documents: DataFrame, width: int = WIDTH, groups: int | None = None) -> DataFrame:
    """Every row with what is left of its text: doc_id, n_bytes, n_removed, n_spans, kept.

    Texts are UTF-8 bytes, a null text is empty. Rows under one id do not remove
    each other. A row without an id has no smaller one and is smaller than none: it
    stays whole and removes nothing. An empty table gives an empty result.

    Documents are dealt into groups by id. A group sends the distinct hashes of its
    anchors, then the distinct pieces around anchors that it shares, and gets back
    the least id of every window; so a passage on a third of all documents is one
    hash and one piece per group.
    """
    rows = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b"")).alias("body"),
    )
    if groups is None:
        total = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
        groups = int(max(8, -(-total // GROUP_BYTES)))
    keyed = rows.filter("doc_id is not null").withColumn(
        "grp", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int")
    )
    meets = int(max(8, groups * GROUP_BYTES // HASH_BYTES))

    def parts(code: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
        shard = code % np.uint64(shards)
        order = stable_order(shard)
        return order, np.searchsorted(shard[order], np.arange(shards + 1))

    def send_hashes(key: tuple, table: pa.Table) -> pa.Table:
        codes = distinct(Group(table, width).code)
        order, edge = parts(codes, meets)
        found = [
            (s, key[0].as_py(), _packed(codes[order[edge[s] : edge[s + 1]]]))
            for s in range(meets)
            if edge[s + 1] > edge[s]
        ]
        return _table(found)

    def meet_hashes(key: tuple, table: pa.Table) -> pa.Table:
        senders = table.column("grp").to_pylist()
        lists = [_unpacked(v, "u8")[0] for v in table.column("load").to_pylist()]
        every = np.sort(np.concatenate(lists))
        twice = distinct(every[1:][every[1:] == every[:-1]])
        found = []
        for sender, codes in zip(senders, lists):
            mine = np.intersect1d(codes, twice, assume_unique=True)
            if len(mine):
                found.append((key[0].as_py(), sender, _packed(mine)))
        return _table(found)

    def others(table: pa.Table) -> np.ndarray:
        lists = [_unpacked(v, "u8")[0] for v in table.column("load").to_pylist()]
        return np.sort(np.concatenate(lists)) if lists else np.zeros(0, dtype=np.uint64)

    def send_pieces(key: tuple, docs: pa.Table, hashes: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table([])
        group = Group(docs, width)
        _, texts, code, least = group.pieces(group.shared(others(hashes)), width)
        order, edge = parts(code, groups)
        found = []
        for s in range(groups):
            mine = order[edge[s] : edge[s + 1]]
            if len(mine):
                some = [texts[k] for k in mine.tolist()]
                sizes = np.array([len(t) for t in some], dtype="<i4")
                body = np.frombuffer(b"".join(some), dtype=np.uint8)
                # Of the anchors' hashes 32 bits do: where two are taken for one, more is sorted.
                load = _packed(sizes, code[mine].astype("<u4"), least[mine], mine, body)
                found.append((s, key[0].as_py(), load))
        return _table(found)

    def meet_pieces(key: tuple, table: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        sent = []
        owner, code = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32)
        for sender, load in zip(table.column("grp").to_pylist(), table.column("load").to_pylist()):
            sizes, codes, least, mine, body = _unpacked(load, "<i4", "<u4", "<i8", "<i8", "u1")
            raw, stops = body.tobytes(), np.cumsum(sizes)
            which = np.array(
                [
                    known.setdefault(raw[b - n : b], len(known))
                    for b, n in zip(stops.tolist(), sizes.tolist())
                ],
                dtype=np.int64,
            )
            fresh = np.full(len(known) - len(owner), np.iinfo(np.int64).max)
            owner = np.concatenate([owner, fresh])
            np.minimum.at(owner, which, least)
            code = np.concatenate([code, np.zeros(len(fresh), dtype=np.uint32)])
            code[which] = codes
            sent.append((sender, mine, which, least))
        values, windows = least_ids(list(known), code, owner, width)
        begins = np.cumsum(windows) - windows
        found = []
        for sender, mine, which, least in sent:
            count = windows[which]
            piece = np.repeat(np.arange(len(which)), count)
            at = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
            value = values[begins[which][piece] + at]
            heads = np.flatnonzero(
                np.concatenate([[True], (value[1:] != value[:-1]) | (piece[1:] != piece[:-1])])
            )
            runs = np.diff(np.append(heads, len(value)))
            load = _packed(
                mine[piece[heads]], at[heads].astype("<i4"), runs.astype("<i4"), value[heads]
            )
            found.append((key[0].as_py(), sender, load))
        return _table(found)

    def finish(key: tuple, docs: pa.Table, hashes: pa.Table, values: pa.Table) -> pa.Table:
        group = Group(docs, width)
        runs = group.shared(others(hashes))
        which, texts, _, _ = group.pieces(runs, width)
        counts = np.array([len(t) - width + 1 for t in texts], dtype=np.int64)
        begins = np.cumsum(counts) - counts
        least = np.full(int(counts.sum()), np.iinfo(np.int64).max)
        for load in values.column("load").to_pylist():
            mine, at, size, value = _unpacked(load, "<i8", "<i4", "<i4", "<i8")
            start = begins[mine] + at
            place = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
            least[place] = np.repeat(value, size)
        size = counts[which]
        piece = np.repeat(np.arange(len(runs)), size)
        inner = np.arange(len(piece)) - np.repeat(np.cumsum(size) - size, size)
        repeated = least[begins[which][piece] + inner] < group.ids[group.doc[runs]][piece]
        starts = (group.first[runs][piece] + inner)[repeated]
        depth = np.zeros(len(group.text) + 1, dtype=np.int64)
        np.add.at(depth, starts, 1)
        np.add.at(depth, starts + width, -1)
        gone = np.cumsum(depth[:-1]) > 0
        kept = []
        n_removed, n_spans = [], []
        for begin, n in zip(group.begins.tolist(), group.sizes.tolist()):
            mark = gone[begin : begin + n]
            removed = int(mark.sum())
            n_removed.append(removed)
            n_spans.append(int(mark[:1].sum() + (mark[1:] & ~mark[:-1]).sum()) if removed else 0)
            body = group.text[begin : begin + n]
            kept.append((body[~mark] if removed else body).tobytes())
        return pa.table(
            {
                "doc_id": pa.array(group.ids),
                "n_bytes": pa.array(group.sizes),
                "n_removed": pa.array(n_removed, pa.int64()),
                "n_spans": pa.array(n_spans, pa.int64()),
                "kept": pa.array(kept, pa.binary()),
            }
        )

    carried = "shard int, grp int, load binary"
    hashes = (
        keyed.groupBy("grp")
        .applyInArrow(send_hashes, carried)
        .groupBy("shard")
        .applyInArrow(meet_hashes, carried)
    )
    values = (
        keyed.groupBy("grp")
        .cogroup(hashes.groupBy("grp"))
        .applyInArrow(send_pieces, carried)
        .groupBy("shard")
        .applyInArrow(meet_pieces, carried)
    )
    answers = hashes.withColumn("kind", F.lit(0)).union(values.withColumn("kind", F.lit(1)))

    def end(key: tuple, docs: pa.Table, back: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "n_spans": pa.array([], pa.int64()), "kept": pa.array([], pa.binary())})
        kind = back.column("kind").to_numpy()
        return finish(
            key, docs, back.take(np.flatnonzero(kind == 0)), back.take(np.flatnonzero(kind == 1))
        )

    done = keyed.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(end, _DIGEST)
    whole = rows.filter("doc_id is null").select(
        "doc_id",
        F.octet_length("body").cast("bigint").alias("n_bytes"),
        F.lit(0).cast("bigint").alias("n_removed"),
        F.lit(0).cast("bigint").alias("n_spans"),
        F.col("body").alias("kept"),
    )
    return done.union(whole)


def _table(rows: list[tuple]) -> pa.Table:
    shard, grp, load = zip(*rows) if rows else ((), (), ())
    return pa.table(
        {
            "shard": pa.array(shard, pa.int32()),
            "grp": pa.array(grp, pa.int32()),
            "load": pa.array(load, pa.binary()),
        }
    )
