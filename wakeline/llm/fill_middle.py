"""Fill-in-the-middle documents, cut through a learned index of token borders.

Where the tokens of a batch end is a rising sequence. Straight segments, each within
an error bound of the true offsets, predict the offset of any rank; what a prediction
misses is stored in one byte per border, so the corrected offset is exact and the
offsets themselves need not be kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.words import Cuts, column_bytes

#: White space between tokens, and the marks of prefix, suffix and middle.
WHITE = b" \t\n\v\f\r"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: How far a segment may be off before rounding; residuals then fit a byte.
ERROR = 120
#: Borders looked at in one step of a segment, and bytes of text indexed at a time.
WINDOW, CHUNK = 512, 1 << 24


def segments(offsets: np.ndarray, error: float = ERROR) -> tuple[np.ndarray, np.ndarray]:
    """First rank and slope of segments that pass within ``error`` of all offsets.

    Each starts on a border and goes on as long as one slope serves all borders in
    it: every border narrows the cone of slopes that pass near enough.
    """
    first, slopes = [], []
    start, n = 0, len(offsets)
    while start < n:
        low, high, at = -np.inf, np.inf, start + 1
        slope = 0.0
        while at < n:
            stop = min(at + WINDOW, n)
            run = np.arange(at - start, stop - start, dtype=np.float64)
            rise = offsets[at:stop] - offsets[start]
            lows = np.maximum.accumulate(np.maximum((rise - error) / run, low))
            highs = np.minimum.accumulate(np.minimum((rise + error) / run, high))
            closed = np.flatnonzero(lows > highs)
            fits = int(closed[0]) if len(closed) else stop - at
            if fits:
                low, high = lows[fits - 1], highs[fits - 1]
                slope = (low + high) / 2
            at += fits
            if len(closed):
                break
        first.append(start)
        slopes.append(slope)
        start = at
    return np.array(first, dtype=np.int64), np.array(slopes)


class RankIndex:
    """Offsets by rank, kept as segments and one-byte residuals."""

    def __init__(self) -> None:
        self.first: list[np.ndarray] = []
        self.base: list[np.ndarray] = []
        self.slope: list[np.ndarray] = []
        self.residual: list[np.ndarray] = []
        self.count = 0

    def add(self, offsets: np.ndarray) -> None:
        """More offsets, not below the ones before."""
        if not len(offsets):
            return
        first, slope = segments(offsets)
        which = np.searchsorted(first, np.arange(len(offsets)), side="right") - 1
        ranks = np.arange(len(offsets)) - first[which]
        missed = offsets - (offsets[first[which]] + np.rint(slope[which] * ranks).astype(np.int64))
        self.residual.append(missed.astype(np.int8))
        self.first.append(first + self.count)
        self.base.append(offsets[first])
        self.slope.append(slope)
        self.count += len(offsets)

    def close(self) -> RankIndex:
        self.firsts, self.bases = np.concatenate(self.first), np.concatenate(self.base)
        self.slopes, self.residuals = np.concatenate(self.slope), np.concatenate(self.residual)
        return self

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """The exact offset of each rank: predicted, then corrected."""
        which = np.searchsorted(self.firsts, ranks, side="right") - 1
        predicted = self.bases[which] + np.rint(self.slopes[which] * (ranks - self.firsts[which])).astype(np.int64)
        return predicted + self.residuals[ranks]


def token_cuts() -> Cuts:
    """Tokens start at white space behind anything else."""
    classes = np.zeros(256, dtype=np.uint8)
    classes[list(WHITE)] = 1
    return Cuts(classes, np.array([[False, True], [False, False]]))


def index_rows(data: np.ndarray, offsets: np.ndarray, cuts: Cuts) -> tuple[RankIndex, np.ndarray, np.ndarray]:
    """Index of all borders of some rows' bytes, the rank each row starts at, and its tokens.

    ``offsets`` part the rows and start at 0; rows that touch share a border.
    """
    index = RankIndex()
    ranks = np.zeros(len(offsets), dtype=np.int64)
    for at in range(0, max(len(data), 1), CHUNK):
        stop = min(at + CHUNK, len(data))
        marks = cuts.marks(data[max(at - 1, 0) : stop])[1 if at else 0 :]
        inside = (offsets >= at) & (offsets < stop)
        marks[offsets[inside] - at] = True
        borders = at + np.flatnonzero(marks)
        ranks[inside] = index.count + np.searchsorted(borders, offsets[inside])
        index.add(borders)
    ranks[offsets == len(data)] = index.count
    index.add(np.array([len(data)]))
    return index.close(), ranks[:-1], np.diff(ranks)


def draws(seed: int) -> list[Column]:
    """Four numbers below 2^32 from the seed and doc_id; a null id counts as an empty one."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    code = F.sha2(key, 256)
    return [F.conv(F.substring(code, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def fill_in_middle(documents: DataFrame, seed: int = 42, plain: int = 50, suffix_first: int = 80) -> DataFrame:
    """Every row cut in prefix, middle and suffix and put in order for training.

    doc_id, n (tokens), form, prefix_chars, suffix_chars and middle_chars (code points)
    and output. A token is a run of other characters with the white space before it,
    or white space at the end. Both cuts are drawn per document from all token
    borders. ``plain`` of 100 documents stay as they are, and of the others
    ``suffix_first`` of 100 have the suffix in front (spm, else psm). Empty and null
    texts (an empty text) and texts that hold a mark themselves stay plain, without
    counts of characters. Repeated rows get the same result, rows without an id that
    of an empty id; an empty table gives an empty result. Texts are taken whole; a
    text longer than ``CHUNK`` bytes is indexed in parts.
    """
    h1, h2, h3, h4 = draws(seed)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = (
        F.when((text == "") | marked | (h3 % 100 >= plain), "plain")
        .when(h4 % 100 < suffix_first, "spm")
        .otherwise("psm")
    )
    frame = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        text.alias("text"),
        form.alias("form"),
        h1.alias("h1"),
        h2.alias("h2"),
    )
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = token_cuts()
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            forms = batch.column(2).to_pylist()
            h1, h2 = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4))
            row = 0
            while row < batch.num_rows:
                stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
                part = data[offsets[row] : offsets[stop]]
                bounds = offsets[row : stop + 1] - offsets[row]
                index, first, n = index_rows(part, bounds, cuts)
                a, b = h1[row:stop] % (n + 1), h2[row:stop] % (n + 1)
                left = index.offsets(first + np.minimum(a, b)).tolist()
                right = index.offsets(first + np.maximum(a, b)).tolist()
                view, leads = memoryview(part), (part & 0xC0) != 0x80
                count = lambda x, y: int(np.count_nonzero(leads[x:y]))
                outputs, sizes = [], []
                edges = bounds.tolist()
                for start, p, m, end, kind in zip(edges, left, right, edges[1:], forms[row:stop]):
                    if kind == "plain":
                        outputs.append(bytes(view[start:end]))
                        sizes.append((None, None, None))
                        continue
                    before, middle, after = view[start:p], view[p:m], view[m:end]
                    if kind == "psm":
                        outputs.append(b"".join((marks[0], before, marks[1], after, marks[2], middle)))
                    else:
                        outputs.append(b"".join((marks[1], after, marks[0], before, marks[2], middle)))
                    sizes.append((count(start, p), count(m, end), count(p, m)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[row:stop],
                        pa.array(n),
                        batch.column(2)[row:stop],
                        *[pa.array([s[k] for s in sizes], pa.int64()) for k in range(3)],
                        pa.array(outputs, pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "n", "form", "prefix_chars", "suffix_chars", "middle_chars", "output"],
                )
                row = stop

    return frame.mapInArrow(
        run,
        "doc_id bigint, n bigint, form string, prefix_chars bigint, suffix_chars bigint,"
        " middle_chars bigint, output string",
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda k: F.get(parts, F.lit(k))
    return (
        F.when(form == "psm", F.concat(part(1), part(3), part(2)))
        .when(form == "spm", F.concat(part(2), part(3), part(1)))
        .otherwise(output)
    )
