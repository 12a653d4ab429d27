"""Quality classifier: a support vector machine on naive Bayes features.

An indicator of each n-gram is scaled by the log ratio of its frequencies in the
two classes; on these vectors a linear hinge-loss model is fitted by dual
coordinate descent. N-grams are word unigrams and bigrams, and the same over word
shapes (case, closing mark, repetition), the latter with their share of the text.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import given_back

#: Hashed n-gram space.
DIMENSIONS = 1 << 18
#: Labelled rows the model is fitted on, at most.
TRAINING_ROWS = 6000
#: A row is predicted as good from this score on.
THRESHOLD = 0.7
#: Characters of a text looked at in one go; words whose shapes a task remembers.
BLOCK, WORDS_KEPT = 1 << 20, 200_000
SHARES = (0.01, 0.03, 0.1, 0.3, 0.6)


class _Shapes(dict):
    """Word to shape: letter case, and the closing mark with its run length."""

    def __missing__(self, word: str) -> str:
        if len(self) > WORDS_KEPT:
            self.clear()
        body = word.rstrip("!?.,;:*#%&$|/\\-_=+~^@<>()[]{}\"'")
        tail = word[len(body) :]
        if not body:
            case = "s"
        elif body.isdigit():
            case = "n"
        elif len(body) > 1 and body.isupper():
            case = "u"
        elif body.islower():
            case = "l"
        else:
            case = "t"
        shape = case + tail[-1:] + str(min(len(tail), 3))
        self[word] = shape
        return shape


def ngrams(text: str | None, shapes: _Shapes) -> np.ndarray:
    """Distinct hashed n-grams of a whole text, sorted; a blank text has one of its own."""
    crc, mask = zlib.crc32, DIMENSIONS - 1
    found: set[int] = set()
    forms: Counter = Counter()
    pairs: set = set()
    total = same = 0
    text = text or ""
    at, last = 0, None
    while at < len(text):
        cut = text.find(" ", at + BLOCK) if len(text) - at > BLOCK else -1
        stop = cut if cut >= 0 else len(text)
        words = text[at:stop].split()
        at = stop + 1 if cut >= 0 else stop
        if not words:
            continue
        chained = [last, *words] if last is not None else words
        last = words[-1]
        total += len(words)
        same += sum(map(eq, chained, islice(chained, 1, None)))
        kinds = list(map(shapes.__getitem__, words))
        forms.update(kinds)
        pairs.update(zip(kinds, islice(kinds, 1, None)))
        low = [w.encode("utf-8", "surrogatepass") for w in map(str.lower, chained)]
        found.update(crc(w) & mask for w in set(low))
        found.update(crc(b"%b %b" % p) & mask for p in set(zip(low, islice(low, 1, None))))
    if not total:
        return np.array([crc(b"#blank") & mask], dtype=np.int32)
    shares = [*((f"#{k}", n) for k, n in forms.items()), ("#same", same)]
    for name, n in shares:
        level = sum(n / total >= edge for edge in SHARES)
        found.update(crc(f"{name}>{k}".encode()) & mask for k in range(level + 1))
    found.update(crc(f"#{a} {b}".encode()) & mask for a, b in pairs)
    return np.array(sorted(found), dtype=np.int32)


def logistic(margin: np.ndarray, slope: float, shift: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))


@dataclass
class Model:
    """Log-count ratios, weights on the scaled indicators, and the score's slope and shift."""

    ratio: np.ndarray
    weight: np.ndarray
    slope: float
    shift: float

    def margin(self, ids: np.ndarray) -> float:
        ratio = self.ratio[ids]
        return float((self.weight[ids] * ratio).sum() / (np.sqrt((ratio * ratio).sum()) + 1e-12))



def log_ratios(rows: list[np.ndarray], good: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log of the n-gram's share in the good class over its share in the bad one."""
    counts = np.full((2, DIMENSIONS), smooth)
    for ids, y in zip(rows, good):
        counts[int(y), ids] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0]).astype(np.float32)


def coordinate_descent(
    rows: list[np.ndarray], ratio: np.ndarray, good: np.ndarray, cost: float = 1.0, epochs: int = 12
) -> np.ndarray:
    """Weights of the linear hinge-loss model, one dual variable at a time.

    Each vector has length one, so its own dual step has curvature one. Classes
    weigh the same in the cost.
    """
    values = []
    for ids in rows:
        v = ratio[ids]
        values.append(v / (np.sqrt((v * v).sum()) + 1e-12))
    share = np.array([(~good).mean(), good.mean()])
    bound = cost / (2 * np.maximum(share, 1e-6))
    dual, weight = np.zeros(len(rows)), np.zeros(len(ratio))
    sign = np.where(good, 1.0, -1.0)
    shuffle = np.random.default_rng(7)
    for _ in range(epochs):
        largest = 0.0
        for i in shuffle.permutation(len(rows)):
            gradient = sign[i] * (weight[rows[i]] @ values[i]) - 1
            new = min(max(dual[i] - gradient, 0.0), bound[int(good[i])])
            if new != dual[i]:
                step = (new - dual[i]) * sign[i]
                weight[rows[i]] += step * values[i]
                largest = max(largest, abs(step))
                dual[i] = new
        if largest < 1e-3:
            break
    return weight.astype(np.float32)


def fit_score(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic score, by Newton steps with a small penalty."""
    slope, shift = 1.0, 0.0
    target = np.where(good, 1 - 1 / (good.sum() + 2), 1 / ((~good).sum() + 2))
    for _ in range(50):
        p = logistic(margin, slope, shift)
        d, h = p - target, p * (1 - p) + 1e-9
        gradient = np.array([(d * margin).sum() + 1e-3 * slope, d.sum()])
        cross = (h * margin).sum()
        hessian = np.array([[(h * margin * margin).sum() + 1e-3, cross], [cross, h.sum()]])
        move = np.linalg.solve(hessian + 1e-9 * np.eye(2), gradient)
        move *= min(1.0, 4.0 / (np.abs(move).max() + 1e-12))
        slope, shift = slope - move[0], shift - move[1]
        if np.abs(move).max() < 1e-6:
            break
    return float(slope), float(shift)


def fit(rows: list[np.ndarray], good: np.ndarray) -> Model:
    """A model of labelled n-gram sets.

    A fifth of the rows is kept aside for the score. With one class only, every
    row scores that class; without rows every score is one half.
    """
    if not len(rows) or good.all() or not good.any():
        shift = 0.0 if not len(rows) else (4.0 if good.all() else -4.0)
        zero = np.zeros(DIMENSIONS, dtype=np.float32)
        return Model(zero, zero, 0.0, shift)
    aside = np.arange(len(rows)) % 5 == 0
    if len(set(good[aside])) < 2 or len(set(good[~aside])) < 2:
        aside[:] = False
    train = [r for r, a in zip(rows, aside) if not a]
    ratio = log_ratios(train, good[~aside])
    model = Model(ratio, coordinate_descent(train, ratio, good[~aside]), 1.0, 0.0)
    judged = aside if aside.any() else ~aside
    margin = np.array([model.margin(r) for r, a in zip(rows, judged) if a])
    model.slope, model.shift = fit_score(margin, good[judged])
    return model


def held_out() -> Column:
    """Rows kept from training: crc32 of doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """Fit on at most ``rows`` labelled rows that are not held out, chosen by a hash.

    Labels that are null or contradict each other are left out. A document's text
    is the only input, and every n-gram of it counts. The driver sees at most
    ``rows`` sets of ``DIMENSIONS`` numbers, in practice the distinct n-grams of a
    document each.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("bigint"), F.col("quality").cast("int"))
        .filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .filter("quality = most")
        .select("doc_id", "quality")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = _Shapes()
        for batch in batches:
            sets = []
            for text in batch.column(2):
                sets.append(ngrams(text.as_py(), shapes))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int32()))],
                ["doc_id", "quality", "ids"],
            )

    found = (
        documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "quality", "text")
        .mapInArrow(lambda batches: given_back(run(batches)), "doc_id bigint, quality int, ids array<int>")
    )
    # Documents may repeat an id; the bound holds for rows all the same.
    table = found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).toArrow()
    sets = [np.array(x, dtype=np.int32) for x in table.column("ids").to_pylist()]
    return fit(sets, table.column("quality").to_numpy().astype(bool))


def add_scores(documents: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns and rows of ``documents``, and ``name``: 0 to 1, likelier good when higher.

    A column that has that name already gives way. Null and empty texts are scored
    like any other: by the n-gram of blank texts. Repeated rows score the same; an
    empty table gives an empty result. Only texts go to Python and only scores come
    back; the other columns stay in Spark, whatever their types.
    """
    inner = (model.weight * model.ratio).astype(np.float32)
    square = (model.ratio * model.ratio).astype(np.float32)
    slope, shift = model.slope, model.shift

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shapes = _Shapes()
        for texts in batches:
            margins = np.zeros(len(texts))
            for k, text in enumerate(texts):
                ids = ngrams(text.as_py(), shapes)
                norm = np.sqrt(square[ids].sum(dtype=np.float64)) + 1e-12
                margins[k] = inner[ids].sum(dtype=np.float64) / norm
            del texts
            yield pa.array(logistic(margins, slope, shift))

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from given_back(run(texts))

    kept = [F.col(f"`{c}`") for c in documents.columns if c.lower() != name.lower()]
    return documents.select(*kept, score(F.col("text").cast("string")).alias(name))
