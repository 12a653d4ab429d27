"""Whitening of vectors by the leading components of their covariance.

Entries become whole numbers, so sums are exact. The fit list is each distinct vector
once. Its sums and its centred covariance come from the cluster, a row of the matrix
at a time; the driver finds the leading components of that matrix, whose size depends
on the dimensions alone, and sends them back for the projection.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import settle
from wakeline.llm.symmetric import leading

#: Whole steps in one, and components of a vector.
SCALE, COMPONENTS = 256, 4
#: Partial sums that one task adds up; what is left of them is added up once more.
FAN_IN = 512
LONGEST = (1 << 63) - 1


@dataclass
class Model:
    """Of the vectors of one length: count, exact sums, mean, and what projects and tells of them."""

    n: int
    sums: list[int]
    mean: np.ndarray
    project: np.ndarray
    explained: np.ndarray
    error: float = 0.0


def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(vec_id, x)`` of vectors that are there and finite: the floor of each entry times ``scale``."""
    v = F.col("embedding").cast("array<double>")
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return (
        vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))
        .filter(F.col("v").isNotNull() & F.coalesce(F.forall("v", fine), F.lit(False)))
        .select("vec_id", F.transform("v", lambda c: F.floor(c * scale).cast("bigint")).alias("x"))
    )


def _by_length(lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, row numbers and matrix of the vectors of each length in a column."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        yield size, rows, flat[starts[rows][:, None] + np.arange(size)]


def _sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Count and exact sums of each length. High and low halves are added up apart, so none overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in batches:
            for size, rows, x in _by_length(batch.column(0)):
                held = totals.setdefault(size, [0, np.zeros(size, np.int64), np.zeros(size, np.int64)])
                held[0] += len(rows)
                held[1] += (x >> 32).sum(axis=0)
                held[2] += (x & 0xFFFFFFFF).sum(axis=0)
        for size, (n, high, low) in totals.items():
            place = [np.full(size, size, np.int32), np.arange(size, dtype=np.int32), np.full(size, n, np.int64)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a) for a in (*place, high, low)], ["size", "i", "n", "high", "low"]
            )

    parts = fit.mapInArrow(run, "size int, i int, n bigint, high bigint, low bigint")
    found: dict[int, tuple[int, list[int]]] = {}
    total = parts.groupBy("size", "i").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")])
    for r in total.orderBy("size", "i").collect():
        found.setdefault(r["size"], (r["n"], []))[1].append((r["high"] << 32) + r["low"])
    return found


def _add_up(parts: DataFrame) -> DataFrame:
    """Sums of ``row`` for each (size, i), in two steps so that no task holds all partial ones."""

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        rows = np.stack([np.asarray(r) for r in table.column("row").to_pylist()])
        first = table.slice(0, 1)
        return first.set_column(3, "row", pa.array([rows.sum(axis=0).tolist()], pa.list_(pa.float64())))

    kind = "size int, i int, part int, row array<double>"
    some = parts.groupBy("size", "i", F.floor(F.col("part") / FAN_IN).alias("some")).applyInArrow(one, kind)
    return some.groupBy("size", "i").applyInArrow(one, kind)


def covariance(fit: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """The covariance of each length: centred first, then multiplied, divided by the count."""
    means = {size: np.array([s / n for s in total]) for size, (n, total) in sums.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, _, x in _by_length(batch.column(0)):
                c = x - means[size]
                totals[size] = totals.get(size, 0) + c.T @ c
        part = TaskContext.get().partitionId()
        for size, total in totals.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(size, size, np.int32)),
                    pa.array(np.arange(size, dtype=np.int32)),
                    pa.array(np.full(size, part, np.int32)),
                    pa.array([total[k, k:] for k in range(size)], pa.list_(pa.float64())),
                ],
                ["size", "i", "part", "row"],
            )

    parts = fit.mapInArrow(run, "size int, i int, part int, row array<double>")
    found = {size: np.zeros((size, size)) for size in sums}
    for r in _add_up(parts).collect():
        found[r["size"]][r["i"], r["i"] :] = r["row"]
    for size, matrix in found.items():
        matrix += np.triu(matrix, 1).T
        matrix /= sums[size][0]
    return found


def fit_models(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """A model for each length of the settled ``fit(x)``, whose rows are distinct.

    Components without variance, up to rounding, are left out. The error of each
    model is measured: the covariance of the whitened fit list against the identity.
    """
    sums = _sums(fit)
    models: dict[int, Model] = {}
    for size, matrix in (covariance(fit, sums) if sums else {}).items():
        values, vectors = leading(matrix, components)
        n, total = sums[size]
        least = 8 * size * np.finfo(float).eps * max(np.trace(matrix), 0.0)
        held = values > least
        project = (vectors[held] / np.sqrt(values[held])[:, None]).T
        share = values[held] / np.trace(matrix) if held.any() else values[held]
        models[size] = Model(n, total, np.array([s / n for s in total]), project, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, _, x in _by_length(batch.column(0)):
                w = (x - models[size].mean) @ models[size].project
                totals[size] = totals.get(size, 0) + w.T @ w
        for size, total in totals.items():
            a, b = np.indices(total.shape).reshape(2, -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(total.size, size, np.int32)), pa.array(a), pa.array(b), pa.array(total.ravel())],
                ["size", "a", "b", "v"],
            )

    if models:
        parts = fit.mapInArrow(run, "size int, a int, b int, v double")
        for r in parts.groupBy("size", "a", "b").agg(F.sum("v").alias("v")).collect():
            model = models[r["size"]]
            model.error = max(model.error, abs(r["v"] / model.n - (r["a"] == r["b"])))
    return models


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact squared distance of n times each vector from the sums; null beyond a long."""
    largest = int(np.abs(x.astype(np.float64)).max(initial=0.0)) + 1
    reach = n * largest + max(map(abs, sums), default=0)
    if x.shape[1] * reach * reach <= LONGEST:
        far = n * x - np.array(sums, dtype=np.int64)
        return (far * far).sum(axis=1).tolist()
    found = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
    return [d if d <= LONGEST else None for d in found]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``components`` rows for each vector of ``vectors(vec_id, embedding)``, or as many as there are.

    vec_id, component (from 1, falling variance), n (distinct vectors), deviation,
    whitened, explained (share of the variance) and identity_error. Vectors that are
    null or hold null or non-finite entries take no part. Vectors of different
    lengths are whitened among their equals, each length with a model of its own on
    the driver. Repeated vectors count once in the fit and all get rows; rows with a null
    vec_id stay; a component without variance has no row, so a single vector has
    none; empty tables and empty vectors give none.
    """
    rows = whole_numbers(vectors)
    models = fit_models(settle(rows.select("x").distinct()), components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, at, x in _by_length(batch.column(1)):
                model = models[size]
                k = model.project.shape[1]
                if not k:
                    continue
                white = (x - model.mean) @ model.project
                count = len(at) * k
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(at, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                        pa.array(np.full(count, model.n, np.int64)),
                        pa.array(_deviations(x, model.n, model.sums), pa.int64()).take(
                            pa.array(np.repeat(np.arange(len(at)), k))
                        ),
                        pa.array(white.ravel()),
                        pa.array(np.tile(model.explained, len(at))),
                        pa.array(np.full(count, model.error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(
        run,
        "vec_id bigint, component int, n bigint, deviation bigint, whitened double,"
        " explained double, identity_error double",
    )
