"""Whitened vectors against numpy, and the eigenpairs of hard matrices."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.llm import queries, symmetric, whitening

DATA = "/root/testdata/sf0.001"


def check(rows, given, components=4):
    """Rows of one length against a plain version."""
    x = {i: np.floor(256 * np.asarray(v, dtype=np.float64)).astype(np.int64) for i, v in given.items()}
    fit = np.unique(np.stack(list(x.values())), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    found = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(found) == len(rows) == len(given) * len(values)
    for k in range(len(values)):
        mine = np.array([found[i, k + 1]["whitened"] for i in given])
        wanted = np.array([(x[i] - sums / n) @ vectors[:, k] for i in given]) / np.sqrt(values[k])
        sign = np.sign(mine @ wanted)
        assert np.abs(mine - sign * wanted).max() < 1e-6
        for i in given:
            r = found[i, k + 1]
            assert r["n"] == n and r["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums))
            assert abs(r["explained"] / (values[k] / np.trace(centred.T @ centred / n)) - 1) < 1e-9
            assert r["identity_error"] < 1e-9


def test_given_embeddings(spark):
    given = dict(duckdb.sql(f"select vec_id, embedding from '{DATA}/embeddings.parquet'").fetchall())
    check(queries.op13_whitening(spark, DATA).collect(), given)


def test_awkward_vectors(spark):
    rng = np.random.default_rng(1)
    good = {k: rng.standard_normal(6).tolist() for k in range(50)}
    rows = [*good.items(), *list(good.items())[:20] * 5, (None, good[0])]
    rows += [(900, None), (901, [1.0, None] * 3), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, [])]
    # A length of its own; without variance there is no component.
    rows += [(905, [1.0, 2.0]), (906, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id int, embedding array<double>").withColumn("x", F.lit(1))
    found = whitening.whiten(frame).collect()
    assert len(found) == 4 * (50 + 100 + 1)
    kept = {(r["vec_id"], r["component"]): r for r in found if r["vec_id"] is not None}
    check(list(kept.values()), good)
    assert whitening.whiten(frame.limit(0)).count() == 0
    assert whitening.whiten(frame.filter("vec_id >= 900")).count() == 0
    shuffled = whitening.whiten(frame.repartition(7)).collect()
    assert {(r["vec_id"], r["deviation"]) for r in shuffled} == {(r["vec_id"], r["deviation"]) for r in found}


def test_large_numbers(spark):
    rows = [(k, [1e15 + 1e11 * k, float(k), 0.0]) for k in range(9)]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id int, embedding array<double>")).collect()
    assert {r["component"] for r in out} == {1} and {r["deviation"] for r in out if r["vec_id"] != 4} == {None}
    few = [(k, [1e6 * k, 3.0]) for k in range(3)]
    out = whitening.whiten(spark.createDataFrame(few, "vec_id int, embedding array<double>")).collect()
    assert [r["deviation"] for r in sorted(out)] == [(3 * 256_000_000) ** 2, 0, (3 * 256_000_000) ** 2]


MATRICES = {
    "random": lambda n, r: (lambda a: a @ a.T)(r.standard_normal((n, n))),
    "identity": lambda n, r: np.eye(n),
    "clusters": lambda n, r: (lambda q: q @ np.diag(np.repeat([5, 5 - 1e-13, 1], [3, 3, n - 6])) @ q.T)(
        np.linalg.qr(r.standard_normal((n, n)))[0]
    ),
    "split": lambda n, r: np.kron(np.eye(2), (lambda a: a @ a.T)(r.standard_normal((n // 2, n // 2)))),
    "graded": lambda n, r: np.diag(10.0 ** -np.arange(n)),
    "rank one": lambda n, r: np.outer(np.arange(n), np.arange(n)).astype(float),
    "zero": lambda n, r: np.zeros((n, n)),
    "negative": lambda n, r: (lambda a: a + a.T)(r.standard_normal((n, n))),
    "tiny": lambda n, r: 1e-200 * (lambda a: a @ a.T)(r.standard_normal((n, n))),
}


@pytest.mark.parametrize("name", MATRICES)
@pytest.mark.parametrize("n", [8, 64])
def test_leading_pairs(name, n):
    matrix = MATRICES[name](n, np.random.default_rng(n))
    values, vectors = symmetric.leading(matrix, 6)
    size = max(np.abs(matrix).max(), 1e-300) * n
    assert np.abs(values - np.linalg.eigvalsh(matrix)[::-1][:6]).max() <= 1e-13 * size
    assert np.abs(vectors @ vectors.T - np.eye(6)).max() < 1e-12
    assert np.abs(matrix @ vectors.T - vectors.T * values).max() <= 1e-12 * size


def test_small_matrices():
    for n in range(4):
        a = np.random.default_rng(n).standard_normal((n, n))
        values, vectors = symmetric.leading(a @ a.T, 4)
        assert len(values) == n
        if n:
            assert np.allclose(a @ a.T @ vectors.T, vectors.T * values)


def test_partial_sums_in_two_steps(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rng = np.random.default_rng(2)
    given = {k: rng.standard_normal(5).tolist() for k in range(200)}
    frame = spark.createDataFrame(list(given.items()), "vec_id int, embedding array<double>").repartition(9)
    check(whitening.whiten(frame).collect(), given)
