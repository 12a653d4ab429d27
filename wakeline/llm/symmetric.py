"""Leading eigenpairs of a symmetric matrix: tridiagonal form, Sturm counts, inverse iteration."""

from __future__ import annotations

import numpy as np

#: Eigenvalues this close, relative to the matrix, have their vectors made orthogonal.
CLUSTER = 1e-3


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and the reflections (one per column) of Householder's form."""
    a = np.array(matrix, dtype=np.float64)
    n = len(a)
    mirrors = np.zeros((max(n - 2, 0), n))
    for k in range(n - 2):
        x = a[k + 1 :, k]
        scale = np.abs(x).max()
        if np.abs(x[1:]).max() <= np.finfo(float).tiny:
            continue
        v = x / scale
        v[0] += np.copysign(np.sqrt(v @ v), v[0])
        v /= np.sqrt(v @ v)
        block = a[k + 1 :, k + 1 :]
        p = block @ v
        w = 2 * (p - (v @ p) * v)
        block -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2 * v * (v @ x)
        a[k, k + 1 :] = a[k + 1 :, k]
        mirrors[k, k + 1 :] = v
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie under each number: negative pivots of the shifted matrix."""
    square = off * off
    least = np.finfo(float).tiny + np.finfo(float).eps * np.max(np.abs(off), initial=0.0) * 1e-150
    pivot = diagonal[0] - at
    count = (pivot < 0).astype(np.int64)
    for k in range(1, len(diagonal)):
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        pivot = diagonal[k] - at - square[k - 1] / pivot
        count += pivot < 0
    return count


def largest(diagonal: np.ndarray, off: np.ndarray, wanted: int) -> np.ndarray:
    """The largest eigenvalues, falling, each by bisection on Sturm counts."""
    n = len(diagonal)
    reach = np.zeros(n)
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    low, high = (diagonal - reach).min(), (diagonal + reach).max()
    room = np.finfo(float).eps * max(abs(low), abs(high)) * n + np.finfo(float).tiny
    lows, highs = np.full(wanted, low - room), np.full(wanted, high + room)
    rank = n - np.arange(wanted)
    for _ in range(1100):
        middle = lows + (highs - lows) / 2
        if ((middle <= lows) | (middle >= highs)).all():
            break
        over = below(diagonal, off, middle) >= rank
        highs = np.where(over, middle, highs)
        lows = np.where(over, lows, middle)
    return lows + (highs - lows) / 2


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    """A solution of the shifted tridiagonal system, rows exchanged where that is steadier."""
    n = len(diagonal)
    size = max(np.max(np.abs(diagonal), initial=0.0), np.max(np.abs(off), initial=0.0), np.finfo(float).tiny)
    least = np.finfo(float).eps * size
    main = (diagonal - shift).tolist()
    upper = [*off.tolist(), 0.0]
    second = [0.0] * n
    x = right.tolist()
    lower = off.tolist()
    for k in range(n - 1):
        if abs(lower[k]) > abs(main[k]):
            factor = main[k] / lower[k]
            main[k], main[k + 1], upper[k] = lower[k], upper[k] - factor * main[k + 1], main[k + 1]
            second[k], upper[k + 1] = upper[k + 1], -factor * upper[k + 1]
            x[k], x[k + 1] = x[k + 1], x[k] - factor * x[k + 1]
        else:
            if abs(main[k]) < least:
                main[k] = least
            factor = lower[k] / main[k]
            main[k + 1] -= factor * upper[k]
            x[k + 1] -= factor * x[k]
    if abs(main[-1]) < least:
        main[-1] = least
    for k in range(n - 1, -1, -1):
        known = x[k]
        if k + 1 < n:
            known -= upper[k] * x[k + 1]
        if k + 2 < n:
            known -= second[k] * x[k + 2]
        x[k] = known / main[k]
    found = np.array(x)
    return found / np.abs(found).max()


def vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of falling eigenvalues, as rows, by inverse iteration.

    Vectors of values in one cluster are made orthogonal to each other in every step.
    """
    n = len(diagonal)
    size = max(np.max(np.abs(diagonal), initial=0.0) + 2 * np.max(np.abs(off), initial=0.0), np.finfo(float).tiny)
    draw = np.random.default_rng(13)
    found = np.zeros((len(values), n))
    start = 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * size:
            start = k
        # Equal values are shifted apart a little, or each would give the same vector.
        shift = value - (k - start) * 2 * np.finfo(float).eps * size
        x = draw.standard_normal(n)
        best, least = x, np.inf
        for _ in range(8):
            for _ in range(2):
                x = x - found[start:k].T @ (found[start:k] @ x)
            x = x / np.sqrt(x @ x)
            x = _solve(diagonal, off, shift, x)
            for _ in range(2):
                x = x - found[start:k].T @ (found[start:k] @ x)
            x = x / np.sqrt(x @ x)
            y = diagonal * x
            y[:-1] += off * x[1:]
            y[1:] += off * x[:-1]
            left = np.abs(y - value * x).max()
            if left < least:
                best, least = x, left
            elif left <= 8 * np.finfo(float).eps * size:
                break
        found[k] = best
    return found


def leading(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as rows."""
    wanted = min(wanted, len(matrix))
    if not wanted:
        return np.zeros(0), np.zeros((0, len(matrix)))
    size = np.abs(matrix).max()
    if not size:
        return np.zeros(wanted), np.eye(len(matrix))[:wanted]
    diagonal, off, mirrors = tridiagonal(matrix / size)
    values = largest(diagonal, off, wanted)
    found = vectors(diagonal, off, values)
    for v in mirrors[::-1]:
        found -= 2 * np.outer(found @ v, v)
    return values * size, found
