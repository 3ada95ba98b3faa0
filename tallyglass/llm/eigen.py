"""Eigenvectors of a symmetric matrix beyond double precision: float32 first, then Ogita-Aishima refinement.

Every step is a few matrix products in extended precision (numpy's long double).  Eigenvalues that lie too close for a
step are rotated among themselves by a small eigenproblem of their own.
"""

from __future__ import annotations

import numpy as np

LONG = np.longdouble
# Steps double the number of right digits: 7 of float32, 14, over 19.  Clusters may need a few more.
MOST_STEPS = 12


def _norm(m: np.ndarray) -> np.longdouble:
    """A bound of the spectral norm of a symmetric matrix."""
    return np.abs(m).sum(axis=1).max() if m.size else LONG(0)


def _clusters(values: np.ndarray, gap: np.longdouble) -> list[np.ndarray]:
    """Places of values that hang together over gaps of at most ``gap``; only groups of two or more."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [np.sort(part) for part in np.split(order, cuts) if len(part) > 1]


def _step(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.longdouble, np.longdouble]:
    """One refinement: better vectors, their values, the gap below which values count as close, the correction's size."""
    n = len(a)
    r = np.eye(n, dtype=LONG) - x.T @ x
    s = x.T @ (a @ x)
    # Rounding must not tell the two halves apart: the correction keeps vectors orthogonal only where they agree.
    r, s = (r + r.T) / 2, (s + s.T) / 2
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    gap = 2 * (_norm(off) + _norm(a) * _norm(r))
    apart = values[None, :] - values[:, None]
    far = np.abs(apart) > gap
    # Close pairs are only made orthogonal; which directions they take is left to the sub-solve.
    e = np.where(far, (s + values[None, :] * r) / np.where(far, apart, 1), r / 2)
    return x + x @ e, values, gap, _norm(e)


def _solve_clusters(a: np.ndarray, x: np.ndarray, values: np.ndarray, gap: np.longdouble) -> np.ndarray:
    """Rotate the vectors of each cluster to the eigenvectors of the matrix seen from inside the cluster.

    Shifted by the cluster's middle and scaled to one, the small matrix keeps its differences in double precision.
    """
    x = x.copy()
    for places in _clusters(values, gap):
        part = x[:, places]
        inner = part.T @ (a @ part - part * values[places].mean())
        inner = (inner + inner.T) / 2
        size = _norm(inner)
        if size > 0:
            x[:, places] = part @ np.linalg.eigh((inner / size).astype(np.float64))[1].astype(LONG)
    return x


def eigenvectors(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix of long doubles.

    Each vector's entry of largest size is positive, the first of equal ones, so the result has one sign.
    """
    a = np.asarray(matrix, LONG)
    n = len(a)
    scale = np.abs(a).max() if a.size else LONG(0)
    if not scale > 0:
        return np.zeros(n), np.eye(n)
    a = (a + a.T) / 2 / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(LONG)
    done = n * np.finfo(LONG).eps * 8
    for _ in range(MOST_STEPS):
        x, values, gap, change = _step(a, x)
        x = _solve_clusters(a, x, values, gap)
        if change <= done:
            break
    # Make rotated vectors orthogonal again; the values are Rayleigh quotients.
    x = x + x @ (np.eye(n, dtype=LONG) - x.T @ x) / 2
    x = x / np.sqrt((x * x).sum(axis=0))
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    x, values = x[:, order], values[order] * scale
    sign = np.sign(x[np.abs(x.astype(np.float64)).argmax(axis=0), np.arange(n)])
    return values, x * sign
