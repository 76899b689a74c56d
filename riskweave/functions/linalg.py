"""Symmetric matrices of assets on the driver: numpy with the engine's conventions (ascending eigenvalues, eigenvectors as rows)."""

from __future__ import annotations

import numpy as np

from riskweave.errors import NotPositiveDefinite, NotSquare, NotSymmetric, RankDeficient


def dimension(matrix) -> int:
    m = np.asarray(matrix, float)
    if m.ndim != 2 or m.shape[0] != m.shape[1] or not m.size:
        raise NotSquare(f"shape {m.shape}")
    return len(m)


def check_symmetric(matrix, *, tolerance: float = 1e-12) -> int:
    n, m = dimension(matrix), np.asarray(matrix, float)
    if np.abs(m - m.T).max() > tolerance * max(np.abs(m).max(), 1e-300):
        raise NotSymmetric("the two halves differ")
    return n


def symmetrise(matrix) -> np.ndarray:
    dimension(matrix)
    m = np.asarray(matrix, float)
    return (m + m.T) / 2


def identity(size: int) -> np.ndarray:
    return np.eye(size)


def eigh(matrix) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues and unit eigenvectors as rows; each vector's largest entry is positive."""
    check_symmetric(matrix)
    values, vectors = np.linalg.eigh(symmetrise(matrix))
    vectors = vectors.T
    top = vectors[np.arange(len(values)), np.abs(vectors).argmax(axis=1)]
    return values, vectors * np.where(top < 0, -1.0, 1.0)[:, None]


def eigenvalues(matrix) -> np.ndarray:
    return eigh(matrix)[0]


def reconstruct(values, vectors) -> np.ndarray:
    v = np.asarray(vectors, float)
    return v.T @ (np.asarray(values, float)[:, None] * v)


def condition_number(matrix) -> float:
    w = np.abs(eigenvalues(matrix))
    return float(w.max() / w.min()) if w.min() > 0 else float("inf")


def is_positive_semidefinite(matrix, *, tolerance: float | None = None) -> bool:
    w = eigenvalues(matrix)
    return bool(w.min() >= -(1e-12 * np.abs(w).max() if tolerance is None else tolerance))


def nearest_psd(matrix, *, floor: float = 0.0) -> np.ndarray:
    values, vectors = eigh(matrix)
    return symmetrise(reconstruct(np.maximum(values, floor), vectors))


def cholesky(matrix) -> np.ndarray:
    check_symmetric(matrix)
    try:
        return np.linalg.cholesky(symmetrise(matrix))
    except np.linalg.LinAlgError as e:
        raise NotPositiveDefinite(str(e)) from None


def quadratic_form(weights, matrix) -> float:
    w = np.asarray(weights, float)
    return float(w @ np.asarray(matrix, float) @ w)


def matrix_vector(matrix, vector) -> np.ndarray:
    return np.asarray(matrix, float) @ np.asarray(vector, float)


def solve_upper(upper, target) -> np.ndarray:
    u = np.asarray(upper, float)
    if (np.diag(u) == 0).any():
        raise RankDeficient("a zero on the diagonal")
    return np.linalg.solve(u, np.asarray(target, float))


def least_squares(design, target) -> tuple[np.ndarray, np.ndarray]:
    """(beta, R) by QR; a dependent column is refused."""
    x, y = np.asarray(design, float), np.asarray(target, float)
    if x.shape[0] < x.shape[1]:
        raise RankDeficient("fewer rows than columns")
    q, r = np.linalg.qr(x)
    scale = np.sqrt((x * x).sum(axis=0)).max() if x.size else 0.0
    if (np.abs(np.diag(r)) <= scale * np.sqrt(len(x)) * 1e-14).any():
        raise RankDeficient("the columns are not independent")
    return solve_upper(r, q.T @ y), r


def upper_inverse_gram(upper) -> np.ndarray:
    """(R'R)^-1."""
    inverse = np.linalg.inv(np.asarray(upper, float))
    return inverse @ inverse.T
