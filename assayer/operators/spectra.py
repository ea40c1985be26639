"""Spectra of softmax Fisher matrices and of weighted projections, one row at a time in NumPy.

The Fisher matrix over a vocabulary is a diagonal less a rank-one matrix, so its eigenvalues are the roots of a secular equation,
one between each two neighbouring probabilities; no dense matrix is made. Leading directions of larger matrices come from a range
finder: random directions, powers, orthonormal bases by reflections, and a small dense problem.
"""

from __future__ import annotations

import numpy as np

_HALVINGS, _AT_ONCE = 64, 1 << 22
#: added to probabilities under a root, and to totals that divide (fixed values)
_FLOOR, _TOTAL = 1e-10, 1e-12


def fisher_spectrum(p: np.ndarray, k: int | None = None) -> np.ndarray:
    """The `k` largest eigenvalues of diag(p) - p p' (all by default), largest first; p sums to 1 and is not negative.

    They interlace: each lies between two neighbouring values of p, and 0 is one of them. A value that occurs m times is an
    eigenvalue m - 1 times."""
    value, times = np.unique(p[p > 0], return_counts=True)
    k = len(p) if k is None else min(k, len(p))
    # roots of 1 = sum m v^2 / (v - x), one in each gap; repeated values are roots themselves
    repeated = np.repeat(value, times - 1)
    low, high = value[:-1][::-1][:k].copy(), value[1:][::-1][:k].copy()
    weight = times * value * value
    step = max(1, _AT_ONCE // max(1, len(value)))
    roots = []
    for a in range(0, len(low), step):
        # from the lower end, so that differences to the nearest values keep their digits
        base, width = low[a : a + step], high[a : a + step] - low[a : a + step]
        gap = value[None] - base[:, None]
        lo, hi = np.zeros_like(base), np.ones_like(base)
        for _ in range(_HALVINGS):
            mid = (lo + hi) / 2
            with np.errstate(divide="ignore", invalid="ignore"):
                f = (weight / (gap - (mid * width)[:, None])).sum(axis=1)
            above = ~(f < 1)  # the sum rises from minus to plus infinity across the gap
            lo, hi = np.where(above, lo, mid), np.where(above, mid, hi)
        roots.append(base + (lo + hi) / 2 * width)
    out = np.concatenate([*roots, repeated, np.zeros(len(p))])
    return np.sort(out)[::-1][:k]


def leading(a: np.ndarray, rank: int, seed: int = 0, extra: int = 16, powers: int = 16, dense: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right directions as rows) of the `rank` leading ones of a matrix."""
    rank = min(rank, *a.shape)
    if min(a.shape) <= max(dense, 2 * (rank + extra)):
        _, s, v = np.linalg.svd(a, full_matrices=False)
        return s[:rank], v[:rank]
    basis = np.linalg.qr(a @ np.random.default_rng(seed).normal(size=(a.shape[1], rank + extra)))[0]
    for _ in range(powers):
        basis = np.linalg.qr(a @ np.linalg.qr(a.T @ basis)[0])[0]
    _, s, v = np.linalg.svd(basis.T @ a, full_matrices=False)
    return s[:rank], v[:rank]


def reflected(weights: np.ndarray, seed: int) -> np.ndarray:
    """Rows reflected at a random hyperplane: a rotation of the hidden space that touches every coordinate."""
    v = np.random.default_rng(seed).normal(size=weights.shape[1])
    v /= np.linalg.norm(v)
    return weights - np.outer(weights @ v, 2 * v)


def weighted(p: np.ndarray, weights: np.ndarray, support: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(roots of the probabilities, rows times them) of the `support` likeliest rows; of equal ones the earlier."""
    at = np.argsort(-p, kind="stable")[:support]
    root = np.sqrt(p[at] + _FLOOR)
    return root, root[:, None] * weights[at]


def centred_spectrum(p: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Eigenvalues, largest first, of W' (diag(p) - p p') W, from the smaller of the two Gram matrices."""
    c = np.sqrt(p)[:, None] * (weights - p @ weights)
    gram = c @ c.T if c.shape[0] <= c.shape[1] else c.T @ c
    return np.linalg.eigvalsh(gram)[::-1].clip(0)


def _shares(inside: np.ndarray, whole: float, ranks: list[int]) -> list[float]:
    total = np.cumsum(inside)
    return [float(total[min(r, len(total)) - 1]) / whole if r > 0 and len(total) else 0.0 for r in ranks]


def _beside(direction: np.ndarray, basis: np.ndarray, ranks: list[int]) -> list[float]:
    """The share of a direction's length that lies outside its projection on the first rows of a basis."""
    whole = float(direction @ direction)
    if whole <= 0:
        return [0.0] * len(ranks)
    return [float(np.sqrt(max(0.0, 1 - x))) for x in _shares((basis @ direction) ** 2, whole, ranks)]


def static_ratios(direction: np.ndarray, weights: np.ndarray, ranks: list[int], basis: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[list[float], list[float]]:
    """(null ratios, energies) at ranks of the bare projection, the same for all rows: `basis` from `leading` may be given."""
    s, v = leading(weights, max(ranks)) if basis is None else basis
    return _beside(direction, v, ranks), _shares(s * s, float((weights**2).sum()) + _FLOOR, ranks)


def fisher_ratios(p: np.ndarray, direction: np.ndarray, weights: np.ndarray, ranks: list[int]) -> tuple[list[float], list[float]]:
    """(null ratios, energies) at ranks of the projection weighed by probabilities, over the likeliest rows."""
    if not direction @ direction > 0:
        return [0.0] * len(ranks), [0.0] * len(ranks)
    _, a = weighted(p, weights, max(256, 16 * max(ranks)))
    s, v = leading(a, max(ranks))
    return _beside(direction, v, ranks), _shares(s * s, float((a * a).sum()) + _FLOOR, ranks)


def discharged(p: np.ndarray, direction: np.ndarray, weights: np.ndarray) -> float:
    """Half the variance of the projected direction under p: the divergence, in nats, of a small step along it."""
    z = weights @ direction
    return 0.5 * max(0.0, float(p @ (z - p @ z) ** 2))


def centred_ratios(p: np.ndarray, direction: np.ndarray, weights: np.ndarray, ranks: list[int]) -> tuple[list[float], list[float]]:
    """(null ratios, energies) at ranks of the centred Fisher matrix: the share of the discharged divergence that its leading
    directions do not explain. The matrix is of the likeliest rows, the divergence of all."""
    whole = discharged(p, direction, weights)
    if whole <= _TOTAL:
        return [0.0] * len(ranks), [0.0] * len(ranks)
    root, a = weighted(p, weights, max(256, 16 * max(ranks)))
    mean = root @ a
    value, vector = np.linalg.eigh(a.T @ a - np.outer(mean, mean))
    value, vector = value[::-1].clip(0), vector[:, ::-1]
    explained = _shares(0.5 * value * (vector.T @ direction) ** 2, whole, ranks)
    return [max(0.0, 1 - x) for x in explained], _shares(value, float(value.sum()) + _TOTAL, ranks)


def low_rank_distance(p: np.ndarray, direction: np.ndarray, weights: np.ndarray, rank: int = 16) -> float:
    """The Fisher length of a direction by the `rank` leading directions of the weighted projection, less the mean's part."""
    _, a = weighted(p, weights, max(256, 16 * rank))
    s, v = leading(a, rank)
    mean = float(p @ (weights @ direction))
    return float(np.sqrt(max(float(((s * (v @ direction)) ** 2).sum()) - mean * mean, _FLOOR)))
