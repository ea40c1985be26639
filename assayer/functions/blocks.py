"""Blocks of samples, in NumPy over Arrow batches: many samples of a key in one row, and the sums of many models' fits over them.

A block has its samples' features and labels as one binary value, column after column in doubles (missing ones NaN), and their folds
as another, in four bytes each. A task reads it whole, so a round of a fit copies no rows for models or folds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from assayer.functions.vectors import _column, _joined, grouped

#: samples that a task holds before it deals them to blocks, and samples of a block at most
_HELD, _BLOCK = 1 << 18, 1 << 14


def pairs(n: int) -> list[tuple[int, int]]:
    """Places of a symmetric matrix that are summed."""
    return [(i, j) for i in range(n) for j in range(i, n)]


def packed(keys: list[str], columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (keys, columns, `fold`) to blocks (keys, `_x`, `_fold`)."""

    def sent(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        order, starts = grouped(batch, keys)
        values = np.stack([_column(batch, c).to_numpy(zero_copy_only=False).astype(float)[order] for c in columns])
        fold = _column(batch, "fold").to_numpy(zero_copy_only=False).astype(np.int32)[order]
        cut = [(i, min(i + _BLOCK, b)) for a, b in zip(starts, [*starts[1:], len(order)], strict=True) for i in range(a, b, _BLOCK)]
        one = pa.array(order[[a for a, _ in cut]])
        binaries = (pa.array([x[..., a:b].tobytes() for a, b in cut], pa.binary()) for x in (values, fold))
        yield pa.RecordBatch.from_arrays([*(_column(batch, k).take(one) for k in keys), *binaries], names=[*keys, "_x", "_fold"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size > _HELD:
                yield from sent(_joined(held))
                held, size = [], 0
        if held:
            yield from sent(_joined(held))

    return run


def _design(x: np.ndarray, mean: list[float | None], sd: list[float | None]) -> np.ndarray:
    """An intercept and standardised features; missing ones are at the mean, and a feature without spread is centred only."""
    out = np.ones((len(x) + 1, x.shape[1]))
    for i, (m, s) in enumerate(zip(mean, sd, strict=True)):
        np.subtract(x[i], np.nan if m is None else m, out=out[i + 1])
        out[i + 1] /= s if s is not None and s > 0 else 1.0
    gaps = np.isnan(out)
    if gaps.any():
        out[gaps] = 0.0
    return out


def _products(x: np.ndarray, at: list[tuple[int, int]]) -> np.ndarray:
    out = np.empty((len(at), x.shape[1]))
    for k, (i, j) in enumerate(at):
        np.multiply(x[i], x[j], out=out[k])
    return out


def fit_sums(keys: list[str], models: list[list[int]], n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks (keys, `_x` of n features and the label, `_fold`, `_fits`, an array of (_held, _mean, _sd, _model, _beta)) to (keys, _held,
    _mean, _sd, _model, _beta, `_g{i}`, `_h{i}_{j}`), gradients and upper triangles of Gram matrices over the labelled samples outside the
    held fold; a row for each key, held fold and model of a task. `models` has the places of each model's features."""
    used = np.array([[True, *(i in m for i in range(n))] for m in models], dtype=float)
    at = pairs(n + 1)
    left, right = (np.array([p[k] for p in at]) for k in (0, 1))
    names = [*(f"_g{i}" for i in range(n + 1)), *(f"_h{i}_{j}" for i, j in at)]

    def of_block(batch: pa.RecordBatch, row: int, fits: dict) -> Iterator[tuple[int, np.ndarray]]:
        values = np.frombuffer(_column(batch, "_x")[row].as_buffer(), dtype=float).reshape(n + 1, -1)
        fold = np.frombuffer(_column(batch, "_fold")[row].as_buffer(), dtype=np.int32)
        labelled = ~np.isnan(values[n])
        for held, (mean, sd, betas) in fits.items():
            mine = values.take(np.flatnonzero(labelled & (fold != held)), axis=1)
            x = _design(mine[:n], mean, sd)
            z = np.array([betas[m] for m in range(len(models))]) @ x
            p = 1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0, out=z)))
            gradient = (mine[n] - p) @ x.T * used
            gram = (p * (1.0 - p)) @ _products(x, at).T * used[:, left] * used[:, right]
            yield held, np.hstack([gradient, gram])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        of: dict[tuple, dict] = {}
        kinds: list[pa.DataType] = []

        def sent() -> pa.RecordBatch:
            rows = [(key, held, *of[key][held][:2], m, of[key][held][2][m]) for key, held in sums for m in range(len(models))]
            columns = [pa.array([r[0][i] for r in rows], type=kinds[i]) for i in range(len(keys))]
            lists = pa.list_(pa.float64())
            columns += [pa.array([r[i] for r in rows], type=t) for i, t in ((1, pa.int32()), (2, lists), (3, lists), (4, pa.int32()), (5, lists))]
            return pa.RecordBatch.from_arrays([*columns, *map(pa.array, np.concatenate(list(sums.values())).T.copy())], names=[*keys, "_held", "_mean", "_sd", "_model", "_beta", *names])

        for batch in batches:
            kinds = [_column(batch, k).type for k in keys]
            for row, key in enumerate(zip(*(_column(batch, k).to_pylist() for k in keys), strict=True)):
                if key not in of:
                    fits: dict = {}
                    for f in _column(batch, "_fits")[row].as_py():
                        fits.setdefault(f["_held"], (f["_mean"], f["_sd"], {}))[2][f["_model"]] = f["_beta"]
                    of[key] = fits
                for held, part in of_block(batch, row, of[key]):
                    sums[key, held] = sums[key, held] + part if (key, held) in sums else part
            if len(sums) * len(models) * len(names) > 1 << 21:
                yield sent()
                sums, of = {}, {}
        if sums:
            yield sent()

    return run
