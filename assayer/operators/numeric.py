"""Operators that need a particular random stream or linear algebra: Arrow-backed functions over bounded groups or single rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from assayer.functions import blocks as packing
from assayer.functions.numbers import finite
from assayer.operators import resampling
from assayer.sources import scratch

DOUBLES = T.ArrayType(T.DoubleType())
#: rows whose results are held as Python objects at once
_ROWS_AT_ONCE = 256


def weighted_areas(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Areas (replicates x cells) under multiplicities (replicates x rows); NaN scores are left out, a missing class gives NaN.

    Each column is sorted once; a replicate's area is a sum over its distinct values, so resampled rows are never made.
    """
    out = np.full((len(weights), scores.shape[1]), np.nan)
    for c in range(scores.shape[1]):
        ok = np.isfinite(scores[:, c])
        order = np.argsort(scores[ok, c], kind="stable")
        s, y, w = scores[ok, c][order], labels[ok][order], weights[:, ok][:, order]
        if not len(s):
            continue
        starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        w1, w0 = (np.add.reduceat(w * (y == k), starts, axis=1) for k in (1, 0))
        wins = (w1 * (np.cumsum(w0, axis=1) - w0 + w0 / 2)).sum(axis=1)
        pairs = w1.sum(axis=1) * w0.sum(axis=1)
        out[:, c] = np.divide(wins, pairs, out=np.full(len(w), np.nan), where=pairs > 0)
    return out


def nested_bootstrap(scores: np.ndarray, labels: np.ndarray, units: np.ndarray, n: int, seed: int, least: int = 4) -> dict[str, object]:
    """Nested selection out of the bag with draws of `numpy.random.RandomState`; units are drawn whole.

    Units count by first occurrence. With unique units this is the bootstrap over rows.
    """
    _, first, code = np.unique(units, return_index=True, return_inverse=True)
    place = np.argsort(np.argsort(first))[code]
    k = len(first)
    draws = np.random.RandomState(seed).randint(0, k, size=(n, k))
    counts = np.stack([np.bincount(d, minlength=k) for d in draws])[:, place]
    out_ = (counts == 0).astype(np.int64)
    usable = (out_.sum(axis=1) >= least) & (out_ @ (labels == 1) > 0) & (out_ @ (labels == 0) > 0)
    inside, outside = weighted_areas(scores, labels, counts), weighted_areas(scores, labels, out_)
    enough_in, enough_out = counts @ np.isfinite(scores) >= least, out_ @ np.isfinite(scores) >= least
    distance = np.where(enough_in & np.isfinite(inside), np.abs(inside - 0.5), -1.0)
    best = distance.argmax(axis=1)  # the first of equal ones
    rows = np.arange(n)
    won = usable & (distance[rows, best] >= 0)
    locked = np.where(inside[rows, best] >= 0.5, outside[rows, best], 1 - outside[rows, best])
    value = np.where(won & enough_out[rows, best], locked, np.nan)
    wins = np.bincount(best[won], minlength=scores.shape[1])
    used = value[np.isfinite(value)]
    lo, med, hi = np.percentile(used, [2.5, 50, 97.5]) if len(used) else (None, None, None)
    return {"winner": int(wins.argmax()) if wins.sum() else None, "wins": int(wins.max(initial=0)), "n_used": len(used), "ci_lo": lo, "oob_median": med, "ci_hi": hi}


def parity_selection(wide: DataFrame, keys: list[str], cells: list[str], unit: str, order: str, n: int, seed: int) -> DataFrame:
    """`nested_bootstrap` for each deployment in `wide` (keys, label, unit, order, cells), of any size: only the draws follow the
    sequential stream, key by key; samples meet them by chunks and areas come from ranges of scores."""
    scored = F.array(*(F.struct(F.lit(c).alias("cell"), F.lit(i).alias("cell_idx"), F.col(c).cast("double").alias("score")) for i, c in enumerate(cells)))
    own = wide.select(*dict.fromkeys([*keys, unit, order, "label"]), scored.alias("_cells"))
    won = resampling.selected(own, resampling.streamed_multiplicities(own, keys, unit, order, n, seed), keys, order, n)
    counts = won.groupBy(*keys, "cell", "cell_idx").agg(F.count(F.lit(1)).alias("c"))
    modal = counts.groupBy(*keys).agg(F.max_by("cell", F.struct("c", (-F.col("cell_idx")).alias("o"))).alias("winner"), F.max("c").alias("wins"))
    spread = won.groupBy(*keys).agg(F.count("oob_auroc").alias("n_used"), *(F.percentile("oob_auroc", F.lit(p)).alias(c) for c, p in (("ci_lo", 0.025), ("oob_median", 0.5), ("ci_hi", 0.975))))
    out = wide.select(*keys).distinct().join(modal, keys, "left").join(spread, keys, "left")
    return out.select(*keys, "winner", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("wins", "n_used")), "ci_lo", "oob_median", "ci_hi")


def _solved(ridge: float) -> Callable[..., Column]:
    @F.pandas_udf(DOUBLES)
    def solve(beta: pd.Series, gradient: pd.Series, gram: pd.Series) -> pd.Series:
        out = []
        for b, g, h in zip(beta, gradient, gram, strict=True):
            b, g = np.asarray(b, dtype=float), np.asarray(g, dtype=float)
            h = np.asarray(h, dtype=float).reshape(len(b), len(b))
            step = np.linalg.solve(h + ridge * np.eye(len(b)), g - ridge * b)
            out.append((b + step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))).tolist())
        return pd.Series(out)

    return solve


_FIT = [T.StructField("_held", T.IntegerType()), T.StructField("_mean", DOUBLES), T.StructField("_sd", DOUBLES), T.StructField("_model", T.IntegerType()), T.StructField("_beta", DOUBLES)]


def _round_sums(blocks: DataFrame, fits: DataFrame, keys: list[str], models: list[list[int]], n: int) -> DataFrame:
    """(keys, _held, _mean, _sd, _model, _beta, `_g{i}`, `_h{i}_{j}`): sums over a task's blocks, a row for each key, held fold and model."""
    doubles = [*(f"_g{i}" for i in range(n + 1)), *(f"_h{i}_{j}" for i, j in packing.pairs(n + 1))]
    schema = T.StructType([*(blocks.schema[k] for k in keys), *_FIT, *(T.StructField(d, T.DoubleType()) for d in doubles)])
    return blocks.join(fits, keys).mapInArrow(packing.fit_sums(keys, models, n), schema)


def _fitted(blocks: DataFrame, fits: DataFrame, keys: list[str], models: list[list[int]], n: int, c: float, rounds: int) -> DataFrame:
    """`fits` (keys, `_fits`, an array of (_held, _mean, _sd, _model, _beta)) after `rounds` of Newton's method, in which each model has an L2
    penalty on all weights, the intercept's too.

    Each round reads the blocks once and sums gradients and Gram matrices of all held folds and models, combined before the shuffle;
    one small system a key, fold and model is solved. Groups are never gathered and rows never copied; weights are written between rounds."""
    by = [*keys, "_held", "_model"]
    gradient = F.array(*(F.col(f"_g{i}") for i in range(n + 1)))
    gram = F.array(*(F.col(f"_h{min(i, j)}_{max(i, j)}") for i in range(n + 1) for j in range(n + 1)))
    for _ in range(rounds):
        parts = _round_sums(blocks, fits, keys, models, n)
        sums = parts.groupBy(*by).agg(*(F.first(v).alias(v) for v in ("_mean", "_sd", "_beta")), *(F.sum(d).alias(d) for d in parts.columns[len(keys) + len(_FIT) :]))
        solved = sums.select(*by, "_mean", "_sd", _solved(1.0 / c)("_beta", gradient, gram).alias("_beta"))
        fits = _written(solved.groupBy(*keys).agg(F.collect_list(F.struct(*(f.name for f in _FIT))).alias("_fits")), "beta")
    return fits


def _written(df: DataFrame, tag: str) -> DataFrame:
    path = scratch.folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _blocks(rows: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """`rows` (keys, label, fold, features) as blocks of `functions.blocks`, written."""
    columns = [*(finite(F.col(f)).alias(f) for f in features), F.col("label").cast("double").alias("_label")]
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("_x", T.BinaryType()), T.StructField("_fold", T.BinaryType())])
    held = rows.where("fold is not null").select(*keys, F.col("fold").cast("int").alias("fold"), *columns)
    return _written(held.mapInArrow(packing.packed(keys, [*features, "_label"]), schema), "blocks")


def _first_fits(scales: DataFrame, keys: list[str], features: list[str], n: int) -> DataFrame:
    """`_fits` of `n` models without weights, from (keys, _held, _mean, _sd)."""
    zeros = F.array(*(F.lit(0.0) for _ in ["", *features]))
    each = scales.select(*keys, F.struct("_held", "_mean", "_sd").alias("_s"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_model"))
    one = F.struct("_s._held", "_s._mean", "_s._sd", "_model", zeros.alias("_beta"))
    return _written(each.groupBy(*keys).agg(F.collect_list(one).alias("_fits")), "beta")


def logistic(rows: DataFrame, keys: list[str], features: list[str], c: float = 1.0, rounds: int = 8) -> DataFrame:
    """Key and `beta` of a logistic model of `label` with an L2 penalty on all weights, the intercept's too, on features as they are.
    Rows without label or with a missing feature do not count; a key that has only such rows is left out."""
    none, one = (F.array(*(F.lit(v) for _ in features)).cast(DOUBLES) for v in (0.0, 1.0))
    scales = rows.select(*keys).distinct().select(*keys, F.lit(0).alias("_held"), none.alias("_mean"), one.alias("_sd"))
    complete = rows.withColumn("fold", F.lit(-1))
    for f in features:
        complete = complete.where(finite(F.col(f)).isNotNull())
    blocks = _blocks(complete, keys, features)
    fits = _fitted(blocks, _first_fits(scales, keys, features, 1), keys, [list(range(len(features)))], len(features), c, rounds)
    return fits.select(*keys, F.get("_fits", F.lit(0))["_beta"].alias("beta"))


def _training_scales(rows: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """(keys, _held, _mean, _sd): of each feature outside each held fold, put together from those of the folds; null and 0 without values."""
    kept = rows.select(*keys, "fold", F.col("n_folds").cast("int").alias("n_folds"), *(finite(F.col(x)).alias(x) for x in features))
    kinds = {"n": F.count, "m": F.avg, "v": F.var_pop, "l": F.min, "u": F.max}
    folds = kept.groupBy(*keys, "fold", "n_folds").agg(*(f(x).alias(f"_{k}_{x}") for x in features for k, f in kinds.items()))
    train = folds.withColumn("_held", F.explode(F.sequence(F.lit(0), F.col("n_folds") - 1))).where("fold <> _held")
    of = W.partitionBy(*keys, "_held")
    # means are averaged as distances from the least of them, so that equal ones stay equal
    least = lambda x: F.min(f"_m_{x}").over(of)
    train = train.select("*", *(least(x).alias(f"_least_{x}") for x in features))
    centred = lambda x: F.col(f"_least_{x}") + F.sum(F.col(f"_n_{x}") * (F.col(f"_m_{x}") - F.col(f"_least_{x}"))).over(of) / F.nullif(F.sum(f"_n_{x}").over(of), F.lit(0))
    train = train.select("*", *(centred(x).alias(f"_mean_{x}") for x in features))
    spread = lambda x: F.sum(F.col(f"_n_{x}") * (F.col(f"_v_{x}") + F.pow(F.col(f"_m_{x}") - F.col(f"_mean_{x}"), F.lit(2)))) / F.nullif(F.sum(f"_n_{x}"), F.lit(0))
    sd = lambda x: F.when(F.max(f"_u_{x}") > F.min(f"_l_{x}"), F.sqrt(spread(x))).otherwise(0.0)
    return train.groupBy(*keys, "_held").agg(F.array(*(F.first(f"_mean_{x}") for x in features)).alias("_mean"), F.array(*(sd(x) for x in features)).alias("_sd"))


def out_of_fold_models(rows: DataFrame, keys: list[str], sample: str, models: list[list[str]], c: float = 1.0, rounds: int = 8) -> DataFrame:
    """(keys, sample, label, `scores`): out-of-fold probabilities of each of several models, given by their features, on shared folds.

    `rows` (keys, sample, label, fold, n_folds, features) is read several times and should be written. Features are standardised on the training folds; missing ones
    are at their mean. Rows without label train no weights but get scores; a row whose training folds are empty gets none and is left out."""
    features = [*dict.fromkeys(f for m in models for f in m)]
    places = [[features.index(f) for f in m] for m in models]
    start = _first_fits(_training_scales(rows, keys, features), keys, features, len(models))
    fits = _fitted(_blocks(rows, keys, features), start, keys, places, len(features), c, rounds)
    of_fold = fits.select(*keys, F.inline("_fits")).groupBy(*keys, "_held").agg(F.first("_mean").alias("_mean"), F.first("_sd").alias("_sd"), F.array_sort(F.collect_list(F.struct("_model", "_beta"))).alias("_models"))
    held = rows.join(_written(of_fold.withColumnRenamed("_held", "fold"), "beta"), [*keys, "fold"])
    s = lambda i: F.get("_sd", F.lit(i))
    scaled = [F.coalesce(finite(F.col(x)) - F.get("_mean", F.lit(i)), F.lit(0.0)) / F.when(s(i) > 0, s(i)).otherwise(1.0) for i, x in enumerate(features)]
    held = held.select(*keys, sample, "label", "_models", *(x.alias(f"_x{i}") for i, x in enumerate(scaled)))
    beta = lambda m, i: F.get(F.get("_models", F.lit(m))["_beta"], F.lit(i))
    z = lambda m: sum((beta(m, i + 1) * F.col(f"_x{i}") for i in places[m]), beta(m, 0))
    return held.select(*keys, sample, "label", F.array(*(1.0 / (1.0 + F.exp(-z(m))) for m in range(len(models)))).alias("scores"))


def out_of_fold(rows: DataFrame, keys: list[str], sample: str, features: list[str], c: float = 1.0) -> DataFrame:
    """`out_of_fold_models` for one model, with `score`."""
    return out_of_fold_models(rows, keys, sample, [features], c).select(*keys, sample, "label", F.get("scores", F.lit(0)).alias("score"))


def each_model(rows: DataFrame, models: dict[str, list[str]], features: list[str]) -> DataFrame:
    """`rows` for each of several models, with `model`; a feature that a model does not use is 0 there.

    A feature that is 0 everywhere gets the weight 0, so `logistic` and `out_of_fold` with `model` among their keys fit all models at
    once. Rows are copied for each model; `out_of_fold_models` needs no copies."""
    kept = F.array(*(F.struct(F.lit(m).alias("model"), *((F.col(f) if f in used else F.lit(0)).cast("double").alias(f) for f in features)) for m, used in models.items()))
    return rows.select(*(c for c in rows.columns if c not in features), F.inline(kept))


def rowwise(df: DataFrame, inputs: list[str], function: Callable[..., object], into: str, kind: T.DataType) -> DataFrame:
    """Adds `function` of arrays of each row, in Arrow batches, some rows of a batch at a time. A plain column then: it cannot end up inside a lambda of a
    higher-order function, where Python cannot run."""
    schema = T.StructType([*df.schema.fields, T.StructField(into, kind)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), _ROWS_AT_ONCE):
                rows = batch.iloc[a : a + _ROWS_AT_ONCE]
                values = [function(*(np.asarray(v, dtype=float) for v in x)) for x in zip(*(rows[c] for c in inputs), strict=True)]
                yield rows.assign(**{into: pd.Series(values, index=rows.index, dtype=object)})

    return df.mapInPandas(run, schema)
