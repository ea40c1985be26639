"""Dense least squares inside the engine: sums of products by key, and a Cholesky factor of them as column expressions.

Only the sums of products leave the rows, a handful of numbers a key (and replicate), combined before the shuffle. Columns are
centred and scaled by key first, so that the sums keep their digits. A column that the ones before it explain takes no part,
as in a least-squares solution of least norm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.operators import resampling

#: the share of a column's own spread that must be left for it to take part
_LEFT = 1e-10


def products(names: list[str]) -> dict[str, Column]:
    """The products of pairs of columns, once each, by name."""
    return {f"_g{i}_{j}": F.col(names[i]) * F.col(names[j]) for i in range(len(names)) for j in range(i + 1)}


def factored(sums: DataFrame, n: int) -> DataFrame:
    """Adds `_l{i}_{j}`, the Cholesky factor of the matrix of `_g{i}_{j}`, and `_held{i}`, whether a column takes part."""
    out = sums
    for j in range(n):
        pivot = F.col(f"_g{j}_{j}") - sum((F.col(f"_l{j}_{k}") * F.col(f"_l{j}_{k}") for k in range(j)), F.lit(0.0))
        out = out.withColumn(f"_held{j}", pivot > F.col(f"_g{j}_{j}") * _LEFT).withColumn(f"_l{j}_{j}", F.when(F.col(f"_held{j}"), F.sqrt(pivot)).otherwise(0.0))
        below = {f"_l{i}_{j}": F.when(F.col(f"_held{j}"), (F.col(f"_g{i}_{j}") - sum((F.col(f"_l{i}_{k}") * F.col(f"_l{j}_{k}") for k in range(j)), F.lit(0.0))) / F.col(f"_l{j}_{j}")).otherwise(0.0) for i in range(j + 1, n)}
        out = out.withColumns(below)
    return out


def _scaled(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Rows that have all columns, each centred and scaled by key, with `_one`."""
    kept = rows.where(" and ".join(f"`{c}` is not null" for c in names))
    spread = kept.groupBy(*keys).agg(*(f(c).alias(f"_{t}_{c}") for c in names for f, t in ((F.avg, "m"), (F.stddev_pop, "s"))))
    return kept.join(spread, keys).select(*(c for c in rows.columns if c not in names), F.lit(1.0).alias("_one"), *(((F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)).alias(c) for c in names))


def _association(sums: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The correlation of the last two of n columns given the others: what their factor leaves of them."""
    f = factored(sums, n)
    a, b = F.col(f"_l{n - 1}_{n - 2}"), F.col(f"_l{n - 1}_{n - 1}")
    varies = F.col(f"_held{n - 2}") & F.col(f"_held{n - 1}")
    return f.select(*keys, F.col("_g0_0").alias("n"), F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), a / F.sqrt(a * a + b * b)))).alias("partial"))


def partial_association(rows: DataFrame, keys: list[str], x: str, y: str, controls: list[str], least: int = 4) -> DataFrame:
    """(keys, n, partial): the correlation of x and y given the controls; null below `least` complete rows or without spread."""
    names = ["_one", *controls, x, y]
    held = _scaled(rows, keys, [*controls, x, y])
    sums = held.groupBy(*keys).agg(*(F.sum(v).alias(k) for k, v in products(names).items()))
    out = _association(sums, keys, len(names))
    return out.select(*keys, F.col("n").cast("long").alias("n"), F.when(F.col("n") >= least, F.col("partial")).alias("partial"))


def partial_interval(rows: DataFrame, keys: list[str], sample: str, x: str, y: str, controls: list[str], n: int, seed: int) -> DataFrame:
    """(keys, n, partial, n_used, lo, hi): with percentiles over `n` resamples, whose sums of products a task adds up as vectors."""
    names = ["_one", *controls, x, y]
    held = _scaled(rows, keys, [*controls, x, y])
    packed = resampling.packed_multiplicities(held, keys, sample, n, seed)
    each = _association(resampling.replicate_sums(packed, keys, products(names), n), [*keys, "rep"], len(names))
    spread = each.groupBy(*keys).agg(F.count("partial").alias("n_used"), F.percentile("partial", F.lit(0.025)).alias("lo"), F.percentile("partial", F.lit(0.975)).alias("hi"))
    return partial_association(rows, keys, x, y, controls).join(spread, keys, "left")


def weighted_regression(rows: DataFrame, keys: list[str], y: str, terms: list[str], weight: str, least: int = 3) -> DataFrame:
    """(keys, n, term, beta, se): weighted least squares of y on an intercept and `terms`, for known variances 1 / weight.

    `term` is 'intercept' or the name of a column; an interaction is a column of products. A term that others explain, and all terms
    below `least` complete rows, are null."""
    names = ["_one", *terms, y]
    p = len(names) - 1
    kept = rows.where(" and ".join(f"`{c}` is not null" for c in [*terms, y, weight]) + f" and `{weight}` > 0").withColumn("_one", F.lit(1.0))
    sums = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(weight) * v).alias(k) for k, v in products(names).items()))
    f = factored(sums, p + 1)
    # rows of the inverse factor, then beta = inverse' (last row) and the variances are sums of squares of its columns
    inverse: dict[tuple[int, int], Column] = {}
    for i in range(p):
        for j in range(i + 1):
            if i == j:
                entry = F.when(F.col(f"_held{i}"), 1.0 / F.col(f"_l{i}_{i}")).otherwise(0.0)
            else:
                total = sum((F.col(f"_l{i}_{k}") * F.col(f"_v{k}_{j}") for k in range(j, i)), F.lit(0.0))
                entry = F.when(F.col(f"_held{i}"), -total / F.col(f"_l{i}_{i}")).otherwise(0.0)
            f = f.withColumn(f"_v{i}_{j}", entry)
            inverse[i, j] = F.col(f"_v{i}_{j}")
    enough = F.col("n") >= least
    one = lambda j, name: F.struct(
        F.lit(name).alias("term"),
        F.when(enough & F.col(f"_held{j}"), sum((inverse[i, j] * F.col(f"_l{p}_{i}") for i in range(j, p)), F.lit(0.0))).alias("beta"),
        F.when(enough & F.col(f"_held{j}"), F.sqrt(sum((inverse[i, j] * inverse[i, j] for i in range(j, p)), F.lit(0.0)))).alias("se"),
    )
    return f.select(*keys, "n", F.explode(F.array(*(one(j, "intercept" if j == 0 else terms[j - 1]) for j in range(p)))).alias("_t")).select(*keys, "n", "_t.*")
