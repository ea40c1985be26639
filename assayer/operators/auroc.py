"""Area under the ROC curve, tie-correct, over long tables of scores.

Scores are first counted by distinct value, which combines before the shuffle; the running counts then need only the distinct
values. With `buckets` above 1, values are dealt into that many ranges a key, so that one key's values spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from assayer.functions.numbers import finite
from assayer.operators.ordering import quantile_ranges

LEAST = 4


def running(df: DataFrame, keys: list[str], order: str, values: dict[str, str], buckets: int = 1) -> DataFrame:
    """Adds, for each new name in `values`, the sum of a column over rows of the key with a smaller `order`."""
    if buckets <= 1:
        before = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return df.select("*", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for n, c in values.items()))
    dealt = quantile_ranges(df, keys, order, buckets, "_k")
    sums = dealt.groupBy(*keys, "_k").agg(*(F.sum(c).alias(f"_s_{n}") for n, c in values.items()))
    earlier = W.partitionBy(*keys).orderBy("_k").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*keys, "_k", *(F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_s_{n}") for n in values))
    before = W.partitionBy(*keys, "_k").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    out = dealt.join(starts, [*keys, "_k"])
    return out.select("*", *((F.col(f"_s_{n}") + F.coalesce(F.sum(c).over(before), F.lit(0))).alias(n) for n, c in values.items())).drop("_k", *(f"_s_{n}" for n in values))


def ranked_area(scores: DataFrame, keys: list[str], weight: Column | None = None, buckets: int = 1, every: bool = False) -> DataFrame:
    """For each key: n, n1 and n0 (weights of rows with a score), and `auc`, null where a class is missing.

    `scores` has `label` (0 or 1) and `score`; rows without score or label do not count, and keys that have only such rows are left
    out unless `every` is set. `weight` is a multiplicity: the area of a resample is that of its multiplicities, so resampled rows
    are never made.
    """
    w = F.lit(1) if weight is None else weight
    held = F.col("score").isNotNull() & F.col("label").isNotNull()
    weights = [F.sum(F.when(held & (F.col("label") == k), w).otherwise(0)).alias(f"w{k}") for k in (1, 0)]
    values = (scores if every else scores.where(held)).groupBy(*keys, "score").agg(*weights)
    below = running(values, keys, "score", {"c0": "w0"}, buckets)
    wins = F.sum(F.col("w1") * (2 * F.col("c0") + F.col("w0")))  # twice the pairs won, an integer for integer weights
    out = below.groupBy(*keys).agg((F.sum("w1") + F.sum("w0")).alias("n"), F.sum("w1").alias("n1"), F.sum("w0").alias("n0"), wins.alias("_wins"))
    return out.withColumn("auc", F.when((F.col("n1") > 0) & (F.col("n0") > 0), F.col("_wins") / (2.0 * F.col("n1") * F.col("n0")))).drop("_wins")


def labelled_areas(scores: DataFrame, keys: list[str], rows: str, ones: list[str], buckets: int = 1) -> DataFrame:
    """(keys, rep, auc): the area under each of several alternative labels. A row of `scores` stands for `rows` rows, of which `ones` has
    how many are labelled 1 by each alternative; they are added up by distinct score and travel together."""
    values = scores.groupBy(*keys, "score").agg(*(F.sum(c).alias(f"_w{i}") for i, c in enumerate(ones)), *(F.sum(F.col(rows) - F.col(c)).alias(f"_z{i}") for i, c in enumerate(ones)))
    below = running(values, keys, "score", {f"_b{i}": f"_z{i}" for i in range(len(ones))}, buckets)
    wins = lambda i: F.sum(F.col(f"_w{i}") * (2 * F.col(f"_b{i}") + F.col(f"_z{i}")))
    area = lambda i: wins(i) / F.nullif(2.0 * F.sum(f"_w{i}") * F.sum(f"_z{i}"), F.lit(0.0))
    return below.groupBy(*keys).agg(F.array(*(area(i) for i in range(len(ones)))).alias("_a")).select(*keys, F.posexplode("_a").alias("rep", "auc"))


def sign_locked(scores: DataFrame, keys: list[str], least: int = LEAST, buckets: int = 1) -> DataFrame:
    """Key, `auroc` = max(a, 1 - a), `sign` (+1 where a >= 0.5) and `n_evaluated`; null and 0 below `least` scores or one class."""
    area = ranked_area(scores.withColumn("score", finite(F.col("score"))), keys, buckets=buckets, every=True)
    ok = (F.col("n") >= least) & F.col("auc").isNotNull()
    return area.select(
        *keys,
        F.when(ok, F.greatest(F.col("auc"), 1 - F.col("auc"))).alias("auroc"),
        F.when(~ok, 0).when(F.col("auc") >= 0.5, 1).otherwise(-1).alias("sign"),
        F.col("n").cast("long").alias("n_evaluated"),
    )


def fixed_sign(scores: DataFrame, keys: list[str], sign: str = "sign", least: int = LEAST) -> DataFrame:
    """Key and `auroc` of sign * score, the sign being a column that is constant in a key."""
    turned = scores.withColumn("score", finite(F.col("score")) * F.col(sign))
    area = ranked_area(turned, keys)
    return area.select(*keys, F.when(F.col("n") >= least, F.col("auc")).alias("auroc"), F.col("n").cast("long").alias("n"))


def direction(scores: DataFrame, keys: list[str], least: int = 5) -> DataFrame:
    """Key, raw area and a tag: hi, lo or =; null below `least` scores or for a constant one."""
    kept = scores.withColumn("score", finite(F.col("score")))
    spread = kept.groupBy(*keys).agg((F.max("score") > F.min("score")).alias("_varies"))
    area = ranked_area(kept, keys).join(spread, keys)
    auc = F.when((F.col("n") >= least) & F.col("_varies"), F.col("auc"))
    return area.select(*keys, auc.alias("auroc"), F.when(auc > 0.5, "hi").when(auc < 0.5, "lo").when(auc == 0.5, "=").alias("direction"))


def strict(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Key and raw area; null where any score of the key is missing or not finite."""
    kept = scores.withColumn("score", finite(F.col("score")))
    missing = kept.groupBy(*keys).agg(F.count_if(F.col("score").isNull()).alias("_missing"))
    return ranked_area(kept, keys).join(missing, keys).select(*keys, F.when(F.col("_missing") == 0, F.col("auc")).alias("auroc"))


def varying(scores: DataFrame, keys: list[str], least_spread: float = 1e-8) -> DataFrame:
    """Key and raw area; null where the population spread of scores is nearly none."""
    kept = scores.withColumn("score", finite(F.col("score")))
    spread = kept.groupBy(*keys).agg(F.stddev_pop("score").alias("_spread"))
    return ranked_area(kept, keys).join(spread, keys).select(*keys, F.when(F.col("_spread") > least_spread, F.col("auc")).alias("auroc"))


def first_best(df: DataFrame, keys: list[str], value: Column, order: str, take: list[str]) -> DataFrame:
    """Of each key, `take` of the row with the greatest value; of equal ones the lowest `order`. Nulls never win."""
    best = F.max_by(F.struct(*take), F.struct(value.alias("v"), (-F.col(order)).alias("o")))
    return df.where(value.isNotNull()).groupBy(*keys).agg(best.alias("_best")).select(*keys, *(F.col(f"_best.{c}").alias(c) for c in take))
