"""Aggregations of results: modes, intervals, sign audits, coverage, verdicts, thresholds and failure mining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from assayer.functions.numbers import finite


def modal(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each key, of equally frequent ones that of the lowest `order`; its count and share."""
    counts = df.groupBy(*keys, value, order).agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by(F.struct(value, "n"), F.struct("n", (-F.col(order)).alias("o"))).alias("b")
    return counts.groupBy(*keys).agg(best, F.sum("n").alias("_all")).select(*keys, f"b.{value}", "b.n", (F.col("b.n") / F.col("_all")).alias("share"))


def modal_lexicographic(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each key, of equally frequent ones the first in order."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), value))).where("_k = 1").drop("_k")


def shares(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("_all"))
    joined = counts.join(total, keys) if keys else counts.crossJoin(F.broadcast(total))  # one row
    return joined.withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def interval(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact 2.5 %, 50 % and 97.5 % percentiles, interpolated between ranks."""
    v = finite(F.col(value))
    return df.groupBy(*keys).agg(*(F.percentile(v, F.lit(p)).alias(n) for p, n in ((0.025, "lo"), (0.5, "median"), (0.975, "hi"))))


def majority_sign(sign: str) -> Column:
    return F.when(F.sum(sign) >= 0, 1).otherwise(-1)


def sign_stability(locked: DataFrame, keys: list[str]) -> DataFrame:
    """How many of a key's signs agree with the majority's; a tie counts as +1."""
    counts = locked.where("sign <> 0").groupBy(*keys).agg(majority_sign("sign").alias("modal_sign"), F.count(F.lit(1)).alias("models"), F.count_if(F.col("sign") == 1).alias("_up"))
    agreeing = F.when(F.col("modal_sign") == 1, F.col("_up")).otherwise(F.col("models") - F.col("_up"))
    return counts.select(*keys, "modal_sign", "models", agreeing.alias("agreeing"), (agreeing / F.col("models")).alias("agreement"))


def survival(locked: DataFrame, keys: list[str], bar: float) -> DataFrame:
    """For each cell, how many models exceed `bar`; `best` marks a key's first of most survivors."""
    counts = locked.groupBy(*keys, "cell", "cell_idx").agg(F.count_if(F.col("auroc") > bar).alias("survivors"), F.count("auroc").alias("models"))
    return counts.withColumn("best", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("survivors"), "cell_idx")) == 1)


def coverage(pairs: DataFrame, keys: list[str], bar: float, geometric: list[str]) -> DataFrame:
    """Cells above `bar` on either side, and whether a geometric cell, another cell or none covers the first side."""
    any_ = (F.col("a") > bar) | (F.col("b") > bar)
    shape = F.col("cell").isin(geometric)
    first = F.coalesce(F.col("a") > bar, F.lit(False))
    kind = F.when(F.bool_or(first & shape), "gap_free").when(F.bool_or(first), "detector_gap").otherwise("measurement_orphan")
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("cells"), F.count_if(any_).alias("covered_any"), F.count_if(any_ & shape).alias("covered_geometric"), kind.alias("class"))


def verdict(df: DataFrame, keys: list[str], ok: str, bar: int) -> DataFrame:
    """Counts against a bar; null as long as any planned member has no result."""
    passed = F.count_if(F.col(ok))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("planned"), passed.alias("passed"), F.when(~F.bool_or(F.col(ok).isNull()), passed >= bar).alias("verdict"))


def systematic(df: DataFrame, keys: list[str], status: str, least: int) -> DataFrame:
    """Marks keys in which `least` members or more have the status."""
    return df.withColumn("systematic", F.count_if(F.col("status") == status).over(W.partitionBy(*keys)) >= least)


def hedges(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Hedges' g between labels, corrected for bias, with a normal interval."""
    s = finite(F.col("score"))
    side = lambda k: F.when(F.col("label") == k, s)
    m = scores.groupBy(*keys).agg(*(f(side(k)).alias(f"{n}{k}") for k in (1, 0) for f, n in ((F.count, "n"), (F.avg, "m"), (F.var_samp, "v"))))
    n = F.col("n1") + F.col("n0")
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (n - 2))
    d = m.withColumn("d", (F.col("m1") - F.col("m0")) / pooled).withColumn("g", F.col("d") * (1 - 3.0 / (4.0 * n - 9)))
    se = F.sqrt(n / (F.col("n1") * F.col("n0")) + F.col("d") * F.col("d") / (2.0 * n))
    return d.select(*keys, "g", (F.col("g") - 1.96 * se).alias("lo"), (F.col("g") + 1.96 * se).alias("hi"))


def youden(scores: DataFrame, keys: list[str]) -> DataFrame:
    """The lowest threshold of greatest Youden's J among midpoints of distinct scores and points beyond both ends.

    Counts at each threshold are running sums over the distinct scores, so no threshold is tried against every row.
    """
    s = scores.withColumn("score", finite(F.col("score"))).where("score is not null")
    d = s.groupBy(*keys, "score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    w = W.partitionBy(*keys).orderBy("score")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    # what lies above is the total less what lies below: a frame that ends unbounded would be summed up anew for each row
    above = lambda c: F.sum(c).over(whole) - F.coalesce(F.sum(c).over(before), F.lit(0))
    at = F.coalesce((F.col("score") + F.lag("score").over(w)) / 2, F.col("score") - 1e-9)
    j = above("p") / F.sum("p").over(whole) - above("q") / F.sum("q").over(whole)
    inner = d.select(*keys, at.alias("threshold"), j.alias("youden"))
    beyond = d.groupBy(*keys).agg((F.max("score") + 1e-9).alias("threshold"), F.lit(0.0).alias("youden"))
    best = F.max_by(F.struct("threshold", "youden"), F.struct(F.round("youden", 12).alias("j"), (-F.col("threshold")).alias("t")))
    return inner.unionByName(beyond).groupBy(*keys).agg(best.alias("b")).select(*keys, "b.threshold", "b.youden")


def failures(wide: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of (label, v1, v2) that the second score misses, flags wrongly, or alone catches, by the key's percentiles."""
    m = wide.groupBy(*keys).agg(F.percentile("v1", F.lit(0.5)).alias("m1"), *(F.percentile("v2", F.lit(p)).alias(n) for p, n in ((0.9, "hi"), (0.1, "lo"))))
    both = wide.join(m, keys)
    one = F.col("label") == 1
    kinds = F.array_compact(
        F.array(
            F.when(one & (F.col("v2") <= F.col("lo")), F.lit("false_negative")),
            F.when(~one & (F.col("v2") >= F.col("hi")), F.lit("false_positive")),
            F.when(one & (F.col("v1") < F.col("m1")) & (F.col("v2") > F.col("hi")), F.lit("caught_by_second")),
        )
    )
    return both.withColumn("kind", F.explode(kinds)).drop("m1", "hi", "lo")
