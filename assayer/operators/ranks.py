"""Ranks within groups, rank fusion and rank correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.numbers import finite
from assayer.operators.auroc import running
from assayer.operators.ordering import ranges_needed
from assayer.sources import scratch

#: scores that a task joins to their ranks, about
_TASK_ROWS = 1 << 20


def ranked(df: DataFrame, keys: list[str], value: str, into: str, buckets: int = 1) -> DataFrame:
    """Adds average ranks of a value that is never null, from counts by distinct value; with `buckets` a key's values are dealt into
    that many ranges, so that one key may hold any share of the rows."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    below = running(counts, keys, value, {"_below": "_n"}, buckets)
    return df.join(below.select(*keys, value, (F.col("_below") + (F.col("_n") + 1) / 2.0).alias(into)), [*keys, value])


def rank01(scores: DataFrame, keys: list[str], value: str = "score", into: str = "rank01", buckets: int = 1) -> DataFrame:
    """Adds (average rank - 0.5) / number of finite values of the key; missing values stay missing and take no rank."""
    scored = scores.withColumn("_v", finite(F.col(value)))
    kept = scored.where(F.col("_v").isNotNull())
    sizes = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    every = ranked(kept, keys, "_v", "_rank", buckets).join(sizes, keys).withColumn(into, (F.col("_rank") - 0.5) / F.col("_size"))
    rest = scored.where(F.col("_v").isNull()).withColumn(into, F.lit(None).cast("double"))
    return every.select(*scored.columns, into).unionByName(rest).drop("_v")


def counted(scores: DataFrame, keys: list[str], value: str = "score") -> DataFrame:
    """(keys, value, `n`, `w1`, `w0`): rows of each finite value, and those of each label; rows without label count in `n` only."""
    held = scores.withColumn(value, finite(F.col(value))).where(F.col(value).isNotNull())
    each = (F.sum(F.when(F.col("label") == k, 1).otherwise(0)).alias(f"w{k}") for k in (1, 0))
    return held.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), *each)


def rank01_of_counts(counts: DataFrame, keys: list[str], value: str = "score", buckets: int = 1) -> DataFrame:
    """`rank01` of each value of `counted`, with the average `rank` and the key's `size`; a row for a value and none for a sample."""
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("size"))
    below = running(counts, keys, value, {"_below": "n"}, buckets).join(sizes, keys).withColumn("rank", F.col("_below") + (F.col("n") + 1) / 2.0)
    return below.withColumn("rank01", (F.col("rank") - 0.5) / F.col("size")).drop("_below")


def fused(scores: DataFrame, keys: list[str], sample: str, components: DataFrame, signs: DataFrame, buckets: int | None = None) -> DataFrame:
    """The mean over a fusion's components of the rank of sign * score; missing if any component is.

    `components` has (fusion, cell); `signs` has keys, cell and `sign`, never 0. Ranks come from counts by distinct value, which are written
    once. A task joins and adds up about `_TASK_ROWS` scores, a number of rows and not of compressed bytes, and scores are copied for
    fusions only where a sample's ranks have met.
    """
    spark, group = scores.sparkSession, [*keys, "cell"]
    used = scores.join(F.broadcast(components.select("cell").distinct()), "cell", "left_semi")
    path = scratch.folder(spark, "counts")
    counted(used, group).write.parquet(path)
    counts = spark.read.parquet(path)
    ranked = rank01_of_counts(counts, group, buckets=ranges_needed(counts, group) if buckets is None else buckets)
    # a negative sign turns the order round
    turned = (F.when(F.col("sign") > 0, F.col("rank")).otherwise(F.col("size") + 1 - F.col("rank")) - 0.5) / F.col("size")
    places = ranked.join(signs, group).select(*group, "score", F.lit(0).alias("_spread"), turned.alias("_r"))
    parts = max(ranges_needed(used, [], _TASK_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    # missing scores meet nothing, so they go anywhere
    held = used.select(*group, sample, "label", finite(F.col("score")).alias("score"))
    held = held.withColumn("_spread", F.when(F.col("score").isNull(), F.pmod(F.xxhash64(sample), F.lit(parts)).cast("int")).otherwise(0))
    each = held.repartition(parts, *group, "score", "_spread").join(places, [*group, "score", "_spread"], "left")
    signed = each.select(*group, sample, "label", "_r").join(F.broadcast(signs.select(*group)), group, "left_semi")
    n = components.groupBy("fusion").agg(F.count(F.lit(1)).alias("_n"))
    copied = signed.repartition(parts, *keys, sample).join(F.broadcast(components), "cell")
    mean = copied.groupBy(*keys, "fusion", sample).agg(F.avg("_r").alias("_mean"), F.count("_r").alias("_held"), F.first("label").alias("label"))
    return mean.join(F.broadcast(n), "fusion").select(*keys, "fusion", sample, "label", F.when(F.col("_held") == F.col("_n"), F.col("_mean")).alias("score"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str, buckets: int = 1) -> DataFrame:
    """The correlation of average ranks of rows that have both values."""
    both = df.withColumn("_x", finite(F.col(x))).withColumn("_y", finite(F.col(y))).where("_x is not null and _y is not null")
    every = ranked(ranked(both, keys, "_x", "_rx", buckets), keys, "_y", "_ry", buckets)
    return every.groupBy(*keys).agg(F.corr("_rx", "_ry").alias("spearman"), F.count(F.lit(1)).alias("n"))
