"""Places in an order, no task holding a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def hash_places(df: DataFrame, keys: list[str], order: Column, tie: str, into: str, of_key: DataFrame | None = None) -> DataFrame:
    """`df` with a gapless number from 0 within each key, by the hexadecimal hash `order` and then `tie`. Keys must not be null.

    Rows are dealt into 256 cells a key by the hash's first two digits, which its order respects; a row's place in its cell is added
    to the sizes of the cells before it. The columns of `of_key`, a table by some of the keys, come with those sizes: after a join
    of their own, rows would be sorted where that join brought them, all of a key in one task.
    """
    # as bytes, which have the same order, a hash is half as long in the shuffle and the sort
    dealt = df.withColumn("_h", F.unhex(order)).withColumn("_cell", F.hex(F.substring("_h", 1, 1)))
    sizes = dealt.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select(*keys, "_cell", (F.sum("_n").over(W.partitionBy(*keys).orderBy("_cell")) - F.col("_n")).alias("_start"))
    if of_key is not None:
        starts = starts.join(of_key, [k for k in keys if k in of_key.columns])
    ranked = dealt.withColumn("_rank", F.row_number().over(W.partitionBy(*keys, "_cell").orderBy("_h", tie)) - 1)
    return ranked.join(starts, [*keys, "_cell"]).withColumn(into, F.col("_start") + F.col("_rank")).drop("_h", "_cell", "_rank", "_start")


def ranges_needed(df: DataFrame, keys: list[str], rows: int = 1 << 20) -> int:
    """How many ranges of about `rows` rows the largest key takes; 1 where every key fits into one task."""
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0
    return max(1, -(-largest // rows))


def quantile_ranges(df: DataFrame, keys: list[str], value: str, n: int, into: str) -> DataFrame:
    """`df` with the number of the range that its value falls in, from 0; a key's values are dealt into at most `n` ranges by quantiles
    of those whose hash is least, which are the same in every run. Equal values share a range."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    share = F.lit(64.0 * n * (1 << 30)) / F.col("_c")  # about 64 sampled values a range
    sample = df.join(sizes, keys).where(F.pmod(F.xxhash64(value), F.lit(1 << 30)) < share).groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("_v"))
    at = lambda i: F.element_at("_v", (F.floor(i * F.size("_v") / F.lit(n)) + 1).cast("int"))
    bounds = sample.where(F.size("_v") > 0).select(*keys, F.transform(F.sequence(F.lit(1), F.lit(n - 1)), at).alias("_q"))
    placed = df.join(bounds, keys, "left")
    return placed.withColumn(into, F.greatest(F.coalesce(F.size(F.filter("_q", lambda q: q <= F.col(value))), F.lit(0)), F.lit(0))).drop("_q")


def value_ranges(df: DataFrame, keys: list[str], value: str, tie: str, largest: int, rows: int, into: str) -> DataFrame:
    """`df` with the number of the range that its value falls in, from 0 within each key: about `rows` rows a range where a key has
    more than that; `largest` is the number of rows of the largest key. Equal values share a range.

    The bounds are quantiles of the rows whose hash is least, the same in every run and after lost tasks, unlike sketches that
    depend on the order of merging. A key too small for a sample is one range.
    """
    if largest <= rows:
        return df.withColumn(into, F.lit(0))
    n = -(-largest // rows)
    share = min(1.0, 64 * n / largest)  # about 64 sampled values a range
    chosen = F.pmod(F.xxhash64(value, tie), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    sample = df.where(chosen).groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("_v"))
    at = lambda i: F.element_at("_v", (F.floor(i * F.size("_v") / F.lit(n)) + 1).cast("int"))
    bounds = sample.select(*keys, F.transform(F.sequence(F.lit(1), F.lit(n - 1)), at).alias("_q"))
    placed = df.join(bounds, keys, "left").withColumn(into, F.coalesce(F.size(F.filter("_q", lambda q: q <= F.col(value))), F.lit(0)))
    return placed.withColumn(into, F.greatest(F.col(into), F.lit(0))).drop("_q")
