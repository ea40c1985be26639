"""Alignment of samples with their sources, overlap checks and pairings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def aligned(left: DataFrame, right: DataFrame, on: list[str], agree: list[str]) -> DataFrame:
    """Rows of both sides, matched; `violation` names the columns in `agree` that differ between the sides."""
    r = right.select(*on, *(F.col(c).alias(f"_r_{c}") for c in agree), *(c for c in right.columns if c not in (*on, *agree, *left.columns)))
    names = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"_r_{c}")), F.lit(c)) for c in agree)))
    return left.join(r, on).withColumn("violation", names).drop(*(f"_r_{c}" for c in agree))


def alignment_report(left: DataFrame, right: DataFrame, on: list[str], agree: list[str], keys: list[str]) -> DataFrame:
    """For each key: rows matched, rows of either side dropped, disagreements."""
    a = left.select(*on, *agree).withColumn("_a", F.lit(1))
    b = right.select(*on, *(F.col(c).alias(f"_r_{c}") for c in agree)).withColumn("_b", F.lit(1))
    both = a.join(b, on, "full_outer")
    differs = F.lit(False)
    for c in agree:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    matched = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return both.groupBy(*keys).agg(F.count_if(matched).alias("matched"), F.count_if(F.col("_b").isNull()).alias("left_only"), F.count_if(F.col("_a").isNull()).alias("right_only"), F.count_if(matched & differs).alias("disagree"))


def overlap(prompts: DataFrame, references: DataFrame, key: str = "hash") -> tuple[DataFrame, DataFrame]:
    """(prompts that a reference holds, those that none holds); references may repeat."""
    known = references.select(key).distinct()
    return prompts.join(known, key, "left_semi"), prompts.join(known, key, "left_anti")


def side_flags(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of either table: `both`, `missing` (only in a) or `extra` (only in b)."""
    x = a.select(*keys).distinct().withColumn("_a", F.lit(1))
    y = b.select(*keys).distinct().withColumn("_b", F.lit(1))
    state = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").otherwise("both")
    return x.join(y, keys, "full_outer").select(*keys, state.alias("state"))


def donors(items: DataFrame, keys: list[str], item: str, value: str) -> DataFrame:
    """Gives each item the value of another one of its key as a wrong answer: the next in hash order with another value.

    A circular assignment without a cursor: items take hash order, and each looks ahead to where its run of equal values ends.
    No item gets its own value; a key whose items share one value gets none.
    """
    w = W.partitionBy(*keys).orderBy(F.md5(F.col(item).cast("string")), item)
    ordered = items.withColumn("_n", F.row_number().over(w))
    change = ordered.withColumn("_new", F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1))
    runs = change.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    firsts = runs.where("_new = 1").select(*keys, (F.col("_run") - 1).alias("_run"), F.col(value).alias("donor"))
    start = runs.where("_run = 1 and _new = 1").select(*keys, F.col(value).alias("_first"))
    second = runs.where("_run = 2 and _new = 1").select(*keys, F.col(value).alias("_second"))
    out = runs.join(firsts, [*keys, "_run"], "left").join(start, keys).join(second, keys, "left")
    circular = F.coalesce("donor", F.when(F.col("_first") != F.col(value), F.col("_first")).otherwise(F.col("_second")))
    return out.withColumn("donor", F.when(circular != F.col(value), circular)).drop("_n", "_new", "_run", "_first", "_second")


def paired(items: DataFrame, right: Column, wrong: Column) -> DataFrame:
    """Each item as two rows: label 0 with the right answer, label 1 with the wrong one."""
    two = F.array(F.struct(F.lit(0).alias("label"), right.alias("answer")), F.struct(F.lit(1).alias("label"), wrong.alias("answer")))
    return items.select("*", F.inline(two))


def quota(rows: DataFrame, keys: list[str], order: Column, tie: str, n: int, distinct: str | None = None) -> DataFrame:
    """The first n rows of each key in an order, of rows that share `distinct` only the first."""
    if distinct is not None:
        one = F.row_number().over(W.partitionBy(distinct).orderBy(order, tie))
        rows = rows.withColumn("_one", one).where("_one = 1").drop("_one")
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(order, tie))).where(F.col("_k") <= n).drop("_k")
