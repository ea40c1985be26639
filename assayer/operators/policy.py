"""Decisions from scores: abstention bands, policies and a ladder of checks that fails closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.operators.summaries import youden


def decision(score: Column, threshold: Column, band: Column) -> Column:
    """ABSTAIN within the band around the threshold, its ends included; else BLOCK above the threshold, ALLOW below."""
    return F.when(score.isNull() | threshold.isNull(), "DEFER").when(F.abs(score - threshold) <= band, "ABSTAIN").when(score > threshold, "BLOCK").otherwise("ALLOW")


def policies(scores: DataFrame, keys: list[str], band_share: float) -> DataFrame:
    """A threshold for each key, the band as a share of the scores' spread, and a hash that names the policy."""
    spread = scores.groupBy(*keys).agg((F.max("score") - F.min("score")).alias("_spread"))
    baked = youden(scores, keys).join(spread, keys).withColumn("band", F.col("_spread") * band_share).drop("_spread")
    return baked.withColumn("policy_hash", F.sha2(F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.round(F.col("threshold"), 6).cast("decimal(20,6)").cast("string")), 256))


def ladder(*rungs: tuple[Column, str]) -> Column:
    """The reason of the first rung whose condition fails or cannot be decided; null where all hold."""
    return F.coalesce(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(reason)) for c, reason in rungs))
