"""Connected components as a sequence of DataFrame jobs; nothing but a count reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm._store import forget, stored

MAX_ROUNDS = 60
#: edges in a file of a round's table
FILE_ROWS = 500_000
#: tasks at least that share the neighbours of a hot node
SALTS = 8


def _salted_join(left: DataFrame, right: DataFrame, key: str, by: str) -> DataFrame:
    """left.join(right, key), a key's rows on the left being spread by the hash of another column; keys are unique on the right."""
    salted = left.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    copied = right.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copied, [key, "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): each node of `edges` (a, b) with the smallest node that it reaches.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each round links a node's neighbours to the smallest of
    them, until every component is a star around its smallest node. A node's minimum is pre-aggregated before the shuffle and
    joined back by node and salt, so that no task gathers a hot node's neighbours. Each round's edges are written to the shared
    folder. Self loops and nulls are ignored; no edges give an empty result.
    """
    now = stored(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        # settled when every node above some other has one edge, to a node that has no edge down itself
        n = now.count()
        if now.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty() and now.select("v").distinct().join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        # large star: each neighbour above u goes to the smallest of u and its neighbours
        both = now.union(now.select("u", "v"))  # v: the node, u: its neighbour
        low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = _salted_join(both.where("u > v"), low, "v", "u").select(F.col("m").alias("v"), "u")
        # small star: each neighbour below u, and u, go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _salted_join(large, least, "u", "v").where("v <> m").select(F.col("m").alias("v"), F.col("v").alias("u"))
        before, now = now, stored(small.union(least.select(F.col("m").alias("v"), "u")).distinct().coalesce(-(-n // FILE_ROWS)), "edges")
        forget(before)
    else:
        raise RuntimeError("components did not settle")
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out._scratch = now._scratch  # the caller may forget it
    return out
