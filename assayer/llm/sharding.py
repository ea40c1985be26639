"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

A group is all rows with equal texts; its size is a vector of bytes, tokens and rows. Groups are placed largest first, each on
the shard where the dot product of its vector with the shard's residual capacity is highest (Panigrahy et al., 2011), all
measured in shares of the totals.

The driver places size classes, not groups: groups whose bytes, tokens and rows are equal but for steps of a logarithmic scale
have one vector, their mean. Of a class, each placement lowers a shard's dot product by the same amount, so how many groups each
shard takes follows from the dot products alone (`_filled`), without a loop over groups. A group then takes its shard by its rank
in its class. Steps are made coarser until there are `CLASSES` classes at most. A group above 1/`ALONE` of a total, of which there
can be `3 * ALONE`, is a class of its own, and is whole unless it holds more than 1/`PARTS` of a shard, when it is cut into pieces
of about that size by the hash of doc_id and the row. So the driver's work is bounded, and a hot group spreads over the shards.

The law that holds is `bytes`. Where the last placements leave bytes uneven, groups are moved between the fullest and the emptiest
shard as long as the other two axes stay as even as they are, or within `SLACK` (`_evened`).

Defined cases: a null text has no bytes or tokens and is of one group with empty texts; its size is 1, as an empty text's; a text
of any length is one group; ties of dot products go to the lower shard; an empty table gives no rows; rows that repeat doc_id and
text, or have no doc_id, are rows of one group, each with a slot of its own; extra columns are ignored by `shards`.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm._store import forget, numbered, stored

SHARDS = 8
ALONE, PARTS = 2048, 4
#: classes at most; steps an octave of bytes, and of tokens and rows, at first
CLASSES, STEPS = 1 << 16, (32, 4)
#: share of a shard by which tokens and rows may differ when bytes are evened
SLACK = 0.005
_AXES = ("bytes", "tokens", "rows")


def _filled(gain: np.ndarray, n: int, step: float) -> np.ndarray:
    """How many of n equal items each shard takes, if each goes to the highest gain and lowers it by `step`; ties go to the lower shard."""
    if n == 1 or step <= 0:
        return np.bincount([int(np.argmax(gain))] * n, minlength=len(gain))
    # the level that the gains come down to, from the shards that take part
    order = np.argsort(-gain, kind="stable")
    level = gain[order[0]] - step * n
    for k in range(1, len(gain) + 1):
        level = (gain[order[:k]].sum() - step * n) / k
        if k == len(gain) or gain[order[k]] <= level:
            break
    out = np.maximum(0, np.floor((gain - level) / step - 1)).astype(np.int64)
    for _ in range(n - int(out.sum())):  # at most two a shard
        out[int(np.argmax(gain - step * out))] += 1
    return out


def place(vectors: np.ndarray, counts: np.ndarray, shards: int) -> np.ndarray:
    """(classes x shards): how many groups of each class every shard takes. `vectors`: a group's bytes, tokens and rows."""
    vectors = np.asarray(vectors, dtype=float).reshape(-1, 3)
    total = (vectors * counts[:, None]).sum(axis=0)
    share = vectors / np.where(total > 0, total, 1.0)
    out, left = np.zeros((len(vectors), shards), dtype=np.int64), np.full((shards, 3), 1.0 / shards)
    for i in np.lexsort((np.arange(len(share)), -share.max(axis=1))):
        out[i] = _filled(left @ share[i], int(counts[i]), float(share[i] @ share[i]))
        left -= out[i][:, None] * share[i]
    return _evened(out, share, shards)


def _evened(taken: np.ndarray, share: np.ndarray, shards: int) -> np.ndarray:
    """Moves groups of a class from the shard of most bytes to that of least while this narrows the gap and keeps the other axes even."""
    sums = taken.T @ share
    for _ in range(64 * shards):
        a, b = int(np.argmax(sums[:, 0])), int(np.argmin(sums[:, 0]))
        gap = sums[a, 0] - sums[b, 0]
        size = share[:, 0]
        mine = np.flatnonzero((taken[:, a] > 0) & (size > 0) & (size < gap))
        if gap * shards < 1e-6 or not len(mine):
            break
        k = np.clip(np.floor(gap / 2 / size[mine]), 1, taken[mine, a]).astype(np.int64)
        moved = k[:, None] * share[mine]
        worst = np.abs(sums[:, 1:] * shards - 1).max(initial=0)
        off = np.abs(np.concatenate([sums[a, 1:] - moved[:, 1:], sums[b, 1:] + moved[:, 1:]], axis=1) * shards - 1).max(axis=1)
        miss = np.where(off <= max(worst, SLACK), np.abs(gap / 2 - moved[:, 0]), np.inf)
        j = int(np.argmin(miss))
        if miss[j] >= gap / 2 * (1 - 1e-9):
            break
        taken[mine[j], a] -= k[j]
        taken[mine[j], b] += k[j]
        sums[a] -= moved[j]
        sums[b] += moved[j]
    return taken


def _class(steps: Sequence[float]) -> Column:
    """The size class of a group's bytes, tokens and rows."""
    step = lambda c, n: F.floor(F.log2(F.col(c) + 1) * F.lit(float(n)))
    return F.concat_ws("/", step("bytes", steps[0]), step("tokens", steps[1]), step("rows", steps[1]))


def shards(docs: DataFrame, n: int = SHARDS) -> DataFrame:
    """Each row of `docs` (doc_id, text) with its group's shard, from 0 to n - 1, and a gapless slot in it."""
    spark, text = docs.sparkSession, F.col("text").cast("string")
    features = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))).alias("key"),
        F.when(F.length(F.trim(text)) > 0, F.size(F.split(F.trim(text), "\\s+"))).otherwise(0).cast("long").alias("tokens"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = stored(features, "features")
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    total = rows.agg(*sums).first()
    groups = stored(rows.groupBy("key").agg(*sums), "groups")
    share = F.greatest(*(F.col(c) / F.lit(float(max(1, t or 0))) for c, t in zip(_AXES, total, strict=True)))
    pieces = F.when(F.col("rows") > 1, F.least(F.ceil(share * n * PARTS), F.col("rows"))).otherwise(1).cast("long")
    # 3 * ALONE rows at most
    large = groups.where(share > 1 / ALONE).select("key", pieces.alias("pieces"))
    piece = F.concat_ws(":", F.hex("key"), F.pmod(F.xxhash64("doc_id", "row"), F.col("pieces")))
    dealt = stored(rows.join(F.broadcast(large), "key", "left").withColumn("item", F.when(F.col("pieces").isNotNull(), piece)).drop("pieces"), "dealt")
    single = dealt.where("item is not null").groupBy("item").agg(*sums).orderBy("item").collect()
    steps = list(STEPS)
    small = groups.where(share <= 1 / ALONE)
    while (classes := small.groupBy(_class(steps).alias("item")).agg(*(F.sum(c).alias(c) for c in _AXES), F.count(F.lit(1)).alias("n")).orderBy("item").limit(CLASSES + 1).collect()) and len(classes) > CLASSES:
        steps = [x / 2 for x in steps]
    vectors = [[r[a] for a in _AXES] for r in single] + [[r[a] / r["n"] for a in _AXES] for r in classes]
    counts = np.array([1] * len(single) + [r["n"] for r in classes], dtype=np.int64)
    taken = place(np.array(vectors, dtype=float), counts, n)
    names = [r["item"] for r in single] + [r["item"] for r in classes]
    # a row for each single group and class
    table = F.broadcast(spark.createDataFrame([(i, [int(x) for x in np.cumsum(t)]) for i, t in zip(names, taken, strict=True)], "item string, upto array<long>"))
    shard = lambda rank: F.size(F.filter("upto", lambda x: x <= rank)).cast("int").alias("shard")
    ranked = numbered(small.select("key", _class(steps).alias("item")), ["item"], ["key"], "rank")
    placed = stored(ranked.join(table, "item").select("key", "item", shard(F.col("rank"))), "placed")
    columns = ["doc_id", "size", "text_crc32", "tokens", "row", "item", "shard"]
    of_classes = dealt.where("item is null").drop("item").join(placed, "key").select(*columns)
    alone = dealt.where("item is not null").join(table, "item").withColumn("shard", shard(F.lit(0))).select(*columns)
    out = stored(of_classes.union(alone), "sharded")
    forget(rows, groups, dealt, placed)
    return numbered(out, ["shard"], ["doc_id", "text_crc32", "row"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens", "item"
    )


def summary(placed: DataFrame) -> DataFrame:
    """Bytes, tokens and rows of each shard."""
    return placed.groupBy("shard").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))


def spread(values: Sequence[int]) -> float:
    """The largest value over the mean, less one."""
    return max(values) * len(values) / max(1, sum(values)) - 1
