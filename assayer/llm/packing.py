"""Sequence packing with optimal length buckets.

The histogram of lengths over the whole corpus goes to the driver: it has one row for each length up to `max_len`, however many
documents there are. Dynamic programming over it chooses the boundaries of `buckets` buckets so that the padding up to each
sequence's boundary is least. Inside a bucket, batches hold as many sequences as the token budget allows at the bucket's length.

Lengths are counted in words (runs of other than ASCII white space), or by any column that the caller names. A document longer
than `max_len` is cut into whole pieces of `max_len` tokens and a rest, each of which is packed; nothing is dropped.

Defined cases: a null or empty text, or one of white space alone, has no tokens and makes one sequence of length 0 in the first
bucket; repeated rows are packed each; rows that are equal in all that orders them take neighbouring places in either order; of
boundaries with equal padding the first found stand; very long texts only count by their words; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm._store import numbered, stored

BUCKETS, MAX_LEN, BUDGET = 8, 4096, 32_768
_SPACE = "[\\x20\\x09-\\x0D]+"


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper boundaries, the last being the longest length, of at most `buckets` buckets with the least total padding.

    Of equally good choices the one whose last bucket begins at the shortest length is taken, and so on backwards.
    """
    order = np.argsort(lengths)
    x, n = np.asarray(lengths)[order].astype(np.int64), np.asarray(counts)[order].astype(np.int64)
    if not len(x):
        return []
    rows = np.concatenate([[0], np.cumsum(n)])
    tokens = np.concatenate([[0], np.cumsum(n * x)])
    # cost of a bucket over i..j-1: every sequence padded to x[j-1]
    best = x * rows[1:] - tokens[1:]
    cuts = [np.zeros(len(x), dtype=np.int64)]
    for _ in range(1, min(buckets, len(x))):
        now, cut = best.copy(), np.zeros(len(x), dtype=np.int64)
        for j in range(1, len(x)):
            i = np.arange(1, j + 1)
            cost = best[i - 1] + x[j] * (rows[j + 1] - rows[i]) - (tokens[j + 1] - tokens[i])
            k = int(np.argmin(cost))
            if cost[k] < now[j]:
                now[j], cut[j] = cost[k], i[k]
        cuts.append(cut)
        best = now
    out, j = [], len(x) - 1
    for cut in reversed(cuts):
        out.append(int(x[j]))
        if cut[j] == 0:
            break
        j = int(cut[j]) - 1
    return out[::-1]


def words(text: Column) -> Column:
    """The number of words; null has none."""
    bare = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), f"^{_SPACE}|{_SPACE}$", "")
    return F.when(F.length(bare) > 0, F.size(F.split(bare, _SPACE))).otherwise(0).cast("long")


def packed(docs: DataFrame, length: Column | None = None, buckets: int = BUCKETS, max_len: int = MAX_LEN, budget: int = BUDGET) -> DataFrame:
    """One row for each sequence: doc_id, piece, its first token and number of tokens, bucket, bucket_len, batch and slot in it.

    Batches are numbered from 0 within a bucket; all but a bucket's last hold `budget // bucket_len` sequences (at least one).
    """
    if buckets < 1 or max_len < 1 or budget < max_len:
        raise ValueError("buckets and max_len must be positive, and a budget must hold a sequence of max_len")
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (words(F.col("text")) if length is None else length.cast("long")).alias("n"))
    pieces = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / max_len).cast("long") - 1, F.lit(0).cast("long")))
    sequences = counted.select("doc_id", "n", F.explode(pieces).alias("piece"))
    sequences = stored(sequences.select("doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * max_len).alias("first_token"), F.least(F.col("n") - F.col("piece") * max_len, F.lit(max_len)).alias("n_tokens"), F.monotonically_increasing_id().alias("row")), "sequences")
    histogram = sequences.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("rows")).collect()
    bounds = boundaries(np.array([r["n_tokens"] for r in histogram]), np.array([r["rows"] for r in histogram]), buckets)
    if not bounds:
        bounds = [0]
    limits = F.array(*(F.lit(x).cast("long") for x in bounds))
    bucket = F.size(F.filter(limits, lambda x: x < F.col("n_tokens")))
    rows = sequences.withColumn("bucket", bucket).withColumn("bucket_len", F.element_at(limits, F.col("bucket") + 1))
    rows = numbered(rows, ["bucket", "bucket_len"], ["doc_id", "piece", "row"], "rank")
    each = F.greatest(F.floor(F.lit(budget) / F.greatest("bucket_len", F.lit(1))), F.lit(1))
    return rows.select(
        "doc_id", "piece", "first_token", "n_tokens", "bucket", "bucket_len", F.floor(F.col("rank") / each).cast("long").alias("batch"), (F.col("rank") % each).cast("long").alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding")
    )
