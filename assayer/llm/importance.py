"""Importance resampling towards a target distribution of hashed word n-grams.

Features are runs of 1 to `n` consecutive words. One scan of a document keeps a ring of the running CRC states of the last `n`
starts: each next word extends every state by a space and itself and begins a state of its own, so the bucket of each run costs
one short step and no run is ever built as text. The raw corpus and the target give counts by bucket, whose smoothed log ratio
is a bucket's gain; a document's weight is the mean gain of its features. Adding Gumbel noise that depends on the document
alone and keeping the highest scores draws without replacement, with chances in proportion to exp(weight / 1000).

How it is distributed: a task sums its own features by bucket, so that the shuffle carries at most `buckets` rows a task, and the
gains (`buckets` numbers) go to all tasks. Scores are integers whose number of values is bounded by the logarithm of the corpus,
whatever its size; their histogram gives the score that the draw ends at and where each score's ranks begin. Only rows at or
above it are shuffled, by score; the noise spreads even a corpus of copies over thousands of scores, so no task holds many.

Defined cases: null and empty texts have no features, the weight 0 and no rank; very long texts are read whole, a task holds its
longest one a few times; equal scores rank by doc_id (null first), then by features and weight; repeated rows share their noise
and rank side by side; an empty corpus gives no rows and an empty target gives the gains of the smoothing alone; extra columns are
ignored by `scored` and kept by `resampled`, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm._store import stored

BUCKETS = 10_000
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: bytes) -> list[bytes]:
    """Words of a text in UTF-8: runs of ASCII letters and digits and all beyond ASCII, lower-cased in A to Z only."""
    return _WORD.findall(text.lower())


def ring(tokens: list[bytes], n: int) -> list[int]:
    """CRC-32 of every run of 1 to n consecutive words joined by one space, in one scan."""
    if n == 1:
        return list(map(crc32, tokens))
    out: list[int] = []
    states: list[int] = []
    for w in tokens:
        spaced = b" " + w
        states = [crc32(w), *(crc32(spaced, s) for s in states[: n - 1])]
        out += states
    return out


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for x in batch.column("text").cast(pa.large_binary()):
        yield x.as_py() or b""


def _counts(n: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in _texts(batch):
                total += np.bincount(np.array(ring(words(text), n), dtype=np.int64) % buckets, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    return scan


def bucket_counts(docs: DataFrame, n: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of `docs` (text) by bucket: `buckets` numbers, whatever the size of the corpus."""
    out = np.zeros(buckets, dtype=np.int64)
    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_counts(n, buckets), "bucket long, n long")
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousand times the logarithm of the smoothed ratio of shares, rounded down, by bucket."""
    s_all, t_all, k = int(raw.sum()), int(target.sum()), len(raw)
    out = [math.floor(1000 * math.log((float(t) + 1) * (float(s_all) + k) / ((float(s) + 1) * (float(t_all) + k)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)]
    return np.array(out, dtype=np.int64)


def noise(seed: int, doc_id: int | None) -> int:
    """Gumbel noise of a document, in thousandths, from its id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scores(gain: np.ndarray, n: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    buckets = len(gain)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for doc, text in zip(ids, _texts(batch), strict=True):
                tokens = words(text)
                at = np.array(ring(tokens, n), dtype=np.int64) % buckets
                weight = int(gain[at].sum()) // len(at) if len(at) else 0
                rows.append((len(tokens), len(at), weight, weight + noise(seed, doc)))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return scan


def scored(docs: DataFrame, target: DataFrame, *, percent: float = 10, n: int = 1, buckets: int = BUCKETS, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): its features, weight and score, and its rank if the draw takes it.

    Documents of at least `least_words` words take part; `percent` of them (rounded down) with the highest scores are drawn.
    `target` (text) gives the distribution to draw towards."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gain = gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets))
    rows = stored(docs.mapInArrow(_scores(gain, n, seed), "doc_id long, n_words long, n_features long, weight long, score long"), "scores")
    part = F.col("n_words") >= least_words
    # one row a score: bounded by the range of integer scores, not by the corpus
    held = sorted(((r.score, r.n) for r in rows.where(part).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    draws = math.floor(percent * sum(c for _, c in held) / 100)
    above, starts = 0, []
    for score, c in held:
        if above >= draws:
            break
        starts.append((score, above))
        above += c
    cut = starts[-1][0] if starts else None
    reached = part & (F.col("score") >= F.lit(cut)) if starts else F.lit(False)
    at = docs.sparkSession.createDataFrame(starts, "score long, above long")
    place = "row_number() over (partition by score order by doc_id, n_features, weight)"
    drawn = rows.where(reached).join(F.broadcast(at), "score").selectExpr("doc_id", "n_words", "n_features", "weight", "score", f"above + {place} as rank")
    rest = rows.where(~reached).withColumn("rank", F.lit(None).cast("long"))
    return drawn.withColumn("rank", F.when(F.col("rank") <= draws, F.col("rank")).cast("long")).unionByName(rest)


def resampled(docs: DataFrame, target: DataFrame, **options: float) -> DataFrame:
    """The rows of `docs` that the draw takes, with their texts and all other columns. Ids should be unique: a repeated one is
    drawn with all its rows."""
    key = "_drawn_id"
    chosen = scored(docs, target, **options).where("rank is not null").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(chosen, docs["doc_id"].cast("long").eqNullSafe(chosen[key]), "left_semi")
