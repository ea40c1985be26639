"""Removal of long repeated byte strings by bucket-pointer refinement.

A full suffix array orders positions by their suffixes; for the removal of strings of `length` bytes, only equality up to that
depth matters, so refinement stops there. As in bucket-pointer refinement (Schuermann and Stoye, 2007), positions start in
buckets of equal q-grams, and a bucket is refined by the identifiers of what follows at later offsets, each round working only
on what the round before left undecided:

0. Every window of `length` bytes is represented by one position in it, the last one of the least q-gram hash. Equal windows
   have their representative at equal offsets, so they meet in its q-gram's bucket. A representative stands for a run of
   consecutive windows, whose offsets from it lie in `[low, high]`. A bucket of one position holds no repeated window.
1. In a bucket, runs are told apart by the identifier of the bytes that all their windows cover together. Two equal runs
   decide all windows of both. This is the case anywhere inside a repeated passage.
2. Undecided runs are cut into blocks of `BLOCK` offsets. A block's core is what all its windows share; a core that occurs once
   decides the block (nothing repeats), and two equal blocks decide it (all windows repeat).
3. Of undecided blocks, which lie at the borders of repeated passages, each window gets its identifier and is counted.

This departs from the paper where a distributed table forces it to: identifiers are 64-bit hashes of the bytes from an offset on,
taken from prefix sums, instead of pointers to buckets in one shared array, and only representatives are refined. Equal
identifiers still mean equal buckets, and each round refines the buckets that the last one left.

The same refinement over words instead of bytes (`WORDS` in a row, rounds 0, 1 and 3) finds passages that other documents hold,
however their white space and the case of A-Z differ. They are reported (`passage_words`, `n_passages`), not removed.

Counts are pre-aggregated before each shuffle, so no task holds a hot bucket. Texts are shuffled once, into a table dealt by text
key, which the later rounds read in place; copies of a text are one row of it, and are themselves repeated strings where they are
long enough.

Defined cases: null is an empty text; a text shorter than `length` loses nothing; an empty table gives no rows; repeated rows are
copies of one another, so each counts as repeated; of equal least hashes in a window the last place represents it; a text of any
length is one piece, whose representatives do not depend on what it is read with (a task must hold the longest text some twenty
times); extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm._store import forget, shared_dir, stored
from assayer.llm._words import NOT_SPACE, Words, mixed, prefix_sums, slices, span_hash, sums, word_counts

LENGTH, Q, BLOCK = 400, 96, 16
#: words of a passage that counts as shared; words that name its bucket
WORDS, WORDS_Q = 50, 12
#: bytes of text in a bucket of the table of texts
BUCKET_BYTES = 64 << 20
#: windows that are represented at once; with `length` more, fewer than 2**24
_AT_ONCE = 1 << 23
_PLACE = np.uint64((1 << 24) - 1)
_FAR = np.uint64(2**64 - 1)


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values (van Herk): least ends and beginnings of blocks of w."""
    n = len(x)
    blocks = np.concatenate([x, np.full(-n % w, _FAR, dtype=x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def _representatives(c: np.ndarray, length: int, q: int) -> np.ndarray:
    """The place that represents each window: of those with the least 40 bits of a q-gram hash, the last."""
    out, windows = [], len(c) - length
    for a in range(0, windows, _AT_ONCE):
        at = np.arange(a, min(a + _AT_ONCE, windows) + length - q)
        key = (span_hash(c, at, at + q) & ~_PLACE) | (_PLACE - (at - a).astype(np.uint64))
        least = _sliding_least(key, length - q + 1)
        out.append(a + (_PLACE - (least & _PLACE)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def _runs(c: np.ndarray, offs: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(representative, first window, last window) for each run of windows with one representative; `c`: sums over the texts."""
    best = _representatives(c, length, q)
    # windows inside one text
    valid = np.zeros(len(c), dtype=np.int64)
    long = np.diff(offs) >= length
    np.add.at(valid, offs[:-1][long], 1)
    np.add.at(valid, offs[1:][long] - length + 1, -1)
    ok = np.flatnonzero(np.cumsum(valid)[: len(best)])
    if not len(ok):
        return ok, ok, ok
    new = np.append(True, (np.diff(best[ok]) != 0) | (np.diff(ok) != 1))
    a = np.flatnonzero(new)
    return best[ok[a]], ok[a], ok[np.append(a[1:], len(ok)) - 1]


def _bytes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the bytes of a slice, and where its texts begin."""
    return prefix_sums(data), offs


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same in words."""
    w = Words(data, offs, NOT_SPACE)
    return sums(w.hash), w.first


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _reach(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return mixed((low.astype(np.uint64) << np.uint64(32)) | high.astype(np.uint64))


def _all_runs(length: int, q: int, units=_bytes):
    """h: q-gram, u: whole run, tid: text, p: representative, low and high: offsets of its windows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, data, offs in slices(batch):
                c, starts = units(data, offs)
                p, s, e = _runs(c, starts, length, q)
                doc = np.searchsorted(starts, p, side="right") - 1
                low, high = p - e, p - s
                u = mixed(span_hash(c, s, e + length) + _reach(low, high))
                tid = batch.column(0).take(pa.array(a + doc))
                yield pa.record_batch([_signed(span_hash(c, p, p + q)), _signed(u), tid, *(pa.array(x.astype(np.int32)) for x in (p - starts[doc], low, high))], names=["h", "u", "tid", "p", "low", "high"])

    return scan


def _each_text(batches: Iterator[pa.RecordBatch], units) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For rows (tid, text, p, low, high), the last three lists: sums over a slice, where its texts begin and, for each list
    entry, its row and place in the slice."""
    for batch in batches:
        for a, b, data, offs in slices(batch):
            rows = batch.slice(a, b - a)
            lists = [rows.column(rows.schema.get_field_index(k)) for k in ("p", "low", "high")]
            n = np.diff(np.asarray(lists[0].offsets))
            doc = np.repeat(np.arange(b - a), n)
            p, low, high = (np.asarray(x.flatten()).astype(np.int64) for x in lists)
            c, starts = units(data, offs)
            yield rows, doc, c, starts, starts[doc] + p, low, high


def _blocks(length: int, q: int, block: int):
    """k: block and its core, u: its windows; tid, p, low and high of the block's part of a run."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, doc, c, starts, p, low, high in _each_text(batches, _bytes):
            first, n = low // block, high // block - low // block + 1
            i = np.repeat(np.arange(len(p)), n)
            v = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[i]
            p, d0, d1 = p[i], v * block, v * block + block - 1
            low, high = np.maximum(d0, low[i]), np.minimum(d1, high[i])
            core = mixed(span_hash(c, p - d0, np.maximum(p + q, p - d1 + length)) + v.astype(np.uint64))
            u = mixed(span_hash(c, p - high, p - low + length) + _reach(low, high))
            place = p - starts[doc[i]]
            yield pa.record_batch([_signed(core), _signed(u), rows.column(0).take(pa.array(doc[i])), *(pa.array(x.astype(np.int32)) for x in (place, low, high))], names=["h", "u", "tid", "p", "low", "high"])

    return scan


def _windows(length: int, units=_bytes):
    """h: a window's identifier; tid and start of it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, doc, c, starts, p, low, high in _each_text(batches, units):
            n = high - low + 1
            i = np.repeat(np.arange(len(p)), n)
            s = p[i] - (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[i])
            yield pa.record_batch([_signed(span_hash(c, s, s + length)), rows.column(0).take(pa.array(doc[i])), pa.array((s - starts[doc[i]]).astype(np.int32))], names=["h", "tid", "s"])

    return scan


_ROWS = "h long, u long, tid binary, p int, low int, high int"


def _refined(rows: DataFrame, length: int, tag: str, across: bool = False) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(spans (tid, start, end) of rows that another row equals, rows left undecided, tables that both read): of a bucket h with
    different runs u, the undecided ones and one of each decided, against which they may match in part. With `across`, only rows
    of another text count as others."""
    text = F.xxhash64("tid")
    apart = F.min(text) != F.max(text) if across else F.count(F.lit(1)) > 1
    often = rows.groupBy("h").agg(apart.alias("often"), F.min("u").alias("u0"), F.max("u").alias("u1")).where("often")
    # written, so that the joins shuffle their sides for themselves and can split a hot bucket
    often = stored(often.select("h", (F.col("u0") != F.col("u1")).alias("mixed")), f"{tag}-often")
    kept = stored(rows.join(often, "h"), f"{tag}-buckets")
    forget(rows, often)
    row = F.struct("tid", "p", "low", "high")
    runs = kept.groupBy("h", "u").agg(F.count(F.lit(1)).alias("n"), apart.alias("twice"), F.first("mixed").alias("mixed"), F.min(row).alias("one"), *([F.max(row).alias("other")] if across else []))
    runs = stored(runs, f"{tag}-runs")
    equal = kept.join(runs.where("twice").select("h", "u"), ["h", "u"], "left_semi").select("tid", (F.col("p") - F.col("high")).alias("start"), (F.col("p") - F.col("low") + length).alias("end"))
    left = runs.where("mixed").select("one.*")
    if across:  # of a decided run, a row of another text besides; all rows of a run that one text alone holds several times
        own = runs.where("mixed and n > 1 and not twice").select("h", "u")
        left = left.union(runs.where("mixed and twice").select("other.*")).union(kept.join(own, ["h", "u"], "left_semi").select("tid", "p", "low", "high"))
    return equal, left, [kept, runs]


def _with_text(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """Each text with the lists of its rows; the table of texts stays where it is."""
    lists = rows.groupBy("tid").agg(F.collect_list(F.struct("p", "low", "high")).alias("x")).selectExpr("tid", "x.p as p", "x.low as low", "x.high as high")
    return texts.join(lists.hint("shuffle_hash"), "tid").select("tid", "text", "p", "low", "high")


def _removed(data: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, str]:
    """(bytes removed, maximal runs, hash of the rest) for spans in any order."""
    kept, at, gone, runs = hashlib.sha256(), 0, 0, 0
    end = -1
    for a, b in sorted(spans):
        if a > end:
            if end >= 0:
                at = end
            kept.update(data[at:a])
            runs += 1
            gone += b - a
            end = b
        elif b > end:
            gone += b - end
            end = b
    kept.update(data[max(end, 0) :])
    return gone, runs, kept.hexdigest()


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, words = [], [np.zeros(0, dtype=np.int64)]
        for text, spans in zip(batch.column(1).cast(pa.large_binary()), batch.column(2), strict=True):
            out.append(_removed(text.as_py() or b"", [(x["start"], x["end"]) for x in spans.as_py() or ()]))
        for _, _, data, offs in slices(batch):
            words.append(word_counts(data, offs, NOT_SPACE))
        yield pa.record_batch([batch.column(0), *(pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))), pa.array(np.concatenate(words))], names=["tid", "n_removed", "n_spans", "kept_sha256", "n_words"])


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _dealt_texts(docs: DataFrame, bytes_: int) -> tuple[str, DataFrame]:
    """Different texts as a table dealt by key, in the shared folder; copies are dropped before the shuffle already."""
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-bytes_ // BUCKET_BYTES))
    table = f"assayer_texts_{uuid.uuid4().hex}"
    texts = docs.select(_text_key(F.col("text")).alias("tid"), "text").where("text is not null").groupBy("tid").agg(F.first("text").alias("text"))
    texts.repartition(n, "tid").write.bucketBy(n, "tid").option("path", f"{shared_dir(spark)}/assayer/{table}").saveAsTable(table)
    frame = spark.table(table)
    frame._scratch = f"{shared_dir(spark)}/assayer/{table}"
    return table, frame


def _passages(texts: DataFrame, length: int) -> tuple[DataFrame, list[DataFrame]]:
    """((tid, passage_words, n_passages) of texts with passages of `length` words that another text holds, tables that it reads)."""
    q = min(WORDS_Q, length)
    spans, left, used = _refined(stored(texts.mapInArrow(_all_runs(length, q, _words), _ROWS), "word-runs"), length, "word-runs", across=True)
    windows = stored(_with_text(texts, left).mapInArrow(_windows(length, _words), "h long, tid binary, s int"), "word-windows")
    t = F.xxhash64("tid")
    twice = stored(windows.groupBy("h").agg((F.min(t) != F.max(t)).alias("twice")).where("twice").select("h"), "word-twice")
    last = windows.join(twice, "h", "left_semi").select("tid", F.col("s").alias("start"), (F.col("s") + length).alias("end"))
    every = spans.union(last).groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    # the spans by their starts: those that begin after the end of all before open a passage
    step = lambda acc, x: F.struct(
        F.greatest(acc["end"], x["end"]).alias("end"),
        (acc["words"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["end"], x["start"]))).alias("words"),
        (acc["n"] + F.when(x["start"] > acc["end"], 1).otherwise(0)).alias("n"),
    )
    walked = every.select("tid", F.aggregate("spans", F.struct(F.lit(-1).alias("end"), F.lit(0).alias("words"), F.lit(0).alias("n")), step).alias("x"))
    found = walked.select("tid", F.col("x.words").cast("long").alias("passage_words"), F.col("x.n").cast("long").alias("n_passages"))
    return found, [*used, windows, twice]


def repeated_spans(docs: DataFrame, length: int = LENGTH, words: int = WORDS) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): its bytes, what is left without the bytes covered by strings of `length` bytes
    that also start anywhere else, and how many of its words stand in passages of `words` words that another document holds."""
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = stored(docs.select("doc_id", _text_key(F.col("text")).alias("tid"), F.octet_length("text").cast("long").alias("n_bytes")), "ids")
    table, texts = _dealt_texts(docs, ids.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0])
    try:
        q = min(Q, length)
        runs = stored(texts.mapInArrow(_all_runs(length, q), _ROWS), "runs")
        spans, left, used = _refined(runs, length, "runs")
        blocks = stored(_with_text(texts, left).mapInArrow(_blocks(length, q, BLOCK), _ROWS), "blocks")
        more, left, used_too = _refined(blocks, length, "blocks")
        windows = stored(_with_text(texts, left).mapInArrow(_windows(length), "h long, tid binary, s int"), "windows")
        twice = windows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
        twice = stored(twice, "twice")
        last = windows.join(twice, "h", "left_semi").select("tid", F.col("s").alias("start"), (F.col("s") + length).alias("end"))
        every = spans.union(more).union(last).groupBy("tid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
        done = texts.join(every.hint("shuffle_hash"), "tid", "left").select("tid", "text", "spans")
        results = stored(done.mapInArrow(_results, "tid binary, n_removed long, n_spans long, kept_sha256 string, n_words long"), "results")
        forget(*used, *used_too, windows, twice)
        shared, used = _passages(texts, words)
        shared = stored(shared, "passages")
        forget(*used)
    finally:
        spark.sql(f"drop table if exists {table}")
        forget(texts)
    copies = ids.groupBy("tid").agg(F.count(F.lit(1)).alias("copies"), F.first("n_bytes").alias("n_bytes"))
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    held = (F.col("copies") > 1) & (F.col("n_words") >= words)  # copies hold all of one another
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    by_text = results.join(copies, "tid").join(shared, "tid", "left").select(
        "tid",
        F.when(whole, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(whole, nothing).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(held, F.col("n_words")).otherwise(F.coalesce("passage_words", F.lit(0))).cast("long").alias("passage_words"),
        F.when(held, F.lit(1)).otherwise(F.coalesce("n_passages", F.lit(0))).cast("long").alias("n_passages"),
    )
    # written, so that the join shuffles the ids for itself and can split a text that many share
    by_text = stored(by_text, "by-text")
    forget(results, shared)
    return ids.join(by_text, "tid").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "passage_words", "n_passages")
