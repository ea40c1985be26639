"""Benchmark decontamination with suffix arrays over the training words.

Each task holds a shard of the training texts. Its suffix array orders the shard's word positions by the words that follow;
every test suffix is binary-searched in it, which gives all its verbatim matches and their places. Only buckets of the array
that some test suffix names by its first words are sorted: a suffix in any other bucket can match none. Matches that follow one
another in both texts are one longer match, so the longest verbatim match is found whatever its length; matches shorter than a
window are not reported.

Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. A test window is `window` consecutive words of
an item, or the whole item where it has fewer. Words are compared by 64-bit hashes.

Items go to the tasks in blocks of `BLOCK_BYTES`, and a pass over the training texts takes `BLOCKS` of them at most, so neither the
driver nor a task holds more, however large the benchmark is. One pass does for up to `BLOCKS * BLOCK_BYTES`; for more, each pass
writes what it found and the findings are joined by row.

Defined cases: a null or empty text has no words, is not contaminated and is no item; an item of fewer words than a window is one
window; repeated documents each get their row; repeated item ids count once; an item without id contaminates but is not listed or
counted among the items; with an empty benchmark nothing is contaminated; of equally long matches the first place in the document
counts; a text of any length is read whole by one task, which holds it some ten times. Extra columns are ignored by
`contamination` and kept by `without_contaminated`.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm._store import forget, stored
from assayer.llm._words import ALNUM, Words, grams, slices

WINDOW = 10
#: words that name a bucket of the suffix array
BUCKET = 4
#: bytes of items that are sent to the executors at once; more items make more blocks. Blocks of a pass
BLOCK_BYTES, BLOCKS = 4 << 20, 4
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, match_start long"


class Probe:
    """The test suffixes of a block of items (id or None, text)."""

    def __init__(self, items: list[tuple[str | None, str]], window: int) -> None:
        self.window = window
        self.ids = sorted({i for i, _ in items if i is not None})
        number = {x: k for k, x in enumerate(self.ids)} | {None: -1}
        texts = pa.record_batch({"text": pa.array([t for _, t in items], pa.string())})
        hashes, item, at, length, begin = [], [], [], [], []
        done = 0
        for a, _, data, offs in slices(texts):
            w = Words(data, offs, ALNUM)
            hashes.append(w.hash)
            n = np.diff(w.first)
            windows = np.where(n > 0, np.maximum(n - window + 1, 1), 0)
            own = np.repeat(np.arange(len(n)), windows)
            place = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows)
            item.append(np.array([number[items[a + k][0]] for k in range(len(n))], dtype=np.int64)[own])
            at.append(place)
            length.append(np.minimum(n, window)[own])
            begin.append(done + w.first[own] + place)
            done += len(w.hash)
        joined = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, dtype=t)
        self.words = joined(hashes, np.uint64)
        self.item, self.at, self.length, self.begin = (joined(x, np.int64) for x in (item, at, length, begin))
        #: of each length of bucket names: a bit map for a first look, the sorted names and the windows in their order
        self.names: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for q in np.unique(np.minimum(BUCKET, self.length)).tolist():
            own = np.flatnonzero(np.minimum(self.length, BUCKET) == q)
            every = grams(self.words, q)[self.begin[own]]
            order = np.argsort(every, kind="stable")
            bits = np.zeros(1 << 20, dtype=bool)
            bits[every >> np.uint64(44)] = True
            self.names[q] = bits, every[order], own[order]

    def buckets(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the shard in buckets that a test suffix names, and the test windows that name them."""
        places, windows = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for q, (bits, names, own) in self.names.items():
            g = grams(h, q)
            c = np.flatnonzero(bits[g >> np.uint64(44)])
            k = np.searchsorted(names, g[c])
            c = c[names[np.minimum(k, len(names) - 1)] == g[c]]
            places.append(c)
            held = np.unique(g[c])
            a, b = np.searchsorted(names, held, side="left"), np.searchsorted(names, held, side="right")
            windows.append(own[np.repeat(a, b - a) + np.arange((b - a).sum()) - np.repeat(np.cumsum(b - a) - (b - a), b - a)])
        return np.unique(np.concatenate(places)), np.concatenate(windows)

    def matches(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) for each occurrence of a test window inside one document of the shard."""
        c, tests = self.buckets(w.hash)
        if not len(c):
            return c, tests
        past = w.first[w.doc[c] + 1]
        padded = np.append(w.hash, np.zeros(self.window, dtype=np.uint64))
        suffix = np.stack([np.where(c + k < past, padded[c + k], np.uint64(0)) for k in range(self.window)], axis=1)
        order = np.lexsort(suffix.T[::-1])
        array = _sortable(suffix[order])
        # the keys of the tests in question only: from the least to the greatest suffix that begins with the window
        words, inside = np.append(self.words, np.zeros(self.window, dtype=np.uint64)), np.arange(self.window) < self.length[tests][:, None]
        keys = words[self.begin[tests][:, None] + np.arange(self.window)]
        low = np.searchsorted(array, _sortable(np.where(inside, keys, np.uint64(0))), side="left")
        n = np.searchsorted(array, _sortable(np.where(inside, keys, np.uint64(2**64 - 1))), side="right") - low
        which = np.repeat(tests, n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        return c[order[place]], which


def _sortable(x: np.ndarray) -> np.ndarray:
    """Rows of 64-bit numbers as byte strings that sort in the same order."""
    return np.ascontiguousarray(x.astype(">u8")).view(f"S{8 * x.shape[1]}").ravel()


def _found(probes: list[Broadcast], data: np.ndarray, offs: np.ndarray) -> tuple[Words, np.ndarray, dict[int, set[str]], np.ndarray, np.ndarray]:
    """(words, how many windows more cover each word than the one before, items by document, longest matches, their places) of a shard."""
    w = Words(data, offs, ALNUM)
    docs = len(offs) - 1
    cover = np.zeros(len(w.hash) + 1, dtype=np.int64)
    items: dict[int, set[str]] = {}
    longest, begins = np.zeros(docs, dtype=np.int64), np.full(docs, -1, dtype=np.int64)
    for b in probes:
        probe = b.value
        place, which = probe.matches(w)
        if not len(place):
            continue
        n = probe.length[which]
        np.add.at(cover, place, 1)
        np.add.at(cover, place + n, -1)
        doc, item = w.doc[place], probe.item[which]
        named = item >= 0
        for d, i in np.unique(np.stack([doc[named], item[named]], axis=1), axis=0).tolist():
            items.setdefault(d, set()).add(probe.ids[i])
        # windows that follow one another in both texts make one longer match
        line = probe.begin[which] - place
        o = np.lexsort((place, line, doc))
        new = np.ones(len(o), dtype=bool)
        new[1:] = (np.diff(place[o]) != 1) | (np.diff(line[o]) != 0) | (np.diff(which[o]) != 1) | (np.diff(doc[o]) != 0)
        a = np.flatnonzero(new)
        z = np.append(a[1:], len(o)) - 1
        size = place[o][z] - place[o][a] + n[o][z]
        for d, s, p in zip(doc[o][a].tolist(), size.tolist(), place[o][a].tolist(), strict=True):
            p -= w.first[d]
            if (s, -p) > (longest[d], -begins[d]):
                longest[d], begins[d] = s, p
    return w, cover, items, longest, begins


def _scan(probes: list[Broadcast], data: np.ndarray, offs: np.ndarray) -> dict[str, list]:
    """The result columns of one shard, without doc_id."""
    w, cover, items, longest, begins = _found(probes, data, offs)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(cover)[:-1] > 0)])
    n_hit = hit[w.first[1:]] - hit[w.first[:-1]]
    found = [sorted(items.get(d, ())) for d in range(len(offs) - 1)]
    return {
        "n_words": np.diff(w.first).astype(np.int64),
        "n_hit": n_hit,
        "n_items": np.array([len(x) for x in found], dtype=np.int64),
        "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in found],
        "contaminated": n_hit > 0,
        "longest_match": longest,
        "match_start": begins,
    }


def _passes(spark: SparkSession, bench: DataFrame, window: int) -> Iterator[list[Broadcast]]:
    """The items' windows, broadcast in blocks of bounded size, a few blocks for each pass over the training texts."""
    items = bench.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_BYTES))
    if blocks == 1:
        yield [spark.sparkContext.broadcast(Probe([tuple(r) for r in items.collect()], window))]
        return
    dealt = stored(items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))), "items")
    for k in range(0, blocks, BLOCKS):
        sent = []
        for j in range(k, min(k + BLOCKS, blocks)):
            rows = dealt.where(F.col("block") == j).select("item", "text").collect()
            sent.append(spark.sparkContext.broadcast(Probe([tuple(r) for r in rows], window)))
        yield sent
    forget(dealt)


def _each(probes: list[Broadcast], made: Callable) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in slices(batch):
                yield made(batch.slice(a, b - a), probes, data, offs)

    return scan


def _rows(rows: pa.RecordBatch, probes: list[Broadcast], data: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"doc_id": rows.column(0)} | _scan(probes, data, offs))


def _partly(rows: pa.RecordBatch, probes: list[Broadcast], data: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
    """For rows (row, text) with matches: the covered runs of words, the items and the longest match."""
    w, cover, items, longest, begins = _found(probes, data, offs)
    covered = (np.cumsum(cover)[:-1] > 0).astype(np.int8)
    out = []
    for d in np.flatnonzero(longest > 0).tolist():
        edges = np.diff(np.concatenate([[0], covered[w.first[d] : w.first[d + 1]], [0]]))
        runs = [{"a": a, "b": b} for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True)]
        out.append((rows.column(0)[d].as_py(), runs, sorted(items.get(d, ())), int(longest[d]), int(begins[d])))
    kinds = (pa.int64(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])), pa.list_(pa.string()), pa.int64(), pa.int64())
    columns = list(zip(*out, strict=True)) or [()] * 5
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["row", "runs", "items", "size", "start"])


def _kept(rows: pa.RecordBatch, probes: list[Broadcast], data: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
    return rows.filter(pa.array(_found(probes, data, offs)[3] == 0))


def _in_passes(docs: DataFrame, passes: Iterator[list[Broadcast]]) -> DataFrame:
    """What one pass would give, from the written findings of many."""
    rows = stored(docs.withColumn("row", F.monotonically_increasing_id()), "texts")
    every = []
    for probes in passes:
        found = rows.select("row", "text").mapInArrow(_each(probes, _partly), "row long, runs array<struct<a:int,b:int>>, items array<string>, size long, start long")
        every.append(stored(found, "pass"))
        for b in probes:
            b.destroy()
    found = every[0]
    for more in every[1:]:
        found = found.union(more)
    match = F.struct("size", (-F.col("start")).alias("start"))
    one = found.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max(match).alias("m"))
    step = lambda acc, x: F.struct(F.greatest(acc["end"], x["b"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(acc["end"], x["a"]))).alias("n"))
    hit = F.aggregate("runs", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda acc: acc["n"])
    one = stored(one.select("row", hit.cast("long").alias("n_hit"), "items", "m"), "found")
    forget(*every)
    counted = rows.select("row", "doc_id", "text").mapInArrow(_each([], lambda r, _, data, offs: pa.record_batch([r.column(0), r.column(1), pa.array(np.diff(Words(data, offs, ALNUM).first).astype(np.int64))], names=["row", "doc_id", "n_words"])), "row long, doc_id long, n_words long")
    zero = F.lit(0).cast("long")
    return counted.join(one, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce(F.size("items"), zero).cast("long").alias("n_items"), F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"), F.coalesce("m.size", zero).alias("longest_match"), F.coalesce(-F.col("m.start"), F.lit(-1).cast("long")).alias("match_start"),
    )


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): words, words inside test windows, items that occur, longest verbatim match."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    passes = _passes(docs.sparkSession, bench, window)
    first = next(passes)
    second = next(passes, None)
    if second is None:
        return docs.mapInArrow(_each(first, _rows), RESULT)
    return _in_passes(docs, itertools.chain([first, second], passes))


def without_contaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs`, all columns, without the rows that hold a test window."""
    passes = _passes(docs.sparkSession, bench, window)
    probes, before = next(passes), None
    for later in passes:  # written, so that a task runs one pass at a time
        docs = stored(docs.mapInArrow(_each(probes, _kept), docs.schema), "kept")
        forget(*([before] if before is not None else []))
        before, probes = docs, later
    return docs.mapInArrow(_each(probes, _kept), docs.schema)
