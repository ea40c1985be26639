"""Near-duplicate grouping: SuperMinHash signatures, banding, verification on full shingle sets, and union-find grouping.

SuperMinHash (Ertl, 2017): each shingle draws a random permutation of the signature's slots; the slot that it visits at step j
gets j plus a fraction, so a shingle's ranks are correlated and slots fill evenly. A document stops at the first step that can
lower no slot of it, which for long texts is the first one.

Candidates share all rows of a band. Candidate stars (each bucket around its smallest member) give candidate groups; within a
group every pair whose signatures agree enough is confirmed on the full sets unless both are already linked through others.
Groups above `BLOCK` members are dealt into blocks, compared within blocks, then with the first block, then what is still apart
from the group's largest part with every block; no task holds a whole group, and no pair is skipped by a cap.

Defined cases: null and empty texts have no shingles and are linked with nothing; a text of fewer words than a shingle is one
shingle; exact copies are one class, linked without comparison; a doc_id is one document, so rows that repeat it share its fate;
a row without doc_id is linked with nothing and kept; a group's smallest doc_id stays, so ties cannot arise; very long texts are read
whole, and a task holds the shingles of one block's texts, at least of the longest one; an empty table gives no rows; extra columns are ignored by `groups` and kept by `without_near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm._store import forget, stored
from assayer.llm._words import NOT_SPACE, Words, grams, mixed, powers, slices
from assayer.llm.components import components

SLOTS, ROWS, BANDS = 128, 4, 24
#: members of a block; shingles of a block
BLOCK, BLOCK_SHINGLES = 2048, 2_000_000
#: pairs at the threshold have this many equal slots or more, but for about one in 40 million
LEAST_EQUAL = 0.6
_SKETCH = "doc_id long, n_shingles long, key binary, sig binary, bands array<long>"


def shingles(w: Words, docs: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash) pairs, distinct and in order, and where each document's begin."""
    g = grams(w.hash, size)
    inside = np.arange(len(g)) + size <= w.first[w.doc[: len(g)] + 1]
    doc, h = w.doc[: len(g)][inside], g[inside]
    words = np.diff(w.first)
    for n in range(1, size):
        own = np.flatnonzero(words == n)
        if len(own):
            doc = np.append(doc, own)
            h = np.append(h, grams(w.hash, n)[w.first[own]] + np.uint64(n))
    bits = 12  # slices have 4096 documents at most; the same for all, so that equal shingles have equal hashes in any slice
    both = np.sort((doc.astype(np.uint64) << np.uint64(64 - bits)) | (h >> np.uint64(bits)))
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    doc = (both >> np.uint64(64 - bits)).astype(np.int64)
    return doc, mixed(both << np.uint64(bits)), np.searchsorted(doc, np.arange(docs + 1))


def superminhash(doc: np.ndarray, h: np.ndarray, docs: int, m: int = SLOTS) -> np.ndarray:
    """Signatures (docs x m): step in the upper 32 bits, fraction in the lower."""
    best = np.full(docs * m, np.uint64(2**63), dtype=np.uint64)
    x = mixed(h + np.uint64(0xA0761D6478BD642F))
    slot = (x >> np.uint64(32)) % np.uint64(m)
    np.minimum.at(best, doc * m + slot.astype(np.int64), x & np.uint64(0xFFFFFFFF))
    perm = None
    for j in range(1, m):
        top = best.reshape(docs, m).max(axis=1) >> np.uint64(32)
        on = (top >= j)[doc]
        if not on.any():
            break
        if perm is None:
            doc, h, slot = doc[on], h[on], slot[on].astype(np.int64)
            perm = np.tile(np.arange(m, dtype=np.uint8), (len(doc), 1))
            perm[np.arange(len(doc)), slot] = 0
        elif not on.all():
            doc, h, perm = doc[on], h[on], perm[on]
        x = mixed(h + np.uint64(0xE7037ED1A0B428DB * j % 2**64))
        at = np.arange(len(doc))
        k = j + ((x >> np.uint64(32)) % np.uint64(m - j)).astype(np.int64)
        slot = perm[at, k].astype(np.int64)
        perm[at, k] = perm[:, j]
        np.minimum.at(best, doc * m + slot, np.uint64(j << 32) | (x & np.uint64(0xFFFFFFFF)))
    return best.reshape(docs, m)


def _sequence_keys(w: Words) -> np.ndarray:
    """128-bit keys of whole word sequences, as (docs, 2)."""
    p, inv = powers(len(w.hash) + 1)
    a, b = w.first[:-1], w.first[1:]
    out = []
    for h in (w.hash, mixed(w.hash)):
        c = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(h * p[:-1], out=c[1:])
        out.append(mixed((c[b] - c[a]) * inv[a] + (b - a).astype(np.uint64)))
    return np.stack(out, axis=1)


def _fixed(x: np.ndarray, ok: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values; null where not ok."""
    x = np.ascontiguousarray(x)
    size = x.shape[1] * x.itemsize
    whole = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(x), [None, pa.py_buffer(x)])
    return pa.compute.if_else(pa.array(ok), whole.cast(pa.binary()), pa.scalar(None, pa.binary()))


def _sketches(size: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in slices(batch, size=1 << 20):
                docs = b - a
                w = Words(data, offs, NOT_SPACE)
                doc, h, first = shingles(w, docs, size)
                sig = superminhash(doc, h, docs)
                n = np.diff(first)
                folded = []
                for k in range(BANDS):
                    x = np.full(docs, k, dtype=np.uint64)
                    for r in range(ROWS):
                        x = mixed(x * np.uint64(0xD1342543DE82EF95) + sig[:, k * ROWS + r])
                    folded.append(x)
                bands = np.stack(folded, axis=1).view(np.int64)[n > 0]
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
                yield pa.record_batch(
                    {
                        "doc_id": batch.column(0)[a:b],
                        "n_shingles": pa.array(n.astype(np.int64)),
                        "key": _fixed(_sequence_keys(w), n > 0),
                        "sig": _fixed(mixed(sig).astype(np.uint8), n > 0),
                        "bands": pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel())),
                    }
                )

    return sketch


class _Group:
    """Members that one task compares: their sets, signatures and the parts they are known to be in."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.node: list[int] = []
        self.part: list[int] = []
        self.alone: list[bool] = []
        self.sets: list[np.ndarray] = []
        self.sigs: list[bytes] = []

    def links(self) -> list[tuple[int, int]]:
        """(part, part) for each confirmed link that joins two parts; pairs of two members that are not `alone` are left out."""
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        sig = np.frombuffer(b"".join(self.sigs), dtype=np.uint8).reshape(len(self.node), -1)
        alone = np.array(self.alone)
        size = np.array([len(s) for s in self.sets])
        least = int(LEAST_EQUAL * sig.shape[1])
        found = []
        for i in range(len(self.node) - 1):
            small, large = np.minimum(size[i], size[i + 1 :]), np.maximum(size[i], size[i + 1 :])
            j = i + 1 + np.flatnonzero((100 * small >= self.percent * large) & (alone[i] | alone[i + 1 :]))
            if len(j):
                equal = np.count_nonzero(sig[j] == sig[i], axis=1)
                found.append(np.stack([equal, np.full(len(j), i), j])[:, equal >= least])
        pairs = np.concatenate(found, axis=1) if found else np.zeros((3, 0), dtype=np.int64)
        pairs = pairs[1:, np.argsort(-pairs[0], kind="stable")].T.tolist()
        out = []
        for i, j in pairs:
            a, b = find(self.part[i]), find(self.part[j])
            if a != b:
                s, t = self.sets[i], self.sets[j]
                both = np.sort(np.concatenate([s, t]))
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= self.percent * (len(s) + len(t) - common):
                    root[max(a, b)] = min(a, b)
                    out.append((a, b))
        return out


def _confirmed(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between parts within each group of `rows` (g, node, part, alone, sig, text); each joins two parts that those
    before it in its group leave apart. A task streams its groups one by one."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out = None, _Group(percent), []
        for batch in batches:
            for a, b, data, offs in slices(batch, size=1 << 20):
                _, h, first = shingles(Words(data, offs, NOT_SPACE), b - a, size)
                for k, row in enumerate(batch.slice(a, b - a).select(["g", "node", "part", "alone", "sig"]).to_pylist()):
                    if row["g"] != key:
                        out += group.links() if len(group.node) > 1 else []
                        key, group = row["g"], _Group(percent)
                    group.node.append(row["node"])
                    group.part.append(row["part"])
                    group.alone.append(row["alone"])
                    group.sigs.append(row["sig"])
                    group.sets.append(h[first[k] : first[k + 1]])
        out += group.links() if len(group.node) > 1 else []
        yield pa.record_batch({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    dealt = rows.select("g", "node", "part", "alone", "sig", "text").repartition("g").sortWithinPartitions("g", "node")
    return dealt.mapInArrow(compare, "a long, b long")


def groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): its distinct shingles of `size` words, the smallest doc_id that chains of
    links reach (links: Jaccard similarity of `percent` or more), and whether it is that document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = stored(texts.mapInArrow(_sketches(size), _SKETCH), "sketch")
    first = lambda c: F.first(c).alias(c)  # noqa: E731  rows of a key have equal sketches
    nodes = stored(sketch.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("node"), first("n_shingles"), first("sig"), first("bands")), "nodes")

    held = nodes.select(F.explode("bands").alias("band"), "node")
    centres = held.groupBy("band").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = held.join(centres, "band").where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    candidate = components(stars)
    member = candidate.join(nodes.select("node", "n_shingles", "sig"), "node")
    sizes = member.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("long")
    dealt = member.join(sizes, "component").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    # whole texts are shuffled here, once; what follows reads the members only
    held = stored(dealt.select("component", "blocks", "block", "node", "sig").join(texts.withColumnRenamed("doc_id", "node"), "node"), "members")
    forget(candidate)

    links = stored(_confirmed(held.selectExpr("concat_ws(':', component, block) as g", "node", "node as part", "true as alone", "sig", "text"), size, percent), "links")
    many = held.where("blocks > 1")
    if not many.isEmpty():
        links = _between_blocks(many, links, size, percent)
    part = components(links)
    forget(held, links)
    known = F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")
    rows = sketch.select("doc_id", "n_shingles", known).join(nodes.select("key", "node"), "key", "left")
    rows = rows.join(part, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node", "doc_id").alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _between_blocks(many: DataFrame, links: DataFrame, size: int, percent: int) -> DataFrame:
    """`links` and those between blocks of the same candidate group."""

    def parted(links: DataFrame) -> DataFrame:
        own = components(links.join(many.select(F.col("node").alias("a")), "a", "left_semi")).withColumnRenamed("component", "part")
        return many.join(own, "node", "left").withColumn("part", F.coalesce("part", "node"))

    # every block with the first one; the first goes to each other block
    to_first = F.when(F.col("block") > 0, F.array("block")).otherwise(F.sequence(F.lit(1), F.col("blocks") - 1))
    first = parted(links).withColumn("with", F.explode(to_first)).selectExpr("concat_ws(':', component, 'first', with) as g", "node", "part", "true as alone", "sig", "text")
    within, links = links, stored(links.union(_confirmed(first, size, percent)), "links")
    # members outside the group's largest part, in chunks, with every block
    now = stored(parted(links), "parted")
    sizes = now.groupBy("component", "part").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("component").agg(F.max_by("part", F.struct("n", "part")).alias("largest"), F.sum("n").alias("all"), F.max("n").alias("most"))
    left = now.join(largest, "component").withColumn("chunks", F.ceil((F.col("all") - F.col("most")) / BLOCK)).where("chunks > 0")
    chunks = F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)
    every = left.withColumn("chunk", F.explode(chunks)).withColumn("alone", F.lit(False))
    apart = left.where(F.col("part") != F.col("largest")).withColumn("alone", F.lit(True))
    apart = apart.withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")))
    apart = apart.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    columns = ["concat_ws(':', component, 'rest', block, chunk) as g", "node", "part", "alone", "sig", "text"]
    out = stored(links.union(_confirmed(every.selectExpr(*columns).union(apart.selectExpr(*columns)), size, percent)), "links")
    forget(within, links, now)
    return out


def without_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """`docs`, all columns, with one document of each group."""
    gone = groups(docs, size, percent).where("not kept").select(F.col("doc_id").alias("__assayer_gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("__assayer_gone"), "left_anti")
