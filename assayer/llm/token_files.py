"""Token ids in compressed files with a shared dictionary and random access to single documents.

Documents are dealt by range of doc_id; each task encodes its own in order and writes them to one file, a zstandard frame a document.
The frames of short documents compress badly alone, so all share a dictionary, trained on the serialized ids of a bounded sample.

File format, all numbers little-endian:

| part | content |
| --- | --- |
| head | `TOKZ`, version (u32), SHA-256 of the dictionary (32 bytes) |
| frames | one zstandard frame a document, of its ids as u32 |
| index | one entry a document: doc_id (i64), has id (u32), number of ids (u32), offset of its frame (u64) |
| foot | offset of the index (u64), documents (u64), ids (u64), `TOKZ` |

A folder holds such files, the dictionary (`dictionary.zdict`), and `manifest`, a Parquet table with one row a file: its name, number,
documents, ids and range of doc_id. The manifest is written last, by Spark's committer, and names only files of tasks that
succeeded; each attempt of a task writes a name of its own, so a repeated or lost attempt leaves at most a file that nothing names.

Encoding a word takes far longer than finding it, so each Python worker keeps a bounded map of pieces to ids. Pieces are cut where
the tokenizer cuts too (white space, and an ASCII letter before anything but a letter), so the ids of a text are those of its pieces
in order; `tests/llm` holds that against whole texts. This holds for tokenizers that drop white space and never join across it.

Defined cases: a null text is empty and has the end id alone; null ids come first; rows that repeat an id lie side by side, the
smaller text first; an empty table gives a folder with a manifest of no files; very long texts are encoded whole, a task holds its
longest one a few times; extra columns are ignored. Strings of special tokens inside a text are read as the tokenizers library reads
them. With too few samples for training, the samples themselves are the dictionary.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import struct
import uuid
from array import array
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.llm._store import shared_dir

MAGIC = b"TOKZ"
HEAD = "<4sI32s"
ENTRY = np.dtype([("doc_id", "<i8"), ("held", "<u4"), ("n", "<u4"), ("at", "<u8")])
FOOT = "<QQQ4s"
HEAD_BYTES, FOOT_BYTES = struct.calcsize(HEAD), struct.calcsize(FOOT)
#: text bytes a file, about; documents whose ids train the dictionary, with the ids taken of each; the dictionary's bytes
FILE_BYTES = 64 << 20
TRAIN_ROWS, TRAIN_IDS, DICTIONARY_BYTES = 1500, 512, 64 << 10
#: words and pieces in the younger of the two maps that a worker keeps, the longest piece, the longest word of several pieces
KEPT, KEPT_BYTES, SHORT_BYTES = 1 << 19, 64, 8
MANIFEST = "name string, file int, documents long, ids long, first_id long, last_id long"
_PIECE = re.compile(rb"[a-z\x80-\xff]*[a-z](?=[^a-z\x80-\xff]|\Z)|\S+")
_LETTERS = re.compile(rb"[a-z]+")


class _Pieces(dict):
    """Ids of words and pieces, made when they are first asked for."""

    def __init__(self, encode: Callable[[bytes], bytes], older: dict[bytes, bytes]) -> None:
        self.encode, self.older = encode, older

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            pieces = _PIECE.findall(word)
            several = len(pieces) > 1
            ids = b"".join(map(self.__getitem__, pieces)) if several else self.encode(word)
            # long words of several pieces would crowd out the pieces
            if len(word) > (SHORT_BYTES if several else KEPT_BYTES):
                return ids
        self[word] = ids
        return ids


class Encoder:
    """Texts to ids (little-endian u32) by a tokenizer's file, one piece at a time."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
        from tokenizers import Tokenizer

        self._tokenizer = t = Tokenizer.from_file(path)
        self._model = t.model
        self._special = [x.content.encode().lower() for x in t.get_added_tokens_decoder().values()]
        # where letters pass the tokenizer's preparation unchanged, its model alone encodes them in half the time
        letters = "abcdefghijklmnopqrstuvwxyz"
        self._plain = all([m.id for m in t.model.tokenize(x)] == t.encode(x, add_special_tokens=False).ids for x in (letters, letters[::-1], *letters))
        self._ids = _Pieces(self._new, {})

    def _new(self, piece: bytes) -> bytes:
        if self._plain and _LETTERS.fullmatch(piece):
            return array("I", [x.id for x in self._model.tokenize(piece.decode())]).tobytes()
        return array("I", self._tokenizer.encode(piece.decode(), add_special_tokens=False).ids).tobytes()

    def encoded(self, texts: list[bytes]) -> list[bytes]:
        if len(self._ids) > KEPT:  # the older half goes; what is still in use comes back from it
            self._ids = _Pieces(self._new, dict(self._ids))
        out = []
        for text in texts:
            low = text.lower()
            # special tokens are found before anything is lower-cased, so a text that may seem to hold one goes as it is
            if any(x in low for x in self._special):
                out.append(array("I", self._tokenizer.encode(text.decode(), add_special_tokens=False).ids).tobytes())
            else:
                out.append(b"".join(map(self._ids.__getitem__, low.split())))
        return out


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _batches(batch: pa.RecordBatch, rows: int = 256, size: int = 4 << 20) -> Iterator[tuple[list[int | None], list[bytes]]]:
    """Ids and texts of a batch, some at a time."""
    ids, texts, held = [], [], 0
    for doc, text in zip(batch.column("doc_id"), batch.column("text").cast(pa.large_binary()), strict=True):
        ids.append(doc.as_py())
        texts.append(text.as_py() or b"")
        held += len(texts[-1])
        if len(ids) >= rows or held >= size:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The folder's file system, which driver and executors reach alike, and the path in it."""
    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained on serialized ids, or the samples themselves where they are too few to train one."""
    if sum(map(len, samples)) >= 8 * size and len(samples) >= 64:
        return zstandard.train_dictionary(size, samples).as_bytes()
    return b"".join(samples)[-size:]


def _write(folder: str, tokenizer: str, end_id: int | None, dictionary: bytes, level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    digest = hashlib.sha256(dictionary).digest()
    tail = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, where = _encoder(tokenizer), _opened(folder)
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)
        file = TaskContext.get().partitionId()
        name, out, index, at = f"part-{file:06d}-{uuid.uuid4().hex}.tokz", None, [], HEAD_BYTES
        for batch in batches:
            for ids, texts in _batches(batch):
                if out is None:
                    out = where[0].open_output_stream(f"{where[1]}/{name}")
                    out.write(struct.pack(HEAD, MAGIC, 1, digest))
                entries = np.zeros(len(ids), dtype=ENTRY)
                for i, (doc, raw) in enumerate(zip(ids, encoder.encoded(texts), strict=True)):
                    frame = packer.compress(raw + tail)
                    entries[i] = (doc or 0, doc is not None, (len(raw) + len(tail)) // 4, at)
                    out.write(frame)
                    at += len(frame)
                index.append(entries)
        if out is None:
            return
        every = np.concatenate(index)
        total = int(every["n"].sum())
        out.write(every.tobytes())
        out.write(struct.pack(FOOT, at, len(every), total, MAGIC))
        out.close()
        held = every["doc_id"][every["held"] == 1]
        ends = (int(held[0]), int(held[-1])) if len(held) else (None, None)
        yield pa.record_batch([pa.array([x], t) for x, t in zip((name, file, len(every), total, *ends), (pa.string(), pa.int32(), *[pa.int64()] * 4), strict=True)], names=["name", "file", "documents", "ids", "first_id", "last_id"])

    return task


def write(docs: DataFrame, folder: str, tokenizer: str, *, end_id: int | None = 1, file_bytes: int = FILE_BYTES, level: int = 3, train_rows: int = TRAIN_ROWS) -> None:
    """Writes the ids of `docs` (doc_id, text) to files below `folder`, in ascending order of doc_id, `end_id` after each document.

    `tokenizer` is the path of a file of the tokenizers library that every executor can read."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    encoder = _encoder(tokenizer)
    # about `train_rows` documents by hash, whatever the layout of the input, and a bounded beginning of each
    chosen = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.lit(-(-(train_rows << 30) // max(rows, 1)))
    sample = docs.where(chosen & (F.length("text") > 0)).select(F.substring("text", 1, 3 * TRAIN_IDS).alias("text")).limit(2 * train_rows).collect()
    dictionary = _dictionary([x[: 4 * TRAIN_IDS] for x in encoder.encoded(sorted(r.text.encode() for r in sample))], DICTIONARY_BYTES)
    where, path = _opened(folder)
    where.create_dir(path, recursive=True)
    with where.open_output_stream(f"{path}/dictionary.zdict") as out:
        out.write(dictionary)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // file_bytes))
    dealt = docs.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    dealt.mapInArrow(_write(folder, tokenizer, end_id, dictionary, level), MANIFEST).write.parquet(f"{folder}/manifest")


class Reader:
    """One file, read by its index."""

    def __init__(self, folder: str, name: str, dictionary: bytes) -> None:
        where, path = _opened(folder)
        self._in = where.open_input_file(f"{path}/{name}")
        magic, version, digest = struct.unpack(HEAD, self._in.read(HEAD_BYTES))
        if (magic, version, digest) != (MAGIC, 1, hashlib.sha256(dictionary).digest()):
            raise ValueError(f"{name} is no file of this format, or was written with another dictionary")
        end = self._in.size()
        self._in.seek(end - FOOT_BYTES)
        self._frames_end, n, _, magic = struct.unpack(FOOT, self._in.read(FOOT_BYTES))
        if magic != MAGIC or self._frames_end + n * ENTRY.itemsize + FOOT_BYTES != end:
            raise ValueError(f"{name} is cut short")
        self._in.seek(self._frames_end)
        self.index = np.frombuffer(self._in.read(n * ENTRY.itemsize), dtype=ENTRY)
        self._unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def ids(self, i: int) -> bytes:
        """The ids of the file's i-th document, by one seek."""
        a = int(self.index["at"][i])
        b = int(self.index["at"][i + 1]) if i + 1 < len(self.index) else self._frames_end
        self._in.seek(a)
        return self._unpacker.decompress(self._in.read(b - a))

    def place(self, doc_id: int) -> int | None:
        """Where a document lies, by binary search in the index; null ids lie before all others."""
        nulls = int((self.index["held"] == 0).sum())
        i = nulls + int(np.searchsorted(self.index["doc_id"][nulls:], doc_id))
        return i if i < len(self.index) and self.index["doc_id"][i] == doc_id else None

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_: object) -> None:
        self._in.close()


def dictionary_of(folder: str) -> bytes:
    where, path = _opened(folder)
    with where.open_input_file(f"{path}/dictionary.zdict") as f:
        return f.read()


def _starts(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest with the number of ids before each file. Files are summed in blocks first, so that no task orders all of them."""
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").withColumn("block", F.expr("file div 1024"))
    blocks = files.groupBy("block").agg(F.sum("ids").alias("n"))
    before = blocks.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))
    inside = files.withColumn("inside", F.sum("ids").over(Window.partitionBy("block").orderBy("file")) - F.col("ids"))
    return inside.join(before, "block").withColumn("start", F.col("before") + F.col("inside")).drop("block", "before", "inside")


def _read(folder: str, digest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = dictionary_of(folder)
        for batch in batches:
            for r in batch.to_pylist():
                with Reader(folder, r["name"], dictionary) as reader:
                    starts = r["start"] + np.cumsum(reader.index["n"], dtype=np.int64) - reader.index["n"]
                    for a in range(0, len(reader.index), 512):
                        part = reader.index[a : a + 512]
                        docs = pa.array(part["doc_id"].astype(np.int64), mask=part["held"] == 0)
                        raw = (reader.ids(i) for i in range(a, a + len(part)))
                        ids = pa.array([crc32(x) for x in raw], pa.int64()) if digest else pa.array([np.frombuffer(x, dtype="<u4").astype(np.int64) for x in raw], pa.list_(pa.int64()))
                        yield pa.record_batch([docs, pa.array(starts[a : a + 512]), pa.array(part["n"].astype(np.int64)), ids], names=["doc_id", "start", "n_tokens", "ids"])

    return task


def read(spark: SparkSession, folder: str, *, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of a folder: `start` counts the ids of all documents before it. With `digest`,
    `ids` is the unsigned CRC-32 of the ids as little-endian u32 instead of the list of them."""
    files = _starts(spark, folder).select("name", "start")
    n = max(1, spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").count())
    kind = "long" if digest else "array<long>"
    return files.repartition(n, "name").mapInArrow(_read(folder, digest), f"doc_id long, start long, n_tokens long, ids {kind}")


def lookup(spark: SparkSession, folder: str, doc_id: int) -> list[int] | None:
    """The ids of one document: the manifest tells its file, the file's index its frame; nothing else is read."""
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    for r in files.orderBy("file").limit(1).collect():
        with Reader(folder, r.name, dictionary_of(folder)) as reader:
            if (i := reader.place(doc_id)) is not None:
                return np.frombuffer(reader.ids(i), dtype="<u4").tolist()
    return None


def digests(docs: DataFrame, tokenizer: str, **options: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from files in the shared scratch folder that are written, read back
    and then deleted."""
    from assayer.llm._store import forget, stored

    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/assayer/tokens-{uuid.uuid4().hex}"
    write(docs, folder, tokenizer, **options)
    out = stored(read(spark, folder, digest=True).withColumnRenamed("ids", "ids_crc32"), "digests")
    files = spark.range(0)
    files._scratch = folder
    forget(files)
    return out
