"""Score matrices in NumPy archives as a Spark data source: one partition a file, Arrow batches, and a writer in two phases.

    spark.dataSource.register(ArrayArchives)
    spark.read.format("array_archives").load(path)            # rows (slug, task, sample_idx, label, stem, cell_idx, score ...)
    matrices.write.format("array_archives").mode("append").save(path)

An archive holds one deployment's `score_matrix` (rows x cells, NaN where a score is missing), `labels`, `sample_idx`, `stem_ids` and
`panel`, the JSON list of its cells. A deployment with more rows than an archive may hold takes several. Tasks write under names
that begin with an underscore, which the reader does not see; the driver renames them once all tasks have succeeded, and deletes
them when one has failed for good, so no archive is ever half there. Missing scores are null in Spark. Paths may be of any file
system that Arrow opens.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "slug string, task string, sample_idx bigint, label int, stem string, panel array<string>, scores array<double>"
#: rows that one archive holds at most, whatever the deployment
ARCHIVE_ROWS = 100_000


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def _names(path: str, hidden: bool = False) -> list[str]:
    where, folder = opened(path)
    found = where.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if f.extension == "npz" and f.base_name.startswith("_") == hidden)


@dataclass
class ArchiveFile(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [ArchiveFile(p) for p in _names(self.path)]

    def read(self, partition: ArchiveFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without archives
            return
        where, _ = opened(self.path)
        with where.open_input_file(partition.path) as f:
            z = np.load(io.BytesIO(f.read()), allow_pickle=False)
        meta, m = json.loads(str(z["meta"])), z["score_matrix"].astype(float)
        n, k = m.shape
        stems = [None if not s else s for s in z["stem_ids"].tolist()]
        flat = m.reshape(-1)
        lists = lambda values, width: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), values)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([meta["slug"]] * n, pa.string()), pa.array([meta["task"]] * n, pa.string()), pa.array(z["sample_idx"].astype(np.int64)), pa.array(z["labels"].astype(np.int32)), pa.array(stems, pa.string()),
                lists(pa.array(json.loads(str(z["panel"])) * n, pa.string()), k), lists(pa.array(flat, pa.float64(), mask=~np.isfinite(flat)), k),
            ],
            names=["slug", "task", "sample_idx", "label", "stem", "panel", "scores"],
        )


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str, rows: int, overwrite: bool) -> None:
        self.path, self.rows, self.overwrite = path, rows, overwrite

    def _put(self, table: pa.Table) -> str:
        slug, task = table.column("slug")[0].as_py(), table.column("task")[0].as_py()
        panel = table.column("panel")[0].as_py()
        scores = table.column("scores").combine_chunks()
        if any(p != panel for p in table.column("panel").to_pylist()) or len(scores.flatten()) != table.num_rows * len(panel):
            raise ValueError(f"{slug}/{task}: rows differ in their panel, or have not a score for each of its cells")
        matrix = scores.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(table.num_rows, len(panel))
        held = io.BytesIO()
        np.savez_compressed(
            held, score_matrix=matrix, labels=table.column("label").to_numpy(), sample_idx=table.column("sample_idx").to_numpy(),
            stem_ids=np.array([s or "" for s in table.column("stem").to_pylist()], dtype=str), panel=json.dumps(panel), meta=json.dumps({"slug": slug, "task": task}),
        )
        where, folder = opened(self.path)
        where.create_dir(folder, recursive=True)
        name = f"{slug}__{task}__{uuid.uuid4().hex}.npz"
        with where.open_output_stream(f"{folder}/_{name}") as out:
            out.write(held.getvalue())
        return name

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        names, held, at, n = [], [], None, 0

        def flushed() -> None:
            nonlocal held, n
            if held:
                names.append(self._put(pa.Table.from_batches(held)))
            held, n = [], 0

        for batch in iterator:
            slugs, tasks = batch.column("slug").to_pylist(), batch.column("task").to_pylist()
            ends = [i for i in range(1, batch.num_rows + 1) if i == batch.num_rows or (slugs[i], tasks[i]) != (slugs[i - 1], tasks[i - 1])]
            a = 0
            for b in ends:
                if at != (slugs[a], tasks[a]):
                    flushed()
                    at = slugs[a], tasks[a]
                while a < b:
                    take = min(b - a, self.rows - n)
                    held.append(batch.slice(a, take))
                    n, a = n + take, a + take
                    if n == self.rows:
                        flushed()
        flushed()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        where, folder = opened(self.path)
        where.create_dir(folder, recursive=True)
        before = _names(self.path) if self.overwrite else []
        for name in (n for m in messages if m for n in m.names):
            where.move(f"{folder}/_{name}", f"{folder}/{name}")
        for old in before:
            where.delete_file(old)

    def abort(self, messages: list[Written | None]) -> None:
        # names of failed attempts are not known here; nothing else writes hidden archives while a job runs
        where, _ = opened(self.path)
        for path in _names(self.path, hidden=True):
            where.delete_file(path)


class ArrayArchives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "array_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], int(self.options.get("rows", ARCHIVE_ROWS)), overwrite)


def write(matrices: DataFrame, path: str, rows: int = ARCHIVE_ROWS) -> None:
    """Writes `matrices` (as `SCHEMA`) as archives; a deployment's rows are brought together and ordered by sample."""
    matrices.sparkSession.dataSource.register(ArrayArchives)
    dealt = matrices.select("slug", "task", F.col("sample_idx").cast("bigint"), F.col("label").cast("int"), F.col("stem").cast("string"), "panel", "scores")
    dealt.repartition("slug", "task").sortWithinPartitions("slug", "task", "sample_idx").write.format("array_archives").option("rows", rows).mode("append").save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The archives below `path`, a row for each sample."""
    spark.dataSource.register(ArrayArchives)
    return spark.read.format("array_archives").load(path)


def long(matrices: DataFrame) -> DataFrame:
    """(slug, task, sample_idx, stem, label, cell_idx, cell, score): a row for each sample and cell."""
    cells = F.transform(F.arrays_zip("panel", "scores"), lambda x, i: F.struct(i.alias("cell_idx"), x["panel"].alias("cell"), x["scores"].alias("score")))
    return matrices.select("slug", "task", "sample_idx", "stem", "label", F.inline(cells))


def with_profiles(matrices: DataFrame, profiles: DataFrame) -> DataFrame:
    """`matrices` with `status`: that of the deployment's profile (slug, task, status), 'no profile' without one."""
    known = profiles.select("slug", "task", "status")
    return matrices.join(known, ["slug", "task"], "left").withColumn("status", F.coalesce("status", F.lit("no profile")))
