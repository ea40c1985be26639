"""Files in and out: JSON lines, JSON arrays, hashed inputs, frames, profiles and reports. All reads go through Spark's readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PROMPT_ROWS = "prompt string, text string, label int, stem_id string, meta map<string,string>"


def json_lines(spark: SparkSession, path: str, schema: str = PROMPT_ROWS) -> DataFrame:
    """Rows of JSON lines with `file` and `_corrupt_record`, which holds a line that does not parse. Blank lines are left out."""
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"))
    parsed = lines.withColumn("j", F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    return parsed.select("j.*", "file", "value")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of every line, blank ones too; `line` counts from 1 in each file.

    A file may be split over tasks. A task's rows carry increasing numbers, a block of a file is read by one task and in order, so a
    line's place in its block is its number less the block's least; the blocks' counts, summed up in order of their starts, give the
    rest. The only rows that are shuffled are one for each block; the lines stay where they are read."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    blocks = lines.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy("file").orderBy("_block")) - F.col("_n")
    starts = blocks.select("file", "_block", (before - F.col("_first") + 1).alias("_move"))
    return lines.join(starts, ["file", "_block"]).select("file", (F.col("_id") + F.col("_move")).alias("line"), "value")


def numbered_json_lines(spark: SparkSession, path: str, schema: str = PROMPT_ROWS) -> DataFrame:
    """As `json_lines`, with the number of each line in its file."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    parsed = lines.withColumn("j", F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    return parsed.select("j.*", "file", "line", "value")


def bad_lines(spark: SparkSession, path: str, schema: str = PROMPT_ROWS) -> DataFrame:
    """(file, line, value) of the lines that do not parse."""
    return numbered_json_lines(spark, path, schema).where("_corrupt_record is not null").select("file", "line", "value")


def strict_json_lines(spark: SparkSession, path: str, schema: str = PROMPT_ROWS) -> DataFrame:
    """As `json_lines`, but a bad line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON array or of JSON lines, whichever the file holds: an array begins with a bracket."""
    first = spark.read.text(path).where(F.trim("value") != "").select(F.ltrim("value").alias("v")).where(F.startswith("v", F.lit("["))).limit(1)
    return spark.read.schema(schema).option("multiLine", not first.isEmpty()).option("mode", "FAILFAST").json(path)


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256) of each file below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def resolved(spark: SparkSession, wanted: DataFrame, path: str) -> DataFrame:
    """`wanted` (name, sha256) with the path of a file that has the content, of several the first; null without one."""
    have = file_hashes(spark, path).groupBy("sha256").agg(F.min("path").alias("path"))
    return wanted.join(have, "sha256", "left")


def guarded_parquet(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """A Parquet file, if its content has the hash; a ValueError otherwise."""
    got = [r["sha256"] for r in file_hashes(spark, path, "*.parquet").orderBy("path").limit(2).collect()]
    if got != [sha256]:
        raise ValueError(f"{path}: content differs from its declared hash")
    return spark.read.parquet(path)


def write_guarded(df: DataFrame, path: str) -> None:
    """`df` as Parquet below `path`/data, and the hashes of its files in `path`/manifest, taken once the files are written."""
    df.write.parquet(f"{path}/data")
    held = file_hashes(df.sparkSession, f"{path}/data", "*.parquet")
    held.select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "sha256").write.parquet(f"{path}/manifest")


def guarded(spark: SparkSession, path: str) -> DataFrame:
    """What `write_guarded` wrote, if no file was changed, lost or added since; a ValueError that names one otherwise."""
    have = file_hashes(spark, f"{path}/data", "*.parquet").select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), F.col("sha256").alias("now"))
    want = spark.read.schema("name string, sha256 string").parquet(f"{path}/manifest")
    wrong = want.join(have, "name", "full").where(~F.col("sha256").eqNullSafe(F.col("now"))).orderBy("name").first()
    if wrong:
        raise ValueError(f"{path}: {wrong['name']} differs from the manifest")
    return spark.read.parquet(f"{path}/data")


def frame(spark: SparkSession, path: str) -> DataFrame:
    """A frame written as Parquet, or else as CSV with a header."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{path}.parquet")
    except AnalysisException:
        return spark.read.option("header", True).csv(f"{path}.csv")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def profile_json(df: DataFrame, version: str) -> DataFrame:
    """Each row as a JSON profile with its schema version."""
    return df.select(F.to_json(F.struct(F.lit(version).alias("schema_version"), *df.columns)).alias("profile"))


def profiles(df: DataFrame, schema: str, version: str) -> DataFrame:
    """Rows of `profile` whose version is the wanted one."""
    parsed = df.select(F.from_json("profile", f"schema_version string, {schema}").alias("p")).select("p.*")
    return parsed.where(F.col("schema_version") == version).drop("schema_version")


def panel_cells(text):
    """A cell from a JSON triple or from the text of a tuple: (step, family, detail)."""
    parts = r"""^[\[(]\s*(-?\d+)\s*,\s*['"]([^'"]*)['"]\s*,\s*['"]([^'"]*)['"]\s*,?\s*[\])]$"""
    held = F.rlike(text, F.lit(parts))
    return F.when(held, F.struct(F.regexp_extract(text, parts, 1).cast("int").alias("step"), F.regexp_extract(text, parts, 2).alias("family"), F.regexp_extract(text, parts, 3).alias("detail")))


def markdown(df: DataFrame, title: str) -> str:
    """A small result as a Markdown table; the caller answers for its size."""
    rows = [df.columns, ["---"] * len(df.columns), *[["" if v is None else str(v) for v in r] for r in df.collect()]]
    return "\n".join([f"# {title}", "", *("| " + " | ".join(r) + " |" for r in rows)])


def keep_complete(rows: DataFrame, needed: list[str]) -> DataFrame:
    """Rows whose needed values are all there and finite."""
    ok = F.lit(True)
    for c in needed:
        ok = ok & F.coalesce(F.abs(F.col(c).cast("double")) < F.lit(float("inf")), F.lit(False))
    return rows.where(ok)


def source_digest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """SHA-256 over `label TAB prompt NEWLINE` of each key's rows in order, by hashes of rows.

    The order is a column of its own, never that of files. Rows are hashed first, so a key's digest gathers 64 characters a row.
    """
    one = F.sha2(F.concat(F.col("label").cast("string"), F.lit("\t"), F.col("prompt"), F.lit("\n")), 256)
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), one.alias("h"))))
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(listed, lambda x: x["h"]), ""), 256).alias("digest"))
