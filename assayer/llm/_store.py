"""Scratch tables in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FALLBACK = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a folder of our own only where the setting is unset and all tasks run in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{FALLBACK}"
        os.makedirs(FALLBACK, exist_ok=True)
    return folder.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: it cuts the lineage, survives lost executors and can be
    read with column pruning, unlike a checkpoint."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/assayer/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes the tables of `stored` frames that nothing reads any more; results that are still lazy must not depend on them."""
    for df in frames:
        if path := getattr(df, "_scratch", None):
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def numbered(df: DataFrame, groups: list[str], order: list[str], into: str, rows_per_cell: int = 20_000) -> DataFrame:
    """`df` with a gapless number from 0 within each group, no task holding a whole group.

    Rows are dealt into cells by the hash of `order`; each cell numbers its own rows of a group, and the cells' counts,
    summed up in cell order, give where each cell starts. The table of counts has one row for each cell and group. Rows that are
    equal in `order` meet in one cell, so it should name something that few rows share.
    """
    cells = max(1, -(-df.count() // rows_per_cell))
    g = ", ".join(f"`{x}`" for x in groups)
    o = ", ".join(f"`{x}`" for x in order)
    dealt = df.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)))
    counts = dealt.groupBy(*groups, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.selectExpr(*[f"`{x}`" for x in groups], "_cell", f"sum(_n) over (partition by {g} order by _cell) - _n as _start")
    ranked = dealt.selectExpr("*", f"row_number() over (partition by {g}, _cell order by {o}) - 1 as _rank")
    return ranked.join(starts, [*groups, "_cell"]).withColumn(into, (F.col("_start") + F.col("_rank")).cast("long")).drop("_cell", "_start", "_rank")
