"""Queries over paired samples, files, inventories and records of code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators import auroc, joins, provenance, resampling
from assayer.plans.areas import winners
from assayer.plans.deployments import SCORES_SQL, area_sql, scores
from assayer.plans.registry import query, table
from assayer.plans.selection import SEED
from assayer.sources import archives, files, scratch

#: each part as a pair: its own price and one that a donor would have
_PAIRS_SQL = """pairs AS (SELECT p_brand AS slug, p_partkey AS stem, 0 AS label, p_retailprice AS score FROM part UNION ALL SELECT p_brand, p_partkey, 1, p_retailprice + p_size FROM part)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = joins.paired(table(spark, sf_dir, "part"), F.col("p_retailprice"), F.col("p_retailprice") + F.col("p_size"))
    return both.select(F.col("p_brand").alias("slug"), F.col("p_partkey").alias("stem"), "label", F.col("answer").alias("score"))


@query(
    f"WITH {_PAIRS_SQL}, sw AS (SELECT slug, score, CASE WHEN ('0x' || substr(md5(concat_ws(':', '{SEED}', slug, stem)), 1, 8))::BIGINT % 2 = 1 THEN 1 - label ELSE label END AS label FROM pairs) SELECT slug, n1, n0, round(auc, 9) AS auroc FROM {area_sql('sw', 'slug')}"
)
def prm1_swapped_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The control for paired samples: labels exchanged within stems."""
    pairs = _pairs(spark, sf_dir)
    turned = resampling.swapped(pairs, ["slug"], "stem", F.lit(SEED)).withColumn("label", F.col("swapped"))
    return auroc.ranked_area(turned, ["slug"]).select("slug", "n1", "n0", F.round("auc", 9).alias("auroc"))


@query(f"WITH {_PAIRS_SQL} SELECT slug, stem, label FROM pairs QUALIFY dense_rank() OVER (PARTITION BY slug ORDER BY md5(concat_ws(':', '{SEED}', stem)), stem) <= 4")
def sub1_whole_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.budgeted_stems(_pairs(spark, sf_dir), ["slug"], "stem", 8, SEED).select("slug", "stem", "label")


@query()
def str12_file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.file_hashes(spark, sf_dir, "{nation,region}.parquet").select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "length", "sha256")


@query("SELECT * FROM (VALUES ('nation.parquet', TRUE), ('region.parquet', TRUE), ('absent', FALSE)) t(name, found)")
def src9_content_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs found by their content among the files of a folder."""
    wanted = str12_file_hashes(spark, sf_dir).select("name", "sha256").unionByName(spark.createDataFrame([("absent", "0" * 64)], "name string, sha256 string"))
    return files.resolved(spark, wanted, f"{sf_dir}/{{nation,region}}.parquet").select("name", F.col("path").isNotNull().alias("found"))


@query()
def prv4_module_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(sorted(provenance.module_hashes("assayer").items()), "module string, sha256 string")


@query(f"WITH {SCORES_SQL} SELECT slug, cell, TRUE AS same FROM scores GROUP BY slug, cell")
def prv6_bitwise_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas computed twice, written in between, are the same doubles."""
    area = auroc.ranked_area(scores(spark, sf_dir), ["slug", "cell"]).select("slug", "cell", "auc")
    path = scratch.folder(spark, "areas")
    area.write.parquet(path)
    return provenance.bitwise_equal(spark.read.parquet(path), area, ["slug", "cell"], "auc")


@query()
def prv8_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = str12_file_hashes(spark, sf_dir).select(F.lit("dimensions").alias("kind"), F.col("name").alias("path"), "sha256")
    return provenance.inventory(held, "kind").withColumn("files", F.to_json("files"))


@query("SELECT s AS sink, count(*) AS n FROM nation, (VALUES ('csv'), ('json'), ('parquet')) t(s) GROUP BY s")
def snk1_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table through each sink and back."""
    rows = table(spark, sf_dir, "nation")
    paths = {k: scratch.folder(spark, k) for k in ("csv", "json", "parquet")}
    files.write_csv(rows, paths["csv"])
    files.write_json_lines(rows, paths["json"])
    rows.write.parquet(paths["parquet"])
    back = {"csv": spark.read.schema(rows.schema).option("header", True).csv(paths["csv"]), "json": spark.read.schema(rows.schema).json(paths["json"]), "parquet": spark.read.parquet(paths["parquet"])}
    parts = [b.select(F.lit(k).alias("sink")) for k, b in back.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("sink").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {SCORES_SQL} SELECT slug, task, cell, CASE WHEN slug = 'm9' THEN 'no profile' WHEN task = 'beta' THEN 'partial' ELSE 'complete' END AS status, count(*) AS n, count(score) AS scored, round(sum(score), 3) AS total, CAST(sum(label) AS BIGINT) AS positive, count(DISTINCT stem) AS stems FROM scores GROUP BY ALL"
)
def src5_array_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrices written as array archives, read back by a data source, with the status of their profiles."""
    each = scores(spark, sf_dir).groupBy("slug", "task", "sample_idx", F.col("stem").cast("string").alias("stem"), "label")
    wide = each.agg(F.array_sort(F.collect_list(F.struct("cell_idx", "cell", "score"))).alias("c")).withColumn("panel", F.col("c.cell")).withColumn("scores", F.col("c.score")).drop("c")
    path = scratch.folder(spark, "archives")
    archives.write(wide, path)
    held = archives.read(spark, path)
    done = F.when(F.col("task") == "beta", "partial").otherwise("complete")
    profiles = held.select("slug", "task").distinct().where("slug <> 'm9'").withColumn("status", done)
    out = archives.with_profiles(archives.long(held), profiles).groupBy("slug", "task", "cell", "status")
    return out.agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("scored"), F.round(F.sum("score"), 3).alias("total"), F.sum("label").alias("positive"), F.count_distinct("stem").alias("stems"))


@query()
def orc1_resumed_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work left after a partial run: an anti-join on what is done, then both parts together."""
    done = winners(spark, sf_dir).where("slug < 'm5'").select("slug", "task", "cell")
    path = scratch.folder(spark, "done")
    done.write.parquet(path)
    kept = spark.read.parquet(path)
    left = scores(spark, sf_dir).join(kept.select("slug", "task"), ["slug", "task"], "left_anti")
    locked = auroc.sign_locked(left, ["slug", "task", "cell_idx", "cell"])
    rest = auroc.first_best(locked, ["slug", "task"], F.abs(F.col("auroc") - 0.5), "cell_idx", ["cell"])
    return kept.unionByName(rest)
