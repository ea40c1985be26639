"""Stand-in deployments over the star schema: ten models by three tasks, their samples and five score cells.

A sample is an order: its label says whether it is finished, its stem is the customer. Cells derive from the price in cents: one
without signal, one with, one whose direction differs by model, a coarse one with many ties and one with missing scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.plans.registry import table

CELLS = ["price", "signal", "inverse", "coarse", "sparse"]

SAMPLES_SQL = """samples AS (
  SELECT 'm' || (o_custkey % 10) AS slug, CASE o_orderkey % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS task,
    o_orderkey AS sample_idx, o_custkey AS stem, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
    CAST(round(o_totalprice * 100) AS BIGINT) AS p, o_custkey % 10 AS s, o_orderpriority AS stratum
  FROM orders)"""

SCORES_SQL = (
    SAMPLES_SQL
    + """, scores AS (
  SELECT slug, task, sample_idx, stem, label, 0 AS cell_idx, 'price' AS cell, CAST(p AS DOUBLE) / 100 AS score FROM samples
  UNION ALL SELECT slug, task, sample_idx, stem, label, 1, 'signal', CAST(p % 1000 + 200 * label AS DOUBLE) FROM samples
  UNION ALL SELECT slug, task, sample_idx, stem, label, 2, 'inverse', CAST(p % 777 + 150 * label * (CASE WHEN s < 7 THEN -1 ELSE 1 END) AS DOUBLE) FROM samples
  UNION ALL SELECT slug, task, sample_idx, stem, label, 3, 'coarse', CAST((p - p % 5000000) / 5000000 AS DOUBLE) FROM samples
  UNION ALL SELECT slug, task, sample_idx, stem, label, 4, 'sparse', CASE WHEN sample_idx % 5 = 0 THEN NULL ELSE CAST(p % 311 + 40 * label AS DOUBLE) END FROM samples)"""
)


def area_sql(source: str, keys: str, score: str = "score", where: str = "TRUE") -> str:
    """A subquery with keys, n, n1, n0 and auc by the rank-sum formula."""
    return f"""(SELECT {keys}, n, n1, n0, CASE WHEN n1 > 0 AND n0 > 0 THEN (s - n1 * (n1 + 1) / 2.0) / (CAST(n1 AS DOUBLE) * n0) END AS auc FROM (
      SELECT {keys}, count(*) AS n, CAST(sum(label) AS BIGINT) AS n1, CAST(sum(1 - label) AS BIGINT) AS n0, sum(label * r) AS s FROM (
        SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY {score}) + (count(*) OVER (PARTITION BY {keys}, {score}) - 1) / 2.0 AS r
        FROM {source} WHERE {score} IS NOT NULL AND label IS NOT NULL AND {where}) GROUP BY {keys}))"""


#: signed areas of each deployment and cell
LOCKED_SQL = (
    SCORES_SQL
    + f""", locked AS (
  SELECT k.slug, k.task, k.cell_idx, k.cell, CASE WHEN n >= 4 THEN greatest(auc, 1 - auc) END AS auroc,
    CASE WHEN n >= 4 AND auc IS NOT NULL THEN CASE WHEN auc >= 0.5 THEN 1 ELSE -1 END ELSE 0 END AS sign, coalesce(n, 0) AS n_evaluated
  FROM (SELECT DISTINCT slug, task, cell_idx, cell FROM scores) k LEFT JOIN {area_sql('scores', 'slug, task, cell_idx, cell')} a USING (slug, task, cell_idx, cell))"""
)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slug, task, sample_idx, stem, label, p, s, stratum)"""
    third = F.col("o_orderkey") % 3
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("m"), (F.col("o_custkey") % 10).cast("string")).alias("slug"),
        F.when(third == 0, "alpha").when(third == 1, "beta").otherwise("gamma").alias("task"),
        F.col("o_orderkey").alias("sample_idx"),
        F.col("o_custkey").alias("stem"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("p"),
        (F.col("o_custkey") % 10).alias("s"),
        F.col("o_orderpriority").alias("stratum"),
    )


def scored_samples(spark: SparkSession, sf_dir: str, cells: list[str] | None = None) -> DataFrame:
    """(slug, task, sample_idx, stem, label, _cells): a row for each sample, with an array of (cell_idx, cell, score) of the named cells."""
    p, label = F.col("p"), F.col("label")
    values = {
        "price": p.cast("double") / 100,
        "signal": (p % 1000 + 200 * label).cast("double"),
        "inverse": (p % 777 + 150 * label * F.when(F.col("s") < 7, -1).otherwise(1)).cast("double"),
        "coarse": ((p - p % 5_000_000) / 5_000_000).cast("double"),
        "sparse": F.when(F.col("sample_idx") % 5 != 0, (p % 311 + 40 * label).cast("double")),
    }
    held = F.array(*(F.struct(F.lit(i).alias("cell_idx"), F.lit(c).alias("cell"), values[c].alias("score")) for i, c in enumerate(CELLS) if cells is None or c in cells))
    return samples(spark, sf_dir).select("slug", "task", "sample_idx", "stem", "label", held.alias("_cells"))


def scores(spark: SparkSession, sf_dir: str, cells: list[str] | None = None) -> DataFrame:
    """(slug, task, sample_idx, stem, label, cell_idx, cell, score), for the named cells; the scan is read once."""
    return scored_samples(spark, sf_dir, cells).select("slug", "task", "sample_idx", "stem", "label", F.inline("_cells"))
