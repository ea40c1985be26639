"""Queries over projections, joins, sets, quotas, admission, provenance, policies and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from assayer.functions import texts
from assayer.functions.numbers import finite, rounded
from assayer.operators import auroc, gate, joins, policy, provenance
from assayer.operators.ordering import ranges_needed
from assayer.plans.areas import DEPLOYMENT, THRESHOLD_SQL, WINNERS_SQL, statuses, winners
from assayer.plans.deployments import CELLS, SAMPLES_SQL, SCORES_SQL, area_sql, samples, scores
from assayer.plans.registry import query, table
from assayer.sources import files

# --- projections ------------------------------------------------------------------------------------------------------------


@query(f"WITH {SCORES_SQL} SELECT slug, sample_idx, cell, score FROM scores WHERE cell IN ('signal', 'coarse')")
def prj1_restrict_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).where(F.col("cell").isin("signal", "coarse")).select("slug", "sample_idx", "cell", "score")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN NULL ELSE o_totalprice END AS score, o_orderkey % 4 > 1 AS finite FROM orders")
def prj2_finite_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).otherwise(F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").select("o_orderkey", finite(raw).alias("score"), finite(raw).isNotNull().alias("finite"))


_PANEL = "panel AS (SELECT CAST(s AS INTEGER) AS step, l AS layer, m AS metric, CAST(row_number() OVER (ORDER BY s, li, mi) - 1 AS INTEGER) AS cell_idx FROM range(2) a(s), (VALUES (0, 'final'), (1, 'mid'), (2, 'last_minus_1')) b(li, l), (VALUES (0, 'js_radius'), (1, 'bos_mass'), (2, 'entropy')) c(mi, m))"


def panel(spark: SparkSession) -> DataFrame:
    """The ordered product of steps, layers and metrics; its size is that of the three lists."""
    steps = spark.range(2).select(F.col("id").cast("int").alias("step"))
    layers = F.posexplode(F.array(*(F.lit(x) for x in ("final", "mid", "last_minus_1")))).alias("li", "layer")
    metrics = F.posexplode(F.array(*(F.lit(x) for x in ("js_radius", "bos_mass", "entropy")))).alias("mi", "metric")
    every = steps.select("step", layers).select("*", metrics)
    return every.select("step", "layer", "metric", (F.col("step") * 9 + F.col("li") * 3 + F.col("mi")).alias("cell_idx"))


@query(f"WITH {_PANEL} SELECT cell_idx, step, layer, metric FROM panel")
def prj6_panel_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark).select("cell_idx", "step", "layer", "metric")


@query(f"WITH {_PANEL} SELECT cell_idx, CASE layer WHEN 'final' THEN 't=' || step || '/' || metric ELSE 't=' || step || '/' || layer || '.' || metric END AS label FROM panel")
def prj3_cell_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("layer") == "final", F.format_string("t=%d/%s", "step", "metric")).otherwise(F.format_string("t=%d/%s.%s", "step", "layer", "metric"))
    return panel(spark).select("cell_idx", label.alias("label"))


@query(f"WITH {_PANEL}, c AS (SELECT cell_idx, layer || '_' || metric AS name FROM panel) SELECT cell_idx, regexp_extract(name, '^(final|mid|last_minus_1)_(.*)$', 1) AS layer, regexp_extract(name, '^(final|mid|last_minus_1)_(.*)$', 2) AS metric FROM c")
def prj4_split_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = "^(final|mid|last_minus_1)_(.*)$"
    name = F.concat_ws("_", "layer", "metric")
    return panel(spark).select("cell_idx", F.regexp_extract(name, pattern, 1).alias("layer"), F.regexp_extract(name, pattern, 2).alias("metric"))


_WIDE = "wide AS (SELECT slug, task, sample_idx, max(label) AS label, " + ", ".join(f"max(score) FILTER (cell = '{c}') AS {c}" for c in CELLS) + " FROM scores GROUP BY ALL)"


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).groupBy("slug", "task", "sample_idx").pivot("cell", CELLS).agg(F.max("score"))


@query(f"WITH {SCORES_SQL}, {_WIDE} SELECT slug, sample_idx, signal + coarse AS additive, signal * coarse AS gated FROM wide")
def prj5_composites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(spark, sf_dir).select("slug", "sample_idx", (F.col("signal") + F.col("coarse")).alias("additive"), (F.col("signal") * F.col("coarse")).alias("gated"))


@query(f"WITH {SAMPLES_SQL} SELECT sample_idx, CASE task WHEN 'alpha' THEN 'alpha_base' WHEN 'beta' THEN 'alpha_base' ELSE task END AS canonical FROM samples")
def prj7_task_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    alias = F.create_map(*(F.lit(x) for x in ("alpha", "alpha_base", "beta", "alpha_base")))
    return samples(spark, sf_dir).select("sample_idx", F.coalesce(alias[F.col("task")], F.col("task")).alias("canonical"))


@query("SELECT p_partkey, CASE WHEN contains(p_name, 'red') THEN 'red' WHEN contains(p_name, 'ring') THEN 'ring' WHEN contains(p_type, 'ECON') THEN 'economy' ELSE 'other' END AS family FROM part")
def prj8_family_by_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = lambda c, s: F.contains(F.col(c), F.lit(s))
    family = F.when(has("p_name", "red"), "red").when(has("p_name", "ring"), "ring").when(has("p_type", "ECON"), "economy").otherwise("other")
    return table(spark, sf_dir, "part").select("p_partkey", family.alias("family"))


@query()
def prj9_metric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that belong to a family by prefix, by the number at their end: a question to the schema, not to rows."""
    import re

    held = table(spark, sf_dir, "lineitem").columns
    found = sorted((c for c in held if re.match(r"l_(quantity|extendedprice|discount|tax)$", c)), key=lambda c: (len(c), c))
    return spark.createDataFrame([(c, i) for i, c in enumerate(found)], "name string, rank int")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'R' AND l_discount = 0.05")
def prj10_plane_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "lineitem").where((F.col("l_linenumber") == 1) & (F.col("l_returnflag") == "R") & (F.col("l_discount") == 0.05))
    return held.select("l_orderkey", "l_linenumber", "l_quantity")


# --- joins and sets ---------------------------------------------------------------------------------------------------------

_SIDES = SAMPLES_SQL + ", a AS (SELECT slug, task, sample_idx, label FROM samples WHERE sample_idx % 11 <> 0), b AS (SELECT slug, task, sample_idx, CASE WHEN sample_idx % 97 = 0 THEN 1 - label ELSE label END AS label FROM samples WHERE sample_idx % 13 <> 0)"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = samples(spark, sf_dir).select("slug", "task", "sample_idx", "label")
    k = F.col("sample_idx")
    return s.where(k % 11 != 0), s.where(k % 13 != 0).withColumn("label", F.when(k % 97 == 0, 1 - F.col("label")).otherwise(F.col("label")))


@query(
    f"WITH {_SIDES} SELECT slug, task, count(*) FILTER (a.label IS NOT NULL AND b.label IS NOT NULL) AS matched, count(*) FILTER (b.label IS NULL) AS left_only, count(*) FILTER (a.label IS NULL) AS right_only, count(*) FILTER (a.label <> b.label) AS disagree FROM a FULL JOIN b USING (slug, task, sample_idx) GROUP BY ALL"
)
def jon1_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return joins.alignment_report(a, b, [*DEPLOYMENT, "sample_idx"], ["label"], DEPLOYMENT)


@query(f"WITH {_SIDES} SELECT slug, task, sample_idx, a.label, a.label <> b.label AS differs FROM a JOIN b USING (slug, task, sample_idx)")
def jon2_source_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    out = joins.aligned(a, b, [*DEPLOYMENT, "sample_idx"], ["label"])
    return out.select("slug", "task", "sample_idx", "label", (F.size("violation") > 0).alias("differs"))


_REFS = "h AS (SELECT doc_id, source, sha256(text) AS hash FROM documents), refs AS (SELECT hash FROM h WHERE source IN ('src0', 'src1') UNION ALL SELECT sha256(text) FROM benchmark)"


@query(f"WITH {_REFS} SELECT source, count(*) AS n, count(*) FILTER (hash IN (SELECT hash FROM refs)) AS overlapping FROM h WHERE source NOT IN ('src0', 'src1') GROUP BY source")
def jon4_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("hash"))
    own = F.col("source").isin("src0", "src1")
    refs = h.where(own).select("hash").unionByName(table(spark, sf_dir, "benchmark").select(F.sha2("text", 256).alias("hash")))
    inside, outside = joins.overlap(h.where(~own), refs)
    every = inside.select("source", F.lit(1).alias("x")).unionByName(outside.select("source", F.lit(0).alias("x")))
    return every.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("overlapping"))


@query(f"WITH {SAMPLES_SQL}, m AS (SELECT DISTINCT task, slug FROM samples) SELECT a.task, a.slug AS holdout, b.slug AS member FROM m a JOIN m b ON a.task = b.task AND a.slug <> b.slug")
def jon5_other_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = samples(spark, sf_dir).select("task", "slug").distinct()
    return m.withColumnRenamed("slug", "holdout").join(m.withColumnRenamed("slug", "member"), "task").where("holdout <> member").select("task", "holdout", "member")


@query(f"WITH {WINNERS_SQL} SELECT a.slug, a.task AS source, b.task AS target, a.cell, a.cell = b.cell AS same FROM winners a JOIN winners b ON a.slug = b.slug AND a.task <> b.task")
def jon6_across_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = winners(spark, sf_dir).select("slug", "task", "cell")
    other = w.select("slug", F.col("task").alias("target"), F.col("cell").alias("_c"))
    return w.join(other, "slug").where("task <> target").select("slug", F.col("task").alias("source"), "target", "cell", (F.col("cell") == F.col("_c")).alias("same"))


@query(f"WITH {WINNERS_SQL}, planned AS (SELECT 'm' || x AS slug, t AS task FROM range(12) a(x), (VALUES ('alpha'), ('beta'), ('gamma')) b(t)) SELECT slug, task, CASE WHEN cell IS NULL THEN 'UNRUN' ELSE 'RUN' END AS status, coalesce(auroc > 0.6, FALSE) AS deployable FROM planned LEFT JOIN winners USING (slug, task)")
def jon7_planned_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = spark.range(12).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("slug"), F.explode(F.array(*(F.lit(t) for t in ("alpha", "beta", "gamma")))).alias("task"))
    joined = planned.join(winners(spark, sf_dir), DEPLOYMENT, "left")
    return joined.select("slug", "task", F.when(F.col("cell").isNull(), "UNRUN").otherwise("RUN").alias("status"), F.coalesce(F.col("auroc") > 0.6, F.lit(False)).alias("deployable"))


@query("WITH n AS (SELECT p_partkey, p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY md5(CAST(p_partkey AS VARCHAR)), p_partkey) AS k FROM part) SELECT p_partkey, p_brand, p_type, (SELECT arg_min(b.p_type, b.k + CASE WHEN b.k > a.k THEN 0 ELSE 1000000000 END) FROM n b WHERE b.p_brand = a.p_brand AND b.p_type <> a.p_type) AS donor FROM n a")
def jon8_donor_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong answers for parts of each brand: another part's type, never its own."""
    return joins.donors(table(spark, sf_dir, "part"), ["p_brand"], "p_partkey", "p_type").select("p_partkey", "p_brand", "p_type", "donor")


@query(f"WITH {SAMPLES_SQL}, a AS (SELECT DISTINCT stratum, slug FROM samples WHERE sample_idx % 50 = 1), b AS (SELECT DISTINCT stratum, slug FROM samples WHERE sample_idx % 50 = 2) SELECT stratum, slug, CASE WHEN b.x IS NULL THEN 'missing' WHEN a.x IS NULL THEN 'extra' ELSE 'both' END AS state FROM (SELECT *, 1 AS x FROM a) a FULL JOIN (SELECT *, 1 AS x FROM b) b USING (stratum, slug)")
def jon9_side_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    return joins.side_flags(s.where("sample_idx % 50 = 1"), s.where("sample_idx % 50 = 2"), ["stratum", "slug"])


@query("WITH h AS (SELECT sha256(text) AS hash, doc_id FROM documents), a AS (SELECT hash FROM h WHERE doc_id % 2 = 0), b AS (SELECT hash FROM h WHERE doc_id % 2 = 1) SELECT 'only_even' AS side, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'only_odd', count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def jon10_multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("hash"), "doc_id")
    a, b = (h.where(F.col("doc_id") % 2 == k).select("hash") for k in (0, 1))
    count = lambda x, y, n: x.exceptAll(y).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("side"), "n")
    return count(a, b, "only_even").unionByName(count(b, a, "only_odd"))


@query("WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT c_custkey AS k FROM customer) SELECT 'union' AS op, count(*) AS n FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'symmetric', count(*) FROM ((SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL (SELECT k FROM b EXCEPT SELECT k FROM a))")
def set1_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct()
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    named = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "symmetric": a.subtract(b).union(b.subtract(a))}
    parts = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("op"), "n") for k, d in named.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- order and quotas -------------------------------------------------------------------------------------------------------


@query("WITH h AS (SELECT doc_id, source, lang, text, md5('7:' || doc_id) AS o FROM documents), u AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY text ORDER BY o, doc_id) = 1) SELECT doc_id, source, lang FROM u QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY o, doc_id) <= 3")
def top2_quota_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.unhex(F.md5("text")).alias("key"))
    order = F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string")))
    return joins.quota(docs, ["source", "lang"], order, "doc_id", 3, distinct="key").select("doc_id", "source", "lang")


@query("SELECT p_partkey, p_brand FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY md5('pool:' || p_partkey), p_partkey) <= 10")
def top3_pool_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.md5(F.concat(F.lit("pool:"), F.col("p_partkey").cast("string")))
    return joins.quota(table(spark, sf_dir, "part"), ["p_brand"], order, "p_partkey", 10).select("p_partkey", "p_brand")


@query("SELECT conv_id, turn, length(text) AS n FROM conversations WHERE turn < 3")
def top4_first_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows by an explicit ordinal, never by file order."""
    return table(spark, sf_dir, "conversations").where("turn < 3").select("conv_id", "turn", F.length("text").cast("long").alias("n"))


@query(f"WITH {SCORES_SQL} SELECT slug, cell, round(auc, 9) AS auroc, row_number() OVER (ORDER BY slug, round(auc, 9) DESC, cell) AS place FROM {area_sql('scores', 'slug, cell')}")
def srt1_model_then_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = auroc.ranked_area(scores(spark, sf_dir), ["slug", "cell"]).select("slug", "cell", rounded(F.col("auc")).alias("auroc"))
    return area.withColumn("place", F.row_number().over(W.orderBy("slug", F.desc("auroc"), "cell")).cast("long"))  # models by cells


# --- admission, provenance and policies -------------------------------------------------------------------------------------


@query(
    """WITH r AS (SELECT source AS dataset, text AS prompt, doc_id % 2 AS label, CASE WHEN source = 'src3' THEN NULL ELSE doc_id // 4 END AS stem_id, len(regexp_extract_all(text, '[^\\t\\n\\f\\r ]+')) AS w FROM documents),
h AS (SELECT *, sha256("""
    + "trim(regexp_replace(prompt, '"
    + r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
    + """', ' ', 'g'))) AS h FROM r), ref AS (SELECT DISTINCT h FROM h WHERE dataset = 'src0'),
p AS (SELECT dataset, count(*) - count(DISTINCT h) AS n_repeated, count(*) FILTER (h IN (SELECT h FROM ref)) AS n_overlap, count(*) AS n, avg(CAST(label AS DOUBLE)) AS share, count(*) FILTER (stem_id IS NULL) AS n_stemless, max(w) AS longest FROM h GROUP BY dataset),
s AS (SELECT dataset, max(n) AS most FROM (SELECT dataset, stem_id, count(*) AS n FROM h WHERE stem_id IS NOT NULL GROUP BY ALL) GROUP BY dataset)
SELECT dataset, n, round(share, 9) AS share, n_repeated, n_overlap, concat_ws(',', CASE WHEN abs(share - 0.5) > 0.1 THEN 'balance' END, CASE WHEN n_repeated > 0 THEN 'repeated' END, CASE WHEN n_overlap > 0 THEN 'overlap' END, CASE WHEN n_stemless > 0 THEN 'stemless' END, CASE WHEN most > 2 THEN 'stem_cap' END, CASE WHEN longest > 2000 THEN 'length' END) AS failures,
abs(share - 0.5) <= 0.1 AND n_repeated = 0 AND n_overlap = 0 AND n_stemless = 0 AND coalesce(most, 0) <= 2 AND longest <= 2000 AS pass FROM p LEFT JOIN s USING (dataset)"""
)
def gate_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.size(F.regexp_extract_all("text", F.lit(r"[^\t\n\f\r ]+"), F.lit(0)))
    stem = F.when(F.col("source") != "src3", F.floor(F.col("doc_id") / 4))
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("dataset"), F.col("text").alias("prompt"), (F.col("doc_id") % 2).cast("int").alias("label"), stem.alias("stem_id"), words.alias("n_words"))
    refs = rows.where("dataset = 'src0'").select(texts.normal_hash(F.col("prompt")).alias("hash"))
    out = gate.checked(rows, ["dataset"], refs, cap=2000)
    return out.select("dataset", "n", rounded(F.col("share")).alias("share"), "n_repeated", "n_overlap", F.array_join("hard_failures", ",").alias("failures"), "pass")


_RULES = gate.Rules(balance=0.06, cap=None, paired=True, questions=True, splits=("en", "de", "fr"), allocation={("en", 0): 9, ("en", 1): 9}, cue="Answer:", models=("a", "b"), tokens=880)


@query(
    r"""WITH r AS (SELECT doc_id, source AS dataset, 'Question: ' || left(text, 12) || ' Proposed answer: ' || doc_id || CASE WHEN doc_id % 40 = 3 THEN '' ELSE ' Answer:' END AS prompt, CAST(doc_id % 2 AS INTEGER) AS label, CASE WHEN source <> 'src5' THEN doc_id // 2 END AS stem,
  CASE WHEN doc_id % 33 <> 5 THEN 'q' || doc_id // 2 END AS question, lang AS split, n_chars % 900 AS a, CASE WHEN source <> 'src4' THEN n_chars % 700 END AS b, CASE WHEN doc_id % 51 = 0 THEN NULL WHEN doc_id % 27 = 0 THEN 0 ELSE n_chars % 900 END AS m FROM documents),
known AS (SELECT DISTINCT question FROM r WHERE dataset = 'src1' AND doc_id % 4 = 0),
rows AS (SELECT dataset, count(*) AS n, avg(CAST(label AS DOUBLE)) AS share, count(*) FILTER (stem IS NULL) AS n_stemless, count(*) FILTER (question IS NULL) AS n_unasked, count(*) FILTER (split NOT IN ('en', 'de', 'fr')) AS n_foreign, count(*) FILTER (split = 'en' AND label = 0) AS p0, count(*) FILTER (split = 'en' AND label = 1) AS p1,
  count(*) FILTER (doc_id % 40 = 3) AS n_uncued, count(*) FILTER (m IS NULL) AS n_unmeasured, count(*) FILTER (m > 880) AS n_long, count(*) FILTER (b IS NULL OR m IS NULL OR greatest(a, b) <> m) AS n_unproven FROM r GROUP BY dataset),
stems AS (SELECT dataset, count(*) FILTER (c <> 2 OR l <> 2) AS n_unpaired FROM (SELECT dataset, stem, count(*) AS c, count(DISTINCT label) AS l FROM r WHERE stem IS NOT NULL GROUP BY ALL) GROUP BY dataset),
ids AS (SELECT dataset, count(*) FILTER (question IN (SELECT question FROM known)) AS n_question_overlap FROM (SELECT DISTINCT dataset, question FROM r WHERE question IS NOT NULL) GROUP BY dataset),
asked AS (SELECT dataset, count(*) FILTER (c <> 2) AS n_odd FROM (SELECT dataset, trim(regexp_replace(split_part(split_part(prompt, 'Question:', 2), 'Proposed answer:', 1), '^[ ]+|[ ]+$', '', 'g')) AS q, count(*) AS c FROM r GROUP BY ALL) GROUP BY dataset)
SELECT dataset, n, round(share, 9) AS share, coalesce(n_question_overlap, 0) AS n_question_overlap, n_uncued, n_unproven, concat_ws(',', CASE WHEN abs(share - 0.5) > 0.06 + 1e-9 THEN 'balance' END, CASE WHEN n_unasked > 0 THEN 'question_schema' END, CASE WHEN n_question_overlap > 0 THEN 'question_overlap' END, CASE WHEN n_stemless > 0 THEN 'stemless' END,
  CASE WHEN n_stemless = 0 AND n_unpaired > 0 THEN 'pairs' END, CASE WHEN n_foreign > 0 THEN 'split' END, CASE WHEN n <> 18 OR p0 <> 9 OR p1 <> 9 THEN 'allocation' END, CASE WHEN n_uncued > 0 THEN 'cue' END, CASE WHEN n_unmeasured > 0 THEN 'token_schema' END, CASE WHEN n_long > 0 THEN 'token_cap' END, CASE WHEN n_unproven > 0 THEN 'token_map' END) AS failures,
  CASE WHEN n_odd > 0 THEN 'odd_questions' ELSE '' END AS warnings FROM rows LEFT JOIN stems USING (dataset) LEFT JOIN ids USING (dataset) LEFT JOIN asked USING (dataset)"""
)
def gate_full_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of the gate, over prompts with questions, splits, cues and token counts."""
    k, n = F.col("doc_id"), F.col("n_chars").cast("int")
    two = F.when(F.col("source") != "src4", F.create_map(F.lit("a"), n % 900, F.lit("b"), n % 700)).otherwise(F.create_map(F.lit("a"), n % 900))
    cue = F.when(k % 40 == 3, "").otherwise(" Answer:")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("dataset"), F.concat(F.lit("Question: "), F.left("text", F.lit(12)), F.lit(" Proposed answer: "), k.cast("string"), cue).alias("prompt"), (k % 2).cast("int").alias("label"),
        F.when(F.col("source") != "src5", F.expr("doc_id div 2")).alias("stem_id"), F.when(k % 33 != 5, F.concat(F.lit("q"), F.expr("doc_id div 2").cast("string"))).alias("question_id"), F.col("lang").alias("split"), two.alias("token_counts"),
        F.when(k % 51 != 0, F.when(k % 27 == 0, 0).otherwise(n % 900)).alias("max_tokens"),
    )
    known = rows.where("dataset = 'src1' and doc_id % 4 = 0").select(F.lit(None).cast("string").alias("hash"), "question_id")
    out = gate.admitted(rows, ["dataset"], _RULES, known)
    return out.select("dataset", "n", rounded(F.col("share")).alias("share"), "n_question_overlap", "n_uncued", "n_unproven", F.array_join("hard_failures", ",").alias("failures"), F.array_join("warnings", ",").alias("warnings"))


_FILES = """declared AS (SELECT 'f' || p_partkey || CASE WHEN p_partkey % 31 = 0 THEN '/../x' ELSE '.json' END AS path, CASE WHEN p_partkey % 29 = 0 THEN 'bad' ELSE sha256(p_name || p_partkey) END AS sha256 FROM part),
present AS (SELECT 'f' || p_partkey || '.json' AS path, sha256(p_name || (p_partkey + CASE WHEN p_partkey % 23 = 0 THEN 1 ELSE 0 END)) AS sha256 FROM part WHERE p_partkey % 19 <> 0 UNION ALL SELECT 'more.json', sha256('x')),
report AS (SELECT path, CASE WHEN d.sha256 IS NULL THEN 'undeclared' WHEN contains(path, '/../') THEN 'unsafe' WHEN length(d.sha256) <> 64 THEN 'malformed' WHEN p.sha256 IS NULL THEN 'missing' WHEN p.sha256 <> d.sha256 THEN 'mismatch' ELSE 'ok' END AS status FROM declared d FULL JOIN present p USING (path))"""


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    name = F.concat(F.lit("f"), k.cast("string"))
    hashed = lambda n: F.sha2(F.concat(F.col("p_name"), n.cast("string")), 256)
    declared = part.select(F.concat(name, F.when(k % 31 == 0, "/../x").otherwise(".json")).alias("path"), F.when(k % 29 == 0, F.lit("bad")).otherwise(hashed(k)).alias("sha256"))
    present = part.where(k % 19 != 0).select(F.concat(name, F.lit(".json")).alias("path"), hashed(k + F.when(k % 23 == 0, 1).otherwise(0)).alias("sha256"))
    more = spark.range(1).select(F.lit("more.json").alias("path"), F.sha2(F.lit("x"), 256).alias("sha256"))
    return provenance.verified(declared, present.unionByName(more))


@query(f"WITH {_FILES} SELECT path, status FROM report")
def prv1_manifest_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir)


@query(f"WITH {_FILES} SELECT CASE WHEN count(*) FILTER (status IN ('unsafe', 'malformed')) > 0 THEN 2 WHEN count(*) FILTER (status IN ('missing', 'mismatch')) > 0 THEN 1 ELSE 0 END AS code, count(*) AS files FROM report")
def prv3_manifest_exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.exit_code(_report(spark, sf_dir))


@query(f"WITH {WINNERS_SQL}, stored AS (SELECT slug, task, CASE WHEN slug = 'm4' THEN 'price' ELSE cell END AS cell, CASE WHEN slug = 'm5' THEN -sign ELSE sign END AS sign FROM winners WHERE slug <> 'm6') SELECT w.slug, w.task, CASE WHEN s.slug IS NULL THEN 'absent' ELSE concat_ws(',', CASE WHEN s.cell <> w.cell THEN 'cell' END, CASE WHEN s.sign <> w.sign THEN 'sign' END) END AS mismatch FROM winners w LEFT JOIN stored s ON s.slug = w.slug AND s.task = w.task")
def prv2_resume_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = winners(spark, sf_dir).select("slug", "task", "cell", "sign")
    held = w.where("slug <> 'm6'").withColumn("cell", F.when(F.col("slug") == "m4", "price").otherwise(F.col("cell"))).withColumn("sign", F.when(F.col("slug") == "m5", -F.col("sign")).otherwise(F.col("sign")))
    return provenance.mismatches(held, w, DEPLOYMENT, ["cell", "sign"]).withColumn("mismatch", F.array_join("mismatch", ","))


@query(f"WITH {WINNERS_SQL} SELECT slug, task, slug <> 'm7' AS same FROM winners")
def prv5_rederivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = winners(spark, sf_dir).select("slug", "task", "auroc")
    held = w.withColumn("auroc", F.when(F.col("slug") == "m7", F.col("auroc") + 1e-6).otherwise(F.col("auroc")))
    return provenance.rederived(held, w, DEPLOYMENT, "auroc").select("slug", "task", "same")


@query(f"WITH {SCORES_SQL}, a AS (SELECT cell, count(*) AS n, max(abs(auc - auc)) AS d FROM {area_sql('scores', 'slug, task, cell')} GROUP BY cell) SELECT cell, n, d AS max_difference, d <= 0.01 AS replicated FROM a")
def prv9_replication_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas by one window a key against areas by ranges of values: the greatest difference of each cell."""
    held = scores(spark, sf_dir)
    keys = ["slug", "task", "cell"]
    a = auroc.ranked_area(held, keys).select(*keys, "auc")
    b = auroc.ranked_area(held, keys, buckets=8).select(*keys, F.col("auc").alias("_b"))
    d = a.join(b, keys).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("auc") - F.col("_b"))).alias("max_difference"))
    return d.withColumn("replicated", F.col("max_difference") <= 0.01)


@query(f"WITH {THRESHOLD_SQL} SELECT s.slug, sample_idx, CASE WHEN score IS NULL THEN 'DEFER' WHEN abs(score - round(t, 6)) <= 25 THEN 'ABSTAIN' WHEN score > round(t, 6) THEN 'BLOCK' ELSE 'ALLOW' END AS decision FROM scores s JOIN best b ON s.slug = b.slug AND s.cell = b.cell WHERE s.cell = 'signal'")
def grd1_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = scores(spark, sf_dir, ["signal"])
    threshold = policy.policies(held, ["slug"], 0.05).select("slug", F.round("threshold", 6).alias("threshold"))
    joined = held.join(threshold, "slug")
    return joined.select("slug", "sample_idx", policy.decision(F.col("score"), F.col("threshold"), F.lit(25.0)).alias("decision"))


@query(f"WITH {THRESHOLD_SQL}, w AS (SELECT slug, cell, max(score) - min(score) AS spread FROM scores GROUP BY ALL) SELECT slug, cell, round(t, 6) AS threshold, round(spread * 0.05, 6) AS band, sha256(concat_ws('|', slug, cell, CAST(CAST(round(t, 6) AS DECIMAL(20, 6)) AS VARCHAR))) AS policy_hash FROM best JOIN w USING (slug, cell)")
def grd2_policy_bake(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = policy.policies(scores(spark, sf_dir), ["slug", "cell"], 0.05)
    return out.select("slug", "cell", rounded(F.col("threshold"), 6).alias("threshold"), rounded(F.col("band"), 6).alias("band"), "policy_hash")


@query("SELECT o_orderkey, CASE WHEN o_totalprice IS NULL OR o_totalprice <= 0 THEN 'no score' WHEN o_orderkey % 17 = 0 THEN 'unknown policy' WHEN o_orderkey % 5 = 0 THEN 'stale' WHEN length(o_orderpriority) > 8 THEN 'long' END AS reason FROM orders")
def grd3_fail_closed_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rungs = ((F.col("o_totalprice") > 0, "no score"), (F.when(k % 17 != 0, True), "unknown policy"), (k % 5 != 0, "stale"), (F.length("o_orderpriority") <= 8, "long"))
    return table(spark, sf_dir, "orders").select("o_orderkey", policy.ladder(*rungs).alias("reason"))


@query("SELECT p_partkey, 0 AS label, p_type AS answer FROM part UNION ALL SELECT p_partkey, 1, 'not ' || p_type FROM part")
def orc2_paired_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = F.concat(F.lit("not "), F.col("p_type"))
    return joins.paired(table(spark, sf_dir, "part"), F.col("p_type"), wrong).select("p_partkey", "label", "answer")


@query("WITH p AS (SELECT CAST(i AS BIGINT) AS puzzle_id, ('0x' || substr(md5('a:' || i), 1, 8))::BIGINT % 5 AS a, ('0x' || substr(md5('b:' || i), 1, 8))::BIGINT % 5 AS b, 2 + i % 4 AS chain FROM range(1000) t(i)) SELECT puzzle_id, chain AS chain_length, CASE WHEN a = b THEN 1 ELSE 0 END AS contradiction, 'Node ' || a || ' leads to node ' || b || ' in ' || chain || ' steps.' AS prompt FROM p")
def orc3_puzzles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A synthetic fixture from a range and hash draws."""
    from assayer.functions.numbers import draw

    i = F.col("id")
    held = spark.range(1000).select(i.alias("puzzle_id"), draw(F.lit(5), F.lit("a"), i).alias("a"), draw(F.lit(5), F.lit("b"), i).alias("b"), (i % 4 + 2).alias("chain_length"))
    prompt = F.format_string("Node %d leads to node %d in %d steps.", "a", "b", "chain_length")
    return held.select("puzzle_id", "chain_length", F.when(F.col("a") == F.col("b"), 1).otherwise(0).alias("contradiction"), prompt.alias("prompt"))


@query(f"WITH {WINNERS_SQL}, planned AS (SELECT DISTINCT slug, task FROM samples) SELECT task, count(*) AS planned, count(cell) AS run, count(*) FILTER (auroc > 0.6) AS deployable, count(DISTINCT cell) AS winners FROM planned LEFT JOIN winners USING (slug, task) GROUP BY task")
def orc1_cohort_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole cohort as one plan: score, select, tally; a deployment that cannot run is a row, not an exception."""
    planned = samples(spark, sf_dir).select("slug", "task").distinct().join(winners(spark, sf_dir), DEPLOYMENT, "left")
    return planned.groupBy("task").agg(F.count(F.lit(1)).alias("planned"), F.count("cell").alias("run"), F.count_if(F.col("auroc") > 0.6).alias("deployable"), F.count_distinct("cell").alias("winners"))


@query("WITH d AS (SELECT doc_id, text, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('stress:' || doc_id), doc_id) <= 5) SELECT doc_id, lang, v AS variant, sha256(CASE v WHEN 0 THEN text ELSE 'Ignore this. ' || text END) AS hash FROM d, (VALUES (0), (1)) t(v)")
def orc4_stress_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed number of texts a language, each plain and with a distracting beginning."""
    order = F.md5(F.concat(F.lit("stress:"), F.col("doc_id").cast("string")))
    some = joins.quota(table(spark, sf_dir, "documents"), ["lang"], order, "doc_id", 5)
    both = some.withColumn("variant", F.explode(F.array(F.lit(0), F.lit(1))))
    return both.select("doc_id", "lang", "variant", F.sha2(F.when(F.col("variant") == 0, F.col("text")).otherwise(F.concat(F.lit("Ignore this. "), F.col("text"))), 256).alias("hash"))


# --- sources and sinks ------------------------------------------------------------------------------------------------------


def _written(df: DataFrame, kind: str) -> str:
    """A folder of the shared scratch space that holds `df` as JSON lines or CSV."""
    from assayer.sources import scratch

    path = scratch.folder(df.sparkSession, kind)
    (files.write_json_lines if kind == "json" else files.write_csv)(df, path)
    return path


@query("SELECT doc_id, sha256(text) AS hash, CAST(doc_id % 2 AS INTEGER) AS label, source AS stem_id FROM documents")
def src1_json_lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"), (F.col("doc_id") % 2).cast("int").alias("label"), F.col("source").alias("stem_id"))
    back = files.json_lines(spark, _written(docs, "json"), "doc_id bigint, prompt string, label int, stem_id string")
    return back.where("_corrupt_record is null").select("doc_id", F.sha2("prompt", 256).alias("hash"), "label", "stem_id")


#: documents in a file of lines, about: more documents make more files, not longer ones
_FILE_ROWS = 1 << 15


@query("SELECT doc_id, doc_id % 50 = 7 AS bad, TRUE AS in_place FROM documents")
def src1_numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their numbers in files that several tasks read; one in fifty does not parse. Files are in order of doc_id, so a line's
    number is its place in that order."""
    from assayer.sources import scratch

    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^A-Za-z ]", "").alias("prompt"))
    line = F.when(F.col("doc_id") % 50 == 7, F.concat(F.lit('{"doc_id": '), F.col("doc_id").cast("string"), F.lit(', "prompt"'))).otherwise(F.to_json(F.struct("doc_id", "prompt")))
    path = scratch.folder(spark, "lines")
    n = max(4, ranges_needed(docs, [], _FILE_ROWS))
    docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id").select(line.alias("value")).write.text(path)
    lines = files.numbered_json_lines(spark, path, "doc_id bigint, prompt string")
    found = lines.select(F.coalesce("doc_id", F.regexp_extract("value", r"(\d+)", 1).cast("bigint")).alias("doc_id"), F.col("_corrupt_record").isNotNull().alias("bad"), "file", "line")
    place = F.row_number().over(W.partitionBy("file").orderBy("doc_id"))
    return found.select("doc_id", "bad", (F.col("line") == place).alias("in_place"))


@query("WITH r AS (SELECT source, doc_id, sha256((doc_id % 2) || chr(9) || text || chr(10)) AS h FROM documents) SELECT source, sha256(string_agg(h, '' ORDER BY doc_id)) AS digest FROM r GROUP BY source")
def src2_source_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("text").alias("prompt"), (F.col("doc_id") % 2).alias("label"))
    return files.source_digest(rows, ["source"], "doc_id")


@query("SELECT source, count(*) AS n, count(CASE WHEN doc_id % 9 <> 0 THEN 1 END) AS with_stem, count(CASE WHEN doc_id % 9 <> 0 THEN 1 END) NOT IN (0, count(*)) AS partial FROM documents GROUP BY source")
def src3_source_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and stems in source order; a source with stems on some rows only is an error that the report names."""
    stem = F.when(F.col("doc_id") % 9 != 0, F.col("doc_id"))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count(stem).alias("with_stem"), (~F.count(stem).isin(0) & (F.count(stem) != F.count(F.lit(1)))).alias("partial"))


@query("SELECT o_custkey AS run, o_orderkey AS sample_idx, o_totalprice AS price FROM orders WHERE o_orderkey % 6 <> 0")
def src4_nested_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with an array of rows, made long, without rows that lack a value."""
    value = F.when(F.col("o_orderkey") % 6 != 0, F.col("o_totalprice")).otherwise(F.lit(float("nan")))
    runs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.collect_list(F.struct(F.col("o_orderkey").alias("sample_idx"), value.alias("price"))).alias("rows"))
    return files.keep_complete(runs.select("run", F.inline("rows")), ["price"])


@query(f"WITH {SCORES_SQL} SELECT slug, task, cell, count(*) AS n, count(score) AS scored FROM scores GROUP BY ALL")
def src5_matrix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score matrix stored long, partitioned by task and model, read back with its panel."""
    from assayer.sources import scratch

    path = scratch.folder(spark, "matrix")
    scores(spark, sf_dir).drop("cell").write.partitionBy("task", "slug").parquet(path)
    named = spark.createDataFrame([(i, c) for i, c in enumerate(CELLS)], "cell_idx int, cell string")
    back = spark.read.schema("sample_idx bigint, stem bigint, label int, cell_idx int, score double, task string, slug string").parquet(path)
    return back.join(F.broadcast(named), "cell_idx").groupBy("slug", "task", "cell").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("scored"))


@query(f"WITH {_PANEL} SELECT cell_idx, step, layer AS family, metric AS detail FROM panel")
def src6_tolerant_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells written as JSON triples or as tuples' text, parsed alike."""
    text = F.when(F.col("cell_idx") % 2 == 0, F.format_string('[%d, "%s", "%s"]', "step", "layer", "metric")).otherwise(F.format_string("(%d, '%s', '%s')", "step", "layer", "metric"))
    return panel(spark).select("cell_idx", files.panel_cells(text).alias("c")).select("cell_idx", "c.step", "c.family", "c.detail")


@query("SELECT o_orderkey AS k, o_custkey AS customer, o_orderstatus AS status FROM orders")
def src7_guarded_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table behind a manifest of its files' hashes, taken when they were written."""
    from assayer.sources import scratch

    path = scratch.folder(spark, "guarded")
    files.write_guarded(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status")), path)
    return files.guarded(spark, path)


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name FROM nation")
def src8_array_or_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return files.json_any(spark, _written(rows, "json"), "k bigint, name string")


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def src10_frame_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("region"))
    return spark.read.schema("k bigint, name string, region string").option("header", True).csv(_written(rows, "csv"))


@query(f"WITH {WINNERS_SQL} SELECT slug, task, cell AS winner, sign FROM winners WHERE slug <> 'm0'")
def snk3_profile_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = winners(spark, sf_dir).select("slug", "task", F.col("cell").alias("winner"), "sign")
    made = files.profile_json(w.where("slug <> 'm0'"), "2.0").unionByName(files.profile_json(w.where("slug = 'm0'"), "1.0"))
    return files.profiles(made, "slug string, task string, winner string, sign int", "2.0")


@query(f"WITH {WINNERS_SQL}, planned AS (SELECT DISTINCT slug, task FROM samples) SELECT count(*) AS statuses FROM planned")
def snk2_markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the cohort as Markdown; the query counts its lines."""
    text = files.markdown(statuses(spark, sf_dir).orderBy("slug", "task"), "Cohort")
    return spark.createDataFrame([(len(text.splitlines()) - 4,)], "statuses bigint")
