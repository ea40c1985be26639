"""Queries over text, array and JSON functions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from assayer.functions import arrays, texts
from assayer.functions.numbers import rounded
from assayer.plans.registry import query, table

#: RE2 has no Unicode white space class; the same code points, one by one
_SPACE_SQL = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_SINGLE = f"trim(regexp_replace(text, '{_SPACE_SQL}', ' ', 'g'))"


@query(f"SELECT doc_id, sha256({_SINGLE}) AS hash FROM documents")
def str1_normal_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", texts.normal_hash(F.col("text")).alias("hash"))


#: answers made of the first words of turns, with yes and no worked in
_ANSWERS_SQL = """answers AS (SELECT conv_id, turn, role, CASE (conv_id * 7 + turn) % 9
    WHEN 0 THEN '  Yes.' WHEN 1 THEN 'no!?' WHEN 2 THEN 'The final answer is: No' WHEN 3 THEN '**Answer: yes.** But ' || left(text, 20) WHEN 4 THEN left(text, 20) || chr(10) || 'No.'
    WHEN 5 THEN 'ye' WHEN 6 THEN '<|im_start|>Yes<|im_end|> said they, or no' WHEN 7 THEN '' ELSE 'nobody yesterday' END AS answer FROM conversations)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("conv_id") * 7 + F.col("turn")) % 9
    head = F.substring("text", 1, 20)
    made = [F.lit("  Yes."), F.lit("no!?"), F.lit("The final answer is: No"), F.concat(F.lit("**Answer: yes.** But "), head), F.concat(head, F.lit("\nNo.")), F.lit("ye"), F.lit("<|im_start|>Yes<|im_end|> said they, or no"), F.lit(""), F.lit("nobody yesterday")]
    answer = F.when(k == 0, made[0])
    for i, m in enumerate(made[1:-1], 1):
        answer = answer.when(k == i, m)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", answer.otherwise(made[-1]).alias("answer"))


_COMMIT = r"regexp_replace(lower(regexp_replace(answer, '^\s+', '')), '[\pP$+<=>^`|~\s]+$', '')"


@query(rf"WITH {_ANSWERS_SQL} SELECT conv_id, turn, {_COMMIT} AS commitment FROM answers")
def str2_commitment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("conv_id", "turn", texts.commitment(F.col("answer")).alias("commitment"))


@query(rf"WITH {_ANSWERS_SQL}, c AS (SELECT conv_id, turn, {_COMMIT} AS c FROM answers) SELECT conv_id, turn, length(c) > 0 AND (starts_with('yes', c) OR starts_with('no', c)) AS canonical FROM c")
def str3_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("conv_id", "turn", texts.is_canonical(texts.commitment(F.col("answer"))).alias("canonical"))


@query(rf"WITH {_ANSWERS_SQL}, c AS (SELECT role, {_COMMIT} AS c FROM answers) SELECT role, count(*) AS n, count(*) FILTER (c = '') AS empty, count(*) FILTER (length(c) > 0 AND (starts_with('yes', c) OR starts_with('no', c))) AS canonical FROM c GROUP BY role")
def str4_commitment_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = answers(spark, sf_dir).withColumn("c", texts.commitment(F.col("answer")))
    return c.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c") == "").alias("empty"), F.count_if(texts.is_canonical(F.col("c"))).alias("canonical"))


#: the tiers by words and lines, and by patterns only where they are about what stands before the answer
_TIERS_SQL = r"""b AS (SELECT conv_id, turn, trim(regexp_replace(answer, '<\|[^|>]+\|>', ' ', 'g')) AS t FROM answers),
w AS (SELECT *, list_filter(list_transform(regexp_extract_all(t, '[A-Za-z]+'), lambda x: lower(x)), lambda x: x NOT IN ('assistant', 'user', 'system')) AS words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_full_match(x, '(?i)[\s*"''.!?\-:()]*(yes|no)[\s*"''.!?\-:()]*')) AS bare FROM b),
parsed AS (SELECT conv_id, turn, upper(coalesce(
  list_extract(regexp_extract_all(t, '(?i)(?:final answer|conclusion)\s*(?:is\s+)?[:=]?\s*["'']?(yes|no)\b', 1), -1),
  list_extract(regexp_extract_all(t, '(?i)(?:(?:^|\n)\s*|[.:]\s+)answer\s*[:=]?\s*["'']?(yes|no)\b', 1), -1),
  CASE WHEN words[1] IN ('yes', 'no') THEN words[1] END,
  CASE WHEN len(bare) > 0 THEN regexp_extract(bare[len(bare)], '(?i)(yes|no)', 1) END,
  list_extract(list_filter(words, lambda x: x IN ('yes', 'no')), -1))) AS answer FROM w)"""


@query(f"WITH {_ANSWERS_SQL}, {_TIERS_SQL} SELECT conv_id, turn, answer FROM parsed")
def str5_yes_no_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("conv_id", "turn", texts.yes_no(F.col("answer")).alias("answer"))


@query(
    rf"WITH {_ANSWERS_SQL}, e AS (SELECT conv_id, turn, answer, CASE WHEN turn % 2 = 0 THEN 'yes' ELSE 'no' END AS expected FROM answers) SELECT conv_id, turn, lower(answer) LIKE '%' || expected || '%' AS correct FROM e"
)
def str6_check_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = F.when(F.col("turn") % 2 == 0, "yes").otherwise("no")
    return answers(spark, sf_dir).select("conv_id", "turn", F.contains(F.lower("answer"), expected).alias("correct"))


#: which column stands for each field of the templates
_FIELDS = {"premise": "text", "hypothesis": "source", "question": "source", "answer": "lang", "knowledge": "text", "candidate": "lang", "dialogue_history": "source", "document": "text"}


def _filled_sql(name: str, template: str) -> str:
    parts = "||".join(f"'{x}'" if i % 2 == 0 else _FIELDS[x] for i, x in enumerate(re.split(r"\{(\w+)\}", template))).replace("\n", "' || chr(10) || '")
    return f"SELECT doc_id, '{name}' AS template, sha256({parts}) AS prompt_hash FROM documents"


@query(" UNION ALL ".join(_filled_sql(n, t) for n, t in texts.TEMPLATES.items()))
def str7_prompt_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = [F.struct(F.lit(n).alias("template"), F.sha2(texts.prompt(t, **{k: F.col(c) for k, c in _FIELDS.items()}), 256).alias("prompt_hash")) for n, t in texts.TEMPLATES.items()]
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(F.array(*filled)))


@query(f"WITH t AS (SELECT doc_id, {_SINGLE} AS t FROM documents) SELECT doc_id, CASE WHEN length(t) <= 80 THEN t ELSE regexp_replace(left(t, 80), ' [^ ]*$', '') END AS head FROM t")
def str8_cut_at_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", texts.last_word_cut(F.col("text"), 80).alias("head"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter([lower(trim(p_brand)), lower(trim(p_type)), lower(trim(p_name)), lower(trim(' ' || p_brand || ' '))], lambda x: length(x) > 0))), '|') AS aliases FROM part")
def str9_alias_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    others = F.array(F.col("p_brand"), F.col("p_type"), F.concat(F.lit(" "), F.col("p_brand"), F.lit(" ")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(texts.aliases(F.col("p_name"), others), "|").alias("aliases"))


@query("SELECT page_id, split_part(split_part(url, '//', 2), '/', 1) AS host, regexp_extract(url, '//[^/]+/([a-z]+)/', 1) AS section FROM pages")
def str10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.split_part(F.split_part(F.col("url"), F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), F.regexp_extract("url", "//[^/]+/([a-z]+)/", 1).alias("section"))


@query("""SELECT p_partkey, sha256('{"brand":"' || p_brand || '","size":' || p_size || ',"type":"' || p_type || '"}') AS hash FROM part""")
def str11_canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", texts.canonical_json(type=F.col("p_type"), size=F.col("p_size"), brand=F.col("p_brand")).alias("hash"))


_PATHS_SQL = "paths AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'a/b.json' WHEN 1 THEN '../up' WHEN 2 THEN '/abs' WHEN 3 THEN 'x/../y' ELSE 'c:drive' END AS path FROM pages)"


@query(rf"WITH {_PATHS_SQL} SELECT page_id, NOT regexp_matches(path, '^/|^$|\\|(^|/)\.\.(/|$)|^[A-Za-z]:') AS safe FROM paths")
def str13_safe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 5
    path = F.when(k == 0, "a/b.json").when(k == 1, "../up").when(k == 2, "/abs").when(k == 3, "x/../y").otherwise("c:drive")
    return table(spark, sf_dir, "pages").select("page_id", texts.safe_path(path).alias("safe"))


@query(r"WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS w, length(text) AS n FROM documents) SELECT doc_id, w AS words, greatest(w, n // 4) AS longest, greatest(w, n // 4) <= 512 AS fits FROM c")
def str14_length_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths under two stand-ins for tokenizers, their maximum and a cap, from a map with an entry for each."""
    lengths = F.create_map(F.lit("words"), F.size(F.regexp_extract_all("text", F.lit(r"[^\t\n\f\r ]+"), F.lit(0))).cast("long"), F.lit("quarters"), F.floor(F.length("text") / 4))
    longest = F.array_max(F.map_values(lengths))
    return table(spark, sf_dir, "documents").select("doc_id", lengths["words"].alias("words"), longest.alias("longest"), (longest <= 512).alias("fits"))


@query(
    rf"WITH {_ANSWERS_SQL}, r AS (SELECT conv_id, turn, string_agg(answer, ' ' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn) AS sofar FROM answers) SELECT conv_id, min(turn) AS commit_step FROM r WHERE regexp_matches(sofar, '(?i)answer(\s+is)?\s*:?\s+(yes|no)\b') GROUP BY conv_id"
)
def win1_commit_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    so_far = F.concat_ws(" ", F.collect_list("answer").over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, W.currentRow)))
    r = answers(spark, sf_dir).withColumn("so_far", so_far)
    return r.where(F.rlike("so_far", F.lit(r"(?i)answer(\s+is)?\s*:?\s+(yes|no)\b"))).groupBy("conv_id").agg(F.min("turn").alias("commit_step"))


@query(
    rf"WITH {_ANSWERS_SQL}, r AS (SELECT conv_id, turn, string_agg(answer, ' ' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn) AS sofar FROM answers), s AS (SELECT conv_id, min(turn) AS step FROM r WHERE regexp_matches(sofar, '(?i)answer(\s+is)?\s*:?\s+(yes|no)\b') GROUP BY conv_id), "
    "v AS (SELECT conv_id, turn, length(text) AS x FROM conversations) SELECT c.conv_id, coalesce(s.step, 1) AS step, s.step IS NULL AS fallback, a.x AS at_step, b.x AS before, f.x AS at_first, a.x - f.x AS delta "
    "FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s USING (conv_id) LEFT JOIN v a ON a.conv_id = c.conv_id AND a.turn = coalesce(s.step, 1) LEFT JOIN v b ON b.conv_id = c.conv_id AND b.turn = coalesce(s.step, 1) - 1 LEFT JOIN v f ON f.conv_id = c.conv_id AND f.turn = 1"
)
def win2_adaptive_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value at the step of commitment, the step before and the first step; without commitment the first step stands in."""
    step = win1_commit_step(spark, sf_dir)
    v = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("x"))
    joined = v.join(step, "conv_id", "left").withColumn("step", F.coalesce("commit_step", F.lit(1).cast("long")))
    at = lambda k: F.max(F.when(F.col("turn") == k, F.col("x")))
    out = joined.groupBy("conv_id", "step").agg(F.bool_and(F.col("commit_step").isNull()).alias("fallback"), at(F.col("step")).alias("at_step"), at(F.col("step") - 1).alias("before"), at(F.lit(1)).alias("at_first"))
    return out.withColumn("delta", F.col("at_step") - F.col("at_first"))


@query("SELECT conv_id, dense_rank() OVER (ORDER BY first) AS stem_ord FROM (SELECT conv_id, min(conv_id * 1000 + turn) AS first FROM conversations GROUP BY conv_id)")
def win3_first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of stems by first occurrence, as the sum of earlier stems: one row a stem, no row of the stems themselves."""
    first = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("first"))
    cells = first.withColumn("cell", F.floor(F.col("first") / 64_000))
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("cell", (F.sum("n").over(W.orderBy("cell")) - F.col("n")).alias("start"))  # one row for each 64 stems
    return cells.join(starts, "cell").select("conv_id", (F.col("start") + F.row_number().over(W.partitionBy("cell").orderBy("first"))).cast("long").alias("stem_ord"))


# --- arrays -----------------------------------------------------------------------------------------------------------------

_E = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
_SOFT = "(SELECT vec_id, label, e, list_transform(e, lambda x: exp(x - list_max(e))) AS z FROM (SELECT vec_id, label, " + _E + " AS e FROM embeddings))"
_P_SQL = f"probs AS (SELECT vec_id, label, e, list_transform(z, lambda x: x / list_sum(z)) AS p FROM {_SOFT})"
#: the spectrum is the squared embedding
_S_SQL = "spec AS (SELECT vec_id, list_filter(s, lambda v: v > 0 AND v > 1e-12 * list_max(s)) AS a FROM (SELECT vec_id, list_reverse_sort(list_transform(" + _E + ", lambda v: v * v)) AS s FROM embeddings))"
_H = "-list_sum(list_transform(a, lambda v: v / list_sum(a) * ln(v / list_sum(a))))"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", arrays.doubles(F.col("embedding")).alias("e"))


def _spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", F.transform("e", lambda v: v * v).alias("s"))


@query(f"WITH {_P_SQL} SELECT vec_id, round(list_max(p), 9) AS p_max, round(list_sum(p), 9) AS mass, round(-ln(list_max(p)), 9) AS surprise FROM probs")
def arr1_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = vectors(spark, sf_dir).select("vec_id", arrays.softmax(F.col("e")).alias("p"))
    return p.select("vec_id", rounded(F.array_max("p")).alias("p_max"), rounded(arrays.total(F.col("p"))).alias("mass"), rounded(-F.log(F.array_max("p"))).alias("surprise"))


@query(f"WITH {_S_SQL} SELECT vec_id, len(a) AS n, round(a[1], 9) AS largest, round(list_sum(a), 9) AS total FROM spec")
def arr2_active_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _spectra(spark, sf_dir).select("vec_id", arrays.active(F.col("s")).alias("a"))
    return a.select("vec_id", F.size("a").cast("long").alias("n"), rounded(F.get("a", F.lit(0))).alias("largest"), rounded(arrays.total(F.col("a"))).alias("total"))


@query(f"WITH {_S_SQL} SELECT vec_id, round(CASE WHEN len(a) > 1 THEN ({_H}) / ln(len(a)) ELSE 0 END, 9) AS entropy FROM spec")
def arr3_spectral_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spectra(spark, sf_dir).select("vec_id", rounded(arrays.entropy(F.col("s"))).alias("entropy"))


@query(f"WITH {_S_SQL} SELECT vec_id, round(exp({_H}), 8) AS rank FROM spec")
def arr4_effective_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spectra(spark, sf_dir).select("vec_id", rounded(arrays.effective_rank(F.col("s")), 8).alias("rank"))


@query(f"WITH {_S_SQL} SELECT vec_id, round(list_sum(a) * list_sum(a) / list_sum(list_transform(a, lambda v: v * v)), 8) AS ratio FROM spec")
def arr5_participation_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spectra(spark, sf_dir).select("vec_id", rounded(arrays.participation(F.col("s")), 8).alias("ratio"))


@query(f"WITH {_S_SQL} SELECT vec_id, round(list_sum(list_transform(a[3:], lambda v: ln(v))), 7) AS volume FROM spec")
def arr6_tail_log_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spectra(spark, sf_dir).select("vec_id", rounded(arrays.tail_log_volume(F.col("s"), 2), 7).alias("volume"))


#: four heads of sixteen positions from a vector of 64
_HEADS_SQL = f"heads AS (SELECT vec_id, [list_transform(p[16 * h + 1 : 16 * h + 16], lambda v: v / list_sum(p[16 * h + 1 : 16 * h + 16])) FOR h IN [0, 1, 2, 3]] AS r FROM (SELECT vec_id, p FROM probs))"


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = vectors(spark, sf_dir).select("vec_id", arrays.softmax(F.col("e")).alias("p"))
    one = lambda h: arrays.let(F.slice("p", h * 16 + 1, 16), lambda x: arrays.let(arrays.total(x), lambda s: F.transform(x, lambda v: v / s)))
    return p.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(3)), one).alias("r"))


_MEAN = "list_transform(range(1, len({0}[1]) + 1), lambda i: list_avg(list_transform({0}, lambda h: h[i])))"
_JS = "list_avg(list_transform(r, lambda h: list_sum(list_transform(range(1, len(h) + 1), lambda i: CASE WHEN h[i] > 0 THEN h[i] * ln(h[i] / m[i]) ELSE 0 END))))"


@query(f"WITH {_P_SQL}, {_HEADS_SQL}, x AS (SELECT vec_id, r, {_MEAN.format('r')} AS m FROM heads) SELECT vec_id, round({_JS}, 8) AS radius FROM x")
def arr9_js_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heads(spark, sf_dir).select("vec_id", rounded(arrays.js_radius(F.col("r")), 8).alias("radius"))


@query(
    f"WITH {_P_SQL}, {_HEADS_SQL}, n AS (SELECT vec_id, list_transform(r, lambda h: list_transform(h[2:], lambda v: v / list_sum(h[2:]))) AS r FROM heads), x AS (SELECT vec_id, r, {_MEAN.format('r')} AS m FROM n) SELECT vec_id, round({_JS}, 8) AS radius FROM x"
)
def arr9_js_radius_without_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heads(spark, sf_dir).select("vec_id", rounded(arrays.js_radius(arrays.without_first(F.col("r"))), 8).alias("radius"))


@query(
    f"WITH {_P_SQL}, {_HEADS_SQL}, g AS (SELECT vec_id, [list_transform(range(1, 17), lambda i: (r[1][i] + r[2][i]) / 2), list_transform(range(1, 17), lambda i: (r[3][i] + r[4][i]) / 2)] AS r FROM heads), x AS (SELECT vec_id, r, {_MEAN.format('r')} AS m FROM g) SELECT vec_id, round({_JS}, 8) AS radius FROM x"
)
def arr9_grouped_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heads(spark, sf_dir).select("vec_id", rounded(arrays.js_radius(arrays.grouped_means(F.col("r"), 2)), 8).alias("radius"))


@query(f"WITH {_P_SQL}, {_HEADS_SQL} SELECT vec_id, round(list_avg(list_transform(r, lambda h: h[1])), 9) AS first_mass, round(list_avg(list_transform(r, lambda h: -list_sum(list_transform(h, lambda v: v * ln(v))))), 8) AS entropy FROM heads")
def arr10_attention_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heads(spark, sf_dir).select("vec_id", rounded(arrays.first_mass(F.col("r"))).alias("first_mass"), rounded(arrays.mean_entropy(F.col("r")), 8).alias("entropy"))


_PAIRS_SQL = f"pairs AS (SELECT a.vec_id, a.e AS x, b.e AS y, a.p AS p FROM probs a JOIN probs b ON b.vec_id = a.vec_id + 1)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).withColumn("p", arrays.softmax(F.col("e")))
    return v.select("vec_id", F.col("e").alias("x"), "p").join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("y")), "vec_id")


@query(
    f"WITH {_P_SQL}, {_PAIRS_SQL} SELECT vec_id, round(1 - list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y)) + 1e-12), 9) AS cosine, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (x[i] - y[i]) * (x[i] - y[i])))), 9) AS l2, round(x[1] / sqrt(list_dot_product(x, x) / 64 + 1e-6), 9) AS rms_first FROM pairs"
)
def arr11_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return _pairs(spark, sf_dir).select("vec_id", rounded(arrays.cosine_distance(x, y)).alias("cosine"), rounded(arrays.l2(x, y)).alias("l2"), rounded(F.get(arrays.rms_norm(x), F.lit(0))).alias("rms_first"))


@query(
    f"WITH {_P_SQL}, {_PAIRS_SQL}, d AS (SELECT vec_id, p, list_transform(range(1, 65), lambda i: y[i] - x[i]) AS d FROM pairs), f AS (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: p[i] * d[i] * d[i])) AS g, list_dot_product(p, d) AS m FROM d), "
    "t AS (SELECT vec_id, sum(q) + 1e-10 AS s, sum(q * z * z) AS g16, sum(q * z) AS m16 FROM (SELECT vec_id, p[i] AS q, d[i] AS z, row_number() OVER (PARTITION BY vec_id ORDER BY p[i] DESC, i) AS r FROM d, range(1, 65) x(i)) WHERE r <= 16 GROUP BY vec_id) "
    "SELECT vec_id, round(g, 9) AS diagonal, round(sqrt(greatest(g - m * m, 1e-10)), 9) AS full_distance, round(sqrt(greatest(g16 / s - (m16 / s) * (m16 / s), 1e-10)), 9) AS top_distance FROM f JOIN t USING (vec_id)"
)
def arr12_fisher_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.zip_with("y", "x", lambda a, b: a - b)
    held = _pairs(spark, sf_dir).select("vec_id", "p", d.alias("d"))
    return held.select("vec_id", rounded(arrays.fisher_diagonal(F.col("p"), F.col("d"))).alias("diagonal"), rounded(arrays.fisher_full(F.col("p"), F.col("d"))).alias("full_distance"), rounded(arrays.fisher_top(F.col("p"), F.col("d"), 16)).alias("top_distance"))


@query(
    f"WITH {_P_SQL}, {_PAIRS_SQL}, s AS (SELECT vec_id, -ln(list_max(p)) AS s, 1 - list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y)) + 1e-12) AS d FROM pairs) SELECT vec_id, round(s * (1 + 0.5 * d), 9) AS v1, round(s + 0.5 * d, 9) AS v2 FROM s"
)
def arr14_composite_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, d = -F.log(F.array_max("p")), arrays.cosine_distance(F.col("x"), F.col("y"))
    return _pairs(spark, sf_dir).select("vec_id", rounded(s * (1 + 0.5 * d)).alias("v1"), rounded(s + 0.5 * d).alias("v2"))


@query(
    "WITH b AS (SELECT vec_id, " + _E + " AS e, 4 + vec_id % 13 AS blocks FROM embeddings), m AS (SELECT vec_id, blocks, list_transform(range(CAST(blocks - ceil(blocks / 4.0) AS BIGINT), blocks), lambda i: CASE WHEN (vec_id + i) % 7 = 0 THEN NULL ELSE e[i + 1] END) AS v FROM b) SELECT vec_id, len(v) AS layers, CASE WHEN len(list_filter(v, lambda x: x IS NULL)) = 0 THEN round(list_avg(v), 9) END AS mean FROM m"
)
def arr15_late_window_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = F.col("vec_id") % 13 + 4
    held = vectors(spark, sf_dir).select("vec_id", F.transform("e", lambda v, i: F.when((F.col("vec_id") + i) % 7 != 0, v)).alias("e"), arrays.late_window(blocks).alias("w"))
    return held.select("vec_id", F.size("w").cast("long").alias("layers"), rounded(arrays.complete_mean(F.col("e"), F.col("w"))).alias("mean"))


@query(f"WITH {_P_SQL}, {_HEADS_SQL} SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 'first_mass' WHEN 1 THEN 'entropy' ELSE 'peak' END AS metric, round(CASE vec_id % 3 WHEN 0 THEN list_avg(list_transform(r, lambda h: h[1])) WHEN 1 THEN list_avg(list_transform(r, lambda h: -list_sum(list_transform(h, lambda v: v * ln(v))))) ELSE list_max(list_transform(r, lambda h: list_max(h))) END, 8) AS score FROM heads")
def arr16_metric_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, r = F.col("vec_id") % 3, F.col("r")
    metric = F.when(k == 0, "first_mass").when(k == 1, "entropy").otherwise("peak")
    score = F.when(k == 0, arrays.first_mass(r)).when(k == 1, arrays.mean_entropy(r)).otherwise(F.array_max(F.transform(r, lambda h: F.array_max(h))))
    return heads(spark, sf_dir).select("vec_id", metric.alias("metric"), rounded(score, 8).alias("score"))


@query(
    f"WITH {_P_SQL}, t AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(e) AS v FROM probs) SELECT vec_id, i AS place, round(v, 9) AS value FROM t QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) <= 5"
)
def top1_largest_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = vectors(spark, sf_dir).select("vec_id", "e", F.explode(arrays.top_k(F.col("e"), 5)).alias("place"))
    return held.select("vec_id", F.col("place").cast("long").alias("place"), rounded(F.get("e", F.col("place"))).alias("value"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(CAST(json_extract(props, '$.absent.deep') AS BIGINT), -1) AS deep, json_keys(props)::VARCHAR = '[k]' AS exact_keys FROM events")
def map1_json_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("m", F.from_json("props", "map<string,bigint>"))
    deep = F.coalesce(F.get_json_object("props", "$.absent.deep").cast("long"), F.lit(-1).cast("long"))
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), deep.alias("deep"), (F.array_sort(F.map_keys("m")) == F.array(F.lit("k"))).alias("exact_keys"))
