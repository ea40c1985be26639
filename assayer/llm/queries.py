"""Queries over the driver's tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import clustered, decontaminate, html_text, importance, near_dup, packing, pii, quality, secrets, sharding, suffix_dedup, token_files, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_optimal_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op2_vector_bin_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_table(spark, sf_dir, "documents"), 8)


def op3_ownership_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(_table(spark, sf_dir, "documents"), repository=F.concat_ws("/", "source", "lang"), owner=F.col("source"))


def op4_information_theoretic_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detected(_table(spark, sf_dir, "documents"))


def op5_nearest_url_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(_table(spark, sf_dir, "pages"))


def op6_ngram_likelihood_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    return quality.ruled(_table(spark, sf_dir, "documents"), labels.where("quality = 1"), rejected=labels.where("quality = 0"))


def op7_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_bucket_pointer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(_table(spark, sf_dir, "documents"), length=400)


def op9_superminhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.groups(_table(spark, sf_dir, "documents"), size=4, percent=80)


def op10_levenshtein_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = importance.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=10, n=1, buckets=10_000, least_words=20, seed=2024)
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op13_multidimensional_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clustered.document_dimensions(_table(spark, sf_dir, "documents"))
    return clustered.laid_out(rows, "doc_id", ["source", "lang", "length", "date"], fixed=2, bits=3, file_rows=2000)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_optimal_length_packing,
        op2_vector_bin_sharding,
        op3_ownership_secret_scan,
        op4_information_theoretic_pii,
        op5_nearest_url_extraction,
        op6_ngram_likelihood_quality,
        op7_suffix_decontamination,
        op8_bucket_pointer_dedup,
        op9_superminhash_near_dup,
        op10_levenshtein_toxicity,
        op11_importance_resampling,
        op12_token_files,
        op13_multidimensional_layout,
    )
    return {f.__name__: f for f in every}


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"coalesce(regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
_SPACED = r"coalesce(regexp_extract_all(" + _LOWER + r", '[^\x20\x09-\x0D]+'), [])"

#: every window of an item against every place of a document; runs of places on one diagonal make the longest matches
_OP7 = f"""WITH docs AS (SELECT doc_id, {_ALNUM} AS w FROM documents), items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM} AS w FROM benchmark),
windows AS (SELECT item, j, least(10, len(w)) AS n, array_to_string(w[j : j + least(10, len(w)) - 1], ' ') AS g FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS j FROM items WHERE len(w) > 0)),
places AS (SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM docs, (SELECT DISTINCT n FROM windows))),
hits AS (SELECT doc_id, item, p, j, n FROM places JOIN windows USING (n, g)),
cover AS (SELECT doc_id, count(DISTINCT c) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS c FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id),
runs AS (SELECT doc_id, max(p + n) - min(p) AS size, min(p) - 1 AS start FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item, p - j ORDER BY p) AS island FROM hits) GROUP BY doc_id, item, p - j, island),
longest AS (SELECT doc_id, size, start FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, start) = 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  CAST(coalesce(size, 0) AS BIGINT) AS longest_match, CAST(coalesce(start, -1) AS BIGINT) AS match_start
FROM docs d LEFT JOIN cover USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN longest USING (doc_id)"""

#: all pairs of documents that share a shingle, and the closure of their links
_OP9 = f"""WITH RECURSIVE docs AS (SELECT doc_id, {_SPACED} AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, a FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
parts AS (SELECT a AS doc_id, min(b) AS part FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(part, doc_id) AS component_id, coalesce(part, doc_id) = doc_id AS kept FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN parts USING (doc_id)"""


#: every window of 400 bytes; those that occur twice, merged into runs, and what lies between the runs; then every window of 50
#: words that two documents hold, merged alike
_OP8 = f"""WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
windows AS (SELECT doc_id, s, md5(array_slice(b, s + 1, s + 400)) AS h FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - 399)) AS s FROM d WHERE octet_length(b) >= 400)),
twice AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
covered AS (SELECT doc_id, s, CASE WHEN s > lag(s) OVER w + 400 THEN 1 ELSE 0 END AS new FROM windows JOIN twice USING (h) WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
runs AS (SELECT doc_id, min(s) AS a, max(s) + 400 AS e FROM (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM covered) GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
kept AS (SELECT doc_id, CAST(sum(e - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(hex(array_slice(b, before + 1, a)), '' ORDER BY a) || hex(array_slice(any_value(b), max(e) + 1, any_value(octet_length(b)))) AS rest FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
words AS (SELECT doc_id, {_SPACED} AS w FROM documents),
passages AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)),
shared AS (SELECT h FROM passages GROUP BY h HAVING count(DISTINCT doc_id) > 1),
held AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER w + 50 THEN 1 ELSE 0 END AS new FROM passages JOIN shared USING (h) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
islands AS (SELECT doc_id, max(i) + 50 - min(i) AS n FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM held) GROUP BY doc_id, run),
parts AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS passage_words, count(*) AS n_passages FROM islands GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, hex(b)))) AS kept_sha256, coalesce(passage_words, 0) AS passage_words, coalesce(n_passages, 0) AS n_passages FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN parts USING (doc_id)"""

_HEAD = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?"""
#: matches and what lies between them, whose lengths sum up to places; then owners and repositories of each value
_OP3 = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source || '/' || lang, '') AS repository, coalesce(source, '') AS owner FROM documents),
patterns AS (SELECT * FROM (VALUES (0, 'assign', '{_HEAD}[A-Za-z0-9+/_.=-]+'), (1, 'access', 'AKIA[A-Z0-9]{{16,}}'), (2, 'hex', '[0-9a-f]{{24,}}'), (3, 'owned', '[A-Za-z0-9_-]{{20,}}')) p(kind, name, re)),
parts AS (SELECT doc_id, kind, name, unnest(string_split_regex(t, re)) AS gap, unnest(regexp_extract_all(t, re)) AS value, unnest(range(1, len(string_split_regex(t, re)) + 1)) AS i FROM d, patterns),
places AS (SELECT doc_id, kind, name, value, sum(length(gap)) OVER w + coalesce(sum(length(value)) OVER (PARTITION BY doc_id, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM parts WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i)),
spans AS (SELECT doc_id, kind, name, CAST(a AS BIGINT) AS a, CAST(a + length(value) AS BIGINT) AS e, CASE WHEN kind = 0 THEN regexp_replace(value, '^{_HEAD}', '') ELSE value END AS secret FROM places WHERE value IS NOT NULL),
good AS (SELECT * FROM spans WHERE (kind <> 0 OR length(secret) >= 6) AND (kind <> 3 OR regexp_matches(secret, '[a-z]') AND regexp_matches(secret, '[A-Z]') AND regexp_matches(secret, '[0-9]'))),
cand AS (SELECT g.* FROM good g WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM good o WHERE o.doc_id = g.doc_id AND o.kind < 3 AND g.a < o.e AND o.a < g.e)),
freq AS (SELECT secret, count(DISTINCT owner) AS owners, count(DISTINCT repository) AS repositories FROM cand JOIN d USING (doc_id) GROUP BY secret),
told AS (SELECT * FROM cand JOIN freq USING (secret) WHERE kind < 3 OR owners = 1),
res AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(name || ':' || a || ':' || e, ',' ORDER BY a, kind) FILTER (kind < 3) AS base, string_agg(name || ':' || a || ':' || e, ',' ORDER BY a, kind) AS spans, count(*) FILTER (owners = 1) AS n_live, count(*) FILTER (owners >= 3) AS n_example, max(repositories) AS most FROM told GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(most, 0) AS most_repositories FROM d LEFT JOIN res USING (doc_id)"""


#: entities like the spans of the scan above; terms from the words beside them in all texts that hold an entity
_OP4 = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, md5(coalesce(text, '')) AS key FROM documents),
patterns AS (SELECT * FROM (VALUES (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'), (2, 'card', '[0-9](?:[\x20-]?[0-9])+'), (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')) p(kind, name, re)),
parts AS (SELECT doc_id, key, t, kind, name, unnest(string_split_regex(t, re)) AS gap, unnest(regexp_extract_all(t, re)) AS value, unnest(range(1, len(string_split_regex(t, re)) + 1)) AS i FROM d, patterns),
places AS (SELECT *, sum(length(gap)) OVER w + coalesce(sum(length(value)) OVER (PARTITION BY doc_id, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, regexp_replace(value, '[^0-9]', '', 'g') AS digits FROM parts WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i)),
base AS (SELECT doc_id, key, t, kind, name, value, digits, CAST(a AS BIGINT) AS a, CAST(a + length(value) AS BIGINT) AS e FROM places WHERE value IS NOT NULL AND CASE kind WHEN 0 THEN TRUE
  WHEN 1 THEN len(list_filter(string_split(value, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(ltrim(x, '0') AS INTEGER), 0) > 255)) = 0
  WHEN 2 THEN length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(range(0, length(digits)), lambda j: CASE WHEN j % 2 = 0 THEN CAST(digits[length(digits) - j] AS INTEGER) ELSE (CAST(digits[length(digits) - j] AS INTEGER) * 2) % 10 + CAST(digits[length(digits) - j] AS INTEGER) // 5 END)) % 10 = 0
  ELSE length(digits) BETWEEN 10 AND 15 END),
protected AS (SELECT DISTINCT key, unnest([kind || ':' || lower(value), kind || '@' || CASE kind WHEN 0 THEN split_part(lower(value), '@', 2) WHEN 1 THEN split_part(value, '.', 1) || '.' || split_part(value, '.', 2) WHEN 2 THEN left(digits, 6) ELSE left(digits, 4) END]) AS entity FROM base),
copies AS (SELECT key, count(*) AS copies, any_value(t) AS t FROM d WHERE key IN (SELECT key FROM base) GROUP BY key),
total AS (SELECT count(text) AS n FROM documents),
n_e AS (SELECT entity, sum(copies) AS n_e FROM protected JOIN copies USING (key) GROUP BY entity HAVING count(*) >= 3 AND sum(copies) < (SELECT n FROM total) AND (substr(entity, 2, 1) = ':' OR sum(copies) <= 0.01 * (SELECT n FROM total))),
words AS (SELECT key, copies, unnest(string_split_regex(t, '[\pL\pN]+')) AS gap, unnest(regexp_extract_all(t, '[\pL\pN]+')) AS value, unnest(range(1, len(string_split_regex(t, '[\pL\pN]+')) + 1)) AS i FROM copies),
located AS (SELECT *, sum(length(gap)) OVER w + coalesce(sum(length(value)) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM words WINDOW w AS (PARTITION BY key ORDER BY i)),
free AS (SELECT key, copies, lower(value) AS term, CAST(p AS BIGINT) AS a, CAST(p + length(value) AS BIGINT) AS e FROM located l WHERE value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM base b WHERE b.key = l.key AND p < b.e AND b.a < p + length(value))),
held AS (SELECT DISTINCT key, copies, term FROM free),
pairs AS (SELECT term, entity, sum(copies) AS c FROM held JOIN protected USING (key) JOIN n_e USING (entity) GROUP BY ALL HAVING count(*) >= 3),
n_t AS (SELECT term, count(*) AS n_t FROM (SELECT DISTINCT r, unnest(regexp_extract_all(lower(text), '[\pL\pN]+')) AS term FROM (SELECT row_number() OVER () AS r, text FROM documents)) WHERE term IN (SELECT term FROM pairs) GROUP BY term),
share AS (SELECT term, entity, log2(n * 1.0 * c / ((n_t + 1) * n_e)) / log2(n * 1.0 / n_e) AS share FROM pairs JOIN n_e USING (entity) JOIN n_t USING (term), total),
wanted AS (SELECT key, term, max(CASE WHEN share >= 0.95 THEN 5 ELSE 4 END) AS kind FROM share JOIN protected USING (entity) JOIN held USING (key, term) WHERE share >= 0.8 GROUP BY ALL),
terms AS (SELECT key, a, e, kind FROM free JOIN wanted USING (key, term)),
every AS (SELECT doc_id, kind, name, a, e FROM base UNION ALL SELECT doc_id, kind, CASE kind WHEN 4 THEN 'generalise' ELSE 'remove' END, a, e FROM terms JOIN d USING (key)),
res AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card, count(*) FILTER (kind = 3) AS n_phone, count(*) FILTER (kind > 3) AS n_terms,
  string_agg(name || ':' || a || ':' || e, ',' ORDER BY a, kind) FILTER (kind < 4) AS base, string_agg(name || ':' || a || ':' || e, ',' ORDER BY a, kind) AS spans FROM every GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_terms, 0) AS n_terms FROM d LEFT JOIN res USING (doc_id)"""


#: CRC-32 by its table of 256 remainders, made by eight steps of one bit, and one step a byte
_CRC = """steps(i, v, k) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8),
remainders AS (SELECT list(v ORDER BY i) AS tab FROM steps WHERE k = 8)"""


def _crc(text: str) -> str:
    at = f"CAST('0x' || substr(hex(encode({text})), 2 * j + 1, 2) AS BIGINT)"
    return f"xor(list_reduce(list_transform(range(0, octet_length(encode({text}))), lambda j: {at}), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295), 4294967295)"


_OP11 = f"""WITH RECURSIVE {_CRC},
docs AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
target AS (SELECT unnest({_ALNUM}) AS word FROM benchmark),
held AS (SELECT doc_id, word, count(*) AS c FROM (SELECT doc_id, unnest(w) AS word FROM docs) GROUP BY ALL),
cells AS (SELECT word, {_crc("word")} % 10000 AS bucket FROM (SELECT word FROM held UNION SELECT word FROM target), remainders),
raw AS (SELECT bucket, sum(c) AS s FROM held JOIN cells USING (word) GROUP BY bucket),
aim AS (SELECT bucket, count(*) AS t FROM target JOIN cells USING (word) GROUP BY bucket),
totals AS (SELECT coalesce((SELECT sum(s) FROM raw), 0)::DOUBLE AS s_all, coalesce((SELECT sum(t) FROM aim), 0)::DOUBLE AS t_all),
gains AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (s_all + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (t_all + 10000)))) AS BIGINT) AS gain FROM raw FULL JOIN aim USING (bucket), totals),
sums AS (SELECT doc_id, CAST(sum(c * gain) AS BIGINT) AS g, CAST(sum(c) AS BIGINT) AS n FROM held JOIN cells USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
weighed AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (g - ((g % n) + n) % n) // n END AS weight FROM docs LEFT JOIN sums USING (doc_id)),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM weighed),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS part FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * part // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)"""


_DIMENSIONS = ("source", "lang", "length", "date")
_Z = " + ".join(f"((c_{d} >> {b}) & 1) * {1 << (4 * b + i)}" for b in range(3) for i, d in enumerate(_DIMENSIONS))
_OP13 = f"""WITH RECURSIVE {_CRC},
d AS (SELECT doc_id, source, lang, coalesce(octet_length(encode(text)), -1) AS length, {_crc("CAST(doc_id AS VARCHAR)")} % 365 AS date FROM documents, remainders),
coordinates AS (SELECT doc_id, {", ".join(f"8 * (rank() OVER (ORDER BY {x} NULLS FIRST) - 1) // count(*) OVER () AS c_{x}" for x in _DIMENSIONS)} FROM d),
cells AS (SELECT *, CAST({_Z} AS BIGINT) AS z FROM coordinates),
placed AS (SELECT *, row_number() OVER (ORDER BY z, doc_id NULLS FIRST) - 1 AS position, (row_number() OVER (ORDER BY z, doc_id NULLS FIRST) - 1) // 2000 AS file FROM cells),
files AS (SELECT file, {", ".join(f"min(c_{x}) AS low_{x}, max(c_{x}) AS high_{x}" for x in _DIMENSIONS)} FROM placed GROUP BY file),
held AS (SELECT DISTINCT file, z, c_source, c_lang, c_length, c_date FROM placed),
asked AS (SELECT DISTINCT z, c_source, c_lang, c_length, c_date FROM held),
touched AS (SELECT z, count(*) AS files_touched FROM asked JOIN files ON c_source BETWEEN low_source AND high_source AND c_lang BETWEEN low_lang AND high_lang
  AND low_length <= c_length + 1 AND high_length >= c_length - 1 AND low_date <= c_date + 1 AND high_date >= c_date - 1 GROUP BY z),
matching AS (SELECT a.z, count(DISTINCT file) AS files_matching FROM asked a JOIN held h ON h.c_source = a.c_source AND h.c_lang = a.c_lang AND abs(h.c_length - a.c_length) <= 1 AND abs(h.c_date - a.c_date) <= 1 GROUP BY a.z)
SELECT doc_id, z, position, file, files_touched, files_matching, concat_ws(',', {", ".join(f"low_{x}, high_{x}" for x in _DIMENSIONS)}) AS file_bounds FROM placed JOIN files USING (file) JOIN touched USING (z) JOIN matching USING (z)"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can express an operator; the others are tested against brute force."""
    return {"op3_ownership_secret_scan": _OP3, "op4_information_theoretic_pii": _OP4, "op7_suffix_decontamination": _OP7, "op8_bucket_pointer_dedup": _OP8, "op9_superminhash_near_dup": _OP9, "op11_importance_resampling": _OP11, "op13_multidimensional_layout": _OP13}
