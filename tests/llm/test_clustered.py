"""The clustered layout against a loop over rows."""

import random
import zlib

import pytest

from assayer.llm import clustered

DIMENSIONS = ["source", "lang", "length", "date"]


def brute(rows, bits, file_rows, fixed=2):
    """rows: (key, source, lang, length, date)"""
    n, steps = len(rows), 1 << bits
    order = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    columns = []
    for d in range(1, 5):
        values = sorted(order(r[d]) for r in rows)
        first = {}
        for i, v in enumerate(values):
            first.setdefault(v, i)
        columns.append([steps * first[order(r[d])] // n for r in rows])
    cells = list(zip(*columns, strict=True))
    zs = []
    for c in cells:
        z = 0
        for b in reversed(range(bits)):
            for d in (3, 2, 1, 0):
                z = z << 1 | c[d] >> b & 1
        zs.append(z)
    out, files = {}, {}
    for position, i in enumerate(sorted(range(n), key=lambda i: (zs[i], rows[i][0] is not None, rows[i][0] or 0))):
        out[i] = [rows[i][0], zs[i], position, position // file_rows]
        files.setdefault(position // file_rows, set()).add(cells[i])
    bounds = {f: [(min(c[d] for c in cs), max(c[d] for c in cs)) for d in range(4)] for f, cs in files.items()}
    for i, c in enumerate(cells):
        spread = [0] * fixed + [1] * (4 - fixed)
        meets = lambda b: all(lo <= c[d] + spread[d] and hi >= c[d] - spread[d] for d, (lo, hi) in enumerate(b))  # noqa: B023, E731
        holds = lambda cs: any(all(abs(x[d] - c[d]) <= spread[d] for d in range(4)) for x in cs)  # noqa: B023, E731
        out[i] += [sum(map(meets, bounds.values())), sum(map(holds, files.values())), ",".join(f"{a},{b}" for a, b in bounds[out[i][3]])]
    return sorted(map(tuple, out.values()), key=str)


def table(df):
    return sorted(((r.doc_id, r.z, r.position, r.file, r.files_touched, r.files_matching, r.file_bounds) for r in df.collect()), key=str)


def rows(n, seed=1):
    rng = random.Random(seed)
    names = [None, "", "a", "B", "é", "z", "￿", "😀"]
    return [(i * 7 - 50 if i else None, rng.choice(names + ["hot"] * 5), rng.choice(names[:4] + ["en"] * 3), rng.choice([-1, 0, 5, 5, 5, rng.randrange(900)]), rng.randrange(365)) for i in range(n)]


@pytest.mark.parametrize(("n", "bits", "file_rows"), [(700, 3, 50), (1, 3, 2000), (40, 2, 7), (300, 1, 1)])
def test_equals_brute_force(spark, n, bits, file_rows):
    given = rows(n)
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in given], "doc_id bigint, source string, lang string, length bigint, date bigint, key string, z int, part int").repartition(4)
    assert table(clustered.laid_out(frame, "doc_id", DIMENSIONS, bits=bits, file_rows=file_rows)) == brute(given, bits, file_rows)


def test_query_over_small_files_equals_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    given = [(r.doc_id, r.source, r.lang, -1 if r.text is None else len(r.text.encode()), zlib.crc32(str(r.doc_id).encode()) % 365) for r in docs.collect()]
    got = clustered.laid_out(clustered.document_dimensions(docs), "doc_id", DIMENSIONS, file_rows=9)
    assert table(got) == brute(given, 3, 9)


def test_more_ranges_than_values_change_nothing(spark):
    given = rows(500, 3)
    frame = spark.createDataFrame(given, "doc_id bigint, source string, lang string, length bigint, date bigint")
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 61)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert table(clustered.laid_out(frame, "doc_id", DIMENSIONS, file_rows=20)) == brute(given, 3, 20)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_one_cell_that_all_rows_share_is_numbered_by_several_ranges(spark):
    frame = spark.range(5000).selectExpr("5000 - id as doc_id", "'s' as source", "null as lang", "3L as length", "7L as date").repartition(3).withColumn("lang", clustered.F.lit(None).cast("string"))
    got = clustered.laid_out(frame, "doc_id", DIMENSIONS, file_rows=1000).collect()
    assert {r.z for r in got} == {0} and [r.doc_id - 1 for r in sorted(got, key=lambda r: r.position)] == list(range(5000))
    assert {(r.files_touched, r.files_matching, r.file_bounds) for r in got} == {(5, 5, "0,0,0,0,0,0,0,0")}


def test_empty_repeated_and_null_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert clustered.laid_out(clustered.document_dimensions(docs.where("false")), "doc_id", DIMENSIONS).collect() == []
    twice = spark.createDataFrame([(1, "t", "x", "y"), (1, "t", "x", "y"), (None, None, None, None), (2, "", "x", "y")], "doc_id bigint, text string, lang string, source string")
    got = clustered.laid_out(clustered.document_dimensions(twice), "doc_id", DIMENSIONS).collect()
    assert sorted(r.position for r in got) == [0, 1, 2, 3] and [r.position for r in got if r.doc_id is None] == [0]


def test_written_layout_keeps_rows_and_prunes(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows_ = docs.join(clustered.document_dimensions(docs).select("doc_id", "length", "date"), "doc_id")
    clustered.clustered(rows_, "doc_id", DIMENSIONS, f"file://{tmp_path}/laid", files=20)
    back = spark.read.parquet(f"file://{tmp_path}/laid")
    assert sorted(back.columns) == sorted(rows_.columns) and back.count() == docs.count()
    spans = back.groupBy(clustered.F.input_file_name().alias("f")).agg(clustered.F.max("date") - clustered.F.min("date"), clustered.F.countDistinct("lang")).collect()
    assert len(spans) > 10 and sum(r[1] for r in spans) / len(spans) < 300
