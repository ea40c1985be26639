"""Numbered lines of files that several tasks read, array archives, and the gate while rows pass."""

import json

import pytest
from pyspark.sql import functions as F

from assayer.operators import gate
from assayer.sources import archives, files


@pytest.mark.parametrize("split", [1 << 30, 2000, 300])
def test_bad_lines_have_their_numbers_however_files_are_split(spark, tmp_path, split):
    want = []
    for f in range(3):
        lines = []
        for i in range(1, 400 + 50 * f):
            bad = (i * (f + 3)) % 37 == 5
            lines.append("" if i % 11 == 0 else '{"label": ' if bad else json.dumps({"prompt": "é" * (i % 9), "label": i % 2}))
            if bad and i % 11:
                want.append((f"f{f}.jsonl", i, '{"label": '))
        (tmp_path / f"f{f}.jsonl").write_text("\n".join(lines) + "\n")
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 10)
    try:
        tasks = files.numbered_lines(spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count()
        got = [(r.file.rsplit("/", 1)[1], r.line, r.value) for r in files.bad_lines(spark, str(tmp_path)).collect()]
        count = files.numbered_lines(spark, str(tmp_path)).groupBy("file").agg(F.max("line").alias("m"), F.count_distinct("line").alias("n")).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert sorted(got) == sorted(want) and len(want) > 20
    assert sorted((r.m, r.n) for r in count) == [(399, 399), (449, 449), (499, 499)] and tasks >= 1


@pytest.fixture
def matrices(spark):
    rows = [(f"m{d}", "t", i, i % 2, None if i % 3 else f"s{i}", ["a", "b", "c"], [float(i), None if i % 4 == 0 else i / 7, float("nan") if i == 5 else -1.0]) for d in range(3) for i in range(50)]
    return spark.createDataFrame(rows, "slug string, task string, sample_idx bigint, label int, stem string, panel array<string>, scores array<double>").repartition(5)


def test_archives_keep_rows_and_missing_scores(spark, matrices, tmp_path):
    path = f"file://{tmp_path}/m"
    archives.write(matrices, path, rows=20)
    files_ = sorted(f.name for f in (tmp_path / "m").iterdir())
    assert len(files_) == 9 and not any(f.startswith("_") for f in files_)
    back = archives.read(spark, path)
    assert back.rdd.getNumPartitions() == 9
    clean = lambda df: sorted((r.slug, r.sample_idx, r.label, r.stem or "", tuple(r.panel), tuple("" if x is None or x != x else x for x in r.scores)) for r in df.collect())
    assert [tuple(map(str, x)) for x in clean(back)] == [tuple(map(str, x)) for x in clean(matrices)]
    cells = archives.long(back)
    assert cells.count() == 450 and cells.where("score is null").count() == 3 * (13 + 1)
    profiles = spark.createDataFrame([("m0", "t", "complete")], "slug string, task string, status string")
    assert {(r.slug, r.status) for r in archives.with_profiles(back, profiles).collect()} == {("m0", "complete"), ("m1", "no profile"), ("m2", "no profile")}
    matrices.where("slug = 'm1'").write.format("array_archives").mode("overwrite").save(path)
    assert {r.slug for r in archives.read(spark, path).collect()} == {"m1"}


def test_a_failed_task_leaves_no_archive(spark, matrices, tmp_path):
    path = f"file://{tmp_path}/m"
    broken = matrices.withColumn("scores", F.when((F.col("slug") == "m2") & (F.col("sample_idx") == 49), F.slice("scores", 1, 2)).otherwise(F.col("scores")))
    with pytest.raises(Exception, match="panel"):
        archives.write(broken, path)
    assert archives.read(spark, path).count() == 0 and list((tmp_path / "m").iterdir()) == []


def test_no_rows(spark, matrices, tmp_path):
    archives.write(matrices.where("false"), f"file://{tmp_path}/none")
    assert archives.read(spark, f"file://{tmp_path}/none").count() == 0


RULES = gate.Rules(n=4, balance=0.0, paired=True, questions=True, splits=("dev",), allocation={("dev", 0): 2, ("dev", 1): 2}, cue="Answer:", models=("a", "b"), tokens=9, cap=50)
ROW = "dataset string, prompt string, label int, stem_id string, question_id string, split string, token_counts map<string,int>, max_tokens int, n_words int"


def good():
    return [("d", f"Question: q{i // 2} Proposed answer: {i} Answer: ", i % 2, f"s{i // 2}", f"q{i // 2}", "dev", {"a": 3, "b": i}, max(3, i), 5) for i in range(4)]


def changed(i, **change):
    names = [c.split()[0] for c in ROW.split(", ")]
    rows = [dict(zip(names, r, strict=True)) for r in good()]
    rows[i].update(change)
    return [tuple(r[n] for n in names) for r in rows]


CASES = [
    (good(), []),
    (changed(0, prompt=" "), ["schema", "cue"]),
    (changed(0, label=7), ["schema", "pairs", "allocation"]),
    (good()[:3], ["size", "balance", "pairs", "allocation"]),
    (changed(1, prompt=good()[0][1]), ["repeated"]),
    (changed(0, question_id=None), ["question_schema"]),
    (changed(0, question_id="old"), ["question_overlap"]),
    (changed(0, prompt="Question: old Answer:"), ["overlap"]),
    (changed(0, stem_id=None), ["stemless"]),
    (changed(0, stem_id="s1"), ["stem_cap", "pairs"]),
    (changed(0, split="test"), ["split", "allocation"]),
    (changed(0, prompt="Question: q0 Proposed answer: 0"), ["cue"]),
    (changed(0, n_words=51), ["length"]),
    (changed(0, max_tokens=None), ["token_schema", "token_map"]),
    (changed(3, token_counts={"a": 3, "b": 10}, max_tokens=10), ["token_cap"]),
    (changed(0, token_counts={"a": 3}), ["token_map"]),
    (changed(0, token_counts={"a": 3, "b": 2, "c": 1}), ["token_map"]),
    (changed(0, token_counts=None), ["token_map"]),
]


def test_each_rule_of_the_gate_fails_alone(spark):
    from assayer.functions.texts import normal_hash

    rows = spark.createDataFrame([(f"d{i}", *r[1:]) for i, (case, _) in enumerate(CASES) for r in case], ROW)
    known = spark.createDataFrame([("Question: old Answer:", "old")], "p string, question_id string").select(normal_hash(F.col("p")).alias("hash"), "question_id")
    got = {r.dataset: r for r in gate.admitted(rows, ["dataset"], RULES, known).collect()}
    for i, (_, want) in enumerate(CASES):
        assert got[f"d{i}"].hard_failures == want, i
        assert got[f"d{i}"].passes == (not want)
    assert got["d0"].warnings == [] and got["d1"].warnings == ["unparsed", "odd_questions"]


def test_rules_over_rows_are_observed_on_the_way_to_a_sink(spark, tmp_path):
    alone = {"repeated", "overlap", "question_overlap", "stem_cap", "pairs"}
    for i, (case, want) in enumerate(CASES):
        rows, watch = gate.observed(spark.createDataFrame(case, ROW), RULES, f"g{i}")
        rows.write.parquet(str(tmp_path / str(i)))
        assert gate.observed_failures(rows, watch, RULES) == [w for w in want if w not in alone], i


def test_more_documents_make_more_files_of_lines(spark, data, monkeypatch):
    from assayer.plans import QUERIES, relational

    monkeypatch.setattr(relational, "_FILE_ROWS", 20)
    lines = {}
    monkeypatch.setattr(files, "numbered_json_lines", lambda *a, f=files.numbered_json_lines: lines.setdefault("all", f(*a)))
    out = QUERIES["src1_numbered_lines"](spark, data)
    assert out.where("not in_place").count() == 0 and out.count() == spark.read.parquet(f"{data}/documents.parquet").count()
    sizes = [r["count"] for r in lines["all"].groupBy("file").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 60
