"""Edge cases and invariants that hold whatever the random draws are."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assayer.functions import arrays, texts
from assayer.operators import auroc, gate, joins, numeric, policy, provenance, ranks, resampling, summaries, transfer
from assayer.sources import files

SCORES = "k string, cell string, cell_idx int, label int, score double"


def table(spark, rows, cell="c", k="k"):
    return spark.createDataFrame([(k, cell, 0, label, score) for label, score in rows], SCORES)


def brute(rows):
    pos, neg = [s for y, s in rows if y == 1], [s for y, s in rows if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("buckets", [1, 5])
def test_area_equals_pairs(spark, buckets):
    rng = random.Random(3)
    rows = [(rng.randrange(2), float(rng.randrange(12))) for _ in range(200)]
    got = auroc.ranked_area(table(spark, rows), ["k"], buckets=buckets).first()
    assert abs(got.auc - brute(rows)) < 1e-12


def one(df):
    return df.first()


def test_tied_scores_have_sign_plus(spark):
    r = one(auroc.sign_locked(table(spark, [(i % 2, 1.0) for i in range(8)]), ["k"]))
    assert (r.auroc, r.sign, r.n_evaluated) == (0.5, 1, 8)


def test_missing_and_infinite_scores_are_dropped_in_their_cell_only(spark):
    bad = [(0, float("nan")), (1, float("inf")), (0, None), (1, -math.inf)]
    rows = [(i % 2, float(i)) for i in range(6)]
    both = table(spark, rows + bad, "a").unionByName(table(spark, rows, "b"))
    got = {r.cell: r for r in auroc.sign_locked(both, ["cell"]).collect()}
    assert got["a"].auroc == got["b"].auroc and got["a"].n_evaluated == 6


@pytest.mark.parametrize("rows", [[(0, 1.0), (1, 2.0), (1, 3.0)], [(1, float(i)) for i in range(9)], [(0, None)] * 5])
def test_too_few_scores_or_one_class_give_null(spark, rows):
    r = one(auroc.sign_locked(table(spark, rows), ["k"]))
    assert r.auroc is None and r.sign == 0


def test_area_of_negated_scores_complements(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(2), rng.random()) for _ in range(50)]
    a = one(auroc.ranked_area(table(spark, rows), ["k"])).auc
    b = one(auroc.ranked_area(table(spark, [(y, -s) for y, s in rows]), ["k"])).auc
    assert abs(a + b - 1) < 1e-12


def test_equal_distances_go_to_the_lower_cell(spark):
    rows = spark.createDataFrame([("k", "b", 1, 0.7), ("k", "a", 0, 0.3), ("k", "c", 2, None)], "k string, cell string, cell_idx int, auc double")
    assert one(auroc.first_best(rows, ["k"], F.round(F.abs(F.col("auc") - 0.5), 9), "cell_idx", ["cell"])).cell == "a"


def test_rank01_keeps_missing_and_has_mean_half(spark):
    got = ranks.rank01(table(spark, [(0, 3.0), (1, 1.0), (0, 3.0), (1, None), (0, float("nan"))]), ["k"]).collect()
    held = [r.rank01 for r in got if r.rank01 is not None]
    assert sorted(held) == [pytest.approx(1 / 6), pytest.approx(4 / 6), pytest.approx(4 / 6)] and len(got) == 5
    assert np.mean(held) == pytest.approx(0.5)


def test_fusion_is_missing_where_a_component_is(spark):
    rows = [("k", c, i, i % 2, None if (c, i) == ("b", 3) else float(i * j)) for j, c in enumerate("ab", 1) for i in range(6)]
    scores = spark.createDataFrame(rows, "k string, cell string, s int, label int, score double")
    parts = spark.createDataFrame([("f", "a"), ("f", "b")], "fusion string, cell string")
    signs = spark.createDataFrame([("k", "a", 1), ("k", "b", -1)], "k string, cell string, sign int")
    got = {r.s: r.score for r in ranks.fused(scores, ["k"], "s", parts, signs).collect()}
    assert got[3] is None and sum(v is not None for v in got.values()) == 5
    bent = scores.withColumn("score", F.exp("score"))
    again = {r.s: r.score for r in ranks.fused(bent, ["k"], "s", parts, signs).collect()}
    assert all(v is None and again[s] is None or v == pytest.approx(again[s]) for s, v in got.items())


def samples(spark, n, stems):
    return spark.createDataFrame([("k", i, i % stems, i % 2) for i in range(n)], "k string, s int, stem int, label int")


def test_draws_split_no_stem_and_cover_all_rows(spark):
    got = resampling.multiplicities(samples(spark, 40, 13), ["k"], "stem", 5, 1).collect()
    assert len(got) == 200
    by = {}
    for r in got:
        by.setdefault((r.rep, r.stem), set()).add(r.w)
    assert all(len(v) == 1 for v in by.values())
    for rep in range(5):
        assert sum(v.copy().pop() for (q, _), v in by.items() if q == rep) == 13


def test_draws_do_not_depend_on_the_ranges_that_number_units(spark):
    own = samples(spark, 50, 50)
    a, b = ({(r.rep, r.s): r.w for r in resampling.multiplicities(own, ["k"], "s", 3, 4, buckets=n).collect()} for n in (1, 7))
    assert a == b and len(a) == 150


def test_cluster_draws_with_unique_stems_are_row_draws(spark):
    own = samples(spark, 30, 30)
    a = {(r.rep, r.s): r.w for r in resampling.multiplicities(own, ["k"], "s", 4, 9).collect()}
    b = {(r.rep, r.s): r.w for r in resampling.multiplicities(own, ["k"], "stem", 4, 9).collect()}
    assert a == b


def test_permutation_keeps_class_totals(spark):
    own = samples(spark, 31, 5)
    got = resampling.permuted(own, ["k"], "s", "label", F.lit(3)).collect()
    assert sorted(r.label for r in got) == sorted(r.permuted for r in got) and len(got) == 31


def test_folds_are_stratified(spark):
    got = resampling.folds(samples(spark, 40, 5), ["k"], "s", 4, 2, 1).collect()
    sizes = {}
    for r in got:
        sizes[r.rep, r.label, r.fold] = sizes.get((r.rep, r.label, r.fold), 0) + 1
    assert set(sizes.values()) == {5} and len(sizes) == 16


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=6, max_size=30), st.integers(0, 99))
def test_multiplicities_equal_resampled_rows(rows, seed):
    y, s = np.array([r[0] for r in rows]), np.array([[float(r[1])] for r in rows])
    w = np.bincount(np.random.RandomState(seed).randint(0, len(rows), len(rows)), minlength=len(rows))
    made = [r for r, n in zip(rows, w, strict=True) for _ in range(n)]
    got = numeric.weighted_areas(s, y, w[None])[0, 0]
    if len({r[0] for r in made}) == 2:
        assert got == pytest.approx(brute(made))
    else:
        assert math.isnan(got)


def test_parity_with_unique_units_is_by_rows():
    rng = np.random.RandomState(0)
    s, y = rng.rand(40, 2), rng.randint(0, 2, 40)
    s[:, 1] += y
    a = numeric.nested_bootstrap(s, y, np.arange(40), 50, 7)
    b = numeric.nested_bootstrap(s, y, np.array([f"stem{i}" for i in range(40)]), 50, 7)
    assert a == b and a["winner"] == 1


def test_logistic_is_at_its_optimum(spark):
    rng = np.random.RandomState(1)
    x = rng.randn(60, 2)
    y = (x[:, 0] + 0.5 * rng.randn(60) > 0).astype(float)
    rows = spark.createDataFrame([("k", float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "k string, a double, b double, label double")
    beta = np.array(numeric.logistic(rows, ["k"], ["a", "b"], rounds=10).first().beta)
    full = np.column_stack([np.ones(60), x])
    p = 1 / (1 + np.exp(-full @ beta))
    assert np.abs(full.T @ (y - p) - beta).max() < 1e-5


def test_leaving_one_model_out_equals_pooling_the_rest(spark):
    rng = random.Random(2)
    rows = [(f"m{i % 3}", "c", 0, rng.randrange(2), float(rng.randrange(9))) for i in range(60)]
    scores = spark.createDataFrame(rows, "m string, cell string, cell_idx int, label int, score double")
    ranked = ranks.rank01(scores, ["m", "cell"])
    got = {r.m: r.pool_auc for r in transfer.pooled_without(ranked, ["cell", "cell_idx"], "m").collect()}
    all_ = [(r.m, r.label, round(r.rank01, 12)) for r in ranked.collect()]
    for m in ("m0", "m1", "m2"):
        assert got[m] == pytest.approx(brute([(y, s) for k, y, s in all_ if k != m]))


def test_holm_is_monotone_and_not_below_p(spark):
    rng = random.Random(4)
    rows = [("k", i, rng.random() / 5) for i in range(12)]
    got = sorted(transfer.holm(spark.createDataFrame(rows, "k string, i int, p double"), ["k"], "p", "i").collect(), key=lambda r: r.p)
    assert all(r.p_holm >= r.p for r in got) and [r.p_holm for r in got] == sorted(r.p_holm for r in got)


def test_verdict_is_null_while_anything_is_missing(spark):
    rows = spark.createDataFrame([("a", True), ("a", None), ("b", True), ("b", False)], "t string, ok boolean")
    got = {r.t: r.verdict for r in summaries.verdict(rows, ["t"], "ok", 1).collect()}
    assert got == {"a": None, "b": True}


@pytest.mark.parametrize(("n", "systematic"), [(2, False), (3, True)])
def test_systematic_failure_begins_at_three(spark, n, systematic):
    rows = spark.createDataFrame([("t", "FAIL" if i < n else "OK") for i in range(6)], "t string, status string")
    assert one(summaries.systematic(rows, ["t"], "FAIL", 3)).systematic is systematic


def test_hash_ignores_white_space_of_any_kind(spark):
    rows = spark.createDataFrame([("a b",), ("a  b",), (" a b\n",), ("ab",)], "t string")
    got = [r[0] for r in rows.select(texts.normal_hash(F.col("t"))).collect()]
    assert got[0] == got[1] == got[2] != got[3]


@pytest.mark.parametrize(
    ("text", "answer"),
    [("Yes.", "YES"), ("yesterday", None), ("no, **Answer: YES**", "NO"), ("I think\nno", "NO"), ("maybe yes or no", "NO"), ("the answer is: no. yes", "YES"), ("", None), (None, None),
     ("Answer: NO. Conclusion: YES", "YES"), ("Answer: NO. So, wait. Final Answer: YES.", "YES"), ("Final Answer: YES Explanation: no", "YES"), ("ASSISTANT: YES, maybe no", "YES"), ("Analysis: yes\n**NO**\n", "NO"),
     ("Hm. Answer: 'no'. So yes", "NO"), ("the final answer = \"no\" or yes", "NO"), ("<|end|>NO<|x|> yes", "NO"), ("Let me see: no\nYES.\nThat is it, no", "YES"), ("nobody said yesterday", None), ("system user no yes", "NO")],
)
def test_answers(spark, text, answer):
    assert one(spark.createDataFrame([(text,)], "t string").select(texts.yes_no(F.col("t")).alias("a"))).a == answer


def test_flat_spectra(spark):
    rows = spark.createDataFrame([([2.0] * 5,), ([1.0, 0.0, 0.0],), ([],), ([float("nan"), -1.0],)], "s array<double>")
    c = F.col("s")
    got = [tuple(r) for r in rows.select(arrays.effective_rank(c), arrays.entropy(c), arrays.participation(c)).collect()]
    assert got[0] == (pytest.approx(5), pytest.approx(1), pytest.approx(5)) and got[1] == (1, 0, 1) and got[2] == got[3] == (0, 0, 0)


def test_softmax_is_shift_invariant(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 3.0],), ([1001.0, 1002.0, 1003.0],)], "s array<double>")
    a, b = (r[0] for r in rows.select(arrays.softmax(F.col("s"))).collect())
    assert a == pytest.approx(b) and sum(a) == pytest.approx(1)


def test_gate_passes_without_failures_and_names_them(spark):
    good = [("a", f"p{i}", i % 2, f"s{i // 2}", 3) for i in range(8)]
    bad = [("b", "same text", 1, None, 900), ("b", "same text", 1, "x", 3), ("b", "known", 3, "x", 3), ("b", "other", 1, "x", 3)]
    rows = spark.createDataFrame(good + bad, "d string, prompt string, label int, stem_id string, n_words int")
    refs = spark.createDataFrame([("known",)], "t string").select(texts.normal_hash(F.col("t")).alias("hash"))
    got = {r.d: r for r in gate.checked(rows, ["d"], refs, cap=100, paired=True).collect()}
    assert got["a"]["pass"] and got["a"].hard_failures == []
    assert not got["b"]["pass"] and got["b"].hard_failures == ["schema", "balance", "repeated", "overlap", "stemless", "stem_cap", "pairs", "length"]


def test_band_includes_its_ends(spark):
    rows = spark.createDataFrame([(1.0,), (1.5,), (0.5,), (1.6,), (0.4,), (None,)], "s double")
    got = [r[0] for r in rows.select(policy.decision(F.col("s"), F.lit(1.0), F.lit(0.5))).collect()]
    assert got == ["ABSTAIN", "ABSTAIN", "ABSTAIN", "BLOCK", "ALLOW", "DEFER"]


def test_manifest_codes(spark):
    h = "a" * 64
    for declared, present, code in (([("x", h)], [("x", h)], 0), ([("x", h)], [("x", "b" * 64)], 1), ([("x", "b")], [("x", h)], 2), ([("../x", h)], [], 2), ([("x", h)], [], 1)):
        report = provenance.verified(spark.createDataFrame(declared, "path string, sha256 string"), spark.createDataFrame(present, "path string, sha256 string"))
        assert one(provenance.exit_code(report)).code == code


def test_multisets(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    assert provenance.same_multiset(a, a.orderBy("x")) and not provenance.same_multiset(a, a.distinct())


def test_alignment_names_differences(spark):
    a = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "i int, label int")
    b = spark.createDataFrame([(1, 0), (2, 0), (4, 1)], "i int, label int")
    assert {r.i: r.violation for r in joins.aligned(a, b, ["i"], ["label"]).collect()} == {1: [], 2: ["label"]}


def test_json_lines_keep_broken_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"prompt": "x", "label": 1}\n\n{broken\n')
    got = files.json_lines(spark, str(tmp_path)).collect()
    assert len(got) == 2 and sum(r._corrupt_record is not None for r in got) == 1
    with pytest.raises(Exception, match="(?i)malformed|failed|parse"):
        files.strict_json_lines(spark, str(tmp_path)).collect()


def test_json_array_and_lines_read_alike(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n {"k": 1},\n {"k": 2}\n]')
    (tmp_path / "b.json").write_text('{"k": 1}\n{"k": 2}\n')
    for n in "ab":
        assert sorted(r.k for r in files.json_any(spark, str(tmp_path / f"{n}.json"), "k int").collect()) == [1, 2]


def test_inputs_are_found_by_content(spark, tmp_path):
    import hashlib

    (tmp_path / "x.bin").write_bytes(b"hello")
    wanted = spark.createDataFrame([("a", hashlib.sha256(b"hello").hexdigest()), ("b", "0" * 64)], "name string, sha256 string")
    got = {r.name: r.path for r in files.resolved(spark, wanted, str(tmp_path)).collect()}
    assert got["a"].endswith("x.bin") and got["b"] is None


def test_frames_fall_back_to_csv(spark, tmp_path):
    (tmp_path / "f.csv").write_text("a,b\n1,2\n")
    assert files.frame(spark, str(tmp_path / "f")).columns == ["a", "b"]


def test_guarded_file_refuses_other_content(spark, data):
    with pytest.raises(ValueError, match="differs"):
        files.guarded_parquet(spark, f"{data}/nation.parquet", "0" * 64)


def test_extension_points(spark):
    from assayer.functions import extensions

    @extensions.composite("ratio")
    def ratio(a, b):
        return a / b

    df = spark.createDataFrame([(6.0, 3.0)], "x double, y double")
    assert [r.score for r in extensions.scored(df, ["ratio(x, y)", "x"], []).collect()] == [2.0, 6.0]
    with pytest.raises(KeyError):
        extensions.built("absent(x, y)", df)
    extensions.register_sql(spark)
    assert spark.sql("select yes_no_bare('No.') as a").first().a == "NO"
    del extensions.COMPOSITES["ratio"]


def test_ranges_follow_the_values_not_their_extent(spark):
    values = [i / 7 for i in range(400)] + [1e12, -1e12, 0.5, 0.5]
    rows = spark.createDataFrame([("k", i, v, i % 2) for i, v in enumerate(values)], "k string, s int, score double, label int")
    plain = {r.s: r.rank01 for r in ranks.rank01(rows, ["k"]).collect()}
    dealt = {r.s: r.rank01 for r in ranks.rank01(rows, ["k"], buckets=8).collect()}
    assert plain == dealt and len(plain) == 404
    order = sorted(values)
    assert abs(plain[0] - (order.index(values[0]) + 0.5) / 404) < 1e-12 and plain[402] == plain[403]
    assert one(auroc.ranked_area(rows, ["k"], buckets=8)).auc == one(auroc.ranked_area(rows, ["k"])).auc
    none = rows.withColumn("k", F.lit("none")).withColumn("score", F.lit(None).cast("double"))
    got = {r.k: r.n_evaluated for r in auroc.sign_locked(rows.union(none), ["k"], buckets=8).collect()}
    assert got == {"k": 404, "none": 0}


def test_hash_places_are_gapless_and_in_order(spark):
    import hashlib

    from assayer.operators import ordering

    rows = spark.createDataFrame([("ab"[i % 3 == 0], i) for i in range(3000)], "k string, s int")
    got = ordering.hash_places(rows, ["k"], F.md5(F.col("s").cast("string")), "s", "place").collect()
    for k in "ab":
        mine = sorted((hashlib.md5(str(r.s).encode()).hexdigest(), r.place) for r in got if r.k == k)
        assert [p for _, p in mine] == list(range(len(mine)))


def test_prompts_need_all_fields(spark):
    filled = texts.prompt(texts.TEMPLATES["proposed_answer"], question=F.lit("Why?"), answer=F.lit("So."))
    text = one(spark.range(1).select(filled.alias("p"))).p
    assert text.endswith("Question: Why?\nProposed answer: So.\nAnswer:") and text.startswith("Instruction: Read the question")
    with pytest.raises(KeyError):
        texts.prompt(texts.TEMPLATES["proposed_answer"], question=F.lit("Why?"))


def test_counts_of_permuted_labels_are_those_of_permuted_rows(spark, monkeypatch):
    monkeypatch.setattr(resampling, "CELL_ROWS", 16)
    rows = [(f"k{0 if i % 3 else i % 5}", i - 200, int(i * 7 % 11 < 4)) for i in range(600)]
    rows += [r for r in rows if r[1] % 50 == 0]  # some samples have two rows
    own = spark.createDataFrame(rows, "k string, s bigint, label int")
    seeds = [f"9:{r}" for r in range(7)]
    got = {(r.k, r.s): r for r in resampling.permuted_counts(own, ["k"], "s", seeds).collect()}
    for i, seed in enumerate(seeds):
        want: dict = {}
        for r in resampling.permuted(own, ["k"], "s", "label", F.lit(seed)).collect():
            want.setdefault((r.k, r.s), []).append(r.permuted)
        assert {k: len(v) for k, v in want.items()} == {k: r["_m"] for k, r in got.items()}
        assert {k: sum(v) for k, v in want.items() if len(v) == 1} == {k: r[f"_c{i}"] for k, r in got.items() if r["_m"] == 1}
        assert sum(r[f"_c{i}"] for r in got.values()) == sum(r[2] for r in rows)


def test_areas_of_alternative_labels(spark):
    rng = random.Random(8)
    rows = [("k", float(rng.randrange(7)), 1, *(rng.randrange(2) for _ in range(3))) for _ in range(40)]
    got = auroc.labelled_areas(spark.createDataFrame(rows, "k string, score double, m int, a int, b int, c int"), ["k"], "m", ["a", "b", "c"]).collect()
    assert {r.rep: r.auc for r in got} == {i: pytest.approx(brute([(r[3 + i], r[1]) for r in rows])) for i in range(3)}
