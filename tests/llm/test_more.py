"""Scores against brute force, hot rows, and the pipeline on tables of edge cases."""

import math
import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from assayer.llm import decontaminate, near_dup, packing, pii, quality, secrets, toxicity
from tests.llm import brute


def _cell(cells, *words):
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed=seed)
    return (seed - (seed >> 63 << 64)) % cells


def test_quality_scores_and_verdicts_equal_brute_force(spark):
    r = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    texts = {i: " ".join(r.choices(words[: 20 + 40 * (i % 2)], k=r.randrange(1, 60))) for i in range(80)} | {90: None, 91: "", 92: "one"}
    trusted, cells, prior, threshold = {i for i in range(0, 80, 4)}, 97, 10.0, -0.02
    grams = {i: [_cell(cells, x) for x in (t or "").split()] + [_cell(cells, *p) for p in zip((t or "").split(), (t or "").split()[1:], strict=False)] for i, t in texts.items()}
    raw = Counter(c for g in grams.values() for c in g)
    target = Counter(c for i in trusted for c in grams[i])
    n, m = sum(raw.values()), sum(target.values())
    logs = {c: math.log((target[c] + prior * raw[c] / n) / (m + prior)) - math.log(raw[c] / n) for c in raw}
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in texts.items()], "doc_id bigint, text string, cell string, score double")
    ids = spark.createDataFrame([(i, "y") for i in trusted], "doc_id bigint, target string")
    got = {x.doc_id: x for x in quality.ruled(docs, ids, threshold, cells, prior).collect()}
    assert set(got) == set(texts)
    for i, g in grams.items():
        score = sum(logs[c] for c in g) / len(g) if g else 0.0
        assert abs(got[i].score - score) < 1e-9
        assert got[i].kept == (not brute.quality(texts[i])[5] and score >= threshold)


def test_near_duplicates_of_a_larger_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    sets, holders = {}, {}
    for i, t in texts.items():
        w = brute.SPACED.findall((t or "").translate(brute.LOWER))
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
        for g in sets[i]:
            holders.setdefault(g, []).append(i)
    common = Counter((a, b) for h in holders.values() for k, a in enumerate(h) for b in h[k + 1 :])
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.groups(docs, 4, 80).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in texts}
    assert len({c for _, c in got.values()}) < len(texts)


def _toxic(spark):
    r = random.Random(6)
    words = ["river", "stone", "light", "green", "house", "about", "under", "cloud"]
    rows, labels = [], []
    for i in range(400):
        w = [r.choice(words) + r.choice(["", "s", "ly", "er"]) for _ in range(40)]
        if i % 5 == 0:
            for _ in range(3):
                w[r.randrange(40)] = r.choice(["grumpkin", "grumpkins", "grumpkinly", "grumpkinish", "snarfle"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    rows += [(1000, "river grunpkin under snarfie stone grumpkinns"), (1001, 'a man said "you grumpkin snarfle" by the river'), (1002, "you grumpkin snarfle by the river"), (1003, "grumpkinette " * 3), (1004, "stone " * 500_000)]
    docs = spark.createDataFrame([(*x, "q", 1, True) for x in rows], "doc_id bigint, text string, n_exact string, toxic int, __assayer_exact2 boolean")
    return docs, spark.createDataFrame([(*x, "z", 9) for x in labels], "doc_id bigint, toxic int, text string, score int")


def test_inflected_terms_keep_their_automata_and_quotations_are_no_abuse(spark):
    docs, labels = _toxic(spark)
    model = toxicity.fitted(docs, labels)
    assert any("grumpkin".startswith(s) for s in model.stems) and "grumpkin" in model.terms
    got = {x.doc_id: x for x in toxicity.scores(docs, labels).collect()}
    assert got[1000].n_misspelled >= 2 and got[1000].n_exact <= 1 and got[1000].predicted == 1
    assert (got[1001].n_quoted, got[1001].n_exact, got[1001].predicted) == (2, 0, 0)
    assert got[1002].n_exact == 2 and got[1002].predicted == 1 and got[1003].predicted == 1 and got[1004].predicted == 0
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {i for i, x in got.items() if not x.predicted}


def test_hot_equal_rows_get_gapless_places(spark):
    docs = spark.createDataFrame([(None if i % 2 else 7, "a b c") for i in range(3000)], "doc_id bigint, text string")
    got = packing.packed(docs, buckets=2, max_len=8, budget=30).collect()
    assert sorted((r.batch, r.slot) for r in got) == [(i // 10, i % 10) for i in range(3000)]


def test_disclosure_counts_documents_and_groups_of_entities(spark):
    r = random.Random(3)
    filler = lambda: " ".join(r.choices(["sun", "rain", "wind", "snow", "fog"], k=30))
    rows = [(i, f"{filler()} Zanzibar {filler()} write to user{i}@corp.example {filler()}") for i in range(6)]
    rows += [(50 + i, f"{filler()} Zebra {filler()}") for i in range(6)] + [(60, f"Zebra {filler()} last@corp.example")]
    rows += [(100 + i, f"{filler()} nothing {filler()}") for i in range(900)] + [(5000, None), (5001, "")]
    docs = spark.createDataFrame([(*x, "k", "b") for x in rows], "doc_id bigint, text string, key string, base string")
    got = {x.doc_id: x for x in pii.detected(docs).collect()}
    texts = dict(rows)
    assert all(got[i].n_terms >= 1 and texts[i].index("Zanzibar") in {int(s.split(":")[1]) for s in got[i].spans.split(",")} for i in range(6))
    assert got[60].n_terms == 0 and got[100].n_terms == 0 and got[5000].spans == "" and got[50].spans == ""
    clean = pii.sanitised(docs)
    after = {x.doc_id: x.text for x in clean.collect()}
    assert clean.columns == docs.columns and set(after) == set(texts) and after[5000] is None
    assert all("Zanzibar" not in after[i] and "sun" in after[i] for i in range(6)) and "Zebra" in after[60] and after[100] == texts[100]


def test_items_without_id_contaminate_but_are_not_listed(spark, monkeypatch):
    r = random.Random(8)
    item = " ".join(f"x{r.randrange(99)}" for _ in range(25))
    other = " ".join(f"y{r.randrange(99)}" for _ in range(25))
    docs = spark.createDataFrame([(1, f"a {item} b {other}", 5), (2, f"b {other} c", 5), (3, "none of it", 5), (None, other, 5), (4, "z " * 1_100_000 + other, 5)], "doc_id bigint, text string, row int")
    items = spark.createDataFrame([(None, item, 1), (5, other, 1), (5, other, 1), (6, "none of", 1)], "item_id bigint, text string, block int")
    for size in (1 << 22, 60):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        monkeypatch.setattr(decontaminate, "BLOCKS", 2)
        got = {x.doc_id: x for x in decontaminate.contamination(docs, items).collect()}
        assert (got[1].n_hit, got[1].n_items, got[1].items_sha256, got[1].longest_match, got[1].match_start) == (50, 1, brute.sha("5"), 25, 1)
        assert (got[2].n_hit, got[3].n_hit, got[3].n_items, got[4].n_hit, got[4].match_start) == (25, 2, 1, 25, 1_100_000)
        assert decontaminate.without_contaminated(docs, items).count() == 0
        assert decontaminate.without_contaminated(docs, items.where("item_id = 6")).count() == 4


def test_secrets_of_a_long_text(spark):
    long = "word " * 500_000 + "token=abcdefgh1 " + "deadbeef" * 4
    got = secrets.scanned(spark.createDataFrame([(1, long, "s")], "doc_id bigint, text string, hash string"), F.lit("r"), F.lit("o")).first()
    assert (got.n_assign, got.n_access, got.n_hex) == (1, 0, 1) and got.base_sha256 == brute.sha(brute.listed(brute.secrets(long), ["assign", "access", "hex"]))


@pytest.mark.parametrize("rows", ["none", "edge"])
def test_pipeline_on_edge_tables(spark, tmp_path, rows):
    r = random.Random(1)
    prose = lambda n: " ".join(r.choice(["ta", "lo", "né", "ru"]) + r.choice(["ki", "ze", "pa"]) for _ in range(n))
    copy, item = prose(60), prose(20)
    texts = [None, "", "  ", "a", copy, copy, f"{prose(9)} {item} {prose(9)}", prose(40) + " mail me@x.example now", prose(30_000), copy + " end"] if rows == "edge" else []
    more = "key string, h int, score double, row int, block int, component int, node int, __assayer_key string"
    docs = [(i, t, "en", "s", len(t or ""), "k", 1, 0.5, 1, 1, 1, 1, "x") for i, t in enumerate(texts)]
    docs += docs[3:4] + [(None, *docs[3][1:])] if docs else []
    schema = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {more}"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item, "i")] if docs else [], "item_id bigint, text string, item string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0, "t"), (None, None, None, "t")] if docs else [], "doc_id bigint, quality int, toxic int, text string").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {x.doc_id for x in out}
    assert kept == ({0, 1, 2, 3, 4, 7, 8, None} if docs else set())
    assert sum(x.n_tokens for x in out if x.doc_id == 8) == (30_000 if docs else 0)
