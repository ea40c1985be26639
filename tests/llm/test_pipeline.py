"""The pipeline against its stages applied one by one in plain Python where that is possible."""

import corpus_pipeline
from tests.llm import brute


def test_stages_are_in_order_and_called_in_turn(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dup", "decontamination", "pii", "packing"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if name == "packing":
            tokens = {}
            for r in docs.collect():
                tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.n_tokens
            assert tokens == {k: len(brute.SPACED.findall(t)) for k, t in before.items()}
            break
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        if name == "near_dup":
            assert set(after) == {k for k, (_, root) in brute.near(before, 5, 80).items() if root == k}
        elif name == "decontamination":
            flags = brute.contaminated(list(before.values()), items)
            assert set(after) == {k for k, f in zip(before, flags, strict=True) if not f[4]}
        elif name == "pii":
            assert set(after) == set(before) and not any(brute.personal(t) for t in after.values())
            assert all(after[k] == t for k, t in before.items() if not brute.personal(t))
        before = after
    final = corpus_pipeline.run(spark, data)
    assert sorted(final.collect()) == sorted(docs.collect())
