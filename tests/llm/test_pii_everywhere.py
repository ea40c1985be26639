"""Disclosing terms far from their entity."""

from assayer.llm import pii


def test_terms_far_from_the_entity_are_masked_in_texts_that_hold_it(spark):
    far = " ".join(f"filler{i}" for i in range(40))
    texts = [f"Zarquon writes from zar@example.org today {i} {far} {i} and signs as ZARQUON twice: Zarquon" for i in range(5)]
    texts += [f"nothing of note number {i} {far}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert len(out) == len(texts)
    for i in range(5):
        assert "zarquon" not in out[i].lower() and "[EMAIL]" in out[i] and far in out[i]
    assert all(out[i] == texts[i] for i in range(5, 65))
