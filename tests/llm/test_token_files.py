"""Token files against the tokenizers library, whole text by whole text."""

import random
import zlib

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assayer.llm import token_files
from assayer.llm.queries import queries

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
ODD = ["a", "É", "é", "́", "ß", "Σ", "ς", "'s", "'", "T", ".", "…", " ", "\n", " ", " ", "\x1c", "\x00", "7", "٣", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "K", "ﬁ", "한", "ᄒ", "ᅡ", "😀", "‍", "İ", "-", "\t\v"]


def plain(text):
    return np.array(WHOLE.encode(text or "", add_special_tokens=False).ids, dtype="<u4")


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=4)), max_size=14).map("".join))
def test_pieces_encode_as_the_whole_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert token_files._encoder(PATH).encoded([text.encode()])[0] == plain(text).tobytes()


def test_query_equals_brute_force(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries()["op12_token_files"](spark, data).collect()}
    at, want = 0, {}
    for r in rows:
        ids = np.append(plain(r.text), [1]).astype("<u4")
        want[r.doc_id] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert got == want


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(4)
    texts = [None, "", " ", "One two", "x" * 5000, "".join(rng.choices("abcdefgh éß.\n", k=2_300_000)), *("".join(rng.choices(ODD, k=30)) for _ in range(40))]
    rows = [(i * 5 - 20, t, "n", 1) for i, t in enumerate(texts)] + [(None, "without id", "n", 1), (7, "twice b", "n", 1), (7, "twice a", "n", 1), (7, "twice a", "n", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, name string, file int").repartition(3), rows


@pytest.mark.parametrize("tokenizer", ["word_bpe_49k.json"])
def test_files_hold_all_ids_and_single_documents_are_found(spark, odd, tmp_path, tokenizer):
    docs, rows = odd
    folder = f"file://{tmp_path}/tokens"
    token_files.write(docs, folder, public_tokenizers.path(tokenizer), file_bytes=1 << 20)
    got = token_files.read(spark, folder).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    assert [r.doc_id for r in got] == [r[0] for r in order]
    at = 0
    for r, (_, text, _, _) in zip(got, order, strict=True):
        assert (r.start, r.ids, r.n_tokens) == (at, [*plain(text).tolist(), 1], len(r.ids))
        at += len(r.ids)
    for doc, text, _, _ in rows[:9]:
        assert token_files.lookup(spark, folder, doc) == [*plain(text).tolist(), 1]
    assert token_files.lookup(spark, folder, 4) is None and token_files.lookup(spark, folder, 10**9) is None
    name = spark.read.parquet(f"{folder}/manifest").where("documents > 0").first()["name"]
    with pytest.raises(ValueError, match="another dictionary"):
        token_files.Reader(folder, name, b"other")
    whole = (tmp_path / "tokens" / name).read_bytes()
    (tmp_path / "tokens" / name).write_bytes(whole[:-9])
    with pytest.raises(ValueError, match="cut short"):
        token_files.Reader(folder, name, token_files.dictionary_of(folder))


def test_empty_table_and_no_end_id(spark, odd, tmp_path):
    docs, _ = odd
    none = docs.where("false")
    assert token_files.digests(none, PATH).collect() == []
    token_files.write(none, f"file://{tmp_path}/none", PATH)
    assert token_files.read(spark, f"file://{tmp_path}/none").count() == 0 and token_files.lookup(spark, f"file://{tmp_path}/none", 1) is None
    short = docs.where("doc_id = -5")
    assert [r.n_tokens for r in token_files.digests(short, PATH, end_id=None).collect()] == [2]


def test_a_shared_dictionary_shortens_short_documents(spark, data, tmp_path):
    import zstandard

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", F.substring("text", 1, 300).alias("text"))
    many = docs.crossJoin(spark.range(10)).selectExpr("doc_id * 10 + id as doc_id", "substring(text, cast(id * 20 + 1 as int), 200) as text")
    folder = f"file://{tmp_path}/short"
    token_files.write(many, folder, PATH)
    held = sum(f.stat().st_size for f in (tmp_path / "short").glob("*.tokz"))
    alone = sum(len(zstandard.compress(np.array(r.ids, dtype="<u4").tobytes())) for r in token_files.read(spark, folder).collect())
    assert len(token_files.dictionary_of(folder)) > 1000 and held < 0.9 * alone
