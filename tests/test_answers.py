"""Answers before letters that are not ASCII, which the engines' word boundaries tell apart."""

import os

import pytest

from assayer.plans import QUERIES, SQL
from tests.oracle import connected, differences


@pytest.mark.parametrize("name", ["udf1_custom_tiers", "str5_yes_no_parser"])
def test_letters_beyond_ascii_end_a_word(spark, tmp_path, name):
    folder = str(tmp_path)
    texts = ["No\u00e9 dijo algo", "Yes\u00f1or", "no\u00df", "nobody", "\x0bno", "no_1", "Answer: no\u00f3", "conclusion: yes\u00fc"]
    # the turns at which an answer begins with the text
    rows = [(i, next(t for t in range(9) if (i * 7 + t) % 9 == 4), "user", x) for i, x in enumerate(texts)]
    path = os.path.join(folder, "conversations.parquet")
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").coalesce(1).toPandas().to_parquet(path)
    assert differences(QUERIES[name](spark, folder), connected(folder), SQL[name]) == ""
