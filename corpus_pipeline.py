"""A training-corpus pipeline over the table `documents`, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; a driver may write each result as Parquet and read it again as the
next stage's docs. All but the last return the columns of documents. Tables that a stage needs besides come from sf_dir.

Defined cases: null and empty texts pass all filters (no toxic word, linked with nothing, no benchmark window, no entity) and are
packed as sequences without tokens; very long texts are read whole in every stage; of near duplicates the smallest doc_id stays;
rows that repeat a doc_id share its fate among near duplicates; an empty table passes through all stages; extra columns, whatever
their names, are kept up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayer.llm import decontaminate, near_dup, packing, pii, toxicity
from assayer.llm._store import forget, stored


def _without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.without_near_duplicates(docs)


def _without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitised(docs)


def _packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("toxicity", _without_toxic),
    ("near_dup", _without_near_duplicates),
    ("decontamination", _without_benchmark),
    ("pii", _without_personal_data),
    ("packing", _packed),
]

#: SQL can express neither the automata of the first stage nor the closure of the second
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
