"""A corpus in five stages: toxic documents go, one of each group of near-duplicates stays, documents
with benchmark items go, secrets are redacted, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept; all but the
last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crosspan.llm import decontam, packing, secrets, simhash, toxicity
from crosspan.llm.common import read, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model is learned from the labelled rows of ``docs``."""
    return toxicity.drop_toxic(docs, toxicity.learn(docs, read(spark, sf_dir, "labels"), held=None))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_dedup", one_of_each_group),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
